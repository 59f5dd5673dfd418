"""Model results as they are landed: payloads of any shape, their candidates and canonical properties.

A payload is a VARIANT: a bare object, an array, ``{"models": [{"candidates" or "results": ...}]}``, ``{"results": [...]}``,
``{"candidates": [...]}``, in any nesting, or the rows of a delimited table.  Everything works within a row (generators and
functions on arrays), so nothing is shuffled; a payload file is read by one task.
"""

from __future__ import annotations

import functools
import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NUMBER, let
from .consensus import PROPERTIES

#: Names under which a property is reported; the first is the canonical one (fixed values).
ALIASES = {
    "tc": ["tc_K", "Tc_K", "tc", "Tc", "critical_temperature_K"],
    "gap": ["band_gap_eV", "bandgap_eV", "band_gap", "bandgap"],
    "formation": ["formation_energy_eV_atom", "formation_energy", "e_form_eV_atom"],
    "hull": ["e_above_hull_eV_atom", "energy_above_hull", "e_hull", "ehull"],
    "moment": ["magnetic_moment_muB", "magmom", "magnetic_moment"],
}
#: What a value in a unit is divided by (fixed values).
DIVISORS = {
    "tc": {"k": 1.0},
    "gap": {"ev": 1.0, "mev": 1000.0},
    "formation": {"ev/atom": 1.0, "mev/atom": 1000.0},
    "hull": {"ev/atom": 1.0, "mev/atom": 1000.0},
    "moment": {"μb": 1.0, "mub": 1.0, "bohrmagneton": 1.0, "bohrmagnetons": 1.0},
}
ERRORS = ["INVALID_PROPERTY_VALUE", "CONFLICTING_PROPERTY_UNITS", "AMBIGUOUS_PROPERTY_UNIT", "UNSUPPORTED_PROPERTY_UNIT", "INVALID_PROPERTY_RANGE", "CONFLICTING_PROPERTY_ALIASES"]
VARIANTS = "map<string,variant>"


def _objects(v: Column) -> Column:
    return F.try_variant_get(v, "$", VARIANTS)


def _present(s: Column) -> Column:
    return F.coalesce((F.trim(s) != "") & (s != "[]"), F.lit(False))


def table_rows(text: Column, sep: Column) -> Column:
    """Array of maps from header to value of a delimited text; quoted fields may hold separators, quotes and line ends."""
    quoted = '"(?:[^"]|"")*+"'
    lines = F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit(rf'((?:[^"\r\n]++|{quoted})*+)(?:\r\n|\r|\n)'), F.lit(1))
    unquote = lambda f: F.trim(F.when(F.trim(f).startswith('"'), F.replace(F.regexp_replace(F.trim(f), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(f))
    # A separator in front of every field makes the first one like the others.
    pattern = F.concat(sep, F.lit(rf'((?:[^"'), sep, F.lit(rf']++|{quoted})*+)'))
    fields = lambda line: F.transform(F.regexp_extract_all(F.concat(sep, line), pattern, F.lit(1)), unquote)
    kept = F.filter(F.transform(lines, fields), lambda r: F.exists(r, lambda c: c != ""))
    header, rows = F.get(kept, F.lit(0)), F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0)))
    return F.transform(rows, lambda r: F.map_from_entries(F.transform(header, lambda h, i: F.struct(h, F.coalesce(F.get(r, i), F.lit(""))))))


def read_payloads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(payloads, errors) of the files below ``path``.

    payloads: file, payload (VARIANT).  JSON is what ends in .json or begins with '[' or '{'; anything else is a table, by tabs
    if the name ends in .tsv or its first line has more tabs than commas.  errors: file, error_code, one of EMPTY_INPUT,
    INVALID_JSON, UNBALANCED_CSV_QUOTE, DUPLICATE_HEADER and EMPTY_TABLE.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    raw = raw.select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", r"^[\s\x{feff}]+|\s+$", "").alias("text"))
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    first = F.regexp_extract("text", r"^([^\r\n]*)", 1)
    raw = raw.withColumns({
        "is_json": F.lower("file").endswith(".json") | F.col("text").rlike(r"^[\[{]"),
        "sep": F.when(F.lower("file").endswith(".tsv") | (count(first, "\t") > count(first, ",")), "\t").otherwise(","),
    })
    balanced = F.length(F.regexp_replace("text", '[^"]', "")) % 2 == 0
    names = F.transform(F.split(first, F.col("sep")), lambda h: F.trim(F.replace(h, F.lit('"'), F.lit(""))))
    unique = F.size(F.array_distinct(names)) == F.size(names)
    raw = raw.withColumns({"json": F.when(F.col("is_json"), F.try_parse_json("text")), "rows": F.when(~F.col("is_json") & balanced & unique, table_rows(F.col("text"), F.col("sep")))})
    code = (
        F.when(F.col("text") == "", "EMPTY_INPUT").when(F.col("is_json"), F.when(F.col("json").isNull(), "INVALID_JSON"))
        .when(~balanced, "UNBALANCED_CSV_QUOTE").when(~unique, "DUPLICATE_HEADER").when(F.size("rows") < 1, "EMPTY_TABLE")
    )
    coded = raw.withColumn("error_code", code)
    payload = F.coalesce(F.col("json"), F.parse_json(F.to_json("rows")))
    return coded.where("error_code IS NULL").select("file", payload.alias("payload")), coded.where("error_code IS NOT NULL").select("file", "error_code")


def candidates(payloads: DataFrame, payload: str = "payload", depth: int = 6) -> DataFrame:
    """One row for each candidate object, with the other columns, ``path`` (its places, outermost first), ``model`` and ``candidate``.

    The model's name is pushed down from the innermost block that has one; a column ``model`` of the input is the default.
    Scalars and nulls yield nothing.  Containers nested deeper than ``depth`` raise.
    """
    keep = [c for c in payloads.columns if c not in (payload, "model", "path", "candidate")]
    default = F.col("model").cast("string") if "model" in payloads.columns else F.lit(None).cast("string")
    step = payloads.select(*keep, F.array().cast("array<int>").alias("path"), default.alias("model"), F.col(payload).alias("candidate"), F.lit(False).alias("found"))
    lists = lambda p: F.try_variant_get("candidate", p, "array<variant>")
    named = lambda v, *paths: F.coalesce(*[F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths])
    given = lambda v, p: F.when(_present(F.try_variant_get(v, p, "string")) | F.try_variant_get(v, p, "array<variant>").isNotNull(), F.variant_get(v, p, "variant"))
    item = lambda v, m, found=False: F.struct(v.alias("v"), m.alias("m"), F.lit(found).alias("found"))
    container = F.coalesce(lists("$.models"), lists("$.results"), lists("$.candidates"), lists("$")).isNotNull()
    inherited = F.coalesce(named(F.col("candidate"), "$.model", "$.name"), F.col("model"))
    block = lambda b: item(F.coalesce(given(b, "$.candidates"), given(b, "$.results")), F.coalesce(named(b, "$.model", "$.name"), F.col("model")))
    # A list is read once, and what was found to be a candidate is passed on as it is.
    of = lambda p, m: let(lists(p), lambda x: F.when(x.isNotNull(), let(m, lambda name: F.transform(x, lambda v: item(v, name)))))
    inside = F.coalesce(let(lists("$.models"), lambda x: F.transform(x, block)), of("$.results", inherited), of("$.candidates", inherited), of("$", F.col("model")))
    itself = F.array(item(F.col("candidate"), F.col("model"), True))
    children = F.when(F.col("found"), itself).otherwise(F.coalesce(inside, F.when(_objects(F.col("candidate")).isNotNull(), itself)))
    for _ in range(depth):
        level = step.select(*keep, "path", F.posexplode(children).alias("pos", "x"))
        place = F.when(F.col("x.found"), F.col("path")).otherwise(F.concat("path", F.array("pos")))
        step = level.select(*keep, place.alias("path"), F.col("x.m").alias("model"), F.col("x.v").alias("candidate"), F.col("x.found").alias("found"))
    deep = F.when(container, F.raise_error(F.lit("PAYLOAD_DEPTH_EXCEEDED"))).otherwise(_objects(F.col("candidate")).isNotNull())
    return step.where(F.when(F.col("found"), True).otherwise(deep)).drop("found")


_TARGETS = {a.lower(): p for p, names in ALIASES.items() for a in names}
_SPECS = [(p, names[0], a, False) for p, names in ALIASES.items() for a in names] + [(p, names[0], names[0], True) for p, names in ALIASES.items()]
_SPELLINGS = [(re.compile(a, re.ASCII), to) for a, to in [("kelvin", "k"), ("electronvolts?", "ev"), ("peratom", "/atom"), (r"atom\^-?1|atom-1", "/atom"), (r"[·*\s]+", "")]]
_STRICT = re.compile(NUMBER[:-1] + r"(\r\n|[\r\n])?\Z", re.ASCII)  # Java's $


class _Number(str):
    """A number as it is written."""


def _plain(x: object) -> str | None:
    """A JSON value as text: strings and numbers as written, anything else as JSON."""
    if x is None or isinstance(x, str):
        return x
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_nested(v)}" for k, v in x.items()) + "}"
    return "[" + ",".join(map(_nested, x)) + "]" if isinstance(x, list) else json.dumps(x)


def _nested(x: object) -> str:
    return json.dumps(x) if x is None or isinstance(x, str) and not isinstance(x, _Number) else _plain(x)


def _said(x: object) -> str | None:
    """The text of a value that is there: not null, blank or an empty list."""
    text = _plain(x)
    return None if text is None or text.strip(" ") == "" or text == "[]" else text


@functools.lru_cache(10_000)
def unit_key(u: str) -> str:
    """A unit's name without case, blanks and spelling variants."""
    s = u.strip(" ").lower().replace("µ", "μ")
    for pattern, to in _SPELLINGS:
        s = pattern.sub(to, s)
    return s


def _number(text: str) -> float | None:
    t = text.strip(" ")
    return float(t) if _STRICT.search(t) else None


def _reported(v: dict) -> list[tuple[str, str, str, object]]:
    """property, canonical name, key and value of all that a record reports, in the order of their precedence."""
    inner = v["properties"] if isinstance(v.get("properties"), dict) else {}
    out = [(p, name, alias, raw) for p, name, alias, nested in _SPECS if (raw := (inner if nested else v).get(alias)) is not None and _said(raw) is not None]
    named = next((t for k in ("target_definition", "target", "property") if (t := _said(v.get(k))) is not None), "")
    target, value = _TARGETS.get(named.strip(" ").lower()), _said(v.get("value"))
    if target and value is not None and _number(value) is not None:
        out.append((target, ALIASES[target][0], "value", v["value"]))
    return out


def _read(v: dict, p: str, name: str, alias: str, raw: object, one: bool, whole: str | None) -> tuple[str | None, list[float | None]]:
    """The error code and the values of one reported property."""
    fields = raw if isinstance(raw, dict) else {}
    texts = [t for k in ("value", "mean", "prediction") if (t := _said(fields.get(k))) is not None] if isinstance(raw, dict) else [_plain(raw)]
    units = v["units"] if isinstance(v.get("units"), dict) else {}
    given = [v.get(f"{name}_unit"), v.get(f"{alias}_unit"), units.get(name), units.get(alias), fields.get("unit")]
    own = list(dict.fromkeys(unit_key(u) for u in map(_said, given) if u is not None))
    unit = own[0] if own else whole if one and whole is not None else ""
    divisor = 1.0 if unit == "" else DIVISORS[p].get(unit)
    code = ERRORS[0] if not texts else ERRORS[1] if len(own) > 1 else ERRORS[2] if not one and whole is not None and not own else ERRORS[1] if one and own and whole is not None and own[0] != whole else None
    numbers = [_number(t) for t in texts]
    values = [None if x is None or divisor is None else x / divisor for x in numbers]
    for x, y in zip(numbers, values, strict=True):
        code = code or (ERRORS[0] if x is None or math.isinf(x) else ERRORS[3] if y is None else None if PROPERTIES[p][1] <= y <= PROPERTIES[p][2] else ERRORS[4])
    return code, values


def _canonical(v: dict) -> tuple[list[tuple[str, float | None]], str | None]:
    """(properties, error) of one record."""
    found, unit = _reported(v), _said(v.get("unit"))
    names, whole = list(dict.fromkeys(f[0] for f in found)), None if unit is None else unit_key(unit)
    codes, values = {n: None for n in names}, {n: [] for n in names}
    for f in found:
        code, some = _read(v, *f, len(names) == 1, whole)
        codes[f[0]] = codes[f[0]] or code
        values[f[0]] += some
    for n in names:
        first = next(iter(values[n]), None)
        if codes[n] is None and any(abs(x - first) > max(1e-12, abs(first) * 1e-12) for x in values[n]):
            codes[n] = ERRORS[5]
    error = next((codes[n] for n in names if codes[n]), None)
    return [] if error else [(n, values[n][0]) for n in names], error


def canonical_properties(df: DataFrame, column: str = "candidate") -> DataFrame:
    """Adds ``properties`` (array of property, value in the canonical unit) and ``error`` to rows of candidate objects.

    A property is read from every alias, from the object ``properties`` (canonical names) and from ``value`` where ``target_definition``,
    ``target`` or ``property`` names it.  A value may be an object with value, mean, prediction and unit.  All that is reported for
    a property has to agree to 1e-12.  A row with an error (the first of ``ERRORS`` met, aliases before nested names before ``value``)
    has no properties; a row that reports nothing has an empty list and no error, like one that is no object.

    Candidates travel to Python as JSON: as functions on arrays, which Spark interprets, the rules took many times as long.
    """

    @F.arrow_udf("struct<properties:array<struct<property:string,value:double>>,error:string>")
    def judged(texts: pa.Array) -> pa.Array:
        ends, names, values, errors = [0], [], [], []
        for t in texts.to_pylist():
            record = None if t is None else json.loads(t, parse_int=_Number, parse_float=_Number)
            properties, error = _canonical(record) if isinstance(record, dict) else ([], None)
            names += [p for p, _ in properties]
            values += [x for _, x in properties]
            ends.append(len(names))
            errors.append(error)
        rows = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.float64())], ["property", "value"])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
        return pa.StructArray.from_arrays([lists, pa.array(errors, pa.string())], ["properties", "error"])

    result = df.withColumn("_result", judged(F.to_json(column)))
    return result.withColumns({"properties": F.col("_result.properties"), "error": F.col("_result.error")}).drop("_result")


def model_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(results, errors): one row for each property of each candidate (file, path, model, formula, property, value); errors by file or candidate.

    The model's name comes from the candidate, the block, or the file.
    """
    payloads, broken = read_payloads(spark, path)
    rows = canonical_properties(candidates(payloads))
    field = lambda *names: F.coalesce(*[F.nullif(F.trim(F.try_variant_get("candidate", f"$.{n}", "string")), F.lit("")) for n in names])
    rows = rows.withColumns({"model": F.coalesce(field("model"), F.col("model"), F.col("file")), "formula": field("formula", "material")})
    good = rows.select("file", "path", "model", "formula", F.explode("properties").alias("r")).select("file", "path", "model", "formula", "r.property", "r.value")
    bad = rows.where("error IS NOT NULL").select("file", "path", F.col("error").alias("error_code"))
    return good, bad.unionByName(broken.withColumn("path", F.lit(None).cast("array<int>")))
