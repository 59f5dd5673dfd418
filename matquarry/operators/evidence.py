"""Claims of many models: conditions, structure and evidence identity, eligibility, consensus and review of groups.

A claim is a row of one property's value.  Records of one identity form a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chem
from ..functions import text as T
from ..scratch import cut, per_value
from . import graph
from .consensus import ENERGY, FAMILY_CAP, NUMERIC_STAGES, PRESSURE, cap_families, in_range, to_kelvin, to_unit, tolerance, weighted_median

ABSENT = "not provided"
#: Parts of an identity's conditions, in order (fixed values).
CONDITIONS = ["target", "pressure", "temperature", "doping", "functional", "gap_type", "soc", "hubbard_u", "magnetic_order", "strain", "dimensionality", "substrate", "phase", "extra"]
STABILITY = ["formation", "hull"]


# ---------------------------------------------------------------- conditions and identity


def named_condition(c: Column, boolean: bool = False) -> Column:
    """'' for none, 'not provided' for a placeholder, else lower-cased with single blanks; booleans are on or off."""
    if boolean:
        return F.when(c.isNull(), "").when(c, "on").otherwise("off")
    s = F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    return F.when(s == "", "").when(T.is_placeholder(s), ABSENT).otherwise(s)


def significant(c: Column, digits: int) -> Column:
    """A number as text to so many significant digits, without trailing zeros."""
    factor = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, "0").otherwise(F.regexp_replace((F.round(c * factor) / factor).cast("string"), r"\.0$", ""))


def measured_condition(value: Column, unit: Column, factors: dict[str, float], to: str) -> Column:
    """'' for none, 'not provided' for placeholders, 'error:...' for a missing or unknown unit, else value and unit.

    Zero needs no unit; text that is no number is kept with its unit.
    """
    text, name = named_condition(value), F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    number = T.strict_number(value)
    converted = to_unit(number, name, factors)
    return (
        F.when(text == "", "")
        .when((text == ABSENT) | ((name != "") & T.is_placeholder(name)), ABSENT)
        .when(number.isNull(), F.when(name == "", text).otherwise(F.concat(text, F.lit("|unit:"), name)))
        .when((name == "") & (number != 0), "error:missing unit")
        .when((number != 0) & converted.isNull(), "error:unknown unit")
        .otherwise(F.concat(significant(F.coalesce(converted, F.lit(0.0)), 12), F.lit(f"|unit:{to}")))
    )


HUBBARD = ENERGY | {"rydberg": ENERGY["ry"]}
STRAIN = {"%": 1.0, "percent": 1.0, "fraction": 100.0, "unitless": 100.0}


def canonical_conditions(df: DataFrame) -> DataFrame:
    """The condition columns of ``CONDITIONS`` that ``df`` has raw, made canonical; pressure in GPa, temperature in K.

    Conditions are told in few ways, so each distinct combination is made canonical once.
    """
    have, out = set(df.columns), {}
    for c in ("doping", "functional", "gap_type", "magnetic_order", "dimensionality", "substrate", "phase"):
        if c in have:
            out[c] = named_condition(F.col(c).cast("string"))
    if "soc" in have:
        out["soc"] = named_condition(F.col("soc"), dict(df.dtypes)["soc"] == "boolean")
    if "hubbard_u" in have:
        out["hubbard_u"] = measured_condition(F.col("hubbard_u"), F.col("hubbard_unit"), HUBBARD, "ev")
    if "strain" in have:
        out["strain"] = measured_condition(F.col("strain"), F.col("strain_unit"), STRAIN, "%")
    if "pressure" in have:
        out["pressure"] = significant(to_unit(F.col("pressure"), F.col("pressure_unit"), PRESSURE), 8)
    if "temperature" in have:
        out["temperature"] = significant(to_kelvin(F.col("temperature"), F.col("temperature_unit")), 8)
    if "extra" in have:
        out["extra"] = F.array_join(F.transform(F.array_sort(F.map_entries("extra")), lambda e: F.concat(e["key"], F.lit("="), named_condition(e["value"]))), ";")
    raw = [c for c in [*out, "hubbard_unit", "strain_unit", "pressure_unit", "temperature_unit"] if c in have and c != "extra"]
    extra = {c: v for c, v in out.items() if c == "extra"}  # maps can't be grouped
    plain = {c: v for c, v in out.items() if c != "extra"}
    df = per_value(df, raw, lambda values: values.withColumns(plain)) if plain else df
    return df.withColumns(extra)


#: Structure databases by the form of an id (fixed values).
NAMESPACES = [(r"^mp-\d+$", "materials_project"), (r"^cod[-_:]?\d+$", "cod"), (r"^oqmd[-_:]?\d+$", "oqmd"), (r"^icsd[-_:]?\d+$", "icsd"), (r"^aflow[:_-]", "aflow")]
#: Forms of a structure hash (a fixed value).
HASH = r"^((sha256|blake3):[a-f0-9]{64}|sha1:[a-f0-9]{40}|md5:[a-f0-9]{32})$"


def structure_identity(df: DataFrame) -> DataFrame:
    """structure_id, structure_namespace, structure_hash made canonical ('' for none), structure_resolved, structure_key;
    worked out once for each distinct combination."""
    raw = [c for c in ("structure_id", "structure_namespace", "structure_hash", "space_group") if c in df.columns]
    return per_value(df, raw, _structure_identity) if raw else _structure_identity(df)


def _structure_identity(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    raw = lambda c: F.trim(F.col(c)) if c in have else F.lit("")
    synthetic = lambda s: F.lower(s).rlike(r"^(placeholder|dummy|todo|tbc|temporary)([-_: ].*)?$|^temp([-_: ]|\d|$)")
    real = lambda s: s.isNotNull() & ~T.is_placeholder(s) & ~synthetic(s)
    id_ = F.when(real(raw("structure_id")) & (F.length(raw("structure_id")) >= 2) & ~raw("structure_id").rlike(r"\s"), raw("structure_id")).otherwise("")
    low = F.lower(id_)
    inferred = F.when(low.rlike(r"^[a-z][a-z0-9_.-]{1,40}:[^:]+$"), F.split_part(low, F.lit(":"), F.lit(1))).otherwise("")
    for pattern, name in reversed(NAMESPACES):
        inferred = F.when(low.rlike(pattern), name).otherwise(inferred)
    given = F.regexp_replace(F.lower(raw("structure_namespace")), r"[\s-]+", "_")
    namespace = F.when(real(given) & given.rlike(r"^[a-z][a-z0-9_.]{1,79}$"), given).otherwise(inferred)
    hash_ = F.when(F.lower(raw("structure_hash")).rlike(HASH), F.lower(raw("structure_hash"))).otherwise("")
    group = F.coalesce(F.nullif(F.nullif(named_condition(raw("space_group")), F.lit(ABSENT)), F.lit("")), F.lit("unspecified"))
    df = df.withColumns({"structure_id": id_, "structure_namespace": namespace, "structure_hash": hash_, "__group": group})
    resolved = (F.col("structure_hash") != "") | ((F.col("structure_id") != "") & (F.col("structure_namespace") != ""))
    key = (
        F.when(F.col("structure_hash") != "", F.concat(F.lit("hash:"), "structure_hash"))
        .when(resolved, F.concat(F.lit("namespace:"), "structure_namespace", F.lit("|id:"), F.lower("structure_id")))
        .otherwise(F.concat(F.lit("structure:unresolved|local-id:"), F.coalesce(F.nullif(F.lower("structure_id"), F.lit("")), F.lit("unspecified"))))
    )
    return df.withColumns({"structure_resolved": resolved, "structure_key": F.concat(key, F.lit("|spacegroup:"), "__group")}).drop("__group")


def identity(df: DataFrame) -> DataFrame:
    """composition and identity: composition (or text), structure and the 14 parts of conditions.

    ``df`` has been through ``canonical_conditions`` and ``structure_identity``; conditions that it lacks are unspecified.
    """
    parts = [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unspecified")) if c in df.columns else F.lit("unspecified") for c in CONDITIONS]
    parsed = chem.per_formula(df, "formula", composition=chem.composition_key)
    base = F.coalesce(F.concat(F.lit("composition:"), F.nullif("composition", F.lit(""))), F.concat(F.lit("text:"), F.lower(F.trim("formula"))))
    return parsed.withColumn("identity", F.concat_ws("|", base, "structure_key", F.concat(F.lit("conditions:"), F.concat_ws("|", *parts))))


#: Names of properties (fixed values).
ALIASES = {"tc": "tc", "tc_k": "tc", "critical_temperature_k": "tc", "gap": "gap", "band_gap": "gap", "band_gap_ev": "gap", "formation": "formation", "formation_energy": "formation", "hull": "hull", "e_above_hull": "hull", "moment": "moment", "magnetic": "moment", "magnetism": "moment"}


def target_of(explicit: list[Column], properties: Column) -> Column:
    """The target that all explicit names agree on, else the single property, else 'general'; 'error:...' if they differ."""
    known = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])

    def canonical(c: Column) -> Column:
        s = F.regexp_replace(named_condition(c), r"[\s-]+", "_")
        return F.when(s != "", F.coalesce(F.element_at(known, s), s))

    names = F.array_distinct(F.array_compact(F.array(*[canonical(c) for c in explicit])))
    return F.when(F.size(names) > 1, "error:conflicting target").when(F.size(names) == 1, F.get(names, F.lit(0))).when(F.size(properties) == 1, F.get(properties, F.lit(0))).otherwise("general")


def is_snapshot_date(c: Column) -> Column:
    """Whether a text is a day (or a time of it) of the calendar from 1900 to today."""
    day = F.left(c, F.lit(10)).try_cast("date").between(F.lit("1900-01-01").cast("date"), F.current_date())
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}(T\S+)?$") & day, F.lit(False))


def novelty(status: Column, checked: Column, resolved: Column, reference: Column, cutoff: Column) -> Column:
    """not_checked, screened_unverified or known_reference; a screen needs a structure, a reference and a dated snapshot."""
    name = F.regexp_replace(F.lower(F.trim(F.coalesce(status, F.lit("")))), r"[\s-]+", "_")
    cited = reference.isNotNull() & ~T.is_placeholder(reference)
    screened = F.when(resolved & cited & is_snapshot_date(cutoff), "screened_unverified").otherwise("not_checked")
    return T.let(name, lambda raw: (
        F.when(raw.rlike(r"^(unknown|not_known|unchecked|not_checked)$"), "not_checked")
        .when(raw.rlike(r"^(no_match|not_found|not_reported|unmatched|screened_unverified|novel_candidate|new_candidate)(_|$)"), screened)
        .when(raw.rlike(r"^(known|known_reference|matched|reference_match|reported|database_match|literature_match)(_|$)"), F.when(cited, "known_reference").otherwise("not_checked"))
        .otherwise(F.when(F.coalesce(checked, F.lit(False)), screened).otherwise("not_checked"))
    ))


# ---------------------------------------------------------------- evidence and eligibility


def with_references(df: DataFrame) -> DataFrame:
    """``df`` and __doi, __ref_doi, __ref_url: canonical names of its references, worked out once for each distinct one."""
    named = lambda kind, c: T.let(F.nullif(c, F.lit("")), lambda x: F.when(x.isNotNull(), F.concat(F.lit(kind), x)))
    dois = per_value(df, ["doi"], lambda v: v.withColumn("__doi", named("doi:", T.strict_doi(F.col("doi")))))
    ref = F.col("source_ref")
    return per_value(dois, ["source_ref"], lambda v: v.withColumns({"__ref_doi": named("doi:", T.strict_doi(ref)), "__ref_url": named("url:", T.canonical_url(ref))}))


def evidence_keys(df: DataFrame) -> Column:
    """DOIs, canonical URLs, evidence ids and, for database records, the structure, each with its kind.

    ``df`` has been through ``with_references``.
    """
    keys = [F.col("__doi"), F.col("__ref_doi"), F.col("__ref_url")]
    id_ = F.lower(F.trim(F.col("evidence_id")))
    keys.append(F.when(id_.isNotNull() & ~T.is_placeholder(id_), F.concat(F.lit("evidence:"), id_)))
    structure = F.when(F.col("structure_hash") != "", F.concat(F.lit("database-hash:"), "structure_hash")).otherwise(F.concat(F.lit("database-id:"), "structure_namespace", F.lit(":"), F.lower("structure_id")))
    keys.append(F.when((F.col("stage") == "database") & F.col("structure_resolved"), structure))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def with_eligibility(df: DataFrame) -> DataFrame:
    """evidence, eligible, complete: whether a claim may count, and whether all its declared conditions are known.

    A claim counts if a worker made it, its source is trusted and verified, its family is trusted, it has evidence, its
    stage gives numbers, it is no demo, and an experiment has its method and raw data.
    """
    df = with_references(df)
    df = df.withColumn("evidence", evidence_keys(df)).drop("__doi", "__ref_doi", "__ref_url")
    eligible = (
        (F.col("role") == "worker") & F.col("trusted") & F.col("verified") & F.col("trusted_family") & (F.size("evidence") > 0)
        & F.col("stage").isin(*NUMERIC_STAGES) & ~F.col("demo") & ((F.col("stage") != "experiment") | F.col("structured"))
    )
    declared = [F.col(c) for c in CONDITIONS if c in df.columns and c not in ("target", "pressure", "temperature")]
    known = [F.coalesce(c, F.lit("")) != ABSENT for c in declared]
    complete = F.col("conditions_complete")
    for k in known:
        complete = complete & k
    return df.withColumns({"eligible": eligible, "complete": complete})


def with_weight(df: DataFrame) -> DataFrame:
    """counts (eligible for its property), calibrated, weight of each claim."""
    counts = F.col("eligible") & F.col("complete") & (F.coalesce("applicability", F.lit(1.0)) != 0)
    calibrated = counts & (F.coalesce("q90", F.lit(0.0)) > 0) & (F.coalesce("applicability", F.lit(0.0)) > 0) & ~T.is_placeholder(F.col("validation_set"))
    base = T.stage_weight(F.col("stage"))
    weight = F.when(calibrated, base * F.least(F.lit(4.0), F.col("applicability") / (F.col("q90") * F.col("q90") + 1e-6))).when(counts, base).otherwise(0.35)
    return df.withColumns({"counts": counts, "calibrated": calibrated, "weight": F.greatest(F.lit(0.01), weight)})


def dedupe_records(df: DataFrame, ignore: list[str]) -> DataFrame:
    """One record for each content: all columns but ``ignore``; the spelling that sorts first stays, then the smallest
    record_id.  Planning rows of an orchestrator are dropped.  ``copies`` counts the records of a content."""
    content = F.sha2(F.to_json(F.struct(*[c for c in df.columns if c not in ("record_id", *ignore)]), {"ignoreNullFields": "false"}), 256)
    kept = df.where(F.col("role") != "orchestrator").withColumn("content", content)
    first = F.min(F.struct(*ignore, "record_id")).alias("first")
    return kept.groupBy("content").agg(first, F.count("*").alias("copies")).select("first.record_id", "copies")


# ---------------------------------------------------------------- consensus


def independent(entries: DataFrame, keys: list[str]) -> DataFrame:
    """The best entry (weight, then smallest record_id) of each set of entries of a group that share evidence,
    directly or through others.

    Each entry is linked to the smallest one of its group with the same evidence, so common evidence costs one link an
    entry.  An entry belongs to one group.
    """
    entries = cut(entries.withColumn("node", F.concat_ws("\x1f", *keys, "record_id")))
    named = entries.select(*keys, "node", F.explode("evidence").alias("key"))
    first = named.groupBy(*keys, "key").agg(F.min("node").alias("a"))
    links = named.join(first, [*keys, "key"]).where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b"))
    joined = entries.join(graph.components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = joined.groupBy(*keys, "component").agg(F.max(F.struct("weight", (-F.col("record_id")).alias("o"))).alias("best"))
    return entries.drop("node").join(best.select(*keys, (-F.col("best.o")).alias("record_id")), [*keys, "record_id"], "left_semi")


def best_of_models(entries: DataFrame, keys: list[str]) -> DataFrame:
    """The best entry (weight, then smallest record_id) of each model in each group."""
    best = entries.groupBy(*keys, F.lower("model")).agg(F.max(F.struct("weight", (-F.col("record_id")).alias("o"))).alias("best"))
    return entries.join(best.select(*keys, (-F.col("best.o")).alias("record_id")), [*keys, "record_id"], "left_semi")


def _upper_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """sorted[n // 2] of each key, over the distinct values."""
    run = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys)
    run = run.withColumns({"__upto": F.sum("__n").over(w.orderBy(value)), "__half": F.floor(F.sum("__n").over(w) / 2) + 1})
    return run.where("__upto >= __half").groupBy(*keys).agg(F.min(value).alias(out))


def _summary(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Median, deviation, spread, tolerance, conflict and precision of each key and kind of entries."""
    by = [*keys, "kind"]
    median = weighted_median(entries, by, "value", "capped", "median")
    far = entries.join(median, by).withColumn("deviation", F.abs(F.col("value") - F.col("median")))
    mad = weighted_median(far, by, "deviation", "capped", "mad")
    q90 = _upper_median(entries.where("calibrated"), by, "q90", "q90_median")
    stats = entries.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("family").alias("families"), F.count_if("calibrated").alias("calibrated"), F.min("value").alias("low"), F.max("value").alias("high"))
    s = stats.join(median, by).join(mad, by).join(q90, by, "left")
    prop, low, high = F.col("property"), F.col("low"), F.col("high")
    base = tolerance(prop)
    allowed = F.greatest(base, F.when(prop == "tc", F.abs("median") * 0.15).otherwise(0.0), F.when(F.col("kind") != "all", F.coalesce("q90_median", F.lit(0.0))).otherwise(0.0))
    ratio = (prop == "tc") & (low > 0) & (high > 1.75 * low)
    signs = ((prop == "tc") & (low <= 0) & (high > 0)) | ((prop == "gap") & (low <= 0.01) & (high >= 0.05))
    s = s.withColumns({"tolerance": allowed, "mad": 1.4826 * F.col("mad")})
    conflict = (F.col("n") > 1) & ((F.round(high - low, 9) > F.round("tolerance", 9)) | ratio | signs)
    precise = F.col("q90_median").isNull() | (F.col("q90_median") <= F.greatest(3 * base, 0.35 * F.abs("median")))
    return s.withColumns({"conflict": conflict, "precise": precise})


def property_consensus(claims: DataFrame) -> DataFrame:
    """One row for each (identity, property) from claims with weight, counts, calibrated, evidence, structure_resolved.

    Claims that count are cut to the best of each model, then to the best of each set that shares evidence; families
    weigh ``FAMILY_CAP`` at most.  Their median and deviation speak for the group, all claims where none counts.
    Several claims of an unresolved structure are incomparable.
    """
    keys = ["identity", "property"]
    columns = [*keys, "record_id", "model", "family", "value", "weight", "counts", "calibrated", "q90", "evidence"]
    claims = cut(claims.select(*columns, "structure_resolved", F.col("stage").isin(*NUMERIC_STAGES).alias("numeric")))
    raw = claims.where(F.col("numeric") & F.col("value").isNotNull()).select(*columns)
    counted = raw.where("counts")
    kinds = {"all": raw, "audit": counted, "eligible": independent(best_of_models(counted, keys), keys)}
    capped = None
    for kind, rows in kinds.items():
        part = cap_families(rows.drop("evidence"), keys, FAMILY_CAP).withColumn("kind", F.lit(kind))
        capped = part if capped is None else capped.unionByName(part)
    s = cut(_summary(cut(capped), keys))
    of = lambda kind, *names: s.where(F.col("kind") == kind).select(*keys, *[F.col(c).alias(f"{kind}_{c}") for c in names])
    resolved = claims.groupBy("identity").agg(F.bool_and("structure_resolved").alias("resolved"))
    r = of("all", "median", "mad", "n", "low", "high", "tolerance", "conflict").join(of("eligible", "median", "mad", "n", "families", "calibrated", "tolerance", "conflict", "precise"), keys, "left").join(of("audit", "conflict"), keys, "left").join(resolved, "identity")
    apart = ~F.col("resolved") & (F.col("all_n") > 1)
    false = F.lit(False)
    doubted = F.when(F.col("eligible_n").isNull(), True).otherwise(F.col("eligible_conflict") | F.coalesce("audit_conflict", false))
    together = F.col("all_conflict") | F.coalesce("eligible_conflict", false) | F.coalesce("audit_conflict", false)
    number = lambda e, a: F.when(~apart, F.coalesce(e, a))
    return r.select(
        *keys,
        number("eligible_median", "all_median").alias("value"),
        F.col("all_low").alias("low"),
        F.col("all_high").alias("high"),
        number("eligible_mad", "all_mad").alias("mad"),
        F.col("all_n").alias("claims"),
        F.coalesce("eligible_calibrated", F.lit(0)).alias("calibrated"),
        F.coalesce("eligible_n", F.lit(0)).alias("eligible"),
        F.coalesce("eligible_families", F.lit(0)).alias("eligible_families"),
        (apart | doubted).alias("eligible_conflict"),
        (~apart & F.coalesce("eligible_precise", false)).alias("precise"),
        (~apart & together).alias("conflict"),
        number("eligible_tolerance", "all_tolerance").alias("tolerance"),
        apart.alias("incomparable"),
    )


def group_summary(claims: DataFrame, properties: DataFrame) -> DataFrame:
    """One row for each identity: models, families, consensus and conflicting properties, flags, steps and priority.

    ``properties`` is the result of ``property_consensus``.  Sets are of models, families and properties, which are
    few for a group; whatever counts records is a plain aggregate.
    """
    agreed = (F.col("eligible_families") >= 2) & ~F.col("eligible_conflict") & F.col("precise") & ~F.col("incomparable")
    per = properties.groupBy("identity").agg(F.sort_array(F.collect_set(F.when(agreed, F.col("property")))).alias("agreed"), F.sort_array(F.collect_set(F.when(F.col("conflict"), F.col("property")))).alias("conflicts"))
    usable = F.col("eligible") & F.col("complete")
    g = claims.groupBy("identity").agg(
        F.count("*").alias("records"),
        F.sort_array(F.collect_set("model")).alias("models"),
        F.sort_array(F.collect_set(F.when(F.col("eligible"), F.col("family")))).alias("families"),
        F.countDistinct(F.when(F.col("eligible"), F.lower("model"))).alias("eligible_models"),
        F.bool_and("demo").alias("demo_only"),
        F.bool_and("structure_resolved").alias("resolved"),
        F.bool_or("structure_resolved").alias("has_structure"),
        F.bool_or("eligible").alias("has_eligible"),
        F.bool_or(F.col("eligible") & ~F.col("complete")).alias("incomplete"),
        F.bool_or(F.col("doi").isNotNull() | F.col("source_ref").isNotNull()).alias("provenance"),
        F.bool_or(F.col("model_version").isNotNull()).alias("versioned"),
        F.coalesce(F.max(F.when(F.col("eligible"), T.stage_weight(F.col("stage")))), F.lit(0.0)).alias("highest"),
        F.bool_or("calibrated").alias("is_calibrated"),
        F.when(F.countDistinct("novelty_status") > 1, "mixed").otherwise(F.min("novelty_status")).alias("novelty_status"),
        F.sort_array(F.collect_set(F.when(usable, F.col("property")))).alias("usable"),
        F.sort_array(F.collect_set(F.when(usable & (F.col("stage") == "experiment") & F.col("structured"), F.col("property")))).alias("measured"),
    ).join(per, "identity", "left")
    g = g.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("agreed", "conflicts")})
    firm, open_ = F.array_except("agreed", "conflicts"), F.array_except("usable", "conflicts")
    wanted = F.when(F.size(firm) > 0, firm).otherwise(open_)
    stable = F.arrays_overlap("agreed", F.array(*map(F.lit, STABILITY)))
    g = g.withColumns({
        "claim": ~F.col("demo_only") & F.col("resolved") & (F.size("agreed") > 0),
        "stable": stable,
        "aimed": F.size(F.array_except("agreed", F.array(*map(F.lit, STABILITY)))) > 0,
        "tested": F.arrays_overlap("measured", wanted),
    })
    return g.withColumns({"priority": review_priority(), "steps": next_steps()}).withColumn("level", review_level())


def review_priority() -> Column:
    """Additive 0..100 score of a group; 25 at most for demos."""
    points = lambda c, n: F.when(F.col(c), n).otherwise(0)
    score = (
        10 + points("has_structure", 10) + points("provenance", 7) + points("versioned", 3)
        + F.least(F.lit(18), F.greatest(F.lit(0), F.col("eligible_models") - 1) * 9) + F.least(F.lit(10), F.greatest(F.lit(0), F.size("families") - 1) * 5)
        + F.floor(F.col("highest") * 15 + 0.5) + points("is_calibrated", 8) + points("stable", 12) + points("aimed", 7)
        - F.least(F.lit(18), F.size("conflicts") * 8)
    ).cast("long")
    score = F.greatest(F.lit(0), F.least(F.lit(100), score))
    return F.when(F.col("demo_only"), F.least(score, F.lit(25))).otherwise(score)


def review_level() -> Column:
    real = ~F.col("demo_only")
    return F.when(real & (F.col("priority") >= 72) & F.col("has_structure") & F.col("stable"), "high").when(real & (F.col("priority") >= 48), "review").otherwise("insufficient")


def required_steps() -> dict[str, Column]:
    """Follow-up steps and when a group (of a general target) needs them, in order."""
    return {
        "structure": ~F.col("has_structure"), "verification": ~F.col("has_eligible"), "conditions": F.col("incomplete"), "novelty": F.col("novelty_status") != "known_reference",
        "stability": ~F.col("stable"), "conflict": F.size("conflicts") > 0, "experiment": ~F.col("tested"),
    }


def next_steps(most: int = 4) -> Column:
    return F.slice(F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in required_steps().items()])), 1, most)


def report_totals(raw: DataFrame, claims: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: raw and deduplicated records, models, candidates, groups that agree, groups in conflict."""
    one = groups.agg(F.count("*").alias("candidates"), F.count_if("claim").alias("agreements"), F.count_if(F.size("conflicts") > 0).alias("conflicts"))
    return raw.agg(F.count("*").alias("raw")).join(claims.agg(F.count("*").alias("normalized"), F.countDistinct("model").alias("models")), F.lit(True)).join(one, F.lit(True))


def report_feed(groups: DataFrame, properties: DataFrame) -> DataFrame:
    """Rows of the candidate table: groups by priority, number of models, identity; properties as text.

    ``rank`` follows from a sort by ranges and a count of the rows of the ranges before, so no task holds all groups.
    """
    text = F.concat_ws(" ", "property", F.when(F.col("incomparable"), "not merged").otherwise(F.format_number("value", 4)), F.when(F.col("conflict"), "(conflict)"))
    per = properties.groupBy("identity").agg(F.array_join(F.sort_array(F.collect_list(text)), "; ").alias("values"))
    order = [F.desc("priority"), F.desc(F.size("models")), F.asc("identity")]
    rows = groups.join(per, "identity", "left").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(rows.select("identity", "priority", "level", "models", F.coalesce("values", F.lit("no numeric values")).alias("values"), "novelty_status", "claim", "steps", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("row")))
    ranges = rows.groupBy("range").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = ranges.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = rows.join(F.broadcast(before.select("range", "first", "before")), "range")
    return ranked.withColumn("rank", F.col("row") - F.col("first") + F.col("before") + 1).drop("range", "row", "first", "before")


# ---------------------------------------------------------------- statements


def cluster_statements(rows: DataFrame, least: float = 0.72) -> DataFrame:
    """Statements (group, model, text) of recommendations, clustered by shared words: statement, models, supporters.

    Sentences of 6 characters or more; classes are components of pairs of that similarity; the longest text under
    360 characters speaks for a class; the four classes of most models stay for each group.
    """
    said = rows.select("group", "model", F.explode(T.sentences(F.col("text"))).alias("statement"))
    distinct = cut(said.select("group", "statement").distinct().withColumn("node", F.xxhash64("group", "statement")))
    # Words carry their group, so only statements of one group can share any.
    items = distinct.select("node", F.transform(T.text_features(F.col("statement")), lambda w: F.concat_ws("\x1f", "group", w)).alias("items"))
    of = graph.similar_components(items, least)
    classed = distinct.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    short = F.length("statement") < 360
    said = said.join(classed, ["group", "statement"])
    c = said.groupBy("group", "component").agg(F.sort_array(F.collect_set("model")).alias("models"), F.max(F.struct(short.alias("s"), F.length("statement").alias("n"), "statement")).alias("t"))
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc(F.size("models")), F.length("t.statement"), "t.statement"))
    return c.withColumn("place", place).where("place <= 4").select("group", "place", F.col("t.statement").alias("statement"), "models", F.size("models").alias("supporters"))


def group_texts(rows: DataFrame, least: float = 0.78) -> DataFrame:
    """record_id, component of text-only records (record_id, conditions, text): those of equal conditions whose words
    have that similarity form a group, directly or through others."""
    items = rows.select(F.col("record_id").alias("node"), F.transform(T.text_features(F.col("text")), lambda w: F.concat_ws("\x1f", "conditions", w)).alias("items"))
    # Records with the same words are one node.
    sets = items.withColumn("items", F.array_sort("items")).groupBy("items").agg(F.min("node").alias("node"))
    members = items.withColumn("items", F.array_sort("items")).select(F.col("node").alias("record_id"), "items").join(sets, "items")
    of = graph.similar_components(sets, least)
    return members.join(of, "node", "left").select("record_id", F.coalesce("component", "node").alias("component"))
