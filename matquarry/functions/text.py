"""Text, identifier and privacy functions on columns; no Python runs per row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def falsy(c: Column) -> Column:
    """'' and null count as missing."""
    return F.nullif(F.trim(c), F.lit(""))


def compact_text(c: Column) -> Column:
    """White space collapsed to single blanks."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def bounded_text(c: Column, n: int) -> tuple[Column, Column]:
    """(text of at most n characters, ending in '...' if cut; whether it was cut)."""
    cut = F.length(c) > n
    return F.when(cut, F.concat(F.left(c, F.lit(n - 3)), F.lit("..."))).otherwise(c), cut


#: Named entities of metadata and of pages (fixed values).
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "minus": "-", "ndash": "-", "mdash": "-", "middot": "·"}
PAGE_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "minus": "-", "ndash": "-", "mdash": "-", "thinsp": " ", "times": "x"}


def decode_entities(c: Column, names: dict[str, str]) -> Column:
    """Decimal, then hexadecimal, then named entities as characters; numbers that are no character stay as they are."""

    def numbered(text: Column, pattern: str, opening: str, number: Callable[[Column], Column]) -> Column:
        def put(text: Column, code: Column) -> Column:
            point = number(code)
            real = point.between(0, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
            char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
            return F.when(F.coalesce(real, F.lit(False)), F.replace(text, F.concat(F.lit(opening), code, F.lit(";")), char)).otherwise(text)

        return F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), text, put)

    s = numbered(c, r"&#(\d+);", "&#", lambda code: code.try_cast("long"))
    hexadecimal = lambda code: F.when(F.length(code) <= 15, F.conv(F.ltrim(F.lower(code), F.lit("x")), 16, 10).try_cast("long"))
    s = numbered(s, r"&#([xX][0-9a-fA-F]+);", "&#", hexadecimal)
    # The ampersand comes last, so what it makes isn't read as the start of another entity.
    order = sorted(names.items(), key=lambda kv: kv[0] == "amp")
    return reduce(lambda acc, kv: F.regexp_replace(acc, f"(?i)&{kv[0]};", kv[1]), order, s)


def clean_metadata(c: Column, n: int = 1200) -> Column:
    """Tags dropped, entities decoded, white space collapsed, bounded."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)<middle dot>", "·")
    s = F.regexp_replace(s, r"<[^>]+>", "")
    return bounded_text(compact_text(decode_entities(s, ENTITIES)), n)[0]


def strip_html(c: Column) -> Column:
    """Script and style blocks, then tags, dropped; entities decoded; white space collapsed."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return compact_text(decode_entities(F.regexp_replace(s, r"<[^>]+>", " "), PAGE_ENTITIES))


def excerpt(c: Column, words: int = 20) -> Column:
    return F.array_join(F.slice(F.split(compact_text(c), " "), 1, words), " ")


def normalize_title(c: Column) -> Column:
    """Letters and digits of any script, lower-cased, single blanks between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def canonical_doi(c: Column) -> Column:
    """Prefix, query, fragment and trailing punctuation dropped; lower-cased; '' for none."""
    s = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?i)^doi\s*:\s*", "")
    s = F.regexp_replace(s, r"(?i)^https?://(dx\.)?doi\.org/", "")
    s = F.regexp_replace(s, r"[?#].*$", "")
    return F.lower(F.regexp_replace(s, r"[\s.,;:]+$", ""))


#: Query parameters that name no other page (fixed values).
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|msclkid|mc_[a-z]+|ref|ref_src|src|source)$"


def canonical_url(c: Column) -> Column:
    """Scheme and host lower-cased; user info, default port, fragment and trailing slash dropped; '' for no URL.

    Query parameters that tell pages apart stay, sorted; tracking ones go.  urn:, ipfs: and s3: names keep what follows.
    """
    s = F.trim(F.coalesce(c, F.lit("")))
    scheme = F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(s, r"://([^/?#]*)", 1)), r"^[^@]*@", "")
    host = F.when(scheme == "http", F.regexp_replace(host, r":80$", "")).when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(s, r"://[^/?#]*([^?#]*)", 1), r"/+$", "")
    # Escapes of unreserved characters are read, others upper-cased.
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "(?i)%7e", "~"), "(?i)%2d", "-"), "(?i)%5f", "_")
    query = F.regexp_extract(s, r"://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(F.regexp_extract(x, "^([^=]*)", 1)).rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    name = F.regexp_extract(s, r"(?i)^((?:urn|ipfs|s3):\S+)$", 1)
    other = F.concat(F.lower(F.regexp_extract(name, r"^([^:]*)", 1)), F.regexp_extract(name, r"^[^:]*(:.*)$", 1))
    return F.when(scheme.isin("", "urn", "ipfs", "s3") & (name != ""), F.regexp_replace(other, r"/+$", "")).when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host, path, tail)).otherwise("")


def strict_doi(c: Column) -> Column:
    """The canonical DOI if it has the form 10.nnnn/suffix, else ''."""
    return let(canonical_doi(c), lambda d: F.when(d.rlike(r"^10\.\d{4,9}/\S+$"), d).otherwise(""))


def labelled_points(c: Column) -> Column:
    """Array of (label, position) of 'G=0, M: 1.25', sorted by position; parts of any other form are skipped."""
    form = r"^([^=:]+?)\s*[=:]\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[Ee][-+]?\d+)?)$"
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,;，；]+"), lambda p: F.trim(p)), lambda p: p.rlike(form))
    points = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, form, 2).cast("double").alias("position"), F.regexp_extract(p, form, 1).alias("label")))
    return F.transform(F.array_sort(points), lambda p: F.struct(p["label"].alias("label"), p["position"].alias("position")))


def article_key(doi: Column, title: Column, year: Column) -> Column:
    d = canonical_doi(doi)
    return F.when(d != "", F.concat(F.lit("doi:"), d)).otherwise(F.concat(F.lit("title:"), normalize_title(title), F.lit(":"), F.coalesce(year.cast("string"), F.lit(""))))


def asset_key(name: Column, url: Column, index: Column) -> Column:
    """slug, figure number and 12 hex digits of the URL's SHA-1."""
    slug = F.left(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), F.lit(90))
    return F.concat(slug, F.lit("-fig"), F.lpad(index.cast("string"), 2, "0"), F.lit("-"), F.substring(F.sha1(url), 1, 12))


#: Names of secrets (fixed values).
SECRET_NAMES = "api[_-]?key|access[_-]?token|token|secret|password|passwd|authorization"


def redact_secrets(c: Column) -> Column:
    """URL user info, name=value and name: value pairs of secrets, and bearer tokens replaced by [REDACTED]."""
    s = F.regexp_replace(c, r"(https?://)[^/\s@:]+:[^/\s@]+@", "$1[REDACTED]@")
    s = F.regexp_replace(s, rf"(?i)\b({SECRET_NAMES})(\s*[=:]\s*)[\"']?[^\s\"'&;,]+[\"']?", "$1$2[REDACTED]")
    return F.regexp_replace(s, r"(?i)\bBearer\s+[A-Za-z0-9._~+/-]+=*", "Bearer [REDACTED]")


def has_secrets(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(rf"(?i)\b({SECRET_NAMES})\s*[=:]\s*[\"']?[^\s\"'&;,]+|\bBearer\s+[A-Za-z0-9._~+/-]+")


#: Placeholders (fixed values).
PLACEHOLDERS = "n/?a|none|null|unknown|tbd|pending|not (provided|available|reported|specified)|unspecified|未知|未提供|待定|无"


def is_placeholder(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).rlike(rf"^({PLACEHOLDERS}|[-–—_.]+)?$")


#: Names of fields that hold credentials (fixed values).
CREDENTIAL_FIELDS = (
    "api[_-]?key|access[_-]?token|auth(?:orization)?|password|passwd|secret|client[_-]?secret|private[_-]?key|signature|credential|x[-_]?(?:api[-_]?key|auth[-_]?token)|"
    "x[-_]amz[-_](?:credential|signature|security[-_]token)|x[-_]goog[-_](?:credential|signature)|sig|token"
)
# Stand-ins for an escaped backslash and quote: JSON text has no raw control characters, so afterwards every '"' bounds a string.
_SLASH, _QUOTE = "\x01", "\x02"


def _shielded(json: Column) -> Column:
    """JSON text in one spelling, without escaped quotes; null if it isn't JSON."""
    text = F.to_json(F.try_parse_json(json))
    return F.replace(F.replace(text, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))


def _string(token: Column) -> Column:
    """The string of a quoted token."""
    text = F.replace(F.replace(token, F.lit(_SLASH), F.lit("\\\\")), F.lit(_QUOTE), F.lit('\\"'))
    return F.try_variant_get(F.try_parse_json(text), "$", "string")


def _tokens(shielded: Column) -> Column:
    """Quoted strings (names of fields with their ':') and what lies between them, in order."""
    return F.regexp_extract_all(shielded, F.lit('("[^"]*+"(?::|)|[^"]++)'), F.lit(1))


def _between(shielded: Column) -> Column:
    return F.regexp_replace(shielded, '"[^"]*+"', "0")


def _depth(shielded: Column) -> Column:
    marks = F.split(F.regexp_replace(F.regexp_replace(_between(shielded), r"\[\]|\{\}", ""), r"[^\[\]{}]++", ""), "")
    step = lambda a, m: F.struct((a["now"] + F.when(m.isin("[", "{"), 1).when(m.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(a["most"], a["now"] + F.when(m.isin("[", "{"), 1).otherwise(0)).alias("most"))
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])


def nested_depth(json: Column) -> Column:
    """How many containers hold the deepest value of a JSON text: 0 for a scalar or an empty container, null for no JSON."""
    return let(_shielded(json), _depth)


def redact_nested(json: Column, deepest: int = 6) -> Column:
    """JSON text with ``redact_secrets`` on every string that is a value, at any place; null for no JSON.

    Values deeper than ``deepest`` raise.  Fields come back in the order of their names.  The walk is one pass over the text
    of a row: nothing is exploded or shuffled, and only ``deepest`` bounds the nesting.
    """
    def clean(token: Column) -> Column:
        safe = F.to_json(F.array(redact_secrets(_string(token))))
        return F.when(token.startswith('"') & ~token.endswith(":"), F.substring(safe, F.lit(2), F.length(safe) - 2)).otherwise(F.replace(F.replace(token, F.lit(_SLASH), F.lit("\\\\")), F.lit(_QUOTE), F.lit('\\"')))

    deep = F.raise_error(F.lit("CREDENTIAL_SCAN_DEPTH_EXCEEDED")).cast("string")
    return let(_shielded(json), lambda s: F.when(_depth(s) > deepest, deep).otherwise(F.array_join(F.transform(_tokens(s), clean), "")))


def has_secrets_nested(json: Column, deepest: int = 8) -> Column:
    """Whether a field at any place is named like a credential or a string value holds one; true beyond ``deepest``, null for no JSON."""
    field = lambda t: _string(F.rtrim(t, F.lit(":"))).rlike(rf"(?i)^(?:{CREDENTIAL_FIELDS})$")
    value = lambda t: has_secrets(F.regexp_replace(_string(t), r"(?i)\[REDACTED\]", ""))
    told = lambda t: t.startswith('"') & F.when(t.endswith(":"), field(t)).otherwise(value(t))
    return let(_shielded(json), lambda s: (_depth(s) > deepest) | F.exists(_tokens(s), told))


def has_placeholder_nested(json: Column, deepest: int = 6) -> Column:
    """Whether a value at any place is null, an empty container or a placeholder; true beyond ``deepest`` and for no value."""
    told = lambda t: t.startswith('"') & ~t.endswith(":") & is_placeholder(_string(t))
    hollow = lambda s: _between(s).rlike(r"\bnull\b|\[\]|\{\}")
    return let(_shielded(json), lambda s: F.coalesce((_depth(s) > deepest) | hollow(s) | F.exists(_tokens(s), told), F.lit(True)))


NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def strict_number(c: Column) -> Column:
    return let(F.trim(c), lambda t: F.when(t.rlike(NUMBER), t.try_cast("double")))


def fortran_number(c: Column) -> Column:
    return strict_number(F.regexp_replace(F.trim(c), "[dD]", "e"))


def bounded01(c: Column) -> Column:
    """Shares: '80%' is 0.8, a bare number in (1, 100] is a per cent, others outside 0..1 are null."""
    def share(t: Column, v: Column) -> Column:
        return F.when(t.endswith("%") | ((v > 1) & (v <= 100)), v / 100).otherwise(v)

    # Each step is bound once: the branches would otherwise work out the ones below again.
    number = lambda t: strict_number(F.when(t.endswith("%"), F.regexp_replace(t, r"\s*%$", "")).otherwise(t))
    return let(F.trim(c), lambda t: let(number(t), lambda v: let(share(t, v), lambda x: F.when((x >= 0) & (x <= 1), x))))


#: Names of evidence stages (fixed values).
STAGES = {
    "ml": "unvalidated_ml unvalidatedml uncalibrated_ml uncalibratedml machine_learning ml mattersim chgnet openlam interatomic_potential ml_potential",
    "llm": "llm gpt deepseek language_model reported_by_llm",
    "reproduction": "independent_reproduction independent_replication reproduced replicated",
    "experiment": "experiment experimental measured observed",
    "literature": "literature paper peer_reviewed literature_report",
    "database": "database reference database_record",
    "dft": "dft ab_initio first_principles quantum_espresso abacus",
    "validated_ml": "validated_ml calibrated_ml",
    "rule": "rule rules heuristic",
    "task_planning": "task task_planning planning suggestion preview task_preview",
}
STAGE_WEIGHT = {"reproduction": 1.0, "experiment": 0.96, "literature": 0.86, "database": 0.82, "dft": 0.78, "validated_ml": 0.68, "ml": 0.55, "llm": 0.28, "rule": 0.24, "task_planning": 0.16, "unknown": 0.12}


def stage_of(c: Column) -> Column:
    """The stage that a name stands for, whatever its case, blanks and hyphens; others (negated ones too) are unknown."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s-]+", "_")
    names = F.create_map(*[F.lit(x) for stage, known in STAGES.items() for name in known.split() for x in (name, stage)])
    return F.coalesce(F.element_at(names, s), F.lit("unknown"))


def stage_weight(stage: Column) -> Column:
    out = F.lit(STAGE_WEIGHT["unknown"])
    for name, w in STAGE_WEIGHT.items():
        out = F.when(stage == name, w).otherwise(out)
    return out


def token_key(c: Column) -> Column:
    """Letters, digits and CJK only, lower-cased."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "")


def text_features(c: Column) -> Column:
    """Set of latin tokens of 2 or more characters and of CJK bigrams."""
    s = F.lower(F.coalesce(c, F.lit("")))
    latin = F.regexp_extract_all(s, F.lit(r"([a-z0-9]{2,})"), F.lit(1))
    runs = F.regexp_extract_all(s, F.lit(r"([\x{4e00}-\x{9fff}]{2,})"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_union(latin, pairs)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def sentences(c: Column, least: int = 6) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[。！？!?;；\n]"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def unique_ci(values: Column) -> Column:
    """First spelling of each value, compared without case; trailing '.,;' dropped; empty ones dropped."""
    clean = F.filter(F.transform(values, lambda v: F.regexp_replace(F.trim(v), r"[.,;]+$", "")), lambda v: v != "")
    lowered = F.transform(clean, lambda s: F.lower(s))
    return F.filter(clean, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1)


def first_number(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(\S+)", 1).try_cast("double")


def year_from_text(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"\b((?:19|20)\d{2})\b", 1).try_cast("long")


def split_keywords(c: Column, most: int = 24) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[;|]"), lambda s: F.trim(s)), lambda k: k != "")), 1, most)


def content_id(prefix: str, *columns: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 16))
