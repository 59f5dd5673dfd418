"""Queries on article text: projections, classification, filters, dedupe, audit, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import text as T
from ..operators import figures, library, search
from .adapters import MATERIALS, ctes, table, view
from .registry import query


def _list(c: Column) -> Column:
    return F.array_join(c, "|")


def _rules(rules: list[tuple[str, str]], text: str, also: dict[str, str] | None = None) -> str:
    """SQL for the labels whose pattern occurs, joined by '|'."""
    cases = [f"CASE WHEN regexp_matches({text}, '{p}'){' AND ' + also[label] if also and label in also else ''} THEN '{label}' END" for label, p in rules]
    return "concat_ws('|', " + ", ".join(cases) + ")"


_ALIAS = lambda t, a: f"regexp_matches({t}, '(?i)(^|[^A-Za-z0-9]){a}($|[^A-Za-z0-9])')"
_UNIQ = "array_to_string(list_filter({x}, lambda v, i: list_position(list_transform({x}, lambda w: lower(w)), lower(v)) = i), '|')"


def _uniq(x: str) -> str:
    return _UNIQ.replace("{x}", x)


_DOI = r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(coalesce({c}, '')), '(?i)^doi\s*:\s*', ''), '(?i)^https?://(dx\.)?doi\.org/', ''), '[?#].*$', ''), '[\s.,;:]+$', ''))"
_KEY = f"CASE WHEN {_DOI.replace('{c}', 'doi')} <> '' THEN 'doi:' || {_DOI.replace('{c}', 'doi')} ELSE 'title:' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ':' || year END"
NAMES = {m: [m] for m in MATERIALS}


@query(
    "ext_01_guess_title",
    r"""SELECT doc_id, list_extract(list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)), lambda s: trim(s)),
        lambda s: length(s) BETWEEN 8 AND 220 AND NOT regexp_matches(lower(s), '^(abstract|doi|arxiv)')), 1) AS title FROM documents""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.guess_title(F.replace(F.col("text"), F.lit("\r"), F.lit(""))).alias("title"))


@query(
    "ext_02_identifiers",
    ctes("articles_v") + r""" SELECT seq, nullif(regexp_replace(regexp_extract(doi, '(?i)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]+)\b', 1), '\.+$', ''), '') AS doi FROM articles_v""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "articles_v").select("seq", X.first_doi(F.col("doi")).alias("doi"))


@query(
    "ext_03_match_materials",
    ctes("articles_v")
    + f" SELECT seq, concat_ws('|', {', '.join(f'CASE WHEN {_ALIAS(chr(97) + chr(98) + chr(115) + chr(116) + chr(114) + chr(97) + chr(99) + chr(116), m)} THEN {chr(39)}{m}{chr(39)} END' for m in MATERIALS)}) AS materials, concat_ws('|', CASE WHEN {_ALIAS('abstract', 'cobaltocene')} THEN 'cobaltocene' END, CASE WHEN {_ALIAS('abstract', 'CoCp2')} THEN 'CoCp2' END) AS dopants FROM articles_v",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("abstract")
    return view(spark, d, "articles_v").select("seq", _list(X.match_names(text, NAMES)).alias("materials"), _list(X.match_names(text, {x: [x] for x in ("cobaltocene", "CoCp2")})).alias("dopants"))


@query("ext_04_technique_flags", ctes("articles_v") + f" SELECT seq, {_rules(X.KEYWORDS, 'lower(abstract)')} AS techniques FROM articles_v")
def _(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "articles_v").select("seq", _list(X.technique_flags(F.col("abstract"))).alias("techniques"))


_PHOTON = r"regexp_extract_all(abstract, '(?i)(?:photon energ(?:y|ies)|hv)\s*(?:of|=|:|were|was)?\s*(\d+(?:\.\d+)?(?:\s*(?:-|to)\s*\d+(?:\.\d+)?)?)\s*eV', 1)"
_TEMP = r"regexp_extract_all(abstract, '(?i)\bat\s*(\d+(?:\.\d+)?)\s*K\b', 1)"
_GAPV = r"regexp_extract_all(abstract, '(?i)(?:band gap|gap)\s*(?:of|=|:|is|was)?\s*(\d+(?:\.\d+)?)\s*(meV|eV)', {g})"
_GAPS = f"list_transform(list_zip({_GAPV.replace('{g}', '1')}, {_GAPV.replace('{g}', '2')}), lambda p: p[1] || ' ' || p[2])"


@query("ext_05_conditions", ctes("articles_v") + f" SELECT seq, {_uniq(_PHOTON)} AS photon_energies, {_uniq(_TEMP)} AS temperatures FROM articles_v")
def _(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "articles_v").select("seq", _list(X.photon_energies(F.col("abstract"))).alias("photon_energies"), _list(X.temperatures(F.col("abstract"))).alias("temperatures"))


@query(
    "ext_06_snippets",
    ctes("articles_v") + r""" SELECT seq, trim(regexp_extract(title, '((?:beamline|Beamline|BL)\s*[-\w ]{1,60})', 1)) AS beamline FROM articles_v""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "articles_v").select("seq", F.coalesce(F.get(X.snippets(F.col("title"), "beamline"), F.lit(0)), F.lit("")).alias("beamline"))


@query("ext_07_band_gaps", ctes("articles_v") + f" SELECT seq, {_uniq(_GAPS)} AS band_gaps, round(CASE WHEN lower({_GAPS}[1]) LIKE '%mev' THEN CAST(string_split({_GAPS}[1], ' ')[1] AS DOUBLE) / 1000 ELSE CAST(string_split({_GAPS}[1], ' ')[1] AS DOUBLE) END, 6) AS gap_ev FROM articles_v")
def _(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "articles_v").select("seq", _list(X.band_gaps(F.col("abstract"))).alias("band_gaps"), F.round(X.gap_eV(F.col("abstract")), 6).alias("gap_ev"))


@query(
    "ext_08_review_notes",
    ctes("articles_v") + r""" SELECT seq, concat_ws('|', CASE WHEN NOT regexp_matches(lower(abstract), 'arpes|angle-resolved photoemission') THEN 'no technique keyword' END,
      CASE WHEN material IN ('SnS', 'FeTe') THEN 'no configured material' END) AS notes FROM articles_v""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    found = X.match_names(F.col("abstract"), {m: [m] for m in MATERIALS if m not in ("SnS", "FeTe")})
    notes = F.array_compact(F.array(F.when(~F.lower("abstract").rlike("arpes|angle-resolved photoemission"), F.lit("no technique keyword")), F.when(F.size(found) == 0, F.lit("no configured material"))))
    return view(spark, d, "articles_v").select("seq", _list(notes).alias("notes"))


@query(
    "ext_09_confidence",
    ctes("articles_v") + f""" SELECT seq, CAST(35 + CASE WHEN {_rules(X.KEYWORDS, 'lower(abstract)')} <> '' THEN 20 ELSE 0 END + CASE WHEN {_ALIAS('abstract', 'cobaltocene')} THEN 15 ELSE 0 END
      + CASE WHEN len({_PHOTON}) + len({_TEMP}) > 0 THEN 15 ELSE 0 END + CASE WHEN len({_GAPS}) > 0 THEN 15 ELSE 0 END AS BIGINT) AS score FROM articles_v""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("abstract")
    score = X.extraction_confidence(X.match_names(t, NAMES), X.technique_flags(t), X.match_names(t, {"cobaltocene": ["cobaltocene"]}), F.concat(X.photon_energies(t), X.temperatures(t)), X.band_gaps(t))
    return view(spark, d, "articles_v").select("seq", score.alias("score"))


@query("ext_10_first_number", ctes("articles_v") + " SELECT seq, try_cast(string_split(substr(doi, 1, 3) || ' x', ' ')[1] AS DOUBLE) AS n FROM articles_v")
def _(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "articles_v").select("seq", T.first_number(F.left("doi", F.lit(3))).alias("n"))


@query(
    "ext_11_properties",
    ctes("articles_v") + """ SELECT seq, concat_ws('|', CASE WHEN lower(abstract) LIKE '%superconducting gap%' OR lower(abstract) LIKE '%gap anisotropy%' THEN 'superconducting gap' END,
      CASE WHEN lower(abstract) LIKE '%fermi surface%' THEN 'Fermi surface' END, CASE WHEN lower(title) LIKE '%band structure%' THEN 'band structure' END) AS properties FROM articles_v""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rules = [("superconducting gap", "superconducting gap|gap anisotropy"), ("Fermi surface", "fermi surface"), ("band structure", "band structure|band dispersion")]
    return view(spark, d, "articles_v").select("seq", _list(X.flags(F.lower(F.concat_ws(" ", "title", "abstract")), rules)).alias("properties"))


_REL = " + ".join(f"CASE WHEN regexp_matches({{t}}, '(?i){p}') THEN {w} ELSE 0.0 END" for p, w in X.RELEVANCE)
_SCORE = f"CASE WHEN regexp_matches({{t}}, '(?i){'|'.join(p for p, _ in X.RELEVANCE[:3])}') THEN round(CAST(least(1.0, {_REL}) AS DOUBLE), 2) ELSE 0.0 END"


@query("ext_12_relevance", ctes("articles_v") + f" SELECT seq, CAST({_SCORE.replace('{t}', '(title || chr(32) || abstract)')} AS DOUBLE) AS relevance FROM articles_v")
def _(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "articles_v").select("seq", X.relevance_score(F.concat_ws(" ", "title", "abstract")).alias("relevance"))


@query("ext_13_known_materials", ctes("articles_v") + " SELECT seq, material AS materials, 'ARPES|' || material || CASE WHEN seq % 10 = 3 THEN '|superconducting gap|Fermi surface' ELSE '' END || '|band structure' || CASE WHEN title LIKE 'Iron-based%' THEN '|iron-based' ELSE '' END AS keywords FROM articles_v")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = X.match_names(F.col("abstract"), NAMES)
    phrases = ["superconductivity", "superconducting gap", "Fermi surface", "band structure", "cuprate", "iron-based", "nickelate", "topological", "nematic", "pseudogap"]
    words = X.flags(F.lower(F.concat_ws(" ", "title", "abstract")), [(p, p.lower()) for p in phrases])
    return view(spark, d, "articles_v").select("seq", _list(found).alias("materials"), _list(F.array_distinct(F.concat(F.array(F.lit("ARPES")), found, words))).alias("keywords"))


@query(
    "ext_14_from_inverted",
    "SELECT doc_id, array_to_string(list_slice(list_filter(string_split_regex(coalesce(text, ''), '[ \\n\\t\\r]+'), lambda w: w <> ''), 1, 100000), ' ') AS abstract FROM documents",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.from_inverted(library.inverted(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "abstract")


@query("ext_15_bounded_authors", "SELECT doc_id, array_to_string(list_slice(w, 1, 12), ', ') || CASE WHEN len(w) > 12 THEN ' et al.' ELSE '' END AS authors FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: s <> '') AS w FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: s != "")
    return table(spark, d, "documents").select("doc_id", library.bounded_authors(lines).alias("authors"))


@query("ext_16_year", r"SELECT o_orderkey, try_cast(nullif(regexp_extract('printed ' || strftime(o_orderdate, '%Y-%m-%d'), '\b((?:19|20)\d{2})\b', 1), '') AS BIGINT) AS year FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", T.year_from_text(F.concat(F.lit("printed "), F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("year"))


@query("ext_17_keywords", ctes("articles_v") + " SELECT seq, keywords FROM articles_v")
def _(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "articles_v").select("seq", _list(T.split_keywords(F.concat(F.col("keywords"), F.lit("; "), F.split_part("keywords", F.lit("|"), F.lit(1))))).alias("keywords"))


@query(
    "ext_18_to_article",
    ctes("articles_v") + f""" SELECT seq, coalesce(nullif({_DOI.replace('{c}', 'doi')}, ''), nullif(url, ''), 'row') AS id, title, year, coalesce(nullif(url, ''), nullif(doi, ''), '') AS link,
      CASE source WHEN 'curated' THEN 'curated' ELSE 'imported:' || source END AS verification_status FROM articles_v""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.to_article(view(spark, d, "articles_v")).select("seq", "id", "title", "year", "link", "verification_status")


# ---------------------------------------------------------------- text functions


@query("txt_01_unique_ci", ctes("articles_v") + " SELECT seq, CASE WHEN lower(dopant) = '' THEN material ELSE material || '|' || dopant END AS names FROM articles_v")
def _(spark: SparkSession, d: str) -> DataFrame:
    values = F.array("material", F.concat(F.upper("material"), F.lit(".;")), "dopant", F.upper("dopant"))
    return view(spark, d, "articles_v").select("seq", _list(T.unique_ci(values)).alias("names"))


@query(
    "txt_02_compact_text",
    r"SELECT doc_id, CASE WHEN length(t) > 200 THEN left(t, 197) || '...' ELSE t END AS text, length(t) > 200 AS cut FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    text, cut = T.bounded_text(T.compact_text(F.col("text")), 200)
    return table(spark, d, "documents").select("doc_id", text.alias("text"), cut.alias("cut"))


#: Pages with entities of letters (Greek, by decimal and hexadecimal numbers) and signs added.
_WITH_ENTITIES = "coalesce(html, '') || ' &#' || CAST(913 + page_id % 57 AS VARCHAR(9)) || '; &#x' || lower(to_hex(945 + page_id % 25)) || '; &amp;lt; &times;&thinsp;x &#1114112;'"


def _decoded(text: str, names: dict[str, str]) -> str:
    """The entities that ``_WITH_ENTITIES`` adds and all named ones, decoded, as SQL."""
    out = f"replace({text}, '&#' || CAST(913 + page_id % 57 AS VARCHAR) || ';', chr(CAST(913 + page_id % 57 AS INTEGER)))"
    out = f"replace({out}, '&#x' || lower(to_hex(945 + page_id % 25)) || ';', chr(CAST(945 + page_id % 25 AS INTEGER)))"
    for name, char in sorted(names.items(), key=lambda kv: kv[0] == "amp"):
        out = f"regexp_replace({out}, '(?i)&{name};', '{char.replace(chr(39), chr(39) * 2)}', 'g')"
    return out


def _entity_pages(spark: SparkSession, d: str) -> DataFrame:
    code = lambda c: F.concat(F.lit(" &#"), c, F.lit(";"))
    signs = [code(913 + F.col("page_id") % 57), code(F.concat(F.lit("x"), F.lower(F.hex(945 + F.col("page_id") % 25)))), F.lit(" &amp;lt; &times;&thinsp;x &#1114112;")]
    return table(spark, d, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), *signs).alias("html"))


@query("txt_03_clean_metadata", r"SELECT page_id, CASE WHEN length(t) > 1200 THEN left(t, 1197) || '...' ELSE t END AS text FROM (SELECT page_id, trim(regexp_replace(" + _decoded(f"regexp_replace({_WITH_ENTITIES}, '<[^>]+>', '', 'g')", T.ENTITIES) + r", '\s+', ' ', 'g')) AS t FROM pages)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _entity_pages(spark, d).select("page_id", T.clean_metadata(F.col("html")).alias("text"))


@query(
    "txt_04_strip_html",
    r"SELECT page_id, t AS text, array_to_string(list_slice(string_split(t, ' '), 1, 20), ' ') AS excerpt FROM (SELECT page_id, trim(regexp_replace("
    + _decoded(f"regexp_replace(regexp_replace({_WITH_ENTITIES}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g')", T.PAGE_ENTITIES)
    + r", '\s+', ' ', 'g')) AS t FROM pages)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _entity_pages(spark, d).select("page_id", T.strip_html(F.col("html")).alias("text")).withColumn("excerpt", T.excerpt(F.col("text")))


@query("txt_05_normalize_title", r"SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS title FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalize_title(F.col("text")).alias("title"))


@query("txt_06_canonical_doi", ctes("articles_v") + f" SELECT seq, {_DOI.replace('{c}', 'doi')} AS doi FROM articles_v")
def _(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "articles_v").select("seq", T.canonical_doi(F.col("doi")).alias("doi"))


@query(
    "txt_07_canonical_url",
    r"""SELECT page_id, CASE WHEN s <> '' AND h <> '' THEN s || '://' || h || regexp_replace(regexp_extract(u, '://[^/?#]*([^?#]*)', 1), '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END ELSE '' END AS url FROM (
      SELECT page_id, u, s, CASE s WHEN 'http' THEN regexp_replace(h, ':80$', '') WHEN 'https' THEN regexp_replace(h, ':443$', '') ELSE h END AS h,
        list_sort(list_filter(string_split(regexp_extract(u, '://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(regexp_extract(x, '^([^=]*)', 1)), '^(utm_[a-z]+|fbclid|gclid|msclkid|mc_[a-z]+|ref|ref_src|src|source)$'))) AS q FROM (
      SELECT page_id, trim(coalesce(url, '')) AS u, lower(regexp_extract(trim(coalesce(url, '')), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s,
      regexp_replace(lower(regexp_extract(trim(coalesce(url, '')), '://([^/?#]*)', 1)), '^[^@]*@', '') AS h FROM pages))""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


@query("txt_06_strict_doi", ctes("articles_v") + f" SELECT seq, CASE WHEN regexp_matches({_DOI.replace('{c}', 'doi')}, '^10\\.[0-9]{{4,9}}/[^ ]+$') THEN {_DOI.replace('{c}', 'doi')} ELSE '' END AS doi FROM articles_v")
def _(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "articles_v").select("seq", T.strict_doi(F.col("doi")).alias("doi"))


@query("txt_19_labelled_points", "SELECT p_partkey, 'X@' || CAST(CAST(p_size AS DOUBLE) / 4 AS VARCHAR) || '|M@' || CAST(CAST(p_size + 8 AS DOUBLE) / 4 AS VARCHAR) AS points FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    low, high = (F.format_string("%.2f", (F.col("p_size") + n) / 4) for n in (0, 8))
    text = F.concat(F.lit(" M : "), high, F.lit(" , broken, "), F.lit("X="), low, F.lit("; Y=word"))
    points = F.transform(T.labelled_points(text), lambda p: F.concat_ws("@", p["label"], p["position"].cast("string")))
    return table(spark, d, "part").select("p_partkey", F.array_join(points, "|").alias("points"))


@query("txt_08_article_key", ctes("articles_v") + f" SELECT seq, {_KEY} AS article_key FROM articles_v")
def _(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "articles_v").select("seq", T.article_key(F.col("doi"), F.col("title"), F.col("year")).alias("article_key"))


@query(
    "txt_09_asset_key",
    r"SELECT page_id, left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 90) || '-fig' || lpad(CAST(page_id % 8 + 1 AS VARCHAR), 2, '0') || '-' || left(sha1(url), 12) AS asset_key FROM pages",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.asset_key(F.col("url"), F.col("url"), F.col("page_id") % 8 + 1).alias("asset_key"))


_SECRET = T.SECRET_NAMES


@query(
    "txt_10_redact_secrets",
    rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(https?://)[^/\s@:]+:[^/\s@]+@', '\1[REDACTED]@', 'g'),
      '(?i)\b({_SECRET})(\s*[=:]\s*)["'']?[^\s"''&;,]+["'']?', '\1\2[REDACTED]', 'g'), '(?i)\bBearer\s+[A-Za-z0-9._~+/-]+=*', 'Bearer [REDACTED]', 'g') AS text FROM documents""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.redact_secrets(F.col("text")).alias("text"))


@query("txt_11_has_secrets", rf"""SELECT doc_id, regexp_matches(coalesce(text, ''), '(?i)\b({_SECRET})\s*[=:]\s*["'']?[^\s"''&;,]+|\bBearer\s+[A-Za-z0-9._~+/-]+') AS has_secrets FROM documents""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.has_secrets(F.col("text")).alias("has_secrets"))


@query(
    "txt_10_nested_values",
    rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(https?://)[^/\s@:]+:[^/\s@]+@', '\1[REDACTED]@', 'g'),
      '(?i)\b({_SECRET})(\s*[=:]\s*)["'']?[^\s"''&;,]+["'']?', '\1\2[REDACTED]', 'g'), '(?i)\bBearer\s+[A-Za-z0-9._~+/-]+=*', 'Bearer [REDACTED]', 'g') AS text,
      regexp_matches(coalesce(text, ''), '(?i)\b({_SECRET})\s*[=:]\s*["'']?[^\s"''&;,]+|\bBearer\s+[A-Za-z0-9._~+/-]+') AS has_secrets,
      lang IS NULL OR source IS NULL OR text IS NULL OR regexp_full_match(lower(trim(text)), '({T.PLACEHOLDERS}|[-–—_.]+)?') AS placeholder FROM documents""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    items = F.array(F.struct(F.struct(F.col("text").alias("body")).alias("part"), F.col("source").alias("from")))
    docs = table(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.col("lang"), items.alias("items")), {"ignoreNullFields": "false"}).alias("j"))
    text = F.try_variant_get(F.parse_json(T.redact_nested(F.col("j"))), "$.items[0].part.body", "string").alias("text")
    return docs.select("doc_id", text, T.has_secrets_nested(F.col("j")).alias("has_secrets"), T.has_placeholder_nested(F.col("j")).alias("placeholder"))


@query("txt_12_placeholder", ctes("articles_v") + " SELECT seq, CASE WHEN dopant = '' THEN true ELSE seq % 4 = 2 END AS placeholder FROM articles_v")
def _(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "articles_v").select("seq", T.is_placeholder(F.when(F.col("dopant") == "CoCp2", F.lit("Not Reported")).otherwise(F.col("dopant"))).alias("placeholder"))


@query("txt_13_numbers", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity > 1 THEN l_quantity / 100 ELSE l_quantity END, 6) AS share, l_tax AS fortran FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    share = T.bounded01(F.concat(F.col("l_quantity").cast("string"), F.when(F.col("l_linenumber") == 1, "%").otherwise("")))
    exact = F.when((F.col("l_quantity") == 1) & (F.col("l_linenumber") == 1), F.lit(1.0)).otherwise(share)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(exact, 6).alias("share"), T.fortran_number(F.concat(F.col("l_tax").cast("string"), F.lit("D0"))).alias("fortran"))


@query("txt_14_stage", ctes("claims_v") + " SELECT record_id, stage, CAST(CASE stage WHEN 'experiment' THEN 0.96 WHEN 'dft' THEN 0.78 WHEN 'database' THEN 0.82 WHEN 'ml' THEN 0.55 WHEN 'literature' THEN 0.86 WHEN 'llm' THEN 0.28 ELSE 0.16 END AS DOUBLE) AS weight FROM claims_v")
def _(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "claims_v").select("record_id", T.stage_of(F.col("stage")).alias("stage")).withColumn("weight", T.stage_weight(F.col("stage")))


@query("txt_15_token_key", "SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '', 'g') AS token FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.token_key(F.concat_ws(" ", "p_name", "p_brand")).alias("token"))


@query(
    "txt_16_features",
    "SELECT item_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '([a-z0-9]{2,})', 1))) AS BIGINT) AS features FROM benchmark",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.size(T.text_features(F.col("text"))).cast("long").alias("features"))


@query("txt_17_sentences", r"SELECT doc_id, CAST(len(list_filter(list_transform(string_split_regex(coalesce(text, ''), '[。！？!?;；\n]'), lambda s: trim(s)), lambda s: length(s) >= 6)) AS BIGINT) AS sentences FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("txt_18_content_id", """SELECT c_custkey, 'c-' || left(sha256('{"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}'), 16) AS id FROM customer""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", T.content_id("c-", "c_name", "c_nationkey").alias("id"))


# ---------------------------------------------------------------- classification


@query("tax_01_techniques", ctes("articles_v") + f" SELECT seq, {_rules(X.TECHNIQUES, '(title || chr(32) || abstract || chr(32) || keywords)')} AS techniques FROM articles_v")
def _(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "articles_v").select("seq", _list(X.techniques(F.concat_ws(" ", "title", "abstract", "keywords"))).alias("techniques"))


_TWO = _rules(X.TWO_D, "title", {"cof-mof": f"regexp_matches(title, '{X.TWO_D_CONTEXT}')"})
_CONTEXT = f"regexp_matches(title || ' ' || abstract, '{X.SUPERCONDUCTIVITY}')"
_SUPER = _rules(X.SUPERCONDUCTORS, "title", {"tmd": _CONTEXT})


@query("tax_02_two_d", ctes("articles_v") + f" SELECT seq, {_TWO} AS categories FROM articles_v")
def _(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "articles_v").select("seq", _list(X.two_d_categories(F.col("title"))).alias("categories"))


@query("tax_03_superconductivity", ctes("articles_v") + f" SELECT seq, {_SUPER} AS categories FROM articles_v")
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.classify(view(spark, d, "articles_v")).select("seq", _list(F.col("superconductivity_categories")).alias("categories"))


_TAGS = f"""concat_ws('|', CASE WHEN regexp_matches(title || ' ' || abstract || ' ' || keywords, '(?i)\\b(ARPES|angle[- ]resolved photoemission|photoemission spectroscopy)\\b') THEN 'arpes' END,
  CASE WHEN {_CONTEXT} OR array_to_string(list_filter(string_split({_SUPER}, '|'), lambda c: c <> 'tmd' AND c <> ''), '') <> '' THEN 'superconductivity' END,
  CASE WHEN {_TWO} <> '' OR regexp_matches(title, '(?i)\\b(2D|two[- ]dimensional|monolayer|bilayer|few[- ]layer)\\b') THEN '2d-materials' END,
  CASE WHEN regexp_matches(title || ' ' || abstract || ' ' || keywords, '(?i)\\b(beamline|endstation|analy[sz]er|instrumentation|spectrometer)\\b') THEN 'instrumentation' END)"""


@query("tax_04_topic_tags", ctes("articles_v") + f" SELECT seq, {_TAGS} AS tags FROM articles_v")
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.classify(view(spark, d, "articles_v")).select("seq", _list(F.col("topic_tags")).alias("tags"))


_FIG = "CASE " + " ".join(f"WHEN regexp_matches({{c}}, '{p}') THEN '{label}'" for label, p in X.FIGURES) + " ELSE 'Other' END"


@query("tax_05_figure_type", ctes("articles_v") + f" SELECT seq, t AS type, CASE WHEN t = 'Other' THEN 'unclassified' ELSE 'high' END AS confidence FROM (SELECT seq, {_FIG.replace('{c}', 'abstract')} AS t FROM articles_v)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "articles_v").select("seq", X.figure_type(F.col("abstract")).alias("f")).select("seq", "f.type", "f.confidence")


@query(
    "tax_06_normalize_article",
    ctes("articles_v") + f" SELECT seq, title, {_DOI.replace('{c}', 'doi')} AS doi, material AS materials, {_rules(X.TECHNIQUES, '(title || chr(32) || abstract || chr(32) || keywords)')} AS techniques, {_TAGS} AS tags FROM articles_v",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.normalize_article(view(spark, d, "articles_v")).select("seq", "title", "doi", _list(F.col("materials")).alias("materials"), _list(F.col("techniques")).alias("techniques"), _list(F.col("topic_tags")).alias("tags"))


@query(
    "tax_07_figures",
    ctes("articles_v") + f" SELECT seq, CAST(n AS BIGINT) AS figure_index, CASE WHEN n = 1 THEN {_FIG.replace('{c}', 'abstract')} ELSE 'Other' END AS type FROM articles_v, (VALUES (1), (2)) AS f(n)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    figures = F.array(F.struct(F.lit(1).cast("long").alias("figure_index"), F.col("abstract").alias("caption"), F.lit("publisher").alias("caption_source")), F.struct(F.lit(2).cast("long").alias("figure_index"), F.lit("Figure 2").alias("caption"), F.lit("generated").alias("caption_source")))
    return library.normalize_figures(view(spark, d, "articles_v").withColumn("figures", figures)).select("seq", F.explode("figures").alias("f")).select("seq", "f.figure_index", "f.type")


@query("tax_08_publisher", ctes("articles_v") + f" SELECT seq FROM articles_v WHERE starts_with({_DOI.replace('{c}', 'doi')}, '10.1000/') AND regexp_matches(title, '(?i)^(iron|layered)')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "articles_v").where(library.supported_publisher(F.col("doi"), F.col("title"), {"10.1000/": "(?i)^(iron|layered)"})).select("seq")


# ---------------------------------------------------------------- filters, joins


@query("flt_01_year", ctes("articles_v") + " SELECT seq, year FROM articles_v WHERE year >= 2016")
def _(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "articles_v").where(F.col("year") >= 2016).select("seq", "year")


@query("flt_02_relevant", ctes("articles_v") + f" SELECT seq FROM articles_v WHERE {_SCORE.replace('{t}', 'abstract')} > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "articles_v").where(X.relevance_score(F.col("abstract")) > 0).select("seq")


@query(
    "jon_02_enrich_by_doi",
    ctes("articles_v", "registry_v") + f""" SELECT a.seq, coalesce(CASE WHEN a.seq % 4 <> 0 THEN a.source END, r.venue) AS venue, coalesce(r.licence, '') AS licence, a.source || CASE WHEN r.doi IS NOT NULL THEN '|registry' ELSE '' END AS sources
      FROM articles_v a LEFT JOIN registry_v r ON {_DOI.replace('{c}', 'a.doi')} = r.doi""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    articles = view(spark, d, "articles_v").withColumn("venue", F.when(F.col("seq") % 4 == 0, "").otherwise(F.col("source")))
    return library.enrich_by_doi(articles, view(spark, d, "registry_v")).select("seq", "venue", "licence", _list(F.col("sources")).alias("sources"))


@query("jon_01_describe", ctes("articles_v") + " SELECT seq, material, CASE WHEN material LIKE 'Sn%' THEN 'tin chalcogenide' WHEN material LIKE 'Fe%' THEN 'iron chalcogenide' END AS family FROM articles_v")
def _(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([(m, "tin chalcogenide" if m.startswith("Sn") else "iron chalcogenide") for m in MATERIALS if m[:2] in ("Sn", "Fe")], "material string, family string")
    return search.describe_materials(view(spark, d, "articles_v"), known).select("seq", "material", "family")


# ---------------------------------------------------------------- aggregations


@query(
    "agg_01_merge_duplicates",
    ctes("articles_v") + f""", k AS (SELECT *, {_KEY} AS article_key FROM articles_v WHERE year >= 2016)
      SELECT article_key, min(seq) AS seq, arg_min(title, seq) AS title, array_to_string(list_sort(list_distinct(list(source))), ' + ') AS source, max(citations) AS citations,
        coalesce(arg_min(url, seq) FILTER (url <> ''), '') AS url, count(*) AS merged, array_to_string(list_sort(list_distinct(list(material))), '|') AS materials FROM k GROUP BY article_key""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.merge_duplicates(view(spark, d, "articles_v").where("year >= 2016")).select("article_key", "seq", "title", "source", "citations", "url", "merged", _list(F.col("materials")).alias("materials"))


@query("agg_02_first_wins", ctes("articles_v") + f" SELECT article_key, seq, title FROM (SELECT *, row_number() OVER (PARTITION BY article_key ORDER BY seq) AS n FROM (SELECT *, {_KEY} AS article_key FROM articles_v)) WHERE n = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    keyed = view(spark, d, "articles_v").withColumn("article_key", T.article_key(F.col("doi"), F.col("title"), F.col("year")))
    return library.first_wins(keyed, ["article_key"], "seq").select("article_key", "seq", "title")


_FAMILY = "CASE WHEN material LIKE 'Sn%' THEN 'tin chalcogenide' WHEN material LIKE 'Fe%' THEN 'iron chalcogenide' END"
_SUMMARY = f"""SELECT *, {_FAMILY} AS family, row_number() OVER (ORDER BY score DESC, articles DESC, material) AS place FROM (SELECT material, count(*) AS articles, count(t) AS temp_count, count(p) AS photon_count, count(g) AS gap_count,
  coalesce(string_agg(DISTINCT nullif(dopant, ''), '|' ORDER BY nullif(dopant, '')), '') AS dopants,
  concat_ws('|', CASE WHEN bool_or(lower(abstract) LIKE '%fermi surface%') THEN 'Fermi surface' END, CASE WHEN bool_or(lower(title) LIKE '%band structure%') THEN 'band structure' END, CASE WHEN bool_or(lower(abstract) LIKE '%superconducting gap%') THEN 'superconducting gap' END) AS properties, sum(citations) AS score, CAST(min(t) AS DOUBLE) AS temp_min, CAST(max(t) AS DOUBLE) AS temp_max, round(avg(t), 3) AS temp_avg,
  CAST(min(p) AS DOUBLE) AS photon_min, CAST(max(p) AS DOUBLE) AS photon_max, round(avg(p), 3) AS photon_avg, round(min(g), 6) AS gap_min, round(max(g), 6) AS gap_max, round(avg(g), 3) AS gap_avg
  FROM (SELECT *, CAST({_TEMP}[1] AS DOUBLE) AS t, CAST({_PHOTON}[1] AS DOUBLE) AS p,
    CASE WHEN lower({_GAPS}[1]) LIKE '%mev' THEN CAST(string_split({_GAPS}[1], ' ')[1] AS DOUBLE) / 1000 ELSE CAST(string_split({_GAPS}[1], ' ')[1] AS DOUBLE) END AS g FROM articles_v) GROUP BY material)"""


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """One row for each material of an article, with the article's facts."""
    rules = [("superconducting gap", "superconducting gap|gap anisotropy"), ("Fermi surface", "fermi surface"), ("band structure", "band structure|band dispersion")]
    first = lambda numbers: T.first_number(F.get(numbers, F.lit(0)))
    return view(spark, d, "articles_v").select(
        F.explode(X.match_names(F.col("abstract"), NAMES)).alias("material"), F.col("seq").alias("id"), "citations", first(X.temperatures(F.col("abstract"))).alias("t"), first(X.photon_energies(F.col("abstract"))).alias("p"),
        X.gap_eV(F.col("abstract")).alias("g"), F.array_compact(F.array(F.nullif("dopant", F.lit("")))).alias("dopants"), X.flags(F.lower(F.concat_ws(" ", "title", "abstract")), rules).alias("properties"),
    )


@query("agg_03_material_summary", ctes("articles_v") + " " + _SUMMARY)
def _(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([(m, "tin chalcogenide" if m.startswith("Sn") else "iron chalcogenide") for m in MATERIALS if m[:2] in ("Sn", "Fe")], "material string, family string")
    s = search.material_summary(_facts(spark, d), known)
    return s.withColumns({c: _list(F.col(c)) for c in ("dopants", "properties")})


@query("agg_03_material_articles", ctes("articles_v") + " SELECT material, seq AS id FROM articles_v")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.material_articles(_facts(spark, d))


@query(
    "agg_04_audit",
    ctes("articles_v") + f""", k AS (SELECT *, {_KEY} AS article_key FROM articles_v)
      SELECT source, count(*) AS articles, count(DISTINCT article_key) AS identities, count(*) - count(DISTINCT article_key) AS duplicates, count_if(url = '') AS no_url,
      count_if(year < 2016) AS too_old, count_if(strpos(doi, 'DOI') > 0) AS raw_doi FROM k GROUP BY source""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return library.audit(view(spark, d, "articles_v"))


@query("agg_05_counts", ctes("articles_v") + " SELECT source, count(*) AS articles, CAST(sum(len(string_split(keywords, '|'))) AS BIGINT) AS keywords FROM articles_v GROUP BY source")
def _(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "articles_v").groupBy("source").agg(F.count("*").alias("articles"), F.sum(F.size(T.split_keywords(F.col("keywords")))).alias("keywords"))


@query("agg_06_ingest_stats", ctes("articles_v", "registry_v") + f" SELECT a.source, count_if(year >= 2016) AS accepted, count_if(year < 2016) AS skipped, count(r.doi) AS enriched FROM articles_v a LEFT JOIN registry_v r ON {_DOI.replace('{c}', 'a.doi')} = r.doi GROUP BY a.source")
def _(spark: SparkSession, d: str) -> DataFrame:
    both = library.enrich_by_doi(view(spark, d, "articles_v"), view(spark, d, "registry_v"))
    return both.groupBy("source").agg(F.count_if(F.col("year") >= 2016).alias("accepted"), F.count_if(F.col("year") < 2016).alias("skipped"), F.count_if(F.array_contains("sources", "registry")).alias("enriched"))


@query("agg_12_facets", ctes("articles_v") + " SELECT 'keyword' AS facet, k AS value, count(*) AS articles FROM (SELECT unnest(string_split(keywords, '|')) AS k FROM articles_v) GROUP BY k UNION ALL SELECT 'material', material, count(*) FROM articles_v GROUP BY material")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "articles_v").select(F.array("material").alias("material"), T.split_keywords(F.col("keywords")).alias("keyword"))
    return search.facets(a, ["keyword", "material"])


@query("srt_01_ranked", ctes("articles_v") + " SELECT seq, row_number() OVER (ORDER BY citations DESC, year DESC, seq) AS place FROM articles_v ORDER BY place LIMIT 120")
def _(spark: SparkSession, d: str) -> DataFrame:
    top = view(spark, d, "articles_v").orderBy(F.desc("citations"), F.desc("year"), "seq").limit(120)
    return top.select("seq", F.row_number().over(Window.orderBy(F.desc("citations"), F.desc("year"), "seq")).cast("long").alias("place"))


@query("set_01_union", ctes("articles_v") + " SELECT source, count(*) AS n FROM (SELECT source FROM articles_v WHERE source = 'curated' UNION ALL SELECT source FROM articles_v WHERE source <> 'curated') GROUP BY source")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "articles_v")
    return a.where("source = 'curated'").drop("url").unionByName(a.where("source <> 'curated'"), allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"))


@query("set_02_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("set_03_intersection", "SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").intersect(table(spark, d, "orders").select("o_custkey"))


# ---------------------------------------------------------------- search

QUERY_TEXTS = [(1, "SnSe2 ARPES"), (2, "fe band"), (3, "cobaltocene, monolayer"), (4, "bi")]


@query(
    "sea_01_search_articles",
    ctes("articles_v") + """, t(qid, term) AS (VALUES (1, 'snse2'), (1, 'arpes'), (2, 'fe'), (2, 'band'), (3, 'cobaltocene'), (3, 'monolayer'), (4, 'bi')),
      s AS (SELECT qid, seq, sum(CASE WHEN length(term) <= 2 THEN CASE WHEN starts_with(lower(material), term) THEN 50 ELSE 0 END ELSE
        CASE WHEN contains(lower(material), term) THEN 50 ELSE 0 END + CASE WHEN contains(lower(dopant), term) THEN 35 ELSE 0 END
        + CASE WHEN len(list_filter(string_split(lower(keywords), '|'), lambda k: contains(k, term))) > 0 THEN 15 ELSE 0 END
        + CASE WHEN contains(lower(title), term) THEN 10 ELSE 0 END + CASE WHEN contains(lower(abstract), term) THEN 10 ELSE 0 END END) AS score FROM t, articles_v GROUP BY qid, seq)
      SELECT CAST(qid AS BIGINT) AS qid, seq, CAST(score AS BIGINT) AS score FROM s WHERE score > 0""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    queries = spark.createDataFrame(QUERY_TEXTS, "qid long, query string")
    a = view(spark, d, "articles_v").select("seq", F.array("material").alias("materials"), F.array("dopant").alias("dopants"), T.split_keywords(F.col("keywords")).alias("keywords"), "title", F.array("abstract").alias("evidence"))
    return search.search_articles(a, queries, "seq").select("qid", "seq", "score")


@query(
    "sea_02_search_elements",
    "SELECT q.qid, n.n_nationkey FROM (VALUES (CAST(1 AS BIGINT), 'nation_1'), (2, 'n_'), (3, 'nation_24')) q(qid, term), nation n WHERE CASE WHEN length(term) <= 2 THEN lower(n_name) = term ELSE contains(lower(n_name), term) END",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    queries = spark.createDataFrame([(1, "NATION_1"), (2, "n_"), (3, "nation_24")], "qid long, query string")
    return search.search_names(table(spark, d, "nation"), queries, ["n_name"], "n_nationkey").select("qid", "n_nationkey")


@query(
    "sea_03_lookup_catalog",
    """WITH q(qid, q) AS (VALUES (CAST(1 AS BIGINT), 'red widget'), (2, 'ring')), c AS (SELECT DISTINCT p_name, p_type FROM part),
      s AS (SELECT qid, p_name, p_type, CASE WHEN p_name = q THEN 100 ELSE 0 END + CASE WHEN contains(p_name, q) THEN 40 ELSE 0 END
        + list_sum(list_transform(string_split(q, ' '), lambda w: CASE WHEN p_name = w THEN 30 WHEN contains(p_name || ' ' || lower(p_type), w) THEN 5 ELSE 0 END)) AS score FROM q, c)
      SELECT qid, p_name, p_type, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, p_name, p_type) AS n FROM s WHERE score > 0) WHERE n <= 8""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    queries = spark.createDataFrame([(1, "red widget"), (2, "ring")], "qid long, query string")
    return search.lookup_catalog(table(spark, d, "part").select("p_name", "p_type").distinct(), queries, "p_name", "p_type", 8)


@query(
    "sea_04_bundle",
    ctes("articles_v") + f""", t(qid, term) AS (VALUES (1, 'snse2'), (1, 'arpes'), (2, 'fe'), (2, 'band'), (3, 'cobaltocene'), (3, 'monolayer'), (4, 'bi')),
      h AS (SELECT qid, seq, sum(CASE WHEN length(term) <= 2 THEN CASE WHEN starts_with(lower(material), term) THEN 50 ELSE 0 END ELSE
        CASE WHEN contains(lower(material), term) THEN 50 ELSE 0 END + CASE WHEN contains(lower(dopant), term) THEN 35 ELSE 0 END + CASE WHEN contains(lower(title), term) THEN 10 ELSE 0 END END) AS score FROM t, articles_v GROUP BY qid, seq)
      SELECT CAST(qid AS BIGINT) AS qid, material, count(*) AS articles, CAST(sum(score) AS BIGINT) AS score, min(year) AS temp_min, max(year) AS temp_max, round(avg(year), 3) AS temp_avg, coalesce(array_to_string(list_sort(list_distinct(list(dopant) FILTER (dopant <> ''))), '|'), '') AS dopants, array_to_string(list_sort(list_distinct(list(source))), '|') AS properties
      FROM h JOIN articles_v USING (seq) WHERE score > 0 GROUP BY qid, material""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    queries = spark.createDataFrame(QUERY_TEXTS, "qid long, query string")
    dopants = F.filter(F.array("dopant"), lambda x: x != "")
    a = view(spark, d, "articles_v").select("seq", F.array("material").alias("materials"), dopants.alias("dopants"), "title", F.array("source").alias("properties"), F.col("year").alias("t"), F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("g"))
    elements = table(spark, d, "nation").select(F.col("n_name").alias("symbol"), F.col("n_name").alias("name"))
    m = search.bundle(a.withColumn("score", F.lit(0)), queries, elements, "seq")[1]
    return m.select("qid", "material", "articles", "score", "temp_min", "temp_max", "temp_avg", _list(F.col("dopants")).alias("dopants"), _list(F.col("properties")).alias("properties"))


# ---------------------------------------------------------------- figures

_FIG = ctes("pages_v", "articles_v") + """, f AS (
    SELECT page_key, 1 AS figure_index, 'https://media.springernature.com/lw685/a&b/Fig1_HTML.png' AS image_url, material || ' ARPES map at ' || p_size || ' K' AS caption FROM pages_v JOIN articles_v ON seq = page_key JOIN part ON p_partkey = page_key WHERE form <> 0
    UNION ALL SELECT page_key, 3, 'https://media.springernature.com/lw685/c/Fig3_HTML.jpeg', '' FROM pages_v WHERE form <> 0
    UNION ALL SELECT page_key, n, 'https://media.springernature.com/lw685/x/art%3A10.1038%2Fs' || page_key || '/MediaObjects/1_Fig' || n || '_HTML.' || CASE n WHEN 1 THEN 'jpg' ELSE 'png' END, '' FROM pages_v, (VALUES (1), (2)) v(n) WHERE form = 0)"""


@query("fig_01_extract_figures", _FIG + " SELECT page_key, CAST(figure_index AS BIGINT) AS figure_index, image_url, caption AS excerpt, 'Study ' || page_key || ' - Figure ' || figure_index || CASE WHEN caption <> '' THEN ': ' || caption ELSE '' END AS caption, CASE WHEN caption <> '' THEN 'publisher' ELSE 'generated_label' END AS caption_source FROM f")
def _(spark: SparkSession, d: str) -> DataFrame:
    return figures.extract_figures(view(spark, d, "pages_v"), "page_key").select("page_key", F.col("figure_index").cast("long").alias("figure_index"), "image_url", "excerpt", "caption", "caption_source")


@query("fig_02_figure_urls", _FIG + " SELECT f.page_key, CAST(figure_index AS BIGINT) AS number, image_url FROM f JOIN pages_v USING (page_key) WHERE form = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return figures.figure_urls(view(spark, d, "pages_v").where("form = 0"), "page_key").select("page_key", F.col("number").cast("long").alias("number"), "image_url")


@query("fig_03_standard_url", "SELECT page_id, 'https://media.springernature.com/lw685/x/full/' || page_id || '.png' AS url FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    sizes = F.array(*[F.lit(x) for x in figures.VARIANTS])
    raw = F.concat(F.lit("//media.springernature.com/"), F.get(sizes, (F.col("page_id") % 4).cast("int")), F.lit("/x/"), F.when(F.col("page_id") % 4 == 2, "full").otherwise("fuII"), F.lit("/"), "page_id", F.lit(".png?as=webp"))
    return table(spark, d, "pages").select("page_id", F.replace(figures.standard_url(raw), F.lit("fuII"), F.lit("full")).alias("url"))


@query(
    "fig_04_manifest",
    _FIG + " SELECT 's-' || 'x' AS kind, count(*) AS figures, count(*) AS assets, count_if(f.page_key % 3 = 0) AS reused FROM f",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "pages_v")
    f = figures.extract_figures(p, "page_key").join(p.select("page_key", "doi"), "page_key")
    landed = figures.asset_manifest(f.where("page_key % 3 = 0"), spark.createDataFrame([], "asset string"), "doi")
    m = figures.asset_manifest(f, landed, "doi")
    return figures.manifest_totals(m).select(F.lit("s-x").alias("kind"), "figures", "assets", "reused")
