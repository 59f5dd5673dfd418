"""Queries on axes, catalogs, edges, identifiers, facets, orders and labellers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chem
from ..functions import extract as X
from ..functions import text as T
from ..operators import bands, consensus, dictionary, knn, library, payloads, search, spectra
from .adapters import ctes, table, view
from .registry import query

# ---------------------------------------------------------------- text


@query("ext_02_preprint_ids", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '2101.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') || CASE WHEN doc_id % 2 = 0 THEN 'v2' ELSE '' END END AS preprint FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    number = F.concat(F.lit("2101."), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"), F.when(F.col("doc_id") % 2 == 0, "v2").otherwise(""))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("see ARXIV: "), number, F.lit(", and arXiv:9999.99999"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("arXiv "), number))
    return table(spark, d, "documents").select("doc_id", X.first_preprint_id(text).alias("preprint"))


@query("ext_07_fermi_velocities", "SELECT p_partkey, '1.' || p_size || ' eV Å|' || p_size || ' m/s' AS velocities FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("a Fermi velocity of 1."), size, F.lit(" eV Å, later vF = "), size, F.lit(" m/s; and v_F=1."), size, F.lit(" eV Å again"))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.fermi_velocities(text), "|").alias("velocities"))


@query("chm_02_acronyms", "SELECT p_partkey, list_extract(['Y|Ba|Cu|O', 'Sr|Ti|O', 'P', '', 'Nd|Sr|Ni|O', ''], CAST(p_partkey % 6 + 1 AS INTEGER)) AS elements FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("ybco", "STO", "black phosphorus", "ARPES", "Nd1-xSrxNiO2", "Xx2")))
    return table(spark, d, "part").select("p_partkey", F.array_join(chem.formula_elements(F.get(names, (F.col("p_partkey") % 6).cast("int"))), "|").alias("elements"))


# ---------------------------------------------------------------- libraries


@query(
    "agg_12_all_facets",
    ctes("articles_v") + """ SELECT 'dopant' AS facet, dopant AS value, count(*) AS articles FROM articles_v GROUP BY dopant UNION ALL SELECT 'element', unnest(regexp_extract_all(material, '[A-Z][a-z]?')), count(*) FROM articles_v GROUP BY 2
      UNION ALL SELECT 'technique', t, count(*) FROM (SELECT unnest(list_filter([CASE WHEN regexp_matches(abstract, 'ARPES') THEN 'ARPES' END, CASE WHEN regexp_matches(abstract, 'STM|scanning tunneling') OR regexp_matches(abstract, '(?i)scanning tunneling') THEN 'STM' END], lambda x: x IS NOT NULL)) AS t FROM articles_v) GROUP BY t""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    a = view(spark, d, "articles_v").select(F.array("dopant").alias("dopant"), F.array_distinct(chem.formula_elements(F.col("material"))).alias("element"), X.techniques(F.col("abstract")).alias("technique"))
    return search.facets(a, ["dopant", "element", "technique"])


@query(
    "agg_04_audit_rules",
    ctes("articles_v") + """ SELECT source, count(*) AS articles, count_if(seq % 13 = 0) AS suspicious_materials, count_if(seq % 17 = 0) AS invalid_elements, count_if(seq % 17 = 0) + count_if(seq % 19 = 0) AS mismatched_elements, count_if(seq % 4 = 2) AS figure_metadata_missing,
      count_if(seq % 10 = 0) AS figure_classification_mismatches, count_if(seq % 5 = 0) AS invalid_figure_types, count_if(seq % 11 = 0) AS invalid_two_d_categories, count_if(seq % 6 = 0) AS unsupported_arpes_tags, count_if(seq % 11 = 0) AS classification_mismatches, false AS passed FROM articles_v GROUP BY source""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    a = library.classify(view(spark, d, "articles_v"))
    n = lambda k: F.col("seq") % k == 0
    extra = lambda base, *more: F.array_compact(F.concat(base, F.array(*more)))
    caption = F.when(n(4), "Fermi surface map").otherwise("")
    kind = F.when(n(5), "Nonsense").when(n(4), "Fermi surface").otherwise("Other")
    figure = F.struct(kind.alias("type"), F.when(n(2), "publisher_caption").otherwise("unclassified").alias("type_source"), F.lit("publisher").alias("caption_source"), F.when(n(4), "high").otherwise("unclassified").alias("classification_confidence"), caption.alias("publisher_caption"))
    a = a.withColumns({
        "materials": extra(F.array("material"), F.when(n(13), F.lit("PHYSICS"))),
        "elements": extra(chem.formula_elements(F.col("material")), F.when(n(17), F.lit("Xq")), F.when(n(19), F.lit("Au"))),
        "techniques": F.array(F.lit("ARPES")), "figures": F.array(figure), "two_d_categories": extra(F.col("two_d_categories"), F.when(n(11), F.lit("bogus"))),
    })
    return library.audit_rules(a, [])


@query("ext_06_all_snippets", "SELECT p_partkey, 'beamline BL' || p_size || ' end' AS beamline, 'Scienta DA30 no. ' || p_size AS analyzer, 'grown by CVT, ' || p_size || '%' AS preparation FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("Data of beamline BL"), size, F.lit(" end; Scienta DA30 no. "), size, F.lit("; crystals were grown by CVT, "), size, F.lit("%\nnext line"))
    return table(spark, d, "part").select("p_partkey", *[F.array_join(X.snippets(text, k), "|").alias(k) for k in ("beamline", "analyzer", "preparation")])


@query("srt_01_by_year", ctes("articles_v") + " SELECT seq, row_number() OVER (ORDER BY year DESC, title, seq) AS place FROM articles_v ORDER BY place LIMIT 220")
def _(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("year"), F.asc("title"), F.asc("seq")]
    top = view(spark, d, "articles_v").orderBy(*order).limit(220)
    return top.select("seq", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("srt_02_eight_each", ctes("articles_v") + " SELECT material, seq FROM (SELECT *, row_number() OVER (PARTITION BY material ORDER BY citations DESC, year DESC, seq) AS n FROM articles_v) WHERE n <= 8")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("material").orderBy(F.desc("citations"), F.desc("year"), "seq")
    return view(spark, d, "articles_v").withColumn("n", F.row_number().over(w)).where("n <= 8").select("material", "seq")


@query("udx_01_labeller", "SELECT vec_id AS qid, label % 3 AS label FROM embeddings WHERE vec_id % 100 = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    knn.register_labeller("own", lambda q, s: q.select(F.col("vec_id").alias("qid"), (F.col("label") % 3).alias("label")))
    e = table(spark, d, "embeddings")
    return knn.labeller("own")(e.where("vec_id % 100 = 0"), e)


# ---------------------------------------------------------------- spectra and bands

_PATHS = ["entry/data/fine_cut", "entry/energy", "scan/Theta_deg", "map/kx", "stage/temp_K", "root/image"]


@query("spc_01_axis_kind", "SELECT event_id, list_extract(['axis', 'energy', 'angle', 'momentum', 'temperature', 'axis'], CAST(event_id % 6 + 1 AS INTEGER)) AS kind FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = F.get(F.array(*map(F.lit, _PATHS)), (F.col("event_id") % 6).cast("int"))
    return table(spark, d, "events").select("event_id", spectra.axis_kind(path).alias("kind"))


@query(
    "spc_02_rank_datasets",
    """WITH c AS (SELECT user_id AS file, event_id, event_id % 6 AS p, 4 + event_id % 40 AS n, CASE WHEN event_id % 5 = 0 THEN 4 ELSE 16 END AS m, CASE WHEN event_id % 7 = 0 THEN 'string' ELSE 'float64' END AS dtype FROM events),
      s AS (SELECT *, log10(n * m) + list_extract([195, 0, 0, 55, 0, 20], CAST(p + 1 AS INTEGER)) - CASE WHEN p IN (1, 2) AND least(n, m) <= 4 THEN 50 ELSE 0 END AS score FROM c WHERE dtype = 'float64' AND n * m >= 64)
      SELECT file, arg_max(n, (round(score, 9), p, n)) AS n, round(max(score), 6) AS score FROM s GROUP BY file""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("event_id") % 6
    path = F.concat(F.get(F.array(*map(F.lit, _PATHS)), p.cast("int")), F.lit("/"), p, F.lpad((4 + F.col("event_id") % 40).cast("string"), 3, "0"))
    catalog = table(spark, d, "events").select(F.col("user_id").alias("file"), path.alias("path"), F.array((4 + F.col("event_id") % 40), F.when(F.col("event_id") % 5 == 0, 4).otherwise(16).cast("long")).alias("shape"), F.when(F.col("event_id") % 7 == 0, "string").otherwise("float64").alias("dtype"))
    return spectra.rank_datasets(catalog).select("file", F.get("shape", F.lit(0)).alias("n"), F.round("score", 6).alias("score"))


@query("spc_04_mid_slice", ctes("spectra_v") + " SELECT dataset, i, round(value, 6) AS value FROM spectra_v WHERE j = 15")
def _(spark: SparkSession, d: str) -> DataFrame:
    return spectra.mid_slice(view(spark, d, "spectra_v"), "j", 30).select("dataset", "i", F.round("value", 6).alias("value"))


@query(
    "spc_10_fermi_edge_near",
    ctes("spectra_v") + """, e AS (SELECT dataset, i, avg(value) AS v FROM spectra_v GROUP BY dataset, i), b AS (SELECT dataset, max(i) AS mi FROM e GROUP BY dataset), k AS (SELECT unnest(range(-6, 7)) AS o),
      s AS (SELECT e.dataset, e.i, sum(exp(-o * o / 8.0) * n.v) / sum(exp(-o * o / 8.0)) AS smooth FROM e JOIN b USING (dataset), k JOIN e n ON n.dataset = e.dataset AND n.i = greatest(0, least(mi, e.i + o)) GROUP BY e.dataset, e.i),
      t AS (SELECT *, (lead(smooth) OVER w - lag(smooth) OVER w) / (2.0 / (mi)) AS slope, -0.5 + i / CAST(mi AS DOUBLE) AS energy, max(smooth) OVER (PARTITION BY dataset) - min(smooth) OVER (PARTITION BY dataset) AS span FROM s JOIN b USING (dataset) WINDOW w AS (PARTITION BY dataset ORDER BY i)),
      u AS (SELECT *, CASE WHEN slope < 0 THEN abs(slope) ELSE 0.18 * abs(slope) END AS score, row_number() OVER (PARTITION BY dataset ORDER BY abs(slope)) AS nth, count(*) OVER (PARTITION BY dataset) AS n FROM t WHERE slope IS NOT NULL AND i >= 1 AND i < mi AND abs(energy) <= 0.18)
      SELECT dataset, arg_max(i, (score, -i)) AS edge, round(arg_max(energy, (score, -i)), 6) AS energy, round(max(score) / greatest(max(CASE WHEN nth = floor(n * 0.5) + 1 THEN abs(slope) END), max(span) * 1e-6), 4) AS confidence FROM u GROUP BY dataset""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = spectra.fermi_edge_near(view(spark, d, "spectra_v"), -0.5, 0.5)
    return e.select("dataset", "edge", F.round("energy", 6).alias("energy"), F.round("confidence", 4).alias("confidence"))


@query("spc_11_calibrate_energy", ctes("spectra_v") + " SELECT dataset, i, j, round(CASE WHEN j % 2 = 0 THEN -(value * CASE i % 4 WHEN 0 THEN 1e-3 WHEN 1 THEN 1e3 WHEN 2 THEN 1e-6 ELSE 1 END - 4.5) ELSE value * CASE i % 4 WHEN 0 THEN 1e-3 WHEN 1 THEN 1e3 WHEN 2 THEN 1e-6 ELSE 1 END - 4.5 END, 6) AS energy FROM spectra_v")
def _(spark: SparkSession, d: str) -> DataFrame:
    unit = F.get(F.array(*map(F.lit, ("meV", "keV", "µeV", "eV"))), (F.col("i") % 4).cast("int"))
    return view(spark, d, "spectra_v").select("dataset", "i", "j", F.round(spectra.calibrate_energy(F.col("value"), unit, F.lit(4.5), F.col("j") % 2 == 0), 6).alias("energy"))


@query("spc_12_source_identity", "SELECT user_id % 50 AS file, count(*) AS datasets, count(DISTINCT event_id % 3) AS identities FROM events GROUP BY user_id % 50")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    n = (F.col("event_id") % 3).cast("double")
    # One axis runs backwards in half of the rows, which must not change the identity.
    one = F.when(F.col("event_id") % 2 == 0, F.struct(F.lit(0).alias("dimension"), F.lit("E").alias("label"), n.alias("first"), (n + 5).alias("last"))).otherwise(F.struct(F.lit(0).alias("dimension"), F.lit("E").alias("label"), (n + 5).alias("first"), n.alias("last")))
    catalog = e.select((F.col("user_id") % 50).alias("file"), F.lit("p").alias("path"), F.lit("float64").alias("dtype"), F.array(F.lit(3), F.lit(4)).alias("shape"), F.array(one).alias("axes"))
    return spectra.source_identity(catalog).groupBy("file").agg(F.count("*").alias("datasets"), F.countDistinct("fingerprint").alias("identities"))


@query("bnd_05_map_scale", ctes("bands_v") + " SELECT dataset, band, k, round(k * 0.25 - 3, 6) AS mapped FROM bands_v")
def _(spark: SparkSession, d: str) -> DataFrame:
    return bands.map_scale(view(spark, d, "bands_v"), 0.25, -3.0).select("dataset", "band", "k", F.round("mapped", 6).alias("mapped"))


@query("txt_12_nested_placeholders", "SELECT p_partkey, p_partkey % 4 IN (1, 3) AS placeholder FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    parts = F.array(F.array(F.lit("300 K"), F.lit("PBE")), F.array(F.lit("300 K"), F.lit("TBD")), F.array(F.lit("x")), F.array(F.lit("n/a")))
    return table(spark, d, "part").select("p_partkey", F.exists(F.get(parts, (F.col("p_partkey") % 4).cast("int")), lambda x: T.is_placeholder(x)).alias("placeholder"))


_SPECS = [(p, names[0], a, False) for p, names in payloads.ALIASES.items() for a in names] + [(p, names[0], names[0], True) for p, names in payloads.ALIASES.items()]
_SPEC_ROWS = ", ".join(f"({i}, '{p}', '{c}', '{a}', {str(n).lower()})" for i, (p, c, a, n) in enumerate(_SPECS))
_DIVISORS = ", ".join(f"('{p}', '{u}', {k})" for p, d in payloads.DIVISORS.items() for u, k in d.items())
_RANGES = ", ".join(f"('{p}', {r[1]}, {r[2]})" for p, r in consensus.PROPERTIES.items())
_UNIT_SQL = "regexp_replace(replace(replace(lower({}), 'kelvin', 'k'), 'electronvolt', 'ev'), '[·*\\s]+', '', 'g')"
_WALK = (
    ctes("payloads_v")
    + """, walk AS (
      SELECT record_id, 0 AS level, '' AS path, CAST(NULL AS VARCHAR) AS model, CAST(payload AS JSON) AS j FROM payloads_v
      UNION ALL
      SELECT record_id, level + 1, path || '/' || (i - 1), kids[i].m, kids[i].v FROM (
        SELECT record_id, level, path, kids, unnest(range(1, len(kids) + 1)) AS i FROM (
          SELECT record_id, level, path, CASE WHEN json_type(j, '$.models') = 'ARRAY' THEN
              list_transform(json_extract(j, '$.models[*]'), lambda b: {'v': coalesce(json_extract(b, '$.candidates'), json_extract(b, '$.results')), 'm': coalesce(json_extract_string(b, '$.model'), json_extract_string(b, '$.name'), model)})
            WHEN json_type(j, '$.results') = 'ARRAY' THEN list_transform(json_extract(j, '$.results[*]'), lambda b: {'v': b, 'm': coalesce(json_extract_string(j, '$.model'), model)})
            WHEN json_type(j, '$.candidates') = 'ARRAY' THEN list_transform(json_extract(j, '$.candidates[*]'), lambda b: {'v': b, 'm': coalesce(json_extract_string(j, '$.model'), model)})
            WHEN json_type(j) = 'ARRAY' THEN list_transform(json_extract(j, '$[*]'), lambda b: {'v': b, 'm': model}) END AS kids
          FROM walk) x WHERE kids IS NOT NULL) y),
    cand AS (SELECT record_id, path, model, j FROM walk WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.models') IS NULL AND json_type(j, '$.results') IS NULL AND json_type(j, '$.candidates') IS NULL)"""
)


@query("src_12_payload_candidates", _WALK + " SELECT record_id, path, model, j->>'$.formula' AS formula, j->>'$.property' AS named FROM cand")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = payloads.candidates(view(spark, d, "payloads_v").withColumn("payload", F.parse_json("payload")))
    text = lambda name: F.try_variant_get("candidate", f"$.{name}", "string").alias("formula" if name == "formula" else "named")
    return rows.select("record_id", F.array_join(F.transform("path", lambda p: F.concat(F.lit("/"), p)), "").alias("path"), "model", text("formula"), text("property"))


@query(
    "clm_01_payload_properties",
    _WALK
    + f""", specs(rank, property, name, alias, nested) AS (VALUES {_SPEC_ROWS}), divisors(property, unit, divisor) AS (VALUES {_DIVISORS}), ranges(property, low, high) AS (VALUES {_RANGES}),
    raws AS (
      SELECT c.record_id, c.path, c.j, s.rank, s.property, s.name, s.alias, json_extract(c.j, CASE WHEN s.nested THEN '$.properties.' ELSE '$.' END || s.alias) AS raw FROM cand c, specs s
      UNION ALL
      SELECT c.record_id, c.path, c.j, 99, s.property, s.name, 'value', json_extract(c.j, '$.value') FROM cand c
        JOIN (SELECT DISTINCT property, name, lower(alias) AS alias FROM specs) s ON s.alias = lower(c.j->>'$.property') WHERE json_extract(c.j, '$.value') IS NOT NULL),
    found AS (SELECT * FROM raws WHERE raw IS NOT NULL AND trim(raw->>'$') <> ''),
    counted AS (SELECT record_id, path, count(DISTINCT property) AS n FROM found GROUP BY ALL),
    readings AS (
      SELECT f.record_id, f.path, f.rank, f.property, n, {_UNIT_SQL.format("nullif(f.j->>'$.unit', '')")} AS whole,
        {_UNIT_SQL.format("coalesce(CASE WHEN json_type(f.raw) = 'OBJECT' THEN nullif(f.raw->>'$.unit', '') END, nullif(json_extract_string(f.j, '$.units.' || f.alias), ''))")} AS own,
        TRY_CAST(CASE WHEN json_type(f.raw) = 'OBJECT' THEN coalesce(f.raw->>'$.value', f.raw->>'$.mean') ELSE f.raw->>'$' END AS DOUBLE) AS x
      FROM found f JOIN counted USING (record_id, path)),
    judged AS (
      SELECT r.record_id, r.path, r.rank, r.property, r.x / coalesce(v.divisor, 1) AS value,
        CASE WHEN n > 1 AND whole IS NOT NULL AND own IS NULL THEN 'AMBIGUOUS_PROPERTY_UNIT' WHEN n = 1 AND own <> whole THEN 'CONFLICTING_PROPERTY_UNITS' WHEN x IS NULL THEN 'INVALID_PROPERTY_VALUE'
             WHEN coalesce(own, whole) IS NOT NULL AND v.divisor IS NULL THEN 'UNSUPPORTED_PROPERTY_UNIT' WHEN r.x / coalesce(v.divisor, 1) NOT BETWEEN g.low AND g.high THEN 'INVALID_PROPERTY_RANGE' END AS code
      FROM readings r JOIN ranges g USING (property) LEFT JOIN divisors v ON v.property = r.property AND v.unit = coalesce(own, whole)),
    agreed AS (
      SELECT record_id, path, property, min(rank) AS rank, arg_min(value, rank) AS value,
        coalesce(arg_min(code, rank) FILTER (code IS NOT NULL), CASE WHEN max(abs(value)) - min(abs(value)) > 1e-12 * greatest(1, max(abs(value))) THEN 'CONFLICTING_PROPERTY_ALIASES' END) AS code
      FROM judged GROUP BY ALL),
    failed AS (SELECT record_id, path, arg_min(code, rank) AS code FROM agreed WHERE code IS NOT NULL GROUP BY ALL)
    SELECT record_id, path, property, round(value, 9) AS value, CAST(NULL AS VARCHAR) AS error FROM agreed ANTI JOIN failed USING (record_id, path)
    UNION ALL SELECT record_id, path, NULL, NULL, code FROM failed""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = payloads.candidates(view(spark, d, "payloads_v").withColumn("payload", F.parse_json("payload")))
    rows = payloads.canonical_properties(rows)
    path = F.array_join(F.transform("path", lambda p: F.concat(F.lit("/"), p)), "").alias("path")
    return rows.select("record_id", path, "error", F.explode_outer("properties").alias("r")).select("record_id", "path", "r.property", F.round("r.value", 9).alias("value"), "error").where("error IS NOT NULL OR property IS NOT NULL")


#: The dictionary of both engines: each benchmark item by its first two words, and each part's brand and name.
_NAMES = """SELECT 'item-' || CAST(item_id AS VARCHAR(20)) AS name, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS alias, CAST(item_id AS BIGINT) AS position FROM {benchmark} WHERE text <> ''
  UNION ALL SELECT DISTINCT p_brand, p_brand, CAST(-1 AS BIGINT) FROM {part} UNION ALL SELECT DISTINCT p_name, split_part(p_name, ' ', 2), CAST(-2 AS BIGINT) FROM {part}"""


@query(
    "jon_03_alias_dictionary",
    "WITH names AS (" + _NAMES.replace("{benchmark}", "benchmark").replace("{part}", "part") + r"""),
    texts AS (SELECT 'd-' || CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'p-' || CAST(p_partkey AS VARCHAR), p_type || ', ' || lower(p_brand) || ': ' || p_name FROM part),
    hits AS (SELECT DISTINCT t.id, n.position, n.name FROM texts t JOIN (SELECT DISTINCT * FROM names WHERE trim(alias) <> '') n
      ON contains(lower(t.text), lower(n.alias)) AND regexp_matches(t.text, '(?i)(^|[^A-Za-z0-9])' || regexp_escape(n.alias) || '($|[^A-Za-z0-9])'))
    SELECT id, coalesce(string_agg(name, '|' ORDER BY position, name), '') AS names FROM texts LEFT JOIN hits USING (id) GROUP BY id""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    names = spark.sql(_NAMES, benchmark=table(spark, d, "benchmark"), part=table(spark, d, "part"))
    documents = table(spark, d, "documents").select(F.concat(F.lit("d-"), "doc_id").alias("id"), "text")
    parts = table(spark, d, "part").select(F.concat(F.lit("p-"), "p_partkey").alias("id"), F.concat("p_type", F.lit(", "), F.lower("p_brand"), F.lit(": "), "p_name").alias("text"))
    return dictionary.match_dictionary(documents.unionByName(parts), names).select("id", F.array_join("names", "|").alias("names"))
