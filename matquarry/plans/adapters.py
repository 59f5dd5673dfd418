"""Domain views over the given tables, by SQL that Spark and DuckDB read alike.

Each view is one SELECT of integer arithmetic, CASE and string concatenation, so both engines build the same
rows.  Lists are strings joined by '|'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.payloads import ALIASES
from ..scratch import spread

#: Fixed example materials of the views, in order.
MATERIALS = ["SnSe2", "SnSeS", "SnS2", "SnSe", "SnS", "Bi2Se3", "Bi2Te3", "Sb2Te3", "WTe2", "MoS2", "FeSe", "FeTe"]
_MATERIAL = "CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MATERIALS)) + " END"

ARTICLES = f"""
SELECT p_partkey AS seq,
  {_MATERIAL} AS material,
  CASE WHEN p_partkey % 4 = 1 THEN 'cobaltocene' WHEN p_partkey % 4 = 2 THEN 'CoCp2' ELSE '' END AS dopant,
  CASE WHEN p_partkey % 7 = 0 THEN 'Iron-based superconductor '
       WHEN p_partkey % 7 = 1 THEN 'Monolayer '
       WHEN p_partkey % 7 = 2 THEN 'Layered COF beamline '
       ELSE 'Study of ' END || {_MATERIAL} || ' band structure ' || CAST(p_partkey % 700 AS VARCHAR(20)) AS title,
  CAST(2008 + p_size % 18 AS BIGINT) AS year,
  CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'https://doi.org/10.1000/ABC.' ELSE 'DOI: 10.1000/abc.' END
       || CAST(p_partkey % 500 AS VARCHAR(20)) || CASE WHEN p_partkey % 5 = 0 THEN '?src=feed' ELSE '' END ELSE '' END AS doi,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'https://lib.example.org/a/' || CAST(p_partkey AS VARCHAR(20)) END AS url,
  CASE p_partkey % 4 WHEN 0 THEN 'index' WHEN 1 THEN 'works' WHEN 2 THEN 'feed' ELSE 'curated' END AS source,
  (p_partkey * 7) % 101 AS citations,
  CASE WHEN p_partkey % 6 = 0 THEN 'Scanning tunneling (STM) data. ' ELSE 'ARPES data. ' END
    || 'Spectra measured at ' || CAST(p_size AS VARCHAR(20)) || ' K with photon energy of ' || CAST(20 + p_partkey % 80 AS VARCHAR(20))
    || ' eV. ' || {_MATERIAL} || ' has a band gap of 0.' || CAST(p_partkey % 9 + 1 AS VARCHAR(20))
    || CASE WHEN p_partkey % 8 = 0 THEN ' meV' ELSE ' eV' END || CASE WHEN p_partkey % 4 = 1 THEN ' after cobaltocene doping' ELSE '' END
    || CASE WHEN p_partkey % 10 = 3 THEN '; superconducting gap and Fermi surface seen' ELSE '' END || '.' AS abstract,
  p_type || '|' || p_brand || '|' || CASE WHEN p_partkey % 2 = 0 THEN 'DFT' ELSE 'photoemission' END AS keywords
FROM {{part}}"""

REGISTRY = """
SELECT '10.1000/abc.' || CAST(o_orderkey % 500 AS VARCHAR(20)) AS doi,
  max(o_orderpriority) AS venue, max(o_orderstatus) AS licence
FROM {orders} GROUP BY o_orderkey % 500"""

CLAIMS = """
SELECT (l_orderkey * 1000000 + l_partkey) * 10 + l_linenumber AS record_id,
  'model-' || CAST(l_suppkey % 9 AS VARCHAR(20)) AS model,
  'family-' || CAST(l_suppkey % 4 AS VARCHAR(20)) AS family,
  CASE l_linenumber WHEN 1 THEN 'experiment' WHEN 2 THEN 'dft' WHEN 3 THEN 'database' WHEN 4 THEN 'ml' WHEN 5 THEN 'literature' WHEN 6 THEN 'llm' ELSE 'task_planning' END AS stage,
  CASE l_partkey % 20 """ + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(["FeSe", "SeFe", "Fe2Se2", "MgB2", "B2Mg", "TiO2", "O2Ti", "H3S", "SnSe2", "Se2Sn", "Bi2Te3", "WTe2", "MoS2", "NbSe2", "LaH10", "CaO2H2", "FeTe", "SnS", "ZnO", "GaN"])) + """ END AS formula,
  CASE l_linenumber % 5 WHEN 0 THEN 'tc' WHEN 1 THEN 'gap' WHEN 2 THEN 'formation' WHEN 3 THEN 'hull' ELSE 'moment' END AS property,
  CAST(l_extendedprice / 25000.0 AS DOUBLE) AS value, CAST(l_tax AS DOUBLE) AS q90, CAST(l_discount * 10 AS DOUBLE) AS applicability,
  'ev-' || CAST(l_orderkey % 3000 AS VARCHAR(20)) AS evidence_id,
  l_returnflag <> 'R' AS trusted, l_linestatus AS status, CAST(l_quantity AS BIGINT) % 3 AS structure
FROM {lineitem}"""

#: One claim a line: conditions, structure and references are spelt in several ways, as models report them.
EVIDENCE = """
SELECT (l_orderkey * 1000000 + l_partkey) * 10 + l_linenumber AS record_id,
  'Model-' || CAST(l_suppkey % 9 AS VARCHAR(20)) AS model, 'family-' || CAST(l_suppkey % 4 AS VARCHAR(20)) AS family,
  CASE WHEN l_suppkey % 3 = 0 THEN 'v' || CAST(l_suppkey % 5 AS VARCHAR(20)) END AS model_version,
  CASE l_linenumber WHEN 1 THEN 'experiment' WHEN 2 THEN 'dft' WHEN 3 THEN 'database' WHEN 4 THEN 'ml' WHEN 5 THEN 'literature' WHEN 6 THEN 'llm' ELSE 'task_planning' END AS stage,
  CASE WHEN l_linenumber = 7 THEN 'orchestrator' ELSE 'worker' END AS role,
  CASE l_partkey % 20 """ + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(["FeSe", "SeFe", "Fe2Se2", "MgB2", "B2Mg", "TiO2", "O2Ti", "H3S", "SnSe2", "Se2Sn", "Bi2Te3", "WTe2", "MoS2", "NbSe2", "LaH10", "CaO2H2", "FeTe", "SnS", "ZnO", "GaN"])) + """ END AS formula,
  CASE (l_linenumber + l_orderkey) % 5 WHEN 0 THEN 'tc' WHEN 1 THEN 'gap' WHEN 2 THEN 'formation' WHEN 3 THEN 'hull' ELSE 'moment' END AS property,
  CAST(floor(l_extendedprice / 25000.0) / 10.0 AS DOUBLE) AS value, CAST(l_tax AS DOUBLE) AS q90, CAST(l_discount * 10 AS DOUBLE) AS applicability,
  CASE WHEN l_suppkey % 6 = 5 THEN 'TBD' ELSE 'holdout' END AS validation_set,
  l_returnflag <> 'R' AS trusted, l_suppkey % 10 <> 3 AS verified, l_suppkey % 4 <> 3 OR l_partkey % 2 = 0 AS trusted_family,
  l_quantity > 5 AS structured, l_partkey % 40 = 7 AS demo, l_suppkey % 7 <> 1 AS conditions_complete, l_linestatus AS status,
  CASE CAST(l_quantity AS BIGINT) % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN 'mp-' || CAST(l_partkey % 20 AS VARCHAR(20)) WHEN 2 THEN 'COD-' || CAST(l_partkey % 20 AS VARCHAR(20)) ELSE 'x1 y' END AS structure_id,
  CASE l_suppkey % 4 WHEN 0 THEN 'PBE' WHEN 1 THEN ' pbe ' WHEN 2 THEN 'HSE06' ELSE 'n/a' END AS functional, l_suppkey % 2 = 0 AS soc,
  CASE WHEN l_partkey % 2 = 0 THEN '4' ELSE '4000' END AS hubbard_u, CASE WHEN l_partkey % 2 = 0 THEN 'eV' ELSE 'meV' END AS hubbard_unit,
  CASE WHEN l_orderkey % 2 = 0 THEN '2' ELSE '0.02' END AS strain, CASE WHEN l_orderkey % 2 = 0 THEN '%' ELSE 'fraction' END AS strain_unit,
  CASE WHEN l_partkey % 2 = 0 THEN CAST(10 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS pressure, CASE WHEN l_partkey % 2 = 0 THEN 'kbar' ELSE 'GPa' END AS pressure_unit,
  CASE WHEN l_orderkey % 2 = 0 THEN CAST(300 AS DOUBLE) ELSE CAST(26.85 AS DOUBLE) END AS temperature, CASE WHEN l_orderkey % 2 = 0 THEN 'K' ELSE 'C' END AS temperature_unit,
  'general' AS target,
  CASE WHEN l_partkey % 3 = 0 THEN 'https://doi.org/10.1000/SET.' || CAST(l_suppkey % 7 AS VARCHAR(20)) END AS doi,
  CASE WHEN l_partkey % 5 = 1 THEN 'https://Lib.Example.org/x/' || CAST(l_orderkey % 50 AS VARCHAR(20)) || '/' END AS source_ref,
  CASE WHEN l_orderkey % 11 = 0 THEN 'n/a' ELSE 'EV-' || CAST(l_orderkey % 300 AS VARCHAR(20)) END AS evidence_id,
  CASE l_suppkey % 5 WHEN 0 THEN 'No match in snapshot' WHEN 1 THEN 'known reference' WHEN 2 THEN 'unchecked' WHEN 3 THEN '' ELSE 'novel' END AS novelty_raw,
  l_partkey % 7 = 0 AS novelty_checked, CASE WHEN l_orderkey % 3 = 0 THEN '2023-05-01' WHEN l_orderkey % 3 = 1 THEN 'soon' END AS data_cutoff
FROM {lineitem}"""

#: Article pages with figure containers, captions and images in several sizes; every fifth page has images alone.
PAGES = f"""
SELECT p_partkey AS page_key, 'Study ' || CAST(p_partkey AS VARCHAR(20)) AS title, '10.1038/S' || CAST(p_partkey AS VARCHAR(20)) AS doi, p_partkey % 5 AS form,
  CASE WHEN p_partkey % 5 = 0 THEN '<p><a href="//media.springernature.com/full/x/art%3A10.1038%2Fs' || CAST(p_partkey AS VARCHAR(20)) || '/MediaObjects/1_Fig2_HTML.png">2</a><img src="https://media.springernature.com/m685/x/art%3A10.1038%2Fs' || CAST(p_partkey AS VARCHAR(20)) || '/MediaObjects/1_Fig1_HTML.jpg"> <img src="https://media.springernature.com/full/x/other/MediaObjects/1_Fig3_HTML.jpg"></p>'
  ELSE '<p>intro</p><div id="figure-1" class="c-article-section__figure js" data-test="figure"><img data-src="//media.springernature.com/full/a&amp;b/Fig1_HTML.png?as=webp"><div data-test="bottom-caption"><p>{{m}} <b>ARPES</b> map at ' || CAST(p_size AS VARCHAR(20)) || ' K</p></div></div>'
    || '<div id="figure-2" class="c-article-section__figure js" data-test="figure"><p>no image</p></div><div id="figure-3" class="x c-article-section__figure" data-test="figure"><img src="https://media.springernature.com/lw1200/c/Fig3_HTML.jpeg"></div>' END AS html
FROM {{part}}""".replace("{m}", "' || " + _MATERIAL + " || '")

SPECTRA = """
SELECT event_type AS dataset, CAST(hour(ts) AS BIGINT) AS i, CAST(day(ts) AS BIGINT) AS j, avg(value) AS value
FROM {events} GROUP BY event_type, hour(ts), day(ts)"""

BANDS = """
SELECT l_returnflag AS dataset, CAST(l_linenumber AS BIGINT) AS band, CAST(l_quantity AS DOUBLE) AS k, avg(l_extendedprice) / 1000 AS energy
FROM {lineitem} GROUP BY l_returnflag, l_linenumber, l_quantity"""

#: Landed model results, one payload a line in six shapes; names, units and forms of values vary.  '<' and '>' stand for braces.
_ALIAS = "CASE l_partkey % 19 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(a for names in ALIASES.values() for a in names)) + " END"
_NUMBER = "CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1100 AS VARCHAR(20)) || '.5'"
_UNIT = "CASE l_linenumber WHEN 1 THEN 'K' WHEN 2 THEN 'eV' WHEN 3 THEN 'meV' WHEN 4 THEN 'meV / atom' WHEN 5 THEN 'Bohr magneton' WHEN 6 THEN 'eV/atom' ELSE '' END"
PAYLOADS = f"""
SELECT record_id, translate(CASE form WHEN 0 THEN a WHEN 1 THEN '[' || a || ',null,[' || b || ']]'
  WHEN 2 THEN '<"models":[<"model":"m1","candidates":[' || a || ']>,<"name":"m2","results":[' || b || ',' || a || ']>]>'
  WHEN 3 THEN '<"model":"m3","results":[' || b || ',7]>' WHEN 4 THEN '<"candidates":[' || a || ',' || b || ']>' ELSE b END, '<>', chr(123) || chr(125)) AS payload
FROM (SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)), CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20)), CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR(20))) AS record_id, l_orderkey % 6 AS form,
  '<"formula":"x' || CAST(l_partkey AS VARCHAR(20)) || '","' || {_ALIAS} || '":' ||
    CASE l_suppkey % 3 WHEN 0 THEN '"' || {_NUMBER} || '"' WHEN 1 THEN '<"value":' || {_NUMBER} || ',"unit":"' || {_UNIT} || '">' ELSE {_NUMBER} || ',"unit":"' || {_UNIT} || '"' END || '>' AS a,
  '<"property":"' || upper({_ALIAS}) || '","value":' || {_NUMBER} || CASE WHEN l_quantity BETWEEN 1 AND 19 THEN ',"units":<"value":"' || {_UNIT} || '">' ELSE '' END ||
    CASE WHEN l_quantity BETWEEN 31 AND 99 THEN ',"properties":<"band_gap_eV":' || CAST(l_linenumber AS VARCHAR(20)) || ',"tc_K":<"mean":' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(20)) || '>>' ELSE '' END || '>' AS b
FROM {{lineitem}}) lines"""

VIEWS = {"payloads_v": PAYLOADS, "articles_v": ARTICLES, "registry_v": REGISTRY, "claims_v": CLAIMS, "evidence_v": EVIDENCE, "pages_v": PAGES, "spectra_v": SPECTRA, "bands_v": BANDS}
_TABLES = {"payloads_v": "lineitem", "articles_v": "part", "registry_v": "orders", "claims_v": "lineitem", "evidence_v": "lineitem", "pages_v": "part", "spectra_v": "events", "bands_v": "lineitem"}

#: Views whose rows take long to work on (texts to match, payloads to read).
HEAVY = {"articles_v", "pages_v", "payloads_v"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view, its rows dealt evenly: articles, pages and payloads are heavy a row, and their tables are small files."""
    source = _TABLES[name]
    rows = table(spark, sf_dir, source)
    return spark.sql(VIEWS[name], **{source: spread(rows) if name in HEAVY else rows})


def ctes(*names: str) -> str:
    """The views as WITH clauses for DuckDB, to be followed by further clauses or a SELECT."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n].replace('{' + _TABLES[n] + '}', _TABLES[n])})" for n in names)
