"""Readers, sinks and operators whose results no SQL restates, on small files and tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from matquarry.functions import text as T
from matquarry.operators import evidence, figures, graph, models, search, tasks
from matquarry.sources import readers


def test_components_and_closure(spark):
    order = random.Random(1).sample(range(10**6), 200)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(199) if i != 99], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert {got[x] for x in order[:100]} == {min(order[:100])} and {got[x] for x in order[100:]} == {min(order[100:])}
    assert graph.components(edges.limit(0)).count() == 0
    steps = spark.createDataFrame([("g", f"s{i}", f"s{i + 1}") for i in range(9)], "identity string, step string, needs string")
    assert tasks.closure(steps).groupBy("step").count().where("step = 's0'").first()["count"] == 9


def test_similar_pairs_equal_all_pairs(spark):
    r = random.Random(4)
    rows = [(i, [f"w{r.randrange(12)}" for _ in range(r.randrange(0, 9))]) for i in range(150)] + [(900, ["only"]), (901, [])]
    sets = {i: set(x) for i, x in rows}
    for least in (0.5, 0.72, 1.0):
        expected = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9}
        got = {(r.a, r.b) for r in graph.similar_pairs(spark.createDataFrame(rows, "node long, items array<string>"), least).collect()}
        assert got == expected


def test_evidence_chains_leave_one_entry(spark):
    rows = [("i", "gap", 1, 0.5, ["a"]), ("i", "gap", 2, 0.9, ["a", "b"]), ("i", "gap", 3, 0.9, ["b", "c"]), ("i", "gap", 4, 0.1, ["d"]), ("i", "tc", 5, 0.2, ["a"]), ("j", "gap", 6, 0.3, ["c"]), ("j", "gap", 7, 0.3, [])]
    df = spark.createDataFrame(rows, "identity string, property string, record_id long, weight double, evidence array<string>")
    assert {r.record_id for r in evidence.independent(df, ["identity", "property"]).collect()} == {2, 4, 5, 6, 7}


def test_conditions_and_urls(spark):
    df = spark.createDataFrame([("4", None), ("0", None), ("4000", " meV"), ("1", "Ry"), ("TBD", "eV"), ("3", "?"), (None, None), ("high", "")], "hubbard_u string, hubbard_unit string")
    got = [r.hubbard_u for r in evidence.canonical_conditions(df).collect()]
    assert got == ["error:missing unit", "0|unit:ev", "4|unit:ev", "13.605693123|unit:ev", "not provided", "error:unknown unit", "", "high"]
    urls = {"HTTPS://u:p@Ex.org:443/A/?b=2&utm_source=x&a=1#f": "https://ex.org/A?a=1&b=2", "https://ex.org/?id=1": "https://ex.org?id=1", "https://ex.org/?id=2": "https://ex.org?id=2", "URN:isbn:1": "urn:isbn:1", "S3://b/k": "s3://b/k", "word": "", None: ""}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r.c for r in df.select(T.canonical_url(F.col("u")).alias("c")).collect()] == list(urls.values())
    points = spark.range(1).select(T.labelled_points(F.lit("Γ=0, M: 1.25; K=.5e0, x, =3")).alias("p")).first().p
    assert [(p.label, p.position) for p in points] == [("Γ", 0.0), ("K", 0.5), ("M", 1.25)]


def test_band_layouts(spark, tmp_path):
    files = {"long": "# c\nband k(1/A) Energy (eV)\n1 0.0 1.5\n2 0 2D0\n1 0.1 x\n", "blocks": "0 1\n1 2\n\n\n0 3\n1 4D-1\n", "matrix": "0 1 2 3\n1 4 gap 6\n"}
    for name, text in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.dat").write_text(text if name != "long" else text.replace("# c\n", "").replace("Energy (eV)", "Energy(eV)"))
    rows = lambda df: sorted((str(r.band), r.k, r.energy) for r in df.collect())
    assert rows(readers.read_band_table(spark, str(tmp_path / "long"))) == [("1", 0.0, 1.5), ("2", 0.0, 2.0)]
    assert rows(readers.read_band_blocks(spark, str(tmp_path / "blocks"))) == [("1", 0.0, 1.0), ("1", 1.0, 2.0), ("2", 0.0, 3.0), ("2", 1.0, 0.4)]
    got = {(r.band, r.k): r.energy for r in readers.read_band_matrix(spark, str(tmp_path / "matrix")).collect()}
    assert got == {(0, 0.0): 1.0, (1, 0.0): 2.0, (2, 0.0): 3.0, (0, 1.0): 4.0, (1, 1.0): None, (2, 1.0): 6.0}


def test_index_api_json(spark, tmp_path):
    one = {"UID": "WOS:1", "title": "A", "source": {"publishYear": "2021", "sourceTitle": "J"}, "identifiers": {"doi": "https://doi.org/10.1/x"}, "names": {"authors": [{"displayName": "B, C"}, {"name": "D"}]}, "keywords": {"authorKeywords": ["k", "k2"], "keywordsPlus": ["k"]}, "citations": [{"count": 7}]}
    two = {"id": "r2", "name": "N", "DOI": "10.1/y", "publicationYear": 2019, "timesCited": "3"}
    for name, doc in (("a.json", {"hits": [one]}), ("b.json", {"metadata": {"records": [two]}}), ("c.json", {"records": [], "results": [{"title": "T"}]})):
        (tmp_path / name).write_text(json.dumps(doc))
    got = {r.title: r for r in readers.read_index_api_json(spark, str(tmp_path)).collect()}
    assert (got["A"].id, got["A"].year, got["A"].doi, got["A"].authors, got["A"].keywords, got["A"].citations) == ("WOS:1", 2021, "10.1/x", "B, C; D", ["k", "k2"], 7)
    assert (got["N"].id, got["N"].doi, got["N"].year, got["N"].citations) == ("r2", "10.1/y", 2019, 3)
    assert got["T"].id == "c.json-0"


def test_sinks_and_dimensions(spark, tmp_path):
    articles = spark.createDataFrame([(f"a{i}", i, "s") for i in range(9)], "id string, year int, source string")
    stats = readers.write_library(articles, str(tmp_path / "lib"), [F.desc("year"), F.asc("id")], 4).first()
    assert (stats.written, stats.first_year, stats.last_year, stats.candidates) == (4, 5, 8, 9)
    samples = spark.createDataFrame([("x", "FeSe", [0.123456, 1.0], "t")], readers.SAMPLE)
    readers.write_samples(samples, str(tmp_path / "samples"))
    assert readers.read_samples(spark, str(tmp_path / "samples"), 2)[0].first().features == [0.1235, 1.0]
    (tmp_path / "e.json").write_text(json.dumps([{"symbol": "Fe", "name": "Iron", "number": 26}, {"symbol": "Fe"}, {"name": "none"}]))
    assert readers.read_dimension(spark, "elements", str(tmp_path / "e.json")).count() == 1


def test_terms_beyond_a_block_are_kept(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 3)
    monkeypatch.setattr(search, "_blocks", lambda stated, block=3, own=search._blocks: own(stated, block))
    queries = spark.createDataFrame([(i, f"word{i} other") for i in range(20)], "qid long, query string")
    articles = spark.createDataFrame([(i, f"Word{i}") for i in range(20)], "seq long, title string")
    got = {(r.qid, r.seq) for r in search.search_articles(articles, queries, "seq").collect()}
    assert {(i, i) for i in range(20)} <= got


def test_figures_of_odd_pages(spark):
    box = '<div id="figure-{n}" class="c-article-section__figure" data-test="figure">{body}</div>'
    html = "".join(box.format(n=i, body=f'<img src="x/Fig{i}_HTML.png">') for i in range(1, 11))
    pages = spark.createDataFrame([(1, html, "10.1/a", "T"), (2, None, None, None), (3, "<p>", "10.1/b", "U")], "k int, html string, doi string, title string")
    got = figures.extract_figures(pages, "k").collect()
    assert sorted(r.figure_index for r in got) == list(range(1, 9)) and {r.k for r in got} == {1}


def test_remainders(spark):
    sources = spark.createDataFrame([("g", i) for i in range(4)] + [("h", 9)], "identity string, record_id long")
    one = tasks.remainder_lineage(sources, sources.where("record_id < 2")).collect()
    assert [r.identity for r in one] == ["g"] and one[0].lineage.startswith("g|remainder:")
    assert tasks.remainder_lineage(sources, sources).count() == 0


def test_training_rows_split_by_composition(spark):
    rows = [(f, p, v) for f, v in (("FeSe", 1.0), ("SeFe", 3.0), ("Fe2Se2", 8.0), ("TiO2", 0.01), ("MgB2", 500.0)) for p in ("gap", "formation")]
    got = {r.key: r for r in models.training_rows(spark.createDataFrame(rows, "formula string, property string, value double")).collect()}
    assert got["Fe1 Se1"].gap == pytest.approx(3.0) and got["B2 Mg1"].gap is None and got["B2 Mg1"].formation == 500.0
    assert len(got) == 3 and len(got["O2 Ti1"].fractions) == 118 and sum(got["O2 Ti1"].fractions) == pytest.approx(1)
    model = models.fit_regressor(models.training_rows(spark.createDataFrame([(f"Fe{i}Se{j}", "tc", float(i * j)) for i in range(1, 12) for j in range(1, 12)], "formula string, property string, value double")), "tc", trees=5)
    assert model.getNumTrees == 5
