"""Readers on tiny files that the tests write."""

import json

from matquarry.sources import readers
from matquarry.streaming import streams


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    put("texts/a.txt", "one\ntwo")
    put("texts/b.pdf", "no")
    assert [r.text for r in readers.read_article_texts(spark, str(tmp_path / "texts")).collect()] == ["one\ntwo"]
    assert readers.read_index_export(spark, put("x.csv", "Article Title;DOI\nA;10.1/x\n")).columns == ["article_title", "doi"]
    assert readers.read_tagged(spark, put("t.txt", "TI\tDI\nA\t1\n\t2\n")).count() == 1
    bib = readers.read_bibtex(spark, put("b.bib", "@article{k1,\n title = {A {B} \\& C},\n year = {2020}\n}\n")).first()
    assert (bib.key, bib.fields) == ("k1", {"title": "A B & C", "year": "2020"})
    work = {"id": "w", "display_name": "T", "publication_year": 2020, "authorships": [{"author": {"display_name": "X"}}], "abstract_inverted_index": {"a": [0]}}
    assert readers.read_works_json(spark, put("w.json", json.dumps(work))).first().authors == ["X"]
    atom = '<feed><entry><id>1</id><title> T </title><summary>s</summary><published>2021-01-01</published><author><name>N</name></author><link href="u" title="pdf"/></entry></feed>'
    got = readers.read_atom(spark, put("f.xml", atom)).first()
    assert (got.title, got.year, got.authors, got.pdf) == ("T", 2021, ["N"], "u")
    good, bad = readers.read_samples(spark, put("s.json", json.dumps({"id": "1", "material": "X", "features": [0.12345] * 20}) + "\n" + json.dumps({"id": "2"})))
    assert good.first().features[0] == 0.1235
    assert bad.first().error_code == "no_material"
    model = readers.read_model_results(spark, put("m.json", json.dumps({"name": "m", "results": [{"formula": "FeSe", "property": "tc", "value": "8"}]}))).first()
    assert (model.model, model.value) == ("m", 8.0)
    bands = readers.read_band_matrix(spark, put("bands.dat", "# k e\n0.0 1.0D0 nan\n1.0 2.0 x\n"))
    assert bands.where("band = 0").count() == 2
    assert bands.where("band = 1 and (energy is null or isnan(energy))").count() == 2


def test_bursts(spark):
    rows = [(1, k, f"2024-01-01 00:00:{k:02d}") for k in (0, 10, 20, 59)] + [(1, 60, "2024-01-01 00:01:00"), (2, 1, "2024-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "user_id long, event_id long, at string").selectExpr("user_id", "event_id", "cast(at as timestamp) as ts")
    got = {(r.key, r.event_id): (r.nth, r.burst) for r in streams.flag_bursts(events, "user_id", "ts", 60, 2).collect()}
    assert got[1, 20] == (3, True)
    assert got[1, 60] == (1, False)
    assert got[2, 1] == (1, False)


def test_streamed_bursts_run_over_batches(spark, tmp_path):
    rows = [(1, k, f"2024-01-01 00:00:{k:02d}") for k in (0, 10, 20, 59)] + [(1, 60, "2024-01-01 00:01:00"), (2, 1, "2024-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "user_id long, event_id long, at string").selectExpr("user_id", "event_id", "cast(at as timestamp) as ts")
    for i, part in enumerate(("event_id <= 10", "event_id > 10")):
        events.where(part).coalesce(1).write.parquet(str(tmp_path / "in" / f"batch={i}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = streams.stream_bursts(stream, "user_id", "ts", 60, 2).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.key, r.event_id): (r.nth, r.burst) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.key, r.event_id): (r.nth, r.burst) for r in streams.flag_bursts(events, "user_id", "ts", 60, 2).collect()}
