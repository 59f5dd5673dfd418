"""Figures that must grow no faster than the input: tasks of heavy scans, steps worked out once, rows and bytes that travel."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from matquarry.functions import text as T
from matquarry.llm import neardup, shared
from matquarry.operators import graph, library, models, payloads, tasks
from matquarry.plans.adapters import view

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_numbers_are_read_once(spark):
    """the branches of a share don't match and cast its text again; results stay."""
    values = ["80%", " 7.5 % ", "0.3", "1", "1.5", "100", "101", "120%", "-1", "x%", "%", "", None, "5e-1", ".5", "1e400", "50%%"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")
    got = df.select("id", T.bounded01(F.col("v")).alias("share"))
    assert plan(got).count("RLIKE") == 1
    expected = [0.8, 0.075, 0.3, 1.0, 0.015, 1.0, None, None, None, None, None, None, None, 0.5, 0.5, None, None]
    assert [r.share for r in got.orderBy("id").collect()] == [e if e is None else pytest.approx(e) for e in expected]
    assert plan(df.select(T.fortran_number(F.col("v")).alias("x"))).count("regexp_replace") == 1


@pytest.mark.parametrize("name", ["articles_v", "pages_v", "payloads_v"])
def test_heavy_views_are_dealt_out(spark, name):
    """a table of one small file is worked on by all cores."""
    assert view(spark, DATA, name).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_words_of_a_row_stay_in_their_task(spark):
    """F16: an index of words is built without a shuffle, null and blank texts included."""
    rows = [(1, "b a  b\tc\nb"), (2, None), (3, " \n"), (4, "x"), (4, "y x y")] + [(i, f"w{i} v w{i % 7}") for i in range(5, 600)]
    df = spark.createDataFrame(rows, "id long, t string")
    index = library.inverted(df, "id", "t")
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    assert index.where("id = 1").collect()[0].words == {"b": [0, 2, 4], "a": [1], "c": [3]}
    assert sorted((r.id, r.out) for r in library.from_inverted(index, "id", "out").collect()) == sorted((i, " ".join((t or "").split())) for i, t in rows)


def test_progress_of_needed_tasks_alone_travels(spark, monkeypatch):
    """dependencies are followed among needed tasks only; the answers are those of all pairs."""
    r = random.Random(5)
    rows = []
    for i in range(400):
        place = r.randrange(8)
        before = [x[0] for x in rows if tasks.STEPS.index(x[2]) <= place and x[6] == i % 10]
        rows.append((f"t{i:03d}", f"k{i % 10}~{tasks.STEPS[place]}", tasks.STEPS[place], r.randrange(3), r.choice([0, 0, 1, 2]), r.sample(before, min(len(before), r.choice([0, 1, 2]))) * r.choice([1, 2]), i % 10))
    df = spark.createDataFrame(rows, "task_id string, logical_key string, step string, claims long, verified long, depends_on array<string>, part int").drop("part")
    edges = df.select(F.col("task_id").alias("a"), F.explode("depends_on").alias("b"))
    want = tasks.authoritative(df.join(tasks.progress_vectors(df, graph.closure(edges)), "task_id"))
    followed, closure = [], graph.closure
    monkeypatch.setattr(tasks.graph, "closure", lambda e: followed.append({x.a for x in e.collect()}) or closure(e))
    assert sorted(map(repr, tasks.authoritative_tasks(df).collect())) == sorted(map(repr, want.collect()))
    assert followed and followed[0] <= {n for x in rows for n in x[5]}


def test_tokens_of_one_text_make_no_rows(spark, monkeypatch):
    """op6_minhash, pipeline: tokens are added up by blocks; only those of several texts become rows, with right counts."""
    r = random.Random(2)
    sets = [(i, sorted({*r.sample(range(-40, 40), 9), *(r.randrange(-(2**31), 2**31) for _ in range(90))})) for i in range(300)]
    df = spark.createDataFrame([(i, struct.pack(f"{len(x)}i", *x)) for i, x in sets] + [(900, b"")], "node long, set binary").repartition(7)
    held = df.where("node % 3 > 0 OR node = 900").select("node")
    often: dict[int, list[int]] = {}
    for _, x in (x for x in sets if x[0] % 3):
        for t in x:
            often.setdefault(t, []).append(len(x))
    for size in (1000, 10**9):
        monkeypatch.setattr(neardup, "RANGE", size)
        got = neardup.token_counts(held, df, 2).collect()
        assert sorted((x.token, x.often, x.least) for x in got) == sorted((t, len(n), min(n)) for t, n in often.items() if len(n) > 1)
    assert neardup.token_counts(held.where("node = 900"), df, 2).count() == 0


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_heavy_keys_are_told_apart_without_a_join(spark, kind):
    """op6_minhash: only the join asked for makes rows, and heavy keys, lone keys and nulls match as in a plain join."""
    key = F.when(F.col("id") < 3000, F.lit(7)).when(F.col("id") < 5500, F.lit(8)).when(F.col("id") < 5600, F.lit(None)).otherwise(F.col("id"))
    big = shared.cut(spark.range(6000).select(key.cast("string").cast("binary").alias("k") if kind == "binary" else key.alias("k"), F.col("id").alias("x")))
    table = shared.cut(big.where("k is not null and x % 2 = 0").groupBy("k").agg(F.min("x").alias("least")))
    for how in ("inner", "left"):
        got = shared.spread_join(big, table, "k", how)
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
        assert got._jdf.queryExecution().optimizedPlan().toString().count("__part") > 0
        want = big.join(table, "k", how)
        assert got.columns == want.columns
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    light = shared.spread_join(big.where("x >= 5500"), table, "k")
    assert "__part" not in light._jdf.queryExecution().analyzed().toString()
    assert light.count() == 200


def test_payloads_are_judged_without_interpreted_functions(spark):
    """properties aren't read by functions on arrays, and a candidate once found is passed on unread; odd values keep their results."""
    rows = ['{"tc": 5, "unit": "K"}', '[{"band_gap": "250", "band_gap_unit": "m eV"}, 3, null]', '"s"', None, '{"models": [{"results": [{"Tc": 1.50}, {"tc": [1]}]}]}']
    df = spark.createDataFrame(list(enumerate(rows)), "i int, j string").select("i", F.parse_json("j").alias("payload"))
    found = payloads.candidates(df)
    judged = payloads.canonical_properties(found)
    added = plan(judged).count("lambdafunction") - plan(found).count("lambdafunction")
    assert added == 0
    assert plan(found).count("CASE WHEN found#") == 7
    got = {(r.i, tuple(r.path)): (r.error, [tuple(p) for p in r.properties]) for r in judged.collect()}
    assert got == {(0, ()): (None, [("tc", 5.0)]), (1, (0,)): (None, [("gap", 0.25)]), (4, (0, 0)): (None, [("tc", 1.5)]), (4, (0, 1)): ("INVALID_PROPERTY_VALUE", [])}
    assert [r.properties for r in payloads.canonical_properties(df.where("i >= 2 and i <= 3").withColumnRenamed("payload", "candidate")).collect()] == [[], []]


def test_training_takes_few_tasks(spark, monkeypatch):
    """few rows are fitted in one task however they are stored."""
    seen = []
    monkeypatch.setattr(models.GBTRegressor, "fit", lambda self, rows: seen.append((rows.rdd.getNumPartitions(), [r.y for r in rows.collect()])))
    rows = spark.range(300).select(F.concat(F.lit("k"), "id").alias("key"), F.array_repeat(F.lit(0.0), 118).alias("fractions"), *[F.lit(0.5).alias(c) for c in models.FEATURES], F.lit("train").alias("split"), F.col("id").cast("double").alias("formation"))
    for stored in (rows.repartition(1), rows.repartition(9)):
        models.fit_regressor(stored, "formation")
    assert [n for n, _ in seen] == [1, 1]
    assert seen[0] == seen[1]
