"""Queries against their SQL on tables that the small fixtures lack: long orders, many claims, other spellings."""

import math
import random
import time

import duckdb
from pyspark.sql import functions as F

from matquarry.catalog import ORACLE_SQL, QUERIES
from matquarry.llm import urlfilter
from matquarry.operators import evidence, knn, tasks

DATA = "/root/testdata/sf0.001"


def same_as_sql(spark, folder, name, **tables):
    """Whether the query on ``tables`` (the rest as given) has the rows of its SQL."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    rows = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    return sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in got.collect())


def test_claims_of_very_many_tasks_are_covered(spark):
    """tasks share Python calls, so 30,000 tasks take seconds; claims and returns of one task lie over batches."""
    rows = spark.range(60_000).select((F.col("id") % 30_000).alias("task_id"), F.array(F.struct(F.lit("p").alias("p"), (F.col("id") % 7).cast("double").alias("v"))).alias("properties"))
    start = time.monotonic()
    got = tasks.cover_claims(rows, rows.where("task_id % 3 > 0")).groupBy("covered").count().collect()
    assert [(r.covered, r["count"]) for r in got] == [(True, 20_000)] and time.monotonic() - start < 20
    one = spark.range(25_000).select(F.lit("t").alias("task_id"), F.create_map(F.lit("p"), F.col("id").cast("double")).alias("properties"))
    assert [r.covered for r in tasks.cover_claims(one, one).collect()] == [True]
    assert [r.covered for r in tasks.cover_claims(one.where("properties['p'] <> 24999"), one).collect()] == [False]


def test_orders_of_many_lines(spark, tmp_path):
    """the query's SQL has no upper bound on the lines of an order."""
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").withColumn("l_orderkey", F.floor(F.col("l_orderkey") / 40))
    assert same_as_sql(spark, tmp_path, "chm_10_validate", lineitem=lines)


def test_content_keeps_unresolved_spellings(spark, tmp_path):
    """records that differ in the spelling of an unresolved structure alone are two contents."""
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_linenumber < 7").limit(200)
    lines = lines.withColumn("l_quantity", F.lit(20).cast(dict(lines.dtypes)["l_quantity"]))
    again = lines.withColumns({"l_quantity": (F.col("l_quantity") + 3).cast(dict(lines.dtypes)["l_quantity"]), "l_orderkey": F.col("l_orderkey") + 2 * 3 * 11 * 300 * 50 * 3000})
    assert same_as_sql(spark, tmp_path, "con_01_dedupe_records", lineitem=lines.unionByName(again))


def test_nearest_by_blocks(spark, monkeypatch):
    """blocks, ties, zero vectors, null components and other lengths, against all pairs; numbers of pairs that the
    interpreted products would not get through in the time."""
    r = random.Random(8)
    rows = [(i, [float(r.randrange(-2, 3)) for _ in range(6)], i % 4) for i in range(400)]
    rows += [(500 + i, rows[7][1], None) for i in range(30)] + [(600, [0.0] * 6, 1), (601, None, 1), (602, [1.0, None] + [2.0] * 4, 2), (603, [1.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)

    def cosine(a, b):
        if None in a or None in b or not any(a) or not any(b):
            return -1.0
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    monkeypatch.setattr(knn, "BLOCK", 9)
    monkeypatch.setattr(knn, "SAMPLES", 50)
    asked = [x for x in rows if x[0] % 20 == 0 and x[1]]
    expected = {(i, rank + 1, j) for i, a, _ in asked for rank, (_, j) in enumerate(sorted((-cosine(a, b), j) for j, b, _ in rows if b and j != i and len(a) == len(b))[:5])}
    got = knn.cosine_topk(df.where("vec_id % 20 = 0"), df, 5)
    assert {(x.qid, x["rank"], x.vec_id) for x in got.collect()} == expected
    monkeypatch.undo()
    start = time.monotonic()
    many = spark.range(30_000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.col("id") * i).cast("float")).alias("embedding"), F.lit(0).alias("label"))
    assert knn.cosine_topk(many.where("vec_id % 30 = 0"), many, 9).count() == 9000 and time.monotonic() - start < 25


def test_threshold_of_all_urls(spark):
    """every held URL counts, also beyond 20,000."""
    r = random.Random(3)
    rows = [(round(r.gauss(0.2 * y, 1), 3), bool(y)) for y in (r.randrange(2) for _ in range(30_000))]
    values, good = sorted({d for d, _ in rows}), sum(y for _, y in rows)
    below = dict.fromkeys(values, (0, 0))
    g = b = 0
    for d, y in sorted(rows):
        if below[d] == (0, 0):
            below[d] = (g, b)
        g, b = g + y, b + (not y)
    right = [below[d][1] / (len(rows) - good) + (good - below[d][0]) / good for d in values]
    at = right.index(max(right))
    got = urlfilter.threshold_of(spark.createDataFrame(rows, "difference double, accepted boolean").repartition(4))
    assert abs(got - (values[at - 1] + values[at]) / 2) < 1e-12
    assert urlfilter.threshold_of(spark.createDataFrame([(1.0, True)], "difference double, accepted boolean")) == 0.0


def test_references_are_worked_out_once(spark, monkeypatch):
    """names of references come from distinct ones; nulls are values like others."""
    rows = [(i, None if i % 3 else "https://doi.org/10.1000/A", None if i % 4 == 1 else f"http://X.org/{i % 2}/") for i in range(60)]
    df, worked = spark.createDataFrame(rows, "id long, doi string, source_ref string"), []
    per_value = evidence.per_value
    monkeypatch.setattr(evidence, "per_value", lambda d, columns, f: per_value(d, columns, lambda v: worked.append(v.count()) or f(v)))
    got = {r.id: (r["__doi"], r["__ref_url"]) for r in evidence.with_references(df).collect()}
    assert got == {i: (d and "doi:10.1000/a", s and f"url:http://x.org/{i % 2}") for i, d, s in rows} and worked == [2, 3]
