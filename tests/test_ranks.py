"""Exact quantiles and ranks of many keys against percentile and plain counts."""

import random

from pyspark.sql import functions as F

from matquarry.operators import ranks


def test_quantiles_equal_percentiles(spark):
    r = random.Random(2)
    rows = [("hot", round(r.gauss(0, 1), 2)) for _ in range(6000)] + [(f"k{r.randrange(40)}", r.random()) for _ in range(1000)]
    rows += [("one", 5.0), ("none", None), (None, 1.0), ("two", 1.0), ("two", 2.0), ("k1", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p99": 0.996, "p100": 1.0}
    got = {x.k: x for x in ranks.quantiles(df, ["k"], "v", shares).collect()}
    expected = df.where("k IS NOT NULL AND v IS NOT NULL").groupBy("k").agg(*(F.percentile("v", p).alias(n) for n, p in shares.items())).collect()
    assert len(got) == len(expected)
    for x in expected:
        for n in shares:
            a, b = got[x.k][n], x[n]
            assert (a != a and b != b) or abs(a - b) < 1e-12
    counts = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    values = sorted(v for k, v in rows if k == "hot")
    for x in ranks.running(counts, ["k"], "v").where("k = 'hot'").collect():
        assert x.below == sum(v < x.v for v in values)
