"""Components of similar sets against all pairs, and their work on a large group of near copies."""

import random

from pyspark.sql import functions as F

from matquarry.operators import graph


def plain(sets, least):
    label = {n: n for n in sets}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    linked, nodes = set(), sorted(sets)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            x, y = set(sets[a]), set(sets[b])
            if x and y and len(x & y) >= least * len(x | y) - 1e-9:
                linked |= {a, b}
                ra, rb = sorted((root(a), root(b)))
                label[rb] = ra
    return {n: root(n) for n in linked}


def test_components_of_similar_sets(spark):
    r = random.Random(6)
    base = [[f"w{r.randrange(80)}" for _ in range(r.randrange(4, 14))] for _ in range(8)]
    sets = {}
    for i in range(220):
        s = list(r.choice(base))
        for _ in range(r.randrange(4)):
            s[r.randrange(len(s))] = f"w{r.randrange(80)}"
        sets[i] = s + s[: r.randrange(2)]
    sets |= {300: [], 301: ["lonely"], 302: base[0], 303: base[0]}
    df = spark.createDataFrame(list(sets.items()), "node long, items array<string>").repartition(3)
    for least in (0.6, 0.78):
        got = {x.node: x.component for x in graph.similar_components(df, least).collect()}
        assert got == plain(sets, least)
    assert graph.similar_components(df.limit(0), 0.7).count() == 0


def test_near_copies_are_not_paired(spark):
    """10,000 sentences that differ in one word: as many comparisons as members and shared items, not their square."""
    n, compared = 10_000, []
    common = [F.lit(f"c{i}") for i in range(12)]
    df = spark.range(n).select(F.col("id").alias("node"), F.array(*common, F.concat(F.lit("own"), F.col("id") % 5000)).alias("items"))
    similar = graph._similar
    graph._similar = lambda pairs, *a: compared.append(pairs.count()) or similar(pairs, *a)
    try:
        got = graph.similar_components(df, 0.72).agg(F.count("*").alias("n"), F.countDistinct("component").alias("classes")).first()
    finally:
        graph._similar = similar
    assert (got.n, got.classes) == (n, 1) and sum(compared) <= 5 * n
