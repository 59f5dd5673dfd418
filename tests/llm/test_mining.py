"""Periodic runs, nearest neighbours and hard negatives against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from matquarry.llm import hardneg, neighbours, periodic, queries, textkit


def runs_of(w):
    """Every run (start, length, period) by trying each lag."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
            i = max(i, start + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def repetitive(r):
    if r.random() < 0.3:
        return [r.choice("ab") for _ in range(r.randrange(300))]
    w = [r.choice("abcdefgh") for _ in range(r.randrange(40))]
    for _ in range(r.randrange(4)):
        p = [r.choice("abcdefghijk") for _ in range(r.randrange(1, 90))]
        w += (p * 8)[: r.randrange(1, len(p) * 8)] + [r.choice("abc") for _ in range(r.randrange(3))]
    return w


@pytest.mark.parametrize("exact", [False, True])
def test_runs_are_all_found(exact):
    r = random.Random(3)
    for _ in range(15):
        texts = [repetitive(r) for _ in range(30)]
        raw, off = textkit.flat([" ".join(t).encode() for t in texts])
        start, end, first = textkit.spans(raw, off, textkit.BY_SPACE)
        got = periodic.find(textkit.hashes(raw, start, end), first, exact)
        assert [[tuple(x) for x in g.tolist()] for g in got] == [runs_of(t) for t in texts]


def test_runs_of_one_long_text():
    r = random.Random(4)
    period = [f"w{r.randrange(3000)}" for _ in range(5000)]
    words = [f"a{i}" for i in range(1000)] + (period * 5)[:23000] + [f"b{i}" for i in range(500)]
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    got = periodic.find(textkit.mix(np.array([ids[w] for w in words], np.uint64)), np.array([0, len(words)]))
    assert got[0].tolist() == [[1000, 23000, 5000]]


def test_wrong_runs_are_found_again():
    words = [b"a", b"b"] * 3 + [b"c", b"b"] * 3
    assert periodic._checked(words, np.array([[0, 12, 2]])).tolist() == []


def plain_report(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_of(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(kept))


def test_report_of_runs(spark):
    r = random.Random(8)
    texts = [None, "", " \n\t ", "é é\x0bé é é\x0c é", "x x x x x x x x x"] + [" ".join(repetitive(r)) for _ in range(150)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(7, texts[7], "clash", 2), (None, "a a a a a a", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repeats string, n_words int").repartition(3)
    got = sorted(periodic.report(docs).collect(), key=str)
    assert [tuple(x) for x in got] == [tuple(x) for x in sorted(got, key=str)]
    assert sorted(map(str, (tuple(x) for x in got))) == sorted(str(plain_report(i, t)) for i, t, *_ in rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and x for i, x, *_ in rows if i is not None)
    assert periodic.report(docs.limit(0)).count() == 0
    kept = periodic.detect(docs, into="repeats")
    assert kept.columns == ["doc_id", "text", "n_words", "repeats"] and kept.count() == len(rows)


def test_report_of_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r in rows:
        if len((r.text or "").split()) < 2500:
            assert got[r.doc_id] == plain_report(r.doc_id, r.text)


def nearest(ids, x, queries_, k):
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for q in queries_:
        at = ids.tolist().index(q)
        s = (x * x[at]).sum(1) / norm / norm[at]
        order = [j for j in np.lexsort((ids, -s)) if j != at][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_nearest_reach_the_recall(spark):
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), np.float64)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    truth = nearest(ids, x, ids[ids % 50 == 0].tolist(), 5)
    got = {}
    for r in neighbours.search(rows, rows.where("vec_id % 50 = 0"), 5, shard_rows=300).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == truth.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in truth[q]}) for q in truth)
    assert hits / (5 * len(truth)) >= 0.97
    scores = {(q, a): s for q, v in truth.items() for a, s in v}
    assert all(abs(s - scores[q, a]) < 1e-12 for q, v in got.items() for a, s in v if (q, a) in scores)


def test_codes_within_a_radius_are_all_met():
    x = np.random.default_rng(1).standard_normal((700, 24))
    shard = neighbours.Shard(np.arange(700), x, neighbours.rotations(x, 128))
    code = shard.parts[5]
    differ = np.bitwise_count(shard.parts ^ code).sum(1)
    for radius in (0, 3, 7, 8, 20, 45, 60, 128):
        assert shard.within(code, radius).tolist() == np.flatnonzero(differ <= radius).tolist()


def test_nearest_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [1.0, float(i), 0.5]) for i in range(50)]
    rows = good + [(60, good[3][1]), (61, [2 * v for v in good[3][1]]), (62, [0.0, 0.0, 0.0]), (63, None), (64, [1.0, None, 0.0]), (65, [1.0, nan, 0.0])]
    rows += [(66, [inf, 1.0, 0.0]), (67, []), (None, [1.0, 1.0, 1.0]), (4, good[4][1]), (5, [9.0, 9.0, 9.0]), (68, [1.0, 2.0]), (69, [2.0**1000, 3 * 2.0**1000, 2.0**999])]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<double>, shard string, asks int").repartition(3)
    got = {}
    for r in neighbours.search(df, df.where("vec_id in (0, 3, 60, 62, 63, 68)"), 5, shard_rows=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    known = {**dict(good), 60: good[3][1], 61: rows[51][1], 69: [1.0, 3.0, 0.5]}
    truth = nearest(np.array(list(known)), np.array(list(known.values())), [0, 3, 60], 5)
    assert got.keys() == truth.keys()
    for q in truth:
        assert [a for a, _ in got[q]] == [a for a, _ in truth[q]] and np.allclose([s for _, s in got[q]], [s for _, s in truth[q]])
    assert neighbours.search(df.limit(0), df, 5).count() == 0 and neighbours.search(df, df.limit(0), 5).count() == 0


def negatives(rows, positives=5, count=10):
    """rows: id -> (label, whole numbers)."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a in rows:
        if a % 100:
            continue
        score = sorted(((-dot(rows[a][1], v), i) for i, (_, v) in rows.items() if i != a))
        for s, p in [(-s, i) for s, i in score if rows[i][0] == rows[a][0]][:positives]:
            fit = [(-n, i) for n, i in score if rows[i][0] != rows[a][0] and 30 * s <= -100 * n <= 90 * s][:count]
            out += [(a, p, k + 1, i, s, n) for k, (n, i) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0, 30])
def test_hard_negatives(spark, spread):
    r = random.Random(spread)
    middle = [[r.randrange(-60, 60) for _ in range(8)] for _ in range(6)]
    rows = {}
    for i in range(1500):
        c = r.choice(middle) if spread else [r.randrange(-3, 3) for _ in range(8)]
        rows[i] = (r.randrange(4), [v + r.randrange(-spread // 5 - 1, spread // 5 + 1) for v in c])
    table = [(i, lab, v, "clash") for i, (lab, v) in rows.items()]
    table += [(2000, None, [1] * 8, ""), (2100, 1, None, ""), (2200, 1, [1, None] * 4, ""), (None, 1, [1] * 8, ""), (7, *rows[7], "again"), (2300, 3, [50, 20], "")]
    df = spark.createDataFrame(table, "vec_id long, label int, vec array<long>, tree string").repartition(4)
    got = hardneg.mine(df, F.col("vec_id") % 100 == 0, shard_rows=200)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(x) for x in got.collect()) == negatives(rows | {2300: (3, [50, 20] + [0] * 6)})
    assert hardneg.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_subtrees_are_left_out_only_if_empty():
    r = np.random.default_rng(2)
    x = np.rint(np.repeat(r.standard_normal((30, 6)) * 500, 40, 0) + r.standard_normal((1200, 6)) * 5)
    tree = hardneg.Tree(np.arange(1200), r.integers(0, 3, 1200), x)
    asked = []
    leaf, tree_search = hardneg.Node.may_hold, tree.search

    def counted(self, *a):
        out = leaf(self, *a)
        asked.append((len(out), int(out.sum())))
        return out

    hardneg.Node.may_hold = counted
    try:
        n = 40
        lo = (x[:n] ** 2).sum(1) * 0.97
        ids, score = tree_search(x[:n], np.arange(n), np.arange(n), np.zeros(n, np.int64), lo, np.full(n, np.inf), 5, True)
    finally:
        hardneg.Node.may_hold = leaf
    for i in range(n):
        s = x @ x[i]
        fit = [(-s[j], j) for j in range(1200) if j != i and tree.labels[j] == 0 and s[j] >= lo[i]]
        expected = sorted(fit)[:5]
        assert [(-a, b) for a, b in zip(score[i], ids[i]) if a > -np.inf] == expected
    assert sum(kept for _, kept in asked) < 0.6 * sum(all_ for all_, _ in asked)


def test_whole_table_of_hard_negatives(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    whole = {r.vec_id: ((r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256 * float(v))) for v in r.embedding]) for r in rows}
    assert sorted(tuple(x) for x in queries.op13_hard_negatives(spark, "/root/testdata/sf0.001").collect()) == negatives(whole)
