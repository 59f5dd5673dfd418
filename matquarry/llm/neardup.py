"""Near-duplicate classes by DartMinHash signatures and banded joining.

A text is a weighted set: its word shingles (five words) weighted by how often they occur.  Darts are thrown
by hashing: each region (shingle, range of weight, range of rank) holds a Poisson number of darts at hashed
places, the same for every text.  A text accepts the darts below its weights, and each of the K coordinates
keeps the accepted dart of the smallest rank.  Two texts agree on a coordinate with a probability of their
weighted Jaccard similarity.  Few darts lie in the small ranks that a long text needs, which makes it fast.

Texts that agree on a whole band of coordinates are candidates; pairs are verified on the exact weighted
Jaccard similarity.  Classes are the connected components of the links between candidates.  Pairs that are in
one class already need no check, so a group of n copies costs about n pairs and not n * n.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared, textkit

WORDS, SIMILARITY = 5, 0.8
#: Coordinates of a signature: BANDS bands of ROWS.  A pair of similarity 0.8 shares a band with 0.9998.
BANDS, ROWS = 21, 5
#: Ranks below this form the first region; each further region doubles the rank.
BASE = 1 / 16
#: Buckets of up to so many texts compare all texts of different classes; larger ones are joined on shingles.  Both
#: ways are exact, so this only chooses the cheaper one.
SMALL = 32
#: Tokens that a task counts before it sends them on, and tokens that are sent to all tasks (4 bytes each); more of these are
#: joined.
COUNTED, SOUGHT = 4_000_000, 1_000_000
#: Tokens of a range that are added up together.
RANGE = 65_536
_U = 2.0**-64


def _poisson_table(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... darts."""
    p, total, out = math.exp(-mean), 0.0, []
    for k in range(int(mean + 12 * math.sqrt(mean) + 20)):
        total += p
        out.append(total)
        p *= mean / (k + 1)
    return np.array(out)


_tables: dict[float, np.ndarray] = {}


def _region(element: np.ndarray, weight_cell: int, rank_cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Darts of one region for many elements: (which element, weight, rank, identity)."""
    w0, w1 = (0.0, 1.0) if weight_cell == 0 else (2.0 ** (weight_cell - 1), 2.0**weight_cell)
    r0, r1 = (0.0, BASE) if rank_cell == 0 else (BASE * 2.0 ** (rank_cell - 1), BASE * 2.0**rank_cell)
    mean = (w1 - w0) * (r1 - r0)
    # Large regions are cut into equal parts, so that the tables stay short.
    parts = max(1, int(mean // 32))
    table = _tables.setdefault(mean / parts, _poisson_table(mean / parts))
    out = []
    with np.errstate(over="ignore"):
        for part in range(parts):
            seed = np.uint64((weight_cell * 1009 + rank_cell * 1_000_003 + part * 7_919 + 17) * 0x9E3779B97F4A7C15 & 2**64 - 1)
            h = textkit.mix(element ^ seed)
            n = np.searchsorted(table, h * _U, "right")
            owner = np.repeat(np.arange(len(element)), n)
            if not len(owner):
                continue
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            dart = textkit.mix(h[owner] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
            low = w0 + (w1 - w0) * (part + (dart >> np.uint64(32)).astype(np.float64) * 2.0**-32) / parts
            rank = r0 + (r1 - r0) * (dart & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
            out.append((owner, low, rank, dart))
    if not out:
        z = np.zeros(0)
        return z.astype(np.int64), z, z, z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n, k) of n weighted sets given as triples; sets without elements are all 0."""
    best = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)  # rank above, identity below
    total = np.bincount(owner, weight, n)
    need = np.log2(np.maximum(1.0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300) / BASE))
    reach = np.where(total > 0, np.ceil(need), -1).astype(np.int64)  # the last rank cell to throw
    thrown = np.full(n, -1, np.int64)
    active = np.flatnonzero(total > 0)
    while len(active):
        top = int(reach[active].max())
        for rank_cell in range(int(thrown[active].min()) + 1, top + 1):
            wanted = np.zeros(n, bool)
            wanted[active] = (reach[active] >= rank_cell) & (thrown[active] < rank_cell)
            some = np.flatnonzero(wanted[owner])
            weight_cell = 0
            while len(some):
                which, low, rank, dart = _region(element[some], weight_cell, rank_cell)
                hit = low < weight[some[which]]
                at, rank, dart = some[which[hit]], rank[hit], dart[hit]
                coordinate = (textkit.mix(dart + np.uint64(5)) % np.uint64(k)).astype(np.int64)
                # Ranks as ordered 32-bit integers; the identity settles ties and is what is compared.
                order = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (textkit.mix(dart) >> np.uint64(32))
                np.minimum.at(best, owner[at] * k + coordinate, order)
                some = some[weight[some] > 2.0**weight_cell] if weight_cell else some[weight[some] > 1.0]
                weight_cell += 1
        thrown[active] = reach[active]
        empty = (best.reshape(n, k)[active] == np.iinfo(np.uint64).max).any(1)
        active = active[empty]
        reach[active] += 1  # an empty coordinate: twice the ranks
    out = best.reshape(n, k)
    out[total == 0] = 0
    return textkit.mix(out)


def weighted(texts: pa.Array | list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, occurrences) of all texts, sorted by text."""
    raw, off = textkit.flat(texts)
    owners, elements, weights = [], [], []
    for i, j, part, at in textkit.chunks(raw, off):
        h, first = textkit.shingles(part, at, words)
        owner = np.repeat(np.arange(j - i), np.diff(first))
        order = np.lexsort((h, owner))
        owner, h = owner[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        start = np.flatnonzero(new)
        owners.append(owner[start] + i)
        elements.append(h[start])
        weights.append(np.diff(np.append(start, len(h))).astype(float))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    return np.concatenate(owners), np.concatenate(elements), np.concatenate(weights)


def bands(texts: pa.Array | list[bytes], words: int = WORDS, n_bands: int = BANDS, rows: int = ROWS) -> list[np.ndarray]:
    """One 64-bit hash for each band of each text; none for a text without words."""
    n = len(texts)
    owner, element, weight = weighted(texts, words)
    sig = signatures(owner, element, weight, n, n_bands * rows)
    h = np.zeros((n, n_bands), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            h = textkit.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows])
    has = np.bincount(owner, minlength=n) > 0
    return [h[i].view(np.int64) if has[i] else np.zeros(0, np.int64) for i in range(n)]


def occurrences(texts: pa.Array | list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Hashes of (shingle, first / second / ... occurrence): sets whose Jaccard similarity is the weighted one.

    32 bits of a hash suffice: two texts of n shingles meet by chance in n * n / 2**32 of them.
    """
    raw, off = textkit.flat(texts)
    out: list[np.ndarray] = []
    for _, _, part, at in textkit.chunks(raw, off):
        h, first = textkit.shingles(part, at, words)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            x = np.sort(h[a:b])
            new = np.ones(len(x), bool)
            new[1:] = x[1:] != x[:-1]
            nth = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
            with np.errstate(over="ignore"):
                each = textkit.mix(x + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out.append(np.sort((each >> np.uint64(32)).astype(np.uint32)))
    return out


def _verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts' weighted Jaccard similarity is ``similarity`` at least; ``pairs`` is a cut.

    A leader has very many pairs; they are dealt to many tasks.
    """

    @F.pandas_udf("double")
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)
            low, high = (p, q) if len(p) <= len(q) else (q, p)
            if len(low) < similarity * len(high):
                out.append(0.0)
                continue
            at = np.minimum(np.searchsorted(high, low), len(high) - 1)
            both = int((high[at] == low).sum())
            out.append(both / (len(p) + len(q) - both))
        return pd.Series(out, dtype=float)

    shared.bounded_batches(pairs.sparkSession)
    with_a = shared.spread_join(pairs, sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return both.where(jaccard("set_a", "set_b") >= similarity).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, class) of all nodes of ``edges`` (a, b): the smallest node of each connected component.

    Each round a label falls to the smallest of its neighbours' labels, and to that label's own label, so chains
    halve.  Every round is written and read anew, so its plan stays as small as the first; rounds end when no
    label changes.
    """
    both = shared.cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = shared.cut(both.select(F.col("a").alias("node")).distinct().withColumn("class", F.col("node")))
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("class").alias("least"))
        fell = label.join(near, F.col("node") == F.col("a")).select("node", F.least("class", "least").alias("to"), F.col("class").alias("was"))
        jump = label.select(F.col("node").alias("to"), F.col("class").alias("then"))
        new = shared.cut(fell.join(jump, "to").select("node", F.least("to", "then").alias("class"), "was"))
        label = new.select("node", "class")
        if new.where("class <> was").isEmpty():
            return label


def _merged(label: DataFrame, found: DataFrame) -> DataFrame:
    """The classes of ``label`` (node, class) after the links ``found`` (a, b); both are cuts."""
    if found.isEmpty():
        return label
    ends = [label.select(F.col("node").alias(x), F.col("class").alias(f"class_{x}")) for x in "ab"]
    edges = shared.cut(found.join(ends[0], "a").join(ends[1], "b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).where("a <> b").distinct())
    to = components(edges).select(F.col("node").alias("class"), F.col("class").alias("to"))
    return shared.cut(shared.spread_join(label, to, "class", "left").select("node", F.coalesce("to", "class").alias("class")))


def _tokens(s: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(x, np.int32) for x in s], dtype=object)


def spelt(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """node, size, score, token: the tokens (occurrence hashes) of ``texts`` (node, score), one row each."""
    shared.bounded_batches(texts.sparkSession)
    size = (F.octet_length("set") / 4).cast("int")
    return sets.join(texts, "node").select("node", size.alias("size"), "score", F.explode(F.pandas_udf(_tokens, "array<int>")("set")).alias("token"))


def token_counts(texts: DataFrame, sets: DataFrame, fewest: int = 1) -> DataFrame:
    """token, often, least, node: in how many of ``texts`` (``fewest`` at least) a token is, the smallest of them and the least node.

    Each task adds up its own texts and sends its tokens on by ranges, a block of sorted tokens each; the blocks of a range
    are added up together.  Ranges are as many as ``RANGE`` tokens each make, so a block's task holds about as many; a token
    of very many texts is one entry of each task, and a token of fewer texts than asked for never becomes a row.
    """
    own = shared.cut(sets.join(texts.select("node"), "node").select("node", "set"))
    ranges = max(1, (own.agg(F.sum(F.octet_length("set"))).first()[0] or 0) // 4 // RANGE)

    names, types = ["token", "often", "least", "node"], [pa.int32(), pa.int64(), pa.int32(), pa.int64()]

    def added(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        token, often, least, node = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(token, kind="stable")
        kinds, first = np.unique(token[order], return_index=True)
        return kinds, np.add.reduceat(often[order], first), np.minimum.reduceat(least[order], first), np.minimum.reduceat(node[order], first)

    def blocks(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        # Tokens are sorted as signed numbers, so ranges are too.
        at = ((columns[0].astype(np.int64) + 2**31) * ranges) >> 32
        kinds, first = np.unique(at, return_index=True)
        ends = pa.array(np.append(first, len(at)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), *lists], names=["part", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            some = [np.frombuffer(x.as_py(), np.int32) for x in b.column("set")]
            sizes = np.array([len(x) for x in some], np.int64)
            if not sizes.sum():
                continue
            held.append((np.concatenate(some), np.ones(sizes.sum(), np.int64), np.repeat(sizes, sizes), np.repeat(b.column("node").to_numpy(), sizes)))
            if sum(len(x[0]) for x in held) > COUNTED:
                held = [added(held)]
                if len(held[0][0]) > COUNTED // 2:
                    yield blocks(held.pop())
        if held:
            yield blocks(added(held))

    def total(group: pa.Table) -> pa.Table:
        columns = added([tuple(group.column(c).combine_chunks().flatten().to_numpy() for c in names)])
        kept = columns[1] >= fewest
        return pa.table([pa.array(x[kept], t) for x, t in zip(columns, types, strict=True)], names=names)

    shared.bounded_batches(texts.sparkSession)
    sent = own.mapInArrow(run, "part long, token array<int>, often array<long>, least array<int>, node array<long>")
    return sent.groupBy("part").applyInArrow(total, "token int, often long, least int, node long")


def having(tokens: DataFrame, texts: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``spelt(texts, sets)`` whose token is in ``tokens`` (a cut of distinct ones).

    Up to ``SOUGHT`` tokens travel to all tasks, which spell out only these; more are joined.
    """
    spark = tokens.sparkSession
    if tokens.count() > SOUGHT:
        return shared.cut(spelt(texts, sets).join(tokens, "token", "left_semi"))
    sent = spark.sparkContext.broadcast(np.sort(tokens.toPandas()["token"].to_numpy(np.int32)))

    @F.pandas_udf("array<int>")
    def among(s: pd.Series) -> pd.Series:
        return _tokens(s).map(lambda x: x[np.isin(x, sent.value)])

    shared.bounded_batches(spark)
    size = (F.octet_length("set") / 4).cast("int")
    return shared.cut(sets.join(texts, "node").select("node", size.alias("size"), "score", F.explode(among("set")).alias("token")))


def _reach(similarity: float, size: Column, at: Column, other: Column) -> Column:
    """Whether a set of ``size`` whose first shared token is at ``at`` can have the similarity to one of size ``other``."""
    return (1 + similarity) * (size - at) >= similarity * (size + other) - 1e-6


def prefixes(texts: DataFrame, counts: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """token, node, size, at: the tokens that one of ``texts`` may share first with another, by the ``counts`` of shared ones.

    Tokens are in one order for all texts, rare ones first; those that no other text has come first of all.  A text
    that shares ``similarity * size`` tokens with another has the first of them among its first size - that + 1, and all
    that follow must nearly suffice, also with the shortest text that has the token.  So most texts that no other can match
    have no token left.
    """
    per = shared.cut(counts.where("often > 1").select("token", "often", "least"))
    if per.count() <= SOUGHT:
        return shared.cut(_prefixes_sent(texts, per, sets, similarity))
    minor = shared.cut(spelt(texts, sets).drop("score"))
    common = shared.spread_join(minor, per, "token")
    order = Window.partitionBy("node").orderBy("often", "token")
    common = common.withColumns({"at": F.row_number().over(order) - 1, "common": F.count("*").over(Window.partitionBy("node"))})
    common = common.withColumn("at", F.col("at") + F.col("size") - F.col("common"))
    able = (F.col("at") <= F.col("size") - F.ceil(similarity * F.col("size") - 1e-6)) & _reach(similarity, F.col("size"), F.col("at"), F.greatest(F.col("least"), similarity * F.col("size")))
    return shared.cut(common.where(able).select("token", "node", "size", "at"))


def _prefixes_sent(texts: DataFrame, per: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``prefixes`` with the counts of shared tokens (``SOUGHT`` at most) sent to all tasks: texts spell out their prefix alone."""
    spark = texts.sparkSession
    known = per.toPandas().sort_values("token")
    sent = spark.sparkContext.broadcast(tuple(known[c].to_numpy(np.int64) for c in ("token", "often", "least")))

    @F.pandas_udf("array<struct<token:int,at:int>>")
    def first(s: pd.Series) -> pd.Series:
        token, often, least = sent.value
        out = []
        for x in s:
            own = np.frombuffer(x, np.int32).astype(np.int64)
            place = np.minimum(np.searchsorted(token, own), max(0, len(token) - 1))
            shared_ = token[place] == own if len(token) else np.zeros(len(own), bool)
            place, n = place[shared_], len(own)
            place = place[np.lexsort((token[place], often[place]))]
            at = np.arange(len(place)) + n - len(place)
            other = np.maximum(least[place], similarity * n)
            able = (at <= n - math.ceil(similarity * n - 1e-6)) & ((1 + similarity) * (n - at) >= similarity * (n + other) - 1e-6)
            out.append([{"token": int(t), "at": int(a)} for t, a in zip(token[place[able]], at[able], strict=True)])
        return pd.Series(out, dtype=object)

    shared.bounded_batches(spark)
    size = (F.octet_length("set") / 4).cast("int")
    return sets.join(texts, "node").select("node", size.alias("size"), F.explode(first("set")).alias("p")).select("p.token", "node", "size", "p.at")


def close_pairs(tokens: DataFrame, prefix: DataFrame, label: DataFrame, similarity: float, lead: bool) -> DataFrame:
    """(a, b) of a text of ``prefix`` and a text of another class that can have the similarity.

    ``tokens`` are all rows of the prefixes' tokens.  No pair of the similarity is left out, except with ``lead``, where
    each token is compared with one text only.
    """
    of = label.select("node", "class")
    tokens = shared.cut(tokens.join(of, "node"))
    led = F.max(F.struct("score", "node", "size", "class")).alias("led")
    per = tokens.groupBy("token").agg(F.min("class").alias("c0"), F.max("class").alias("c1"), led).where("c0 <> c1").select("token", "led")
    one = shared.cut(prefix.join(of, "node").select("token", F.col("node").alias("a"), F.col("size").alias("size_a"), "at", F.col("class").alias("class_a")))
    one = shared.spread_join(one, per, "token")
    fit = (F.col("class_a") != F.col("class_b")) & (F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b") - 1e-6) & _reach(similarity, F.col("size_a"), F.col("at"), F.col("size_b"))
    if lead:
        both = one.withColumns({"b": F.col("led.node"), "size_b": F.col("led.size"), "class_b": F.col("led.class")})
    else:
        other = shared.cut(tokens.select("token", F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("class").alias("class_b")))
        both = shared.spread_join(other, shared.cut(one.drop("led")), "token")
    return both.where(fit).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _read(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, at, sha, bands of every row: a number of its own, the text's digest and its band hashes.

    Only the first of equal texts in a task carries bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = pyspark.TaskContext.get().partitionId() << 33, set()
        for b in batches:
            text = b.column("text")
            sha = [hashlib.sha256((t.as_py() or "").encode()).digest() for t in text]
            first = [i for i, x in enumerate(sha) if x not in seen and not seen.add(x)]
            hashes: list[bytes | None] = [None] * len(sha)
            for i, h in zip(first, bands(text.take(pa.array(first, pa.int64())), words), strict=True):
                hashes[i] = h.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(range(at, at + len(sha)), pa.int64()), pa.array(sha, pa.binary()), pa.array(hashes, pa.binary())], names=["doc_id", "at", "sha", "bands"])
            at += len(sha)

    shared.bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, at long, sha binary, bands binary")


def _classes(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): doc_id and sha of every row; sha, node, best, copies, class_id and lead of every text.

    ``lead`` marks one text of each class, the one of class_id (of texts that share that id, one).
    """

    @F.pandas_udf("binary")
    def occurrence_set(s: pd.Series) -> pd.Series:
        return pd.Series([x.tobytes() for x in occurrences(pa.array(s, pa.string()), words)], dtype=object)

    @F.pandas_udf("array<long>")
    def split(s: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, np.int64) for x in s], dtype=object)

    rows = shared.cut(_read(docs, words))
    # A text is named by the number of its first row; its bands are those of that row.
    texts = shared.cut(rows.groupBy("sha").agg(F.max("doc_id").alias("best"), F.count("*").alias("copies"), F.min("at").alias("node")))
    held = rows.where("bands is not null").select(F.col("at").alias("node"), "bands").join(texts.select("node"), "node")
    members = shared.cut(held.select("node", F.posexplode(split("bands")).alias("band", "hash")).select("node", F.xxhash64("band", "hash").alias("bucket")))
    size = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    placed = shared.cut(shared.spread_join(members, size, "bucket"))
    busy = shared.cut(placed.groupBy("node").agg(F.sum("n").alias("score")))
    placed = shared.cut(placed.join(busy, "node"))
    # The texts of busy nodes, one row each (several only where rows repeat).
    wanted = texts.join(busy.select("node"), "node").select("sha", "best", "node")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("sha", shared.text_sha(F.col("text")))
    chosen = chosen.join(wanted.withColumnRenamed("sha", "of"), (F.col("sha") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("best"))).select("node", occurrence_set("text").alias("set"))
    sets = shared.cut(chosen.groupBy("node").agg(F.first("set").alias("set")))

    # First, every text of a bucket is compared with the bucket's leader, the text that shares most buckets with most
    # texts (the original of a group of edited copies).
    leader = placed.groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("led")).select("bucket", F.col("led.node").alias("leader"))
    led = shared.spread_join(placed, leader, "bucket").where("node <> leader")
    pairs = shared.cut(led.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct())
    label = shared.cut(busy.select("node", F.col("node").alias("class")))
    label = _merged(label, shared.cut(_verify(pairs, sets, similarity)))

    def mixed(table: DataFrame) -> DataFrame:
        """The rows (bucket, node, n) of buckets that hold several classes, with their class."""
        classed = shared.cut(table.join(label, "node"))
        several = classed.groupBy("bucket").agg(F.min("class").alias("c0"), F.max("class").alias("c1")).where("c0 <> c1").select("bucket", F.lit(True).alias("several"))
        return shared.cut(shared.spread_join(classed, several, "bucket").drop("several"))

    # Then small buckets compare all their texts of different classes.
    rest = mixed(placed.select("bucket", "node", "n"))
    one = rest.where(F.col("n") <= SMALL).select("bucket", F.col("node").alias("a"), F.col("class").alias("class_a"))
    other = one.select("bucket", F.col("a").alias("b"), F.col("class_a").alias("class_b"))
    again = one.join(other, "bucket").where("a < b and class_a <> class_b").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    label = _merged(label, shared.cut(_verify(shared.cut(again), sets, similarity)))

    # In a larger one, at least one text of two different classes is none of the bucket's largest class.  These minor texts
    # are joined on their rarest shingles with all others, which misses no pair of the similarity: first each with one
    # text of a shingle, then with all of other classes.
    large = mixed(rest.where(F.col("n") > SMALL).select("bucket", "node", "n"))
    if not large.isEmpty():
        shares = large.groupBy("bucket", "class").agg(F.count("*").alias("size"))
        most = shares.groupBy("bucket").agg(F.max(F.struct("size", "class")).alias("m")).select("bucket", F.col("m.class").alias("most"))
        held = shared.spread_join(large, most, "bucket").groupBy("node").agg(F.bool_or(F.col("class") != F.col("most")).alias("minor"))
        held = shared.cut(held.join(busy, "node"))
        prefix = prefixes(held.where("minor").select("node", "score"), token_counts(held, sets, 2), sets, similarity)
        met = having(shared.cut(prefix.select("token").distinct()), held.select("node", "score"), sets)
        for lead in (True, False):
            label = _merged(label, shared.cut(_verify(shared.cut(close_pairs(met, prefix, label, similarity, lead)), sets, similarity)))

    named = shared.cut(texts.join(label, "node", "left").withColumn("class", F.coalesce("class", "node")))
    of_class = named.groupBy("class").agg(F.max("best").alias("class_id"))
    named = shared.cut(shared.spread_join(named, of_class, "class"))
    lead = named.where(F.col("best").eqNullSafe(F.col("class_id"))).groupBy("class").agg(F.min("node").alias("first"))
    named = shared.spread_join(named, lead, "class").withColumn("lead", F.col("node") == F.col("first"))
    return rows.select("doc_id", "sha"), shared.cut(named.select("sha", "node", "best", "copies", "class_id", "lead"))


def classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, copies, kept: one row for each input row.

    Rows of one text (null: empty) are one node, so copies cost nothing.  class_id is the largest doc_id of the
    class; copies counts the rows of its text; kept marks the rows of the text that stands for the class (one
    text, also where several share class_id; repeated rows share it).  Texts without words only equal each
    other.  Null ids lose against any other; a class of null ids alone has a null class_id.  An empty table gives
    no rows.

    Any two texts of the similarity that share a bucket get one class, whatever the size of the bucket.
    """
    rows, texts = _classes(docs, words, similarity)
    kept = F.col("lead") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return shared.spread_join(rows, texts, "sha").select("doc_id", "class_id", "copies", kept.alias("kept"))


def one_each(docs: DataFrame) -> DataFrame:
    """One row of each class of ``classes``, with its columns: the row of class_id's text (of repeated rows, one).

    Rows are told apart by their whole text's digest, so different texts that share a doc_id lose nothing.
    """
    rows, texts = _classes(docs, WORDS, SIMILARITY)
    lead = texts.where("lead").select("sha", F.col("class_id").alias("id"))
    return shared.one_row_each(docs, lead, rows)
