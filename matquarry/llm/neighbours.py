"""Approximate nearest neighbours by multi-index hashing.

A vector's binary code has the signs of its coordinates after learned rotations.  Codes are split into substrings of
16 bits, and each shard of the rows indexes every substring: places sorted by its value.  If two codes differ in
``r`` bits, then by the pigeonhole principle they differ in at most ``r // m`` bits of one of the ``m`` substrings (for
all but the first ``r % m + 1`` of them even in one less), so probing each index in the balls of these radii meets
every code within Hamming radius ``r``.  Codes met are checked whole, and those within the radius are ranked by the
cosine of their vectors in double precision.

The radius is each query's own.  It grows until over ``k`` codes are within; the ``k``-th best cosine among them bounds
the angle ``t`` of the true neighbours, whose codes differ in about ``bits * t / pi`` bits, and the last probe goes
``SPREAD`` standard deviations beyond that.  So a query among near copies looks into few buckets and one far from
all others into many, whatever the size of the table; there is no cap on buckets or candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Bits of a code, bits of a substring, standard deviations that the last radius goes beyond the expected one.
BITS, PART, SPREAD = 256, 16, 2.0
#: Vectors that the rotations are learned from, rounds of learning, rows of a shard.
SAMPLE, ROUNDS, SHARD_ROWS = 4096, 30, 1 << 16
#: Rows of a shard that a query is compared with to choose its first radius, if hardly any code is near.
FEW = 256
_BALLS = np.argsort(np.bitwise_count(np.arange(1 << PART, dtype=np.uint32)), kind="stable").astype(np.uint16)
_BALL_SIZES = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << PART, dtype=np.uint32))))


def usable(vec: Column) -> Column:
    """Whether a vector can take part: not null, no null or non-finite component, not all zero (so not empty)."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to [0.5, 1): the cosine stays the same, exactly."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def rotations(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS) -> np.ndarray:
    """A matrix of ``bits`` columns whose signs are a vector's code.

    Each group of as many columns as there are dimensions is an orthogonal rotation, turned so that the sampled unit
    vectors lie close to the corners that their signs name (alternating signs and the best rotation for them).
    """
    d, out = sample.shape[1], []
    random = np.random.default_rng(d)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    for _ in range(-(-bits // d)):
        turn = np.linalg.qr(random.standard_normal((d, d)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(unit.T @ np.where(unit @ turn >= 0, 1.0, -1.0))
            turn = u @ v
        out.append(turn)
    return np.concatenate(out, 1)[:, :bits]


class Shard:
    """The index of some rows: codes, and for each substring the rows sorted by its value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.norms = np.sqrt((vectors[order] ** 2).sum(1))
        self.turn, self.bits = turn, turn.shape[1]
        self.parts = codes(self.vectors, turn)
        self.words = self.parts.view(np.uint64)
        self.m = self.parts.shape[1]
        self.index = []
        for j in range(self.m):
            values, bucket = np.unique(self.parts[:, j], return_inverse=True)
            rows = np.argsort(bucket, kind="stable")
            first = np.append(0, np.cumsum(np.bincount(bucket, minlength=len(values))))
            place = np.full(1 << PART, -1, np.int32)
            place[values] = np.arange(len(values))
            self.index.append((values, place, bucket.astype(np.int32), rows, first))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose code differs from ``code`` in at most ``radius`` bits."""
        met = np.zeros(len(self.ids), bool)
        for j, (values, place, bucket, rows, first) in enumerate(self.index):
            near = radius // self.m - (j > radius % self.m)
            if near < 0:
                break
            if 8 * _BALL_SIZES[min(near, PART)] < len(values):
                at = place[code[j] ^ _BALLS[: _BALL_SIZES[near]]]
                for i in at[at >= 0].tolist():
                    met[rows[first[i] : first[i + 1]]] = True
            else:  # the ball has more codes than there are buckets, so these are looked through
                met |= (np.bitwise_count(values ^ code[j]) <= near)[bucket]
        met = np.flatnonzero(met)
        return met[np.bitwise_count(self.words[met] ^ code.view(np.uint64)).sum(1) <= radius]

    def ranked(self, query: np.ndarray, own: int, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` rows nearest to the query by cosine and id, without the query's own, and their cosines."""
        rows = rows[self.ids[rows] != own]
        # Summed row by row, so equal vectors have equal cosines wherever they stand.
        cosine = (self.vectors[rows] * query).sum(1) / (self.norms[rows] * np.sqrt((query**2).sum()))
        best = np.argsort(-cosine, kind="stable")[:k]  # rows stand by id
        return rows[best], cosine[best]

    def nearest(self, query: np.ndarray, own: int, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest rows found for one query."""
        radius = self.m - 1
        rows = self.within(code, radius)
        if len(rows) <= k:  # the expected radius of the neighbours among a few rows
            few = self.ranked(query, own, np.arange(min(len(self.ids), FEW)), k)[1]
            radius = max(radius, int(self.bits * _share(few[-1]))) if len(few) == k else self.bits
            rows = self.within(code, radius)
        while len(rows) <= k and radius < self.bits:
            radius = min(self.bits, radius + self.m)
            rows = self.within(code, radius)
        rows, cosine = self.ranked(query, own, rows, k)
        if radius < self.bits:
            share = _share(cosine[-1])
            last = min(self.bits, int(np.ceil(self.bits * share + SPREAD * np.sqrt(self.bits * share * (1 - share)))))
            if last > radius:
                rows, cosine = self.ranked(query, own, self.within(code, last), k)
        return rows, cosine


def _share(cosine: float) -> float:
    """The share of a code's bits in which vectors of that cosine are expected to differ."""
    return float(np.arccos(np.clip(cosine, -1, 1)) / np.pi)


def codes(vectors: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Codes as rows of 16-bit substrings."""
    return np.packbits(vectors @ turn >= 0, axis=1).view(np.uint16)


_FOUND = "query_id long, vec_id long, score double"


def search(rows: DataFrame, queries: DataFrame, k: int = 5, vec: str = "embedding", bits: int = BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each of ``queries`` its ``k`` nearest of ``rows`` (all, if fewer).

    Both tables have ``vec_id`` and the vector ``vec``.  The nearest have the largest cosines, ties go to the smaller
    vec_id; a row with the query's vec_id is no candidate.  Rows with a null vec_id or a vector that isn't usable
    take no part; of rows that share a vec_id the one with the least vector (in order of components) counts.  Vectors
    of another length than a query's aren't compared with it.  Empty tables give no rows.

    Rows are dealt to shards by a hash of vec_id; a shard holds ``shard_rows`` rows at most on average (and few
    enough to occupy every task), is indexed in one task and answers all queries, which pass it batch by batch.  So
    memory is bounded by a shard, and no key decides where rows go.  The rotations are learned on the driver
    from the ``SAMPLE`` vectors with the least hashes of each vector length of the sample.
    """
    spark = rows.sparkSession
    if bits % 64:
        raise ValueError("codes have whole words of 64 bits")

    def plain(df: DataFrame) -> DataFrame:
        doubles = F.transform(vec, lambda x: x.cast("double"))
        good = df.select(F.col("vec_id").cast("long"), doubles.alias("vec")).where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
        return good.groupBy("vec_id").agg(F.min("vec").alias("vec"))

    all_rows = shared.cut(plain(rows))
    asked = shared.cut(plain(queries))
    order = [F.xxhash64("vec_id"), F.col("vec_id")]
    seen: dict[int, list] = {}
    for r in all_rows.orderBy(*order).limit(SAMPLE).collect():
        seen.setdefault(len(r.vec), []).append(r.vec)
    turns = {d: rotations(scaled(np.array(x)), bits) for d, x in seen.items()}
    n, width = all_rows.count(), shared.tasks(spark)
    shards = max(1, min(width, n // SAMPLE), n // shard_rows)

    kind = all_rows.select("vec_id", "vec", F.lit(False).alias("asks"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"))
    every = asked.select("vec_id", "vec", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    dealt = kind.unionByName(every)

    def build(held: pa.Table) -> dict[int, Shard]:
        return {d: Shard(ids, vectors, _turn(turns, d, bits)) for d, ids, vectors in _arrays(held)}

    def answer(index: dict[int, Shard], asked: pa.Table) -> Iterator[pa.RecordBatch]:
        return (_answers(index[d], ids, vectors, k) for d, ids, vectors in _arrays(asked) if d in index)

    found = shared.by_shard(dealt, shards, build, answer, _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _turn(turns: dict[int, np.ndarray], d: int, bits: int) -> np.ndarray:
    """The rotations for vectors of a length; lengths that the sample lacks have unlearned ones."""
    return turns[d] if d in turns else rotations(np.eye(d), bits, 0)


def _arrays(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ids and scaled vectors by length of the vector."""
    ids, vec = table.column("vec_id").to_numpy(), table.column("vec").combine_chunks()
    size = np.asarray(vec.value_lengths())
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        flat = vec.take(pa.array(rows)).flatten()
        yield int(d), ids[rows], scaled(flat.to_numpy().reshape(-1, d))


def _answers(shard: Shard, ids: np.ndarray, vectors: np.ndarray, k: int) -> pa.RecordBatch:
    own, who, cosine = [], [], []
    for one, vector, code in zip(ids.tolist(), vectors, codes(vectors, shard.turn), strict=True):
        rows, c = shard.nearest(vector, one, code, k)
        own.append(np.full(len(rows), one))
        who.append(shard.ids[rows])
        cosine.append(c)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (own, who, cosine)], names=["query_id", "vec_id", "score"])
