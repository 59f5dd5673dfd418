"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of a text's shingles (five words; all words of a
shorter text).  Sketches of parts merge into the sketch of the whole, and two sketches estimate
resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared, textkit

K, WORDS = 256, 5
#: Keys that a task folds before it sends them on, and the parts that one key's hashes are ranked in.
FOLDED, SHARES = 20_000, 32


def sketches(texts: list[bytes], k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """The sorted bottom-k sketch of each text; an empty text has an empty one."""
    raw, off = textkit.flat(texts)
    out: list[np.ndarray] = []
    for _, _, part, at in textkit.chunks(raw, off):
        h, first = textkit.shingles(part, at, words)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            out.append(_lowest(h[a:b], k))
    return out


def _lowest(h: np.ndarray, k: int) -> np.ndarray:
    if len(h) > 8 * k:
        # Hashes are uniform: those below this bound nearly always hold the k smallest distinct ones.
        few = h[h < np.uint64(min(2**64 - 1, int(2.0**64 * 3 * k / len(h))))]
        if len(low := np.unique(few)) >= k:
            return low[:k]
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what ``a`` and ``b`` describe."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    low = merge(a, b, k)
    if not len(low):
        return 1.0
    shared_by_both = np.isin(low, a, assume_unique=True) & np.isin(low, b, assume_unique=True)
    return float(shared_by_both.sum() / len(low))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / float(a[-1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; 1 if a is empty."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, both / distinct(a, k))


def dump(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def load(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u8")


def fingerprint(df: DataFrame, text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """All columns of ``df`` and ``fingerprint``; a null or empty text has the empty fingerprint ''."""
    shared.bounded_batches(df.sparkSession)

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([dump(x) for x in sketches([("" if v is None else v).encode() for v in s], k, words)], dtype=object)

    return df.withColumn("fingerprint", F.pandas_udf(run, "string")(F.col(text)))


def merged(df: DataFrame, keys: list[str], column: str = "fingerprint", k: int = K) -> DataFrame:
    """One sketch for each key from the sketches of its parts; null keys are one key, no keys give one row.

    Each task folds its own parts first.  Folded sketches are split into their hashes, of which the k smallest
    distinct ones of each key are found by ranking; a key with most of the rows sends k hashes from each task, and
    their ranking is dealt to ``SHARES`` parts before it is joined.
    """
    names = [f"__key{i}" for i in range(len(keys))]
    source = df.select(*(F.col(c).alias(n) for c, n in zip(keys, names, strict=True)), F.coalesce(column, F.lit("")).alias("__sketch"))
    source = source.withColumn("__id", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}) if names else F.lit(""))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(have), pa.string()), pa.array([x.view(np.int64) for x in have.values()], pa.list_(pa.int64()))], names=["__id", "__hashes"])

        for b in batches:
            for at, s in zip(b.column("__id").to_pylist(), b.column("__sketch").to_pylist(), strict=True):
                x = load(s)[:k]
                have[at] = merge(have[at], x, k) if at in have else x
            if len(have) > FOLDED:
                yield out()
                have = {}
        yield out()

    # Unsigned order as an order of signed numbers.
    hashes = source.select("__id", "__sketch").mapInArrow(fold, "__id string, __hashes array<long>").select("__id", F.explode("__hashes").alias("__h"))
    hashes = hashes.select("__id", F.expr("__h ^ -9223372036854775808L").alias("__h")).distinct().withColumn("__share", F.pmod("__h", F.lit(SHARES)))
    for part in (["__id", "__share"], ["__id"]):
        hashes = hashes.withColumn("__nth", F.row_number().over(Window.partitionBy(*part).orderBy("__h"))).where(F.col("__nth") <= k)

    def pack(s: pd.Series) -> pd.Series:
        return pd.Series([dump(np.sort(np.asarray(x, np.int64).view(np.uint64) ^ np.uint64(1 << 63))) for x in s], dtype=object)

    sketches_ = hashes.groupBy("__id").agg(F.collect_list("__h").alias("__h")).select("__id", F.pandas_udf(pack, "string")("__h").alias(column))
    one = source.dropDuplicates(["__id"]).drop("__sketch")
    return one.join(sketches_, "__id", "left").select(*(F.col(n).alias(c) for c, n in zip(keys, names, strict=True)), F.coalesce(column, F.lit("")).alias(column))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, next_in_doc double"


def with_neighbour(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints of each text and of its edit, which ends with the start of the next document.

    Documents stand in descending order of doc_id (equal ids by text; null ids last); after the last comes
    the first.  The edit replaces the last floor(n/2) code points by as many, or all, of the next text.
    Texts are shuffled once: ids are cut into many ranges by quantiles, each range is sorted in its task, and
    the first document of a range is also sent to the end of the range before.  Those copies are one for
    each range.  An empty table gives no rows; null texts count as empty; repeated rows follow one another.
    """
    spark = docs.sparkSession
    shared.bounded_batches(spark, 256)
    parts = shared.tasks(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = 8 * parts
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 4 * ranges)).first()[0] or []))
    # Large ids come first; a null id falls in the last range.
    bucket = F.lit(len(cuts)) - F.coalesce(_reached(cuts), F.lit(0))

    ids = docs.select("doc_id", bucket.alias("bucket"))
    heads = sorted((r.bucket, r.head) for r in ids.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect())
    if not heads:
        return spark.createDataFrame([], _OUT)
    before = [(heads[i - 1][0], heads[i][1]) for i in range(len(heads))]
    tails = (
        docs.join(F.broadcast(spark.createDataFrame(before, "bucket int, head long")), F.col("doc_id").eqNullSafe(F.col("head")))
        .groupBy("bucket", "doc_id")
        .agg(F.min("text").alias("text"))
        .select("doc_id", "text", "bucket", F.lit(1).alias("tail"))
    )
    rows = docs.select("doc_id", "text", bucket.alias("bucket"), F.lit(0).alias("tail")).unionByName(tails)
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for b in batches:
            texts = b.column("text").to_pylist()
            prints = sketches([x.encode() for x in texts], k, words)
            todo: list[tuple] = []
            for one in zip(b.column("doc_id").to_pylist(), texts, b.column("tail").to_pylist(), prints, strict=True):
                if last is not None and not last[2]:
                    todo.append((*last, one[1], one[3]))
                last = one
            edits, out = [], []
            for _, text, _, _, after, _ in todo:
                half = len(text) // 2
                edits.append((text[: len(text) - half] + after[:half]).encode())
            for (doc_id, text, _, own, _, nxt), edit, other in zip(todo, edits, sketches(edits, k, words), strict=True):
                out.append((doc_id, len(text), hashlib.sha256(edit).hexdigest(), dump(own), dump(other), resemblance(own, other, k), resemblance(own, nxt, k), distinct(own, k), containment(nxt, own, k)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(_TYPES)], names=_NAMES)

    return rows.mapInArrow(run, _OUT)


def _reached(cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` a doc_id reaches; null for a null id."""

    @F.pandas_udf("int")
    def reached(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, np.int64), ids.to_numpy(np.int64), "right").astype(np.int32))

    # Null ids are told apart in SQL, so ids reach the task as whole numbers.
    return F.when(F.col("doc_id").isNotNull(), reached(F.coalesce("doc_id", F.lit(0).cast("long"))))


_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in _OUT.split(", ")]
