"""Quality classifier by importance resampling.

Two hashed n-gram generative models are counted: one over texts labelled as good (the target), one over all
texts (raw).  A text's log-weight is the log-ratio of its probabilities under them.  Texts are then sampled
without replacement, with probabilities by weight, through Gumbel top-k: the k largest sums of log-weight and
Gumbel noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, textkit

GRAM, BITS, PRIOR = 2, 15, 4.0
#: Labelled texts that the target model and the size of the sample are fitted on, at most.
LABELLED = 20_000
#: A level of the k-th key's histogram has so many bins; from so few rows on, they are sorted.
BINS, SORTED = 4096, 20_000


def counts(texts: DataFrame, gram: int = GRAM, bits: int = BITS) -> np.ndarray:
    """Grams in each bucket over all texts; each task adds up its own, so 2^bits rows a task are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << bits, np.int64)
        for pdf in batches:
            for _, _, _, cell in textkit.buckets(pa.array(pdf["text"], pa.string()), gram, bits):
                total += np.bincount(cell, minlength=1 << bits)
        yield pd.DataFrame({"bucket": np.flatnonzero(total), "n": total[total > 0]})

    shared.bounded_batches(texts.sparkSession)
    got = texts.select(F.col("text").cast("string")).mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << bits)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Log-ratio of the models in each bucket, drawn towards 0 where the target is expected to hold few grams."""
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    return np.log((target + prior) / (expected + prior))


def weights(ratio: np.ndarray, texts: pa.Array | list[bytes], gram: int = GRAM) -> np.ndarray:
    """The log-weight of each text; 0 without a token."""
    out = np.zeros(len(texts))
    for i, j, owner, cell in textkit.buckets(texts, gram, len(ratio).bit_length() - 1):
        out[i:j] = np.bincount(owner, ratio[cell], j - i)
    return out


def gumbel(doc_id: Column, seed: int = 2) -> Column:
    """Standard Gumbel noise that depends on doc_id and seed alone."""
    u = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest value (1 is the largest), exactly, by histograms of ever narrower ranges.

    ``keys`` is read a few times; only histograms and the rows of the last, narrow range reach the driver.
    """
    low, high = keys.agg(F.min(column), F.max(column)).first()
    above = 0
    while True:
        inside = keys.where((F.col(column) >= low) & (F.col(column) <= high))
        width = (high - low) / BINS
        n = inside.count()
        if n <= SORTED or width <= abs(high) * 1e-15:
            rows = inside.orderBy(F.desc(column)).limit(k - above).agg(F.min(column)).first()
            return float(rows[0])
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1))
        bins = inside.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("b")).collect()
        for b in bins:
            if above + b.n >= k:
                low, high = b.lo, b.hi
                break
            above += b.n
        if low == high:
            return float(low)


class Classifier:
    """The two models and the log-weight from which on labelled texts count as drawn from the target."""

    def __init__(self, ratio: np.ndarray, threshold: float) -> None:
        self.ratio, self.threshold = ratio, threshold


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Classifier:
    """Counts the raw model over all texts and the target model over the labelled good ones.

    Without a good label, or without a bad one, every text has weight 0 or every weight counts as good.
    """
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2))
    some = shared.cut(shared.labelled(docs, labels, "quality", bound).withColumn("fold", fold))
    halves = [counts(some.where((F.col("y") == 1) & (F.col("fold") == k))) for k in (0, 1)]
    if not (halves[0] + halves[1]).any():
        return Classifier(np.zeros(1 << BITS), -np.inf)
    raw = counts(docs)
    # Each half is weighed by the other half's model, as texts are that the model hasn't counted.
    got = pd.concat([score(some.where(F.col("fold") == k), Classifier(log_ratio(halves[1 - k], raw), 0.0), "y").toPandas() for k in (0, 1)])
    return Classifier(log_ratio(halves[0] + halves[1], raw), _threshold(got["log_weight"].to_numpy(float), got["y"].to_numpy(int) == 1))


def _threshold(w: np.ndarray, good: np.ndarray) -> float:
    """The cut with the best mean of both classes' shares told right."""
    if good.all() or not good.any():
        return -np.inf
    rank = np.argsort(w, kind="stable")
    w, good = w[rank], good[rank]
    right = np.concatenate([[0], np.cumsum(~good)]) / (~good).sum() + 1 - np.concatenate([[0], np.cumsum(good)]) / good.sum()
    at = int(np.argmax(right))
    return -np.inf if at == 0 else np.inf if at == len(w) else float(w[at - 1] + w[at]) / 2


def score(docs: DataFrame, model: Classifier, *keep: str) -> DataFrame:
    """doc_id, the columns ``keep`` and log_weight of each row; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model.ratio)

    @F.pandas_udf("double")
    def weigh(s: pd.Series) -> pd.Series:
        return pd.Series(weights(sent.value, pa.array(s, pa.string())))

    shared.bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, weigh(F.col("text").cast("string")).alias("log_weight"))


def key(seed: int = 2) -> Column:
    """What Gumbel top-k ranks by."""
    return F.col("log_weight") + gumbel(F.col("doc_id"), seed)


def top_k(scored: DataFrame, k: int, seed: int = 2) -> float | None:
    """The key from which on a row is in the sample of k; rows that tie with the k-th (repeated rows) all are."""
    return kth_largest(scored.select(key(seed).alias("key")), "key", k) if k > 0 else None


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_weight, key, accepted of every row.

    k is the number of texts whose log-weight reaches the model's threshold.  Null and empty texts have log-weight
    0; null ids share one noise value; an empty table gives no rows.
    """
    model = fit(docs, labels)
    scored = shared.cut(score(docs, model).withColumn("key", key()))
    least = _least(scored, model)
    return scored.withColumn("accepted", F.col("key") >= least)


def _least(scored: DataFrame, model: Classifier) -> float:
    k = scored.where(F.col("log_weight") >= model.threshold).count()
    least = top_k(scored, k)
    return float("inf") if least is None else least


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that ``classify`` accepts, with their columns.

    Keys are small and cut once to find the k-th; the texts are then scored again where they lie, which costs
    less than shuffling or writing them.
    """
    model = fit(docs, labels)
    least = _least(shared.cut(score(docs, model)), model)
    sent = docs.sparkSession.sparkContext.broadcast(model.ratio)

    @F.pandas_udf("double")
    def weigh(s: pd.Series) -> pd.Series:
        return pd.Series(weights(sent.value, pa.array(s, pa.string())))

    return docs.where(weigh(F.col("text").cast("string")) + gumbel(F.col("doc_id").cast("long")) >= least)
