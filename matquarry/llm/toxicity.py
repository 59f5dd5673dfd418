"""Toxicity by cumulative-link ordinal regression over sparse text features.

A text's features are the hashed words it holds (presence), all of them.  Grades are the ordered values of the
label column, as many as it has (0/1 labels give two).  One weight vector is shared by all thresholds:
P(grade > j) = sigmoid(w.x - theta_j) with theta_1 < theta_2 < ...  The output is the expected severity, the sum
of those probabilities, beside the most probable grade.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, textkit

BITS = 20
#: Labelled texts that are fitted on, at most (evenly from all grades); gradient steps; L1 penalty.
LABELLED, STEPS, PENALTY = 10_000, 400, 1e-3


def features(texts: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, bucket) of the distinct word buckets of each text."""
    rows, cells = [], []
    for i, _, owner, cell in textkit.buckets(texts, 1, BITS):
        pair = np.unique(owner << BITS | cell)
        rows.append((pair >> BITS) + i)
        cells.append(pair & (1 << BITS) - 1)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(cells)


@dataclass
class Model:
    buckets: np.ndarray  # sorted buckets with a weight
    weights: np.ndarray
    theta: np.ndarray  # one threshold between each two neighbouring grades
    grades: list[int] = field(default_factory=lambda: [0, 1])
    reject: float = float("inf")  # severity from which on a text counts as toxic

    def linear(self, n: int, row: np.ndarray, cell: np.ndarray) -> np.ndarray:
        if not len(self.buckets):
            return np.zeros(n)
        at = np.minimum(np.searchsorted(self.buckets, cell), len(self.buckets) - 1)
        return np.bincount(row, np.where(self.buckets[at] == cell, self.weights[at], 0.0), n)

    def severity(self, n: int, row: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The expected number of grades above the lowest."""
        return _sigmoid(self.linear(n, row, cell)[:, None] - self.theta).sum(1)

    def above(self, texts: pa.Array | list[bytes]) -> np.ndarray:
        """P(grade > j) for each text and threshold."""
        return _sigmoid(self.linear(len(texts), *features(texts))[:, None] - self.theta)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(row: np.ndarray, cell: np.ndarray, label: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> Model:
    """Accelerated proximal gradient on the L1-penalised likelihood of the cumulative-link model.

    ``row`` and ``cell`` are the pairs of texts and buckets, ``label`` the grade of each text.  Every grade weighs
    alike; the penalty leaves weights to the words that explain the labels.  Labels of one grade alone give a model
    without weights that rejects nothing.
    """
    n, names = len(label), sorted(set(label.tolist()))
    if len(names) < 2 or not len(row):
        return Model(np.zeros(0, np.int64), np.zeros(0), np.arange(max(1, len(names) - 1)) + 10.0, names if len(names) > 1 else [0, 1])
    levels = len(names)
    y = np.searchsorted(names, label)
    target = (y[:, None] > np.arange(levels - 1)).astype(float)
    weight = 1 / (levels * np.bincount(y, minlength=levels))[y]
    # A word whose texts weigh no more than the penalty can never get a weight: leaving it out changes nothing.
    reach = (levels - 1) * np.bincount(cell, weight[row], 1 << BITS) > penalty
    kinds, keep = np.flatnonzero(reach), reach[cell]
    row, column = row[keep].astype(np.int64), (np.cumsum(reach) - 1)[cell[keep]]
    size = len(kinds)
    if not size:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.arange(levels - 1) + 10.0, names)
    direction, curvature = np.ones(size), 1.0
    for _ in range(20):  # the largest curvature, by power iteration
        direction = np.bincount(column, (weight * np.bincount(row, direction[column], n))[row], size)
        curvature = float(np.linalg.norm(direction))
        direction /= max(curvature, 1e-12)
    step = 1 / ((levels - 1) * (0.25 * curvature + 0.25))
    w, theta = np.zeros(size), np.arange(levels - 1, dtype=float)
    v, edge, t = w, theta, 1.0
    for _ in range(steps):
        error = (_sigmoid(np.bincount(row, v[column], n)[:, None] - edge) - target) * weight[:, None]
        moved = v - step * np.bincount(column, error.sum(1)[row], size)
        fresh = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        cut = np.maximum.accumulate(edge + step * error.sum(0) + 1e-4 * np.arange(levels - 1))
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, edge = fresh + (t - 1) / following * (fresh - w), cut + (t - 1) / following * (cut - theta)
        w, theta, t = fresh, cut, following
    model = Model(kinds[w != 0], w[w != 0], theta, names)
    model.reject = _cut(model.severity(n, row, kinds[column]), y > 0)
    return model


def _cut(s: np.ndarray, toxic: np.ndarray) -> float:
    """The severity that tells toxic texts apart best, by the mean of both classes' shares told right."""
    rank = np.argsort(s, kind="stable")
    s, toxic = s[rank], toxic[rank]
    right = np.concatenate([[0], np.cumsum(~toxic)]) / (~toxic).sum() + 1 - np.concatenate([[0], np.cumsum(toxic)]) / toxic.sum()
    at = int(np.argmax(right))
    return float(s[0] if at == 0 else np.inf if at == len(s) else (s[at - 1] + s[at]) / 2)


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", bound: int = LABELLED) -> Model:
    """Fits on the words of at most ``bound`` labelled texts (copies count once), which reach the driver as numbers.

    ``column`` holds whole-numbered grades, the lowest meaning harmless.
    """

    @F.pandas_udf("binary")
    def cells(s: pd.Series) -> pd.Series:
        row, cell = features(pa.array(s, pa.string()))
        return pd.Series([x.tobytes() for x in np.split(cell.astype(np.int32), np.searchsorted(row, np.arange(1, len(s))))], dtype=object)

    shared.bounded_batches(docs.sparkSession)
    some = shared.labelled(docs, labels, column, bound, evenly=True).select("y", cells(F.col("text").cast("string")).alias("cells"))
    got = some.groupBy("cells").agg(F.max("y").alias("y")).orderBy("cells").toPandas()
    cell = [np.frombuffer(x, np.int32) for x in got["cells"]]
    row = np.repeat(np.arange(len(cell), dtype=np.int32), np.array([len(x) for x in cell], np.int64))
    return train(row, np.concatenate([*cell, np.zeros(0, np.int32)]), got["y"].to_numpy(np.int64))


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (0 to the number of thresholds), grade, toxic of every row; nothing is shuffled.

    A text is toxic if its severity reaches the model's bound; its grade is then the most probable one above the
    lowest, else the lowest.
    Null and empty texts have no words and so the lowest severity; repeated rows repeat their result; an empty
    table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("severity double, grade int")
    def rate(s: pd.Series) -> pd.DataFrame:
        above = sent.value.above(pa.array(s, pa.string()))
        edge = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], 1)
        likely = edge[:, :-1] - edge[:, 1:]
        best = np.where(above.sum(1) >= sent.value.reject, 1 + likely[:, 1:].argmax(1), 0)
        return pd.DataFrame({"severity": above.sum(1), "grade": np.array(sent.value.grades)[best].astype(np.int32)})

    shared.bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), rate(F.col("text").cast("string")).alias("r")).select("doc_id", "r.severity", "r.grade", (F.col("r.severity") >= model.reject).alias("toxic"))


def harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose expected severity stays below the model's bound, with their columns."""
    model = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def severity(s: pd.Series) -> pd.Series:
        return pd.Series(sent.value.above(pa.array(s, pa.string())).sum(1))

    shared.bounded_batches(docs.sparkSession)
    return docs.where(severity(F.col("text").cast("string")) < model.reject)
