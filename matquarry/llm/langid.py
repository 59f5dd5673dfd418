"""Language ID by string-kernel classification.

The blended-spectrum presence kernel of two texts counts the byte n-grams of 1 to ``SPECTRUM`` bytes that both
hold, normalised to 1 for equal sets.  N-grams are hashed to ``BUCKETS`` buckets.  Texts map to Nystroem
features through landmarks drawn from the training texts, one-versus-rest kernel ridge regression scores every
language, and a batch of texts is scored by two matrix products: with the landmarks and with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, textkit

SPECTRUM, BUCKETS, RIDGE = 3, 1 << 15, 1e-3
#: Landmarks in all, and of each language at least; training texts of each language, about; texts of one product.
LANDMARKS, PER_LANG_LANDMARKS, PER_LANG, BATCH = 192, 8, 400, 128
#: Values of lang that are learnt, and texts of all of them, at most: the bitmaps that the driver holds.
MAX_LANGS, TEXTS = 2000, 40_000
#: A learned language's score is turned into a share of all by this factor.
SHARPNESS = 8.0

_LETTER = regex.compile(r"\p{L}").search


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0; a null id counts as the empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def presence(texts: list[str], spectrum: int = SPECTRUM, buckets: int = BUCKETS) -> np.ndarray:
    """One row for each text: 1/sqrt(size) in the buckets of its n-grams, so that rows have norm 1."""
    raw, off = textkit.flat([t.lower().encode() for t in texts])
    out = np.zeros((len(texts), buckets), np.float32)
    for i, j, part, at in textkit.chunks(raw, off, 1 << 18):
        row = np.repeat(np.arange(i, j, dtype=np.int64) * buckets, np.diff(at))
        left = np.repeat(at[1:], np.diff(at)) - np.arange(len(part))
        gram = np.zeros(len(part), np.uint32)
        for n in range(1, spectrum + 1):
            ahead = np.zeros(len(part), np.uint32)
            ahead[: len(part) - n + 1] = part[n - 1 :]
            gram = gram << np.uint32(8) | ahead
            cell = (gram * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - buckets.bit_length() + 1)
            fits = left >= n
            out.reshape(-1)[(row + cell)[fits]] = 1.0
    size = np.sqrt(out.sum(1, keepdims=True))
    np.divide(out, size, out=out, where=size > 0)
    return out


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)), np.float32)
        for i in range(0, len(texts), BATCH):
            out[i : i + BATCH] = (presence(texts[i : i + BATCH]) @ self.landmarks.T) @ self.weights
        return out


def train(sets: list[bytes], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fits on a bounded sample: landmarks are taken evenly from all languages in the given order.

    ``sets`` are the texts' sets of buckets as bitmaps; the rows of a batch are unpacked at a time.
    """
    names = sorted(set(langs))
    y = np.array([[1.0 if lang == n else -1.0 for n in names] for lang in langs])
    nth = pd.Series(langs).groupby(langs).cumcount().to_numpy()
    chosen = _rows([sets[i] for i in np.argsort(nth, kind="stable")[: max(landmarks, PER_LANG_LANDMARKS * len(names))]])
    value, vector = np.linalg.eigh((chosen @ chosen.T).astype(np.float64))
    good = value > 1e-6 * value[-1]
    to_feature = vector[:, good] / np.sqrt(value[good])
    z = np.concatenate([_rows(sets[i : i + BATCH]) @ chosen.T for i in range(0, len(sets), BATCH)]) @ to_feature
    solved = np.linalg.solve(z.T @ z + ridge * len(z) * np.eye(z.shape[1]), z.T @ y)
    return Model(names, chosen, (to_feature @ solved).astype(np.float32))


def _rows(sets: list[bytes]) -> np.ndarray:
    out = np.unpackbits(np.frombuffer(b"".join(sets), np.uint8).reshape(len(sets), -1), axis=1).astype(np.float32)
    size = np.sqrt(out.sum(1, keepdims=True))
    return np.divide(out, size, out=out, where=size > 0)


def bitmap(text: str) -> bytes:
    """The buckets of a text's n-grams, one bit each."""
    return np.packbits(presence([text])[0] > 0).tobytes()


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """(doc_id, lang, grams) of about ``per_lang`` texts of each language, as bitmaps of ``BUCKETS`` bits.

    Only rows that aren't held out, hold text and have a language; of over ``MAX_LANGS`` values of lang the most frequent
    are learnt, and of many values fewer texts of each (``TEXTS`` of all), so a dirty column can't fill the driver.  A share of each is kept by a hash of doc_id, so no language
    is gathered in one task.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length(F.coalesce("text", F.lit(""))) > 0)).select("doc_id", "text", "lang")
    many = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    many = shared.cut(many)
    each = min(per_lang, TEXTS // max(1, many.count()))
    share = many.select("lang", (F.lit(each) / F.col("n")).alias("share"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) / 1_000_000
    grams = F.pandas_udf(lambda s: s.map(bitmap), "binary")
    return rows.join(share, "lang").where(chance < F.col("share")).select("doc_id", "lang", grams(F.col("text").cast("string")).alias("grams"))


_OUT = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text, learnt from the rows that aren't held out.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if there is nothing to learn
    from; an empty table gives no rows.  lang, source and doc_id are no inputs of a prediction.  Repeated rows give repeated results.
    """
    spark = docs.sparkSession
    shared.bounded_batches(spark)
    got = sample(docs).toPandas().sort_values(["doc_id", "grams"])
    model = train(got["grams"].tolist(), got["lang"].tolist()) if len(got) else None
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            texts = [x or "" for x in b.column("text").to_pylist()]
            known = [model is not None and _LETTER(x) is not None for x in texts]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            if todo := [i for i, x in enumerate(known) if x]:
                s = model.scores([texts[i] for i in todo]).astype(np.float64)
                e = np.exp(SHARPNESS * (s - s.max(1, keepdims=True)))
                best = s.argmax(1)
                for i, k, p in zip(todo, best.tolist(), (e[np.arange(len(best)), best] / e.sum(1)).tolist(), strict=True):
                    lang[i], score[i] = model.langs[k], p
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, _OUT)
