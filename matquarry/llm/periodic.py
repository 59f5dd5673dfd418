"""Periodic runs of words: stretches that repeat with some smallest period, at four times or more.

A run is a longest stretch of consecutive words of one text in which words ``q`` apart are equal, ``q`` being the
smallest such number, of at least ``max(SHORTEST, TIMES * q)`` words.  Words are separated by ASCII white space.

Periods up to ``DIRECT`` are found by comparing the text with itself at each lag.  Longer ones are found scale by
scale.  At the scale of periods ``K/2 < q <= K`` every place has the hash of its ``K`` following words, and the least
hash of each ``K/2`` consecutive places is a minimizer.  Inside a run the hashes of ``q`` consecutive places all
differ and the windows repeat ``q`` further on, so a minimizer is followed by an equal one at distance ``q`` exactly,
and a run of four periods is long enough to hold such a pair.  Equal neighbours of a scale are therefore all seeds;
each is extended both ways by comparing hashes of longer and longer stretches.  Runs are verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, textkit

SHORTEST, TIMES, DIRECT = 6, 4, 8
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _at_lag(x: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches with equal places ``lag`` apart that are long enough for a run."""
    if len(x) <= lag:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.flatnonzero(x[lag:] == x[:-lag])
    breaks = np.flatnonzero(np.diff(same) > 1)
    start = same[np.concatenate([[0], breaks + 1])] if len(same) else same
    end = same[np.concatenate([breaks, [-1]])] + 1 + lag if len(same) else same
    long = end - start >= max(SHORTEST, TIMES * lag)
    return start[long], end[long]


def _sliding(h: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of each ``width`` (a power of two) consecutive values."""
    step = 1
    while step < width:
        h = pick(h[:-step], h[step:])
        step *= 2
    return h


def _seeds(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring minimizers of equal hash whose distance belongs to the scale ``k``: places and distances."""
    w = k // 2
    least = _sliding(h, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), w, np.maximum) == h)
    order = np.argsort(h[chosen], kind="stable")
    chosen = chosen[order]
    gap = np.diff(chosen)
    pair = np.flatnonzero((h[chosen[1:]] == h[chosen[:-1]]) & (gap > w) & (gap <= k))
    return chosen[pair], gap[pair]


def _extended(x: np.ndarray, at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far places ``lag`` apart stay equal to the left and right of each seed, by bisection on hashes."""
    n = len(x)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(x * power[:-1], out=run[1:])
        shift = power[lag]

        def reach(most: np.ndarray, way: int) -> np.ndarray:
            low, high = np.zeros(len(at), np.int64), most
            while (open_ := low < high).any():
                mid = (low + high + 1) // 2
                a, b = (at, at + mid) if way > 0 else (at - mid, at)
                equal = (run[b] - run[a]) * shift == run[b + lag] - run[a + lag]
                low, high = np.where(open_ & equal, mid, low), np.where(open_ & ~equal, mid - 1, high)
            return low

        return at - reach(at.copy(), -1), at + lag + reach(n - at - lag, 1)


def find(words: np.ndarray, first: np.ndarray, exact: bool = False) -> list[np.ndarray]:
    """The runs of each text: rows of start, length, period, by start and period.

    ``words`` has the 64-bit hashes of the words of all texts and ``first`` the n+1 places of each text's first
    word.  With ``exact`` seeds aren't extended by hashes, but by comparing the text with itself at their lags.
    """
    count = np.diff(first)
    order = np.argsort(count, kind="stable")  # texts long enough for a scale stand last
    count = count[order]
    if not len(count) or count[-1] < SHORTEST:
        return [np.zeros((0, 3), np.int64)] * len(count)
    begin = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count + 1, out=begin[1:])  # a word of its own ends each text
    x = textkit.mix(np.arange(1, begin[-1] + 1, dtype=np.uint64) | np.uint64(1 << 63))
    inside = np.arange(first[-1] - first[0]) - np.repeat(begin[:-1] - np.arange(len(count)), count)
    x[inside + np.repeat(begin[:-1], count)] = words[inside + np.repeat(first[:-1][order], count)]
    found = []

    def keep(base: int, start: np.ndarray, end: np.ndarray, lag: np.ndarray | int) -> None:
        lag = np.broadcast_to(np.asarray(lag, np.int64), start.shape)
        long = end - start >= np.maximum(SHORTEST, TIMES * lag)
        found.append(np.stack([start[long] + base, end[long] + base, lag[long]], 1))

    def rest(least: int) -> int:
        """Where the texts of at least so many words begin."""
        return int(begin[np.searchsorted(count, least)])

    for lag in range(1, DIRECT + 1):
        base = rest(max(SHORTEST, TIMES * lag))
        keep(base, *_at_lag(x[base:], lag), lag)
    k, h, done = 1, x, 0
    while TIMES * (k + 1) <= count[-1]:
        with np.errstate(over="ignore"):
            h = textkit.mix(h[:-k] * _STEP + h[k:])
        k *= 2
        if k <= DIRECT:
            continue
        base = rest(TIMES * (k // 2 + 1))
        h, done = h[base - done :], base
        at, lag = _seeds(h, k)
        if exact:
            for one in np.unique(lag):
                keep(base, *_at_lag(x[base:], int(one)), one)
        elif len(at):
            keep(base, *_extended(x[base:], at, lag), lag)
    runs = np.unique(np.concatenate(found), axis=0)
    # A stretch found at a multiple of its period is the same stretch, so of each stretch the least lag counts.
    runs = runs[np.append(True, (np.diff(runs[:, :2], axis=0) != 0).any(1))[: len(runs)]]
    place = np.searchsorted(begin, runs[:, 0], "right") - 1
    runs = np.stack([runs[:, 0] - begin[place], runs[:, 1] - runs[:, 0], runs[:, 2]], 1)
    sort = np.lexsort((runs[:, 2], runs[:, 0], place))
    parts = np.split(runs[sort], np.searchsorted(place[sort], np.arange(1, len(count))))
    out: list[np.ndarray] = [parts[0]] * len(count)
    for to, part in zip(order.tolist(), parts, strict=True):
        out[to] = part
    return out


def _checked(words: list[bytes], runs: np.ndarray) -> np.ndarray:
    """The runs, if they hold word by word; else those found again from numbers of the words instead of hashes."""
    if all(words[s : s + n - q] == words[s + q : s + n] for s, n, q in runs.tolist()):
        return runs
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    return find(textkit.mix(ids), np.array([0, len(ids)]), exact=True)[0]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, without those that a run repeats after its first period."""
    if not len(runs):
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()])


RUNS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def detect(df: DataFrame, text: str = "text", into: str = "repeats") -> DataFrame:
    """All columns of ``df`` and ``into``: number of words, the runs of words (spans) and the text without repeats.

    A null or empty text, or one of white space, has no words, no runs and an empty collapsed text; repeated rows
    have equal results.  A column that is named ``into`` is replaced.  Texts are worked through in pieces of about
    1 MB, a longer text alone, so memory is linear in the longest text.
    """
    shared.bounded_batches(df.sparkSession)

    def found(texts: pa.Array) -> pa.StructArray:
        raw, off = textkit.flat(texts)
        sizes, spans, out = [], [], []
        for _, _, part, at in textkit.chunks(raw, off):
            start, end, first = textkit.spans(part, at, textkit.BY_SPACE)
            data = part.tobytes()
            for a, b, runs in zip(at[:-1].tolist(), at[1:].tolist(), find(textkit.hashes(part, start, end), first), strict=True):
                words = data[a:b].split()
                runs = _checked(words, runs)
                sizes.append(len(words))
                spans.append(runs)
                out.append(collapsed(words, runs))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in spans])])
        rows = np.concatenate([np.zeros((0, 3), np.int64), *spans])
        runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(rows[:, i].copy()) for i in range(3)], fields=list(_RUN)))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), runs, pa.array(out, pa.binary()).cast(pa.string())], names=["n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found(b.column(b.num_columns - 1))], names=[*b.schema.names[:-1], into])

    rest = df.drop(into)
    schema = T.StructType([*rest.schema.fields, T.StructField(into, T.StructType.fromDDL(RUNS))])
    return rest.withColumn(into, F.col(text).cast("string")).mapInArrow(run, schema)


def best(runs: Column) -> Column:
    """The run with the greatest length/period, compared exactly; of equals the first by start, then period."""
    first = F.get(runs, F.lit(0))
    return F.reduce(runs, first, lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))


def tandem(doc_id: Column, text: Column) -> Column:
    """The text of one document in ten with its end replaced by copies of one stretch, by a hash of its doc_id.

    With ``h = crc32(doc_id)``, ``g = h div 10`` and ``n`` words: if ``h`` is divisible by 10, the words from
    ``a = g mod n`` on repeat the first ``1 + (n - a) div (3 + g mod 8)`` of them.  Other texts, and all with a null
    doc_id, stay as they are.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))

    def repeated(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i)))))

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    # The words are bound once, or each place would split the text again.
    changed = F.get(F.transform(F.array(words), repeated), F.lit(0))
    return F.when(h % 10 == 0, changed).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    """For each document the number of its runs, its best run and digests of all runs and of the collapsed text."""
    texts = docs.select(F.col("doc_id").cast("long"), tandem(F.col("doc_id"), F.col("text").cast("string")).alias("text"))
    found = detect(texts).select("doc_id", "repeats.*").withColumn("best", best(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start"),
        F.col("best.length"),
        F.col("best.period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda s: F.concat(s, F.lit("\n")))).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
