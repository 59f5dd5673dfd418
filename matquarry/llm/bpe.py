"""Byte-level BPE encoding and decoding by monoid tree reduction.

A piece (one match of the split pattern) is encoded by halves, recursively.  Two neighbouring encodings are
joined by re-encoding a window around their boundary.  Two adjacent tokens are *stable* when encoding their
joined bytes gives the same two tokens; an encoding is right exactly when all its adjacent pairs are stable.
So a window is grown, on the side that fails, until the pairs at both of its ends are stable; tokens outside
cannot change.  Joining is associative, with the empty encoding as unit.  Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces, shared

#: Pieces of up to so many bytes are leaves; leaves are encoded by merging the lowest rank first.
LEAF = 12
#: Leaves and pairs that a task remembers at most (when full, it starts anew), and the longest leaf in bytes.
MEMO, LONGEST = 400_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file, which every executor has at ``path``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        size = np.zeros(max(self.token) + 1, np.int64)
        for i, x in self.token.items():
            size[i] = len(x)
        self.size, self.begin = size, np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(len(size))), np.uint8)
        self.stable: dict[tuple[int, int], bool] = {}
        self.packed = pieces.Packer(pattern, lambda x: self.piece(x.encode())).packed
        self.leaves: dict[bytes, tuple[int, ...]] = {}

    def leaf(self, raw: bytes) -> tuple[int, ...]:
        if (known := self.leaves.get(raw)) is None:
            known = self.merged(raw)
            if len(self.leaves) >= MEMO:
                self.leaves.clear()
            if len(raw) <= LONGEST:
                self.leaves[raw] = known
        return known

    def merged(self, raw: bytes) -> tuple[int, ...]:
        """Lowest rank first, leftmost of equal ranks: the definition, for short inputs."""
        get, none = self.ranks.get, 1 << 60
        parts = [raw[i : i + 1] for i in range(len(raw))]
        of_pair = [get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while of_pair and (best := min(of_pair)) != none:
            i = of_pair.index(best)
            parts[i] += parts.pop(i + 1)
            of_pair.pop(i)
            if i:
                of_pair[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(of_pair):
                of_pair[i] = get(parts[i] + parts[i + 1], none)
        return tuple(map(self.ranks.__getitem__, parts))

    def pair(self, a: int, b: int) -> bool:
        key = (a, b)
        if (known := self.stable.get(key)) is None:
            if len(self.stable) >= MEMO:
                self.stable.clear()
            known = self.stable[key] = self.leaf(self.token[a] + self.token[b]) == (a, b)
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right:
            return left or right
        if self.stable.get((left[-1], right[0])) or self.pair(left[-1], right[0]):
            return left + right
        i, j, step_i, step_j = len(left) - 1, 1, 1, 1
        while True:
            mid = self.leaf(b"".join(map(self.token.__getitem__, left[i:] + right[:j])))
            low = i == 0 or self.pair(left[i - 1], mid[0])
            high = j == len(right) or self.pair(mid[-1], right[j])
            if low and high:
                return left[:i] + mid + right[j:]
            if not low:
                i, step_i = max(0, i - step_i), 2 * step_i
            if not high:
                j, step_j = min(len(right), j + step_j), 2 * step_j

    def piece(self, raw: bytes) -> tuple[int, ...]:
        if raw in self.ranks:
            return (self.ranks[raw],)
        if len(raw) <= LEAF:
            return self.leaf(raw)
        # Bottom-up over equal leaves: the same tree without Python's recursion limit.
        level = [self.leaf(raw[k : k + LEAF]) for k in range(0, len(raw), LEAF)]
        while len(level) > 1:
            level = [self.join(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """Concatenates the tokens' bytes at the offsets that the sums of their lengths give."""
        size = self.size[ids]
        end = np.cumsum(size)
        shift = self.begin[ids] - (end - size)
        return self.bytes[np.arange(end[-1] if len(end) else 0) + np.repeat(shift, size)].tobytes()


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    if (key := (path, pattern)) not in _encoders:
        _encoders[key] = Encoder(read_ranks(path), pattern)
    return _encoders[key]


def _map(df: DataFrame, schema: str, names: list[str], f: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(f(b), names=names)

    shared.bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``df`` and the ids of ``text`` as binary (little-endian unsigned 32-bit integers).

    A null or empty text has no ids.  A column named as ``out`` is replaced.
    """

    def ids(s):
        import pandas as pd

        e = encoder(path, pattern)
        return pd.Series([e.packed(x or "") for x in s], dtype=object)

    shared.bounded_batches(df.sparkSession)
    return df.withColumn(out, F.pandas_udf(ids, "binary")(F.col(text)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """The inverse of ``encode``; bytes that are no UTF-8 decode with replacement characters."""

    def texts(s):
        import pandas as pd

        e = encoder(path, pattern)
        return pd.Series([e.decode(np.frombuffer(x or b"", "<u4")).decode("utf-8", "replace") for x in s], dtype=object)

    shared.bounded_batches(df.sparkSession)
    return df.withColumn(out, F.pandas_udf(texts, "string")(F.col(ids)))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, without a shuffle.

    A null text counts as empty (no tokens).  Each row is handled alone, so repeated rows give repeated results.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def f(b: pa.RecordBatch) -> list[pa.Array]:
        e = encoder(path, pattern)
        n, ids_sha, text_sha = [], [], []
        for text in b.column("text"):
            ids = e.packed(text.as_py() or "")
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(e.decode(np.frombuffer(ids, "<u4"))).hexdigest())
        return [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

    return _map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", names, f)
