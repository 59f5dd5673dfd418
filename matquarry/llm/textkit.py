"""Vectorised token spans and hashes over Arrow string columns.

Every function works on the concatenated UTF-8 bytes of many texts, so a task handles a batch with a
fixed number of numpy passes and no Python loop over tokens.  Texts are cut into chunks of about
``CHUNK`` bytes first (a longer text is a chunk of its own), which bounds the temporaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))

_SPACE, _WORD, _PUNCT = 0, 1, 2
#: White space ends a word, everything else belongs to one.
BY_SPACE = np.ones(256, np.uint8)
BY_SPACE[[9, 10, 11, 12, 13, 32]] = _SPACE
#: Letters, digits, underscore and all non-ASCII bytes are word bytes; other ASCII is punctuation.
BY_CLASS = np.full(256, _PUNCT, np.uint8)
BY_CLASS[128:] = _WORD
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    BY_CLASS[_c] = _WORD
BY_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(21, int(n).bit_length())
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]))
        if size <= 1 << 22:
            _powers[name] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array | pa.ChunkedArray | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another and their n+1 offsets; a null counts as an empty text."""
    if isinstance(texts, list):
        off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in texts], out=off[1:])
        return np.frombuffer(b"".join(texts), np.uint8), off
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(raw: np.ndarray, off: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive runs of texts of about ``size`` bytes: (first text, end text, bytes, offsets)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(raw: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token starts, token ends, and the n+1 positions of each text's first token.

    A token is a longest run of bytes of one class other than white space; it never crosses texts.
    """
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    kind = table[raw]
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    inner = off[:-1][off[:-1] < n]
    change[inner] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], n)
    token = kind[start] != _SPACE
    start, end = start[token], end[token]
    return start, end, np.searchsorted(start, off)


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token, the same wherever the token stands."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = len(raw)
    with np.errstate(over="ignore"):
        run = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n)[:n], out=run[1:])
        return mix((run[end] - run[start]) * _power("down", _BASE_INV, n)[start] + (end - start).astype(np.uint64) * _ODD)


def grams(token: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-grams of tokens, and the positions of each text's first n-gram.

    A text with 1 to n-1 tokens has one gram of all of them; a text without tokens has none.
    """
    count = np.diff(first)
    full = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    begin = np.zeros(len(first), np.int64)
    np.cumsum(full, out=begin[1:])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], full)
    left = np.repeat(first[1:], full) - at
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            factor = np.uint64((int(_ODD) * (2 * k + 1) + (k << 33)) & (2**64 - 1) | 1)
            if k == 0:
                out += token[at] * factor
            else:
                has = left > k
                if has.all():
                    out += token[at + k] * factor
                else:
                    out[has] += token[at[has] + k] * factor
    return mix(out), begin


def shingles(raw: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text (words by ASCII white space, as written)."""
    start, end, first = spans(raw, off, BY_SPACE)
    return grams(hashes(raw, start, end), first, words)


def buckets(texts: pa.Array | list[bytes], n: int, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts with the buckets of their token grams of 1 to n tokens: (first text, end text, owner, bucket).

    Tokens are lower-cased (A-Z) runs of word bytes or of punctuation; ``owner`` counts from the first text.
    """
    raw, off = flat(texts)
    for i, j, part, at in chunks(LOWER[raw], off):
        start, end, first = spans(part, at, BY_CLASS)
        token = hashes(part, start, end)
        owners, cells = [], []
        for k in range(1, n + 1):
            if k == 1:
                gram, begin = mix(token), first
            else:
                gram, begin = grams(token, first, k)
            owners.append(np.repeat(np.arange(j - i), np.diff(begin)))
            cells.append((gram >> np.uint64(64 - bits)).astype(np.int64))
        yield i, j, np.concatenate(owners), np.concatenate(cells)
