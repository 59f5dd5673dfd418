"""Packed token ids of whole texts from the ids of their pieces, for byte-level BPE patterns.

A piece is one match of the split pattern; its ids don't depend on what stands around it.  A task remembers
the ids of pieces and of space-separated units, so frequent words are looked up and not encoded again.
"""

from __future__ import annotations

import gc
import re
import struct
import unicodedata
from collections.abc import Callable, Sequence

import regex

#: Pieces, and units, that a task remembers at most (when full, it starts anew), and their longest size.
MEMO, LONGEST = 700_000, 48
#: Texts below this code point are split by the standard library.
LATIN = 0x250
#: White space that a text must not hold for its units to be the pieces' own: runs, or rarer kinds.
_ODD_SPACE = ("  ", "\n\n", " \n", "\n ", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0")


_BEYOND = re.compile(f"[^\0-{chr(LATIN - 1)}]").search


def _plain(pattern: str) -> Callable[[str], list[str]] | None:
    """The pattern for the standard library's faster matcher, for texts of code points below ``LATIN``.

    Its classes of letters, numbers and white space are spelled out from the Unicode tables.
    """
    points = [chr(i) for i in range(LATIN)]
    of = lambda kind: "".join(re.escape(c) for c in points if unicodedata.category(c)[0] == kind)
    classes = {r"\p{L}": of("L"), r"\p{N}": of("N"), r"\s": r"\t\n\x0b\x0c\r \x85\xa0"}
    for name, chars in classes.items():
        # Inside brackets the class is named bare, elsewhere it stands for a set of its own.
        pattern = re.sub(r"\[\^([^\]]*)\]", lambda m, n=name, c=chars: "[^" + m[1].replace(n, c) + "]", pattern)
        head, *rest = re.split(re.escape(name) + r"(?![^\[]*\])", pattern)
        pattern = head + "".join(f"[{chars}]{x}" for x in rest)
    pattern = pattern.replace(r"\S", f"[^{classes[r'\s']}]")
    return None if re.search(r"\\p\{|\\[wWdDbB]", pattern) else re.compile(pattern).findall


class _Memo(dict):
    def __init__(self, compute: Callable[[str], bytes]) -> None:
        self.compute = compute

    def __missing__(self, key: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        value = self.compute(key)
        if len(key) <= LONGEST:
            self[key] = value
        return value


class Packer:
    """``encode`` gives the ids of one piece; ``packed`` those of a text, as little-endian unsigned 32-bit integers."""

    def __init__(self, pattern: str, encode: Callable[[str], Sequence[int]]) -> None:
        # The memos hold many small objects and no cycles; the collector need not walk them so often.
        gc.set_threshold(100_000, 50, 1000)
        self.any_text = regex.compile(pattern).findall
        self.latin_text = _plain(pattern) or self.any_text
        self.piece = _Memo(lambda x: struct.pack(f"<{len(ids := encode(x))}I", *ids))
        self.bare = _Memo(lambda x: b"".join(map(self.piece.__getitem__, self.latin_text(x))))
        self.spaced = _Memo(lambda x: self.bare.compute(" " + x))

    def packed(self, text: str) -> bytes:
        if _BEYOND(text):
            return b"".join(map(self.piece.__getitem__, self.any_text(text)))
        if any(x in text for x in _ODD_SPACE):
            return b"".join(map(self.piece.__getitem__, self.latin_text(text)))
        # Single spaces and line ends between words: a space starts a piece, a line end is one.
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(self.bare[first] + b"".join(map(self.spaced.__getitem__, rest)))
        return self.bare["\n"].join(lines)
