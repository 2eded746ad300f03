"""Vectorised word and window hashing shared by the text operators.

A batch of documents is laid out as one byte buffer.  Rolling (Rabin-Karp) prefix sums modulo 2**64 give the hash of any
byte range in constant time, so hashing every word, or every prefix of every word, costs a few array operations instead of
a Python loop.  Words are maximal runs of bytes outside a separator set; separators are ASCII, so UTF-8 needs no decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Multipliers of the two polynomial hashes: odd, so that they have an inverse modulo 2**64.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
#: Separators of a word `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that are worked on at once, unless one text is longer.
PIECE_BYTES = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between batches up to twice the usual length."""
    if base in _powers and len(_powers[base]) >= n:
        return _powers[base][:n]
    steps = np.full(n if n > 2 * PIECE_BYTES else 2 * PIECE_BYTES, base, dtype=U64)
    steps[0] = 1
    out = np.cumprod(steps, dtype=U64)
    if n <= 2 * PIECE_BYTES:
        _powers[base] = out
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits (a bijection on 64-bit values)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words:
    """Words of a batch of texts: byte ranges, hashes and the document that each belongs to.

    Attributes: buf (bytes as uint8), start/end (byte range of each word), doc (row of each word), first (index of the first
    word of each row, with one more entry for the end) and hash (64 bits of each word).
    """

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACE, table: np.ndarray | None = None) -> None:
        raw = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(raw, dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.offset = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(lengths + 1, out=self.offset[1:])
        self.raw = raw
        self.buf = buf if table is None else table[buf]
        gap = separators[buf]
        inside = np.empty(len(gap) + 1, dtype=bool)
        inside[0] = False
        np.logical_not(gap, out=inside[1:])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.offset)
        self.count = np.diff(self.first)
        self._sums: np.ndarray | None = None

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def range_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes start..end of the (folded) buffer, the same wherever they stand."""
        n = len(self.buf)
        if self._sums is None:
            self._sums = np.zeros(n + 1, dtype=U64)
            np.cumsum((self.buf.astype(U64) + U64(1)) * powers(BYTE_BASE, n), out=self._sums[1:])
        back = powers(pow(BYTE_BASE, -1, 1 << 64), n + 1)[start]
        return mix((self._sums[end] - self._sums[start]) * back + (end - start).astype(U64))

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            self._hash = self.range_hash(self.start, self.end)
            self._sums = None
        return self._hash

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of every window of k words inside one document, in order."""
        h = self.hash
        n = len(h) - k + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=U64)
        rolled = np.zeros(n, dtype=U64)
        for j in range(k):
            rolled *= U64(WORD_BASE)
            rolled += h[j : j + n]
        fits = np.arange(n) + k <= np.repeat(self.first[1:], self.count)[:n]
        at = np.flatnonzero(fits)
        return at, mix(rolled[at])


def encoded(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of a text column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def ranges(lengths: np.ndarray, limit: int = PIECE_BYTES, rows: int = 1 << 30) -> list[tuple[int, int]]:
    """Row ranges of about `limit` bytes and at most `rows` rows; a longer text stands alone."""
    out, begin, size = [], 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > begin and (size + n > limit or i - begin == rows):
            out.append((begin, i))
            begin, size = i, 0
        size += n + 1
    if begin < len(lengths):
        out.append((begin, len(lengths)))
    return out


def pieces(column: pa.ChunkedArray | pa.Array, limit: int = PIECE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of a text column and their texts as UTF-8 (null is empty), so that a batch's work arrays stay small."""
    lengths = np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64)
    for begin, end in ranges(lengths, limit, rows):
        yield begin, end, encoded(column.slice(begin, end - begin))
