"""SuperMinHash signatures of shingle sets, vectorised over a batch of documents.

Each element draws, level by level, a random value in [level, level + 1) for the next slot of its own random permutation
of the slots (a Fisher-Yates walk seeded by the element's hash); a slot keeps the least value it is given.  The slots of an
element are so a permutation and not independent draws, which makes the estimate's variance lower than MinHash's.  A
document stops at the first level that fills its last slot: later levels can't lower any value.
"""

from __future__ import annotations

import numpy as np

from millrace.llm.tokens import LOWER, U64, WORD_BASE, Words, mix

#: Bits of a value below its level; level and value share 32 bits.
VALUE_BITS = 25
EMPTY = np.uint32(0xFFFFFFFF)
#: Rows whose shingles are sorted together: the row takes the top bits of a sort key, the hash the rest.
ROWS = 1024
ROW_BITS = 10


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct k-word shingle (ASCII letters lower-cased) of each text, sorted by both.

    A text of 1 to k-1 words has one shingle, its whole word sequence; one without words has none.  At most ROWS texts.
    """
    words = Words(texts, table=LOWER)
    at, h = words.windows(k)
    row = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        first, n = words.first[short], words.count[short]
        whole = np.zeros(len(short), dtype=U64)
        for j in range(k - 1):
            more = n > j
            whole[more] = whole[more] * U64(WORD_BASE) + words.hash[first[more] + j]
        h = np.concatenate([h, mix(whole + n.astype(U64))])
        row = np.concatenate([row, short])
    key = (row.astype(U64) << U64(64 - ROW_BITS)) | (h >> U64(ROW_BITS))
    key = np.sort(key)
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> U64(64 - ROW_BITS)).astype(np.int64), key << U64(ROW_BITS)


def signatures(row: np.ndarray, elements: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """Signature (m slots of 32 bits) of each row's set; rows without elements keep EMPTY in every slot."""
    sig = np.full(n_rows * m, EMPTY, dtype=np.uint32)
    open_rows = np.zeros(n_rows, dtype=bool)
    open_rows[row] = True
    seed, level = mix(elements), 0
    walks: list[np.ndarray] = []
    order: np.ndarray | None = None
    while len(row) and level < m:
        draw = mix(seed + U64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = (np.uint32(level) << np.uint32(VALUE_BITS)) | (draw >> U64(64 - VALUE_BITS)).astype(np.uint32)
        k = level + (((draw & U64(0xFFFFFFFF)) * U64(m - level)) >> U64(32)).astype(np.int64)
        if level == 0:
            slot = k
        elif level == 1:  # all that the first step moved is place 0
            slot = np.where(k == walks[0], 0, k)
        else:
            if order is None:
                order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(row), 1))
                each = np.arange(len(row))
                for j, w in enumerate(walks):
                    order[each, w] = order[:, j]
            each = np.arange(len(row))
            slot = order[each, k].astype(np.int64)
            order[each, k] = order[:, level]
        place = row * m + slot
        lower = value < sig[place]
        np.minimum.at(sig, place[lower], value[lower])
        if level < 2:
            walks.append(k)
        open_rows &= (sig.reshape(n_rows, m) == EMPTY).any(axis=1)
        alive = open_rows[row]
        if not alive.all():
            row, seed = row[alive], seed[alive]
            walks = [w[alive] for w in walks]
            order = order[alive] if order is not None else None
        level += 1
    return sig.reshape(n_rows, m)


def set_digests(row: np.ndarray, elements: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and a 128-bit digest (two order-free sums) of each row's set."""
    size = np.bincount(row, minlength=n_rows)
    starts = np.concatenate([[0], np.cumsum(size)])
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        sums = np.zeros(len(row) + 1, dtype=U64)
        np.cumsum(mix(elements ^ U64(salt)), out=sums[1:])
        out.append(sums[starts[1:]] - sums[starts[:-1]])
    return size, out[0], out[1]


def odd_sketches(row: np.ndarray, elements: np.ndarray, n_rows: int, words: int) -> np.ndarray:
    """For each row, the parity of the elements that fall on each of 64 * words bits, as 64-bit words."""
    bits = 64 * words
    place = row * bits + (mix(elements ^ U64(0xA0761D6478BD642F)) % U64(bits)).astype(np.int64)
    parity = (np.bincount(place, minlength=n_rows * bits) & 1).astype(bool)
    return np.packbits(parity.reshape(n_rows, bits), axis=1).view(U64)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; keys of different bands never meet but by chance."""
    n, m = sig.shape
    out = np.zeros((n, bands), dtype=U64)
    parts = sig.reshape(n, bands, m // bands)
    out += np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
    for j in range(m // bands):
        out = mix(out + parts[:, :, j].astype(U64))
    return out
