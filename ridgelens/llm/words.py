"""Vectorised words of a block of texts.

A word is a maximal run of bytes other than space and \\x09-\\x0D; these bytes never occur inside a UTF-8 sequence,
so words of the bytes are words of the code points.  Everything here works on the UTF-8 buffer of an Arrow string
column, some megabytes at a time, and never builds a Python string for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE_INV = U64(pow(int(BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators where only letters, digits and bytes above 127 count.
_MARKS = np.ones(256, bool)
_MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a block of texts: a block's arrays are some fifty times its size, and workers keep freed memory.
BLOCK = 1 << 18
_powers = {int(BASE): np.ones(1, U64), int(BASE_INV): np.ones(1, U64)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; those of blocks of the usual size are kept between calls."""
    have = _powers[int(base)]
    if len(have) < n:
        have = np.full(max(n, min(2 * len(have), BLOCK)), base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= BLOCK:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def blocks(texts: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows) of runs of rows of about `most` bytes, or of one longer row."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        j = min(j, len(texts))
        yield i, j, whole[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


class Words:
    """The words of a block: byte starts and ends, a 64-bit hash of each, and the first word of each row.

    lower: with A-Z lower-cased.  bare: ASCII marks also end words.  blank: only spaces end them.  stops: a comma or full
    stop at the end of a word, behind an ASCII letter, is a word of its own.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False, bare: bool = False, blank: bool = False, stops: bool = False):
        n = len(data)
        word = data != 32 if blank else ~(_MARKS if bare else _SPACE)[data]
        first, last = word.copy(), word.copy()
        if n:
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            inner = at[1:-1]
            inner = inner[(inner > 0) & (inner < n)]
            first[inner] = word[inner]
            last[inner - 1] = word[inner - 1]
            if stops:
                cut = np.flatnonzero(last & ~first & ((data == 44) | (data == 46)))
                cut = cut[_LETTER[data[cut - 1]]]
                first[cut], last[cut - 1] = True, True
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row_at = np.searchsorted(self.starts, at)
        data = _LOWER[data] if lower else data
        sums = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * powers(BASE, n), out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * powers(BASE_INV, n)[self.starts] + (self.ends - self.starts).astype(U64)) if n else np.zeros(0, U64)

    def windows(self, k: int) -> np.ndarray:
        """The hash of the k words from each word on; only valid where all k lie in the row."""
        h = self.hashes
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, U64)
        sums = np.zeros(len(h) + 1, U64)
        np.cumsum(h * powers(BASE, len(h)), out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * powers(BASE_INV, n) + U64(k))


class WordCache:
    """Ids of words seen before, in arrays of fixed size: a word has one slot, by its hash, and takes it from the last.

    A word is known by its 64-bit hash; what is not there is encoded again, so nothing depends on what is remembered.
    """

    def __init__(self, kind: type, bits: int = 19, room: int = 1 << 21):
        self.mask = U64((1 << bits) - 1)
        self.keys, self.starts, self.lengths = np.zeros(1 << bits, U64), np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int32)
        self.flat, self.used = np.zeros(room, kind), 0

    def __call__(self, w: Words, data: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words of a block, end to end, and how many each has.  encode: the same of a list of words."""
        slot = (w.hashes & self.mask).astype(np.int64)
        known = self.keys[slot] == w.hashes
        starts, lengths = self.starts[slot], self.lengths[slot]
        lost = np.flatnonzero(~known)
        if len(lost):
            hashes, first, back = np.unique(w.hashes[lost], return_index=True, return_inverse=True)
            raw, at = data.tobytes(), lost[first]
            ids, n = encode([raw[a:b].decode() for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)])
            more = len(ids)
            if self.used + more > len(self.flat):
                if known.any():  # full: forget all, and encode this block's words anew
                    self.keys[:] = 0
                    self.used = 0
                    return self(w, data, encode)
                self.flat, self.used = np.zeros(max(len(self.flat), 2 * more), self.flat.dtype), 0
            self.flat[self.used : self.used + more] = ids
            begin = self.used + np.concatenate([[0], np.cumsum(n)[:-1]])
            self.used += more
            own = (hashes & self.mask).astype(np.int64)
            self.keys[own], self.starts[own], self.lengths[own] = hashes, begin, n
            # two new words of one slot: the slot is the last one's, whose start and length were stored last too
            starts[lost], lengths[lost] = begin[back], n[back]
        total = np.cumsum(lengths, dtype=np.int64)
        each = np.repeat(starts - (total - lengths), lengths)
        return self.flat[each + np.arange(len(each))], lengths
