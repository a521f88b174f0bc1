"""Vectorised word arithmetic on Arrow text columns.

A word is a maximal run of bytes other than space and 0x09-0x0D, which for UTF-8 is the same as
`[^\\x20\\x09-\\x0D]+` on code points. All functions work on one block of whole documents whose bytes lie
one after the other; a document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first 0 to 8 bytes of a little-endian word; longest word that is hashed in eights.
_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
LONG = 512


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX2
    return h ^ (h >> np.uint64(31))


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in bytes) for blocks of whole rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offs = np.frombuffer(where, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that don't cross a row's edge, and the index of each row's first run."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offs[1:-1]
    edges = edges[edges < n]
    begin[edges] = inside[edges]
    starts = np.flatnonzero(begin)
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = offs[1:-1] - 1
    last = last[last >= 0]
    end[last] = inside[last]
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def slices_of(buf: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of each run, the distinct runs): runs have equal numbers exactly if their bytes are equal; inside marks the bytes of all runs."""
    edges = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=edges[1:])
    kind, width = (pa.binary(), np.int32) if edges[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    runs = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(edges.astype(width)), pa.py_buffer(buf[inside])])
    coded = runs.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each word, as rows (n, 2): eight bytes at a time go through `mix`, in two ways; words over LONG bytes by XXH3-128."""
    wide = np.zeros(len(buf) + 8, np.uint8)
    wide[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", wide, strides=(1,))
    size = ends - starts
    out = np.empty((len(starts), 2), np.uint64)
    out[:, 0] = size
    out[:, 1] = ~out[:, 0]
    at, done = np.flatnonzero(size <= LONG), 0
    while len(at):
        part = eight[starts[at] + done] & _BYTES[np.minimum(size[at] - done, 8)]
        out[at, 0] = mix(out[at, 0] * _STEP ^ part)
        out[at, 1] = mix((out[at, 1] ^ _STEP) + part * _MIX1)
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = np.frombuffer(xxhash.xxh3_128_digest(buf[starts[i] : ends[i]].tobytes()), "<u8")
    return out


@lru_cache(8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, 1 << max(16, int(size).bit_length()))


class Hasher:
    """Polynomial hashes of slices of a sequence, modulo 2**64 over randomly drawn symbols; `seed` picks the family.

    Slices of bytes serve as features only: two chosen byte strings of 512 and more can collide. What must tell words apart
    goes by `slices_of` and `word_hashes`; runs of up to 128 words' hashes keep 2**-36 and less as chance of a collision.
    """

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(0x5EED + seed)
        self.base = int(rng.integers(1 << 62)) * 2 + 1
        self.gram = int(rng.integers(1 << 62)) * 2 + 1
        self.symbols = rng.integers(1 << 63, size=256, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)

    def sums(self, buf: np.ndarray) -> np.ndarray:
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.symbols[buf] * powers(self.base, len(buf))[0][: len(buf)], out=out[1:])
        return out

    def slices(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inv = powers(self.base, len(sums))[1]
        return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))

    def gram_sums(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(self.gram, len(words))[0][: len(words)], out=out[1:])
        return out

    def grams(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the words from starts to ends, by the sums over the words' hashes."""
        return mix((sums[ends] - sums[starts]) * powers(self.gram, len(sums))[1][starts])


def row_of(first: np.ndarray) -> np.ndarray:
    """For each run, the index of its row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n positions lie in one of the intervals."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries occur twice or more."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out
