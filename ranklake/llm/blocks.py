"""Whole texts of Arrow batches as bounded blocks of bytes, cut into hashed words with numpy.

Used inside ``mapInArrow`` tasks.  Texts arrive as UTF-8 bytes (``cast('binary')``); a block
holds about ``BLOCK_BYTES`` of them, or one longer text, so memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_A, _Z = ord("A"), ord("Z")
#: Lower-cases A-Z, leaves all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[_A : _Z + 1] += 32

#: Words between white space: [^\x20\x09-\x0D]+
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of ASCII letters, digits and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once lower-cased
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]


class _Powers:
    """Tables of powers that this process has made; the code of a task travels without them."""

    def __init__(self):
        self.tables: dict[str, np.ndarray] = {}

    def __reduce__(self):
        return _Powers, ()


_powers = _Powers()


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2^64; kept, and made longer when a longer text comes."""
    have = _powers.tables.get(name)
    if have is None or len(have) < n:
        size = max(n, 2 * BLOCK_BYTES)
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        have = _powers.tables[name] = np.multiply.accumulate(table)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    return h


@dataclass
class Block:
    """Rows ``lo`` to ``hi`` of a batch: their bytes, and where each text begins."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """A binary column in blocks; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(column))
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Words of a block in order; ``first[i]`` is the index of text i's first word."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray | None
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(block: Block, kind: np.ndarray, hashed: bool = True) -> Words:
    """Words as maximal runs of bytes of a ``kind``, A-Z lower-cased for the hash."""
    data, n = block.data, len(block.data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(block.offsets), np.int64))
    inside = kind[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = block.offsets[:-1][block.offsets[:-1] < n]
    before[cuts] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    h = None
    if hashed:
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_VALUES[data] * _power("base", _BASE, n), out=sums[1:])
        h = mix((sums[end] - sums[start]) * _power("inverse", _INVERSE, n)[start])
    return Words(start, end, h, np.searchsorted(start, block.offsets))


def joined_words(block: Block, found: Words, kind: np.ndarray) -> list[bytes]:
    """Each text as its words, lower-cased and joined by single blanks (one more may follow the last)."""
    inside = kind[block.data]
    shown = np.where(inside, LOWER[block.data], 0x20).astype(np.uint8)
    # The byte after a word becomes the blank, unless the text ends there.
    inside[found.end[~np.isin(found.end, block.offsets)]] = True
    bounds = zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist())
    return [shown[lo:hi][inside[lo:hi]].tobytes() for lo, hi in bounds]


def word_hash(word: str | bytes) -> int:
    """The hash that :func:`words` gives to this word."""
    raw = word.encode() if isinstance(word, str) else word
    data = np.frombuffer(raw, np.uint8)
    return int(mix((_VALUES[data] * _power("base", _BASE, len(data))).sum(dtype=np.uint64)[None])[0])


def chain(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values; len(h) - size + 1 of them."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= np.uint64(_BASE)
        out += h[k : k + n]
    return mix(out)


def shingle_sets(found: Words, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; with fewer words, the whole sequence as one."""
    runs, sets = chain(found.hash, size), []
    for lo, hi in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
        if hi - lo >= size:
            own = np.sort(runs[lo : hi - size + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif hi > lo:
            own = chain(found.hash[lo:hi], hi - lo) ^ np.uint64(hi - lo)
        else:
            own = np.zeros(0, np.uint64)
        sets.append(own)
    return sets
