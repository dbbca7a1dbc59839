"""Vectorised text arithmetic over Arrow string columns.

Everything works on slices of the raw UTF-8 buffer, so a batch of documents is
split into words and hashed with a fixed number of numpy passes and no loop over
words.  A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; those
bytes never occur inside a multi-byte UTF-8 sequence.

Hashes are chains: each step mixes what came before with the next eight bytes, or
two halves of a run of words, through a bijection that isn't linear in either.  So
no arrangement of symbols makes texts collide for all seeds, as it does for
polynomials modulo a power of two, and hashes with different seeds are independent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 18
#: Longer words are hashed one by one.
LONG_WORD = 128

U64 = np.uint64
_STEP = U64(0xD1342543DE82EF95)
_SEEDS = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Masks of the low n bytes.
LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply, twice)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA0761D6478BD642F)
    x ^= x >> U64(32)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number (zeros beyond the end); a view of a padded copy."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans of one length up to eight bytes never share one."""
    at8, size = eights(data), ends - starts
    out = mix(size.astype(U64) * _STEP + _SEEDS[seed])
    out = mix(out ^ (at8[starts] & LOW_BYTES[np.minimum(size, 8)]))
    at, rest = 8, np.flatnonzero((size > 8) & (size <= LONG_WORD))
    while len(rest):
        left = size[rest] - at
        out[rest] = mix(out[rest] * _STEP ^ (at8[starts[rest] + at] & LOW_BYTES[np.minimum(left, 8)]))
        at, rest = at + 8, rest[left > 8]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=bytes([seed])).digest(), "little")
    return out


def same_bytes(one: np.ndarray, one_at: np.ndarray, other: np.ndarray, other_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size[i] bytes of ``one`` from one_at[i] on are those of ``other`` from other_at[i] on (``eights`` of both)."""
    same, at, rest = np.ones(len(size), dtype=bool), 0, np.flatnonzero(size > 0)
    while len(rest):
        left = size[rest] - at
        same[rest] = ((one[one_at[rest] + at] ^ other[other_at[rest] + at]) & LOW_BYTES[np.minimum(left, 8)]) == 0
        at, rest = at + 8, rest[same[rest] & (left > 8)]
    return same


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of hashes[i:i+k] for each full run, from halves: about 2 log2(k) passes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return hashes[:0]
    out, done, level, span = None, 0, hashes, 1
    while True:
        if k & span:
            m = len(hashes) - done - span + 1
            out = level if out is None else mix(level[:m] * _STEP + out[span : span + m])
            done += span
        if 2 * span > k:
            return mix(out ^ U64(k))
        level = mix(level[:-span] * _STEP + level[span:])
        span *= 2


class Slice:
    """Consecutive documents of one batch.

    rows: index of the first document in the batch; data: their bytes; offsets:
    byte offsets of documents; starts, ends: byte span of each word;
    word_offsets: first word of each document (one more than documents).
    """

    def __init__(self, row: int, data: np.ndarray, offsets: np.ndarray, fold_case: bool = False):
        self.row, self.offsets = row, offsets
        self.data = LOWER[data] if fold_case else data

    @cached_property
    def _words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, offsets = len(self.data), self.offsets
        space = IS_SPACE[self.data]
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0] = after[-1] = True
            before[1:], after[:-1] = space[:-1], space[1:]
            inner = offsets[(offsets > 0) & (offsets < n)]
            before[inner] = True
            after[inner - 1] = True
        starts = np.flatnonzero(~space & before)
        return starts, np.flatnonzero(~space & after) + 1, np.searchsorted(starts, offsets)

    @property
    def starts(self) -> np.ndarray:
        return self._words[0]

    @property
    def ends(self) -> np.ndarray:
        return self._words[1]

    @property
    def word_offsets(self) -> np.ndarray:
        return self._words[2]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def word_hashes(self, seed: int = 0) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends, seed)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.word_offsets))


def texts(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """The column as one large_string array without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    return column.cast(pa.large_string())


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and n+1 offsets of a string column."""
    column = texts(column)
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=column.offset + n + 1)[column.offset :] if offsets is not None and n else np.zeros(n + 1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def slices(column: pa.Array | pa.ChunkedArray, fold_case: bool = False, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Whole documents, about ``limit`` bytes at a time."""
    data, offsets = raw(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield Slice(row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row], fold_case)
        row = to


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for each full window, by doubling."""
    if len(x) < width:
        return x[:0]
    span, low = 1, x
    while 2 * span <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + c) for each pair."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    heads = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(heads - starts, counts)
