"""Vectorised helpers over the byte buffer of an Arrow string column.

A batch of texts is one uint8 array plus int64 offsets. Words, their hashes and their
n-gram hashes are found for all texts of a batch at once, so that no Python object is made
per word. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; the temporary arrays take about 30 times as much.
PIECE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: True for bytes outside ASCII letters and digits; bytes of other scripts count as letters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[128:] = False
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place; a bijection of 64-bit integers."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values, the same in every process."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_keys = seeded(64, 1)


def _key(number: np.ndarray) -> np.ndarray:
    """The key of each block of a span by its number in the span."""
    global _keys
    top = int(number.max(initial=0)) + 1
    if len(_keys) < top:
        _keys = seeded(2 * top, 1)
    return _keys[number]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about `limit` bytes; one longer text comes alone."""
    data, off = buffers(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(data: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs without `gap` bytes), and the first word of each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    out = gap[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    before = cut[:-1].copy()
    before[1:] |= out[:-1]
    after = cut[1:]
    after[:-1] |= out[1:]
    inside = ~out
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def _blocks(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans' bytes in blocks of 8 (the last one filled up with zeros) as integers, each block's number in its span, and each span's first block. `padded` has 8 bytes more than the text."""
    n = np.maximum(ends - starts + 7 >> 3, 1)
    first = np.cumsum(n) - n
    number = np.arange(int(n.sum())) - np.repeat(first, n)
    at = np.repeat(starts, n) + 8 * number
    value = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))[at]
    left = np.repeat(ends, n) - at
    short = np.flatnonzero(left < 8)
    value[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
    return value, number, first


def _padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(8, np.uint8)])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span's bytes, A-Z lower-cased if asked; memory is bounded by PIECE or the longest span.

    Blocks of 8 bytes are mixed under a key for each place and summed, so spans of equal length up to 8 bytes never share a hash, and longer ones do by
    chance alone (2 ** -64 a pair). What gives out results for a span by its hash compares the bytes as well (same_spans).
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + PIECE, "right")))
        piece = data[a : int(ends[i:j].max())]
        s, e = starts[i:j] - a, ends[i:j] - a
        value, number, first = _blocks(_padded(LOWER[piece] if lower else piece), s, e)
        value ^= _key(number)
        out[i:j] = np.add.reduceat(mix(value), first) + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        i = j
    return mix(out)


def same_spans(one: np.ndarray, starts: np.ndarray, ends: np.ndarray, two: np.ndarray, starts2: np.ndarray, ends2: np.ndarray) -> np.ndarray:
    """Whether the k-th span of `one` and that of `two` hold the same bytes."""
    same = ends - starts == ends2 - starts2
    at = np.flatnonzero(same)
    one, two = _padded(one), _padded(two)
    size = np.cumsum(ends[at] - starts[at])
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(size, size[i] + PIECE, "right")))
        k = at[i:j]
        a, _, first = _blocks(one, starts[k], ends[k])
        b, _, _ = _blocks(two, starts2[k], ends2[k])
        same[k] = np.logical_and.reduceat(a == b, first)
        i = j
    return same


def ngrams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows inside each text, and the first window of each text."""
    count = np.diff(first)
    per = np.maximum(count - n + 1, 0)
    at = np.zeros(len(first), np.int64)
    np.cumsum(per, out=at[1:])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    whole = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        whole *= np.uint64(0xD6E8FEB86659FD93)
        whole += words[k : len(words) - n + 1 + k]
    pos = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], per)
    return mix(whole[pos]), at


def window_positions(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The word at which each window of ngrams() starts."""
    return np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], np.diff(at))


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s:s+n] of all (s, n), one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]
