"""Lossless bit streams with one code group: prefix-code headers, units, pixels.

A coded image is a row (image_id, data, at, width, height): at is the bit of data where its cache flag stands. Streams are split at fixed places and read speculatively:

* read_header() reads the cache flag and the five codes of many images side by side, in at most as many steps for a code as its alphabet has symbols. A code goes on as the lengths of its symbols, a byte each.
* units(): every bit offset of a piece might begin a unit (a literal, a copy or a cache reference). For each offset the unit and its end are looked up side by side, whatever piece it lies in, and by pointer doubling
  each of the first ENTRY offsets of a piece is followed to where it leaves it. These exits, a short array for each piece, are composed along each image in log rounds over pieces, which tells the offset
  at which each piece is really entered; from there pointer doubling marks its real units. No task reads a stream from its start to its end.
* pixels(): units become pixels; copies are followed to what they copy from by pointer doubling over all images.

An image fails with the stage of its first bad unit, as a reader's does; streams with several code groups fail in stage `meta-flag` here. Null data or sizes below 1 fail in `header`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pixels as P
from ..functions.tables import LENGTH_ORDER
from ..session import written
from . import bits, lossless

LITERALS, LENGTHS, DISTANCES = 256, 24, 40
#: The longest unit: two codes of 15 bits, 10 extra bits of a length and 18 of a distance; or four codes.
ENTRY, REGION, CHANNELS = 64, 6144, ("green", "red", "blue", "alpha", "distance")


def _taken(region: np.ndarray, begin: np.ndarray, room: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each image n (0 to 16) bits from its bit `at` on; 0 if fewer than n are there. region: the bytes of all images, begin: where each one's begin."""
    k = np.minimum(begin + (at >> 3), len(region) - 3)
    v = region[k].astype(np.int64) | region[k + 1].astype(np.int64) << 8 | region[k + 2].astype(np.int64) << 16
    return np.where(at + n > room, 0, v >> (at & 7) & ((1 << n) - 1))


#: Of the symbols 0 to 18 of a code of lengths: how many bits follow, and the least length of a run.
_EXTRA, _LEAST = np.array([0] * 16 + [2, 3, 7]), np.array([1] * 16 + [3, 3, 11])
_SEVEN = np.array([int(f"{v:07b}"[::-1], 2) for v in range(128)])


def _read_code(take, room: np.ndarray, p: np.ndarray, size: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One prefix code for each image, read at its bit p, of an alphabet of `size` symbols: (the bit behind it, stage, lengths of the symbols).

    A simple code has one or two symbols. A normal one has a code of lengths, then lengths and runs of them until the alphabet is full or max_symbol symbols are read; a run past the alphabet fails it, as do
    over-full codes and codes without symbols. The images take their steps together, at most as many as the alphabet has symbols.
    """
    rows = np.arange(len(p))
    stage, lengths = np.full(len(p), None, object), np.zeros((len(p), widest), np.uint8)
    simple, two, wide = take(rows, p, 1) == 1, take(rows, p + 1, 1), np.where(take(rows, p + 2, 1) == 1, 8, 1)
    first, second = take(rows, p + 3, wide), take(rows, p + 3 + wide, 8)
    stage[simple & (two == 1) & (second >= size)] = "huffman-simple-second-symbol"
    stage[simple & (first >= size)] = "huffman-simple-first-symbol"
    for which, symbol in ((simple & (first < size), first), (simple & (two == 1) & (second < size), second)):
        lengths[rows[which], symbol[which]] = 1
    end = np.where(simple, p + 3 + wide + 8 * two, p)
    # The code of lengths: its symbols in order of length, each as often as it has windows of 7 bits
    many = take(rows, p + 1, 4) + 4
    own = np.zeros((len(p), 19), np.int64)
    for k, s in enumerate(LENGTH_ORDER):
        own[:, s] = np.where(k < many, take(rows, p + 5 + 3 * k, 3), 0)
    share = np.where(own > 0, 128 >> own, 0)
    coded, space = (own > 0).sum(axis=1), share.sum(axis=1)
    alone = coded == 1
    good = (coded > 0) & (alone | (space <= 128))
    share[~good] = 0
    order = np.argsort(np.where(own > 0, own, 8), axis=1, kind="stable")
    held = np.concatenate([order * 8 + np.take_along_axis(own, order, 1), np.zeros((len(p), 1), np.int64)], axis=1)
    times = np.concatenate([np.take_along_axis(share, order, 1), 128 - share.sum(axis=1, keepdims=True)], axis=1)
    windows = np.repeat(held.ravel(), times.ravel()).reshape(-1, 128)
    windows[alone] = held[alone, :1] & ~7  # reads no bits
    q = p + 5 + 3 * np.minimum(many, 19)
    flag = take(rows, q, 1) == 1
    nb = np.where(flag, 2 + 2 * take(rows, q + 1, 3), 0)
    most = np.where(flag, 2 + take(rows, q + 4, nb), size)
    stage[~simple & (most > size)] = "huffman-max-symbol-range"
    stage[~simple & ~good] = "huff-build-overfull"
    stage[~simple & (coded == 0)] = "huff-build-all-zero"
    at, place, prev = np.where(flag, q + 4 + nb, q + 1), np.zeros(len(p), np.int64), np.full(len(p), 8)
    go, step, runs = rows[~simple & (stage == None)], 0, []  # noqa: E711
    end[go] = at[go]
    while len(go):
        here = at[go]
        left = np.maximum(0, room[go] - here)
        x = windows[go, _SEVEN[take(go, here, np.minimum(7, left))]]
        symbol, n = x >> 3, x & 7
        unread = ~alone[go] & ((n == 0) | (n > left))
        stage[go[unread]] = "huffman-code-length-symbol"
        go, here, symbol = go[~unread], (here + n)[~unread], symbol[~unread]
        w = _EXTRA[symbol]
        times = _LEAST[symbol] + take(go, here, w)
        fill = np.where(symbol < 16, symbol, np.where(symbol == 16, prev[go], 0))
        runs.append(np.stack([go, place[go], times, fill])[:, (fill > 0) & (place[go] + times <= size[go])])
        at[go] = end[go] = here + np.where(here + w > room[go], 0, w)
        prev[go] = np.where((symbol > 0) & (symbol < 16), symbol, prev[go])
        place[go] += times
        stage[go[place[go] > size[go]]] = "huffman-repeat-range"
        step += 1
        go = go[(place[go] < size[go]) & (step < most[go])]
    if runs:
        row, start, times, fill = np.concatenate(runs, axis=1)
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        lengths[np.repeat(row, times), np.repeat(start, times) + inside] = np.repeat(fill, times)
    coded, space = (lengths > 0).sum(axis=1), np.where(lengths > 0, 1 << bits.LONGEST >> lengths.astype(np.int64), 0).sum(axis=1)
    sound = stage == None  # noqa: E711
    stage[sound & (coded == 0)] = "huff-build-all-zero"
    stage[sound & (coded > 1) & (space > 1 << bits.LONGEST)] = "huff-build-overfull"
    return end, stage, lengths


#: Images whose headers are read together.
TOGETHER = 1024


def _headers(region: pa.Array, room: pa.Array, p: pa.Array, stage: pa.Array) -> pa.Array:
    """stage: null, `header` (not to be read) or `meta` (a flag for several code groups follows that for a cache)."""
    return pa.concat_arrays([_together(*(x.slice(k, TOGETHER) for x in (region, room, p, stage))) for k in range(0, len(region), TOGETHER)]) if len(region) else _together(region, room, p, stage)


def _together(region: pa.Array, room: pa.Array, p: pa.Array, flags: pa.Array) -> pa.Array:
    flat, begin = _flat(region)
    flat = np.concatenate([flat, np.zeros(3, np.uint8)])
    room, p, flags = room.to_numpy(zero_copy_only=False), p.to_numpy(zero_copy_only=False).astype(np.int64), np.array(flags.to_pylist(), object)
    take = lambda rows, at, n: _taken(flat, begin[rows], room[rows], at, np.asarray(n))
    rows = np.arange(len(p))
    cache = take(rows, p, 1)
    cache_bits = np.where(cache == 1, take(rows, p + 1, 4), 0)
    p = p + 1 + 4 * cache
    stage = np.where(flags == "header", flags, None)
    stage[(stage == None) & (cache == 1) & ((cache_bits < 1) | (cache_bits > 11))] = "color-cache"  # noqa: E711
    meta = flags == "meta"
    stage[(stage == None) & meta & (take(rows, p, 1) == 1)] = "meta-flag"  # noqa: E711
    p = p + meta
    sizes = alphabets(cache_bits)
    parts = []
    for size in sizes:
        go = rows[stage == None]  # noqa: E711
        widest = int(size.max(initial=0))
        part = np.zeros((len(rows), widest), np.uint8)
        own = lambda r, at, n, go=go: take(go[r], at, n)
        if len(go):
            p[go], stage[go], part[go] = _read_code(own, room[go], p[go], size[go], widest)
        parts.append(part)
    good = stage == None  # noqa: E711
    there = np.concatenate([np.arange(x.shape[1]) < (size * good)[:, None] for x, size in zip(parts, sizes, strict=True)], axis=1)
    ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
    codes = pa.Array.from_buffers(pa.binary(), len(rows), [pa.array(good).buffers()[1], pa.py_buffer(ends), pa.py_buffer(np.concatenate(parts, axis=1)[there])])
    return pa.StructArray.from_arrays([pa.array(cache_bits, pa.int32()), pa.array(stage, pa.string()), pa.array(p, pa.int64()), codes], ["cache_bits", "stage", "p", "codes"])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all rows of a binary column, where each row's begin)."""
    column = column.cast(pa.large_binary())
    start = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    bytes_ = column.buffers()[2]
    return (np.frombuffer(bytes_, np.uint8)[start[0] : start[-1]] if bytes_ and len(column) else np.zeros(0, np.uint8)), start[:-1] - start[0]


def alphabets(cache_bits: np.ndarray) -> list[np.ndarray]:
    """How many symbols each of the CHANNELS has."""
    green = LITERALS + LENGTHS + np.where(cache_bits > 0, 1 << np.minimum(cache_bits, 11), 0)
    return [green, *(np.full_like(green, n) for n in (LITERALS, LITERALS, LITERALS, DISTANCES))]


def _sizes() -> list[str]:
    return [f"{LITERALS + LENGTHS} + if(cache_bits > 0, shiftleft(1, cache_bits), 0)", *(str(n) for n in (LITERALS, LITERALS, LITERALS, DISTANCES))]


def _length(at: str) -> str:
    """SQL: the byte of `codes` at a place."""
    return f"ascii(cast(substring(codes, cast({at} as int) + 1, 1) as string))"


def entries(headers: DataFrame) -> DataFrame:
    """(image_id, channel, symbol, len) of the symbols in the codes of read_header()'s images without a stage."""
    sizes = _sizes()
    starts = [" + ".join(["0", *sizes[:k]]) for k in range(len(sizes))]
    spans = ", ".join(f"named_struct('channel', '{c}', 'start', {a}, 'size', {n})" for c, a, n in zip(CHANNELS, starts, sizes, strict=True))
    own = headers.where("stage is null").select("image_id", "codes", F.expr(f"inline(array({spans}))"))
    own = own.select("image_id", "codes", "channel", "start", F.explode(F.expr("sequence(0, size - 1)")).alias("symbol"))
    return own.select("image_id", "channel", "symbol", F.expr(_length("start + symbol")).alias("len")).where("len > 0")


def read_header(coded: DataFrame, meta: bool) -> DataFrame:
    """Coded images with cache_bits, `codes` (a byte for each symbol of the five codes, CHANNELS, its length), the codes' entries (len, symbol) by channel in their order, stage (null where all is well) and `begin`, the bit where the units begin; written to the shared folder. meta: whether a flag for several code groups is there."""
    out = coded.withColumn("_base", F.expr("cast(coalesce(shiftright(at, 3), 0) as int)"))
    region = F.expr(f"coalesce(substring(data, _base + 1, {REGION}), X'')")
    room = F.expr("cast(coalesce(greatest(0L, least(8L * (length(data) - _base), 1L << 30)), 0L) as int)")
    flag = F.expr(f"case when data is null or not coalesce(width > 0 and height > 0, false) then 'header' when {str(meta).lower()} then 'meta' end")
    out = out.withColumn("_h", F.arrow_udf(_headers, "cache_bits int, stage string, p bigint, codes binary")(region, room, F.expr("cast(coalesce(at & 7, 0) as int)"), flag))
    kept = [c for c in coded.columns if c not in ("cache_bits", "stage", "begin", "codes", *CHANNELS)]
    out = written(out.select(*kept, "_h.cache_bits", "_h.stage", F.expr("8L * _base + _h.p").alias("begin"), "_h.codes"))
    start, listed = "0", {}
    for channel, size in zip(CHANNELS, _sizes(), strict=True):
        own = f"transform(sequence(0, {size} - 1), s -> struct({_length(f'{start} + s')} as len, s as symbol))"
        listed[channel], start = F.expr(f"if(stage is null, sort_array(filter({own}, e -> e.len > 0)), null)"), f"{start} + {size}"
    return out.withColumns(listed)


class Code:
    """Symbols and lengths of a channel's prefix codes for arrays of windows, each with the row of its code."""

    def __init__(self, lengths: np.ndarray, row: np.ndarray, symbol: np.ndarray, rows: int):
        coded = np.flatnonzero(lengths)
        size = lengths[coded].astype(np.int64)
        order = np.argsort(row[coded] << 4 | size, kind="stable")
        row, self.symbols, self.size = row[coded][order], symbol[coded][order], size[order]
        share = 1 << (bits.LONGEST - self.size)
        n = np.bincount(row, minlength=rows)
        first = np.cumsum(n) - n
        before = np.concatenate([[0], np.cumsum(share)])
        self.end, self.alone, self.first = before[first + n] - before[first], n == 1, first
        self.starts = (row << 16) + before[:-1] - before[first[row]]

    def read(self, w: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, length) of the code at the beginning of each window; see bits.lookup()."""
        v, end, alone = _REVERSED[(w & np.uint64(0x7FFF)).astype(np.int64)], self.end[row], self.alone[row]
        at = np.searchsorted(self.starts, row << 16 | v, "right") - 1
        none = ~alone & (v >= end)
        some = (v >> (bits.LONGEST - bits.ROOT)) << (bits.LONGEST - bits.ROOT) < end
        return np.where(none, 0, self.symbols[np.where(alone, self.first[row], at)]), np.where(none, np.where(some, bits.ROOT, 0), np.where(alone, 0, self.size[at]))


_REVERSED = np.zeros(1 << bits.LONGEST, np.int64)
for _k in range(bits.LONGEST):
    _REVERSED |= (np.arange(1 << bits.LONGEST) >> _k & 1) << (bits.LONGEST - 1 - _k)


def _shifted(w: np.ndarray, n: np.ndarray) -> np.ndarray:
    return w >> n.astype(np.uint64)


def _prefixed(symbol: np.ndarray, w: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, extra bits read) of prefix symbols whose extra bits begin the windows; missing bits are 0 and not read."""
    n = np.where(symbol < 4, 0, np.maximum(symbol - 2, 0) >> 1)
    have = n <= left
    extra = np.where(have, (w & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))).astype(np.int64), 0)
    return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << n) + extra + 1), np.where(have, n, 0)


#: What may be wrong with a unit, in the order in which a reader finds it.
STAGES = ("green-symbol", "literal-symbol", "distance-symbol", "cache-disabled", "cache-range")


def _units(w: np.ndarray, left: np.ndarray, row: np.ndarray, codes: list[Code], cache_bits: np.ndarray) -> dict[str, np.ndarray]:
    """For windows, the bits left and the rows of their codes: kind (0 literal, 1 copy, 2 cache), value (pixel, length or slot), distance code, bits read, whether a read was short, and bad (a place in STAGES, -1: none)."""
    symbol, size = codes[0].read(w, row)
    bad = np.where(size > left, 0, -1)
    kind = np.where(symbol < LITERALS, 0, np.where(symbol < LITERALS + LENGTHS, 1, 2))
    value, distance, total, short = symbol.copy(), np.zeros(len(w), np.int64), size.copy(), np.zeros(len(w), bool)
    one = np.flatnonzero((kind == 0) & (bad < 0))
    pixel, used = symbol[one] << 8, size[one]
    for code, shift in zip(codes[1:4], (16, 0, 24), strict=True):
        s, n = code.read(_shifted(w[one], used), row[one])
        bad[one] = np.where((bad[one] < 0) & (used + n > left[one]), 1, bad[one])
        pixel, used = pixel | (s << shift), used + n
    value[one], total[one] = pixel, used
    two = np.flatnonzero((kind == 1) & (bad < 0))
    length, n = _prefixed(symbol[two] - LITERALS, _shifted(w[two], size[two]), left[two] - size[two])
    wanted = np.where(symbol[two] - LITERALS < 4, 0, (symbol[two] - LITERALS - 2) >> 1)
    used = size[two] + n
    s, m = codes[4].read(_shifted(w[two], used), row[two])
    bad[two] = np.where(used + m > left[two], 2, -1)
    used = used + m
    far, k = _prefixed(s, _shifted(w[two], used), left[two] - used)
    short[two] = (n < wanted) | (k < np.where(s < 4, 0, np.maximum(s - 2, 0) >> 1))
    value[two], distance[two], total[two] = length, far, used + k
    three = kind == 2
    value[three] -= LITERALS + LENGTHS
    bad[three & (bad < 0) & (cache_bits[row] == 0)] = 3
    bad[three & (bad < 0) & (value >= 1 << cache_bits[row])] = 4
    return {"kind": kind, "value": value, "distance": distance, "bits": total, "short": short, "bad": bad}


#: How many offsets are looked at together.
OFFSETS = 1 << 16


class Pieces:
    """Some pieces of a batch: n, how many offsets each has; for each offset of all of them its row (the piece), its place `at` in it and what _units() found there."""

    def __init__(self, part: pa.RecordBatch):
        rows = part.num_rows
        raw = _flat(part.column("slice"))[0].reshape(rows, -1)
        raw = np.ascontiguousarray(raw)
        left, cache_bits = (part.column(c).to_numpy().astype(np.int64) for c in ("left", "cache_bits"))
        size = raw.shape[1] - bits.MORE
        self.n = 8 * np.minimum(size, 1 - (-left // 8))
        k = np.arange(8, dtype=np.uint64)
        low = np.ndarray((rows, size, 1), "<u8", raw.data, 0, (raw.shape[1], 1, 8))
        high = raw[:, 8 : 8 + size, None].astype(np.uint64) << (np.uint64(64) - np.maximum(k, np.uint64(1)))
        there = np.arange(8 * size) < self.n[:, None]
        w = np.where(k > 0, (low >> k) | high, low).reshape(rows, -1)[there]
        self.row, self.at = np.nonzero(there)
        self.found = _units(w, left[self.row] - self.at, self.row, self._codes(part.column("codes"), cache_bits), cache_bits)
        # Offsets in one line, each piece followed by where units may go on behind it: ENTRY offsets, then `nowhere`
        wide = self.n + ENTRY + 1
        self.base = np.cumsum(wide) - wide

    @staticmethod
    def _codes(codes: pa.Array, cache_bits: np.ndarray) -> list[Code]:
        flat, start = _flat(codes)
        out, rows = [], len(start)
        for size in alphabets(cache_bits):
            row = np.repeat(np.arange(rows), size)
            symbol = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            out.append(Code(flat[np.repeat(start, size) + symbol], row, symbol, rows))
            start = start + size
        return out

    def next(self) -> np.ndarray:
        """Where the unit after each one begins, in the line; `nowhere`, which leads to itself as all places behind a piece do: a bad unit, or one without bits, which repeats."""
        to = np.arange(self.base[-1] + self.n[-1] + ENTRY + 1)
        on = (self.found["bad"] < 0) & (self.found["bits"] > 0) & ~self.found["short"]
        to[self.line()] = self.base[self.row] + np.where(on, self.at + self.found["bits"], self.n[self.row] + ENTRY)
        return to

    def line(self) -> np.ndarray:
        return self.base[self.row] + self.at

    def exits(self, entry: np.ndarray) -> np.ndarray:
        """entry: offsets of each piece, a row for each; the offsets in the next piece at which units from there go on; ENTRY: nowhere."""
        to = self.next()
        for _ in range(int(self.n.max()).bit_length()):
            to = to[to]
        return to[self.base[:, None] + np.minimum(entry, self.n[:, None])] - (self.base + self.n)[:, None]

    def real(self, entry: np.ndarray) -> np.ndarray:
        """Which offsets units really begin at when the pieces are entered at entry."""
        to, inside = self.next(), np.zeros(self.base[-1] + self.n[-1] + ENTRY + 1, bool)
        inside[self.line()] = True
        real = self.base + np.minimum(entry, self.n)
        while True:
            more = to[real]
            more = more[inside[more]]
            if not len(more):
                break
            real, to = np.concatenate([real, more]), to[to]
        marked = np.zeros_like(inside)
        marked[real] = True
        return np.flatnonzero(marked[self.line()])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Pieces]]:
    """The batches in parts of OFFSETS offsets: what Python holds doesn't grow with the batch."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            some = max(1, OFFSETS // (8 * len(batch.column("slice")[at].as_py())))
            part = batch.slice(at, some)
            yield part, Pieces(part)
            at += some


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece, for each of its first ENTRY offsets, the offset in the next piece at which units from there on go on; ENTRY: nowhere."""
    for part, pieces in _parts(batches):
        exits = np.full((part.num_rows, ENTRY + 1), ENTRY, np.int16)
        entry = np.broadcast_to(np.arange(ENTRY), (part.num_rows, ENTRY))
        exits[:, :ENTRY] = np.where(entry < pieces.n[:, None], pieces.exits(entry), ENTRY)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * (ENTRY + 1)), pa.array(exits.ravel()))
        yield pa.RecordBatch.from_arrays([part.column("image_id"), part.column("piece").cast(pa.int64()), lists], ["image_id", "piece", "exits"])


UNITS = "image_id bigint, at bigint, kind int, value bigint, distance bigint, bits int, short boolean, bad int"


def _marked(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    """UNITS that really begin in a piece entered at `entry`."""
    names = [x.split()[0] for x in UNITS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32())
    for part, pieces in _parts(batches):
        ids, number, entry = (part.column(c).to_numpy().astype(np.int64) for c in ("image_id", "piece", "entry"))
        real = pieces.real(entry)
        row = pieces.row[real]
        columns = [ids[row], 8 * piece * number[row] + pieces.at[real], *(pieces.found[c][real] for c in names[2:])]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def units(headers: DataFrame, piece: int = bits.PIECE) -> DataFrame:
    """UNITS of the images that read_header() took: from `begin` on, up to their last pixel or first bad unit, and what follows those by chance."""
    good = headers.where("stage is null").withColumns({"_first": F.expr(f"begin div {8 * piece}"), "_last": F.expr(f"(begin + {ENTRY}L * width * height) div {8 * piece}")})
    # A byte more, so that units without bits have a place at the stream's end
    padded = good.select("image_id", F.expr("concat(data, X'00')").alias("data"), "begin", "cache_bits", "codes", "_first", "_last")
    cut = bits.pieces(padded, piece).where("piece between _first and _last").withColumn("left", F.col("left") - 8)
    columns = ["image_id", "piece", "slice", "left", "cache_bits", "codes"]
    first = cut.where("piece = _first").select(*columns, F.expr(f"cast(begin % {8 * piece} as int)").alias("entry"))
    later = cut.where("piece > _first").select(*columns)
    exits = written(later.mapInArrow(_exits, "image_id bigint, piece bigint, exits array<smallint>"))
    n = exits.groupBy("image_id").count().agg(F.max("count")).first()[0]
    if not n:
        return first.mapInArrow(partial(_marked, piece=piece), UNITS)
    step = 1
    while step < n - 1:  # from the second piece on, or over the last `step` pieces; these double
        before = exits.select("image_id", (F.col("piece") + step).alias("piece"), F.col("exits").alias("_before"))
        exits = written(exits.join(before, ["image_id", "piece"], "left").select("image_id", "piece", F.expr("if(_before is null, exits, transform(_before, x -> exits[x]))").alias("exits")))
        step *= 2
    second = written(first.mapInArrow(_from_entry, "image_id bigint, piece bigint, entry int"))
    further = exits.join(second.select("image_id", "entry"), "image_id").select("image_id", (F.col("piece") + 1).alias("piece"), F.expr("cast(exits[entry] as int)").alias("entry"))
    entries = later.join(second.unionByName(further).where(f"entry < {ENTRY}"), ["image_id", "piece"])
    return first.unionByName(entries.select(*columns, "entry")).mapInArrow(partial(_marked, piece=piece), UNITS)


def _from_entry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each image's first piece, the offset in the next one at which its units go on."""
    for part, pieces in _parts(batches):
        exits = pieces.exits(part.column("entry").to_numpy().astype(np.int64)[:, None])[:, 0]
        number = part.column("piece").to_numpy().astype(np.int64) + 1
        yield pa.RecordBatch.from_arrays([part.column("image_id"), pa.array(number, pa.int64()), pa.array(exits, pa.int32())], ["image_id", "piece", "entry"])


def placed(found: DataFrame, headers: DataFrame) -> DataFrame:
    """UNITS up to each image's last pixel or first failure, with pos, the pixel where they begin, count, how many pixels they give, repeat, how often they come (more than once without bits), stage, null where all is well, and end, the bit behind them.

    One image's units are ordered in one task; the format bounds them by 2 ** 28.
    """
    count = F.when(F.col("kind") == 1, F.col("value")).otherwise(1).cast("bigint")
    order = W.partitionBy("image_id").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    sized = found.withColumn("count", count).withColumn("pos", F.coalesce(F.sum("count").over(order), F.lit(0)))
    own = sized.join(headers.select("image_id", "width", (F.col("width") * F.col("height")).alias("total")), "image_id").where("pos < total")
    own = lossless.distances(own.withColumnRenamed("distance", "far_code"), "width", "far_code").withColumn("distance", F.when(F.col("kind") == 1, F.col("distance")))
    repeat = F.when((F.col("bits") == 0) & (F.col("bad") < 0), F.expr("(total - pos + count - 1) div count")).otherwise(1)
    own = own.withColumn("repeat", repeat)
    named = F.expr(f"get(array({', '.join(repr(x) for x in STAGES)}), bad)")
    late = (F.col("kind") == 1) & (F.col("distance") > F.col("pos"))
    past = (F.col("kind") == 1) & (F.col("pos") + F.col("count") * F.col("repeat") > F.col("total"))
    own = own.withColumn("stage", F.when(F.col("bad") >= 0, named).when(late, "distance-range").when(past, "length-range").when(F.col("short") & (F.col("pos") + F.col("count") < F.col("total")), "eos"))
    failed = F.coalesce(F.bool_or(F.col("stage").isNotNull()).over(order), F.lit(False))
    return own.withColumn("_failed", failed).where("not _failed").select("image_id", "at", (F.col("at") + F.col("bits")).alias("end"), "pos", "kind", "value", "distance", "count", "repeat", "total", "stage")


def _resolved(cells: DataFrame) -> DataFrame:
    """Copied pixels (image_id, pos, source) with the source that is itself no copy, in log rounds."""
    while True:
        up = cells.select("image_id", F.col("pos").alias("source"), F.col("source").alias("_up"))
        cells = written(cells.join(up, ["image_id", "source"], "left").select("image_id", "pos", F.coalesce("_up", "source").alias("source"), F.col("_up").isNotNull().alias("_moved")))
        moved = cells.where("_moved").limit(1).count()
        cells = cells.drop("_moved")
        if not moved:
            return cells


def _valued(plain: DataFrame, copied: DataFrame) -> DataFrame:
    """(image_id, pos, argb) of pixels with a value and of copies of them."""
    own = copied.join(plain.select("image_id", F.col("pos").alias("source"), "argb"), ["image_id", "source"]).select("image_id", "pos", "argb")
    return plain.select("image_id", "pos", "argb").unionByName(own)


def pixels(places: DataFrame, headers: DataFrame) -> DataFrame:
    """(image_id, pos, argb) of the images whose units are all well.

    A cache reference takes the last pixel before it whose slot is its own; which pixel that is may hang on other references, so they are guessed from the pixels known so far and guessed again until nothing changes:
    a pixel hangs on earlier ones alone, so each round settles at least the next of them, and usually all.
    """
    fine = places.join(places.where("stage is not null").select("image_id").distinct(), "image_id", "left_anti")
    fine = written(fine)
    literals = fine.where("kind = 0").select("image_id", F.expr("explode(sequence(pos, pos + repeat - 1))").alias("pos"), F.col("value").alias("argb"))
    copies = fine.where("kind = 1").select("image_id", "pos", "distance", (F.col("count") * F.col("repeat")).alias("length"), "total")
    copied = lossless.copied(copies)
    copied = _resolved(copied) if fine.where("kind = 1").limit(1).count() else copied
    if not fine.where("kind = 2").limit(1).count():
        return _valued(literals, copied)
    literals, copied = written(literals), written(copied)
    slots = fine.where("kind = 2").select("image_id", F.expr("explode(sequence(pos, pos + repeat - 1))").alias("pos"), F.col("value").alias("slot"))
    guess = slots.select("image_id", "pos", F.lit(0).cast("bigint").alias("argb"))
    # Only images with references are gone through again
    asked = slots.select("image_id").distinct()
    plain, repeated = (written(x.join(asked, "image_id", "left_semi")) for x in (literals, copied))
    while True:
        known = _valued(plain.unionByName(guess), repeated).join(headers.where("cache_bits > 0").select("image_id", "cache_bits"), "image_id")
        # The slot of a pixel's colour, as cache_key() has it, for as many bits as each image has
        slot = F.expr("shiftright((argb * 506832829) & 4294967295L, 32 - cache_bits)")
        met = known.select("image_id", "pos", slot.alias("slot"), "argb", F.lit(1).alias("_kind")).unionByName(slots.select("image_id", "pos", "slot", F.lit(None).cast("bigint").alias("argb"), F.lit(0).alias("_kind")))
        order = W.partitionBy("image_id", "slot").orderBy("pos", "_kind").rowsBetween(W.unboundedPreceding, -1)
        new = met.withColumn("argb", F.when(F.col("_kind") == 0, F.coalesce(F.last("argb", ignorenulls=True).over(order), F.lit(0)))).where("_kind = 0").select("image_id", "pos", "argb")
        new = written(new)
        if not new.exceptAll(guess).limit(1).count():
            return _valued(literals.unionByName(new), copied)
        guess = new


def decode_coded(coded: DataFrame, meta: bool = False, piece: int = bits.PIECE) -> tuple[DataFrame, DataFrame]:
    """(rows (image_id, stage, end), pixels (image_id, pos, argb)) of coded images; end: the bit behind the last unit, stage: null, or where it failed."""
    headers = read_header(coded, meta)
    places = written(placed(units(headers, piece), headers))
    last = places.groupBy("image_id").agg(F.max("end").alias("end"), F.max("stage").alias("_stage"))
    results = headers.select("image_id", "stage").join(last, "image_id", "left").select("image_id", F.coalesce("stage", "_stage", F.when(F.col("end").isNull(), STAGES[0])).alias("stage"), "end")
    return written(results), pixels(places, headers)
