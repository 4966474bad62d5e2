"""Bits, codes and streams against plain reading, bit by bit."""

import random

import pytest
from pyspark.sql import functions as F

from pixweft.functions import tables
from pixweft.operators import bits, codes, lossless, streams, transforms
from pixweft.plans import streams as plans


def as_bytes(text):
    return bytes(int(text[k : k + 8][::-1], 2) for k in range(0, len(text), 8))


class Short(Exception):
    pass


class Plain:
    """Reads bits one by one. strict reads fail at the end, others give 0 and set eos."""

    def __init__(self, data, at=0):
        self.bits, self.at, self.eos = "".join(f"{b:08b}"[::-1] for b in data), at, False

    def take(self, n):
        if self.at + n > len(self.bits):
            self.eos = True
            return 0
        out = int(self.bits[self.at : self.at + n][::-1] or "0", 2)
        self.at += n
        return out

    def symbol(self, tree):
        if len(tree) == 1:
            return next(iter(tree.values()))
        for n in range(1, 16):
            if self.at + n <= len(self.bits) and (word := self.bits[self.at : self.at + n]) in tree:
                self.at += n
                return tree[word]
        rest = (self.bits[self.at :] + "0" * 15)[:15]
        n = next((len(w) for w in tree if rest.startswith(w)), None)
        if n is None:  # no code: nothing is read, or 8 bits where longer codes share them
            n = 8 if any(len(w) > 8 and w.startswith(rest[:8]) for w in tree) else 0
            if self.at + n > len(self.bits):
                raise Short
            self.at += n
            return 0
        raise Short


def plain_units(data, at, trees, cache_bits, width, height):
    """(pixels or None, stage)."""
    r, out, cache = Plain(data, at), [], [0] * (1 << cache_bits)
    total = width * height

    def put(argb):
        out.append(argb)
        if cache_bits:
            cache[((argb * 0x1E35A7BD) & 0xFFFFFFFF) >> (32 - cache_bits)] = argb

    def prefix(s):
        return s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + r.take((s - 2) >> 1) + 1

    while len(out) < total:
        try:
            stage = "green-symbol"
            g = r.symbol(trees[0])
            if g < 256:
                stage = "literal-symbol"
                red, blue, alpha = (r.symbol(t) for t in trees[1:4])
                put(alpha << 24 | red << 16 | g << 8 | blue)
            elif g < 280:
                stage = "distance-symbol"
                length = prefix(g - 256)
                code = prefix(r.symbol(trees[4]))
                near = tables.NEAR[code - 1] if code <= 120 else None
                distance = code - 120 if near is None else max(1, (near >> 4) * width + 8 - (near & 15))
                if distance > len(out):
                    return None, "distance-range"
                if len(out) + length > total:
                    return None, "length-range"
                for _ in range(length):
                    put(out[-distance])
            elif not cache_bits:
                return None, "cache-disabled"
            elif g - 280 >= 1 << cache_bits:
                return None, "cache-range"
            else:
                put(cache[g - 280])
        except Short:
            return None, stage
        if r.eos and len(out) < total:
            return None, "eos"
    return out, None


def words_of(lengths):
    return {w: s for s, w in plans.canonical(lengths).items()}


def decoded(spark, rows, meta=False, piece=bits.PIECE):
    """{image_id: (pixels, stage)} of (image_id, data, width, height)."""
    table = spark.createDataFrame([(i, d, 0, w, h) for i, d, w, h in rows], "image_id long, data binary, at long, width long, height long")
    results, cells = streams.decode_coded(table, meta, piece)
    got = {r.image_id: r.stage for r in results.collect()}
    planes = {}
    for r in cells.collect():
        planes.setdefault(r.image_id, {})[r.pos] = r.argb
    return {i: ([planes[i][k] for k in range(len(planes[i]))] if i in planes else None, s) for i, s in got.items()}


def test_every_window_of_codes(spark):
    trees = {1: [3, 2, 0, 1, 3], 2: [0, 0, 5], 3: [2, 9, 9, 0, 9], 4: [15] * 7 + [1, 12], 5: [8] * 256 + [0] * 24, 6: [1, 1], 7: [1, 1, 1], 8: [0, 0], 9: [10] * 3}
    rows = [(t, s, n) for t, lengths in trees.items() for s, n in enumerate(lengths)]
    lengths = spark.createDataFrame(rows, "tree long, symbol long, len long")
    table = bits.code_table(lengths).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(32767)))).where("code is not null")
    got = {}
    for r in table.select("tree", "v", F.expr(bits.lookup("code", "v")).alias("x")).collect():
        got.setdefault(r.tree, []).append((r.v, r.x.symbol, r.x.len))
    assert got.keys() == trees.keys() - {7, 8}
    valid = {r.tree for r in codes.validity(lengths).collect() if r.valid}
    assert valid == got.keys()
    for t, seen in got.items():
        tree = words_of(trees[t])
        own = {c.code << (15 - c.len): (c.symbol, c.len) for c in codes.canonical(lengths.where(F.col("tree") == t)).collect()}
        assert {int(w.ljust(15, "0"), 2) if w else 0: s for w, s in tree.items()} == {k: s for k, (s, _) in own.items()}
        for v, symbol, n in seen[:: 1 if t != 5 else 17]:
            r = Plain(b"")
            r.bits = f"{v:015b}"
            assert (r.symbol(tree), r.at) == (symbol, n), (t, v)


def test_windows_are_shifted_integers(spark):
    rng = random.Random(4)
    rows = [(k, bytes(rng.randrange(256) for _ in range(n))) for k, n in enumerate((0, 1, 2, 9, 16, 17, 700))] + [(99, None)]
    got = {(r.image_id, r.at): (r.w & (2**64 - 1), r.left, r.n, r.eos) for r in bits.windows(spark.createDataFrame(rows, "image_id long, data binary"), 16).select("*", bits.read(F.col("at") % 32).alias("n"), bits.eos(F.col("at") % 32).alias("eos")).collect()}
    want = {}
    for k, data in rows:
        x, n = int.from_bytes(data or b"", "little"), 8 * len(data or b"")
        want |= {(k, at): ((x >> at) & (2**64 - 1), n - at, (x >> at) & ((1 << at % 32) - 1) if at % 32 <= n - at else 0, at % 32 > n - at) for at in range(n)}
    assert got == want


def test_headers_sound_and_failing(spark):
    normal, simple, number = plans.normal, plans.simple, plans.number
    rest = simple(3) + simple(9) + simple(255) + simple(0)
    lengths = "0" + number(0, 4) + number(1, 3) * 4  # lengths 17, 18, 0 and 1 have codes of one bit each: over-full
    own = "0" + number(1, 4) + "".join(number(x, 3) for x in (0, 1, 0, 0, 1))  # 18 and 2
    cases = {
        0: ("0" + normal([8] * 256 + [0] * 24) + rest, None),
        1: ("0" + normal([0] * 270 + [1, 1] + [0] * 8, True) + rest, None),
        2: ("0" + simple(1, 0) + rest, None),
        3: ("0" + simple(77, 77) + rest, None),
        4: ("0" + lengths + rest, "huff-build-overfull"),
        5: ("0" + "0" + number(0, 4) + number(0, 3) * 4 + "0" * 40, "huff-build-all-zero"),
        6: ("0" + simple(3) + simple(9) + simple(255) + simple(0) + simple(77), "huffman-simple-first-symbol"),
        7: ("0" + own + "0" + ("1" + number(127, 7)) * 3, "huffman-repeat-range"),
        8: ("0" + own + "1" + number(7, 3) + number(300, 16), "huffman-max-symbol-range"),
        9: ("1" + number(12, 4), "color-cache"),
        10: ("0" + own + "0" + "0" * 280 + rest, "huff-build-overfull"),
        12: ("", "header"),
        13: ("1" + number(3, 4) + normal([9] * 256 + [0] * 24 + [3] * 4 + [0] * 4) + rest, None),
    }
    rows = [(i, as_bytes(t) if t else None, 0, 4, 4) for i, (t, _) in cases.items()] + [(50, as_bytes(cases[0][0]), 0, 0, 4)]
    got = {r.image_id: r for r in streams.read_header(spark.createDataFrame(rows, "image_id long, data binary, at long, width long, height long"), False).collect()}
    assert {i: r.stage for i, r in got.items()} == {i: s for i, (_, s) in cases.items()} | {50: "header"}
    for i in (0, 1, 2, 3, 13):
        assert got[i].begin == len(cases[i][0])
    assert [(e.len, e.symbol) for e in got[1].green] == [(1, 270), (1, 271)] and [(e.len, e.symbol) for e in got[3].green] == [(1, 77)]
    assert [(e.len, e.symbol) for e in got[2].green] == [(1, 0), (1, 1)] and len(got[13].green) == 260 and got[13].cache_bits == 3


@pytest.mark.parametrize("piece", [16, 512])
def test_random_streams(spark, piece):
    """Sound headers, then bits by chance: all kinds of units, failures and ends."""
    rng = random.Random(piece)
    greens = [[9] * 256 + [0] * 2 + [3] * 2 + [6] * 2 + [0] * 18 + [5] * 2, [0] * 65 + [1] + [0] * 190 + [2] + [0] * 30 + [2], [0] * 7 + [4, 12] + [0] * 248 + [2, 2, 3], [0] * 100 + [2] + [0] * 157 + [1] + [0] * 21 + [3, 3]]
    rows, want = [], {}
    for i in range(90):
        cache = rng.choice([0, 0, 3])
        size = 280 + (8 if cache else 0)
        green = (greens[i % 4] + [0] * size)[:size]
        trees = [green, rng.choice([[8] * 256, [0] * 255 + [1]]), rng.choice([[8] * 256, [0, 1, 1]]), [0] * 255 + [1], rng.choice([[1], [2, 2, 1], [0, 1], [0, 2, 0, 3] + [0] * 15 + [2]])]
        trees[4] = trees[4] + [0] * (40 - len(trees[4]))
        trees[1:4] = [t + [0] * (256 - len(t)) for t in trees[1:4]]
        head = ("1" + plans.number(3, 4) if cache else "0") + "".join(plans.normal(t) for t in trees)
        width, height = rng.choice([(1, 1), (5, 3), (16, 9), (40, 1)])
        text = head + "".join(rng.choice("01") for _ in range(rng.choice([0, 5, 40, 400, 4000])))
        rows.append((i, as_bytes(text), width, height))
        want[i] = plain_units(rows[-1][1], len(head), [words_of(t) for t in trees], 3 if cache else 0, width, height)
    assert len({s for _, s in want.values()}) >= 4
    got = decoded(spark, rows, piece=piece)
    assert got == want


def test_a_hundred_thousand_symbols_and_long_chains(spark):
    rng = random.Random(7)
    values = [rng.randrange(256) for _ in range(100_000)]
    head = "0" + plans.normal(plans.PLAIN) + plans.simple(3) + plans.simple(9) + plans.simple(255) + plans.simple(0)
    words = plans.canonical(plans.PLAIN)
    one = head + "".join(words[v] for v in values)
    lengths = [0] * 7 + [1] + [0] * 248 + [1] + [0] * 23  # literal 7 and copies of one pixel
    head = "0" + plans.normal(lengths) + plans.simple(3) + plans.simple(9) + plans.simple(255) + plans.simple(1)
    two = head + "0" + "1" * 3999
    got = decoded(spark, [(1, as_bytes(one), 400, 250), (2, as_bytes(two), 4000, 1)])
    assert got[1] == ([0xFF030009 | v << 8 for v in values], None)
    assert got[2] == ([0xFF030709] * 4000, None)


def test_transform_lists_of_pictures(spark):
    """Lists of their own side by side: none, twice the same kind, four and five steps, damaged sub-images, null data."""
    number, simple = plans.number, plans.simple
    colour = lambda g, r, b, a: "0" + simple(g) + simple(r) + simple(b) + simple(a) + simple(0)
    main = lambda g, r, b, a: "0" + "0" + colour(g, r, b, a)  # noqa: E731  end of the list, cache, then meta and codes without bits
    green, palette = "1" + number(2, 2), "1" + number(3, 2) + number(1, 8)
    lists = {
        0: main(10, 20, 30, 40),
        1: green * 2 + main(10, 250, 30, 40),
        2: green * 4 + main(1, 2, 3, 4),
        3: green * 5 + main(1, 2, 3, 4),
        4: "1" + number(0, 2) + number(7, 3) + colour(1, 0, 0, 0) + main(1, 2, 3, 4),
        5: "1" + number(1, 2) + number(0, 3) + colour(64, 32, 96, 0) + main(200, 100, 50, 255),
        6: palette + colour(5, 6, 7, 8) + main(0b00000010, 0, 0, 0),
        7: "1" + number(0, 2) + number(7, 3) + "1" + number(12, 4),
        8: "1" + number(1, 2),
    }
    rows = [(i, as_bytes(t), 3, 2) for i, t in lists.items()] + [(20, None, 3, 2), (21, as_bytes(lists[0]), 3, 0)]
    ended, cells = transforms.decode_lossless(spark.createDataFrame(rows, "image_id long, data binary, width long, height long"))
    stages = {r.image_id: r.stage for r in ended.collect()}
    assert {i for i, s in stages.items() if s is None} == {0, 1, 2, 4, 5, 6}
    assert (stages[3], stages[7], stages[20], stages[21]) == ("transforms", "color-cache", "header", "header") and stages[8]
    got = {}
    for r in cells.collect():
        got.setdefault(r.image_id, {})[r.y, r.x] = tuple((r.argb >> s) & 255 for s in (24, 16, 8, 0))
    assert got.keys() == {0, 1, 2, 4, 5, 6} and all(p.keys() == {(y, x) for y in range(2) for x in range(3)} for p in got.values())
    assert set(got[0].values()) == {(40, 20, 10, 30)} and set(got[1].values()) == {(40, (250 + 20) % 256, 10, 50)} and set(got[2].values()) == {(4, 6, 1, 7)}
    first = lambda k: tuple((x * k + y) % 256 for x, y in zip((4, 2, 1, 3), (255, 0, 0, 0), strict=True))
    assert [got[4][0, x] for x in range(3)] == [first(1), first(2), first(3)] and got[4][1, 0] == first(2) and got[4][1, 2] == first(4)  # mode 1: the left one
    signed = lambda v: (v + 128) % 256 - 128
    delta = lambda t, c: signed((signed(t) * signed(c)) >> 5)
    red = (100 + delta(96, 200)) % 256
    assert set(got[5].values()) == {(255, red, 200, (50 + delta(64, 200) + delta(32, red)) % 256)}
    assert [got[6][0, x] for x in range(3)] == [(8, 6, 5, 7), (16, 12, 10, 14), (8, 6, 5, 7)]  # indexes 0, 1, 0; the palette's second colour is the sum of two equal ones


def test_headers_keep_a_byte_for_each_symbol(spark):
    """Codes as lengths, in rows of different alphabets side by side, null data and failing headers between them; entries() and the columns of entries say the same."""
    cached = plans.CACHED
    heads = {
        1: ("0" + plans.normal(plans.PLAIN) + plans.simple(3) + plans.normal(plans.EIGHT) + plans.simple(255) + plans.simple(1, 0), [plans.PLAIN, [0, 0, 0, 1] + [0] * 252, plans.EIGHT, [0] * 255 + [1], [1, 1] + [0] * 38]),
        2: ("1" + plans.number(3, 4) + plans.normal(cached, True) + plans.normal(plans.EIGHT) * 3 + plans.simple(0), [cached, *[plans.EIGHT] * 3, [1] + [0] * 39]),
        3: ("1" + plans.number(12, 4), None),
    }
    rows = [(i, as_bytes(t), 0, 4, 4) for i, (t, _) in heads.items()] + [(9, None, 0, 4, 4)]
    headers = streams.read_header(spark.createDataFrame(rows, "image_id long, data binary, at long, width long, height long").coalesce(1), False)
    got = {r.image_id: r for r in headers.collect()}
    wanted = {i: lengths for i, (_, lengths) in heads.items()} | {9: None}
    assert {i: r.codes and list(r.codes) for i, r in got.items()} == {i: x and [n for tree in x for n in tree] for i, x in wanted.items()}
    listed = {}
    for r in streams.entries(headers).collect():
        listed.setdefault((r.image_id, r.channel), []).append((r.len, r.symbol))
    for i in (1, 2):
        for channel, tree in zip(streams.CHANNELS, wanted[i], strict=True):
            own = sorted((n, s) for s, n in enumerate(tree) if n)
            assert sorted(listed[i, channel]) == own == [(e.len, e.symbol) for e in got[i][channel]]
    assert {i for i, _ in listed} == {1, 2}


def test_pieces_of_a_batch_take_bounded_memory():
    """3,000 pieces with codes of their own in one batch, as Spark sends them: exits as from each alone."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(11)
    trees = [plans.PLAIN, [2] * 3 + [0] * 277, [0] * 7 + [4, 12] + [0] * 248 + [2, 2, 3] + [0] * 20]
    rows = []
    for i in range(3000):
        cache = 3 * (i % 2)
        green = trees[i % 3] + ([0] * 7 + [3]) * (cache > 0)
        codes = green + [8] * 256 + ([0] * 255 + [1] if i % 5 else [8] * 256) + [3, 3, 3] + [0] * 253 + [1, 1] + [0] * 38
        rows.append({"image_id": i, "piece": 1, "slice": bytes(rng.randrange(256) for _ in range(42)), "left": 8 * rng.choice([3, 20, 32, 900]), "cache_bits": cache, "codes": bytes(codes)})
    schema = pa.schema([("image_id", pa.int64()), ("piece", pa.int64()), ("slice", pa.binary()), ("left", pa.int64()), ("cache_bits", pa.int32()), ("codes", pa.binary())])
    batch = pa.RecordBatch.from_pylist(rows, schema)
    tracemalloc.start()
    got = [x for out in streams._exits([batch]) for x in out.column("exits").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 3000 and peak < 150e6, peak
    for i in range(0, 3000, 97):
        assert [x.column("exits").to_pylist() for x in streams._exits([batch.slice(i, 1)])] == [[got[i]]]
    assert len({tuple(x) for x in got}) > 100


def test_planes_of_a_batch_take_bounded_memory():
    """20,000 pictures of two sizes in one batch: the predictor undone as for each alone, in parts."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = 20_000
    high, wide = np.full(rows, 8), np.where(np.arange(rows) % 5, 8, 5)
    sizes, blocks = high * wide, 2 * ((wide + 3) // 4)
    listed = lambda n, top: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(rng.integers(0, top, n.sum())))
    columns = {"image_id": pa.array(np.arange(rows)), "width": pa.array(wide), "height": pa.array(high), "argb": listed(sizes, 2**32), "modes": listed(blocks, 16), "bits": pa.array(np.full(rows, 2))}
    batch, held = pa.RecordBatch.from_pydict(columns), {}
    tracemalloc.start()
    for out in lossless._undone([batch], None):
        ids = out.column("image_id").to_pylist()
        held |= {i: out.column("argb")[k].as_py() for k, i in enumerate(ids) if i % 997 == 0}
        rows -= len(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 0 and len(held) == 21 and peak < 40e6, peak
    for i, got in held.items():
        assert [x.column("argb").to_pylist() for x in lossless._undone([batch.slice(i, 1)], None)] == [[got]]


def test_units_of_a_batch_take_bounded_memory():
    """3,000 entered pieces with codes in one batch, as the last step of units() gets them: the units marked as in each alone."""
    import tracemalloc
    from functools import partial

    import pyarrow as pa

    rng = random.Random(12)
    codes = bytes(plans.PLAIN + [8] * 256 * 3 + [1, 1] + [0] * 38)
    rows = [{"image_id": i, "piece": i % 3, "slice": bytes(rng.randrange(256) for _ in range(42)), "left": 8 * rng.choice([3, 20, 32, 900]), "cache_bits": 0, "codes": codes, "entry": rng.randrange(20)} for i in range(3000)]
    schema = pa.schema([("image_id", pa.int64()), ("piece", pa.int64()), ("slice", pa.binary()), ("left", pa.int64()), ("cache_bits", pa.int32()), ("codes", pa.binary()), ("entry", pa.int32())])
    batch, marked, got = pa.RecordBatch.from_pylist(rows, schema), partial(streams._marked, piece=32), {}
    tracemalloc.start()
    for out in marked([batch]):
        for r in out.to_pylist():
            if r["image_id"] % 97 == 0:
                got.setdefault(r["image_id"], []).append(r)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 31 and peak < 150e6, peak
    for i, own in got.items():
        assert [r for x in marked([batch.slice(i, 1)]) for r in x.to_pylist()] == own
