"""Odd rows of the operators over pixels, codes and files: nulls, empty tables, damaged files, clashing names, hand-computed values."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixweft import registry
from pixweft.functions import pixels as P
from pixweft.operators import alpha, codes, compose, container, lossless, lossy
from pixweft.sources.container import chunks, read_files


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} bigint" for c in columns))


def test_hand_computed_values(spark):
    got = lambda value, **c: one(spark, **c).select(value.alias("v")).first().v
    assert got(P.average(F.col("p"), F.col("q")), p=0x01000000, q=0x02000000) == 0x01800000
    assert got(P.select(F.col("p"), F.col("q"), F.col("r")), p=0xFF000010, q=0xFF000020, r=0xFF000010) == 0xFF000010
    assert [got(lossless.prefix_value("p", "e"), p=p, e=e) for p, e in ((3, 0), (4, 1), (5, 0))] == [4, 6, 7]
    assert got(lossless.cache_key("p", 8), p=0xFFFFFFFF) == 225
    assert got(lossless.color_delta(F.col("p"), F.col("q")), p=32, q=128) == -128
    assert [got(lossless.packed_width("w", n), w=9) for n in (2, 4, 16, 17)] == [2, 3, 5, 9]
    assert got(lossy.dc_only("d", "p"), d=4, p=9) == 10
    deltas = {f"{c}_delta": 0 for c in lossy.DELTAS}
    assert [tuple(lossy.quantizers(one(spark, q=q, **deltas)).first()[c] for c in ("y1_dc", "y1_ac", "y2_dc", "y2_ac", "uv_dc", "uv_ac")) for q in (0, 127)] == [(4, 4, 8, 8, 4, 4), (157, 284, 314, 440, 132, 284)]
    gray = [(16, 128, 128), (235, 128, 128), (81, 90, 240)]
    luma, chroma = spark.createDataFrame([(i, 0, 0, y) for i, (y, _, _) in enumerate(gray)], "image_id long, y long, x long, luma long"), spark.createDataFrame([(i, 0, 0, u, v) for i, (_, u, v) in enumerate(gray)], "image_id long, y long, x long, cb long, cr long")
    assert sorted((r.image_id, r.r, r.g, r.b) for r in lossy.yuv_to_bgra(luma, chroma).collect()) == [(0, 0, 0, 0), (1, 255, 255, 255), (2, 255, 0, 0)]
    wht = lossy.inverse_wht(spark.createDataFrame([(1, [8] + [0] * 15)], "image_id long, c array<long>")).first().wht
    assert wht == [1] * 16
    plane = spark.createDataFrame([(1, 2, 2, [10, 10, 240, 1])], "image_id long, width long, height long, v array<long>")
    assert compose.unfilter_gradient(plane).first().v == [10, 20, 250, 0]


def test_distances_without_a_value(spark):
    rows = [(1, 10, 10), (2, 10, 1), (3, 10, 11), (4, 10, 9), (121, 10, 1), (4, 1, 1), (0, 10, None), (-5, 10, None), (None, 10, None), (1, 0, None), (130, 0, 10)]
    got = lossless.distances(spark.createDataFrame([(c, w, k, 0, 0) for k, (c, w, _) in enumerate(rows)], "code long, width long, k long, up long, across long"))
    assert {r.k: r.distance for r in got.collect()} == {k: d for k, (_, _, d) in enumerate(rows)} and {"up", "across"} <= set(got.columns)


def test_runs_and_copies_of_no_length(spark):
    runs = spark.createDataFrame([(1, 0, 5, 0), (1, 1, 7, 2), (1, 2, 9, -3), (1, 3, 4, None), (2, 0, 1, 0)], "tree long, pos long, value long, repeat long")
    assert sorted(map(tuple, codes.expand_runs(runs).collect())) == [(1, 0, 7), (1, 1, 7)]
    copies = spark.createDataFrame([(1, 5, 2, 0), (1, 5, 2, 3), (1, 5, 6, 2), (1, 5, 0, 2), (1, 5, -1, 2), (1, 5, None, 2), (1, 0, 1, 1), (1, 5, 2, -1)], "image_id long, pos long, distance long, length long")
    assert sorted(map(tuple, lossless.copied(copies).collect())) == [(1, 5, 3), (1, 6, 4), (1, 7, 3)]
    assert lossless.bad_copies(copies).count() == 5


def test_run_symbols_before_any_length(spark):
    rows = [(1, 0, 16, 1), (1, 1, 0, 0), (1, 2, 16, 0), (1, 3, 5, 0), (1, 4, 0, 0), (1, 5, 16, 3), (1, 6, 17, 7), (1, 7, 18, 127), (1, 8, 19, 0), (1, 9, None, 0)]
    got = codes.run_symbols(spark.createDataFrame(rows, "tree long, pos long, symbol long, extra long"))
    assert [(r.value, r.repeat) for r in got.orderBy("pos").collect()] == [(8, 4), (0, 1), (8, 3), (5, 1), (0, 1), (5, 6), (0, 10), (0, 138), (None, None), (None, None)]


def test_blocks_keep_the_callers_columns(spark):
    pixels = spark.createDataFrame([(1, 5, 2, "b", "x", 3)], "image_id long, y long, x long, by string, bx string, meta long")
    got = lossless.group_select(pixels, spark.createDataFrame([(1, 1, 0, 512)], "image_id long, by long, bx long, meta long"), 2, 10).first()
    assert (got.by, got.bx, got.code_group) == ("b", "x", 2)
    alone = lossless.group_select(pixels, spark.createDataFrame([], "image_id long, by long, bx long, meta long"), 2, 10).first()
    assert alone.code_group == 0


def test_palettes_of_images(spark):
    indexes = spark.createDataFrame([(1, 0, 0, 1), (2, 0, 0, 1), (2, 0, 1, 9), (3, 0, 0, None)], "image_id long, y long, x long, index long")
    own = spark.createDataFrame([(1, 1, 10), (2, 1, 20)], "image_id long, index long, argb long")
    assert sorted((r.image_id, r.x, r.argb) for r in lossless.palette_lookup(indexes, own).collect()) == [(1, 0, 10), (2, 0, 20), (2, 1, 0), (3, 0, 0)]


def test_chains_of_unknown_transforms(spark):
    with pytest.raises(ValueError, match="no such transforms"):
        lossless.undo_transforms(one(spark, image_id=1, y=0, x=0, a=1, r=1, g=1, b=1), [("subtract-green",), ("subtract-green",)])


def test_partitions_that_fail_the_frame(spark):
    rows = [(1, 0, 20, [1, 2, 3]), (2, 0, 14, [1, 2, 3]), (3, 0, 20, [1, None, 3]), (4, 0, 20, []), (5, 0, 20, [5, 9, 1])]
    got = lossy.token_partitions(spark.createDataFrame(rows, "image_id long, start long, end long, sizes array<long>"))
    sizes = {i: [r.size for r in got.where(f"image_id = {i}").orderBy("part").collect()] for i in range(1, 6)}
    assert sizes == {1: [1, 2, 3, 5], 2: [None] * 4, 3: [None] * 4, 4: [20], 5: [None] * 4}


def test_prediction_of_other_modes(spark):
    blocks = spark.createDataFrame([(1, 0, 7, [1] * 8, [2] * 8, 3, False, False), (2, 0, 0, [1] * 8, [2] * 8, 3, False, False)], "image_id long, block long, mode long, top array<long>, left array<long>, corner long, has_top boolean, has_left boolean")
    assert {r.image_id: r.v for r in lossy.predict_blocks(blocks, 8).collect()} == {1: None, 2: 128}
    small = lossy.predict_small(spark.createDataFrame([(1, 0, 12, list(range(13))), (2, 0, None, [0] * 13)], "image_id long, block long, mode long, edge array<long>"))
    assert {r.v for r in small.collect()} == {128} and small.count() == 32


def riff(*parts):
    body = b"".join(tag + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2) for tag, x in parts)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


VP8L = b"\x2f" + struct.pack("<I", 7 + (4 << 14)) + b"\x88\0\0"


def files(spark, *contents):
    return spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "image_id long, content binary")


def test_every_prefix_of_a_file(spark):
    whole = riff((b"VP8X", b"\x10\0\0\0\x09\0\0\x08\0\0"), (b"EXIF", b"abc"), (b"VP8L", VP8L))
    got = container.probe(chunks(files(spark, *(whole[:n] for n in range(len(whole) + 1))))).select("image_id", "reason", "chunk", "stage", "width", "height").collect()
    for r in got:
        n = r.image_id
        edges = [(30, "VP8X"), (42, "EXIF"), (len(whole), "VP8L")]
        begin = 12
        if n < 20:
            want = ("invalid-header", "----")
        else:
            want = ("ok", "----") if n == len(whole) else None
            for end, tag in edges:
                if want is None and begin + 8 <= n < end:
                    want = ("chunk-bounds", tag)
                begin = end
            want = want or ("missing-image-payload", "----")  # at most 7 bytes behind a chunk are left over
        assert (r.reason, r.chunk) == want, n
        assert ((r.width, r.height) == (10, 9)) == (r.reason == "ok")


def test_files_without_chunks_and_with_many(spark):
    many = riff(*[(b"JUNK", b"")] * 40_000, (b"VP8L", VP8L))
    odd = files(spark, None, b"", b"RIFF", b"\0" * 40, many, riff((b"VP8L", VP8L + b"\x01"))[:-1], riff((b"\0\0\0\0", b""), (b"ab\0c", b"1"))[:-1])
    got = {r.image_id: r for r in container.probe(chunks(odd)).collect()}
    assert [got[k].reason for k in range(7)] == ["invalid-header"] * 4 + ["ok", "chunk-bounds", "chunk-bounds"]
    assert (got[4].width, got[4].height) == (8, 5) and got[6].chunk == "ab" and chunks(odd).where("image_id = 4").count() == 40_002
    assert container.outcome(chunks(odd), F.lit(None), F.lit(10)).where("done or stage <> 'container'").count() == 0
    assert container.probe(chunks(odd.limit(0))).count() == 0


def test_last_canvas_and_first_image_count(spark):
    canvas = lambda w: b"\0\0\0\0" + struct.pack("<I", w - 1)[:3] + b"\x04\0\0"
    two = riff((b"VP8X", canvas(5)), (b"VP8L", VP8L), (b"VP8L", b"\x2e"), (b"VP8X", canvas(77)))
    got = container.outcome(chunks(files(spark, two)), F.lit(400), F.lit(2000)).first()
    assert (got.width, got.height, got.path, got.done, got.chunk, got.stage) == (77, 5, "vp8l", True, "VP8L", "ok")
    refused = container.outcome(chunks(files(spark, two)), F.lit(307), F.lit(2000)).first()
    assert (refused.done, refused.reason, refused.stage, refused.path) == (False, "invalid-dimensions", "ok", None)
    huge = container.outcome(chunks(files(spark, two)), F.lit(1 << 62), F.lit((1 << 63) - 1)).first()
    assert (huge.done, huge.reason) == (False, "invalid-dimensions")


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.webp").write_bytes(riff((b"VP8L", VP8L)))
    (tmp_path / "b.webp").write_bytes(b"nothing")
    found = read_files(spark, str(tmp_path))
    got = container.probe(chunks(found)).join(found.drop("content"), "image_id")
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in got.collect()} == {"a.webp": "ok", "b.webp": "invalid-header"}


def test_alpha_planes_that_give_no_rows(spark):
    rows = [(1, 2, 2, b"\0abcd"), (2, 2, 2, b"\0abc"), (3, 2, 2, None), (4, 2, 2, b"\x01abcd"), (5, 2, 2, b"\x0c\x01\x02\x03\xffmore"), (6, 0, 2, b"\0"), (7, None, 2, b"\0ab"), (8, 2, 2, b"")]
    got = alpha.unfiltered(alpha.raw_samples(spark.createDataFrame(rows, "image_id long, width long, height long, body binary")))
    by = {}
    for r in got.orderBy("image_id", "y", "x").collect():
        by.setdefault(r.image_id, []).append(r.v)
    assert by == {1: [97, 98, 99, 100], 5: [1, 3, 4, 5]}


def test_planes_undone_pixel_by_pixel():
    rng = np.random.default_rng(5)
    for h, w in ((1, 1), (1, 9), (9, 1), (2, 2), (5, 11), (11, 4), (16, 16), (0, 3)):
        flat = rng.integers(0, 256, (3, h, w))
        done = flat.copy()
        for y in range(h):
            for x in range(w):
                guess = np.clip(done[:, y, x - 1] + done[:, y - 1, x] - done[:, y - 1, x - 1], 0, 255) if x and y else done[:, y, x - 1] if x else done[:, y - 1, x] if y else 0
                done[:, y, x] = (done[:, y, x] + guess) & 255
        assert (compose.undo_gradient(flat) == done).all(), (h, w)
        pixels, modes = rng.integers(0, 256, (3, h, w, 4)), rng.integers(0, 15, (3, h // 4 + 1, w // 4 + 1))
        done = pixels.copy()
        for k in range(3):
            for y in range(h):
                for x in range(w):
                    if x and y:
                        near = [done[k, y, x - 1], done[k, y - 1, x], done[k, y - 1, x - 1], done[k, y - 1, min(x + 1, w - 1)]]
                        guess = lossless._predict(int(modes[k, y // 4, x // 4]), *near)
                    else:
                        guess = done[k, y, x - 1] if x else done[k, y - 1, x] if y else np.array([255, 0, 0, 0])
                    done[k, y, x] = (done[k, y, x] + guess) & 255
        assert (lossless.undo_predictor(pixels, modes, 2) == done).all(), (h, w)


def test_empty_tables(spark, tmp_path):
    for name, kinds in (("embeddings", "vec_id long, embedding array<float>, label int"), ("part", "p_partkey long, p_name string, p_size int"), ("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")):
        spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.conf.set("spark.sql.codegen.wholeStage", "false")  # plans for no rows aren't worth compiling
    try:
        for name, query in registry.QUERIES.items():
            assert query(spark, str(tmp_path)).isEmpty(), name
    finally:
        spark.conf.unset("spark.sql.codegen.wholeStage")


def test_nulls_stay_null(spark):
    """Null samples, indexes and levels give null results, never a bound."""
    null = lambda value, **c: spark.createDataFrame([tuple(c.values())], ", ".join(f"{k} bigint" for k in c)).select(value.alias("v")).first().v
    assert null(P.clip("c"), c=None) is None and null(P.clip("c"), c=999) == 255
    assert null(lossy.dc_only("d", "p"), d=4, p=None) is None and null(lossy.dc_only("d", "p"), d=None, p=4) is None
    assert null(lossy.true_motion("l", "t", "k"), l=1, t=None, k=3) is None
    assert null(lossy.segment_quantizer("b", "s", F.lit(False)), b=None, s=3) is None
    deltas = {f"{c}_delta": 0 for c in lossy.DELTAS}
    got = lossy.quantizers(spark.createDataFrame([(1, None, *deltas.values(), 77), (2, 0, *deltas.values(), 78)], f"image_id long, q long, {', '.join(f'{d} long' for d in deltas)}, y2_dc long")).orderBy("image_id").collect()
    assert [got[0][c] for c in ("y1_dc", "y1_ac", "y2_dc", "y2_ac", "uv_dc", "uv_ac")] == [None] * 6 and (got[1].y2_dc, got[1].uv_ac) == (8, 4)
    luma = spark.createDataFrame([(1, 0, 0, None, 5), (1, 0, 1, 16, 5), (1, 4, 4, 16, 5)], "image_id long, y long, x long, luma long, cb long")
    chroma = spark.createDataFrame([(1, 0, 0, 128, 128)], "image_id long, y long, x long, cb long, cr long")
    assert sorted((r.y, r.x, str(r.b), str(r.g), r.a) for r in lossy.yuv_to_bgra(luma, chroma).collect()) == [(0, 0, "None", "None", 255), (0, 1, "0", "0", 255), (4, 4, "None", "None", 255)]
    levels = spark.createDataFrame([(1, 0, 3, 9), (1, 16, 3, 9), (1, 1, None, 9), (1, None, 3, 9), (None, 0, 3, 9), (500, 0, 3, 9)], "q long, n long, level long, dc long")
    got = {(r.q, r.n, r.level): (r.place, r.value, r.dc) for r in lossy.dequantize(levels, lossy.steps(spark), ["q"]).collect()}
    assert got == {(1, 0, 3): (0, 15, 9), (1, 16, 3): (None, 15, 9), (1, 1, None): (1, None, 9), (1, None, 3): (None, None, 9), (None, 0, 3): (0, None, 9), (500, 0, 3): (0, None, 9)}
    taps = lossy.macroblock_edge(spark.createDataFrame([(None, *range(100, 107), 4, 20, 60)], ", ".join(f"{t} long" for t in lossy.TAPS) + ", hev long, interior long, edge long")).first()
    assert [taps[t] for t in lossy.TAPS] == [None, *range(100, 107)]


def test_runs_end_with_the_alphabet(spark):
    runs = [(1, 0, 5, 1), (1, 1, 0, 138), (1, 2, 0, 138), (1, 3, 0, 138), (2, 0, 7, 3), (2, 1, 0, 7), (2, 2, 9, 9), (3, 0, None, None), (4, 0, 4, 6), (4, 1, 4, 4)]
    read = lambda *a: {(r.tree, r.pos) for r in codes.read_runs(spark.createDataFrame(runs, "tree long, pos long, value long, repeat long"), *a).collect()}
    assert read(280) == {(2, 0), (2, 1), (2, 2), (4, 0), (4, 1)}
    assert read(10) == {(2, 0), (2, 1), (4, 0), (4, 1)}  # full before tree 2's third run
    assert read(280, 2) == {(1, 0), (1, 1), (2, 0), (2, 1), (4, 0), (4, 1)} and read(9) == set()
    copies = spark.createDataFrame([(1, 5, 2, 3, 8), (1, 5, 2, 4, 8)], "image_id long, pos long, distance long, length long, total long")
    assert lossless.copied(copies).count() == 3 and lossless.bad_copies(copies).count() == 1


def test_outputs_of_any_size(spark):
    top = 2**63 - 1
    rows = [(5, 4, 3), (0, top, 1), (top, 0, 1), (top, 1, 0), (top, 2, 1), (2**32, 2**31, 1), (2**32, 2**31 - 1, 1), (-3, 2, 1), (-top - 1, 2, 1), (None, 2, 1)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, stride long, height long, width long")
    got = {r.k: r.n for r in df.select("k", container.needed_bytes(F.col("stride"), F.col("height")).alias("n")).collect()}
    assert got == {k: (h * s if s is not None and -(2**63) < s and abs(h * s) < 2**63 else None) for k, (s, h, _) in enumerate(rows)}
