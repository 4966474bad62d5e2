"""Lossy (VP8) operators as projections and joins: quantizers, inverse transforms, prediction, loop filter, colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels as P
from ..functions import tables

DELTAS = ("y1_dc", "y2_dc", "y2_ac", "uv_dc", "uv_ac")


def steps(spark: SparkSession) -> DataFrame:
    """(q, dc, ac): 128 rows."""
    return spark.createDataFrame([(q, tables.DC_STEPS[q], tables.AC_STEPS[q]) for q in range(128)], "q bigint, dc bigint, ac bigint")


def segment_quantizer(base: Column | str, segment: Column | str, absolute: Column | str) -> Column:
    """A segment's index: its own, or the base plus its own, clipped."""
    return P.clip(F.when(P.col(absolute), P.long(segment)).otherwise(P.long(base) + P.long(segment)), 0, 127)


def quantizers(frames: DataFrame) -> DataFrame:
    """Columns y1_dc, y1_ac, y2_dc, y2_ac, uv_dc, uv_ac of rows with q and a column <name>_delta for each of DELTAS. They replace columns of these names; a null q or delta gives null steps."""

    def step(kind: list[int], delta: str | None) -> Column:
        return F.get(F.array(*(F.lit(v).cast("bigint") for v in kind)), P.clip(P.long("q") + (P.long(delta) if delta else 0), 0, 127).cast("int"))

    dc = {n: step(tables.DC_STEPS, f"{n}_delta") for n in ("y1_dc", "y2_dc", "uv_dc")}
    y1_ac, y2_ac, uv_ac = step(tables.AC_STEPS, None), step(tables.AC_STEPS, "y2_ac_delta"), step(tables.AC_STEPS, "uv_ac_delta")
    y2 = F.expr("_y2 * 155 div 100")
    out = frames.withColumns({"_y2": y2_ac, "_uv": dc["uv_dc"]})
    return out.withColumns({"y1_dc": dc["y1_dc"], "y1_ac": y1_ac, "y2_dc": dc["y2_dc"] * 2, "y2_ac": F.when(y2 < 8, F.lit(8).cast("bigint")).otherwise(y2), "uv_dc": F.when(F.col("_uv") > 132, F.lit(132).cast("bigint")).otherwise(F.col("_uv")), "uv_ac": uv_ac}).drop("_y2", "_uv")


def dequantize(coefficients: DataFrame, quant: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by..., n, level) with the n-th level times the DC or AC step, as a 16-bit number, at its place in the block. Quantizers (by..., dc, ac) have one row for each key.

    Every row stays: an n outside 0 to 15 has a null place, a row without quantizer or with a null n or level a null value. place and value replace columns of these names; the rows' own dc and ac stay.
    """
    place = F.get(F.array(*(F.lit(z).cast("bigint") for z in tables.ZIGZAG)), F.col("n").cast("int"))
    product = P.long("level") * F.when(F.col("n") == 0, F.col("_dc")).when(F.col("n").isNotNull(), F.col("_ac"))
    steps_ = quant.select(*by, F.col("dc").alias("_dc"), F.col("ac").alias("_ac"))
    return coefficients.join(steps_, by, "left").withColumns({"place": place, "value": F.pmod(product + 32768, F.lit(65536)) - 32768}).drop("_dc", "_ac")


def _grid(name: str) -> list[list[Column]]:
    """Columns of an array of 16 values as a 4x4 grid."""
    return [[P.long(F.col(name)[4 * i + j]) for j in range(4)] for i in range(4)]


def _let(df: DataFrame, name: str, grid: list[list[Column]]) -> DataFrame:
    """A stage's values as an array column: later stages then refer to it and don't repeat its expressions."""
    return df.withColumn(name, F.array(*(c for row in grid for c in row)))


def inverse_wht(blocks: DataFrame, name: str = "c", out: str = "wht") -> DataFrame:
    """Inverse Walsh-Hadamard transform of an array column of 16: rows, then columns, rounded by (v + 3) >> 3."""
    wrap = lambda v: F.pmod(v + 32768, F.lit(65536)) - 32768

    def butterfly(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
        return [a + d + b + c, a - d + b - c, a + d - b - c, a - d - b + c]

    rows = [list(map(wrap, butterfly(*r))) for r in _grid(name)]
    df = _let(blocks, "_t", rows)
    t = _grid("_t")
    columns = [[wrap(P.shift(v + 3, 3)) for v in butterfly(*(t[i][j] for i in range(4)))] for j in range(4)]
    return _let(df, out, [[columns[j][i] for j in range(4)] for i in range(4)]).drop("_t")


def _dct(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
    part = lambda v, f: P.shift(v * f, 16)
    odd = part(b, 35468) - d - part(d, 20091)
    even = b + part(b, 20091) + part(d, 35468)
    return [a + c + even, a - c + odd, a - c - odd, a + c - even]


def inverse_dct(blocks: DataFrame, name: str = "c", pred: str = "pred", out: str = "pixels") -> DataFrame:
    """Inverse DCT of an array column of 16, columns first, added to the prediction (16 values) and clipped."""
    g = _grid(name)
    columns = [_dct(*(g[i][j] for i in range(4))) for j in range(4)]
    df = _let(blocks, "_t", [[columns[j][i] for j in range(4)] for i in range(4)])
    base = _grid(pred)
    rows = [[P.clip(base[i][j] + P.shift(v + 4, 3)) for j, v in enumerate(_dct(*r))] for i, r in enumerate(_grid("_t"))]
    return _let(df, out, rows).drop("_t")


def dc_only(dc: Column | str, pred: Column | str) -> Column:
    """A sample of a block that has a DC coefficient alone."""
    return P.clip(P.long(pred) + P.shift(P.long(dc) + 4, 3))


def dc_prediction(edges: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """Blocks with column dc: the rounded mean of their edge samples (by..., v), 128 where they have none."""
    total, n = F.sum(P.long("v")), F.count("v")
    mean = edges.groupBy(*by).agg(total.alias("_s"), n.alias("_n")).select(*by, F.expr("(_s + _n div 2) div _n").alias("dc"))
    return blocks.join(mean, by, "left").withColumn("dc", F.coalesce("dc", F.lit(128).cast("bigint")))


def true_motion(left: Column | str, top: Column | str, corner: Column | str) -> Column:
    return P.clip(P.long(left) + P.long(top) - P.long(corner))


def predict_blocks(blocks: DataFrame, size: int) -> DataFrame:
    """Blocks (image_id, block, mode, top, left, corner, has_top, has_left) of size * size samples as rows (image_id, block, y, x, v); 16 for luma, 8 for chroma.

    Modes: 0 the rounded mean of the edges there are (128 without any), 1 the sample above, 2 the one to the left, 3 left + top - corner, clipped. Other modes give null samples.
    """
    side = F.expr(f"sequence(0L, {size - 1}L)")
    total = lambda c, has: F.when(F.col(has), F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(0)
    n = (F.when(F.col("has_top"), size).otherwise(0) + F.when(F.col("has_left"), size).otherwise(0)).cast("bigint")
    mean = blocks.withColumns({"_sum": total("top", "has_top") + total("left", "has_left"), "_n": n}).withColumn("_dc", F.expr("if(_n > 0, (_sum + _n div 2) div _n, 128L)"))
    cells = mean.withColumn("_y", F.explode(side)).withColumn("_x", F.explode(side))
    top, left = F.get(F.col("top"), F.col("_x").cast("int")), F.get(F.col("left"), F.col("_y").cast("int"))
    v = F.when(F.col("mode") == 0, F.col("_dc")).when(F.col("mode") == 1, top).when(F.col("mode") == 2, left).when(F.col("mode") == 3, true_motion(left, top, "corner"))
    return cells.select("image_id", "block", F.col("_y").alias("y"), F.col("_x").alias("x"), v.alias("v"))


def small_modes() -> list[tuple[int, int, int, list[int], int]]:
    """(mode, y, x, weights, bits) of the ten modes of 4x4 blocks: a sample is the weighted sum of the 13 edge samples, rounded and shifted by bits.

    The edge runs from the lowest left sample up to the corner (place 4), along the top and on to the top right.
    """
    out = []

    def add(mode: int, y: int, x: int, places: dict[int, int], bits: int) -> None:
        out.append((mode, y, x, [places.get(k, 0) for k in range(13)], bits))

    def two(k: int) -> tuple[dict[int, int], int]:
        return {k: 1, k + 1: 1}, 1

    def three(k: int, low: int = 0, high: int = 12) -> tuple[dict[int, int], int]:
        places: dict[int, int] = {}
        for at, w in ((k - 1, 1), (k, 2), (k + 1, 1)):
            at = min(max(at, low), high)
            places[at] = places.get(at, 0) + w
        return places, 2

    for y in range(4):
        for x in range(4):
            add(0, y, x, {k: 1 for k in (0, 1, 2, 3, 5, 6, 7, 8)}, 3)
            add(1, y, x, {5 + x: 1, 3 - y: 1, 4: -1}, 0)
            add(2, y, x, *three(5 + x))
            add(3, y, x, *three(3 - y))
            add(4, y, x, *three(6 + x + y))
            add(5, y, x, *three(4 + x - y))
            for mode, along, across, sign in ((6, x, y, 1), (8, y, x, -1)):  # steep diagonals: the second mirrors the first at the corner
                z = 2 * along - across
                if z >= 0 and z % 2 == 0:
                    k = 4 + sign * (z // 2)
                    add(mode, y, x, *two(k if sign > 0 else k - 1))
                else:
                    add(mode, y, x, *three(4 + sign * ((z + 1) // 2 if z >= -1 else 1 - across)))
            k = 5 + x + y // 2
            if x == 3 and y >= 2:
                add(7, y, x, *three(8 + y))
            else:
                add(7, y, x, *(three(k + 1) if y % 2 else two(k)))
            z = x + 2 * y
            if z > 5:
                add(9, y, x, {0: 1}, 0)
            else:
                add(9, y, x, *(three(2 - z // 2) if z % 2 else two(2 - z // 2)))
    return out


def predict_small(blocks: DataFrame) -> DataFrame:
    """Blocks (image_id, block, mode, edge) with the 13 samples of small_modes() as rows (image_id, block, y, x, v); an unknown mode gives 128."""
    table = blocks.sparkSession.createDataFrame(small_modes(), "mode bigint, y bigint, x bigint, weights array<bigint>, bits int")
    cells = table.groupBy("mode").agg(F.collect_list(F.struct("y", "x", "weights", "bits")).alias("_cells"))
    flat = F.array(*(F.struct(F.lit(y).cast("bigint").alias("y"), F.lit(x).cast("bigint").alias("x"), F.lit(None).cast("array<bigint>").alias("weights"), F.lit(0).alias("bits")) for y in range(4) for x in range(4)))
    own = blocks.select("image_id", "block", F.col("mode").cast("bigint").alias("mode"), "edge").join(F.broadcast(cells), "mode", "left")
    one = own.select("image_id", "block", "edge", F.explode(F.coalesce("_cells", flat)).alias("c"))
    total = F.expr("aggregate(zip_with(edge, c.weights, (e, w) -> cast(e as bigint) * w), 0L, (a, v) -> a + v)")
    rounded = F.expr("shiftright(_total + if(c.bits > 0, shiftleft(1L, c.bits - 1), 0L), c.bits)")
    return one.withColumn("_total", total).select("image_id", "block", F.col("c.y").alias("y"), F.col("c.x").alias("x"), F.when(F.col("c.weights").isNull(), F.lit(128).cast("bigint")).otherwise(P.clip(rounded)).alias("v"))


def mode_context(mode: Column | str) -> Column:
    """The 4x4 mode by which a block predicted as a whole counts for its neighbours; 0 for unknown modes."""
    known = F.array(*(F.lit(v).cast("bigint") for v in tables.MODE_CONTEXT))
    return F.coalesce(F.get(known, P.long(mode).cast("int")), F.lit(0).cast("bigint"))


def partition_of(row: Column | str, partitions: Column | str) -> Column:
    """The token partition of a row of macroblocks; null without partitions."""
    return F.when(P.long(partitions) > 0, P.long(row) % P.long(partitions))


def filter_parameters(macroblocks: DataFrame) -> DataFrame:
    """level, interior, hev, mb_edge and sub_edge from base_level, use_segment, absolute, segment_level, use_delta, ref_delta, mode_delta, is_i4x4 and sharpness."""
    own = F.when(F.col("use_segment"), F.when(F.col("absolute"), P.long("segment_level")).otherwise(P.long("base_level") + P.long("segment_level"))).otherwise(P.long("base_level"))
    shifted = P.clip(own, 0, 63) + F.when(F.col("use_delta"), P.long("ref_delta") + F.when(F.col("is_i4x4"), P.long("mode_delta")).otherwise(0)).otherwise(0)
    out = macroblocks.withColumn("level", P.clip(shifted, 0, 63))
    sharp = P.long("sharpness")
    inner = F.when(sharp > 0, F.least(F.when(sharp > 4, P.shift("level", 2)).otherwise(P.shift("level", 1)), 9 - sharp)).otherwise(F.col("level"))
    out = out.withColumn("interior", F.greatest(inner, F.lit(1).cast("bigint")))
    hev = F.when(F.col("level") >= 40, 2).when(F.col("level") >= 15, 1).otherwise(0).cast("bigint")
    return out.withColumns({"hev": hev, "mb_edge": 2 * (F.col("level") + 2) + F.col("interior"), "sub_edge": 2 * F.col("level") + F.col("interior")})


TAPS = ("p3", "p2", "p1", "p0", "q0", "q1", "q2", "q3")


def _distance(a: str, b: str) -> Column:
    return F.abs(P.long(a) - P.long(b))


def _edge_near(limit: Column | str) -> Column:
    return 2 * _distance("p0", "q0") + P.shift(_distance("p1", "q1"), 1) <= P.col(limit)


def filter_yes(interior: Column | str, edge: Column | str) -> Column:
    """Whether the eight samples across an edge are smooth enough to filter."""
    smooth = _edge_near(edge)
    for a, b in (("p3", "p2"), ("p2", "p1"), ("p1", "p0"), ("q3", "q2"), ("q2", "q1"), ("q1", "q0")):
        smooth &= _distance(a, b) <= P.col(interior)
    return smooth


def high_variance(threshold: Column | str) -> Column:
    return (_distance("p1", "p0") > P.col(threshold)) | (_distance("q1", "q0") > P.col(threshold))


def _s8(v: Column) -> Column:
    return P.between(v, -128, 127)  # a null tap fails the edge's condition, so nothing of this counts


def _signed(name: str) -> Column:
    return P.long(name) - 128


def _pixel(v: Column) -> Column:
    return _s8(v) + 128


def _adjusted(outer: Column) -> tuple[Column, Column, Column]:
    """(step, new p0, new q0) of the common adjustment."""
    a = _s8(outer + 3 * (_signed("q0") - _signed("p0")))
    step = P.shift(_s8(a + 4), 3)
    return step, _pixel(_signed("p0") + P.shift(_s8(a + 3), 3)), _pixel(_signed("q0") - step)


def _outer() -> Column:
    return _s8(_signed("p1") - _signed("q1"))


def _replaced(df: DataFrame, changes: dict[str, Column], where: Column) -> DataFrame:
    return df.withColumns({k: F.when(where, v).otherwise(P.long(k)) for k, v in changes.items()})


def _simple(edge: str) -> tuple[dict[str, Column], Column]:
    _, p0, q0 = _adjusted(_outer())
    return {"p0": p0, "q0": q0}, _edge_near(edge)


def _subblock(hev: str, interior: str, edge: str) -> tuple[dict[str, Column], Column]:
    high = high_variance(hev)
    step, p0, q0 = _adjusted(F.when(high, _outer()).otherwise(F.lit(0).cast("bigint")))
    half = P.shift(step + 1, 1)
    calm = lambda name, v: F.when(high, P.long(name)).otherwise(_pixel(v))
    return {"p0": p0, "q0": q0, "q1": calm("q1", _signed("q1") - half), "p1": calm("p1", _signed("p1") + half)}, filter_yes(interior, edge)


def _macroblock(hev: str, interior: str, edge: str) -> tuple[dict[str, Column], Column]:
    high = high_variance(hev)
    _, p0, q0 = _adjusted(_outer())
    w = _s8(_outer() + 3 * (_signed("q0") - _signed("p0")))
    changes = {}
    for side, strong, sign in (("p", p0, 1), ("q", q0, -1)):
        for k, factor in enumerate((27, 18, 9)):
            name = f"{side}{k}"
            changes[name] = F.when(high, P.long(name) if k else strong).otherwise(_pixel(_signed(name) + sign * _s8(P.shift(factor * w + 63, 7))))
    return changes, filter_yes(interior, edge)


def simple_edge(df: DataFrame, edge: str = "edge") -> DataFrame:
    """Taps p1, p0, q0, q1 after the simple filter."""
    return _replaced(df, *_simple(edge))


def subblock_edge(df: DataFrame, hev: str = "hev", interior: str = "interior", edge: str = "edge") -> DataFrame:
    """TAPS after the inner-edge filter."""
    return _replaced(df, *_subblock(hev, interior, edge))


def macroblock_edge(df: DataFrame, hev: str = "hev", interior: str = "interior", edge: str = "edge") -> DataFrame:
    """TAPS after the macroblock-edge filter."""
    return _replaced(df, *_macroblock(hev, interior, edge))


def filter_edges(df: DataFrame) -> DataFrame:
    """TAPS after the filter that column kind names: simple, subblock (limit sub_edge) or macroblock, as any other (both with limit mb_edge); a null kind counts as macroblock."""
    kinds = {"simple": _simple("mb_edge"), "subblock": _subblock("hev", "interior", "sub_edge"), "macroblock": _macroblock("hev", "interior", "mb_edge")}
    own = F.when(F.col("kind").isin("simple", "subblock"), F.col("kind")).otherwise("macroblock")
    out = {}
    for tap in TAPS:
        value = P.long(tap)
        for kind, (changes, where) in kinds.items():
            if tap in changes:
                value = F.when((own == kind) & where, changes[tap]).otherwise(value)
        out[tap] = value
    return df.withColumns(out)


def yuv_to_bgra(luma: DataFrame, chroma: DataFrame) -> DataFrame:
    """(image_id, y, x, b, g, r, a): samples luma (image_id, y, x, luma) joined with chroma (image_id, y, x, cb, cr) of half the size. Luma without chroma, or null, has null colours; other columns of luma don't count."""
    half = chroma.select("image_id", F.col("y").alias("_y"), F.col("x").alias("_x"), "cb", "cr")
    joined = luma.select("image_id", "y", "x", "luma", P.shift("y", 1).alias("_y"), P.shift("x", 1).alias("_x")).join(half, ["image_id", "_y", "_x"], "left")
    base, u, v = 298 * (P.long("luma") - 16), P.long("cb") - 128, P.long("cr") - 128
    sample = lambda c: P.clip(P.shift(c + 128, 8))
    return joined.select("image_id", "y", "x", sample(base + 516 * u).alias("b"), sample(base - 100 * u - 208 * v).alias("g"), sample(base + 409 * v).alias("r"), F.lit(255).cast("bigint").alias("a"))


def token_partitions(frames: DataFrame) -> DataFrame:
    """(image_id, part, start, size) of frames (image_id, start, end, sizes): the last part takes what is left. If the parts pass the end, or a size is null or negative, the frame fails: all its sizes are null."""
    one = frames.select("image_id", "end", F.expr("start + 3 * size(sizes)").cast("bigint").alias("base"), "sizes", F.explode(F.expr("sequence(0, size(sizes))")).alias("part"))
    sum_of = lambda a: F.expr(f"aggregate({a}, 0L, (a, x) -> a + x)")
    good = (F.col("base") + sum_of("sizes") <= F.col("end")) & F.expr("forall(sizes, x -> x >= 0)")
    out = one.withColumn("start", F.col("base") + sum_of("slice(sizes, 1, part)")).withColumn("size", F.when(F.col("part") < F.size("sizes"), F.expr("cast(try_element_at(sizes, part + 1) as bigint)")).otherwise(F.col("end") - F.col("start")))
    return out.select("image_id", F.col("part").cast("bigint").alias("part"), "start", F.when(good, F.col("size")).alias("size"))
