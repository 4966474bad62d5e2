"""Queries over the reference's operators by name, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry_blocks, registry_files, registry_streams  # noqa: F401  (they register queries)
from .catalog import ORACLE, QUERIES, clip, query, s8  # noqa: F401
from .functions import pixels as P
from .functions import tables
from .operators import codes, compose, lossless, lossy
from .plans.planes import COLOURS, LENGTHS, LINES, PX, colours, lengths, lines, px, table

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yuv_to_bgra(spark, sf_dir)


# Lossless


@query(f"with {LINES} select image_id, pos, a, (r + g) & 255 as r, g, (b + g) & 255 as b from li")
def subtract_green(spark, sf):
    return lossless.subtract_green(lines(spark, sf))


@query(f"with {PX} select image_id, y, x, (sum(v) over (partition by image_id, y order by x))::bigint & 255 as v from px")
def palette_delta(spark, sf):
    return lossless.palette_delta(px(spark, sf), ["image_id", "y"], "x", ["v"])


@query(f"with {PX}, pal as (select p_partkey::bigint as idx, (p_partkey::bigint * 2654435761) % 4294967296 as argb from part where p_partkey < 12) select image_id, y, x, v >> 4 as index, coalesce(argb, 0) as argb from px left join pal on v >> 4 = idx")
def palette_lookup(spark, sf):
    pal = table(spark, sf, "part").where("p_partkey < 12").selectExpr("cast(p_partkey as bigint) as index", "cast(p_partkey as bigint) * 2654435761 % 4294967296 as argb")
    return lossless.palette_lookup(px(spark, sf).select("image_id", "y", "x", P.shift("v", 4).alias("index")), pal)


@query(f"with {PX} select image_id, y, x * 2 + k as x, (v >> (k * 4)::int) & 15 as index from px, range(0, 2) as t(k)")
def palette_unpack(spark, sf):
    return lossless.palette_unpack(px(spark, sf), 16, 16, "v")


def _delta(t: str, c: str) -> str:
    return s8(f"(({s8(t)}) * ({s8(c)})) >> 5")


@query(f"with {COLOURS}, k as (select image_id, y >> 2 as by_, x >> 2 as bx, v as gr, v * 3 % 256 as gb, v * 5 % 256 as rb from px where y % 4 = 0 and x % 4 = 0), one as (select c.image_id, y, x, g, b, gb, rb, (r + {_delta('gr', 'g')}) & 255 as r from c join k on c.image_id = k.image_id and y >> 2 = by_ and x >> 2 = bx) select image_id, y, x, r, g, (((b + {_delta('gb', 'g')}) & 255) + {_delta('rb', 'r')}) & 255 as b from one")
def cross_color(spark, sf):
    blocks = px(spark, sf).where("y % 4 = 0 and x % 4 = 0").selectExpr("image_id", "y div 4 as by", "x div 4 as bx", "v as green_to_red", "v * 3 % 256 as green_to_blue", "v * 5 % 256 as red_to_blue")
    return lossless.cross_color(colours(spark, sf), blocks, 2).select("image_id", "y", "x", "r", "g", "b")


@query(f"with {PX}, k as (select image_id, y, x, max(case when y % 4 = 0 and x % 4 = 0 then v end) over (partition by image_id, y >> 2, x >> 2) as grp from px) select image_id, y, x, case when grp < 200 then grp else 0 end as code_group from k")
def meta_group_select(spark, sf):
    blocks = px(spark, sf).where("y % 4 = 0 and x % 4 = 0").selectExpr("image_id", "y div 4 as by", "x div 4 as bx", "v * 256 as meta")
    return lossless.group_select(px(spark, sf), blocks, 2, 200).select("image_id", "y", "x", "code_group")


@query(f"with {PX} select image_id, max(v) + 1 as n_groups from px group by image_id")
def group_count(spark, sf):
    return lossless.group_count(px(spark, sf).selectExpr("image_id", "v * 256 + 7 as meta"))


@query(f"with {LINES} select image_id, pos, case when r % 40 < 4 then r % 40 + 1 else ((2 + r % 2) << ((r % 40 - 2) // 2)::int) + g + 1 end as value from li")
def prefix_value(spark, sf):
    return lines(spark, sf).select("image_id", "pos", lossless.prefix_value(F.col("r") % 40, "g").alias("value"))


@query(f"with {LINES}, d as (select image_id, pos, r + 1 as code, g + 1 as width, {tables.NEAR}[(r + 1)::int] as n from li) select image_id, pos, code, width, (case when code > 120 then code - 120 else greatest(1, (n // 16) * width + 8 - n % 16) end)::bigint as distance from d")
def distance_map(spark, sf):
    return lossless.distances(lines(spark, sf).selectExpr("image_id", "pos", "r + 1 as code", "g + 1 as width"))


@query(f"with {LINES} select image_id, pos, (((a * 16777216 + r * 65536 + g * 256 + b) * 506832829) & 4294967295) >> 22 as slot from li")
def cache_hash(spark, sf):
    return lines(spark, sf).select("image_id", "pos", lossless.cache_key(P.argb("a", "r", "g", "b"), 10).alias("slot"))


@query(f"with {COLOURS}, s as (select image_id, y * 8 + x as pos, argb, ((argb * 506832829) & 4294967295) >> 30 as slot from c) select image_id, pos, argb, slot, coalesce(last_value(argb) over (partition by image_id, slot order by pos rows between unbounded preceding and 1 preceding), 0) as before from s")
def cache_state(spark, sf):
    return lossless.cache_state(colours(spark, sf).selectExpr("image_id", "y * 8 + x as pos", "argb"), 2)


@query(f"with {PX} select image_id, y * 8 + x + k as pos, y * 8 + x - (1 + v % 7) + k % (1 + v % 7) as source from px, range(0, 11) as t(k) where k < 1 + v % 11 and 1 + v % 7 <= y * 8 + x")
def copy_sources(spark, sf):
    return lossless.copied(px(spark, sf).selectExpr("image_id", "y * 8 + x as pos", "1 + v % 7 as distance", "1 + v % 11 as length"))


@query(f"with {COLOURS} select image_id, y, x, argb from c")
def predictor_round_trip(spark, sf):
    pixels = colours(spark, sf)
    mode = F.pmod(F.col("image_id") + F.expr("y div 4 * 2 + x div 4"), F.lit(14))
    planes = compose.as_planes(lossless.predictor_residuals(pixels, mode), 8, 8, "residual").withColumnRenamed("residual", "argb")
    planes = planes.withColumn("modes", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.pmod(F.col("image_id") + k, F.lit(14))))
    return compose.as_pixels(lossless.inverse_predictor(planes, 2), "argb").select("image_id", "y", F.col("x").cast("bigint").alias("x"), "argb")


# Prefix codes

_LEN = LENGTHS.format("5 + p_size % 11")


@query(f"with {_LEN} select tree, len, count(*) as n_symbols from lens where len > 0 group by tree, len")
def code_length_histogram(spark, sf):
    return codes.histogram(lengths(spark, sf, "5 + p_size % 11"))


@query(f"with {_LEN} select tree, symbol, len, row_number() over (partition by tree order by len, symbol) - 1 as place from lens")
def symbol_rank(spark, sf):
    return codes.ranks(lengths(spark, sf, "5 + p_size % 11"))


@query(f"with {_LEN}, k as (select tree, symbol, len, (coalesce(sum(1 << (15 - len)::int) over (partition by tree order by len, symbol rows between unbounded preceding and 1 preceding), 0)::bigint >> (15 - len)::int) as code from lens) select tree, symbol, len, code, list_sum(list_transform(range(0, len), lambda i: ((code >> i::int) & 1) << (len - 1 - i)::int))::bigint as reversed from k")
def canonical_codes(spark, sf):
    return codes.canonical(lengths(spark, sf, "5 + p_size % 11"))


@query(f"with {LENGTHS.format('p_size % 17')}, s as (select tree, sum((len > 0)::int)::bigint as coded, sum(case when len between 1 and 15 then 1 << (15 - len)::int else 0 end)::bigint as space, bool_and(len between 0 and 15) as legal from lens group by tree) select tree, coded, space, legal and coded > 0 and space <= 32768 as valid, coded = 1 as reads_no_bits from s")
def kraft_check(spark, sf):
    return codes.validity(lengths(spark, sf, "p_size % 17"))


@query(f"with {PX}, r as (select image_id as tree, y * 8 + x as pos, v % 16 as value, k from px, range(1, 6) as t(k) where k <= 1 + v % 5) select tree, row_number() over (partition by tree order by pos, k) - 1 as place, value as len from r")
def run_expansion(spark, sf):
    return codes.expand_runs(px(spark, sf).selectExpr("image_id as tree", "y * 8 + x as pos", "v % 16 as value", "1 + v % 5 as repeat"))


# Lossy


@query(f"with {LINES}, p as (select image_id, pos, b % 16 as n, (r - 128) * (case when b % 16 = 0 then {tables.DC_STEPS}[(g % 128 + 1)::int] else {tables.AC_STEPS}[(g % 128 + 1)::int] end) as product from li) select image_id, pos, n, {tables.ZIGZAG}[(n + 1)::int]::bigint as place, case when product > 32767 then product - 65536 when product < -32768 then product + 65536 else product end as value from p")
def dequantize(spark, sf):
    levels = lines(spark, sf).selectExpr("image_id", "pos", "g % 128 as q", "b % 16 as n", "r - 128 as level")
    return lossy.dequantize(levels, F.broadcast(lossy.steps(spark)), ["q"]).select("image_id", "pos", "n", "place", "value")


def _step(kind: list[int], delta: str) -> str:
    return f"{kind}[({clip(f'q + {delta}', 0, 127)} + 1)::int]::bigint"


@query(
    "with f as (select p_partkey::bigint as image_id, p_partkey::bigint % 128 as q, p_size::bigint % 16 as d from part) select image_id, q, "
    f"{_step(tables.DC_STEPS, '(d - 8)')} as y1_dc, {_step(tables.AC_STEPS, '0')} as y1_ac, 2 * {_step(tables.DC_STEPS, '(7 - d)')} as y2_dc, greatest(8, {_step(tables.AC_STEPS, '(d // 2)')} * 155 // 100) as y2_ac, least(132, {_step(tables.DC_STEPS, 'd')}) as uv_dc, {_step(tables.AC_STEPS, '(-d)')} as uv_ac from f"
)
def quant_table(spark, sf):
    frames = table(spark, sf, "part").selectExpr("cast(p_partkey as bigint) as image_id", "cast(p_partkey % 128 as bigint) as q", "cast(p_size % 16 as bigint) as d")
    frames = frames.selectExpr("image_id", "q", "d - 8 as y1_dc_delta", "7 - d as y2_dc_delta", "d div 2 as y2_ac_delta", "d as uv_dc_delta", "-d as uv_ac_delta")
    return lossy.quantizers(frames).select("image_id", "q", "y1_dc", "y1_ac", "y2_dc", "y2_ac", "uv_dc", "uv_ac")


_BLOCKS = f"{PX}, blk as (select image_id, (y // 4) * 2 + x // 4 as block, list(v - 128 order by y, x) as c from px group by all)"


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The four 4x4 blocks of each image; image_id holds both until _block_values."""
    return compose.as_planes(px(spark, sf).selectExpr("image_id * 4 + y div 4 * 2 + x div 4 as image_id", "y", "x", "v - 128 as c"), 4, 4, "c")


def _values(df: DataFrame, name: str) -> DataFrame:
    return df.select("image_id", F.posexplode(name).alias("i", "value")).withColumn("i", F.col("i").cast("bigint"))


def _block_values(df: DataFrame, name: str) -> DataFrame:
    return _values(df, name).selectExpr("image_id div 4 as image_id", "image_id % 4 as block", "i", "value")


def _wht_sql(at: Callable[[int, int], str], i: int, j: int) -> str:
    """Sums with the signs of the j-th basis vector."""
    signs = ("++++", "++--", "+--+", "+-+-")[j]
    return "(" + " ".join(f"{s} {at(i, k)}" for k, s in enumerate(signs)) + ")"


_WHT_ROWS = ", ".join(_wht_sql(lambda i, k: f"c[{4 * i + k + 1}]", i, j) for i in range(4) for j in range(4))
_WHT = ", ".join(f"({_wht_sql(lambda j, k: f't[{4 * k + j + 1}]', j, i)} + 3) >> 3" for i in range(4) for j in range(4))


@query(f"with {_BLOCKS}, one as (select image_id, block, [{_WHT_ROWS}] as t from blk), two as (select image_id, block, [{_WHT}] as o from one) select image_id, block, i as i, o[i + 1]::bigint as value from two, range(0, 16) as s(i)")
def iwht4x4(spark, sf):
    return _block_values(lossy.inverse_wht(_blocks(spark, sf)), "wht")


def _dct_sql(at: Callable[[int], str], k: int) -> str:
    odd = f"((({at(1)} * 35468) >> 16) - {at(3)} - (({at(3)} * 20091) >> 16))"
    even = f"({at(1)} + (({at(1)} * 20091) >> 16) + (({at(3)} * 35468) >> 16))"
    return (f"({at(0)} + {at(2)} + {even})", f"({at(0)} - {at(2)} + {odd})", f"({at(0)} - {at(2)} - {odd})", f"({at(0)} + {at(2)} - {even})")[k]


_DCT_COLUMNS = ", ".join(_dct_sql(lambda k, j=j: f"c[{4 * k + j + 1}]", i) for i in range(4) for j in range(4))
_DCT = ", ".join(clip(f"c[{4 * i + j + 1}] + 128 + (({_dct_sql(lambda k, i=i: f't[{4 * i + k + 1}]', j)} + 4) >> 3)") for i in range(4) for j in range(4))


@query(f"with {_BLOCKS}, one as (select image_id, block, c, [{_DCT_COLUMNS}] as t from blk), two as (select image_id, block, [{_DCT}] as o from one) select image_id, block, i as i, o[i + 1]::bigint as value from two, range(0, 16) as s(i)")
def idct4x4(spark, sf):
    return _block_values(lossy.inverse_dct(_blocks(spark, sf).withColumn("pred", F.transform("c", lambda v: v + 128))), "pixels")


@query(f"with {PX} select image_id, y, x, {clip('v + ((v * 37 % 2048 - 1024 + 4) >> 3)')} as v from px")
def idct_dc_add(spark, sf):
    return px(spark, sf).withColumn("v", lossy.dc_only(F.col("v") * 37 % 2048 - 1024, "v"))


@query(f"with {PX} select image_id, ((sum(v) + count(*) // 2) // count(*))::bigint as dc from px where y = 0 or x = 0 group by image_id")
def dc_predict(spark, sf):
    p = px(spark, sf)
    return lossy.dc_prediction(p.where("y = 0 or x = 0"), p.where("y = 0 and x = 0").select("image_id"), ["image_id"])


@query(f"with {PX}, n as (select image_id, y, x, first_value(v) over (partition by image_id, y order by x) as l, first_value(v) over (partition by image_id, x order by y) as t, first_value(v) over (partition by image_id order by y, x) as k from px) select image_id, y, x, {clip('l + t - k')} as v from n where y > 0 and x > 0")
def true_motion(spark, sf):
    p = px(spark, sf)
    left = p.where("x = 0").select("image_id", "y", F.col("v").alias("l"))
    top = p.where("y = 0").select("image_id", "x", F.col("v").alias("t"))
    corner = p.where("y = 0 and x = 0").select("image_id", F.col("v").alias("k"))
    joined = p.where("y > 0 and x > 0").join(left, ["image_id", "y"]).join(top, ["image_id", "x"]).join(corner, "image_id")
    return joined.select("image_id", "y", "x", lossy.true_motion("l", "t", "k").alias("v"))


_LEVEL = clip(f"{clip('case when g % 2 = 0 then case when g % 3 = 0 then b % 64 else r % 64 + b % 64 - 32 end else r % 64 end', 0, 63)} + case when a % 2 = 0 then a % 20 - 10 + case when r % 5 = 0 then b % 9 - 4 else 0 end else 0 end", 0, 63)


@query(
    f"with {LINES}, l as (select image_id, pos, r, g, b, a, (r % 8) as sharp, ({_LEVEL})::bigint as level from li), i as (select *, greatest(1, case when sharp > 0 then least(case when sharp > 4 then level >> 2 else level >> 1 end, 9 - sharp) else level end) as interior from l) "
    "select image_id, pos, level, interior, (case when level >= 40 then 2 when level >= 15 then 1 else 0 end)::bigint as hev, 2 * (level + 2) + interior as mb_edge, 2 * level + interior as sub_edge from i"
)
def filter_params(spark, sf):
    own = {"base_level": "r % 64", "use_segment": "g % 2 = 0", "absolute": "g % 3 = 0", "segment_level": "case when g % 3 = 0 then b % 64 else b % 64 - 32 end", "use_delta": "a % 2 = 0", "ref_delta": "a % 20 - 10", "mode_delta": "b % 9 - 4", "is_i4x4": "r % 5 = 0", "sharpness": "r % 8"}
    return lossy.filter_parameters(lines(spark, sf).selectExpr("image_id", "pos", *(f"{e} as {n}" for n, e in own.items()))).select("image_id", "pos", "level", "interior", "hev", "mb_edge", "sub_edge")


def _taps(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of eight samples across an edge, with limits from the image."""
    taps = [F.max(F.when(F.col("x") == k, 100 + F.col("v") % 24)).alias(n) for k, n in enumerate(lossy.TAPS)]
    limits = {"interior": "8 + image_id % 20", "hev": "image_id % 3 * 4", "edge": "20 + image_id % 40"}
    return px(spark, sf).groupBy("image_id", "y").agg(*taps).selectExpr("*", *(f"{e} as {n}" for n, e in limits.items()))


_TAPS = f"{PX}, e as (select image_id, y, {', '.join(f'max(case when x = {k} then 100 + v % 24 end) as {n}' for k, n in enumerate(lossy.TAPS))}, 8 + image_id % 20 as interior, image_id % 3 * 4 as hev, 20 + image_id % 40 as edge from px group by image_id, y)"
_NEAR = "2 * abs(p0 - q0) + (abs(p1 - q1) >> 1) <= edge"
_YES = " and ".join([_NEAR, *(f"abs({a} - {b}) <= interior" for a, b in (("p3", "p2"), ("p2", "p1"), ("p1", "p0"), ("q3", "q2"), ("q2", "q1"), ("q1", "q0")))])
_HIGH = "(abs(p1 - p0) > hev or abs(q1 - q0) > hev)"
_OUTER = clip("p1 - q1", -128, 127)


def _c(x: str) -> str:
    return clip(x, -128, 127)


def _edge_sql(outer: str, yes: str, more: dict[str, str], base: str) -> str:
    """p0 and q0 by the common step with the given outer term; more: what else changes, from a (the step before rounding), hi and w."""
    step = f"(({_c('a + 4')}) >> 3)"
    new = {"p0": f"{_c(f'p0 - 128 + (({_c('a + 3')}) >> 3)')} + 128", "q0": f"{_c(f'q0 - 128 - {step}')} + 128"} | {k: v.replace("STEP", step) for k, v in more.items()}
    if base:
        new = {k: f"case when hi then {new[k] if k in ('p0', 'q0') else k} else {_c(f'{k} - 128 {base_sign} ({_c(f'({factor} * w + 63) >> 7')})')} + 128 end" for k, factor, base_sign in (("p0", 27, "+"), ("p1", 18, "+"), ("p2", 9, "+"), ("q0", 27, "-"), ("q1", 18, "-"), ("q2", 9, "-"))}
    chosen = ", ".join(f"(case when yes then {new[t]} else {t} end)::bigint as {t}" if t in new else t for t in lossy.TAPS)
    return f"with {_TAPS}, s as (select *, {_HIGH} as hi, {yes} as yes, {_c(f'{_OUTER} + 3 * (q0 - p0)')} as w, {_c(f'{outer} + 3 * (q0 - p0)')} as a from e) select image_id, y, {chosen} from s"


@query(_edge_sql(_OUTER, _NEAR, {}, ""))
def edge_simple(spark, sf):
    return lossy.simple_edge(_taps(spark, sf)).select("image_id", "y", *lossy.TAPS)


_HALF = "((STEP + 1) >> 1)"


@query(_edge_sql(f"case when {_HIGH} then {_OUTER} else 0 end", _YES, {"q1": f"case when hi then q1 else {_c(f'q1 - 128 - {_HALF}')} + 128 end", "p1": f"case when hi then p1 else {_c(f'p1 - 128 + {_HALF}')} + 128 end"}, ""))
def edge_subblock(spark, sf):
    return lossy.subblock_edge(_taps(spark, sf)).select("image_id", "y", *lossy.TAPS)


@query(_edge_sql(_OUTER, _YES, {}, "all"))
def edge_macroblock(spark, sf):
    return lossy.macroblock_edge(_taps(spark, sf)).select("image_id", "y", *lossy.TAPS)


@query(f"with {PX}, s as (select image_id, y, x, v, list(v) over (partition by image_id order by y, x rows between unbounded preceding and unbounded following) as plane from px), uv as (select image_id, y, x, v, plane[((y >> 1) * 8 + (x >> 1) + 1)::int] as c from s), k as (select image_id, y, x, 298 * (v - 16) as base, c - 128 as u, c * 3 % 256 - 128 as w from uv) select image_id, y, x, {clip('(base + 516 * u + 128) >> 8')} as b, {clip('(base - 100 * u - 208 * w + 128) >> 8')} as g, {clip('(base + 409 * w + 128) >> 8')} as r, 255::bigint as a from k")
def yuv_to_bgra(spark, sf):
    p = px(spark, sf)
    return lossy.yuv_to_bgra(p.withColumnRenamed("v", "luma"), p.where("y < 4 and x < 4").selectExpr("image_id", "y", "x", "v as cb", "v * 3 % 256 as cr"))


@query(f"with {PX}, f as (select image_id * 8 + y as image_id, list(v order by x) as v from px group by image_id, y), p as (select image_id, k as part, 121 + coalesce(list_sum(v[1:k]), 0)::bigint as start, 600 + v[8] * 4 as stop, list_sum(v[1:7]) as total, v, k from f, range(0, 8) as t(k)) select image_id, part, start, (case when 121 + total <= stop then case when k < 7 then v[k + 1] else stop - start end end)::bigint as size from p")
def token_partitions(spark, sf):
    rows = px(spark, sf).groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("s")).select(F.expr("image_id * 8 + y").alias("image_id"), F.col("s.v").alias("v"))
    return lossy.token_partitions(rows.select("image_id", F.lit(100).cast("bigint").alias("start"), F.expr("600 + v[7] * 4").alias("end"), F.slice("v", 1, 7).alias("sizes")))


# Alpha, composition and output

_ALONG = "(sum(f) over (partition by image_id, {a} order by {b}))::bigint & 255"


@query(f"with {PX}, d as (select *, case when x = 0 then sum(v) over (partition by image_id, x order by y) else v end as f from px) select image_id, y, x, {_ALONG.format(a='y', b='x')} as v from d")
def alpha_unfilter_h(spark, sf):
    return compose.unfilter_horizontal(px(spark, sf))


@query(f"with {PX}, d as (select *, case when y = 0 then sum(v) over (partition by image_id, y order by x) else v end as f from px) select image_id, y, x, {_ALONG.format(a='x', b='y')} as v from d")
def alpha_unfilter_v(spark, sf):
    return compose.unfilter_vertical(px(spark, sf))


@query(f"with {PX} select image_id, y, x, v from px")
def alpha_unfilter_gradient(spark, sf):
    planes = compose.as_planes(compose.gradient_residuals(px(spark, sf)), 8, 8, "v")
    return compose.as_pixels(compose.unfilter_gradient(planes), "v").select("image_id", "y", F.col("x").cast("bigint").alias("x"), "v")


@query(f"with {COLOURS} select image_id, y, x, r, g, b, v * 11 % 256 as a from c")
def alpha_merge(spark, sf):
    return compose.merge_alpha(colours(spark, sf).select("image_id", "y", "x", "r", "g", "b"), px(spark, sf).selectExpr("image_id", "y", "x", "v * 11 % 256 as v"))


@query(f"with {COLOURS} select image_id, y, x, r, g, b, 255::bigint as a from c")
def alpha_opaque(spark, sf):
    return compose.opaque(colours(spark, sf).select("image_id", "y", "x", "r", "g", "b"))


@query(f"with {COLOURS}, f as (select distinct image_id, 2 * (image_id % 4) as fx, 2 * (image_id % 3) as fy from px where 2 * (image_id % 4) + 8 <= 12) select f.image_id, cy as y, cx as x, coalesce(argb, 0) as argb from f cross join range(0, 13) as t(cy) cross join range(0, 12) as u(cx) left join c on c.image_id = f.image_id and c.y = cy - fy and c.x = cx - fx")
def canvas_compose(spark, sf):
    frames = px(spark, sf).where("y = 0 and x = 0").selectExpr("image_id", "2 * (image_id % 4) as x", "2 * (image_id % 3) as y", "8L as w", "8L as h", "12L as canvas_w", "13L as canvas_h")
    return compose.compose(frames, colours(spark, sf))


@query(f"with {LINES} select image_id, pos, printf('%02X%02X%02X%02X', b, g, r, a) as bgra from li")
def argb_to_bgra(spark, sf):
    return lines(spark, sf).withColumn("argb", P.argb("a", "r", "g", "b")).select("image_id", "pos", compose.bgra_hex().alias("bgra"))


@query(f"with {LINES} select image_id, pos, g from li")
def extract_green(spark, sf):
    return lines(spark, sf).withColumn("argb", P.argb("a", "r", "g", "b")).select("image_id", "pos", P.channel("argb", "g").alias("g"))
