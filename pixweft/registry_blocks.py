"""Queries over prediction, filter choice, runs of code lengths and chains of transforms, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import clip, query
from .functions import pixels as P
from .functions import tables
from .operators import codes, compose, lossless, lossy
from .plans.planes import COLOURS, LINES, PX, colours, lines, px, table

# Prediction


def _edges(spark, sf, n: int):
    """Blocks whose edges are the rows and columns of an image, repeated up to n samples."""
    side = lambda c, by: F.transform(F.array_sort(F.collect_list(F.when(F.col(by) == 0, F.struct(c, F.col("v").alias("v"))))), lambda s: s["v"])
    one = px(spark, sf).groupBy("image_id").agg(side("x", "y").alias("t"), side("y", "x").alias("l"), F.max(F.when((F.col("y") == 7) & (F.col("x") == 7), F.col("v"))).alias("corner"))
    grown = [F.slice(F.concat(c, F.transform(c, lambda v: 255 - v)), 1, n).alias(name) for c, name in (("t", "top"), ("l", "left"))]
    return one.select("image_id", "corner", *grown, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("block")).selectExpr("*", "block % 5 as mode", "block = 5 or image_id % 2 = 0 as has_top", "block = 5 or image_id % 3 = 0 as has_left")


def _edges_sql(n: int) -> str:
    grown = lambda c: f"list_concat({c}, list_transform({c}, lambda v: 255 - v))[1:{n}]"
    return f"{PX}, one as (select image_id, list(v order by x) filter (where y = 0) as t, list(v order by y) filter (where x = 0) as l, max(v) filter (where y = 7 and x = 7) as corner from px group by image_id), e as (select image_id, block::bigint as block, block % 5 as mode, corner, {grown('t')} as top, {grown('l')} as lft, block = 5 or image_id % 2 = 0 as has_top, block = 5 or image_id % 3 = 0 as has_left from one, range(0, 6) as s(block))"


def _predict_sql(n: int) -> str:
    total, count = "(case when has_top then list_sum(top) else 0 end + case when has_left then list_sum(lft) else 0 end)", f"({n} * (has_top::int + has_left::int))"
    mean = f"case when {count} = 0 then 128 else ({total} + {count} // 2) // {count} end"
    return f"with {_edges_sql(n)} select image_id, block, y::bigint as y, x::bigint as x, (case mode when 0 then {mean} when 1 then top[x + 1] when 2 then lft[y + 1] when 3 then {clip('lft[y + 1] + top[x + 1] - corner')} end)::bigint as v from e, range(0, {n}) as a(y), range(0, {n}) as b(x)"


@query(_predict_sql(16))
def predict_luma(spark, sf):
    return lossy.predict_blocks(_edges(spark, sf, 16), 16)


@query(_predict_sql(8))
def predict_chroma(spark, sf):
    return lossy.predict_blocks(_edges(spark, sf, 8), 8)


def _m2(a: str, b: str) -> str:
    return f"({a} + {b} + 1) >> 1"


def _m3(a: str, b: str, c: str) -> str:
    return f"({a} + 2 * {b} + {c} + 2) >> 2"


def _small_sql(mode: int, y: int, x: int) -> str:
    """A sample by its mode's own picture, from l1..l4 (downward), k, t1..t8."""
    left, top = ["l1", "l2", "l3", "l4"], [f"t{k}" for k in range(1, 9)]
    line = [*reversed(left), "k", *top]
    if mode == 0:
        return f"({' + '.join(left + top[:4])} + 4) >> 3"
    if mode == 1:
        return clip(f"{left[y]} + {top[x]} - k")
    if mode == 2:
        return _m3(line[4 + x], line[5 + x], line[6 + x])
    if mode == 3:
        return _m3(["k", *left][y], left[y], [*left, "l4"][y + 1])
    if mode == 4:
        return _m3(top[x + y], top[x + y + 1], top[min(x + y + 2, 7)])
    if mode == 5:
        return _m3(*line[3 + x - y : 6 + x - y])
    if mode in (6, 8):
        own, (a, b) = (line, (y, x)) if mode == 6 else (line[:9][::-1] + line[9:], (x, y))
        if a % 2 == 0 and 2 * b >= a:
            return _m2(own[4 + b - a // 2], own[5 + b - a // 2])
        if 2 * b >= a - 1:
            return _m3(*own[3 + b - a // 2 : 6 + b - a // 2])
        return _m3(*own[4 - a : 7 - a]) if a == 3 else _m3(own[2], own[3], own[4])
    if mode == 7:
        k = x + y // 2
        if (y, x) == (2, 3):
            return _m3(*top[4:7])
        if (y, x) == (3, 3):
            return _m3(*top[5:8])
        return _m3(*top[k : k + 3]) if y % 2 else _m2(*top[k : k + 2])
    down = [*left, "l4", "l4", "l4", "l4"]
    k = y + x // 2
    if x + 2 * y > 5:
        return "l4"
    return _m3(*down[k : k + 3]) if x % 2 else _m2(*down[k : k + 2])


_CELLS = " union all ".join(f"select image_id, block, {y}::bigint as y, {x}::bigint as x, (case mode {' '.join(f'when {m} then {_small_sql(m, y, x)}' for m in range(10))} else 128 end)::bigint as v from e" for y in range(4) for x in range(4))
_SMALL = f"{PX}, p as (select image_id, list(v order by y, x) as s from px group by image_id), e as materialized (select image_id, m::bigint as block, m as mode, {', '.join(f's[{k + 1}] as l{4 - k}' for k in range(4))}, s[5] as k, {', '.join(f's[{k + 6}] as t{k + 1}' for k in range(8))} from p, range(0, 11) as r(m))"


@query(f"with {_SMALL} {_CELLS}")
def predict_small(spark, sf):
    edges = px(spark, sf).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("s")).select("image_id", F.slice(F.col("s.v"), 1, 13).alias("edge"))
    return lossy.predict_small(edges.withColumn("block", F.explode(F.expr("sequence(0L, 10L)"))).withColumn("mode", F.col("block")))


@query(f"with {LINES} select image_id, pos, (r + g + 1) // 2 as two, (r + 2 * g + b + 2) // 4 as three from li")
def rounded_means(spark, sf):
    return lines(spark, sf).select("image_id", "pos", P.mean2("r", "g").alias("two"), P.mean3("r", "g", "b").alias("three"))


@query(f"with {LINES} select image_id, pos, (case r % 6 when 0 then 0 when 1 then 2 when 2 then 3 when 3 then 1 else 0 end)::bigint as context, case when g % 9 > 0 then b % (g % 9) end as part from li")
def mode_and_partition(spark, sf):
    return lines(spark, sf).select("image_id", "pos", lossy.mode_context(F.col("r") % 6).alias("context"), lossy.partition_of("b", F.col("g") % 9).alias("part"))


@query("with s as (select p_partkey::bigint as image_id, (p_partkey % 128)::bigint as base, (p_size * 5 - 120)::bigint as own, p_size % 2 = 0 as absolute from part) select image_id, greatest(0, least(127, case when absolute then own else base + own end)) as q from s")
def segment_quant(spark, sf):
    rows = table(spark, sf, "part").selectExpr("cast(p_partkey as bigint) as image_id", "cast(p_partkey % 128 as bigint) as base", "cast(p_size * 5 - 120 as bigint) as own", "p_size % 2 = 0 as absolute")
    return rows.select("image_id", lossy.segment_quantizer("base", "own", "absolute").alias("q"))


# Filters


def _taps_sql() -> str:
    taps = ", ".join(f"max(case when x = {k} then 100 + v % 24 end) as {n}" for k, n in enumerate(lossy.TAPS))
    return f"{PX}, e as (select image_id, y, {taps}, (array['simple', 'subblock', 'macroblock'])[(1 + (image_id + y) % 3)::int] as kind, 8 + image_id % 20 as interior, image_id % 3 * 4 as hev, 20 + image_id % 40 as mb_edge, 16 + image_id % 44 as sub_edge from px group by image_id, y)"


def _s8(x: str) -> str:
    return clip(x, -128, 127)


def _dispatch_sql() -> str:
    """All three filters of a row of taps, then the one that its kind names."""
    near = "2 * abs(p0 - q0) + (abs(p1 - q1) >> 1)"
    smooth = " and ".join(f"abs({a} - {b}) <= interior" for a, b in (("p3", "p2"), ("p2", "p1"), ("p1", "p0"), ("q3", "q2"), ("q2", "q1"), ("q1", "q0")))
    first = f"select *, {near} as near_, {smooth} as smooth, abs(p1 - p0) > hev or abs(q1 - q0) > hev as high, {_s8('p1 - q1')} as outer_ from e"
    second = f"select *, {_s8('case when kind = ' + chr(39) + 'subblock' + chr(39) + ' and not high then 3 * (q0 - p0) else outer_ + 3 * (q0 - p0) end')} as a, {_s8('outer_ + 3 * (q0 - p0)')} as w, case kind when 'simple' then near_ <= mb_edge when 'subblock' then near_ <= sub_edge and smooth else near_ <= mb_edge and smooth end as yes from f"
    third = f"select *, {_s8('a + 4')} >> 3 as down, {_s8('a + 3')} >> 3 as up from g"
    move = lambda tap, by: f"{_s8(f'{tap} - 128 + {by}')} + 128"
    out = []
    for tap in lossy.TAPS:
        sign, k = ("+" if tap[0] == "p" else "-"), int(tap[1])
        step = move(tap, "up") if tap == "p0" else move(tap, "(-down)")
        weak = move(tap, f"({sign}({_s8(f'({(27, 18, 9, 0)[k]} * w + 63) >> 7')}))")
        half = move(tap, f"({sign}((down + 1) >> 1))")
        simple, sub, macro = (step, step, f"case when high then {step} else {weak} end") if k == 0 else (tap, f"case when high then {tap} else {half} end" if k == 1 else tap, f"case when high then {tap} else {weak} end" if k < 3 else tap)
        out.append(f"(case when not yes then {tap} when kind = 'simple' then {simple} when kind = 'subblock' then {sub} else {macro} end)::bigint as {tap}")
    return f"with {_taps_sql()}, f as ({first}), g as ({second}), h as ({third}) select image_id, y, kind, {', '.join(out)} from h"


@query(_dispatch_sql())
def edge_dispatch(spark, sf):
    taps = [F.max(F.when(F.col("x") == k, 100 + F.col("v") % 24)).alias(n) for k, n in enumerate(lossy.TAPS)]
    limits = {"kind": "element_at(array('simple', 'subblock', 'macroblock'), cast(1 + (image_id + y) % 3 as int))", "interior": "8 + image_id % 20", "hev": "image_id % 3 * 4", "mb_edge": "20 + image_id % 40", "sub_edge": "16 + image_id % 44"}
    rows = px(spark, sf).groupBy("image_id", "y").agg(*taps).selectExpr("*", *(f"{e} as {n}" for n, e in limits.items()))
    return lossy.filter_edges(rows).select("image_id", "y", "kind", *lossy.TAPS)


# Prefix codes and packing

_SYMBOLS = f"{PX}, s as (select image_id as tree, y * 8 + x as pos, v % 20 as symbol, v // 20 as extra from px)"
_LAST = "coalesce(last_value(case when symbol between 1 and 15 then symbol end ignore nulls) over (partition by tree order by pos rows between unbounded preceding and 1 preceding), 8)"


@query(f"with {_SYMBOLS} select tree, pos, (case when symbol < 16 then symbol when symbol = 16 then {_LAST} when symbol < 19 then 0 end)::bigint as value, case when symbol < 16 then 1 when symbol < 18 then 3 + extra when symbol = 18 then 11 + extra end as repeat from s")
def run_symbols(spark, sf):
    return codes.run_symbols(px(spark, sf).selectExpr("image_id as tree", "y * 8 + x as pos", "v % 20 as symbol", "v div 20 as extra"))


@query(f"with {PX} select image_id as tree, y * 8 + x as pos, v % 8 as len, case when y * 8 + x < 19 then {tables.LENGTH_ORDER}[(y * 8 + x + 1)::int] end::bigint as symbol from px")
def length_symbols(spark, sf):
    return codes.length_symbols(px(spark, sf).selectExpr("image_id as tree", "y * 8 + x as pos", "v % 8 as len"))


@query(" union all ".join(f"select p_partkey::bigint as image_id, {n}::bigint as colours, (p_size::bigint + {per - 1}) // {per} as width from part" for n, per in ((1, 8), (2, 8), (3, 4), (4, 4), (5, 2), (16, 2), (17, 1), (256, 1))))
def packed_widths(spark, sf):
    sizes = F.array(*(F.struct(F.lit(n).cast("bigint").alias("n"), lossless.packed_width("p_size", n).alias("width")) for n in (1, 2, 3, 4, 5, 16, 17, 256)))
    return table(spark, sf, "part").select(F.col("p_partkey").cast("bigint").alias("image_id"), F.explode(sizes).alias("s")).select("image_id", F.col("s.n").alias("colours"), F.col("s.width").alias("width"))


def _unpacked(size: int) -> str:
    bits = lossless.palette_bits(size)
    per = 8 // bits
    return f"select image_id, {size}::bigint as colours, y, x * {per} + k as x, (v >> (k * {bits})::int) & {(1 << bits) - 1} as index from px, range(0, {per}) as t(k)"


@query(f"with {PX} {' union all '.join(_unpacked(n) for n in (2, 4, 17))}")
def palette_unpack_sizes(spark, sf):
    one = lambda n: lossless.palette_unpack(px(spark, sf), 64 // lossless.palette_bits(n), n, "v").withColumn("colours", F.lit(n).cast("bigint"))
    return one(2).unionByName(one(4)).unionByName(one(17)).select("image_id", "colours", "y", "x", "index")


@query(f"with {COLOURS}, pal as (select image_id, v // 16 as index, max(argb) as argb from c group by all) select image_id, y, x, px.v % 16 as index, coalesce(argb, 0) as argb from px left join pal using (image_id) where pal.index = px.v % 16 or pal.image_id is null union all select image_id, y, x, px.v % 16, 0 from px where not exists (select 1 from pal where pal.image_id = px.image_id and pal.index = px.v % 16)")
def image_palettes(spark, sf):
    palettes = colours(spark, sf).groupBy("image_id", F.expr("v div 16").alias("index")).agg(F.max("argb").alias("argb"))
    return lossless.palette_lookup(px(spark, sf).selectExpr("image_id", "y", "x", "v % 16 as index"), palettes).select("image_id", "y", "x", "index", "argb")


@query(f"with {PX}, pal as (select p_partkey::bigint as idx, (p_partkey::bigint * 2654435761) % 4294967296 as argb from part where p_partkey < 16), u as (select image_id, y, x * 2 + k as x, (v >> (k * 4)::int) & 15 as idx from px, range(0, 2) as t(k)), w as (select image_id, y, x, coalesce(argb, 0) as p from u left join pal using (idx)) select image_id, y, x, p >> 24 as a, ((p >> 16) + (p >> 8)) & 255 as r, (p >> 8) & 255 as g, (p + (p >> 8)) & 255 as b from w")
def transform_chain(spark, sf):
    """Read as subtract-green, then colour indexing: undone from the last to the first, the width restored."""
    pal = table(spark, sf, "part").where("p_partkey < 16").selectExpr("cast(p_partkey as bigint) as index", "cast(p_partkey as bigint) * 2654435761 % 4294967296 as argb")
    packed = px(spark, sf).selectExpr("image_id", "y", "x", "v as g")
    return lossless.undo_transforms(packed, [("subtract-green",), ("color-indexing", pal, 16, 16)]).select("image_id", "y", "x", "a", "r", "g", "b")


# Residuals by windows over the decoded pixels

_MEAN = "((({0} & 16711935) + ({1} & 16711935)) >> 1 & 16711935) | ((((({0} >> 8) & 16711935) + (({1} >> 8) & 16711935)) >> 1) << 8)"


def _mean(p: str, q: str) -> str:
    return "(" + _MEAN.format(p, q) + ")"


def _ch(p: str, shift: int) -> str:
    return f"(({p}) >> {shift} & 255)"


def _by_channel(f) -> str:
    return " + ".join(f"(({f(s)}) << {s})" for s in (24, 16, 8, 0))


def _sum(p: str) -> str:
    return "(" + " + ".join(_ch(p, s) for s in (24, 16, 8, 0)) + ")"


_MODES = ["4278190080", "l", "t", "tr", "tl", _mean(_mean("l", "tr"), "t"), _mean("l", "tl"), _mean("l", "t"), _mean("tl", "t"), _mean("t", "tr"), _mean(_mean("l", "tl"), _mean("t", "tr"))]
_MODES.append(f"case when abs({_sum('l')} - {_sum('tl')}) < abs({_sum('t')} - {_sum('tl')}) then l else t end")
_MODES.append(_by_channel(lambda s: clip(f"{_ch('l', s)} + {_ch('t', s)} - {_ch('tl', s)}")))
_MODES.append(_by_channel(lambda s: clip(f"{_ch('m', s)} + trunc(({_ch('m', s)} - {_ch('tl', s)}) / 2.0)::bigint")))
_NEIGHBOURS = f"{COLOURS}, n as (select *, lag(argb) over rows_ as l, lag(argb) over columns_ as t from c window rows_ as (partition by image_id, y order by x), columns_ as (partition by image_id, x order by y)), o as (select *, lag(t) over rows_ as tl, coalesce(lead(t) over rows_, t) as tr from n window rows_ as (partition by image_id, y order by x)), q as (select *, {_mean('l', 't')} as m, (image_id + y // 4 * 2 + x // 4) % 14 as mode from o)"
_GUESSED = f"case when y = 0 and x = 0 then 4278190080 when y = 0 then l when x = 0 then t else case mode {' '.join(f'when {k} then {e}' for k, e in enumerate(_MODES))} end end"


@query(f"with {_NEIGHBOURS}, g as (select image_id, y, x, argb, {_GUESSED} as p from q) select image_id, y, x, {_by_channel(lambda s: f'({_ch("argb", s)} - {_ch("p", s)}) & 255')} as residual from g")
def predictor_residuals(spark, sf):
    mode = F.pmod(F.col("image_id") + F.expr("y div 4 * 2 + x div 4"), F.lit(14))
    return lossless.predictor_residuals(colours(spark, sf), mode)


@query(f"with {PX}, n as (select *, lag(v) over rows_ as l, lag(v) over columns_ as t from px window rows_ as (partition by image_id, y order by x), columns_ as (partition by image_id, x order by y)), o as (select *, lag(t) over (partition by image_id, y order by x) as tl from n) select image_id, y, x, (v - case when x = 0 and y = 0 then 0 when y = 0 then l when x = 0 then t else {clip('l + t - tl')} end) & 255 as v from o")
def gradient_residuals(spark, sf):
    return compose.gradient_residuals(px(spark, sf))
