"""Queries over container bytes, and the same in SQL: a recursive walk over the hexadecimal digits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import clip, query
from .functions import sql
from .operators import alpha, compose, container
from .plans.images import IMAGES, images
from .plans.planes import COLOURS, LINES, colours, lines
from .sources.container import chunks


def _u(h: str, at: str, n: int) -> str:
    """n bytes of digits h as a number, lowest first; bytes beyond the end count as 0."""
    return "(" + " + ".join(f"coalesce(try_cast('0x' || substr({h}, (2 * ({at}) + {2 * k + 1})::int, 2) as bigint), 0) * {256**k}" for k in range(n)) + ")"


def _tag(h: str, at: str) -> str:
    return f"chr({_u(h, at, 1)}::int) || chr({_u(h, f'{at} + 1', 1)}::int) || chr({_u(h, f'{at} + 2', 1)}::int) || chr({_u(h, f'{at} + 3', 1)}::int)"


def _next(source: str) -> str:
    """The walk's step from rows (image_id, ordinal, next, stop, fits, h)."""
    size = _u("h", "next + 4", 4)
    return f"select image_id, ordinal + 1 as ordinal, next as place, {size} as size, next + 8 as payload, next + 8 + {size} + {size} % 2 <= stop as fits, next + 8 + {size} + {size} % 2 as next, stop, h from {source} where fits and next + 8 <= stop"


_GOOD = "length(h) // 2 >= 20 and substr(h, 1, 8) = '52494646' and substr(h, 17, 8) = '57454250'"
_WALK = f"""with recursive {IMAGES},
walk as (select image_id, -1::bigint as ordinal, 0::bigint as place, (length(h) // 2)::bigint as size, 12::bigint as payload, {_GOOD} as fits, 12::bigint as next, (length(h) // 2)::bigint as stop, h from img union all {_next('walk')}),
anim as (select image_id, payload, size, h from walk where ordinal >= 0 and fits and {_tag('h', 'place')} = 'ANMF' qualify row_number() over (partition by image_id order by ordinal) = 1),
inner_ as (select image_id, -1::bigint as ordinal, null::bigint as place, null::bigint as size, null::bigint as payload, true as fits, payload + 16 as next, payload + size as stop, h from anim union all {_next('inner_')}),
ch as (select image_id, scope, ordinal, place, case when ordinal >= 0 then {_tag('h', 'place')} end as tag, size, payload, fits, case when ordinal >= 0 then substr(h, 2 * payload::int + 1, 2 * least(size, 16)::int) end as head, h from (select 'file' as scope, * from walk union all select 'frame', * from inner_ where ordinal >= 0))"""


@query(f"{_WALK} select image_id, scope, ordinal, place, tag, size, payload, fits, head from ch")
def riff_chunks(spark, sf):
    return chunks(images(spark, sf)).select("image_id", "scope", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("at").alias("place"), "tag", "size", "payload", "fits", F.hex("head").alias("head"))


@query(f"{_WALK} select image_id, scope, ordinal, place, tag, size, payload, fits, head from ch")
def riff_chunks_in_sql(spark, sf):
    """riff_chunks as plain SQL over a registered table function."""
    sql.register(spark)
    return spark.sql("select image_id, c.scope, cast(c.ordinal as bigint) as ordinal, c.at as place, c.tag, c.size, c.payload, c.fits, hex(c.head) as head from {files}, lateral webp_chunks(content) c", files=images(spark, sf))


@query(
    f"with {LINES}, p as (select *, a * 16777216 + r * 65536 + g * 256 + b as argb, a * 16777216 + a * 65536 + r * 256 + r as other from li) select image_id, pos, least(200, greatest(50, r)) as clipped, argb, (argb >> 8) & 255 as green, "
    "((((a + b) // 2) << 24) | (((r + g) // 2 | ((a + b) % 2) * 128) << 16) | (((g + r) // 2) << 8) | ((b + a) // 2)) as average, case when abs(a + r + g + b - 510) < abs(2 * a + 2 * r - 510) then argb else other end as chosen, "
    "(r + g + 1) // 2 as two, (r + 2 * g + b + 2) // 4 as three, ((argb * 506832829) & 4294967295) >> 24 as slot, case when r % 40 < 4 then r % 40 + 1 else ((2 + r % 2) << ((r % 40 - 2) // 2)::int) + g + 1 end as value, r * r * g as needed from p"
)
def pixel_functions_in_sql(spark, sf):
    sql.register(spark)
    return spark.sql(
        "select image_id, pos, px_clip(r, 50, 200) as clipped, argb, px_channel(argb, 1) as green, px_average(argb, px_argb(b, g, r, a)) as average, "
        "px_select(argb, px_argb(a, a, r, r), px_argb(255, 255, 0, 0)) as chosen, px_mean2(r, g) as two, px_mean3(r, g, b) as three, px_cache_slot(argb, 8) as slot, px_prefix_value(r % 40, g) as value, px_needed_bytes(r * r, g) as needed "
        "from (select *, px_argb(a, r, g, b) as argb from {li})",
        li=lines(spark, sf),
    )


def _pick(scope: str, tag: str, last: bool = False) -> str:
    """The place of the chunk that counts."""
    return f"{'arg_max' if last else 'arg_min'}(payload, ordinal) filter (where ordinal >= 0 and fits and scope = '{scope}' and tag = '{tag}')"


_SIZES = {"vp8x": ("file", "VP8X", True), "vp8l": ("file", "VP8L", False), "vp8": ("file", "VP8 ", False), "alph": ("file", "ALPH", False), "anmf": ("file", "ANMF", False), "frame_vp8l": ("frame", "VP8L", False), "frame_vp8": ("frame", "VP8 ", False), "frame_alph": ("frame", "ALPH", False)}
_PLACES = ", ".join(f"{_pick(*own)} as {name}, {_pick(*own).replace('(payload,', '(size,')} as {name}_size" for name, own in _SIZES.items())
_PARTS = f"""{_WALK}, parts as (select image_id, any_value(h) as h, bool_or(ordinal = -1 and fits) as good, coalesce(bool_or(scope = 'file' and tag in ('ANIM', 'ANMF')), false) as has_anim,
arg_min(tag, ordinal) filter (where scope = 'file' and ordinal >= 0 and (not fits or tag = 'VP8X' and size < 10)) as bad, arg_min(tag, ordinal) filter (where scope = 'frame' and not fits) as frame_bad, {_PLACES} from ch group by image_id)"""


@query(f"{_PARTS} select image_id, good, has_anim, bad, frame_bad, vp8x, vp8l, vp8l_size, vp8, vp8_size, alph, alph_size, anmf, anmf_size, frame_vp8l, frame_vp8, frame_alph from parts")
def container_info(spark, sf):
    at = [F.col(f"{n}.payload").alias(n) for n in ("vp8x", "frame_vp8l", "frame_vp8", "frame_alph")]
    both = [c for n in ("vp8l", "vp8", "alph", "anmf") for c in (F.col(f"{n}.payload").alias(n), F.col(f"{n}.size").alias(f"{n}_size"))]
    return container.parts(chunks(images(spark, sf))).select("image_id", "good", "has_anim", "bad", "frame_bad", *at, *both)


def _vp8(at: str, size: str) -> tuple[str, str]:
    w, h = (f"({_u('h', f'{at} + {k}', 2)} & 16383)" for k in (6, 8))
    fits = f"{size} >= 10 and substr(h, 2 * {at}::int + 7, 6) = '9D012A' and {w} > 0 and {h} > 0"
    return f"case when {fits} then {w} end", f"case when {fits} then {h} end"


_BITS = f"case when vp8l_size >= 5 and {_u('h', 'vp8l', 1)} = 47 then {_u('h', 'vp8l + 1', 4)} end"
_DIMS = [(f"case when vp8x is not null then 1 + {_u('h', f'vp8x + {k}', 3)} end", f"1 + (({_BITS}) >> {s} & 16383)", v, f"case when anmf_size >= 16 then 1 + {_u('h', f'anmf + {a}', 3)} end") for k, s, v, a in zip((4, 7), (0, 14), _vp8("vp8", "vp8_size"), (6, 9), strict=True)]
_PROBE = f"""{_PARTS}, dims as (select *, coalesce({', '.join(_DIMS[0])}) as w0, coalesce({', '.join(_DIMS[1])}) as h0 from parts),
why as (select *, case when not good then 'invalid-header' when bad is not null then 'chunk-bounds' when vp8 is null and vp8l is null and anmf is null then 'missing-image-payload' when w0 is null then 'invalid-dimensions' else 'ok' end as reason from dims),
probe as (select *, case when reason = 'ok' then w0 end as width, case when reason = 'ok' then h0 end as height, case when reason = 'chunk-bounds' then bad else '----' end as chunk, case when reason in ('ok', 'invalid-dimensions') then 'ok' else 'container' end as stage from why)"""


@query(f"{_PROBE} select image_id, width, height, reason, chunk, stage from probe")
def webp_info(spark, sf):
    return container.probe(chunks(images(spark, sf))).select("image_id", "width", "height", "reason", "chunk", "stage")


def _after(scope: str, w: str, h: str) -> str:
    """The failures that headers tell, as a code; 0 for none."""
    own_w, own_h = _vp8(f"{scope}vp8", f"{scope}vp8_size")
    at, size = f"{scope}vp8", f"{scope}vp8_size"
    fits = f"coalesce({_u('h', at, 1)} % 2 = 0 and greatest({own_w}, {own_h}) <= 4096 and ({own_w}) = {w} and ({own_h}) = {h} and 10 + ({_u('h', at, 3)} >> 5) <= {size}, false)"
    first = _u("h", f"{scope}alph", 1)
    return f"case when {scope}vp8l is not null then case when {scope}vp8l_size >= 5 and {_u('h', f'{scope}vp8l', 1)} = 47 then 0 else 1 end when not {fits} then 2 when {scope}alph is null then 0 when {scope}alph_size = 0 then 3 when {first} % 4 > 1 then 4 when {first} % 4 = 0 and {scope}alph_size < 1 + {w} * {h} then 5 else 0 end"


_STRIDE, _ROOM = "case image_id % 7 when 0 then 0 when 1 then coalesce(4 * width, 4) - 1 else coalesce(4 * width, 4) + 3 end", "coalesce(height, 1)"
_OUTCOME = f"""{_PROBE}, box as (select *, {_STRIDE} as stride, ({_STRIDE}) * {_ROOM} - case when image_id % 5 = 0 then 1 else 0 end as room, has_anim and anmf is not null as moving,
{', '.join(f"case when anmf_size >= 16 then {c} end as {n}" for n, c in (('x', f"2 * {_u('h', 'anmf', 3)}"), ('y', f"2 * {_u('h', 'anmf + 3', 3)}"), ('w', f"1 + {_u('h', 'anmf + 6', 3)}"), ('hh', f"1 + {_u('h', 'anmf + 9', 3)}")))} from probe),
coded as (select *, case when stride <= 0 then 'a' when reason <> 'ok' then 'b' when stride < 4 * width or stride * height > room then 'c' when moving and w is null then 'd' when moving and (x + w > width or y + hh > height) then 'e' when moving and frame_bad is not null then 'f' when moving and frame_vp8 is null and frame_vp8l is null then 'g' end as before from box),
ended as (select *, case when before is not null then null when moving then {_after('frame_', 'w', 'hh')} else {_after('', 'width', 'height')} end as code,
case when moving then case when frame_vp8l is not null then 'vp8l' when frame_alph is not null then 'vp8+alph' else 'vp8' end else case when vp8l is not null then 'vp8l' when alph is not null then 'vp8+alph' else 'vp8' end end as way from coded)"""


def _outcome(spark, sf):
    stride = F.when(F.col("image_id") % 7 == 0, 0).when(F.col("image_id") % 7 == 1, F.coalesce(4 * F.col("width"), F.lit(4)) - 1).otherwise(F.coalesce(4 * F.col("width"), F.lit(4)) + 3)
    return container.outcome(chunks(images(spark, sf), ("ALPH",)), stride, stride * F.coalesce("height", F.lit(1)) - F.when(F.col("image_id") % 5 == 0, 1).otherwise(0))


@query(
    f"""{_OUTCOME} select image_id, case when before is null then case when moving then 'frame ' else '' end || way end as path, before is null and code = 0 as done,
case before when 'a' then 'invalid-dimensions' when 'b' then reason when 'c' then 'invalid-dimensions' when 'd' then 'chunk-bounds' when 'e' then 'frame-bounds' when 'f' then 'chunk-bounds' when 'g' then 'missing-image-payload' else case code when 1 then 'decode-backend-failed' when 2 then 'decode-backend-failed' when 4 then 'alph-unsupported-mode' when 5 then 'alph-invalid-payload' else 'ok' end end as reason,
case when before in ('a', 'c') then '----' when before = 'b' then chunk when before = 'f' then frame_bad when before is not null then 'ANMF' when code = 1 then 'VP8L' when code = 2 then 'VP8 ' when code = 3 then '----' when code in (4, 5) then 'ALPH' when moving then 'ANMF' else case way when 'vp8l' then 'VP8L' when 'vp8' then 'VP8 ' else 'ALPH' end end as chunk,
case when before = 'a' then 'container' when before = 'b' then stage when before is not null then 'ok' else case code when 1 then 'header' when 2 then 'vp8' when 4 then 'alph-mode' when 5 then 'alph-raw' else 'ok' end end as stage from ended"""
)
def error_reason(spark, sf):
    return _outcome(spark, sf).select("image_id", "path", "done", "reason", "chunk", "stage")


@query(f"with {LINES}, o as (select image_id, pos, r * r * (case when a > 200 then 4611686018427 else 5 end) as stride, 1 + g as width, b * b * b as height from li) select image_id, pos, case when stride::hugeint * height <= 9223372036854775807 then stride * height end as needed, case when stride::hugeint * (height - 1) + 4 * width <= 9223372036854775807 then stride * (height - 1) + 4 * width end as least from o")
def output_bytes(spark, sf):
    rows = lines(spark, sf).selectExpr("image_id", "pos", "r * r * if(a > 200, 4611686018427L, 5L) as stride", "1 + g as width", "b * b * b as height")
    return rows.select("image_id", "pos", container.needed_bytes(F.col("stride"), F.col("height")).alias("needed"), container.least_output(F.col("stride"), F.col("width"), F.col("height")).alias("least"))


def _planes(spark, sf):
    """The raw alpha planes of images whose outcome isn't an error, with their size."""
    own = _outcome(spark, sf).where("done and path in ('vp8+alph', 'frame vp8+alph')")
    still = F.col("path") == "vp8+alph"
    return own.select("image_id", "path", "x", "y", F.when(still, F.col("width")).otherwise(F.col("w")).alias("width"), F.when(still, F.col("height")).otherwise(F.col("h")).alias("height"), F.when(still, F.col("alph.body")).otherwise(F.col("frame_alph.body")).alias("body"), F.col("width").alias("canvas_w"), F.col("height").alias("canvas_h"))


_LEFT, _TOP, _CORNER = "out[i]", "out[i - 7]", "out[i - 8]"
_GUESS = f"case when i = 0 then 0 when kind = 0 then 0 when kind = 1 then case when i % 8 > 0 then {_LEFT} else {_TOP} end when kind = 2 then case when i > 7 then {_TOP} else {_LEFT} end when i < 8 then {_LEFT} when i % 8 = 0 then {_TOP} else {clip(f'{_LEFT} + {_TOP} - {_CORNER}')} end"
_ALPHA = f"""{_OUTCOME}, raw as (select image_id, moving, x, y, width, height, case when moving then frame_alph else alph end as place, h from ended where code = 0 and before is null and way = 'vp8+alph'),
start as (select *, ({_u('h', 'place', 1)} >> 2) & 3 as kind from raw),
grown as (select image_id, moving, x, y, width, height, place, h, kind, 0 as i, []::bigint[] as out from start union all
  select image_id, moving, x, y, width, height, place, h, kind, i + 1, list_append(out, ({_u('h', 'place + 1 + i', 1)} + {_GUESS}) & 255) from grown where i < 64),
plane as (select image_id, moving, x as fx, y as fy, width, height, j // 8 as y, j % 8 as x, out[j + 1] as v from grown, range(0, 64) as s(j) where i = 64)"""
_ALPHA = f"{_ALPHA}, {COLOURS}"


@query(f"{_ALPHA} select p.image_id, p.y::bigint as y, p.x::bigint as x, c.r, c.g, c.b, p.v as a from plane p join c on c.image_id = p.image_id and c.y = p.y and c.x = p.x")
def alpha_raw_apply(spark, sf):
    return alpha.applied(colours(spark, sf).select("image_id", "y", "x", "r", "g", "b"), _planes(spark, sf)).select("image_id", "y", "x", "r", "g", "b", "a")


@query(f"{_ALPHA}, cells as (select distinct image_id, fx, fy, cy, cx from plane, range(0, 30) as s(cy), range(0, 40) as t(cx) where moving) select e.image_id, e.cy::bigint as y, e.cx::bigint as x, coalesce(p.v * 16777216 + c.r * 65536 + c.g * 256 + c.b, 0) as argb from cells e left join plane p on p.image_id = e.image_id and p.y = e.cy - e.fy and p.x = e.cx - e.fx left join c on c.image_id = p.image_id and c.y = p.y and c.x = p.x")
def frame_compose(spark, sf):
    own = _planes(spark, sf).where("path = 'frame vp8+alph'")
    merged = alpha.applied(colours(spark, sf).select("image_id", "y", "x", "r", "g", "b"), own)
    frames = own.selectExpr("image_id", "x", "y", "width as w", "height as h", "canvas_w", "canvas_h")
    return compose.compose(frames, merged.selectExpr("image_id", "y", "x", "a * 16777216 + r * 65536 + g * 256 + b as argb"))
