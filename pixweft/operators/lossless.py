"""Lossless (VP8L) operators as relations of pixels, blocks and codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pixels as P
from ..functions import tables


def subtract_green(pixels: DataFrame) -> DataFrame:
    """Inverse of subtract-green on columns r, g, b: green is added to red and blue."""
    return pixels.withColumns({"r": P.low8(P.long("r") + P.long("g")), "b": P.low8(P.long("b") + P.long("g"))})


def palette_delta(entries: DataFrame, by: list[str], order: str, channels: list[str]) -> DataFrame:
    """Palette entries from differences: per channel a running sum modulo 256."""
    run = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return entries.withColumns({c: P.low8(F.sum(P.long(c)).over(run)) for c in channels})


def palette_bits(size: int) -> int:
    """Bits of an index in a palette of this size."""
    return 1 if size <= 2 else 2 if size <= 4 else 4 if size <= 16 else 8


def packed_width(width: Column | str, size: int) -> Column:
    """Pixels of a packed row."""
    per = 8 // palette_bits(size)
    return P.shift(P.long(width) + per - 1, {8: 3, 4: 2, 2: 1, 1: 0}[per])


def palette_unpack(packed: DataFrame, width: int, size: int, green: str = "g") -> DataFrame:
    """(image_id, y, x, index) of rows (image_id, y, x, green) whose greens hold several indexes each, lowest bits first."""
    bits = palette_bits(size)
    per = 8 // bits
    out = packed.select("image_id", "y", P.long("x").alias("x"), P.long(green).alias("_green"), F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("_k"))
    index = F.expr(f"shiftright(_green, _k * {bits}) & {(1 << bits) - 1}")
    return out.select("image_id", "y", (F.col("x") * per + F.col("_k")).alias("x"), index.alias("index")).where(F.col("x") < width)


def palette_lookup(indexes: DataFrame, palette: DataFrame) -> DataFrame:
    """Indexes joined with palette (index, argb), which all images share, or (image_id, index, argb), one for each image; a null index and one beyond the palette give 0.

    A shared palette has at most 256 rows and is broadcast; palettes of images are joined on both columns, however many they are.
    """
    by = [c for c in ("image_id", "index") if c in palette.columns]
    own = palette.select(*by, F.col("argb").alias("_argb"))
    found = indexes.drop("argb").join(own if len(by) == 2 else F.broadcast(own), by, "left")
    return found.withColumn("argb", F.coalesce("_argb", F.lit(0).cast("bigint"))).drop("_argb")


def with_block(pixels: DataFrame, blocks: DataFrame, bits: int) -> DataFrame:
    """Each pixel with the other columns of the block (image_id, by, bx, ...) that covers it, null if there is none; they replace columns of the same names, and the pixels' own by and bx stay."""
    more = [c for c in blocks.columns if c not in ("image_id", "by", "bx")]
    own = blocks.select("image_id", F.col("by").alias("_by"), F.col("bx").alias("_bx"), *more)
    return pixels.drop(*more).withColumns({"_by": P.shift("y", bits), "_bx": P.shift("x", bits)}).join(own, ["image_id", "_by", "_bx"], "left").drop("_by", "_bx")


def color_delta(t: Column, c: Column) -> Column:
    """The product of two signed bytes over 32, as a signed byte."""
    return P.signed8(P.shift(P.signed8(t) * P.signed8(c), 5))


def cross_color(pixels: DataFrame, blocks: DataFrame, bits: int) -> DataFrame:
    """Inverse of the cross-colour transform on r, g, b; block columns green_to_red, green_to_blue, red_to_blue. Blue uses the new red."""
    joined = with_block(pixels, blocks, bits)
    red = P.low8(P.long("r") + color_delta(F.col("green_to_red"), F.col("g")))
    joined = joined.withColumn("r", red)
    blue = P.low8(P.long("b") + color_delta(F.col("green_to_blue"), F.col("g")))
    return joined.withColumn("b", P.low8(blue + color_delta(F.col("red_to_blue"), F.col("r"))))


def neighbours(pixels: DataFrame, value: str = "argb") -> DataFrame:
    """Columns l, t, tl, tr: the pixels left, above, above left and above right; in the last column tr is t."""
    row, up = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    out = pixels.withColumns({"l": F.lag(value).over(row), "t": F.lag(value).over(up)})
    return out.withColumns({"tl": F.lag("t").over(row), "tr": F.coalesce(F.lead("t").over(row), F.col("t"))})


def predicted(pixels: DataFrame, mode: Column) -> DataFrame:
    """Column pred of decoded pixels (image_id, y, x, argb): black in the corner, left in row 0, above in column 0, else by mode (unknown ones: black). Null where a pixel that counts is null."""
    n = neighbours(pixels)
    choice = F.when((F.col("x") == 0) & (F.col("y") == 0), F.lit(P.BLACK).cast("bigint")).when(F.col("y") == 0, F.col("l")).when(F.col("x") == 0, F.col("t"))
    choice = choice.when(F.col("l").isNull() | F.col("t").isNull() | F.col("tl").isNull() | F.col("tr").isNull(), F.lit(None).cast("bigint"))
    for k, p in enumerate(P.predictors(F.col("l"), F.col("t"), F.col("tl"), F.col("tr"))):
        choice = choice.when(mode == k, p)
    return n.withColumn("pred", choice.otherwise(F.lit(P.BLACK).cast("bigint")))


def predictor_residuals(pixels: DataFrame, mode: Column) -> DataFrame:
    """The forward transform: (image_id, y, x, residual)."""
    p = predicted(pixels, mode)
    return p.select("image_id", "y", "x", P.each(lambda a, b: F.pmod(a - b, F.lit(256)), F.col("argb"), F.col("pred")).alias("residual"))


def _average(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    out = (p + q) >> 1
    out[..., 1] |= ((p[..., 0] + q[..., 0]) & 1) << 7
    return out


def _predict(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """predictors() for arrays of pixels with the channels a, r, g, b last."""
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode in (6, 7, 8, 9):
        return _average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        near = abs(left.sum(-1) - corner.sum(-1)) < abs(top.sum(-1) - corner.sum(-1))
        return np.where(near[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mid = _average(left, top)
        return np.clip(mid + np.fix((mid - corner) / 2).astype(np.int64), 0, 255)
    return np.broadcast_to(np.array([255, 0, 0, 0]), left.shape)


def undo_predictor(residual: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Inverse predictor of planes (image, y, x, 4) of one size; modes (image, by, bx). Edges are running sums; the inside goes by pixels of equal x + 2y, which need only earlier ones, side by side over images."""
    out = residual.astype(np.int64).copy()
    _, height, width, _ = out.shape
    out[:, :1, :1] += np.array([255, 0, 0, 0])
    out[:, :1] = np.cumsum(out[:, :1], axis=2) & 255
    out[:, :, :1] = np.cumsum(out[:, :, :1], axis=1) & 255
    for d in range(3, width + 2 * height - 2):
        y = np.arange(max(1, (d - width + 2) // 2), min(height - 1, (d - 1) // 2) + 1)
        x = d - 2 * y
        left, top, corner, right = out[:, y, x - 1], out[:, y - 1, x], out[:, y - 1, x - 1], out[:, y - 1, np.minimum(x + 1, width - 1)]
        mode = modes[:, y >> bits, x >> bits]
        pred = np.empty_like(left)
        for m in np.unique(mode):
            at = mode == m
            pred[at] = _predict(int(m), left[at], top[at], corner[at], right[at])
        out[:, y, x] = (out[:, y, x] + pred) & 255
    return out


def _flat(lists: pa.Array, rows: np.ndarray) -> np.ndarray:
    """The values of some rows of a list column, one after the other, without Python numbers."""
    return lists.take(pa.array(rows)).flatten().to_numpy()


#: How many pixels of planes of one size are undone together; a larger plane goes alone.
PIXELS = 1 << 16


def _undone(batches: Iterator[pa.RecordBatch], bits: int | None) -> Iterator[pa.RecordBatch]:
    """The planes of a batch in parts of PIXELS: what Python holds beside the batch doesn't grow with it."""
    for batch in batches:
        size = np.stack([batch.column(c).to_numpy() for c in ("height", "width")] + [np.full(batch.num_rows, bits) if bits is not None else batch.column("bits").to_numpy()], axis=1)
        for h, w, k in np.unique(size, axis=0).tolist():
            same, some = np.flatnonzero((size == (h, w, k)).all(axis=1)), max(1, PIXELS // max(1, h * w))
            for at in range(0, len(same), some):
                rows = same[at : at + some]
                flat = _flat(batch.column("argb"), rows).reshape(len(rows), h, w)
                planes = np.stack([flat >> s & 255 for s in (24, 16, 8, 0)], axis=-1)
                modes = _flat(batch.column("modes"), rows).reshape(len(rows), (h + (1 << k) - 1) >> k, (w + (1 << k) - 1) >> k)
                packed = (undo_predictor(planes, modes, k) << np.array([24, 16, 8, 0])).sum(-1).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (h * w)), pa.array(packed))
                yield pa.RecordBatch.from_arrays([batch.column("image_id").take(pa.array(rows)), pa.array(np.full(len(rows), w)), pa.array(np.full(len(rows), h)), lists], ["image_id", "width", "height", "argb"])


PLANES = "image_id bigint, width bigint, height bigint, argb array<bigint>"


def inverse_predictor(planes: DataFrame, bits: int | None) -> DataFrame:
    """PLANES of rows with PLANES and `modes`, the block modes in row order; without bits, each image's own are in its column bits. One image is one unit of work."""
    return planes.select("image_id", "width", "height", "argb", "modes", *(["bits"] if bits is None else [])).mapInArrow(lambda b: _undone(b, bits), PLANES)


def group_select(pixels: DataFrame, blocks: DataFrame, bits: int, groups: int) -> DataFrame:
    """The code group of each pixel: bits 8 to 23 of its block's pixel; 0 where that is no group."""
    group = P.shift("meta", 8).bitwiseAND(F.lit(65535))
    return with_block(pixels, blocks, bits).withColumn("code_group", F.when(group < groups, group).otherwise(F.lit(0).cast("bigint")))


def group_count(blocks: DataFrame) -> DataFrame:
    """Code groups of each image: the greatest in use plus one."""
    return blocks.groupBy("image_id").agg((F.max(P.shift("meta", 8).bitwiseAND(F.lit(65535))) + 1).alias("n_groups"))


def prefix_value(prefix: Column | str, extra: Column | str) -> Column:
    """Lengths and distances from a prefix symbol and its extra bits; null beyond 24 extra bits."""
    p = P.long(prefix)
    n = F.shiftright(p - 2, 1)
    base = (2 + p.bitwiseAND(F.lit(1))) * F.pow(F.lit(2), n).cast("bigint")
    return F.when(p < 0, None).when(p < 4, p + 1).when(n <= 24, base + P.long(extra) + 1)


def near_codes(spark) -> DataFrame:
    """(code, rows, columns) of the short distance codes."""
    return spark.createDataFrame([(i + 1, v >> 4, 8 - (v & 15)) for i, v in enumerate(tables.NEAR)], "code bigint, up bigint, across bigint")


def distances(codes: DataFrame, width: str = "width", code: str = "code") -> DataFrame:
    """Column distance: codes over 120 count pixels, others name a near pixel, at least 1. Null where the code is null or below 1, or a near pixel's image has no width: readers fail there."""
    near = F.broadcast(near_codes(codes.sparkSession).select(F.col("code").alias("_code"), F.col("up").alias("_up"), F.col("across").alias("_across")))
    joined = codes.join(near, codes[code] == near["_code"], "left")
    short = F.col("_up") * P.long(width) + F.col("_across")
    value = F.when(P.long(code) > 120, P.long(code) - 120).when(F.col("_code").isNotNull() & (P.long(width) > 0), F.when(short < 1, 1).otherwise(short))
    return joined.withColumn("distance", value).drop("_code", "_up", "_across")


def cache_key(argb: Column | str, bits: int) -> Column:
    """The colour cache's slot of a pixel."""
    return F.shiftright((P.long(argb) * tables.CACHE_FACTOR).bitwiseAND(F.lit(4294967295)), 32 - bits)


def cache_state(pixels: DataFrame, bits: int) -> DataFrame:
    """Column before: what the pixel's cache slot held when it came (0: nothing yet)."""
    earlier = W.partitionBy("image_id", "slot").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return pixels.withColumn("slot", cache_key("argb", bits)).withColumn("before", F.coalesce(F.last("argb").over(earlier), F.lit(0).cast("bigint")))


def copied(copies: DataFrame) -> DataFrame:
    """Back-references (image_id, pos, distance, length) as rows (image_id, pos, source): an overlapping copy repeats its first `distance` pixels.

    No rows for copies of length 0 or less, and none for those that readers reject: a distance below 1 or null, a source before the start, or, where there is a column total, pixels behind the image's end (see bad_copies).
    """
    good = copies.where(~_bad_copy(copies) & (F.col("length") > 0))
    out = good.select("image_id", P.long("pos").alias("_pos"), P.long("distance").alias("_distance"), F.explode(F.expr("sequence(0L, cast(length as bigint) - 1)")).alias("_k"))
    return out.select("image_id", (F.col("_pos") + F.col("_k")).alias("pos"), (F.col("_pos") - F.col("_distance") + F.col("_k") % F.col("_distance")).alias("source"))


def _bad_copy(copies: DataFrame) -> Column:
    past = F.col("pos") + F.col("length") > F.col("total") if "total" in copies.columns else F.lit(False)
    return F.coalesce((F.col("distance") < 1) | (F.col("distance") > F.col("pos")) | past, F.lit(True))


def bad_copies(copies: DataFrame) -> DataFrame:
    """The back-references at which a reader fails."""
    return copies.where(_bad_copy(copies))


def undo_transforms(pixels: DataFrame, transforms: list[tuple]) -> DataFrame:
    """Pixels (image_id, y, x, a, r, g, b) after the inverse of transforms, which are given in the order in which they are read and undone from the last to the first.

    ("subtract-green",), ("cross-color", blocks, bits) or ("color-indexing", palette, width, size): the last one reads packed greens and restores the width.
    The predictor works on whole planes (inverse_predictor). At most four transforms, each kind once, as the format has it.
    """
    kinds = [t[0] for t in transforms]
    if len(set(kinds)) < len(kinds) or not set(kinds) <= {"subtract-green", "cross-color", "color-indexing"}:
        raise ValueError(f"no such transforms: {kinds}")
    for kind, *own in reversed(transforms):
        if kind == "subtract-green":
            pixels = subtract_green(pixels)
        elif kind == "cross-color":
            pixels = cross_color(pixels, *own).select("image_id", "y", "x", "a", "r", "g", "b")
        else:
            palette, width, size = own
            found = palette_lookup(palette_unpack(pixels, width, size), palette)
            pixels = found.select("image_id", "y", "x", *(P.channel("argb", c).alias(c) for c in "argb"))
    return pixels
