"""Alpha planes, canvas composition and output layouts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pixels as P


def unfilter_horizontal(plane: DataFrame) -> DataFrame:
    """(image_id, y, x, v): each sample adds its left one, in column 0 the one above; a running sum down column 0, then one along each row."""
    down = W.partitionBy("image_id", "x").orderBy("y").rowsBetween(W.unboundedPreceding, 0)
    along = W.partitionBy("image_id", "y").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    first = plane.withColumn("v", F.when(F.col("x") == 0, F.sum(P.long("v")).over(down)).otherwise(P.long("v")))
    return first.withColumn("v", P.low8(F.sum("v").over(along)))


def unfilter_vertical(plane: DataFrame) -> DataFrame:
    """The same with rows and columns exchanged."""
    turned = unfilter_horizontal(plane.select("image_id", F.col("x").alias("y"), F.col("y").alias("x"), "v"))
    return turned.select("image_id", F.col("x").alias("y"), F.col("y").alias("x"), "v")


def gradient_residuals(plane: DataFrame) -> DataFrame:
    """The forward gradient filter: each sample less left + above - corner, clipped; at the edges less the neighbour there is."""
    row, up = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    n = plane.withColumns({"l": F.lag("v").over(row), "t": F.lag("v").over(up)}).withColumn("tl", F.lag("t").over(row))
    guess = F.when(F.col("tl").isNotNull(), P.clip(P.long("l") + P.long("t") - P.long("tl"))).otherwise(F.coalesce("l", "t", F.lit(0)))
    return n.select("image_id", "y", "x", F.pmod(P.long("v") - guess, F.lit(256)).alias("v"))


def undo_gradient(residual: np.ndarray) -> np.ndarray:
    """Planes (image, y, x) of one size, side by side. Edges are running sums; every other step clips, so the inside goes diagonal by diagonal."""
    out = residual.astype(np.int64).copy()
    _, height, width = out.shape
    out[:, :1] = np.cumsum(out[:, :1], axis=2) & 255
    out[:, :, :1] = np.cumsum(out[:, :, :1], axis=1) & 255
    for d in range(2, height + width - 1):
        y = np.arange(max(1, d - width + 1), min(height, d))
        x = d - y
        guess = np.clip(out[:, y, x - 1] + out[:, y - 1, x] - out[:, y - 1, x - 1], 0, 255)
        out[:, y, x] = (out[:, y, x] + guess) & 255
    return out


def _gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.stack([batch.column(c).to_numpy() for c in ("height", "width")], axis=1)
        for h, w in np.unique(size, axis=0).tolist():
            rows = pa.array(np.flatnonzero((size == (h, w)).all(axis=1)))
            done = undo_gradient(batch.column("v").take(rows).flatten().to_numpy().reshape(len(rows), h, w))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (h * w)), pa.array(done.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("image_id").take(rows), pa.array(np.full(len(rows), w)), pa.array(np.full(len(rows), h)), lists], ["image_id", "width", "height", "v"])


def unfilter_gradient(planes: DataFrame) -> DataFrame:
    """Rows (image_id, width, height, v array<bigint>): one image is one unit of work."""
    return planes.select("image_id", "width", "height", "v").mapInArrow(_gradient, "image_id bigint, width bigint, height bigint, v array<bigint>")


def as_planes(pixels: DataFrame, width: int, height: int, value: str) -> DataFrame:
    """One row per image with its values in row order. The size of an image is bounded by the format."""
    cells = F.array_sort(F.collect_list(F.struct(F.col("y").cast("bigint"), F.col("x").cast("bigint"), F.col(value).cast("bigint").alias("v"))))
    return pixels.groupBy("image_id").agg(F.transform(cells, lambda c: c["v"]).alias(value)).withColumns({"width": F.lit(width).cast("bigint"), "height": F.lit(height).cast("bigint")})


def as_pixels(planes: DataFrame, value: str) -> DataFrame:
    """The reverse of as_planes."""
    out = planes.select("image_id", "width", F.posexplode(value).alias("i", value))
    return out.select("image_id", F.expr("i div width").alias("y"), F.expr("i % width").alias("x"), value)


def merge_alpha(pixels: DataFrame, alpha: DataFrame) -> DataFrame:
    """Pixels with the samples (image_id, y, x, v) of an alpha plane as a."""
    return pixels.drop("a").join(alpha.select("image_id", "y", "x", P.long("v").alias("a")), ["image_id", "y", "x"])


def opaque(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("a", F.lit(255).cast("bigint"))


def inside(frames: DataFrame) -> DataFrame:
    """Frames (x, y, w, h) that lie in their canvas."""
    return frames.where("x >= 0 and y >= 0 and w > 0 and h > 0 and x + w <= canvas_w and y + h <= canvas_h")


def compose(frames: DataFrame, pixels: DataFrame) -> DataFrame:
    """Every canvas pixel of frames (image_id, x, y, w, h, canvas_w, canvas_h): the frame's pixel there, or transparent black."""
    cells = inside(frames).withColumn("cy", F.explode(F.expr("sequence(0L, cast(canvas_h as bigint) - 1)"))).withColumn("cx", F.explode(F.expr("sequence(0L, cast(canvas_w as bigint) - 1)")))
    cells = cells.select("image_id", F.col("cy"), F.col("cx"), (F.col("cy") - F.col("y")).alias("y"), (F.col("cx") - F.col("x")).alias("x"))
    return cells.join(pixels.select("image_id", "y", "x", "argb"), ["image_id", "y", "x"], "left").select("image_id", F.col("cy").alias("y"), F.col("cx").alias("x"), F.coalesce("argb", F.lit(0).cast("bigint")).alias("argb"))


def bgra_hex(argb: str = "argb") -> F.Column:
    """The four output bytes of a pixel, in hexadecimal."""
    return F.concat(*(F.lpad(F.hex(P.channel(argb, c)), 2, "0") for c in "bgra"))
