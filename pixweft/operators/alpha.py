"""The alpha plane of an ALPH chunk with raw samples, un-filtered and merged into the pixels.

The header's lowest two bits are the method (0: raw; others give no rows here), the next two the filter. Bytes behind width * height samples are ignored; a payload that is null or too short
gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.container import byte
from . import compose


def raw_samples(planes: DataFrame) -> DataFrame:
    """(image_id, filter, y, x, v) of rows (image_id, width, height, body)."""
    header = byte("body", 0)
    enough = (header % 4 == 0) & (F.length("body") >= 1 + F.try_multiply(F.col("width"), F.col("height"))) & (F.col("width") > 0) & (F.col("height") > 0)
    own = planes.where(enough).select("image_id", "width", F.shiftright(header, 2).bitwiseAND(F.lit(3)).alias("filter"), F.expr("substring(body, 2, cast(width * height as int))").alias("_samples"))
    out = own.select("image_id", "width", "filter", "_samples", F.explode(F.expr("sequence(0, length(_samples) - 1)")).alias("_i"))
    value = F.expr("cast(conv(hex(substring(_samples, _i + 1, 1)), 16, 10) as bigint)")
    return out.select("image_id", "filter", F.expr("_i div width").alias("y"), F.expr("_i % width").cast("bigint").alias("x"), value.alias("v"))


def unfiltered(samples: DataFrame) -> DataFrame:
    """(image_id, y, x, v) with each image's filter undone: 0 none, 1 along rows, 2 along columns, 3 gradient. Kinds 0 to 2 share one pass of windows, columns turned to rows."""
    turn = lambda df, v: df.select("image_id", "filter", F.when(F.col("filter") == 2, F.col("x")).otherwise(F.col("y")).alias("y"), F.when(F.col("filter") == 2, F.col("y")).otherwise(F.col("x")).alias("x"), v.alias("v"), F.col("v").alias("raw"))
    sums = compose.unfilter_horizontal(turn(samples.where("filter < 3"), F.col("v")))
    flat = turn(sums, F.when(F.col("filter") == 0, F.col("raw")).otherwise(F.col("v")))
    planes = samples.where(F.col("filter") == 3).groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("cells"))
    gradient = compose.as_pixels(compose.unfilter_gradient(planes.select("image_id", "width", "height", F.col("cells.v").alias("v"))), "v")
    return reduce(DataFrame.unionByName, [p.select("image_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.col("v").cast("bigint").alias("v")) for p in (flat, gradient)])


def applied(pixels: DataFrame, planes: DataFrame) -> DataFrame:
    """Pixels (image_id, y, x, r, g, b) of images with such a plane, with its samples as a."""
    return compose.merge_alpha(pixels, unfiltered(raw_samples(planes)))
