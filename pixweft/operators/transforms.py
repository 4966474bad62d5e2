"""Whole lossless pictures: each image's own list of transforms as rows, read in rounds and undone in rounds.

A picture is a row (image_id, data, width, height): the bits behind the header. In each of four rounds every image that has one more transform reads it; the sub-images of all of them are decoded together.
What is read is one row a step: (image_id, step, kind, bits, size, width), and the sub-images' pixels. Undoing goes from step 3 to step 0; in each round the images are routed by the kind of their step, so that images with
different lists go side by side. Kinds may come again. A fifth transform fails in stage `transforms`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as P
from ..session import written
from . import bits, lossless, streams

PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, INDEXING = range(4)
MOST = 4
STEPS = "image_id bigint, step int, kind int, bits int, size int, width bigint, height bigint, restored bigint"


def _bit(at: str, n: str) -> str:
    """SQL: n (0 to 16) bits of `region` from the bit `at` on; 0 if fewer than n are there."""
    byte = lambda k: f"shiftleft(get(region, shiftright({at}, 3) + {k}), {8 * k})"
    return f"if(({at}) + ({n}) > room, 0, shiftright({byte(0)} + {byte(1)} + {byte(2)}, ({at}) & 7) & (shiftleft(1, {n}) - 1))"


def _read_step(todo: DataFrame) -> DataFrame:
    """todo (image_id, data, at, width, height) with more (whether a transform is there), kind, bits and size (of a palette), at behind them."""
    near = todo.withColumn("region", F.expr(bits.numbers("rpad(substring(data, cast(at div 8 as int) + 1, 4), 8, X'00')")))
    near = near.withColumns({"room": F.expr("cast(greatest(0L, least(8L * (length(data) - at div 8), 64L)) as int)"), "p": F.expr("cast(at & 7 as int)")})
    near = near.withColumns({"more": F.expr(f"{_bit('p', '1')} = 1"), "kind": F.expr(_bit("p + 1", "2")), "_three": F.expr(_bit("p + 3", "3")), "_eight": F.expr(_bit("p + 3", "8"))})
    size = F.when(F.col("kind") == INDEXING, F.col("_eight") + 1)
    own = F.when(F.col("kind") < SUBTRACT_GREEN, F.col("_three") + 2).when(size <= 2, 3).when(size <= 4, 2).when(size <= 16, 1).otherwise(0)
    taken = F.when(~F.col("more"), 1).when(F.col("kind") < SUBTRACT_GREEN, 6).when(F.col("kind") == INDEXING, 11).otherwise(3)
    return near.withColumns({"bits": own.cast("int"), "size": size.cast("int"), "at": F.col("at") + taken}).select("image_id", "data", "at", "width", "height", "more", "kind", "bits", "size")


def _ceil_shift(c: str) -> F.Column:
    return F.expr(f"cast(shiftright({c} + shiftleft(1, bits) - 1, bits) as bigint)")


def read_transforms(pictures: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(coded main images (image_id, data, at, width, height), failed (image_id, stage), STEPS, pixels of sub-images (image_id, step, y, x, argb)). width of a step: the picture's while the step is undone; restored: afterwards."""
    spark = pictures.sparkSession
    todo = pictures.withColumn("at", F.lit(0).cast("bigint"))
    full = pictures.select("image_id", F.col("width").alias("restored"))
    main, failed, steps, subs = [], [], [], []
    for k in range(MOST + 1):
        read = written(_read_step(todo))
        main.append(read.where("not more").select("image_id", "data", "at", "width", "height"))
        more = read.where("more")
        if k == MOST:
            failed.append(more.select("image_id", F.lit("transforms").alias("stage")))
            break
        if not more.limit(1).count():
            break
        sub = more.where(F.col("kind") != SUBTRACT_GREEN)
        block = F.col("kind") < SUBTRACT_GREEN
        sized = sub.withColumns({"_w": F.when(block, _ceil_shift("width")).otherwise(F.col("size")), "_h": F.when(block, _ceil_shift("height")).otherwise(1).cast("bigint")})
        results, cells = streams.decode_coded(sized.select("image_id", "data", "at", F.col("_w").cast("bigint").alias("width"), F.col("_h").alias("height")))
        failed.append(results.where("stage is not null").select("image_id", "stage"))
        cells = cells.join(sized.select("image_id", "kind", F.col("_w").alias("_w")), "image_id")
        subs.append(cells.select("image_id", F.lit(k).alias("step"), "kind", F.expr("pos div _w").alias("y"), F.expr("cast(pos % _w as bigint)").alias("x"), "argb"))
        left = more.join(results.where("stage is null").select("image_id", "end"), "image_id", "left").where(F.col("end").isNotNull() | (F.col("kind") == SUBTRACT_GREEN))
        packed = F.when(F.col("kind") == INDEXING, _ceil_shift("width")).otherwise(F.col("width"))
        left = written(left.withColumns({"at": F.coalesce("end", "at"), "_packed": packed}))
        restored = F.when(F.col("kind") == INDEXING, F.col("restored")).otherwise(F.col("width"))
        steps.append(left.join(full, "image_id").select("image_id", F.lit(k).alias("step"), "kind", "bits", "size", F.col("_packed").alias("width"), "height", restored.alias("restored")))
        todo = left.select("image_id", "data", "at", F.col("_packed").alias("width"), "height")
    both = lambda frames, schema: reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)
    blocks = both(subs, "image_id bigint, step int, kind int, y bigint, x bigint, argb bigint")
    return both(main, ""), both(failed, "image_id bigint, stage string"), written(both(steps, STEPS)), written(blocks)


def _channels(df: DataFrame) -> DataFrame:
    return df.withColumns({c: P.channel("argb", c) for c in "argb"})


def _packed(df: DataFrame) -> DataFrame:
    return df.select("image_id", "y", "x", P.argb("a", "r", "g", "b").alias("argb"))


def _undo_predictor(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """Whole planes, an image a row; its modes are the greens of its blocks."""
    listed = lambda df, v: df.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", v.alias("v")))), lambda c: c["v"]).alias("list"))
    own = listed(cells, F.col("argb")).withColumnRenamed("list", "argb").join(cells.groupBy("image_id").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.first("bits").alias("bits")), "image_id")
    planes = own.join(listed(blocks, P.channel("argb", "g")).withColumnRenamed("list", "modes"), "image_id")
    done = lossless.inverse_predictor(planes, None)
    return done.select("image_id", "width", F.posexplode("argb").alias("_i", "argb")).select("image_id", F.expr("_i div width").alias("y"), F.expr("_i % width").alias("x"), "argb")


def _undo_cross_color(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    own = _channels(cells).withColumns({"_by": F.expr("shiftright(y, bits)"), "_bx": F.expr("shiftright(x, bits)")})
    t = blocks.select("image_id", F.col("y").alias("_by"), F.col("x").alias("_bx"), P.channel("argb", "b").alias("_gr"), P.channel("argb", "g").alias("_gb"), P.channel("argb", "r").alias("_rb"))
    own = own.join(t, ["image_id", "_by", "_bx"])
    own = own.withColumn("r", P.low8(F.col("r") + lossless.color_delta(F.col("_gr"), F.col("g"))))
    blue = P.low8(F.col("b") + lossless.color_delta(F.col("_gb"), F.col("g")))
    return _packed(own.withColumn("b", P.low8(blue + lossless.color_delta(F.col("_rb"), F.col("r")))))


def _undo_indexing(cells: DataFrame, palettes: DataFrame) -> DataFrame:
    """Greens hold 2 ** bits indexes each; those beyond the palette give 0."""
    own = cells.withColumn("_k", F.explode(F.expr("sequence(0, shiftleft(1, bits) - 1)")))
    own = own.withColumn("_x", F.expr("shiftleft(x, bits) + _k")).where("_x < restored")
    own = own.withColumn("_index", F.expr("shiftright(shiftright(argb, 8) & 255, _k * shiftright(8, bits)) & (shiftleft(1, shiftright(8, bits)) - 1)"))
    colours = lossless.palette_delta(_channels(palettes), ["image_id"], "x", list("argb"))
    colours = colours.select("image_id", F.col("x").alias("_index"), P.argb("a", "r", "g", "b").alias("_argb"))
    return own.join(colours, ["image_id", "_index"], "left").select("image_id", "y", F.col("_x").alias("x"), F.coalesce("_argb", F.lit(0).cast("bigint")).alias("argb"))


def undo(cells: DataFrame, steps: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pixels (image_id, y, x, argb) after the inverse of each image's own steps, the last first; blocks: the sub-images' pixels (image_id, step, kind, y, x, argb). Images without steps stay as they are."""
    there = {r.step: {s.kind for s in steps.where(F.col("step") == r.step).select("kind").distinct().collect()} for r in steps.select("step").distinct().collect()}  # at most MOST * 4
    work = {PREDICTOR: _undo_predictor, CROSS_COLOR: _undo_cross_color, INDEXING: _undo_indexing}
    for k in sorted(there, reverse=True):
        own = steps.where(F.col("step") == k)
        routed = cells.join(own.drop("step"), "image_id", "left")
        parts = [routed.where("kind is null")]
        for kind in sorted(there[k]):
            mine, sub = routed.where(F.col("kind") == kind), blocks.where((F.col("step") == k) & (F.col("kind") == kind))
            parts.append(_packed(lossless.subtract_green(_channels(mine))) if kind == SUBTRACT_GREEN else work[kind](mine, sub))
        cells = written(reduce(DataFrame.unionByName, [p.select("image_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), "argb") for p in parts]))
    return cells


def decode_lossless(pictures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows (image_id, stage), pixels (image_id, y, x, argb)) of pictures (image_id, data, width, height); stage is null for decoded ones. Null data and sizes below 1 fail in stage `header`."""
    sound = F.coalesce(F.col("data").isNotNull() & (F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    own = written(pictures.select("image_id", "data", F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height")))  # each round reads it
    main, failed, steps, blocks = read_transforms(own.where(sound))
    results, flat = streams.decode_coded(main, meta=True)
    sized = main.select("image_id", "width")
    cells = flat.join(sized, "image_id").select("image_id", F.expr("pos div width").alias("y"), F.expr("cast(pos % width as bigint)").alias("x"), "argb")
    ended = results.select("image_id", "stage").unionByName(failed).unionByName(own.where(~sound).select("image_id", F.lit("header").alias("stage")))
    return ended, undo(cells, steps, blocks)
