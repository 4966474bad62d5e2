"""Queries over bits, prefix codes and whole lossless streams, and the same in SQL: what the streams were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query
from .operators import bits, streams, transforms
from .plans import streams as plans
from .plans.planes import COLOURS, LENGTHS, PX, lengths, px

PARTS = 32


def planes(spark: SparkSession, sf: str) -> DataFrame:
    """(image_id, s): the 64 samples of each image in order; in PARTS partitions, as a row is much work."""
    own = px(spark, sf).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("c"))
    return own.select("image_id", F.col("c.v").alias("s")).repartition(PARTS, "image_id")


@query(f"with {PX}, s as (select image_id, list(v order by y, x) || [0, 0, 0, 0, 0, 0, 0, 0] as b from px group by image_id) select image_id, k::bigint as at, ((b[k // 8 + 1] + b[k // 8 + 2] * 256 + b[k // 8 + 3] * 65536 + b[k // 8 + 4] * 16777216 + b[k // 8 + 5] * 4294967296) >> (k % 8)::int) & 4294967295 as next, 512 - k as n_left, case when 20 <= 512 - k then ((b[k // 8 + 1] + b[k // 8 + 2] * 256 + b[k // 8 + 3] * 65536) >> (k % 8)::int) & 1048575 & 1048575 else 0 end as low, 20 > 512 - k as eos from s, range(0, 512) as t(k)".replace("b[k // 8 + 3] * 65536) >> (k % 8)::int) & 1048575 & 1048575", "b[k // 8 + 3] * 65536 + b[k // 8 + 4] * 16777216) >> (k % 8)::int) & 1048575"))
def bit_windows(spark, sf):
    data = F.expr("unhex(array_join(transform(s, v -> lpad(hex(v), 2, '0')), ''))")
    seen = bits.windows(planes(spark, sf).select("image_id", data.alias("data")), 16)
    return seen.select("image_id", "at", F.col("w").bitwiseAND(F.lit(2**32 - 1)).alias("next"), F.col("left").alias("n_left"), bits.read(20).alias("low"), bits.eos(20).alias("eos"))


_LEN = LENGTHS.format("2 + p_size % 14")


@query(
    f"with {_LEN}, c as (select tree, symbol, len, (coalesce(sum(1 << (15 - len)::int) over (partition by tree order by len, symbol rows between unbounded preceding and 1 preceding), 0))::bigint as low, 1 << (15 - len)::int as size from lens), g as (select tree, max(low + size) as top from c group by tree having max(low + size) <= 32768), w as (select tree, top, (k * 127 % 32768)::bigint as v from g, range(0, 259) as t(k)) "
    "select w.tree, v, coalesce(symbol, 0) as symbol, coalesce(len, case when (v // 128) * 128 < top then 8 else 0 end) as len from w left join c on c.tree = w.tree and v >= low and v < low + size"
)
def code_lookup(spark, sf):
    codes = bits.code_table(lengths(spark, sf, "2 + p_size % 14")).where("code is not null")
    asked = codes.withColumn("v", F.explode(F.expr("transform(sequence(0, 258), k -> k * 127 % 32768)")))
    return asked.select("tree", F.col("v").cast("bigint").alias("v"), F.expr(bits.lookup("code", "v")).alias("x")).select("tree", "v", F.col("x.symbol").cast("bigint").alias("symbol"), F.col("x.len").cast("bigint").alias("len"))


def _coded(spark, sf) -> DataFrame:
    own = plans.coded(planes(spark, sf)).select("image_id", F.expr(plans.packed("bits")).alias("data"), F.lit(0).cast("bigint").alias("at"), "width", "height")
    return own.repartition(PARTS, F.col("image_id") + 1)  # else what reads the bytes would make them again


_TREES = {0: (plans.PLAIN, plans.EIGHT, plans.EIGHT, plans.EIGHT, [1]), 1: (plans.PLAIN, [0, 0, 0, 1], plans.EIGHT, [0] * 255 + [1], [1]), 2: (plans.COPIES, plans.EIGHT, plans.EIGHT, plans.EIGHT, [1, 1]), 3: (plans.CACHED, plans.EIGHT, plans.EIGHT, plans.EIGHT, [1])}
_WANTED = ", ".join(f"({k}, '{name}', {n}, {tree.count(n)}, {tree.index(n)}, {len(tree) - 1 - tree[::-1].index(n)})" for k, trees in _TREES.items() for name, tree in zip(streams.CHANNELS, trees, strict=True) for n in sorted(set(tree) - {0}))


@query(f"with {PX}, i as (select distinct image_id from px) select image_id, channel, len::bigint as len, n::bigint as n_symbols, low::bigint as first, high::bigint as last from i join (values {_WANTED}) as w(kind, channel, len, n, low, high) on image_id % 4 = kind")
def prefix_code_headers(spark, sf):
    each = streams.entries(streams.read_header(_coded(spark, sf), True))
    return each.groupBy("image_id", "channel", F.col("len").cast("bigint").alias("len")).agg(F.count("*").alias("n_symbols"), F.min("symbol").cast("bigint").alias("first"), F.max("symbol").cast("bigint").alias("last"))


_PIXELS = f"{PX}, c as (select image_id, y, x, y * 8 + x as pos, image_id % 4 as kind, case when image_id % 4 = 1 then 4278190080 + 3 * 65536 else (255 - v) * 16777216 + v * 3 % 256 * 65536 end + v * 256 + (v * 5 + 1) % 256 as argb from px), k as (select *, ((argb * 506832829) & 4294967295) >> 29 as slot from c)"


@query(
    f"with {_PIXELS} select image_id, pos, 0::bigint as kind, argb as value, null::bigint as distance, 1::bigint as count from k where kind < 2 or y = 0 "
    "union all select image_id, pos, 1, 4, 8, 4 from k where x % 4 = 0 and (kind = 2 and y > 0 or kind = 3 and y > 1) union all select image_id, pos + 8, 2, slot, null, 1 from k where kind = 3 and y = 0"
)
def stream_units(spark, sf):
    headers = streams.read_header(_coded(spark, sf), True)
    found = streams.placed(streams.units(headers, 128), headers)
    return found.select("image_id", "pos", F.col("kind").cast("bigint").alias("kind"), "value", "distance", "count")


@query(
    f"with {_PIXELS}, h as (select image_id, slot, max_by(argb, x) as held from k where y = 0 group by all), f as (select k.image_id, x, argb, held from k join h using (image_id, slot) where y = 0) "
    "select k.image_id, y, k.x, case when kind < 2 or y = 0 then k.argb when kind = 2 then f.argb else f.held end as argb from k join f on f.image_id = k.image_id and f.x = k.x"
)
def decode_stream(spark, sf):
    _, out = streams.decode_coded(_coded(spark, sf), True)
    return out.select("image_id", F.expr("pos div 8").alias("y"), F.expr("pos % 8").alias("x"), "argb")


@query(f"with {COLOURS} select image_id, y, x, case when image_id % 5 = 3 then (v & 15) * 2654435761 % 4294967296 else argb end as argb from c")
def decode_lossless(spark, sf):
    _, out = transforms.decode_lossless(plans.pictures(spark, sf).repartition(PARTS, "image_id"))
    return out
