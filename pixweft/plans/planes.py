"""Integer planes derived from the tables: the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, v): the first 64 values of an embedding as an 8x8 plane of bytes."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("image_id"), F.posexplode(F.slice("embedding", 1, 64)).alias("i", "e"))
    v = P.clip(F.floor(F.col("e").cast("double") * 128) + 128)
    return rows.select("image_id", F.expr("i div 8").alias("y"), F.expr("cast(i % 8 as bigint)").alias("x"), v.alias("v"))


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px with channels a, r, g, b and the packed pixel argb."""
    out = px(spark, sf_dir).withColumns({"a": F.col("v") * 11 % 256, "r": F.col("v"), "g": F.col("v") * 7 % 256, "b": F.col("v") * 13 % 256})
    return out.withColumn("argb", P.argb("a", "r", "g", "b"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, pos, a, r, g, b) from the keys of lineitem."""
    cols = {"image_id": "l_orderkey", "pos": "l_linenumber", "a": "l_linenumber * 31 % 256", "r": "l_partkey % 256", "g": "l_suppkey % 256", "b": "l_orderkey % 256"}
    return table(spark, sf_dir, "lineitem").select(*(F.expr(f"cast({e} as bigint)").alias(n) for n, e in cols.items()))


def lengths(spark: SparkSession, sf_dir: str, length: str) -> DataFrame:
    """(tree, symbol, len): trees of 20 symbols from part."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey div 20 as tree", "cast(p_partkey % 20 as bigint) as symbol", f"cast({length} as bigint) as len")


#: The same planes for DuckDB.
PX = "px as materialized (select vec_id::bigint as image_id, (i // 8)::bigint as y, (i % 8)::bigint as x, least(255, greatest(0, floor(embedding[i + 1]::double * 128)::bigint + 128)) as v from embeddings, range(0, 64) as t(i))"
COLOURS = f"{PX}, c as materialized (select *, v * 11 % 256 as a, v as r, v * 7 % 256 as g, v * 13 % 256 as b, (v * 11 % 256) * 16777216 + v * 65536 + (v * 7 % 256) * 256 + v * 13 % 256 as argb from px)"
LINES = "li as (select l_orderkey::bigint as image_id, l_linenumber::bigint as pos, (l_linenumber::bigint * 31 % 256) as a, (l_partkey::bigint % 256) as r, (l_suppkey::bigint % 256) as g, (l_orderkey::bigint % 256) as b from lineitem)"
LENGTHS = "lens as (select p_partkey::bigint // 20 as tree, p_partkey::bigint % 20 as symbol, ({})::bigint as len from part)"
