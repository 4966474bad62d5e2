"""Prefix codes as relations (tree, symbol, len)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import LENGTH_ORDER

MAX_LENGTH = 15


def histogram(lengths: DataFrame) -> DataFrame:
    """How many symbols of a tree have each length (length 0: not in the code)."""
    return lengths.where("len > 0").groupBy("tree", "len").agg(F.count("*").alias("n_symbols"))


def ranks(lengths: DataFrame) -> DataFrame:
    """The place of each coded symbol in order of length, then symbol."""
    return lengths.where("len > 0").withColumn("place", F.row_number().over(W.partitionBy("tree").orderBy("len", "symbol")).cast("bigint") - 1)


def canonical(lengths: DataFrame) -> DataFrame:
    """Column code: the canonical code, and reversed: its bits as a reader meets them, lowest first."""
    share = F.expr(f"shiftleft(1L, cast({MAX_LENGTH} - len as int))")
    earlier = W.partitionBy("tree").orderBy("len", "symbol").rowsBetween(W.unboundedPreceding, -1)
    coded = lengths.where("len > 0").withColumn("left", F.coalesce(F.sum(share).over(earlier), F.lit(0)))
    coded = coded.withColumn("code", F.expr(f"shiftright(left, cast({MAX_LENGTH} - len as int))")).drop("left")
    return coded.withColumn("reversed", F.expr("cast(conv(reverse(lpad(bin(code), cast(len as int), '0')), 2, 10) as bigint)"))


def validity(lengths: DataFrame) -> DataFrame:
    """Per tree: coded symbols, share of the code space in units of 2**-15, and whether a reader takes it.

    It takes trees with lengths of 0 to 15, a coded symbol and no over-full code; under-full codes pass. A single coded symbol reads no bits.
    """
    legal = F.col("len").between(0, MAX_LENGTH)
    share = F.when(legal & (F.col("len") > 0), F.expr(f"shiftleft(1L, cast({MAX_LENGTH} - len as int))")).otherwise(0)
    out = lengths.groupBy("tree").agg(F.sum((F.col("len") > 0).cast("bigint")).alias("coded"), F.sum(share).alias("space"), F.bool_and(legal).alias("legal"))
    return out.select("tree", "coded", "space", (F.col("legal") & (F.col("coded") > 0) & (F.col("space") <= 32768)).alias("valid"), (F.col("coded") == 1).alias("reads_no_bits"))


def read_runs(runs: DataFrame, alphabet: int, max_symbol: int | None = None) -> DataFrame:
    """The runs (tree, pos, value, repeat) that a reader of an alphabet takes: the first max_symbol ones at most, until the alphabet is full. A tree has none if a run in that range passes the alphabet's end or is null: it fails."""
    order = W.partitionBy("tree").orderBy("pos")
    near = runs.withColumns({"_place": F.row_number().over(order), "_before": F.coalesce(F.sum("repeat").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    near = near.where((F.col("_place") <= (alphabet if max_symbol is None else max_symbol)) & (F.col("_before") < alphabet))
    fails = F.bool_or(F.coalesce((F.col("_before") + F.col("repeat") > alphabet) | F.col("value").isNull(), F.lit(True))).over(W.partitionBy("tree"))
    return near.withColumn("_fails", fails).where(~F.col("_fails")).drop("_place", "_before", "_fails")


def expand_runs(runs: DataFrame) -> DataFrame:
    """Rows (tree, pos, value, repeat) as one row per code length: (tree, place, len). Runs of 0, less or null times give no rows. read_runs() ends them at an alphabet."""
    one = runs.where("repeat > 0").select("tree", "pos", "value", F.explode(F.expr("sequence(1L, cast(repeat as bigint))")).alias("_k"))
    return one.select("tree", (F.row_number().over(W.partitionBy("tree").orderBy("pos", "_k")).cast("bigint") - 1).alias("place"), F.col("value").alias("len"))


def run_symbols(symbols: DataFrame) -> DataFrame:
    """Symbols 0 to 18 of a code-length code with their extra bits, (tree, pos, symbol, extra), as runs (tree, pos, value, repeat).

    Up to 15: that length, once. 16: the last length that isn't 0 (8 before there is one), 3 + extra times. 17 and 18: zeros, 3 + extra and 11 + extra times.
    A null symbol and any other has a null value and repeat.
    """
    s = F.col("symbol")
    before = W.partitionBy("tree").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    last = F.coalesce(F.last(F.when(s.between(1, 15), s), ignorenulls=True).over(before), F.lit(8))
    value = F.when(s.between(0, 15), s).when(s == 16, last).when(s.between(17, 18), 0)
    repeat = F.when(s.between(0, 15), 1).when(s.between(16, 17), 3 + F.col("extra")).when(s == 18, 11 + F.col("extra"))
    return symbols.select("tree", "pos", value.cast("bigint").alias("value"), repeat.cast("bigint").alias("repeat"))


def length_symbols(stored: DataFrame) -> DataFrame:
    """Column symbol: which symbol of the code-length code the length at place pos (0 to 18) is for; null beyond."""
    order = F.array(*(F.lit(v).cast("bigint") for v in LENGTH_ORDER))
    return stored.withColumn("symbol", F.when(F.col("pos").between(0, 18), F.element_at(order, (F.greatest(F.col("pos"), F.lit(0)) % 19 + 1).cast("int"))))
