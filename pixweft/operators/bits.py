"""Bits, lowest first, of byte streams as rows and expressions, and prefix codes as left-aligned bounds.

A stream is a row (image_id, data). It is cut into pieces of PIECE bytes, each with the MORE bytes behind it, so that every offset of a piece sees 64 bits. Bits behind the end count as 0;
a reader that asks for more than are left gets 0 and is at the end of the stream (`eos`). Null data gives no rows, empty data none either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE, MORE, ROOT, LONGEST = 512, 10, 8, 15


def numbers(data: str) -> str:
    """SQL: the bytes of a binary expression as an array of int."""
    return f"transform(split(decode({data}, 'ISO-8859-1'), ''), c -> ascii(c))"


def pieces(streams: DataFrame, piece: int = PIECE) -> DataFrame:
    """Rows of streams with, for data, `piece`, its bytes (`slice`, filled up with zeros), and how many bits are `left` from its first on."""
    own = streams.where("length(data) > 0").withColumn("piece", F.explode(F.expr(f"sequence(0, (length(data) - 1) div {piece})")))
    own = own.withColumn("slice", F.expr(f"rpad(substring(data, piece * {piece} + 1, {piece + MORE}), {piece + MORE}, X'00')"))
    return own.withColumn("left", F.expr(f"8L * (length(data) - piece * {piece})")).drop("data")


def windows(streams: DataFrame, piece: int = PIECE) -> DataFrame:
    """(image_id, at, w, left): for every bit offset of a stream the next 64 bits as a long and how many bits there are."""
    near = pieces(streams.select("image_id", "data"), piece).select("image_id", "piece", "left", F.expr(numbers("slice")).alias("_b"))
    eight = " | ".join(f"shiftleft(cast(_b[i + {k}] as bigint), {8 * k})" for k in range(8))
    words = near.select("image_id", "piece", "left", F.posexplode(F.expr(f"transform(sequence(0, least({piece}L, left div 8) - 1), i -> struct({eight} as low, cast(_b[i + 8] as bigint) as high))")).alias("_i", "_x"))
    bits = words.select("image_id", "left", F.expr(f"8L * (piece * {piece} + _i)").alias("_at"), "_i", "_x.low", "_x.high", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_k"))
    return bits.select("image_id", (F.col("_at") + F.col("_k")).alias("at"), F.expr("if(_k = 0, low, shiftrightunsigned(low, _k) | shiftleft(high, 64 - _k))").alias("w"), F.expr("left - 8L * _i - _k").alias("left"))


def read(n: Column | int, w: str = "w", left: str = "left") -> Column:
    """The next n bits (0 to 31) of a window; 0 if there are fewer."""
    n = F.lit(n) if isinstance(n, int) else n
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int")) - 1
    return F.when(n <= F.col(left), F.col(w).bitwiseAND(mask)).otherwise(F.lit(0).cast("bigint"))


def eos(n: Column | int, left: str = "left") -> Column:
    """Whether reading n bits passes the end."""
    return (F.lit(n) if isinstance(n, int) else n) > F.col(left)


def let(bindings: dict[str, str], body: str) -> str:
    """SQL: body with names for values, each of which may use those before it and is computed once. (The greatest element of one: taking the first would be simplified to the body with the values in place of the names.)"""
    for name, value in reversed(bindings.items()):
        body = f"array_max(transform(array({value}), {name} -> {body}))"
    return body


def turned(v: str, n: int) -> str:
    """SQL: the lowest n bits (up to 15) in reverse order."""
    bit = lambda k: f"shiftleft(shiftright(u, {k}) & 1, {n - 1 - k})"
    return let({"u": v}, " | ".join(bit(k) for k in range(n)))


def bounds(entries: str, top: int) -> str:
    """SQL: what lookup() needs of a code's entries, an array of structs (len, symbol) in their order, of lengths up to `top`.

    For each length k: how much of the code space (2 ** top units) lies before its codes (`base`), and before those of greater length (`lim`), and the place of its first symbol (`first`).
    """
    counts = f"transform(sequence(0, {top}), k -> size(filter({entries}, e -> e.len = k)))"
    before = lambda unit: f"transform(sequence(0, {top}), k -> aggregate(sequence(1, {top}), 0, (a, j) -> a + if(j < k, c[j] * {unit}, 0)))"
    base = before(f"shiftleft(1, {top} - j)")
    inner = f"struct(c as counts, {base} as base, {before('1')} as first)"
    return (
        let({"c": counts}, inner),
        f"named_struct('base', _t.base, 'first', _t.first, 'lim', transform(sequence(0, {top}), k -> if(k = 0, 0, _t.base[k] + _t.counts[k] * shiftleft(1, {top} - k))), 'symbols', transform({entries}, e -> e.symbol))",
    )


def with_bounds(codes: DataFrame, entries: str, name: str, top: int = LONGEST) -> DataFrame:
    """Column `name` with the bounds() of the array column `entries`; null for a null or empty one, and for an over-full code of several symbols, which readers reject."""
    first, second = bounds(entries, top)
    out = codes.withColumn("_t", F.expr(first)).withColumn(name, F.expr(second)).drop("_t")
    good = f"size({entries}) > 0 and (size({entries}) = 1 or {name}.lim[{top}] <= {1 << top})"
    return out.withColumn(name, F.expr(f"if({good}, {name}, null)"))


def lookup(code: str, v: str, top: int = LONGEST) -> str:
    """SQL: struct (symbol, len) that a reader finds whose next `top` bits, first bit highest, are v.

    The length is the first whose lim lies above v. A code of one symbol reads no bits. What no code covers reads symbol 0 and no bits, or ROOT bits where longer codes share its first ROOT bits.
    """
    length = f"(1 + size(filter(slice({code}.lim, 2, {top}), x -> x <= {v})))"
    none = f"if(shiftleft(shiftright({v}, {top - ROOT}), {top - ROOT}) < {code}.lim[{top}], {ROOT}, 0)" if top > ROOT else "0"
    found = let({"k": length}, f"struct({code}.symbols[{code}.first[k] + shiftright({v} - {code}.base[k], {top} - k)] as symbol, k as len)")
    return f"case when size({code}.symbols) = 1 then struct({code}.symbols[0] as symbol, 0 as len) when {v} >= {code}.lim[{top}] then struct(0 as symbol, {none} as len) else {found} end"


def code_table(lengths: DataFrame) -> DataFrame:
    """(tree, code) of the rows (tree, symbol, len) of trees; lengths of 0 or null are not in the code."""
    entries = F.array_sort(F.collect_list(F.when((F.col("len") > 0), F.struct(F.col("len").cast("int").alias("len"), F.col("symbol").cast("int").alias("symbol")))))
    return with_bounds(lengths.groupBy("tree").agg(entries.alias("_entries")), "_entries", "code").drop("_entries")
