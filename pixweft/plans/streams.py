"""VP8L bit streams made from planes: inputs of the stream queries. Bits are text of 0 and 1 in the order in which a reader meets them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import LENGTH_ORDER
from ..operators.bits import let


def number(x: int, n: int) -> str:
    """n bits of a number, lowest first."""
    return f"{x:0{n}b}"[::-1] if n else ""


def simple(*symbols: int) -> str:
    """The header of a code of one or two symbols; one symbol reads no bits."""
    first = number(symbols[0], 1) if symbols[0] < 2 else number(symbols[0], 8)
    return "1" + number(len(symbols) - 1, 1) + ("0" if symbols[0] < 2 else "1") + first + (number(symbols[1], 8) if len(symbols) == 2 else "")


def runs(lengths: list[int]) -> list[tuple[int, int, int]]:
    """Symbols of the code of lengths with their extra bits: (symbol, extra, bits of it)."""
    out, k, last = [], 0, 8
    while k < len(lengths):
        v, n = lengths[k], 1
        while k + n < len(lengths) and lengths[k + n] == v:
            n += 1
        if v == 0 and n >= 11:
            n = min(n, 138)
            out.append((18, n - 11, 7))
        elif v == 0 and n >= 3:
            n = min(n, 10)
            out.append((17, n - 3, 3))
        elif v and v == last and n >= 3:
            n = min(n, 6)
            out.append((16, n - 3, 2))
        else:
            n = 1
            out.append((v, 0, 0))
        last = v or last
        k += n
    return out


def canonical(lengths: list[int]) -> dict[int, str]:
    """The code words of a tree; one symbol alone has an empty one."""
    order = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(order) == 1:
        return {order[0][1]: ""}
    out, code, before = {}, 0, 0
    for n, s in order:
        code <<= n - before
        out[s], before = f"{code:0{n}b}", n
        code += 1
    return out


def normal(lengths: list[int], max_symbol: bool = False) -> str:
    """The header of a code with these lengths; with max_symbol, zeros at the end are left out."""
    kept = lengths[: max(k for k, n in enumerate(lengths) if n) + 1] if max_symbol else lengths
    symbols = runs(kept)
    used = sorted({s for s, _, _ in symbols})
    own = [0] * 19
    bits_ = max(1, (len(used) - 1).bit_length())
    for s in used:
        own[s] = bits_
    words = canonical(own)
    n = max(4, 1 + max(LENGTH_ORDER.index(s) for s in used))
    head = "0" + number(n - 4, 4) + "".join(number(own[LENGTH_ORDER[k]], 3) for k in range(n))
    head += ("1" + number(7, 3) + number(len(symbols) - 2, 16)) if max_symbol else "0"
    return head + "".join(words[s] + number(x, b) for s, x, b in symbols)


def packed(bits: str) -> str:
    """SQL: the bytes of a text of bits, filled up with zeros."""
    return let({"b": bits, "t": "rpad(b, cast(8 * ((length(b) + 7) div 8) as int), '0')"}, "unhex(array_join(transform(sequence(0, length(b) - 1, 8), k -> lpad(conv(reverse(substr(t, k + 1, 8)), 2, 16), 2, '0')), ''))")


def words(codes: dict[int, str], value: str, size: int) -> str:
    """SQL: the code word of a symbol."""
    return f"element_at(array({', '.join(repr(codes.get(s, '')) for s in range(size))}), cast({value} + 1 as int))"


EIGHT = [8] * 256
#: Green codes: literals of 8 bits; literals of 9 and two lengths of 2 bits; literals of 9, two lengths and slots of a cache of 3 bits.
PLAIN = [8] * 256 + [0] * 24
COPIES = [9] * 256 + [0] * 3 + [2] + [0] * 3 + [2] + [0] * 16
CACHED = [9] * 256 + [0] * 3 + [3] + [0] * 20 + [5] * 8
KINDS = 4


def coded(planes: DataFrame, meta: bool = True) -> DataFrame:
    """Coded images (image_id, bits, width, height) of 8x8 planes with a column s, their 64 greens in order: of the pixel with green v, red is 3v, blue 5v + 1 and alpha 255 - v, modulo 256.

    By image_id % KINDS: 0 literals; 1 literals with one red and one alpha (3 and 255); 2 the first row as literals, the others copies of the row before; 3 a cache of 8 slots: the first row as literals, of the second each pixel
    the slot of the pixel above, then copies as in 2.
    """
    flag = "0" if meta else ""
    greens = {k: canonical(v) for k, v in ((0, PLAIN), (2, COPIES), (3, CACHED))}
    eight = canonical(EIGHT)
    part = lambda g, r, a: f"concat({words(g, 'v', 256)}, {words(eight, 'v * 3 % 256', 256) if r else repr('')}, {words(eight, '(v * 5 + 1) % 256', 256)}, {words(eight, '255 - v', 256) if a else repr('')})"
    all_ = lambda source, one: f"array_join(transform({source}, v -> {one}), '')"
    head = {
        0: f"0{flag}" + normal(PLAIN, True) + normal(EIGHT) * 3 + simple(0),
        1: f"0{flag}" + normal(PLAIN) + simple(3) + normal(EIGHT) + simple(255) + simple(0),
        2: f"0{flag}" + normal(COPIES) + normal(EIGHT) * 3 + simple(1, 0),
        3: f"1{number(3, 4)}{flag}" + normal(CACHED) + normal(EIGHT) * 3 + simple(0),
    }
    # Half a row: length 4 is green 259, distance symbol 0 is code 1, the pixel above
    row = {2: (greens[2][259] + "0") * 2, 3: greens[3][259] * 2}
    slot = "shiftright(((255 - v) * 16777216L + v * 3 % 256 * 65536 + v * 256 + (v * 5 + 1) % 256) * 506832829L & 4294967295L, 29)"
    bits = (
        f"case image_id % {KINDS} when 0 then concat('{head[0]}', {all_('s', part(greens[0], True, True))}) when 1 then concat('{head[1]}', {all_('s', part(greens[0], False, False))}) "
        f"when 2 then concat('{head[2]}', {all_('slice(s, 1, 8)', part(greens[2], True, True))}, '{row[2] * 7}') "
        f"else concat('{head[3]}', {all_('slice(s, 1, 8)', part(greens[3], True, True))}, {all_('slice(s, 1, 8)', words({k: greens[3][280 + k] for k in range(8)}, slot, 8))}, '{row[3] * 6}') end"
    )
    return planes.select("image_id", F.expr(bits).alias("bits"), F.lit(8).cast("bigint").alias("width"), F.lit(8).cast("bigint").alias("height"))


LISTS = 5


def _zero_bits(*symbols: str) -> str:
    """SQL: a sub-image of one colour: five codes of one symbol each."""
    return "concat('0', " + ", ".join(f"'101', reverse(lpad(bin({s}), 8, '0'))" for s in symbols) + f", '{simple(0)}')"


def pictures(spark, sf_dir: str) -> DataFrame:
    """Pictures (image_id, data, width, height) of the colours c with lists of transforms. By image_id % LISTS: 0 none; 1 predictor (mode image_id % 14), subtract green; 2 cross colour, predictor, subtract green;
    3 colour indexing: 16 colours i * 2654435761, the index is the sample's lowest four bits; 4 subtract green twice, then cross colour.
    """
    from ..operators import lossless
    from .planes import colours

    c = colours(spark, sf_dir).withColumn("kind", F.expr(f"cast(image_id % {LISTS} as int)"))
    less_green = lambda df, times: df.withColumns({n: F.expr(f"pmod({n} - {times} * g, 256)") for n in "rb"})
    delta = lambda t, v: lossless.color_delta(F.lit(t), F.col(v))
    crossed = lambda df: df.withColumns({"r": F.pmod(F.col("r") - delta(200, "g"), F.lit(256)), "b": F.pmod(F.col("b") - delta(77, "g") - delta(31, "r"), F.lit(256))})

    def residual(df: DataFrame) -> DataFrame:
        own = df.select("image_id", "y", "x", F.expr("a * 16777216 + r * 65536 + g * 256 + b").alias("argb"))
        out = lossless.predictor_residuals(own, F.pmod(F.col("image_id"), F.lit(14)))
        return out.selectExpr("image_id", "y", "x", "shiftright(residual, 24) & 255 as a", "shiftright(residual, 16) & 255 as r", "shiftright(residual, 8) & 255 as g", "residual & 255 as b")

    cells = [c.where("kind = 0"), less_green(residual(c.where("kind = 1")), 1), less_green(residual(crossed(c.where("kind = 2"))), 1), crossed(less_green(c.where("kind = 4"), 2))]
    rest = c.where("kind = 3").groupBy("image_id", "y", F.expr("x div 2").alias("x")).agg(F.sum(F.expr("(v & 15) * shiftleft(1, cast(4 * (x % 2) as int))")).alias("g")).selectExpr("image_id", "y", "x", "255L as a", "9L as r", "g", "7L as b")
    names = ["image_id", "y", "x", "a", "r", "g", "b"]
    flat = rest.select(*names)
    for part in cells:
        flat = flat.unionByName(part.select(*names))
    eight = "concat(" + ", ".join(f"lpad(bin({n}), 8, '0')" for n in "grba") + ")"
    bits = flat.select("image_id", "y", "x", F.expr(eight).alias("t")).groupBy("image_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(y, x, t))), s -> s.t), '')").alias("t"))
    codes = normal(PLAIN, True) + normal(EIGHT) * 3 + simple(0)
    step = lambda kind: "1" + number(kind, 2)
    mode = _zero_bits("image_id % 14", "0", "0", "0")
    crosses = _zero_bits("77", "31", "200", "0")
    colour = lambda i: [(i * 2654435761 % 2**32) >> s & 255 for s in (8, 16, 0, 24)]
    palette = "".join(f"{(x - y) % 256:08b}" for i in range(16) for x, y in zip(colour(i), colour(i - 1) if i else [0] * 4, strict=True))
    lists = {
        0: "''",
        1: f"concat('{step(0)}{number(1, 3)}', {mode}, '{step(2)}')",
        2: f"concat('{step(1)}{number(0, 3)}', {crosses}, '{step(0)}{number(1, 3)}', {mode}, '{step(2)}')",
        3: f"'{step(3)}{number(15, 8)}0{codes}{palette}'",
        4: f"concat('{step(2)}{step(2)}{step(1)}{number(2, 3)}', {crosses})",
    }
    text = F.expr(f"concat(case image_id % {LISTS} {' '.join(f'when {k} then {v}' for k, v in lists.items())} end, '000{codes}', t)")
    return bits.select("image_id", text.alias("bits")).select("image_id", F.expr(packed("bits")).alias("data"), F.lit(8).cast("bigint").alias("width"), F.lit(8).cast("bigint").alias("height"))

