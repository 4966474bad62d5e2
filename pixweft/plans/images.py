"""Container bytes made from the embeddings, sound ones and damaged ones: the inputs of the container queries.

The bytes are written in hexadecimal by one SQL text that Spark and DuckDB both run.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .planes import table

KINDS = 30


class Hex(NamedTuple):
    """An SQL expression of bytes in hexadecimal, and how many they are."""

    sql: str
    n: int

    def __add__(self, other: Hex) -> Hex:
        return Hex(f"{self.sql} || {other.sql}", self.n + other.n)


def raw(digits: str) -> Hex:
    return Hex(f"'{digits}'", len(digits) // 2)


def le(x: str | int, n: int) -> Hex:
    """n bytes of a number, lowest first."""
    if isinstance(x, int):
        return raw(x.to_bytes(n, "little").hex().upper())
    return Hex(" || ".join(f"lpad(hex((({x}) >> {8 * k}) % 256), 2, '0')" for k in range(n)), n)


def text(s: str) -> Hex:
    return raw(s.encode().hex().upper())


def chunk(tag: str, body: Hex) -> Hex:
    return text(tag) + le(body.n, 4) + body + raw("00" * (body.n % 2))


def vp8l(w: str | int, h: str | int) -> Hex:
    size = w - 1 + (h - 1) * 16384 if isinstance(w, int) and isinstance(h, int) else f"{w} - 1 + ({h} - 1) * 16384"
    return raw("2F") + le(size, 4) + raw("8800")


def vp8(w: str | int, h: str | int, start: str = "100000") -> Hex:
    return raw(start + "9D012A") + le(w, 2) + le(h, 2) + raw("00010203")


def vp8x(w: str | int, h: str | int) -> Hex:
    less = lambda x: x - 1 if isinstance(x, int) else f"{x} - 1"
    return chunk("VP8X", raw("10000000") + le(less(w), 3) + le(less(h), 3))


def anmf(x: str | int, y: str | int, sub: Hex) -> Hex:
    return chunk("ANMF", le(x, 3) + le(y, 3) + raw("07000007000064000000") + sub)


PLANE = Hex("plane", 64)
_W, _H, _FILTER = "(1 + image_id % 300)", "(1 + image_id % 200)", f"((image_id // {KINDS}) % 4)"
_ALPH = le(f"{_FILTER} * 4", 1) + PLANE
_CASES = [
    vp8x(_W, _H) + chunk("VP8L", vp8l(_W, _H)),
    chunk("VP8L", vp8l(_W, _H)),
    chunk("VP8 ", vp8(_W, f"{_H} + 16384")),
    vp8x(8, 8) + chunk("ALPH", _ALPH) + chunk("VP8 ", vp8(8, 8)),
    vp8x(40, 30) + chunk("ANIM", raw("FFFFFFFF0000")) + anmf("image_id % 5", "image_id % 7", chunk("ALPH", _ALPH) + chunk("VP8 ", vp8(8, 8))) + anmf(0, 0, chunk("VP8L", vp8l(8, 8))),
    raw("00000000000000"),  # 19 bytes in all
    chunk("VP8L", vp8l(_W, _H)),  # wrong signatures below
    chunk("VP8L", vp8l(_W, _H)),
    text("VP8L") + raw("E80300002F0000000088"),
    vp8x(8, 8) + text("VP8L") + raw("070000002F000000008800"),
    chunk("VP8X", raw("100000000700000700")) + chunk("VP8L", vp8l(8, 8)),
    chunk("EXIF", PLANE),
    chunk("VP8L", raw("2E") + PLANE),
    vp8x(10, 10) + chunk("VP8L", vp8l(_W, 7)) + chunk("VP8L", vp8l(7, _H)) + vp8x(_W, _H),
    anmf(0, 0, chunk("VP8L", vp8l(8, 8))),
    Hex(f"repeat({chunk('JUNK', raw('')).sql}, 150)", 1200) + chunk("VP8L", vp8l(_W, _H)),
    vp8x(8, 8) + chunk("ALPH", raw("02") + PLANE) + chunk("VP8 ", vp8(8, 8)),
    vp8x(8, 8) + chunk("ALPH", raw("00") + Hex("substr(plane, 3)", 63)) + chunk("VP8 ", vp8(8, 8)),
    vp8x(8, 8) + chunk("ALPH", raw("")) + chunk("VP8 ", vp8(8, 8)),
    vp8x(8, 8) + anmf(1, 0, chunk("VP8L", vp8l(8, 8))),
    vp8x(40, 30) + anmf(1, 1, chunk("EXIF", raw("00"))),
    vp8x(40, 30) + anmf(1, 1, chunk("VP8L", vp8l(8, 8)) + text("JUNK") + raw("0900000000")),
    vp8x(40, 30) + chunk("ANMF", Hex("substr(plane, 1, 30)", 15)),
    vp8x(8, 8) + chunk("VP8 ", vp8(9, 8)),
    chunk("VP8 ", vp8(8, 8, "110000")),
    chunk("VP8 ", Hex("substr(plane, 1, 18)", 9)),
    vp8x(8, 8) + chunk("VP8L", raw("")),
    vp8x(8, 8) + chunk("VP8L", raw("2F")),
    vp8x(8, 8) + chunk("VP8L", raw("2F07C001")),
    vp8x(40, 30) + anmf(1, 1, chunk("VP8L", raw("2F07C00100"))),
]
assert len(_CASES) == KINDS
_BODY = f"case image_id % {KINDS} " + " ".join(f"when {k} then {c.sql}" for k, c in enumerate(_CASES)) + " end"
_FILE = f"case image_id % {KINDS} when 6 then {text('RIFX').sql} else {text('RIFF').sql} end || '00000000' || case image_id % {KINDS} when 7 then {text('WEBM').sql} else {text('WEBP').sql} end || ({_BODY})"

#: (image_id, h): the bytes of each image in hexadecimal, for DuckDB.
IMAGES = f"b as (select vec_id::bigint as image_id, array_to_string(list_transform(embedding[1:64], lambda e: lpad(hex(least(255, greatest(0, floor(e::double * 128)::bigint + 128))), 2, '0')), '') as plane from embeddings), img as materialized (select image_id, plane, {_FILE} as h from b)"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, content)."""
    v = "lpad(hex(least(255L, greatest(0L, cast(floor(cast(e as double) * 128) as bigint) + 128))), 2, '0')"
    base = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("image_id"), F.expr(f"array_join(transform(slice(embedding, 1, 64), e -> {v}), '')").alias("plane"))
    return base.select("image_id", F.expr(f"unhex({_FILE.replace('//', 'div')})").alias("content"))
