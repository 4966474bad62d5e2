"""Expressions over channels and packed ARGB pixels. All values are bigint: sums of ints overflow under ANSI."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def long(c: Column | str | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else col(c)).cast("bigint")


def shift(c: Column | str, n: int) -> Column:
    """Arithmetic right shift."""
    return F.shiftright(long(c), n)


def low8(c: Column | str) -> Column:
    return long(c).bitwiseAND(F.lit(255))


def clip(c: Column | str, low: int = 0, high: int = 255) -> Column:
    """The nearest value between the bounds; null for null."""
    return F.when(long(c).isNotNull(), between(c, low, high))


def between(c: Column | str, low: int, high: int) -> Column:
    """clip() of what isn't null; a null gives the upper bound, as least() skips it."""
    return F.greatest(F.lit(low).cast("bigint"), F.least(F.lit(high).cast("bigint"), long(c)))


def signed8(c: Column | str) -> Column:
    """A byte read as a signed number."""
    return F.pmod(long(c) + 128, F.lit(256)) - 128


def channel(argb: Column | str, name: str) -> Column:
    return low8(shift(argb, {"a": 24, "r": 16, "g": 8, "b": 0}[name]))


def argb(a: Column | str, r: Column | str, g: Column | str, b: Column | str) -> Column:
    return long(a) * 16777216 + long(r) * 65536 + long(g) * 256 + long(b)


def each(f, *pixels: Column) -> Column:
    """A pixel of f applied to each channel of the pixels."""
    return argb(*(f(*(channel(p, c) for p in pixels)) for c in "argb"))


def mean2(x: Column | str, y: Column | str) -> Column:
    """The mean of two samples, halves rounded up."""
    return shift(long(x) + long(y) + 1, 1)


def mean3(x: Column | str, y: Column | str, z: Column | str) -> Column:
    """The mean of three samples, the middle one counted twice, halves rounded up."""
    return shift(long(x) + 2 * long(y) + long(z) + 2, 2)


def average(p: Column, q: Column) -> Column:
    """The halved sum in lanes of 16 bits. The alpha and green lanes aren't masked after the shift: the lowest bit of the alpha sum goes into the highest bit of red."""
    half = each(lambda x, y: shift(x + y, 1), p, q)
    carry = (channel(p, "a") + channel(q, "a")).bitwiseAND(F.lit(1)) * 8388608
    return half.bitwiseOR(carry)


def total(p: Column) -> Column:
    return channel(p, "a") + channel(p, "r") + channel(p, "g") + channel(p, "b")


def select(left: Column, top: Column, top_left: Column) -> Column:
    """The left pixel if its channel sum is nearer to the corner's than the top's is, else the top pixel."""
    return F.when(F.abs(total(left) - total(top_left)) < F.abs(total(top) - total(top_left)), left).otherwise(top)


def half_step(x: Column, y: Column) -> Column:
    """x plus half of x - y, halved toward zero, clipped."""
    return between(x + toward_zero_half(x - y), 0, 255)


def toward_zero_half(d: Column) -> Column:
    return shift(d + F.when(d < 0, 1).otherwise(0), 1)


BLACK = 4278190080


def predictors(left: Column, top: Column, top_left: Column, top_right: Column) -> list[Column]:
    """The predictions of modes 0 to 13, of pixels that aren't null."""
    return [
        F.lit(BLACK).cast("bigint"),
        left,
        top,
        top_right,
        top_left,
        average(average(left, top_right), top),
        average(left, top_left),
        average(left, top),
        average(top_left, top),
        average(top, top_right),
        average(average(left, top_left), average(top, top_right)),
        select(left, top, top_left),
        each(lambda a, b, c: between(a + b - c, 0, 255), left, top, top_left),
        each(half_step, average(left, top), top_left),
    ]
