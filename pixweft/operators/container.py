"""Probe, dispatch and error columns of WebP files, from the rows of sources.container.

Which chunk counts: of VP8X the last, of all others the first. Dimensions come from the VP8X canvas, else the VP8L header, else the VP8 header, else the
first frame. The bit streams themselves are not decoded: outcome() tells what happens before them and, as if they decode, after them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.container import byte, little

_MOST, _LEAST = 2**63 - 1, -(2**63)
_FIRST = {"vp8l": "VP8L", "vp8": "VP8 ", "alph": "ALPH", "anmf": "ANMF"}


def _part(name: str, scope: str, tag: str) -> Column:
    own = F.when((F.col("scope") == scope) & (F.col("tag") == tag) & F.col("fits"), F.struct("ordinal", "payload", "size", "head", "body"))
    return (F.max(own) if tag == "VP8X" else F.min(own)).alias(name)


def parts(chunks: DataFrame) -> DataFrame:
    """A row for each image: good (signatures), bad and frame_bad (the tag that ends a walk), has_anim, and the chunks that count as structs."""
    short = (F.col("tag") == "VP8X") & (F.col("size") < 10)
    fails = lambda scope: F.min(F.when((F.col("scope") == scope) & (F.col("ordinal") >= 0) & (~F.col("fits") | (short if scope == "file" else F.lit(False))), F.struct("ordinal", "tag")))["tag"]
    found = [_part(n, "file", t) for n, t in {**_FIRST, "vp8x": "VP8X"}.items()] + [_part(f"frame_{n}", "frame", t) for n, t in _FIRST.items() if n != "anmf"]
    anim = F.coalesce(F.bool_or((F.col("scope") == "file") & F.col("tag").isin("ANIM", "ANMF")), F.lit(False))
    return chunks.groupBy("image_id").agg(F.bool_or((F.col("ordinal") == -1) & F.col("fits")).alias("good"), fails("file").alias("bad"), fails("frame").alias("frame_bad"), anim.alias("has_anim"), *found)


def vp8l_size(part: str) -> tuple[Column, Column]:
    """(width, height) of a VP8L header; null if it is short or lacks its signature."""
    head, bits = F.col(f"{part}.head"), little(F.col(f"{part}.head"), 1, 4)
    fits = (F.col(f"{part}.size") >= 5) & (byte(head, 0) == 0x2F)
    return F.when(fits, 1 + bits.bitwiseAND(F.lit(16383))), F.when(fits, 1 + F.shiftright(bits, 14).bitwiseAND(F.lit(16383)))


def vp8_size(part: str) -> tuple[Column, Column]:
    """(width, height) of a VP8 frame header without the scale bits; null if it is short, lacks its start code or has no size. The key-frame bit isn't looked at."""
    head = F.col(f"{part}.head")
    w, h = (little(head, at, 2).bitwiseAND(F.lit(16383)) for at in (6, 8))
    fits = (F.col(f"{part}.size") >= 10) & (F.hex(F.substring(head, 4, 3)) == "9D012A") & (w > 0) & (h > 0)
    return F.when(fits, w), F.when(fits, h)


def frame_box(part: str = "anmf") -> tuple[Column, ...]:
    """(x, y, width, height) of an ANMF header; null if it is short."""
    head, fits = F.col(f"{part}.head"), F.col(f"{part}.size") >= 16
    return tuple(F.when(fits, v) for v in (2 * little(head, 0, 3), 2 * little(head, 3, 3), 1 + little(head, 6, 3), 1 + little(head, 9, 3)))


def _errors(cases: list[tuple[Column, str, Column | str, str]], end: tuple[Column | str, Column | str, Column | str]) -> list[Column]:
    """Columns reason, chunk and stage of the first case that holds."""
    out = []
    for k, name in enumerate(("reason", "chunk", "stage")):
        value = None
        for case in cases:
            v = case[k + 1] if isinstance(case[k + 1], Column) else F.lit(case[k + 1])
            value = F.when(case[0], v) if value is None else value.when(case[0], v)
        last = end[k] if isinstance(end[k], Column) else F.lit(end[k])
        out.append(value.otherwise(last).alias(name))
    return out


def _shown(tag: Column | str) -> Column:
    """A tag as text: up to its first zero byte; four dashes for four of them."""
    tag = F.col(tag) if isinstance(tag, str) else tag
    return F.when(tag == "\0\0\0\0", "----").otherwise(F.substring_index(tag, "\0", 1))


def _settled(df: DataFrame) -> DataFrame:
    """The same rows, one for each image_id, as an aggregate on the partitioning they have: later filters and columns then refer to its values and don't repeat their long expressions."""
    return df.groupBy("image_id").agg(F.first(F.struct(*(c for c in df.columns if c != "image_id"))).alias("_row")).select("image_id", "_row.*")


def probe(chunks: DataFrame) -> DataFrame:
    """parts() with width, height (null on failure), reason, chunk and stage."""
    p = parts(chunks)
    sizes = [(F.when(F.col("vp8x").isNotNull(), 1 + little(F.col("vp8x.head"), 4, 3)), F.when(F.col("vp8x").isNotNull(), 1 + little(F.col("vp8x.head"), 7, 3))), vp8l_size("vp8l"), vp8_size("vp8"), frame_box()[2:]]
    p = p.withColumns({"width": F.coalesce(*(s[0] for s in sizes)), "height": F.coalesce(*(s[1] for s in sizes))})
    none = F.col("vp8").isNull() & F.col("vp8l").isNull() & F.col("anmf").isNull()
    cases = [(~F.col("good"), "invalid-header", "----", "container"), (F.col("bad").isNotNull(), "chunk-bounds", _shown("bad"), "container"), (none, "missing-image-payload", "----", "container"), (F.col("width").isNull(), "invalid-dimensions", "----", "ok")]
    p = p.select("*", *_errors(cases, ("ok", "----", "ok")))
    ok = F.col("reason") == "ok"
    return _settled(p.withColumns({"width": F.when(ok, F.col("width")), "height": F.when(ok, F.col("height"))}))


def needed_bytes(stride: Column, height: Column) -> Column:
    """Bytes of an output of rows with a stride; null where the product isn't below 2 ** 63 in size. No exception is made for such rows, however many they are."""
    a, b = stride.cast("bigint"), height.cast("bigint")
    fits = (a > _LEAST) & (b > _LEAST) & (F.abs(a) <= F.call_function("div", F.lit(_MOST), F.abs(b)))
    return F.when(b == 0, a - a).when(fits, a * b)


def least_output(stride: Column, width: Column, height: Column) -> Column:
    """Bytes that the lossy decoder asks for: the last row needs no stride."""
    rows = needed_bytes(stride, height - 1)
    return F.when(rows <= _MOST - F.greatest(4 * width, F.lit(0)), rows + 4 * width)


def _backend(scope: str, w: Column, h: Column) -> tuple[list[tuple[Column, str, str, str]], Column]:
    """Failures that headers tell, and the path: vp8l, vp8 or vp8+alph."""
    name = lambda n: f"{scope}{n}"
    lossless, has = F.col(name("vp8l")).isNotNull(), F.col(name("alph")).isNotNull()
    head, size = F.col(f"{name('vp8')}.head"), F.col(f"{name('vp8')}.size")
    own_w, own_h = vp8_size(name("vp8"))
    first = F.shiftright(little(head, 0, 3), 5)
    fits = own_w.isNotNull() & (byte(head, 0) % 2 == 0) & (F.greatest(own_w, own_h) <= 4096) & (own_w == w) & (own_h == h) & (10 + first <= size)
    method = byte(F.col(f"{name('alph')}.head"), 0) % 4
    a_size = F.col(f"{name('alph')}.size")
    cases = [
        (lossless & ~F.coalesce((byte(F.col(f"{name('vp8l')}.head"), 0) == 0x2F) & (F.col(f"{name('vp8l')}.size") >= 5), F.lit(False)), "decode-backend-failed", "VP8L", "header"),
        (~lossless & ~F.coalesce(fits, F.lit(False)), "decode-backend-failed", "VP8 ", "vp8"),
        (~lossless & has & (a_size == 0), "ok", "----", "ok"),
        (~lossless & has & (method > 1), "alph-unsupported-mode", "ALPH", "alph-mode"),
        (~lossless & has & (method == 0) & (a_size < 1 + F.try_multiply(w, h)), "alph-invalid-payload", "ALPH", "alph-raw"),
    ]
    return cases, F.when(lossless, "vp8l").when(has, "vp8+alph").otherwise("vp8")


def outcome(chunks: DataFrame, stride: Column, size: Column) -> DataFrame:
    """probe() with x, y, w, h of the first frame, path (what decodes the image; null if nothing is asked to), done and reason, chunk and stage of decoding into an output of `size` bytes.

    done assumes that bit streams decode: failures inside them aren't told. An output is refused if its stride is null, not positive or below 4 bytes a pixel, or the product doesn't fit.
    """
    p = probe(chunks).withColumns({"_stride": stride.cast("bigint"), "_size": size.cast("bigint")})
    p = p.withColumns(dict(zip(("x", "y", "w", "h"), frame_box(), strict=True)))
    moving = F.col("has_anim") & F.col("anmf").isNotNull()
    room = (F.col("_stride") >= 4 * F.col("width")) & (needed_bytes(F.col("_stride"), F.col("height")) <= F.col("_size"))
    still_cases, still_path = _backend("", F.col("width"), F.col("height"))
    frame_cases, frame_path = _backend("frame_", F.col("w"), F.col("h"))
    before = [
        (~F.coalesce(F.col("_stride") > 0, F.lit(False)) | F.col("_size").isNull(), "invalid-dimensions", "----", "container"),
        (F.col("reason") != "ok", F.col("reason"), F.col("chunk"), F.col("stage")),
        (~F.coalesce(room, F.lit(False)), "invalid-dimensions", "----", "ok"),
        (moving & F.col("w").isNull(), "chunk-bounds", "ANMF", "ok"),
        (moving & ((F.col("x") + F.col("w") > F.col("width")) | (F.col("y") + F.col("h") > F.col("height"))), "frame-bounds", "ANMF", "ok"),
        (moving & F.col("frame_bad").isNotNull(), "chunk-bounds", _shown("frame_bad"), "ok"),
        (moving & F.col("frame_vp8").isNull() & F.col("frame_vp8l").isNull(), "missing-image-payload", "ANMF", "ok"),
    ]
    asked = ~F.coalesce(F.greatest(*(F.when(c[0], 1).otherwise(0) for c in before)) == 1, F.lit(False))
    after = [(moving & c[0], *c[1:]) for c in frame_cases] + [(~moving & c[0], *c[1:]) for c in still_cases]
    fails = F.coalesce(F.greatest(*(F.when(c[0], 1).otherwise(0) for c in [*before, *after])) == 1, F.lit(False))
    shown = F.when(moving, "ANMF").when(still_path == "vp8+alph", "ALPH").when(still_path == "vp8l", "VP8L").otherwise("VP8 ")
    errors = _errors([*before, *after], ("ok", shown, "ok"))
    path = F.when(asked, F.when(moving, F.concat(F.lit("frame "), frame_path)).otherwise(still_path)).alias("path")
    kept = [c for c in p.columns if c not in ("reason", "chunk", "stage", "_stride", "_size")]
    return _settled(p.select(*kept, path, (~fails).alias("done"), *errors))
