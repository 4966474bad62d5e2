"""The chunks of RIFF/WebP files as rows.

A file is walked header by header from byte 12 while 8 bytes are left; the size field of the RIFF header isn't read. The first ANMF chunk of at least
16 bytes is walked inside as well, from its byte 16. A chunk whose payload or pad byte doesn't fit ends its walk.

Every file has a row of scope `file` and ordinal -1 with its size, and `fits` tells there whether it is long enough and has both signatures; without them, and for
null contents (size null), there are no other rows. Image ids name one file each. One file is read by one task; its chunks are counted by no limit.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNKS = "image_id bigint, scope string, ordinal int, at bigint, tag string, size bigint, payload bigint, fits boolean, head binary, body binary"
_SCHEMA = pa.schema([("image_id", pa.int64()), ("scope", pa.string()), ("ordinal", pa.int32()), ("at", pa.int64()), ("tag", pa.string()), ("size", pa.int64()), ("payload", pa.int64()), ("fits", pa.bool_()), ("head", pa.binary()), ("body", pa.binary())])
HEAD, LEAST, ROWS = 16, 20, 1 << 14


def _steps(data: memoryview, begin: int, end: int) -> Iterator[tuple[int, str, int, int, bool]]:
    """(place, tag, size, payload, fits) of the chunks between two places."""
    at, fits = begin, True
    while fits and at + 8 <= end:
        tag, size = struct.unpack_from("<4sI", data, at)
        stop = at + 8 + size + size % 2
        fits = stop <= end
        yield at, tag.decode("latin-1"), size, at + 8, fits
        at = stop


def _walked(batches: Iterator[pa.RecordBatch], keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for image, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not content.is_valid:
                rows.append((image, "file", -1, None, None, None, None, False, None, None))
                continue
            data = memoryview(content.as_buffer())
            good = len(data) >= LEAST and data[:4] == b"RIFF" and data[8:12] == b"WEBP"
            rows.append((image, "file", -1, 0, None, len(data), 12, good, None, None))
            frame = None
            for scope in ("file", "frame") if good else ():
                begin, end = (12, len(data)) if scope == "file" else frame or (0, 0)
                for k, (at, tag, size, payload, fits) in enumerate(_steps(data, begin, end)):
                    if scope == "file" and tag == "ANMF" and fits and frame is None:
                        frame = (payload + 16, payload + size)
                    body = bytes(data[payload : payload + size]) if tag in keep and fits else None
                    rows.append((image, scope, k, at, tag, size, payload, fits, bytes(data[payload : payload + min(size, HEAD)]), body))
                    if len(rows) >= ROWS:
                        yield _batch(rows)
                        rows = []
    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_SCHEMA.types)], schema=_SCHEMA)


def chunks(images: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """CHUNKS of images (image_id, content); head: the first bytes of a payload, body: all of it for the tags to keep."""
    return images.select(F.col("image_id").cast("bigint"), F.col("content").cast("binary")).mapInArrow(lambda batches: _walked(batches, keep), CHUNKS)


def read_files(spark, path: str) -> DataFrame:
    """(image_id, path, content) of a folder of files; ids are hashes of the paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("image_id"), "path", "content")


def byte(data: Column | str, at: int) -> Column:
    """A byte of a binary column as a number; null beyond its end."""
    return F.conv(F.hex(F.substring(data, at + 1, 1)), 16, 10).cast("bigint")


def little(data: Column | str, at: int, n: int) -> Column:
    """n bytes as an unsigned little-endian number."""
    out = byte(data, at)
    for k in range(1, n):
        out = out + byte(data, at + k) * (1 << 8 * k)
    return out
