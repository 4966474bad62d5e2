"""The scalar expressions and the chunk walk as functions of SQL: register(spark), then `select px_average(a, b) from ...` or `select c.* from files, lateral webp_chunks(content) c`.

Scalar functions are SQL expressions, which Catalyst puts in place of the calls; nulls give null. webp_chunks is a table function in Python, for each file alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..sources.container import _walked

_LANES = "x bigint, y bigint"
_SUM = "((shiftright({0}, 24) & 255) + (shiftright({0}, 16) & 255) + (shiftright({0}, 8) & 255) + ({0} & 255))"
#: (name, parameters, body), each of type bigint; later ones use earlier ones.
FUNCTIONS = [
    ("px_clip", "v bigint, low bigint, high bigint", "case when v < low then low when v > high then high else v end"),
    ("px_channel", "argb bigint, place int", "shiftright(argb, 8 * place) & 255"),
    ("px_argb", "a bigint, r bigint, g bigint, b bigint", "a * 16777216 + r * 65536 + g * 256 + b"),
    ("px_average", _LANES, "(shiftright((x & 16711935) + (y & 16711935), 1) & 16711935) | shiftleft(shiftright((shiftright(x, 8) & 16711935) + (shiftright(y, 8) & 16711935), 1), 8)"),
    ("px_select", "l bigint, t bigint, k bigint", f"if(abs({_SUM.format('l')} - {_SUM.format('k')}) < abs({_SUM.format('t')} - {_SUM.format('k')}), l, t)"),
    ("px_mean2", _LANES, "shiftright(x + y + 1, 1)"),
    ("px_mean3", "x bigint, y bigint, z bigint", "shiftright(x + 2 * y + z + 2, 2)"),
    ("px_cache_slot", "argb bigint, width int", "shiftright((argb * 506832829) & 4294967295, 32 - width)"),
    ("px_prefix_value", "symbol bigint, extra bigint", "case when symbol < 0 then null when symbol < 4 then symbol + 1 when symbol < 52 then shiftleft(2 + (symbol & 1), cast(shiftright(symbol - 2, 1) as int)) + extra + 1 end"),
    ("px_needed_bytes", "stride bigint, height bigint", "case when height = 0 then 0 when stride = 0 then 0 when abs(stride) <= 9223372036854775807 div abs(height) then stride * height end"),
]
CHUNKS = "scope string, ordinal int, at bigint, tag string, size bigint, payload bigint, fits boolean, head binary"


class WebpChunks:
    """The rows of sources.container.chunks of one file."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        for batch in _walked(iter([pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([content], pa.binary())], ["image_id", "content"])]), ()):
            for r in batch.to_pylist():
                yield tuple(r[x.split()[0]] for x in CHUNKS.split(", "))


def register(spark: SparkSession) -> None:
    """Temporary functions of this session: FUNCTIONS and webp_chunks(binary)."""
    for name, parameters, body in FUNCTIONS:
        spark.sql(f"create or replace temporary function {name}({parameters}) returns bigint return {body}")
    spark.udtf.register("webp_chunks", udtf(WebpChunks, returnType=CHUNKS))
