"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of the tables that cut() wrote, and of file sets given to note(), by name of the application.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the folder given to SparkContext.setCheckpointDir. Only a session on one machine (local master) without either gets a new folder of its own; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pixweft-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def note(spark: SparkSession, path: str) -> str:
    """Have clear() delete the path too."""
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later stages don't recompute it when an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/pixweft/{name}-{uuid.uuid4().hex}"
    df.write.parquet(note(df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the tables that cut() wrote in this application, and what note() named. Results that were not collected or written yet can't be read any more."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


#: Bits of a bitmap, as a power of two: 8 MB, whatever it marks.
MARKS = 26


def bitmap(df: DataFrame, name: str) -> np.ndarray:
    """A bitmap of the hashed values of a long column, by which tasks drop rows that a later join would drop; values in it by chance only cost work. At most 2 ** (MARKS - 6) sums reach the driver."""
    m = F.pmod(F.col(name), F.lit(1 << MARKS))
    words = df.select(m.alias("m")).groupBy(F.expr("shiftright(m, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(m % 64 as int))")).alias("bits"))
    got = words.toArrow()
    marks = np.zeros(1 << (MARKS - 6), np.uint64)
    marks[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return marks


def marked(values: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which of the longs are in the bitmap."""
    m = values & np.int64((1 << MARKS) - 1)
    return (marks[m >> 6] >> (m & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def column(name: str) -> Column:
    """The column of this very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def judged(column_: Column, batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: Callable[[pa.Table], pa.Array]) -> Column:
    """What `keep` tells from the rows that `batches` makes of the texts, one for each in their order. Only texts go to Python; the table's other columns, of whatever type, stay where they are."""

    @F.arrow_udf("boolean")
    def verdict(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            made = list(batches(iter([pa.RecordBatch.from_arrays([array], ["text"])]))) if len(array) else []
            yield keep(pa.Table.from_batches(made)) if made else pa.array([], pa.bool_())

    return verdict(column_.cast("string"))


def free_name(df: DataFrame, name: str) -> str:
    """The name, or with underscores behind it if a column of df has it."""
    while name in {c.lower() for c in df.columns}:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """The rows of docs whose doc_id isn't in gone (doc_id, one row each), with their columns, whatever those are called."""
    key = free_name(docs, "gone_id")
    ids = cut(gone.select(F.col("doc_id").alias(key)), name)
    return docs.join(ids, docs["`doc_id`"] == ids[key], "left_anti")
