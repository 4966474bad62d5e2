"""The stages of corpus_pipeline.py: (spark, docs, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe, decontam, langid, neardup, quality
from .shared import column, free_name, without


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with their columns."""
    return quality.keep_good(docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some learned language fits, with their columns."""
    return langid.keep_known(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near-duplicates, with its columns; of rows with one doc_id that with the least text stays, and all rows without doc_id."""
    gone = neardup.near_duplicates(docs).where("doc_id is not null and not kept").select("doc_id").distinct()
    left = without(docs, gone, "gone")
    repeated = left.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        return left
    place = free_name(left, "place")
    first = left.where("doc_id is not null").withColumn(place, F.row_number().over(W.partitionBy(column("doc_id")).orderBy(column("text")))).where(F.col(place) == 1).drop(place)
    return first.unionByName(left.where("doc_id is null"))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item, with their columns."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens) of every document."""
    return bpe.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))
