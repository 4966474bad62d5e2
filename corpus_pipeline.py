"""Corpus pipeline: quality rules, language ID, near-dedup, decontamination, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixweft.llm import stages
from pixweft.llm.shared import cut, documents

STAGES = [
    ("quality rules", stages.good_quality),
    ("language ID", stages.known_language),
    ("MinHash near-dedup", stages.one_of_each_group),
    ("benchmark decontamination", stages.no_benchmark),
    ("BPE encoding", stages.encoded),
]

#: Compression ratios, automata and BPE have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES on the documents table, each stage's rows written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs, f"stage{k}") if k < len(STAGES) - 1 else docs
    return docs
