"""The registered queries and the same in SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def s8(x: str) -> str:
    return f"((({x}) + 128) % 256 + 256) % 256 - 128"


def clip(x: str, low: int = 0, high: int = 255) -> str:
    return f"greatest({low}, least({high}, {x}))"
