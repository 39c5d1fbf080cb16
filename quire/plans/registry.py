"""Where queries and their SQL are registered, and the settings they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TEST_WORDS, Config

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SMALL = replace(TEST_WORDS, candidates=2)
#: Few words and many numbers, so that pages beside a page with words hold numbers alone.
SPARSE = replace(TEST_WORDS, weak=("copyright",), patterns=(r"\d{2,}",), least_patterns=1_000)
DEFAULT = Config()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def long(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]
