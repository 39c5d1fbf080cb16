"""Ground truth and metrics as JSON files: one case a row or a file."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DAY = "struct<date: string, clock_in: string, break_start: string, break_end: string, clock_out: string>"
_ITEM = "struct<competence: string, item_name: string, amount: string>"
#: Fixed value: shape of a case's ground truth.
TRUTH = f"pages map<string, string>, time_cards array<{_DAY}>, payslips array<{_ITEM}>, meta struct<layout: string, scan: string>"


def truth_documents(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """case_id (the file's name without ``suffix``) and document (its whole text) of the JSON files at ``path``, a folder or a glob."""
    return spark.read.text(path, wholetext=True).select(file_case(suffix).alias("case_id"), F.col("value").alias("document"))


def file_case(suffix: str = ".json") -> Column:
    """The name of the file that a row comes from, without ``suffix``."""
    return F.regexp_extract(F.input_file_name(), rf"([^/]+?){suffix.replace('.', '[.]')}$", 1)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, below ``spark.checkpoint.dir``; a local session without that setting gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in a new shared folder, which cuts its lineage; the folder's owner deletes it. With ``by``, a part for each value of that column."""
    path = shared_folder(df.sparkSession, name)
    if by is None:
        df.write.parquet(path)
    else:
        df.repartition(by).write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_metrics(scores: DataFrame, path: str, done: DataFrame | None = None) -> None:
    """Append a JSON line for each case to ``path``; cases of ``done`` (case_id) were measured before and stay as they are."""
    rows = scores if done is None else scores.join(done.select("case_id").distinct(), "case_id", "left_anti")
    rows.write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The metrics of all runs under ``path``, a folder or a glob."""
    return spark.read.schema(schema).json(path)
