"""Evaluation as truth files come: each file is scored once, by a stream that runs until it has read what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate
from ..sources.case_files import folders
from ..sources.files import file_case


def truth_stream(spark: SparkSession, path: str, suffix: str = ".json", most_files: int = 10_000) -> DataFrame:
    """case_id, document of the truth files below ``path`` as a stream, ``most_files`` to a batch; a file is read whole, and only once."""
    rows = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", most_files).load(path)
    return rows.select(file_case(suffix).alias("case_id"), F.col("value").alias("document"))


def day_and_item_scores(documents: DataFrame, cards: DataFrame, slips: DataFrame) -> DataFrame:
    """A row for each case of ``documents``: its problem, if it has one, and its counters against ``cards`` (case_id, date, times, ambiguous) and ``slips`` (case_id, competence, amount, label_key, row_no)."""
    _, days, items, problems = evaluate.truth_tables(documents)
    days, items = days.drop("pos"), items.withColumns({"label_key": F.col("item_name"), "row_no": F.col("pos")})
    cases = documents.select("case_id").distinct()
    mine = lambda rows: rows.join(cases, "case_id", "left_semi")
    day = evaluate.day_scores(days, mine(cards)).select("case_id", F.col("fields").alias("day_fields"), F.col("correct").alias("day_correct"))
    item = evaluate.item_scores(items, mine(slips)).select("case_id", F.col("expected").alias("item_expected"), F.col("matched").alias("item_matched"))
    whole = cases.join(problems, "case_id", "left").join(day, "case_id", "left").join(item, "case_id", "left")
    counters = ("day_fields", "day_correct", "item_expected", "item_matched")
    return whole.select("case_id", "problem", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counters))


def score_new(documents: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Score the documents that no earlier run with this ``checkpoint`` has read, and append their rows to ``path``.

    A batch writes its own folder and replaces it when it runs again, so a batch that is repeated after a failure changes nothing."""
    def batch(rows: DataFrame, number: int) -> None:
        score(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def score_folders(spark: SparkSession, path: str, score: Callable[[DataFrame, str], DataFrame], out: str, checkpoint: str) -> None:
    """``score_new`` for the truth files of each folder below ``path``, a stream after the other; ``score`` gets the folder's name, too.

    A stream's driver lists all its files and keeps their names, so a stream holds one folder's; Spark's own records of files and tasks outlast it, up to Spark's limits."""
    for name in folders(path):
        score_new(truth_stream(spark, f"{path}/{name}"), lambda rows, name=name: score(rows, name), f"{out}/folder={name}", f"{checkpoint}/{name}")
