"""Reviewer edits as joins on the row or conflict they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import TIMES


def edited(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` (case_id, row_no, field, new_value): the value is set, confidence becomes 1, and the flags of the field go, for a time those of all times."""
    by_row = edits.groupBy("case_id", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("field", "new_value"))).alias("new"))
    rows = rows.join(by_row, ["case_id", "row_no"], "left")
    touched = F.map_keys("new")
    gone = F.when(F.arrays_overlap(touched, F.array(*map(F.lit, TIMES))), F.concat(touched, F.array(*map(F.lit, TIMES)))).otherwise(touched)
    flags = {c: F.when(F.col("new").isNull(), F.col(c)).otherwise(F.array_except(c, gone)) for c in ("missing", "ambiguous")}
    values = {t: F.when(F.coalesce(F.array_contains(touched, t), F.lit(False)), F.col("new")[t]).otherwise(F.col(t)) for t in TIMES}
    return rows.withColumns({**flags, **values, "confidence": F.when(F.col("new").isNotNull(), F.lit(1.0)).otherwise(F.col("confidence"))}).drop("new")


def kept_pages(rows: DataFrame, choices: DataFrame, group: list[str]) -> DataFrame:
    """``choices`` (case_id, group, keep_page): of a decided group only the rows of that page stay."""
    return rows.join(choices, ["case_id", *group], "left").where("keep_page IS NULL OR source_page = keep_page").drop("keep_page")


def chosen_salaries(rows: DataFrame, choices: DataFrame) -> DataFrame:
    """``choices`` (case_id, competence, salary) set the base salary of all rows of a month."""
    return rows.join(choices, ["case_id", "competence"], "left").withColumn("base_salary", F.coalesce("salary", "base_salary")).drop("salary")


def confirmed_dates(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """The flag of the date goes for all rows of the confirmed ``pages`` (case_id, source_page)."""
    marked = rows.join(pages.select("case_id", "source_page").distinct().withColumn("confirmed", F.lit(True)), ["case_id", "source_page"], "left")
    return marked.withColumn("ambiguous", F.when(F.col("confirmed"), F.array_remove("ambiguous", "date")).otherwise(F.col("ambiguous"))).drop("confirmed")


def needs_attention(rows: DataFrame, least: float = 0.5) -> DataFrame:
    return rows.where((F.col("confidence") < least) | (F.size("missing") > 0) | (F.size("ambiguous") > 0))

