"""Model answers as JSON: parsed, checked and joined to what was asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import read_time

#: Types of pages, and shapes of the answers; numbers are read as text and checked, so that one bad value spoils its own row only; values of conflicts may be of any type and keep it.
TYPES = ("CARTAO_PONTO", "HOLERITE", "IRRELEVANTE")
STRIPS = "strips array<struct<id: string, values: array<string>>>"
_DAY = "struct<date: string, clock_in: string, break_start: string, break_end: string, clock_out: string, confidence: string, missing_fields: array<string>, ambiguous_fields: array<string>>"
_ITEM = "struct<competence: string, item_name: string, amount: string, base_salary: string, confidence: string>"
_CONFLICT = "struct<field: string, values: array<variant>, source_pages: array<int>>"
_LISTS = "missing_fields: array<string>, ambiguous_fields: array<string>"
ANSWER = f"pages array<struct<page_number: string, document_type: string, confidence: string, time_cards: array<{_DAY}>, payslips: array<{_ITEM}>, {_LISTS}, conflicts: array<{_CONFLICT}>>>"


def unfenced(answer: str):
    return F.regexp_replace(F.trim(answer), r"^```[a-z]*\s*|\s*```$", "")


def answer_pages(answers: DataFrame) -> DataFrame:
    """``answers`` (case_id, call, answer): a row for each page with a known type (without one, it is irrelevant) and a confidence from 0 to 1 (without one, 0), with its nested rows; code fences are cut off."""
    rows = answers.select("case_id", "call", F.posexplode(F.from_json(unfenced("answer"), ANSWER)["pages"]).alias("pos", "p")).select("case_id", "call", "pos", "p.*")
    rows = rows.withColumns({
        "page_number": F.col("page_number").try_cast("int"), "document_type": F.coalesce("document_type", F.lit(TYPES[2])), "confidence": F.coalesce("confidence", F.lit("0")).try_cast("double"),
    })
    return rows.where(F.col("page_number").isNotNull() & F.col("document_type").isin(*TYPES) & F.col("confidence").between(0, 1))


def parsed(answers: DataFrame) -> DataFrame:
    """case_id, call, pos, page_number, document_type, confidence of the valid pages."""
    return answer_pages(answers).select("case_id", "call", "pos", "page_number", "document_type", "confidence")


def classified(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """The first valid answer for each page that was asked in its call."""
    rows = asked.join(parsed(answers), ["case_id", "call", "page_number"])
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("case_id", "page_number").orderBy("call", "pos"))).where("nth = 1").select("case_id", "page_number", "document_type", "confidence")


def unclassified(asked: DataFrame, found: DataFrame, overflow: DataFrame) -> DataFrame:
    """Pages without an answer, and those never sent."""
    return asked.select("case_id", "page_number").join(found, ["case_id", "page_number"], "left_anti").union(overflow.select("case_id", "page_number")).distinct()


def strip_reads(cells: DataFrame, answers: DataFrame) -> DataFrame:
    """``cells`` (case_id, strip_id, row_pos from 1, ...) with the time that the answers read for each, by place in its strip.

    Answers for unknown strips, or with another number of values than the strip has rows, don't count; of several the last does."""
    items = answers.select("case_id", F.posexplode(F.from_json(unfenced("answer"), STRIPS)["strips"]).alias("at", "s")).select("case_id", "at", F.col("s.id").alias("strip_id"), F.col("s.values").alias("values"))
    sizes = cells.groupBy("case_id", "strip_id").agg(F.count("*").alias("n"))
    whole = items.join(sizes, ["case_id", "strip_id"]).where(F.size("values") == F.col("n")).groupBy("case_id", "strip_id").agg(F.max_by("values", "at").alias("values"))
    return cells.join(whole, ["case_id", "strip_id"]).withColumn("model_read", read_time(F.get("values", F.col("row_pos") - 1))).drop("values")
