"""Validation and reconciliation of time-card and payslip rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import cents, chronological, label_key, normalized_date, normalized_month, normalized_time

TIMES = ("clock_in", "break_start", "break_end", "clock_out")


def valid_time_cards(rows: DataFrame) -> DataFrame:
    """Normalised dates and times, with the ordered lists of missing and ambiguous fields; lists that rows bring come first."""
    given = {c: F.col(c) if c in rows.columns else F.array().cast("array<string>") for c in ("missing", "ambiguous")}
    rows = rows.withColumns({f"{c}_given": v for c, v in given.items()})
    clean = rows.withColumns({"date": normalized_date(F.col("date_raw")), **{f"{t}_ok": normalized_time(F.col(t)) for t in TIMES}})
    unread = [F.when(F.col(t).isNotNull() & F.col(f"{t}_ok").isNull(), F.lit(t)) for t in TIMES]
    clean = clean.withColumn("ambiguous", F.array_distinct(F.concat("ambiguous_given", F.array_compact(F.array(F.when(F.col("date").isNull(), F.lit("date")), *unread)))))
    absent = []
    for a, b in (("clock_in", "clock_out"), ("break_start", "break_end")):
        one = F.when(F.col(f"{a}_ok").isNull() & F.col(f"{b}_ok").isNotNull(), F.lit(a)).when(F.col(f"{b}_ok").isNull() & F.col(f"{a}_ok").isNotNull(), F.lit(b))
        absent.append(F.when(~F.array_contains("ambiguous", one), one))
    clean = clean.withColumn("missing", F.array_distinct(F.concat("missing_given", F.array_compact(F.array(*absent)))))
    given = F.array_compact(F.array(*[F.when(F.col(f"{t}_ok").isNotNull(), F.lit(t)) for t in TIMES]))
    disordered = ~chronological([F.col(f"{t}_ok") for t in TIMES])
    clean = clean.withColumn("ambiguous", F.when(disordered, F.array_distinct(F.concat("ambiguous", given))).otherwise(F.col("ambiguous")))
    return clean.withColumns({t: F.col(f"{t}_ok") for t in TIMES}).withColumn("day_key", F.coalesce("date", "date_raw")).drop(*(f"{t}_ok" for t in TIMES), "missing_given", "ambiguous_given")


def valid_payslips(rows: DataFrame) -> DataFrame:
    """Normalised months and trimmed names, with the list of ambiguous fields; a list that rows bring comes first."""
    month, name = normalized_month(F.col("competence")), F.trim("item_name")
    own = F.array_compact(F.array(F.when(F.col("month").isNull(), F.lit("competence")), F.when(F.col("item_name") == "", F.lit("item_name"))))
    flags = F.array_distinct(F.concat("ambiguous", own)) if "ambiguous" in rows.columns else own
    return rows.withColumn("month", month).withColumn("item_name", name).withColumn("ambiguous", flags).withColumn("competence", F.coalesce("month", "competence")).withColumn("label_key", label_key(F.col("item_name"))).drop("month")


def reconciled(rows: DataFrame, group: list[str], value: Column) -> DataFrame:
    """Rows with ``kept`` and ``disputed``. In a group on two pages or more, of equal values the page of the
    row with the highest confidence (then the smallest page) stays, with all its rows; a group with
    several values before that is disputed if it spans two pages after it."""
    g = Window.partitionBy("case_id", *group)
    rows = rows.withColumn("value_key", value)
    v = Window.partitionBy("case_id", *group, "value_key")
    one = lambda w, c: F.min(c).over(w) != F.max(c).over(w)
    rows = rows.withColumns({"on_pages": one(g, "source_page"), "many_values": one(g, "value_key"), "best_page": F.max_by("source_page", F.struct(F.col("confidence"), -F.col("source_page"))).over(v)})
    rows = rows.withColumn("kept", ~F.col("on_pages") | (F.col("source_page") == F.col("best_page")))
    page = F.when(F.col("kept"), F.col("source_page"))
    return rows.withColumn("disputed", F.col("on_pages") & F.col("many_values") & (F.min(page).over(g) != F.max(page).over(g)))


def conflicts(rows: DataFrame, group: list[str]) -> DataFrame:
    """A row for each disputed group: its values in row order and its pages."""
    found = rows.where("kept AND disputed").groupBy("case_id", *group)
    values = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "value_key"))), lambda x: x["value_key"]))
    return found.agg(F.array_join(values, "; ").alias("found_values"), F.array_join(F.array_sort(F.collect_set("source_page")), ",").alias("source_pages"))


def day_value() -> Column:
    return F.concat_ws("/", *(F.coalesce(F.col(t), F.lit("-")) for t in TIMES))


def reconciled_time_cards(rows: DataFrame) -> DataFrame:
    return reconciled(valid_time_cards(rows), ["day_key"], day_value())


def reconciled_payslips(rows: DataFrame) -> DataFrame:
    return reconciled(valid_payslips(rows), ["competence", "label_key"], cents(F.col("amount")).cast("string"))


def salary_conflicts(rows: DataFrame) -> DataFrame:
    """Months with several base salaries on several pages, among the rows that were kept."""
    known = rows.where("kept AND base_salary IS NOT NULL").withColumn("salary", cents(F.col("base_salary")).cast("string"))
    values = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "salary"))), lambda x: x["salary"]))
    found = known.groupBy("case_id", "competence").agg(values.alias("v"), F.array_sort(F.collect_set("source_page")).alias("p"))
    return found.where("size(v) > 1 AND size(p) > 1").select("case_id", "competence", F.array_join("v", "; ").alias("found_values"), F.array_join("p", ",").alias("source_pages"))
