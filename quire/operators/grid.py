"""Dates of table rows: printed periods, weekdays, votes on the start, and days that were not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import WEEKDAYS

PERIOD = r"(\d{2})/(\d{2})/(\d{4})\s*[àaÀ]\s*(\d{2})/(\d{2})/(\d{4})"


def period(text: Column) -> Column:
    """Struct of start, end and whether the end was printed plausibly (6 to 62 days on); else a month less a day, or 30 days for starts after the 28th."""
    part = lambda a: F.try_to_date(F.concat_ws("/", *(F.regexp_extract(text, PERIOD, k) for k in (a, a + 1, a + 2))), "dd/MM/yyyy")
    start, end = part(1), part(4)
    plausible = F.coalesce(F.datediff(end, start).between(6, 62), F.lit(False))
    monthly = F.when(F.dayofmonth(start) > 28, F.date_add(start, 30)).otherwise(F.date_sub(F.add_months(start, 1), 1))
    return F.when(start.isNotNull(), F.struct(start.alias("start"), F.when(plausible, end).otherwise(monthly).alias("end"), plausible.alias("printed")))


def synced_dates(rows: DataFrame) -> DataFrame:
    """``rows`` (case_id, pos, weekday 0-6, start): each row's date is the next one with its weekday, by running sums of gaps."""
    w = Window.partitionBy("case_id").orderBy("pos")
    before = F.lag("weekday").over(w)
    gap = F.when(before.isNull(), F.pmod(F.col("weekday") - F.weekday("start"), F.lit(7))).otherwise(1 + F.pmod(F.col("weekday") - before - 1, F.lit(7)))
    return rows.withColumn("gap", gap).withColumn("date", F.date_add("start", F.sum("gap").over(w).cast("int"))).drop("gap")


def start_vote(rows: DataFrame, least: int = 5, share: float = 0.8) -> DataFrame:
    """``rows`` (case_id, pos, read_date): the start most rows agree on (date less position), if enough do; ties to the first seen, then to the later start."""
    votes = rows.groupBy("case_id", F.date_sub("read_date", F.col("pos").cast("int")).alias("start")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = votes.groupBy("case_id").agg(F.sum("n").alias("n_rows"), F.max_by(F.struct("start", "n"), F.struct(F.col("n"), -F.col("first"), "start")).alias("best"))
    return best.where(F.col("best.n") >= F.greatest(F.lit(least), share * F.col("n_rows"))).select("case_id", "best.start", F.col("best.n").alias("votes"), "n_rows")


def month_shift(rows: DataFrame, reach: int = 15) -> DataFrame:
    """``rows`` (case_id, date, printed_month): by how many days dates must move for most months to agree; the smallest move wins ties."""
    shifted = rows.withColumn("shift", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    counted = shifted.groupBy("case_id", "shift").agg(F.count_if(F.month(F.date_add("date", F.col("shift"))) == F.col("printed_month")).alias("agree"))
    return counted.groupBy("case_id").agg(F.max_by("shift", F.struct(F.col("agree"), -F.abs("shift"), -F.col("shift"))).alias("best_shift"), F.max("agree").alias("agree"))


def unread_days(rows: DataFrame) -> DataFrame:
    """Days between a case's first and last row that no row has."""
    ends = rows.groupBy("case_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return ends.select("case_id", F.explode(F.sequence("a", "b")).alias("day")).join(rows.select("case_id", "day").distinct(), ["case_id", "day"], "left_anti")


def nearest_words(words: DataFrame, columns: DataFrame, share: float = 0.5) -> DataFrame:
    """For each column (case_id, line, slot, x, width) the word of its line whose place is nearest and within ``share`` of the width."""
    near = words.join(columns.withColumnRenamed("x", "column_x"), ["case_id", "line"]).withColumn("away", F.abs(F.col("x") - F.col("column_x"))).where(F.col("away") <= share * F.col("width"))
    return near.groupBy("case_id", "line", "slot").agg(F.min_by("text", F.struct("away", "pos")).alias("text"), F.min("away").alias("away"))


def weekday_number(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, WEEKDAYS)), name).cast("int") - 1
