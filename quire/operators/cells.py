"""Cells of a time card: observed schedule, consensus, a second reader's vote, and the rows they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import minutes


def consensus(cells: DataFrame) -> DataFrame:
    """Adds ``agreed``: the first reading, if both others equal it."""
    return cells.withColumn("agreed", F.when((F.col("first_read") == F.col("reread_1")) & (F.col("first_read") == F.col("reread_2")), F.col("first_read")))


def schedule(cells: DataFrame, config: Config) -> DataFrame:
    """case_id, weekday (0: Monday), in_min, out_min: upper medians of first readings, where both slots have enough."""
    at = lambda slot: F.filter(F.sort_array(F.collect_list(F.when(F.col("slot") == slot, minutes(F.col("first_read"))))), lambda m: m.isNotNull())
    rows = cells.groupBy("case_id", F.weekday("day").alias("weekday")).agg(at(0).alias("ins"), at(1).alias("outs")).where((F.size("ins") >= config.least_samples) & (F.size("outs") >= config.least_samples))
    middle = lambda c: F.element_at(c, (F.floor(F.size(c) / 2) + 1).cast("int"))
    return rows.select("case_id", "weekday", middle("ins").alias("in_min"), middle("outs").alias("out_min"))


def with_usual(cells: DataFrame, times: DataFrame) -> DataFrame:
    """Adds ``usual``, the observed minute of the cell's weekday and slot; null without a schedule."""
    rows = cells.withColumn("weekday", F.weekday("day")).join(times, ["case_id", "weekday"], "left")
    return rows.withColumn("usual", F.when(F.col("slot") == 0, F.col("in_min")).otherwise(F.col("out_min")))


def plausible(reading: str, config: Config, require_schedule: bool) -> Column:
    """Whether a reading is near the usual minute; without a schedule, whether none is required. False for a null reading."""
    near = F.abs(minutes(F.col(reading)) - F.col("usual")) <= config.tolerance
    return F.col(reading).isNotNull() & F.coalesce(near, F.lit(not require_schedule))


def resolved(cells: DataFrame, times: DataFrame, config: Config) -> DataFrame:
    """Adds ``value`` and ``source``. The consensus counts near the schedule, or where there is none; a model
    that reads something else then sends the cell to review, and fills a cell without consensus only near a known schedule."""
    rows = with_usual(consensus(cells), times).withColumn("local", plausible("agreed", config, False))
    rows = rows.withColumn("vetoed", F.col("local") & (F.col("model_read") != F.col("agreed")))
    model = ~F.col("local") & plausible("model_read", config, True)
    return rows.withColumns({
        "source": F.when(F.col("local") & ~F.coalesce("vetoed", F.lit(False)), "local").when(model, "model"),
        "value": F.when(F.col("local") & ~F.coalesce("vetoed", F.lit(False)), F.col("agreed")).when(model, F.col("model_read")),
    })


def strips(cells: DataFrame, config: Config, seed: int = 0) -> DataFrame:
    """Columns (case, slot) with an open cell as strips: rows in a seeded order, strips in calls."""
    column = Window.partitionBy("case_id", "slot")
    rows = cells.withColumn("open", F.max(F.col("value").isNull()).over(column)).where("open").drop("open")
    rows = rows.withColumn("row_pos", F.row_number().over(column.orderBy(F.md5(F.concat_ws("-", F.lit(seed).cast("string"), F.col("cell_id").cast("string"))))))
    strip = rows.select("case_id", "slot").distinct().withColumn("call", F.floor((F.row_number().over(Window.partitionBy("case_id").orderBy("slot")) - 1) / config.strips_per_call).cast("int"))
    return rows.join(strip, ["case_id", "slot"])


def entries(cells: DataFrame, config: Config) -> DataFrame:
    """One row for each work day: its two times, flags of cells without a value, and the confidence of its worst source."""
    pick = lambda slot: F.max(F.when(F.col("slot") == slot, F.col("value")))
    open_ = lambda slot: F.max((F.col("slot") == slot) & F.col("value").isNull())
    rows = cells.groupBy("case_id", "day").agg(pick(0).alias("clock_in"), pick(1).alias("clock_out"), open_(0).alias("no_in"), open_(1).alias("no_out"), F.max(F.coalesce(F.col("source") == "model", F.lit(False))).alias("by_model"))
    flags = F.array_join(F.array_compact(F.array(F.when(F.col("no_in"), "clock_in"), F.when(F.col("no_out"), "clock_out"))), ",")
    level = F.when(F.col("no_in") | F.col("no_out"), config.confidence_pending).when(F.col("by_model"), config.confidence_model).otherwise(config.confidence_local)
    return rows.select("case_id", "day", "clock_in", "clock_out", flags.alias("ambiguous"), level.alias("confidence"))


def outcomes(cells: DataFrame, truth: str) -> DataFrame:
    """Cells that are right, to review, or wrong without a sign, by source."""
    return cells.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count_if(F.col("value") == F.col(truth)).alias("correct"), F.count_if(F.col("value").isNull()).alias("review"), F.count_if(F.col("value") != F.col(truth)).alias("silent_errors"))



def schedule_cells(cells: DataFrame) -> DataFrame:
    """The cells that a case's schedule is observed from: those of pages with confirmed dates, or all where no page has."""
    any_confirmed = F.max(F.col("confirmed")).over(Window.partitionBy("case_id"))
    return cells.withColumn("any_confirmed", any_confirmed).where("confirmed OR NOT any_confirmed").drop("any_confirmed")


def physical_column(entry_x: Column, exit_x: Column) -> Column:
    """0 or 1: the column that a cell's place is nearest to (the entry's where both are as near), whatever its slot."""
    return (F.abs(F.col("x") - exit_x) < F.abs(F.col("x") - entry_x)).cast("int")


def column_strips(cells: DataFrame, passes: Column, config: Config, seed: int = 0) -> DataFrame:
    """Cells that ``passes`` lets through, as strips: one for each column of a page with an open cell, rows in a seeded order, strips in calls.

    ``cells`` have entry_x and exit_x of their page; settled cells of a strip are context, and answers for them don't count."""
    rows = cells.where(passes).withColumn("column", physical_column(F.col("entry_x"), F.col("exit_x")))
    column = Window.partitionBy("case_id", "page_number", "column")
    rows = rows.withColumn("open", F.max(F.col("value").isNull()).over(column)).where("open").drop("open")
    mixed = F.md5(F.concat_ws("-", F.lit(seed).cast("string"), F.col("cell_id").cast("string")))
    rows = rows.withColumn("row_pos", F.row_number().over(column.orderBy(mixed)))
    strip = F.dense_rank().over(Window.partitionBy("case_id").orderBy("page_number", "column"))
    return rows.withColumn("strip_no", strip).withColumn("call", F.floor((F.col("strip_no") - 1) / config.strips_per_call).cast("int"))


def has_letters(text: Column) -> Column:
    """Three letters in a row: a word. A blurred digit reads as one or two."""
    return text.rlike(r"[A-Za-zÀ-ú]{3,}")


def ink_ratio(pixels: Column, below: int = 128) -> Column:
    return F.size(F.filter(pixels, lambda x: x < below)) / F.greatest(F.size(pixels), F.lit(1))


def time_card_entries(cells: DataFrame, unread: DataFrame, config: Config, work_days: DataFrame | None = None) -> DataFrame:
    """A row for each page and day: ``cells`` (case_id, page_number, day, slot, cell_id, value, source, single_mark, confirmed) as one entry, and ``unread`` days (with confirmed) as empty ones.

    Of ``work_days`` (case_id, page_number, day, confirmed) each has an entry, also one without a cell: it has no times, nothing of it is open, and no reading is doubtful.

    An entry has its times, its month, the fields to check (the date first, where the page's dates are not confirmed; both times for a lone mark
    without a value), the confidence of its worst source, and the cells to show by field."""
    name = F.when(F.col("slot") == 0, "clock_in").otherwise("clock_out")
    pending = F.when(F.col("confirmed"), F.array().cast("array<string>")).otherwise(F.array(F.lit("date")))
    open_ = F.when(F.col("value").isNotNull(), F.array().cast("array<string>")).when(F.col("single_mark"), F.array(F.lit("clock_in"), F.lit("clock_out"))).otherwise(F.array(name))
    shown = F.when(F.coalesce(F.col("source"), F.lit("")) != "local", F.struct(F.when(F.col("single_mark") & F.col("value").isNull(), "clock_in").otherwise(name).alias("field"), F.col("cell_id").alias("cell")))
    rows = cells.select("case_id", "page_number", "day", "slot", "cell_id", "value", "source", pending.alias("pending"), open_.alias("open"), shown.alias("shown"))
    if work_days is not None:  # rows without a cell, aggregated with the others: no join
        rows = rows.unionByName(work_days.select("case_id", "page_number", "day", pending.alias("pending"), F.array().cast("array<string>").alias("open")), allowMissingColumns=True)
    pick = lambda slot: F.max_by("value", F.when((F.col("slot") == slot) & F.col("value").isNotNull(), F.col("cell_id")))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("slot", "cell_id", c))), lambda x: x[c])
    shown_last = F.aggregate(F.array_compact(in_order("shown")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")),
                             lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["field"]), F.map_from_arrays(F.array(x["field"]), F.array(x["cell"].cast("bigint")))))
    level = F.when(F.max(F.col("slot").isNotNull() & F.col("source").isNull()), config.confidence_pending).when(F.max(F.col("source") == "model"), config.confidence_model).otherwise(config.confidence_local)
    read = rows.groupBy("case_id", "page_number", "day").agg(
        pick(0).alias("clock_in"), pick(1).alias("clock_out"), F.concat(F.first("pending"), F.array_distinct(F.flatten(in_order("open")))).alias("ambiguous"),
        level.alias("confidence"), shown_last.alias("review_cells"))
    none = F.lit(None).cast("string")
    both = F.array(F.lit("clock_in"), F.lit("clock_out"))
    empty = unread.select(
        "case_id", "page_number", "day", none.alias("clock_in"), none.alias("clock_out"), F.concat(pending, both).alias("ambiguous"), F.lit(0.0).alias("confidence"),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")).alias("review_cells"))
    return read.unionByName(empty).withColumn("competence", F.date_format("day", "yyyy-MM"))


def review_cell(field: str) -> Column:
    """The cell to show for a field of an entry, or null."""
    return F.try_element_at("review_cells", F.lit(field))


def cell_summary(pages: DataFrame, cells: DataFrame, unread: DataFrame) -> DataFrame:
    """Eight counters of a case's local reading; ``pages`` (case_id, page_number, recognized, confirmed)."""
    a = pages.groupBy("case_id").agg(
        F.count_if("recognized").alias("pages"), F.count_if(~F.col("recognized")).alias("unrecognized"), F.count_if(F.col("recognized") & ~F.col("confirmed")).alias("dates_unconfirmed"))
    b = cells.groupBy("case_id").agg(
        F.count("*").alias("cells"), F.count_if(F.col("source") == "local").alias("local"), F.count_if(F.col("source") == "model").alias("model"), F.count_if(F.col("value").isNull()).alias("review"))
    c = unread.groupBy("case_id").agg(F.count("*").alias("unread_days"))
    names = ("pages", "unrecognized", "dates_unconfirmed", "cells", "local", "model", "review", "unread_days")
    return a.join(b, "case_id", "left").join(c, "case_id", "left").select("case_id", *(F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names))


def strategies(expected: DataFrame, cells: DataFrame, config: Config) -> DataFrame:
    """How often each way to settle cells is right, leaves a cell to review, or is wrong without a sign: ``expected`` (case_id, day, slot, want) against the first cell of each place.

    ``cells`` are resolved (usual, agreed, local, value). A place without a cell is one to review, for every way."""
    first = cells.withColumn("nth", F.row_number().over(Window.partitionBy("case_id", "day", "slot").orderBy("cell_id"))).where("nth = 1")
    ways = F.array(
        F.struct(F.lit("first_reading").alias("strategy"), F.when(plausible("first_read", config, False), F.col("first_read")).alias("got")),
        F.struct(F.lit("consensus").alias("strategy"), F.when(F.col("local"), F.col("agreed")).alias("got")),
        F.struct(F.lit("with_model").alias("strategy"), F.col("value").alias("got")),
    )
    rows = expected.join(first, ["case_id", "day", "slot"], "left").select("want", F.inline(ways))
    right, review = F.col("got") == F.col("want"), F.col("got").isNull()
    return rows.groupBy("strategy").agg(F.count_if(right).alias("correct"), F.count_if(review).alias("review"), F.count_if(F.col("got") != F.col("want")).alias("silent_errors"))
