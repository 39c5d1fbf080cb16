"""Inputs of the engine derived from the driver's tables; every input has its case and its order as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import WEEKDAYS

EVENT_PAGES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_out(scan: DataFrame, key: str) -> DataFrame:
    """``scan``, a table as it is read, dealt out by ``key`` where it comes in fewer parts than there are cores, so that work on its texts isn't one task's. Larger tables stay as they are read."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan


#: Documents of a source that make one case, so that cases grow in number, not in size.
CASE_DOCS, CASE_ITEMS = 1_000, 5


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, doc_id, text: pages in the order of doc_id, not yet numbered."""
    docs = spread_out(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    case = F.concat_ws("/", "source", F.floor(F.col("doc_id") / CASE_DOCS).cast("string"))
    return docs.select(case.alias("case_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def numbered(pages: DataFrame) -> DataFrame:
    """Adds page_number, dense from 1 in each case. Rows are shuffled here, so texts must be read before."""
    return pages.withColumn("page_number", F.row_number().over(Window.partitionBy("case_id").orderBy("doc_id")))


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, page_number, title, item_id: every third page of a case may have a title."""
    items, of_source = table(spark, sf_dir, "benchmark"), F.floor(F.col("item_id") / 20)
    case = F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"), F.lit("/"), F.floor(of_source / CASE_ITEMS).cast("string"))
    return items.select(case.alias("case_id"), (of_source % CASE_ITEMS * 3 + 1).cast("int").alias("page_number"), F.col("text").alias("title"), "item_id")


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, page_number, row_no, pixels, doc_id: 20 vectors are the rows of a page, some of them blank; in every third page the dark pixels of a row lie together. They belong to every third document."""
    k, page = F.col("vec_id"), F.floor(F.col("vec_id") / 20)
    values = F.when(page % 3 == 0, F.array_sort("embedding")).otherwise(F.col("embedding"))
    pixels = F.when(k % (2 + page % 4) == 0, F.transform(values, lambda x: F.lit(255).cast("bigint"))).otherwise(F.transform(values, lambda x: F.floor(128 + 256 * x.cast("double"))))
    return table(spark, sf_dir, "embeddings").select(F.floor(page / 10).alias("case_id"), (page % 10 + 1).alias("page_number"), (k % 20).alias("row_no"), pixels.alias("pixels"), (page * 3 + 2).alias("doc_id"))


def time_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw row for each user, day and kind of event, with some dates and times in other shapes."""
    events = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for pair in EVENT_PAGES.items() for x in pair])
    day = F.date_format("ts", "yyyy-MM-dd")
    hours = lambda x: F.format_string("%02d", (F.floor(F.col(x) / 6) * 6).cast("int"))
    rows = events.groupBy(F.col("user_id").alias("case_id"), day.alias("day"), kind[F.col("event_type")].alias("source_page")).agg(
        F.min(F.hour("ts")).alias("first"), F.max(F.hour("ts")).alias("last"), F.count("*").alias("n"), F.min("event_id").alias("k"), F.min("value").alias("v"))
    d = F.to_date("day")
    shaped = rows.select(
        "case_id", "day", "source_page", "k",
        F.when(F.col("k") % 11 == 0, F.date_format(d, "d/M/yyyy")).when(F.col("k") % 23 == 0, F.concat("day", F.lit("x"))).otherwise(F.col("day")).alias("date_raw"),
        F.when(F.col("k") % 13 == 0, "25:00").when(F.col("k") % 7 == 0, F.concat(hours("first"), F.lit("h05"))).otherwise(F.concat(hours("first"), F.lit(":05"))).alias("clock_in"),
        F.when(F.col("n") > 1, F.concat(hours("first"), F.lit(":40"))).alias("break_start"),
        F.when((F.col("n") > 1) & (F.col("k") % 5 != 0), F.concat(hours("last"), F.lit(":50"))).alias("break_end"),
        F.when(F.col("k") % 9 != 0, F.concat(hours("last"), F.lit(":55"))).alias("clock_out"),
        (F.floor(F.col("v") * 100) % 100 / 100.0).alias("confidence"),
    )
    return shaped.withColumn("row_no", F.row_number().over(Window.partitionBy("case_id").orderBy("day", "source_page"))).drop("day")


def payslips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw row for each line item: month, label with noise, amount, base salary and page."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    label = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(" "), F.lower("p_type"))).when(F.col("l_linenumber") % 3 == 1, F.initcap("p_type")).otherwise(F.col("p_type"))
    order = Window.partitionBy("case_id").orderBy("competence", "l_orderkey", "l_linenumber", "l_partkey", "amount")
    return (
        lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
        .select(
            F.col("l_suppkey").alias("case_id"), F.when(F.col("l_orderkey") % 4 == 0, F.date_format("l_shipdate", "M/yyyy")).otherwise(F.date_format("l_shipdate", "yyyy-MM")).alias("competence"),
            label.alias("item_name"), F.col("l_extendedprice").alias("amount"), F.when(F.col("l_partkey") % 4 == 0, 1000.0 + F.col("l_partkey") % 3).alias("base_salary"),
            F.col("l_linenumber").alias("source_page"), (1 - F.col("l_discount")).cast("decimal(4,2)").alias("confidence"), "l_orderkey", "l_linenumber", "l_partkey",
        )
        .withColumn("row_no", F.row_number().over(order))
        .select("case_id", "row_no", "competence", "item_name", "amount", "base_salary", "source_page", "confidence")
    )


#: Place of the two columns of a page and usual size of a cell.
ENTRY_X, EXIT_X, CELL = 412, 538, (84, 23)


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a time card, per user, day and slot (0: entry, 1: exit): first reading, two further readings and a model's; page (a month), place, size, ink and letters."""
    events = table(spark, sf_dir, "events")
    slot = F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0)
    rows = events.groupBy(F.col("user_id").alias("case_id"), F.to_date("ts").alias("day"), slot.alias("slot")).agg(F.min(F.hour("ts")).alias("h"), F.min("event_id").alias("k"))
    at = lambda shift: F.format_string("%02d:%02d", ((F.col("h") + shift) % 24).cast("int"), (F.col("k") % 60).cast("int"))
    k, single = F.col("k"), F.col("k") % 9 == 0
    return rows.select(
        "case_id", "day", "slot", k.alias("cell_id"), at(F.lit(0)).alias("first_read"),
        F.when(k % 6 == 0, at(F.lit(1))).otherwise(at(F.lit(0))).alias("reread_1"), F.when(k % 10 != 0, at(F.lit(0))).alias("reread_2"),
        F.when(k % 4 == 0, at(F.lit(1))).when(k % 4 != 3, at(F.lit(0))).alias("model_read"),
        F.month("day").alias("page_number"), ((F.col("case_id") + F.month("day")) % 3 != 0).alias("confirmed"), single.alias("single_mark"),
        (F.when((F.col("slot") == 0) | single, ENTRY_X).otherwise(EXIT_X) + k % 5 - 2).alias("x"), (CELL[0] - k % 24).alias("w"), F.lit(CELL[1]).alias("h"),
        (k % 12 / 100.0).alias("ink_ratio"), (k % 17 == 0).alias("has_letters"), F.lit(CELL[0]).alias("column_width"), F.lit(CELL[1]).alias("column_height"),
        F.lit(ENTRY_X).alias("entry_x"), F.lit(EXIT_X).alias("exit_x"),
    )


#: First line of a printed day, and the space between days.
SHEET_TOP, SHEET_STEP = 260, 34


def sheet_columns(case_id):
    """Where a case's sheets have their entries and exits, and how wide and high a time is printed: every case its own layout."""
    entry, width = 315 + 12 * (case_id % 4), 70 + 3 * (case_id % 3)
    return entry, entry + width + 45, width, 19 + case_id % 3


def sheets(spark: SparkSession, sf_dir: str, bare: bool = False) -> DataFrame:
    """case_id, page_number, tsv: a printed month of each user, as optical recognition's tab-separated words.

    A day has its first and last event; one event is a lone mark, some rows have both times in one word
    or no entry. A third of the users has no rows of Wednesdays; some headers have a wrong year or start.
    With ``bare``, every third lone mark is printed without its time."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.to_date("ts").alias("day"), F.date_format("ts", "HH:mm").alias("t"), "event_id")
    days = events.groupBy("case_id", "day").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"), F.min("event_id").alias("k"))
    months = days.groupBy("case_id", F.trunc("day", "month").alias("month")).agg(F.map_from_entries(F.collect_list(F.struct(F.dayofmonth("day"), F.struct("a", "b", "n", "k")))).alias("known"))
    few, wrong_start = F.col("case_id") % 3 == 1, (F.col("case_id") % 5 == 3) & (F.col("case_id") % 3 != 1)
    rows = months.withColumn("page_number", F.row_number().over(Window.partitionBy("case_id").orderBy("month"))).withColumn("day", F.explode(F.sequence("month", F.last_day("month")))).where(~(few & (F.weekday("day") == 2)))
    e, y = F.col("known")[F.dayofmonth("day")], SHEET_TOP + SHEET_STEP * F.dayofmonth("day")
    entry, leave, width, height = sheet_columns(F.col("case_id"))
    as_column = lambda v: v if hasattr(v, "alias") else F.lit(v)
    word = lambda y, x, w, text: F.struct(*(c.cast(t).alias(n) for c, t, n in zip(map(as_column, (x, y, w, text)), ("bigint", "bigint", "bigint", "string"), ("x", "y", "w", "text"))))
    start = [word(y, 60, 120, F.date_format("day", "dd/MM/yyyy")), word(y, 210, 40, F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday("day") + 1))]
    cells = (
        F.when(e.isNull(), F.array(word(y, entry, 2 * width, "DESCANSO")))
        .when(F.lit(bare) & (e["n"] == 1) & (e["k"] % 3 == 0), F.array(word(y, leave + width + 20, 2 * width + 30, "Esquecimento")))
        .when(e["n"] == 1, F.array(word(y, entry + 2, width - 4, e["a"]), word(y, leave + width + 20, 2 * width + 30, "Esquecimento")))
        .when(e["k"] % 7 == 0, F.array(word(y, entry - 5, 2 * width + 25, F.concat(e["a"], F.lit("."), e["b"]))))
        .when(e["k"] % 7 == 1, F.array(word(y, leave, width, e["b"])))
        .otherwise(F.array(word(y, entry, width, e["a"]), word(y, leave, width, e["b"])))
    )
    body = rows.groupBy("case_id", "page_number", "month").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("day", F.concat(F.array(*start), cells).alias("ws")))), lambda r: r["ws"])).alias("ws"))
    year = F.when(F.col("case_id") % 5 == 2, F.add_months("month", -12)).otherwise(F.col("month"))
    br = lambda d: F.date_format(d, "dd/MM/yyyy")
    head = F.array(word(110, 60, 90, "Período"), word(110, 170, 110, br(F.when(wrong_start, F.date_add("month", 10)).otherwise(year))), word(110, 300, 16, "à"), word(110, 340, 110, br(F.last_day(year))))
    all_words = F.concat(head, F.col("ws"), F.array(word(1500, 60, 70, "Saldo"), word(1500, 150, 60, "mensal")))
    line = lambda w: F.concat_ws("\t", F.lit("5\t1\t1\t1"), w["y"], F.lit(1), w["x"], w["y"], w["w"], height, F.lit(90), w["text"])
    top = F.lit("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n")
    return body.select("case_id", "page_number", F.concat(top, F.array_join(F.transform(all_words, line), "\n")).alias("tsv"))
