"""Page triage: signals of every page, neighbours of good pages, ranks within a case, candidates and overflow.

All windows are partitioned by case, so pages are shuffled once.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import fold, folded
from . import visual


def _count(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(fold(w))).cast("int") for w in words], F.lit(0))


def toc_hits(toc: DataFrame, config: Config) -> DataFrame:
    title = folded(F.col("title"))
    return toc.where(reduce(or_, [F.contains(title, F.lit(fold(w))) for w in (*config.strong, *config.weak)])).select("case_id", "page_number").distinct()


def toc_titles(toc: DataFrame, order: str = "page_number") -> DataFrame:
    """Each case's titles as a list in page order, every title once a page."""
    listed = F.array_sort(F.collect_list(F.struct("page_number", order, "title")))
    return toc.groupBy("case_id").agg(F.transform(listed, lambda x: x["title"]).alias("titles"))


def read_pages(pages: DataFrame, config: Config) -> DataFrame:
    """A row for each page with what its text says; the text is read here, before any shuffle, and goes no further."""
    words = [F.when(F.contains(F.col("folded"), F.lit(fold(w))), F.lit(w)) for w in (*config.strong, *config.weak)]
    hits = reduce(lambda a, b: a + b, [F.regexp_count("text", F.lit(p)) for p in config.patterns])
    return pages.withColumn("folded", folded(F.col("text"))).select(
        *(c for c in pages.columns if c != "text"),
        _count(F.col("folded"), config.strong).alias("strong"), _count(F.col("folded"), config.weak).alias("weak"),
        F.concat_ws("|", *words).alias("keywords"), hits.alias("patterns"), (_count(F.col("folded"), config.markers) > 0).alias("calculation"),
        F.contains("text", F.lit(config.table_mark)).alias("table_hint"), (F.length("text") / F.lit(config.page_area)).alias("density"),
        visual.little_text(config).alias("little_text"),
    )


def scored(rows: DataFrame, toc: DataFrame, config: Config) -> DataFrame:
    """Numbered rows of ``read_pages`` with primary, score and visual. Pages with ``n_images`` and ``coverage`` can be visual."""
    marked = rows.join(toc_hits(toc, config).withColumn("in_toc", F.lit(True)), ["case_id", "page_number"], "left").withColumn("in_toc", F.coalesce("in_toc", F.lit(False)))
    primary = ~F.col("calculation") & ((F.col("strong") > 0) | (F.col("patterns") >= config.least_patterns) | F.col("in_toc"))
    score = (
        config.strong_score * F.col("strong") + config.weak_score * F.col("weak") + config.pattern_score * F.least("patterns", F.lit(config.most_patterns))
        + config.toc_score * F.col("in_toc").cast("int") + 10.0 * F.col("density")
    )
    rows = marked.withColumn("primary", primary).withColumn("score", score)
    images = {"n_images", "coverage"} <= set(rows.columns)
    seen = F.coalesce(visual.is_visual(config, F.col("little_text")), F.lit(False)) if images else F.lit(False)
    return rows.withColumn("visual", seen).drop("little_text", "n_images", "coverage")


def signals(pages: DataFrame, toc: DataFrame, config: Config) -> DataFrame:
    """``read_pages`` and ``scored`` of pages that have their numbers."""
    return scored(read_pages(pages, config), toc, config)


def page_counts(signals: DataFrame) -> DataFrame:
    """Pages of each case by kind."""
    n = lambda c: F.count_if(F.col(c)).alias(f"{c}_pages")
    return signals.groupBy("case_id").agg(F.count("*").alias("pages"), n("calculation"), n("primary"), n("visual"))


def with_neighbors(signals: DataFrame, config: Config) -> DataFrame:
    """Adds ``neighbor``: pages beside a primary page with a keyword that hold patterns alone; their score is set, not raised. Page numbers are dense."""
    w = Window.partitionBy("case_id").orderBy("page_number")
    anchor = F.col("primary") & (F.col("keywords") != "")
    beside = F.coalesce(F.lag("anchor").over(w), F.lit(False)) | F.coalesce(F.lead("anchor").over(w), F.lit(False))
    rows = signals.withColumn("anchor", anchor).withColumn("neighbor", beside & ~F.col("calculation") & ~F.col("primary") & (F.col("patterns") > 0) & (F.col("keywords") == "") & ~F.col("visual"))
    return rows.withColumn("score", F.when(F.col("neighbor"), config.neighbor_score).otherwise(F.col("score")))


def with_visual(rows: DataFrame, profile: DataFrame, config: Config) -> DataFrame:
    """Adds ``tier`` from the visual pages' ``profile`` (case_id, page_number, ink_ratio, bands, ruled): 0 text, 1 accepted visual pages, 2 visual pages with some bands beside
    one of these or beside a text page with a keyword (one step, no chain), 3 the other visual pages of short cases; null for other pages."""
    case = Window.partitionBy("case_id")
    rows = rows.join(profile.select("case_id", "page_number", "ink_ratio", "bands", "ruled"), ["case_id", "page_number"], "left")
    inked = F.col("visual") & F.coalesce(visual.has_ink(config), F.lit(False))
    rows = rows.withColumn("inked", inked).withColumn("accepted", F.col("inked") & visual.is_table(config))
    rows = rows.withColumn("beside", visual.beside(F.col("accepted") | F.col("anchor")))
    short = F.max("page_number").over(case) <= config.all_visual_up_to
    tier = (
        F.when(F.col("primary") | F.col("neighbor"), 0).when(F.col("accepted"), 1)
        .when(F.col("inked") & F.col("beside") & (F.col("bands") >= config.least_neighbor_bands), 2).when(F.col("visual") & short, 3)
    )
    score = F.when(F.col("tier") == 1, visual.score()).when(F.col("tier") == 2, config.neighbor_score).otherwise(F.col("score"))
    return rows.withColumn("tier", tier).withColumn("score", score).drop("inked", "accepted", "beside", "ink_ratio", "bands", "ruled")


def ranked(rows: DataFrame, config: Config, tables: bool = False, keep_all_up_to: int = 0) -> DataFrame:
    """Candidates and overflow by rank; with ``tables``, the best primary pages with a table move up. Visual pages (``tier`` 1 to 3) stand behind all text pages, so
    they fill the free slots only. In cases of up to ``keep_all_up_to`` pages every page is a candidate, in page order."""
    if "tier" not in rows.columns:
        rows = rows.withColumn("tier", F.when(F.col("primary") | F.col("neighbor"), 0))
    rows = rows.withColumn("whole", F.max("page_number").over(Window.partitionBy("case_id")) <= keep_all_up_to)
    found = rows.where("whole OR tier IS NOT NULL")
    if tables:
        found = found.withColumn("first_rank", F.row_number().over(Window.partitionBy("case_id", "primary").orderBy(F.desc("score"), "page_number")))
        up = F.col("primary") & (F.col("first_rank") <= config.table_checks) & F.col("table_hint")
        found = found.withColumn("score", F.col("score") + F.when(up, config.table_score).otherwise(0.0))
    placed = lambda c: F.when(~F.col("whole"), c)
    order = Window.partitionBy("case_id").orderBy(placed(F.col("tier")), placed(F.when(F.col("tier") < 3, F.col("score"))).desc(), "page_number")
    return found.withColumn("rank", F.row_number().over(order)).withColumn("overflow", ~F.col("whole") & (F.col("rank") > config.candidates))


def triage(signals: DataFrame, config: Config, tables: bool = False, profile: DataFrame | None = None, keep_all_up_to: int = 0) -> DataFrame:
    """Ranked candidates and overflow from the pages' ``signals``; with the raster ``profile`` of visual pages, these too."""
    rows = with_neighbors(signals, config)
    return ranked(rows if profile is None else with_visual(rows, profile, config), config, tables, keep_all_up_to)


def text_only(candidates: DataFrame, read: DataFrame) -> DataFrame:
    """Candidates that are left when pages read elsewhere (case_id, page_number) are taken out."""
    return candidates.join(read.select("case_id", "page_number"), ["case_id", "page_number"], "left_anti")


def all_pages(pages: DataFrame, config: Config) -> DataFrame:
    """Cases of few pages: every page is a candidate, in page order."""
    rows = pages.select("case_id", "page_number", F.max("page_number").over(Window.partitionBy("case_id")).alias("pages"))
    return rows.where((F.col("pages") >= 1) & (F.col("pages") <= config.all_pages_up_to)).select("case_id", "page_number", F.col("page_number").alias("rank"))


def page_ranges(rows: DataFrame) -> DataFrame:
    """Runs of consecutive pages of a case, as first-last."""
    numbered = rows.select("case_id", "page_number").distinct().withColumn("island", F.col("page_number") - F.row_number().over(Window.partitionBy("case_id").orderBy("page_number")))
    runs = numbered.groupBy("case_id", "island").agg(F.min("page_number").alias("first"), F.max("page_number").alias("last"))
    return runs.select("case_id", "first", "last", F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string"))).alias("label"))


def batches(rows: DataFrame, per_call: int, order: str = "page_number") -> DataFrame:
    """Calls of ``per_call`` rows in page order."""
    nth = F.row_number().over(Window.partitionBy("case_id").orderBy(order))
    return rows.withColumn("call", F.floor((nth - 1) / per_call).cast("int"))


def call_counts(candidates: DataFrame, per_call: int) -> DataFrame:
    """Candidates in rank order with the number of calls that were begun up to and with each, and of all the case's calls."""
    sent = candidates.where("NOT overflow")
    all_calls = F.ceil(F.max("rank").over(Window.partitionBy("case_id")) / per_call)
    return sent.select("case_id", "page_number", "rank", F.ceil(F.col("rank") / per_call).alias("calls_so_far"), all_calls.alias("calls"))
