"""Visual pages: ink of a page's raster, bands and ruled rows, predicates and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import Config


def ink_profile(rows: DataFrame, config: Config) -> DataFrame:
    """``rows`` (case_id, page_number, row_no, pixels: one raster row each) by page: width, height, ink_ratio, bands and ruled.

    A pixel is ink where it is darker than ``ink_relative`` of the page's mean. Bands are stretches of rows with enough ink,
    ruled rows hold an unbroken run of it. A page's rows meet once, by page."""
    page = Window.partitionBy("case_id", "page_number")
    sized = rows.withColumns({"total": F.aggregate("pixels", F.lit(0).cast("bigint"), lambda a, x: a + x), "n": F.size("pixels")})
    sized = sized.withColumn("limit", F.floor(F.sum("total").over(page) / F.sum("n").over(page) * config.ink_relative))
    bits = F.array_join(F.transform("pixels", lambda x: F.when(x < F.col("limit"), "1").otherwise("0")), "")
    part = lambda share: F.greatest(F.lit(2), F.floor(F.col("n") * share).cast("int"))
    marked = sized.withColumn("bits", bits).withColumn("ink", F.length(F.translate("bits", "0", "")))
    marked = marked.withColumn("inked", F.col("ink") >= part(config.least_row_ink)).withColumn("rule", F.contains("bits", F.repeat(F.lit("1"), part(config.least_rule))))
    rising = F.col("inked") & ~F.coalesce(F.lag("inked").over(page.orderBy("row_no")), F.lit(False))
    return marked.withColumn("rising", rising).groupBy("case_id", "page_number").agg(
        F.max("n").alias("width"), F.count("*").alias("height"), (F.sum("ink") / F.sum("n")).alias("ink_ratio"), F.count_if("rising").alias("bands"), F.count_if("rule").alias("ruled"))


def has_ink(config: Config) -> Column:
    return F.col("ink_ratio").between(config.least_ink, config.most_ink)


def is_table(config: Config) -> Column:
    """Bands enough, or some bands and many ruled rows."""
    return (F.col("bands") >= config.least_bands) | ((F.col("ruled") >= config.least_ruled) & (F.col("bands") >= config.least_neighbor_bands))


def score() -> Column:
    return (2 * F.least("bands", F.lit(40)) + F.least("ruled", F.lit(40))).cast("double")


def beside(flag: Column) -> Column:
    """Whether the page right before or after has the flag; page numbers are dense."""
    w = Window.partitionBy("case_id").orderBy("page_number")
    return F.coalesce(F.lag(flag).over(w), F.lit(False)) | F.coalesce(F.lead(flag).over(w), F.lit(False))


def image_cover(page: DataFrame) -> DataFrame:
    """Adds n_images and coverage (0 to 1) of the pages' ``images`` (x0, y0, x1, y1), clipped to ``width`` and ``height``; overlaps count twice."""
    side = lambda a, b, size: F.greatest(F.least(b, F.col(size)) - F.greatest(a, F.lit(0.0)), F.lit(0.0))
    area = F.aggregate("images", F.lit(0.0), lambda s, i: s + side(i["x0"], i["x1"], "width") * side(i["y0"], i["y1"], "height"))
    return page.withColumn("n_images", F.size("images")).withColumn("coverage", F.least(area / F.greatest(F.col("width") * F.col("height"), F.lit(1.0)), F.lit(1.0)))


def little_text(config: Config) -> Column:
    return F.length(F.regexp_replace("text", r"(?U)\s", "")) <= config.most_visual_text


def is_visual(config: Config, few: Column | None = None) -> Column:
    """A page without calculation or primary signals that holds little text (``few``) beside an image, or is covered by images."""
    few = little_text(config) if few is None else few
    return ~F.col("calculation") & ~F.col("primary") & ((few & (F.col("n_images") >= 1)) | (F.col("coverage") >= config.raster_coverage))


def visual_candidates(profile: DataFrame, config: Config) -> DataFrame:
    """Pages that look like tables, ranked, and the pages right beside one with ink and some bands (one step, no chain)."""
    rows = profile.withColumn("inked", has_ink(config)).withColumn("accepted", F.col("inked") & is_table(config))
    near = ~F.col("accepted") & F.col("inked") & beside(F.col("accepted")) & (F.col("bands") >= config.least_neighbor_bands)
    rows = rows.withColumn("neighbor", near).where("accepted OR neighbor").withColumn("score", F.when(F.col("accepted"), score()).otherwise(config.neighbor_score))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "page_number"))).drop("inked")
