"""Connected components of a graph of written edges, by rounds of smallest-neighbour links and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, salted_join, written


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``edges`` (a, b: bigint).

    A round links every node's neighbours and itself to the smallest of them (the star contractions of
    Kiveris et al. 2014, large and small); each is written, so the lineage is cut. Sums by node are
    pre-aggregated, no node's neighbours are gathered as a list, and those of a hot node are dealt over many tasks. Rounds grow with the logarithm of
    the longest path; only a count and a checksum of the edges go to the driver. An empty table has no nodes."""

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    def star(e: DataFrame, large: bool, few: bool) -> DataFrame:
        rows = both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = rows.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        linked = rows.join(least, "a") if few else salted_join(rows, least := written(least, "least"), ["a"], ["b"])
        if large:
            out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where(F.col("a") != F.col("b")).distinct()

    now = written(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    was = None
    while (is_now := mark(now)) != was:
        was = is_now
        few = 2 * is_now[0] <= 10 * HOT_ROWS  # a task holds a star of so many rows
        now = written(star(star(now, True, few), False, few), "edges")
    stars = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
