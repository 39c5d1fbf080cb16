"""Operator 12: mixing sources to target weights by entropy balancing. DataFrame functions only.

A source's documents get rates of minimal relative entropy to one copy each, under the constraint that the rates times the
documents' words sum to the source's target and none is above ``MOST``: the rates are exp(v * size), cut at ``MOST``, an exponential tilt
with one dual variable v for each source. The dual is convex; all sources take a Newton step at a time, held in a bracket of the signs seen
(a step that leaves it halves it). A rate depends on a document's source and size alone, so the table that the iterations read is the
number of documents by source and size, pre-aggregated once: a source with a third of all rows is as many rows as it has sizes.

Sums are whole numbers (rates in units of 2**-20), so they don't depend on the order of rows, and reruns agree. Rates become copies by
systematic rounding: a source's documents are put in order of size, and each gets the whole numbers that the running sum of rates
passes within it. So every document gets its rate rounded up or down, and a source's words miss its target by no more than about its longest
document. Running sums are taken by (source, size), then by blocks of a hash, then inside a block: no source, size or group of copies is one task's.

Targets: weights repeat over the sources in the order of their code points (null is a source, the last one); the sources share ``share`` of all
words by weight, a target stops at ``MOST`` times its source's words, and what that leaves goes to the others by weight until none is above.

Null and empty texts have no words, rate nothing and are taken 0 times; a source without words has the target 0. Repeated rows are documents of
their own, equal in the order of rounding, so that the copies of equal rows may change places; a null doc_id is as any other. Long texts are
counted whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import written

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Units of a rate, blocks of the documents of one source and size, bounds of the iterations and of the relative error they end at.
UNIT, BLOCKS, STEPS, NEAR = 1 << 20, 1024, 60, 1e-6
#: What separates words.
BLANK, WORD = " \t\n\x0b\x0c\r", r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"
WHOLE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    """The number of words, without a list of them: each word and the blank behind it become one character."""
    return F.coalesce(F.length(F.regexp_replace(F.ltrim(text, F.lit(BLANK)), F.lit(WORD), F.lit("x"))), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from a row for each source with its words. One row a source is put in order here, however many documents there are.

    Sources reach ``most`` times their size by rising size for their weight. The first that does not shares what is left with all behind it."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.array(*map(F.lit, weights))[F.pmod(place, F.lit(len(weights)))].cast("double")
    cap = F.col("source_size") * most
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", cap.cast("double"))
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(behind)
    held = ranked.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    first = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "level"))).over(Window.partitionBy())
    return held.select("source", "source_size", F.coalesce(F.least("cap", first["level"] * F.col("weight")), "cap").alias("target"))


def rate(tilt: Column, most: int = MOST) -> Column:
    """The rate in units. A target that is all a source can give has no tilt: all its documents have the greatest rate."""
    return F.when(tilt.isNull(), F.lit(most * UNIT)).otherwise(F.round(F.exp(F.least(tilt * F.col("size"), F.log(F.lit(float(most))))) * UNIT)).cast("bigint")


def tilts(grouped: DataFrame, goals: DataFrame, most: int = MOST, steps: int = STEPS, near: float = NEAR) -> DataFrame:
    """``goals`` (source_key, source_size, target) with ``tilt``, the dual variable of each source, from ``grouped`` (source_key, size, n).

    The driver sees one number a step: how many sources are not yet near enough."""
    free = F.col("target") < most * F.col("source_size")
    unit = F.col("source_size") / F.col("docs")  # a source's mean size scales its tilt
    counts = grouped.groupBy("source_key").agg(F.sum("n").alias("docs"))
    none = F.lit(None).cast("double")
    state = goals.join(counts, "source_key").select("*", F.when(free, F.log(F.col("target") / F.col("source_size")) / unit).alias("tilt"), none.alias("low"), none.alias("high"), F.lit(False).alias("done"))
    state = written(state, "tilts")
    for _ in range(steps):
        open_ = state.where("tilt IS NOT NULL AND NOT done")
        own = grouped.join(open_.select("source_key", "tilt"), "source_key")
        mass = (F.col("n") * F.col("size")).cast(WHOLE) * rate(F.col("tilt"), most).cast("decimal(18,0)")
        moving = F.col("tilt") * F.col("size") < F.log(F.lit(float(most)))
        sums = own.groupBy("source_key").agg(
            F.sum(mass.cast(WHOLE)).alias("words"),
            F.sum(F.when(moving, (mass * F.col("size").cast("decimal(10,0)")).cast(WHOLE))).alias("slope"),
        )
        joined = state.join(sums, "source_key", "left")
        gap = F.col("words").cast("double") / UNIT - F.col("target")  # the gradient of the dual; its slope is the second moment
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap >= 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap / F.nullif(F.col("slope").cast("double") / UNIT, F.lit(0.0))
        inside = newton.isNotNull() & (low.isNull() | (newton > low)) & (high.isNull() | (newton < high))
        reach = F.greatest(2 * F.abs("tilt"), 1 / unit)
        other = F.when(low.isNull(), high - reach).when(high.isNull(), low + reach).otherwise((low + high) / 2)
        ended = F.abs(gap) <= near * F.col("target")
        live = F.col("words").isNotNull()
        state = written(
            joined.select(
                *goals.columns, "docs",
                F.when(live & ~ended, F.when(inside, newton).otherwise(other)).otherwise(F.col("tilt")).alias("tilt"),
                F.when(live, low).otherwise(F.col("low")).alias("low"), F.when(live, high).otherwise(F.col("high")).alias("high"),
                (F.col("done") | F.coalesce(ended, F.lit(False)) | F.coalesce(low >= high, F.lit(False))).alias("done"),
            ),
            "tilts",
        )
        if state.where("tilt IS NOT NULL AND NOT done").isEmpty():
            break
    return state.drop("low", "high", "done", "docs")


def copies(rows: DataFrame, tilted: DataFrame, grouped: DataFrame, most: int = MOST) -> DataFrame:
    """``rows`` (source_key, size, block, spread, ...) with ``copies``, its documents' rates rounded along the sources' order of size."""
    by_size = Window.partitionBy("source_key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sized = grouped.join(tilted, "source_key").withColumn("rate", F.when(F.col("size") == 0, F.lit(0)).otherwise(rate(F.col("tilt"), most)))
    sized = sized.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(by_size), F.lit(0)))
    by_block = Window.partitionBy("source_key", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("source_key", "size", "block").agg(F.count("*").alias("in_block"))
    placed = blocks.withColumn("rows_before", F.coalesce(F.sum("in_block").over(by_block), F.lit(0))).drop("in_block")
    starts = placed.join(sized.drop("n"), ["source_key", "size"]).withColumn("start", F.col("before") + F.col("rows_before") * F.col("rate")).drop("before", "rows_before", "tilt")
    nth = F.row_number().over(Window.partitionBy("source_key", "size", "block").orderBy("spread", "doc_id"))
    whole = lambda k: F.shiftright(F.col("start") + k * F.col("rate") + UNIT // 2, UNIT.bit_length() - 1)
    return rows.withColumn("nth", nth).join(starts, ["source_key", "size", "block"]).withColumn("copies", whole(F.col("nth")) - whole(F.col("nth") - 1))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each row of ``docs`` (doc_id, text, source)."""
    counted = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sizes = counted.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, weights, share, most)
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("source_key")  # a null source joins as others do
    goals = written(goals.select(key, "source_size", "target"), "targets")
    spread = F.xxhash64(F.col("doc_id").cast("string"))
    rows = counted.select(key, "doc_id", "size", spread.alias("spread"), F.pmod(spread, F.lit(BLOCKS)).cast("int").alias("block"))
    grouped = written(rows.groupBy("source_key", "size").agg(F.count("*").alias("n")), "grouped")
    done = copies(rows, tilts(grouped.where("size > 0"), goals.where("source_size > 0"), most).union(goals.where("source_size = 0").withColumn("tilt", F.lit(0.0))), grouped, most)
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("int").alias("copies"))
