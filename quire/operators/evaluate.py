"""Scores against ground truth: recall, precision and grouped totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import cents, normalized_date, normalized_month, normalized_time
from ..sources.files import TRUTH, kept
from .answers import TYPES
from .records import TIMES

#: The type of a page that ground truth doesn't list.
IRRELEVANT = TYPES[2]


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 4)


def page_scores(truth: DataFrame, sent: DataFrame) -> DataFrame:
    """``truth`` (case_id, page_number), ``sent`` with ``overflow``: recall and precision of what was sent per case."""
    both = truth.withColumn("t", F.lit(1)).join(sent.select("case_id", "page_number", "overflow"), ["case_id", "page_number"], "full")
    n = lambda c: F.count_if(c)
    is_sent = F.coalesce(~F.col("overflow"), F.lit(False))
    counts = both.groupBy("case_id").agg(n(F.col("t").isNotNull()).alias("relevant"), n(is_sent).alias("sent"), n(F.col("t").isNotNull() & is_sent).alias("hit"), n(F.col("t").isNotNull() & F.coalesce("overflow", F.lit(False))).alias("in_overflow"))
    return counts.withColumns({"recall": ratio(F.col("hit"), F.col("relevant")), "precision": ratio(F.col("hit"), F.col("sent"))})


def class_scores(truth: DataFrame, classified: DataFrame) -> DataFrame:
    """``truth`` (case_id, page_number, document_type) of the relevant pages, others being irrelevant, against classified pages: accuracy, and relevant pages not recognised."""
    both = truth.withColumnRenamed("document_type", "want").join(classified.select("case_id", "page_number", F.col("document_type").alias("got")), ["case_id", "page_number"], "full")
    right = F.coalesce(F.col("got") == F.coalesce("want", F.lit(IRRELEVANT)), F.lit(False))
    counts = both.groupBy("case_id").agg(F.count("got").alias("classified"), F.count_if(right).alias("correct"), F.count_if(F.col("want").isNotNull() & ~right).alias("relevant_missed"))
    return counts.withColumn("accuracy", ratio(F.col("correct"), F.col("classified")))


def model_scores(calls: DataFrame, group: list[str]) -> DataFrame:
    """``calls`` (latency, null if the call failed; tokens_in, tokens_out, ok, total) by model: whole tokens an answer, mean and greatest latency, per cent of fields right."""
    answered, latency = F.greatest(F.count("latency"), F.lit(1)), F.col("latency").cast("decimal(18,2)")
    return calls.groupBy(*group).agg(
        F.count("*").alias("calls"), F.count_if(F.col("latency").isNull()).alias("failures"), ratio(F.sum(latency), answered).alias("mean_latency"), F.max("latency").alias("most_latency"),
        *(F.floor(F.coalesce(F.sum(F.when(F.col("latency").isNotNull(), F.col(c))), F.lit(0)) / answered).cast("bigint").alias(f"{c}_each") for c in ("tokens_in", "tokens_out")),
        F.round(F.try_divide(100.0 * F.sum("ok"), F.sum("total")), 2).alias("percent"))


def day_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """``truth`` (case_id, date, times) against validated rows; of several predictions for a day the first counts.

    Days found and invented, and of the four times of each day how many are right, empty, wrong, or wrong on a day whose date is to be confirmed."""
    first = predicted.where("date IS NOT NULL").withColumn("nth", F.row_number().over(Window.partitionBy("case_id", "date").orderBy("row_no"))).where("nth = 1")
    got = first.select("case_id", "date", *(F.col(t).alias(f"got_{t}") for t in TIMES), F.array_contains("ambiguous", "date").alias("pending"), F.lit(1).alias("found"))
    fields = F.explode(F.array(*[F.struct(F.lit(t).alias("name"), F.col(t).alias("want"), F.col(f"got_{t}").alias("got")) for t in TIMES]))
    rows = truth.join(got, ["case_id", "date"], "left").withColumn("f", fields)
    want, have = F.col("f.want"), F.col("f.got")
    counts = rows.groupBy("case_id").agg(
        F.count("*").alias("fields"), F.count_if(want.eqNullSafe(have)).alias("correct"), F.count_if(want.isNull() & have.isNotNull()).alias("invented"), F.count_if(want.isNotNull()).alias("marks"),
        F.count_if(want.isNotNull() & have.isNull()).alias("empty"), F.count_if((want != have) & ~F.col("pending")).alias("wrong"), F.count_if((want != have) & F.col("pending")).alias("date_pending"), (F.count_if(F.col("found") == 1) / 4).cast("bigint").alias("found_days"),
        F.count_distinct("date").alias("expected_days"), *(F.count_if((F.col("f.name") == t) & want.eqNullSafe(have)).alias(f"right_{t}") for t in TIMES), *(F.count_if(F.col("f.name") == t).alias(f"all_{t}") for t in TIMES))
    extra = got.join(truth.select("case_id", "date").distinct(), ["case_id", "date"], "left_anti").groupBy("case_id").agg(F.count("*").alias("extra_days"))
    pending = got.groupBy("case_id").agg(F.count_if("pending").alias("unconfirmed_days"))
    shares = {f"accuracy_{t}": ratio(F.col(f"right_{t}"), F.col(f"all_{t}")) for t in TIMES}
    both = counts.join(extra, "case_id", "left").join(pending, "case_id", "left")
    none = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("extra_days", "unconfirmed_days")}
    whole = {"day_recall": ratio(F.col("found_days"), F.col("expected_days")), "accuracy": ratio(F.col("correct"), F.col("fields"))}
    return both.withColumns({**none, **whole, **shares}).drop(*(f"{a}_{t}" for a in ("right", "all") for t in TIMES))


def item_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Pay items (case_id, competence, amount, label_key, row_no) matched one to one by month and exact cents, in row order."""
    def numbered(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.select("case_id", "competence", cents(F.col("amount")).alias("cents"), F.col("label_key").alias(name), "row_no")
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy("case_id", "competence", "cents").orderBy("row_no"))).drop("row_no")

    both = numbered(truth, "want").join(numbered(predicted, "got"), ["case_id", "competence", "cents", "nth"], "full")
    counts = both.groupBy("case_id").agg(F.count("want").alias("expected"), F.count("got").alias("predicted"), F.count_if(F.col("want").isNotNull() & F.col("got").isNotNull()).alias("matched"), F.count_if(F.col("want") == F.col("got")).alias("named"))
    return counts.withColumns({"recall": ratio(F.col("matched"), F.col("expected")), "precision": ratio(F.col("matched"), F.col("predicted"))})


def greedy_matches(truth: DataFrame, predicted: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Rows of truth with the prediction each takes: in row order the first unused one of its month within ``tolerance``; null amounts match nothing.

    Amounts of a month that lie further apart than ``tolerance`` cannot compete, so a month is cut at such gaps into runs. A run whose amounts are
    all within reach of each other matches by place. The others are settled in rounds (``_rounds``); a row takes part as long as it has an
    unused candidate."""
    columns, month = ["case_id", "competence", "row_no", "amount"], ["case_id", "competence"]
    by_amount, run = Window.partitionBy(*month).orderBy("amount"), Window.partitionBy(*month, "run")
    rows = truth.select(*columns, F.lit(True).alias("given")).union(predicted.select(*columns, F.lit(False).alias("given"))).where("amount IS NOT NULL")
    gap = F.coalesce((F.col("amount") - F.lag("amount").over(by_amount) > tolerance).cast("int"), F.lit(0))
    rows = rows.withColumn("gap", gap).withColumn("run", F.sum("gap").over(by_amount)).drop("gap")
    span = F.max("amount").over(run) - F.min("amount").over(run)
    rows = rows.withColumns({"near": span <= tolerance, "both": F.count_if("given").over(run) * F.count_if(~F.col("given")).over(run) > 0}).where("both").drop("both")
    placed = rows.where("near").withColumn("nth", F.row_number().over(Window.partitionBy(*month, "run", "given").orderBy("row_no")))
    side = lambda given: F.max(F.when(F.col("given") == given, F.col("row_no")))
    by_place = placed.groupBy(*month, "run", "nth").agg(side(True).alias("row_no"), side(False).alias("taken")).where("row_no IS NOT NULL AND taken IS NOT NULL").select(*month, "row_no", "taken")
    return by_place.union(_rounds(kept(rows.where("NOT near").select(*columns, "given"), "unsettled"), tolerance))


def _rounds(free: DataFrame, tolerance: float) -> DataFrame:
    """``greedy_matches`` of rows (case_id, competence, row_no, amount, given) in rounds, each of which settles some rows of every month that can still match.

    Rows of a month, a side and one amount are a class, whose first unused row stands for it. A class's choice is the class within reach with the smallest first row.
    Two classes that choose each other match row by row, until one's next row comes after the first of another class that the other side could choose."""
    month = ["case_id", "competence"]
    cell = F.floor(F.col("amount") / (2 * tolerance)) if tolerance else F.col("amount")
    beside = F.explode(F.array(cell - 1, cell, cell + 1)) if tolerance else cell
    classes = free.select(*month, "given", "amount").distinct()
    a = classes.where("given").select(*month, F.col("amount").alias("want"), cell.alias("cell"))
    b = classes.where("NOT given").select(*month, F.col("amount").alias("have"), beside.alias("cell"))
    reach = kept(a.join(b, [*month, "cell"]).where(F.abs(F.col("have") - F.col("want")) <= tolerance).drop("cell"), "reach")
    found = []
    while True:
        firsts = free.groupBy(*month, "given", "amount").agg(F.min("row_no").alias("first"))
        wanted = firsts.where("given").select(*month, F.col("amount").alias("want"), F.col("first").alias("want_first"))
        had = firsts.where("NOT given").select(*month, F.col("amount").alias("have"), F.col("first").alias("have_first"))
        live = reach.join(wanted, [*month, "want"]).join(had, [*month, "have"])
        of_want, of_have = Window.partitionBy(*month, "want").orderBy("have_first"), Window.partitionBy(*month, "have").orderBy("want_first")
        live = live.withColumns({"choice": F.row_number().over(of_want), "until": F.lead("have_first").over(of_want)})
        live = live.withColumns({"chosen": F.row_number().over(of_have), "limit": F.lead("want_first").over(of_have)}).where("choice = 1 AND chosen = 1")
        ranked = free.withColumn("nth", F.row_number().over(Window.partitionBy(*month, "given", "amount").orderBy("row_no")))
        left = ranked.where("given").join(live.withColumnRenamed("want", "amount"), [*month, "amount"]).where("limit IS NULL OR row_no < limit").select(*month, "have", "nth", "row_no")
        right = ranked.where("NOT given").join(live.withColumnRenamed("have", "amount"), [*month, "amount"]).where("until IS NULL OR row_no < until").select(*month, F.col("amount").alias("have"), "nth", F.col("row_no").alias("taken"))
        now = kept(left.join(right, [*month, "have", "nth"]).select(*month, "row_no", "taken"), "matched")
        found.append(now)
        if now.isEmpty():
            return reduce(DataFrame.union, found)
        gone = now.select(*month, "row_no", F.lit(True).alias("given")).union(now.select(*month, F.col("taken").alias("row_no"), F.lit(False).alias("given")))
        free = kept(free.join(gone, [*month, "row_no", "given"], "left_anti").select(*free.columns), "unsettled")


def within(truth: DataFrame, predicted: DataFrame, key: list[str], tolerance: float = 0.006) -> DataFrame:
    """Rows of ``truth`` (key, amount) that have a predicted amount nearer than ``tolerance``; predictions may serve several rows.

    Amounts meet in cells of the tolerance's size and the two beside, so the join is by equal keys."""
    cell = F.floor(F.col("amount") / tolerance)
    near = predicted.select(*key, F.col("amount").alias("other"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")).distinct()
    rows = truth.withColumn("cell", cell)
    same = [rows[k].eqNullSafe(near[k]) for k in key]
    met = (rows["cell"] == near["cell"]) & (F.abs(rows["amount"] - near["other"]) < tolerance)
    for s in same:
        met = met & s
    return rows.join(near, met, "left_semi").drop("cell")


def totals(scores: DataFrame, group: list[str]) -> DataFrame:
    """Sums by group and in total (null group), and the ratio of the sums."""
    sums = scores.groupingSets([group, []], *group).agg(F.count("*").alias("cases"), F.sum("correct").alias("correct"), F.sum("fields").alias("fields"))
    return sums.withColumn("accuracy", ratio(F.col("correct"), F.col("fields")))


def truth_tables(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``documents`` (case_id, document: JSON) as pages, time cards and pay items, and what is wrong with the other cases.

    A case with a page below 1, an unknown type, a date, month or time that cannot be read, or an amount that is no number gives no rows but
    one in the last table: ``problem`` names the field, never its value. Amounts lose their sign and are rounded to cents."""
    rows = documents.select("case_id", F.from_json("document", TRUTH).alias("t")).select("case_id", "t.*")
    page = lambda k, v: k.try_cast("int").isNull() | (k.try_cast("int") < 1) | ~F.coalesce(v, F.lit("")).isin(*TYPES)
    unread = lambda t: lambda r: r[t].isNotNull() & (r[t] != "") & normalized_time(r[t]).isNull()
    has = lambda c, f: F.coalesce(F.exists(c, f), F.lit(False))
    problem = F.when(F.col("pages").isNull() & F.col("time_cards").isNull() & F.col("payslips").isNull(), "document")
    problem = problem.when(F.coalesce(F.size(F.map_filter("pages", page)) > 0, F.lit(False)), "pages")
    problem = problem.when(has("time_cards", lambda r: normalized_date(r["date"]).isNull()), "date")
    for t in TIMES:
        problem = problem.when(has("time_cards", unread(t)), t)
    problem = problem.when(has("payslips", lambda r: normalized_month(r["competence"]).isNull()), "competence").when(has("payslips", lambda r: r["amount"].try_cast("double").isNull()), "amount")
    rows = rows.withColumn("problem", problem)
    good = rows.where("problem IS NULL")
    pages = good.select("case_id", F.explode("pages").alias("page", "document_type")).select("case_id", F.col("page").cast("int").alias("page_number"), "document_type")
    days = good.select("case_id", F.posexplode("time_cards").alias("pos", "r")).select("case_id", "pos", normalized_date(F.col("r.date")).alias("date"), *(normalized_time(F.col(f"r.{t}")).alias(t) for t in TIMES))
    items = good.select("case_id", F.posexplode("payslips").alias("pos", "r")).select(
        "case_id", "pos", normalized_month(F.col("r.competence")).alias("competence"), F.coalesce("r.item_name", F.lit("")).alias("item_name"), F.round(F.abs(F.col("r.amount").try_cast("double")), 2).alias("amount"))
    return pages, days, items, rows.where("problem IS NOT NULL").select("case_id", "problem")


def next_cases(cases: DataFrame, done: DataFrame, most: int, kinds: list[str] | None = None) -> DataFrame:
    """The first ``most`` cases (case_id, layout, scan), in the order of their ids, that were not measured before; with ``kinds`` (layout/scan), of these alone."""
    rows = cases if kinds is None else cases.where(F.concat_ws("/", "layout", "scan").isin(kinds))
    return rows.join(done.select("case_id").distinct(), "case_id", "left_anti").orderBy("case_id").limit(most)


def case_scores(pages: DataFrame, classes: DataFrame, days: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each case from the four scores: ``page_scores``, ``class_scores``, ``day_scores``, ``item_scores``; counters of a part that a case lacks are 0, its ratios null."""
    named = lambda rows, name: rows.select("case_id", *(F.col(c).alias(f"{name}_{c}") for c in rows.columns if c != "case_id"))
    parts = [named(rows, name) for rows, name in ((pages, "page"), (classes, "class"), (days, "day"), (items, "item"))]
    whole = reduce(lambda a, b: a.join(b, "case_id", "full"), parts)
    counts = [c for c, t in whole.dtypes if t == "bigint" and c != "case_id"]
    return whole.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in counts})
