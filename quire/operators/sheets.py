"""Dated tables rebuilt from positioned words: lines, table rows, columns, dates by several rules, and cells.

A page is the unit: its words are brought together once, as one row with its lines, and every later step is an
expression on that row (a page has some hundred words at most), so nothing else is shuffled and nothing is sorted again. The alternatives for
the dates (as printed, a year off, as most rows say) are columns, and the first that holds is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .grid import PERIOD, period, weekday_number

PAGE = ["case_id", "page_number"]
# Texts that end a table, mark a day without work, and mark a lone time; two times in one word.
TABLE_END, NO_WORK, LONE = r"(?iu)Sald|Hor[aá]rio do Func", r"(?iu)DES|ESC|EST|23.?59\)|N[aã]o Adm|Liberad|SENHORA|SRA\.|FERIAD", r"(?iu)\*|Esquec"
TWO_TIMES = r"(\d{2}[:;.]\d{2}).+?(\d{2}[:;.]\d{2})"
# Fewest rows and two-time rows of a table, days that dates are moved by to test them, shares of votes.
LEAST_ROWS, LEAST_PAIRS, REACH = 5, 3, 15
YEAR_SHARE, WEEKDAY_SHARE, START_SHARE = 0.6, 0.7, 0.8
# Least and greatest width and height of a cell (in those of its column), least ink.
GATE_WIDTH, GATE_HEIGHT, LEAST_INK = (0.8, 1.3), (0.6, 1.8), 0.04
# Reach of a column and least size of a word, width of a merged word (in column widths), first time that is an exit.
COLUMN_REACH, WORD_WIDTH, MERGED, EXIT_FROM = 0.5, 0.4, 1.6, "13:00"


def tsv_words(pages: DataFrame) -> DataFrame:
    """``pages`` (case_id, page_number, tsv): pos, line_key, x, y, w, h, text of every word. The head line, short lines, blank words and places that are no numbers go."""
    lines = pages.select(*PAGE, F.posexplode(F.split("tsv", r"\r\n|\n|\r")).alias("pos", "line")).where("pos > 0")
    rows = lines.withColumn("c", F.split("line", "\t")).where(F.size("c") >= 12)
    place = [F.get("c", F.lit(k)).try_cast("int").alias(n) for k, n in zip((6, 7, 8, 9), "xywh")]
    key = F.concat_ws("-", *(F.get("c", F.lit(k)) for k in (2, 3, 4))).alias("line_key")
    return rows.select(*PAGE, "pos", key, *place, F.regexp_replace(F.get("c", F.lit(11)), r"^\s+|\s+$", "").alias("text")).where("text != ''").dropna(subset=list("xywh"))


def page_lines(words: DataFrame) -> DataFrame:
    """A row for each page, its ``lines`` by place: y, first (of the word met first), text and words. The words are shuffled once, by page."""
    word = F.struct("x", "pos", "y", "w", "h", "text")
    lines = words.repartition(*PAGE).groupBy(*PAGE, "line_key").agg(F.min_by("y", "pos").alias("y"), F.min("pos").alias("first"), F.array_sort(F.collect_list(word)).alias("words"))
    return lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("y", "first", joined(F.col("words")).alias("text"), "words"))).alias("lines"))


def joined(words: Column, by: str = " ") -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), by)


def table_rows(pages: DataFrame) -> DataFrame:
    """case_id, page_number, the printed ``start`` and ``end``, and ``rows``: the lines above the table's end that begin with a piece of a date and a weekday. Pages without a period, or with too few rows, go."""
    text = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    ends = F.filter(F.transform("lines", lambda x, i: F.when(x["text"].rlike(TABLE_END), i)), lambda i: i.isNotNull())
    above = F.slice("lines", F.lit(1), F.coalesce(F.get(ends, F.lit(0)), F.size("lines")))

    def row(x: Column) -> Column:
        words = x["words"]

        def day_at(k: int) -> Column:
            dated = F.exists(F.slice(words, 1, k), lambda w: F.contains(w["text"], F.lit("/")))
            return F.when((F.size(words) > k) & dated, T.read_weekday(F.get(words, F.lit(k))["text"]))

        def dated_row(day: Column) -> Column:
            at = F.when(day["one"].isNotNull(), 1).otherwise(2)
            return F.when(F.coalesce(day["one"], day["two"]).isNotNull(), F.struct(
                x["y"].alias("y"), weekday_number(F.coalesce(day["one"], day["two"])).alias("weekday"), F.slice(words, at + 2, F.size(words)).alias("rest"),
                F.translate(F.upper(joined(F.slice(words, F.lit(1), at))), T.CONFUSED, T.DIGITS).alias("fragment")))

        return T.bound(F.struct(day_at(1).alias("one"), day_at(2).alias("two")), dated_row)

    found = pages.select(*PAGE, T.bound(F.regexp_extract(text, PERIOD, 0), period).alias("period"), above.alias("above")).where("period IS NOT NULL")
    rows = F.filter(F.transform("above", row), lambda r: r.isNotNull())
    return found.select(*PAGE, "period.start", "period.end", rows.alias("rows")).where(F.size("rows") >= LEAST_ROWS)


def with_columns(pages: DataFrame) -> DataFrame:
    """Adds entry_x, exit_x, width, height: medians (rounded half to even) of the rows that start with two times; pages with too few of them go."""
    word = lambda r, k: F.get(r["rest"], F.lit(k))
    time = lambda r, k: T.read_time(word(r, k)["text"]).isNotNull()
    pairs = F.filter("rows", lambda r: (word(r, 0)["x"] < word(r, 1)["x"]) & time(r, 0) & time(r, 1))
    pages = pages.withColumn("pairs", F.transform(pairs, lambda r: F.struct(word(r, 0).alias("a"), word(r, 1).alias("b")))).where(F.size("pairs") >= LEAST_PAIRS)
    listed = lambda *of: F.array_sort(F.concat(*(F.col(f"pairs.{side}.{field}") for side, field in of)))
    sorted_ = {"entry_x": listed(("a", "x")), "exit_x": listed(("b", "x")), "width": listed(("a", "w"), ("b", "w")), "height": listed(("a", "h"), ("b", "h"))}
    return pages.withColumns({c: T.bound(v, lambda x: F.bround(middle(x), 0).cast("int")) for c, v in sorted_.items()}).drop("pairs")


def middle(values: Column) -> Column:
    """Median of a sorted array, of its two middle values the mean; null if empty."""
    at = lambda k: F.get(values, F.floor(k).cast("int"))
    return (at((F.size(values) - 1) / 2) + at(F.size(values) / 2)) / 2


def count(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def months_agree(dates: Column, months: Column) -> Column:
    """Whether no move of the dates, by ``REACH`` days at most, makes more of them fall in their printed months than none does.

    For each row the moves that agree are an interval: what its printed month's first and last day are away. A histogram of these intervals
    is highest where one of them begins, so only those moves are counted."""
    def moves(day: Column, month: Column) -> Column:
        year = F.year(day) + F.when(month - F.month(day) > 6, -1).when(month - F.month(day) < -6, 1).otherwise(0)
        first = F.make_date(year, month, F.lit(1))
        return F.struct(F.greatest(F.datediff(first, day), F.lit(-REACH)).alias("from"), F.least(F.datediff(F.last_day(first), day), F.lit(REACH)).alias("to"))

    near = F.filter(F.zip_with(dates, months, lambda d, m: F.when(m.isNotNull(), moves(d, m))), lambda x: x["from"] <= x["to"])

    def highest(own: Column) -> Column:
        at = lambda k: count(own, lambda x: (x["from"] <= k) & (k <= x["to"]))
        begins = F.array_distinct(F.transform(own, lambda x: x["from"]))
        return at(F.lit(0)) >= F.coalesce(F.array_max(F.transform(begins, at)), F.lit(0))

    return T.bound(near, highest)


def with_days(pages: DataFrame) -> DataFrame:
    """Adds ``days``, one for each row, start, end and confirmed.

    A row for each day of the period: places give the dates; else each row takes the next date with its
    weekday. The period's year is mended if most printed years say so. Dates that the rows' months, and
    their weekdays or first day, don't bear out give way to the start that most rows print; if that
    isn't borne out either, the first dates stay, not confirmed."""
    printed = lambda text, pattern, k: F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).try_cast("int")

    def month(text: Column) -> Column:
        found = F.coalesce(printed(text, r"\d{2}/(\d{2})/\d{2,4}", 1), printed(text, r"(\d{2})/\d{2,4}", 1))
        return T.bound(found, lambda m: F.when(m.between(1, 12), m))

    full = lambda text: F.try_to_date(F.nullif(F.regexp_extract(text, r"\d{2}/\d{2}/\d{4}", 0), F.lit("")), "dd/MM/yyyy")
    of = lambda f: F.transform("rows", lambda r: f(r["fragment"]))
    pages = pages.withColumns({
        "n_rows": F.size("rows"), "weekdays": F.transform("rows", lambda r: r["weekday"]), "months": of(month), "years": of(lambda t: printed(t, r"/\d{2}/(\d{4})", 1)), "full": of(full),
    })
    gaps = F.transform("weekdays", lambda d, i: F.when(i == 0, 0).otherwise(1 + F.pmod(d - F.get("weekdays", i - 1) - 1, F.lit(7))))
    steps = F.aggregate(gaps, F.array().cast("array<int>"), lambda acc, g: F.array_append(acc, F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), acc), -1), F.lit(0)) + g))
    pages = pages.withColumn("steps", steps)
    each = lambda start, end: F.col("n_rows") == F.datediff(F.col(end), F.col(start)) + 1

    def days(start: str, end: str) -> Column:
        synced = F.pmod(F.get("weekdays", F.lit(0)) - F.weekday(start), F.lit(7))
        return F.transform("steps", lambda s, i: F.date_add(F.col(start), F.when(each(start, end), i).otherwise(synced + s).cast("int")))

    def borne_out(start: str, end: str, dates: str) -> Column:
        months = (count(F.col("months"), lambda m: m.isNotNull()) >= LEAST_ROWS) & months_agree(F.col(dates), F.col("months"))
        right = count(F.zip_with(dates, "weekdays", lambda d, w: F.weekday(d) == w), lambda x: x)
        return months & F.when(each(start, end), right >= WEEKDAY_SHARE * F.col("n_rows")).otherwise(F.array_min(dates) == F.col(start))

    pages = pages.withColumn("days", days("start", "end"))
    shifts = F.zip_with("years", "days", lambda y, d: y - F.year(d))
    pages = pages.withColumn("shifts", F.filter(shifts, lambda x: x.isNotNull()))
    back, same, on = (F.size(F.filter("shifts", lambda x: x == k)) for k in (-1, 0, 1))
    most = F.greatest(back, on)
    moved = (F.size("shifts") >= LEAST_ROWS) & (most > same) & (most >= YEAR_SHARE * F.size("shifts"))
    pages = pages.withColumn("moved", F.when(moved, F.when(back >= on, -12).otherwise(12)).otherwise(0))
    pages = pages.withColumns({c: F.add_months(c, F.col("moved")) for c in ("start", "end")})
    pages = pages.withColumn("days", days("start", "end"))
    pages = pages.withColumn("by_period", F.coalesce((F.array_max("days") <= F.col("end")) & borne_out("start", "end", "days"), F.lit(False)))

    votes = F.filter(F.zip_with(F.transform("full", lambda d, i: F.date_sub(d, i)), F.zip_with("full", "weekdays", lambda d, w: F.weekday(d) == w), lambda v, ok: F.when(ok, v)), lambda v: v.isNotNull())
    pages = pages.withColumn("votes", votes)  # first rows first
    ranked = F.transform(F.array_distinct("votes"), lambda v: F.struct(count(F.col("votes"), lambda x: x == v).alias("n"), (-F.array_position("votes", v)).alias("early"), v.alias("vote")))
    best = T.bound(F.array_max(ranked), lambda b: F.when(b["n"] >= F.greatest(F.lit(LEAST_ROWS), START_SHARE * F.col("n_rows")), b["vote"]))
    pages = pages.withColumn("voted", best).withColumn("voted_end", F.date_add("voted", F.col("n_rows") - 1))
    pages = pages.withColumn("other", days("voted", "voted_end"))
    pages = pages.withColumn("by_rows", ~F.col("by_period") & F.coalesce(borne_out("voted", "voted_end", "other"), F.lit(False)))
    pick = lambda a, b: F.when(F.col("by_rows"), F.col(a)).otherwise(F.col(b))
    return pages.select(
        *PAGE, "rows", "n_rows", "entry_x", "exit_x", "width", "height", pick("other", "days").alias("days"), pick("voted", "start").alias("start"), pick("voted_end", "end").alias("end"),
        (F.col("by_period") | F.col("by_rows")).alias("confirmed"))


def sheet_rows(words: DataFrame) -> DataFrame:
    """All dated rows of the pages that hold such a table; other pages give none."""
    pages = with_days(with_columns(table_rows(page_lines(words))))
    kept = ("n_rows", "entry_x", "exit_x", "width", "height", "start", "end", "confirmed")
    rows = pages.select(*PAGE, *kept, "days", F.posexplode("rows").alias("pos", "r"))
    return rows.select(*PAGE, "r.y", "r.weekday", "r.rest", "pos", *kept, F.get("days", F.col("pos")).alias("day"))


def is_day_off() -> Column:
    """A text of a day without work, unless it starts with a time or the exit column holds digits."""
    text = joined(F.col("rest"))
    near = F.exists("rest", lambda w: (F.abs(w["x"] - F.col("exit_x")) <= COLUMN_REACH * F.col("width")) & (F.length(F.regexp_replace(w["text"], r"\D", "")) >= 3))
    return F.substring(text, 1, 30).rlike(NO_WORK) & ~text.rlike(r"^\S{0,3}\d") & ~near


def work_days(rows: DataFrame) -> DataFrame:
    """A row for each day that isn't off: case_id, page_number, day, confirmed, column_width, column_height and the list ``cells`` of slot (0: entry, 1: exit), x, y, w, h, first_read, single_mark.

    A word belongs to the column it is nearest to. A lone mark has its slot from its time; a wide word
    holds both times; a column without a word gets its usual box, to be read again. A day with the sign of a lone mark but without a word has an empty list."""
    word = lambda x: F.array_min(F.transform(
        F.filter("rest", lambda w: (F.abs(w["x"] - F.col(x)) <= COLUMN_REACH * F.col("width")) & (w["w"] >= WORD_WIDTH * F.col("width"))),
        lambda w: F.struct(F.abs(w["x"] - F.col(x)).alias("away"), w.alias("word"))))["word"]

    def cell(slot, x, y, w, h, read, single: bool = False) -> Column:
        named = zip(("slot", "x", "y", "w", "h", "first_read", "single_mark"), (slot, x, y, w, h, read, F.lit(single)))
        return F.struct(*((c if isinstance(c, Column) else F.lit(c)).cast(t).alias(n) for (n, c), t in zip(named, ("int",) * 5 + ("string", "boolean"))))

    def of(slot, w: Column, single: bool = False) -> Column:
        return cell(slot, w["x"], w["y"], w["w"], w["h"], T.read_time(w["text"]), single)

    entry, leave, width = F.col("entry"), F.col("leave"), F.col("width")
    usual_y = F.coalesce(F.bround(middle(F.array_sort(F.transform("rest", lambda w: w["y"]))), 0), F.lit(0))
    lone = F.coalesce(entry, leave)
    lone_slot = F.coalesce((T.read_time(lone["text"]) >= EXIT_FROM).cast("int"), F.lit(0))
    part = lambda k: T.read_time(F.nullif(F.regexp_extract(entry["text"], TWO_TIMES, k), F.lit("")))
    merged = F.array(
        cell(0, entry["x"], entry["y"], width, entry["h"], part(1)),
        cell(1, F.col("exit_x"), entry["y"], F.least(width, entry["x"] + entry["w"] - F.col("exit_x")), entry["h"], part(2)),
    )
    slots = F.array(*(F.when(w.isNotNull(), of(k, w)).otherwise(cell(k, F.col(x), usual_y, width, F.col("height"), None)) for k, w, x in ((0, entry, "entry_x"), (1, leave, "exit_x"))))
    worked = rows.where(~is_day_off()).withColumns({"entry": word("entry_x"), "leave": word("exit_x")})
    cells = F.when(joined(F.col("rest")).rlike(LONE), F.when(lone.isNotNull(), F.array(of(lone_slot, lone, True)))).when(
        entry.isNotNull() & leave.isNull() & (entry["w"] > MERGED * width), merged).otherwise(slots)
    return worked.select(*PAGE, "day", "confirmed", F.col("width").alias("column_width"), F.col("height").alias("column_height"), F.coalesce(cells, F.filter(slots, lambda _: F.lit(False))).alias("cells"))


def cells_of(days: DataFrame) -> DataFrame:
    """A row for each cell of ``work_days``."""
    return days.select(*(c for c in days.columns if c != "cells"), F.inline("cells"))


def row_cells(rows: DataFrame) -> DataFrame:
    """A row for each cell of the work days of ``rows``; a work day without one has none (see ``work_days``)."""
    return cells_of(work_days(rows))


def passes_gate() -> Column:
    """Whether a cell may be shown to the second reader: about as large as its column's cells, with ink, without letters."""
    w, h = F.col("column_width"), F.col("column_height")
    sized = F.col("w").between(GATE_WIDTH[0] * w, GATE_WIDTH[1] * w) & F.col("h").between(GATE_HEIGHT[0] * h, GATE_HEIGHT[1] * h)
    return sized & (F.col("ink_ratio") >= LEAST_INK) & ~F.col("has_letters")


def span_texts(words: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """For each of ``spans`` (key, span, top, bottom) the words whose middle lies in it, joined by place; a word (key, pos) in several counts for the first.

    Strips may have any number of spans, of any height: a span lies in at most three cells of the power of two from its height on, a word in one cell of each power that
    there is a span of, and they meet by strip, power and cell. Spans are many more than the rows they come from, so no join sends them whole to the tasks."""
    at = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("level")))
    high = spans.where("bottom > top").withColumn("level", F.ceil(F.log2(F.col("bottom") - F.col("top"))))
    held = high.select(*key, "level", "span", "top", "bottom", F.explode(F.sequence(at(F.col("top")), at(F.col("bottom")))).alias("at"))
    placed = words.withColumn("middle", F.col("y") + F.col("h") / 2).crossJoin(F.broadcast(high.select("level").distinct())).withColumn("at", at(F.col("middle")))
    near = placed.join(held.hint("merge"), [*key, "level", "at"]).where("top <= middle AND middle < bottom")
    first = near.groupBy(*key, "pos").agg(F.min("span").alias("span"), F.first("x").alias("x"), F.first("text").alias("text"))
    found = first.groupBy(*key, "span").agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY x, pos)").alias("text"))
    return spans.join(found.hint("merge"), [*key, "span"], "left").select(*key, "span", F.coalesce("text", F.lit("")).alias("text"))


def sheet_pages(rows: DataFrame) -> DataFrame:
    """A row for each table: its period, columns, rows and whether its dates are confirmed."""
    same = [F.first(c).alias(c) for c in ("start", "end", "confirmed", "entry_x", "exit_x", "width", "height")]
    return rows.groupBy(*PAGE).agg(F.count("*").alias("n_rows"), *same)


def sheet_unread(rows: DataFrame) -> DataFrame:
    """Days of the period between a page's first and last row that no row has."""
    found = rows.groupBy(*PAGE).agg(F.first("start").alias("start"), F.first("end").alias("end"), F.max_by("day", "pos").alias("last"), F.min_by("day", "pos").alias("first"), F.collect_set("day").alias("days"))
    from_, to = F.greatest("start", "first"), F.least("end", "last")
    missing = F.when(from_ <= to, F.array_except(F.sequence(from_, to), "days"))
    return found.select(*PAGE, F.explode(missing).alias("day"))
