"""Queries of time-card cells beyond one reading: where the schedule comes from, strips of columns, entries, counters, strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells, sheets
from ..sources import tables as src
from . import inputs_sql as S
from .registry import DEFAULT, long, query


def _resolved(spark, sf):
    marks = src.marks(spark, sf)
    return cells.resolved(marks, cells.schedule(marks, DEFAULT), DEFAULT)


_FROM = f"""{S.MARKS}, c AS (SELECT *, bool_or(confirmed) OVER (PARTITION BY case_id) AS any_page FROM marks), chosen AS (SELECT * FROM c WHERE confirmed OR NOT any_page),
picked AS (SELECT case_id, weekday, list_sort(list({S.minutes('first_read')}) FILTER (slot = 0)) AS a, list_sort(list({S.minutes('first_read')}) FILTER (slot = 1)) AS b FROM chosen GROUP BY 1, 2)"""


@query(f"""WITH {_FROM} SELECT case_id, CAST(weekday AS BIGINT) AS weekday, CAST(a[len(a) // 2 + 1] AS BIGINT) AS in_min, CAST(b[len(b) // 2 + 1] AS BIGINT) AS out_min
FROM picked WHERE len(a) >= 3 AND len(b) >= 3""")
def schedule_of_confirmed_pages(spark, sf):
    return cells.schedule(cells.schedule_cells(src.marks(spark, sf)), DEFAULT).select("case_id", *long("weekday", "in_min", "out_min"))


_COLUMN = "CASE WHEN slot = 1 AND NOT single_mark THEN 1 ELSE 0 END"


@query(f"""WITH {S.RESOLVED}, g AS (SELECT *, {_COLUMN} AS c FROM resolved WHERE 84 - k % 24 >= 0.8 * 84 AND k % 12 / 100.0::DOUBLE >= 0.04::DOUBLE AND k % 17 <> 0),
o AS (SELECT *, bool_or(value IS NULL) OVER (PARTITION BY case_id, page_number, c) AS open FROM g), s AS (SELECT *, dense_rank() OVER (PARTITION BY case_id ORDER BY page_number, c) AS n FROM o WHERE open)
SELECT case_id, cell_id, CAST(page_number AS BIGINT) AS page_number, CAST(c AS BIGINT) AS col, n AS strip_no, row_number() OVER (PARTITION BY case_id, page_number, c ORDER BY md5('0-' || cell_id)) AS row_pos,
  CAST((n - 1) // 4 AS BIGINT) AS call FROM s""")
def column_strips(spark, sf):
    rows = cells.column_strips(_resolved(spark, sf), sheets.passes_gate(), DEFAULT)
    return rows.select("case_id", "cell_id", *long("page_number"), F.col("column").cast("bigint").alias("col"), *long("strip_no", "row_pos", "call"))


def _unread(spark, sf):
    """The day after each cell's whose number ends in 3 was not read, unless it has a cell."""
    marks = src.marks(spark, sf)
    after = marks.where("cell_id % 10 = 3").select("case_id", F.date_add("day", 1).alias("day")).distinct()
    gone = after.join(marks.select("case_id", "day").distinct(), ["case_id", "day"], "left_anti")
    return gone.withColumns({"page_number": F.month("day"), "confirmed": (F.col("case_id") + F.month("day")) % 3 != 0})


_UNREAD = """unread AS (
  SELECT case_id, day, month(day) AS page_number, (case_id + month(day)) % 3 <> 0 AS confirmed
  FROM (SELECT DISTINCT case_id, CAST(day + 1 AS DATE) AS day FROM marks WHERE cell_id % 10 = 3) ANTI JOIN (SELECT DISTINCT case_id, day FROM marks) USING (case_id, day))"""
_SHOWN = "coalesce(source, '') <> 'local'"


@query(f"""WITH {S.RESOLVED}, {_UNREAD},
f AS (SELECT *, CASE WHEN slot = 0 THEN 'clock_in' ELSE 'clock_out' END AS name FROM resolved),
d AS (
  SELECT case_id, page_number, day, max(CASE WHEN slot = 0 THEN value END) AS clock_in, max(CASE WHEN slot = 1 THEN value END) AS clock_out, bool_and(confirmed) AS confirmed,
    list_distinct(flatten(list(CASE WHEN value IS NOT NULL THEN [] WHEN single_mark THEN ['clock_in', 'clock_out'] ELSE [name] END))) AS open,
    bool_or(source IS NULL) AS none, coalesce(bool_or(source = 'model'), false) AS m,
    max_by(cell_id, slot) FILTER ({_SHOWN} AND CASE WHEN single_mark AND value IS NULL THEN 'clock_in' ELSE name END = 'clock_in') AS show_in,
    max_by(cell_id, slot) FILTER ({_SHOWN} AND CASE WHEN single_mark AND value IS NULL THEN 'clock_in' ELSE name END = 'clock_out') AS show_out
  FROM f GROUP BY ALL)
SELECT case_id, CAST(page_number AS BIGINT) AS page_number, day, strftime(day, '%Y-%m') AS competence, clock_in, clock_out,
  concat_ws(',', CASE WHEN NOT confirmed THEN 'date' END, CASE WHEN list_contains(open, 'clock_in') THEN 'clock_in' END, CASE WHEN list_contains(open, 'clock_out') THEN 'clock_out' END) AS ambiguous,
  CASE WHEN none THEN 0.3::DOUBLE WHEN m THEN 0.85::DOUBLE ELSE 0.95::DOUBLE END AS confidence, show_in, show_out FROM d
UNION ALL SELECT case_id, page_number, day, strftime(day, '%Y-%m'), NULL, NULL, CASE WHEN confirmed THEN '' ELSE 'date,' END || 'clock_in,clock_out', 0.0::DOUBLE, NULL, NULL FROM unread""")
def time_card_entries(spark, sf):
    rows = cells.time_card_entries(_resolved(spark, sf), _unread(spark, sf), DEFAULT)
    return rows.select(
        "case_id", *long("page_number"), "day", "competence", "clock_in", "clock_out", F.array_join("ambiguous", ",").alias("ambiguous"), "confidence",
        cells.review_cell("clock_in").alias("show_in"), cells.review_cell("clock_out").alias("show_out"))


@query(f"""WITH {S.RESOLVED}, {_UNREAD}, p AS (SELECT DISTINCT case_id, page_number, confirmed FROM marks),
a AS (SELECT case_id, count(*) FILTER ((case_id + page_number) % 5 <> 0) AS pages, count(*) FILTER ((case_id + page_number) % 5 = 0) AS unrecognized,
  count(*) FILTER ((case_id + page_number) % 5 <> 0 AND NOT confirmed) AS dates_unconfirmed FROM p GROUP BY 1),
b AS (SELECT case_id, count(*) AS cells, count(*) FILTER (source = 'local') AS local, count(*) FILTER (source = 'model') AS model, count(*) FILTER (value IS NULL) AS review FROM resolved GROUP BY 1),
u AS (SELECT case_id, count(*) AS unread_days FROM unread GROUP BY 1)
SELECT a.*, b.* EXCLUDE (case_id), coalesce(unread_days, 0) AS unread_days FROM a JOIN b USING (case_id) LEFT JOIN u USING (case_id)""")
def cell_summary(spark, sf):
    rows = _resolved(spark, sf)
    pages = rows.select("case_id", "page_number", "confirmed").distinct().withColumn("recognized", (F.col("case_id") + F.col("page_number")) % 5 != 0)
    return cells.cell_summary(pages, rows, _unread(spark, sf))


@query(f"""WITH {S.RESOLVED}, x AS (SELECT case_id, CASE WHEN k % 10 = 0 THEN CAST(day + 4000 AS DATE) ELSE day END AS day, slot, CASE WHEN k % 8 = 0 THEN reread_1 ELSE first_read END AS want FROM resolved),
j AS (SELECT x.want, r.* FROM x LEFT JOIN resolved r ON x.case_id = r.case_id AND x.day = r.day AND x.slot = r.slot),
w AS (SELECT want, unnest(['first_reading', 'consensus', 'with_model']) AS strategy,
  unnest([CASE WHEN coalesce(abs({S.minutes('first_read')} - usual) <= 75, true) THEN first_read END, CASE WHEN local THEN agreed END, value]) AS got FROM j)
SELECT strategy, count(*) FILTER (got = want) AS correct, count(*) FILTER (got IS NULL) AS review, count(*) FILTER (got <> want) AS silent_errors FROM w GROUP BY 1""")
def strategy_comparison(spark, sf):
    rows = _resolved(spark, sf)
    k = F.col("cell_id")
    expected = rows.select(
        "case_id", F.when(k % 10 == 0, F.date_add("day", 4_000)).otherwise(F.col("day")).alias("day"), "slot", F.when(k % 8 == 0, F.col("reread_1")).otherwise(F.col("first_read")).alias("want"))
    again = rows.withColumn("cell_id", k + 10_000_000).withColumn("value", F.lit("00:00"))
    return cells.strategies(expected, rows.union(again), DEFAULT)


@query(r"""SELECT conv_id, turn, regexp_matches(text, '[A-Za-zÀ-ú]{3,}') AS has_letters,
array_to_string(list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda w: CASE WHEN regexp_matches(w, '[A-Za-zÀ-ú]{3,}') THEN '1' ELSE '0' END), '') AS word_flags FROM conversations""")
def letters_flags(spark, sf):
    """Whole texts, and every word of theirs (a cell holds one): 1 for each with letters, else 0."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    flags = F.array_join(F.transform(words, lambda w: F.when(cells.has_letters(w), "1").otherwise("0")), "")
    return src.table(spark, sf, "conversations").select("conv_id", "turn", cells.has_letters(F.col("text")).alias("has_letters"), flags.alias("word_flags"))


@query("SELECT vec_id, round(len(list_filter(embedding, lambda x: floor(128 + 256 * x::DOUBLE) < 128)) / 64.0::DOUBLE, 6) AS ink FROM embeddings")
def crop_ink(spark, sf):
    """A vector is the pixels of a crop."""
    pixels = F.transform("embedding", lambda x: F.floor(128 + 256 * x.cast("double")))
    return src.table(spark, sf, "embeddings").select("vec_id", F.round(cells.ink_ratio(pixels), 6).alias("ink"))
