"""Queries of evaluation and intake: ground truth as JSON, whole cases, resumed runs, uploads, admissions, pacing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate, intake, records
from ..sources import case_files, files, tables as src
from ..streaming import evaluation as stream_evaluation
from . import inputs_sql as S
from .catalog import _files, _FILES, _RATIO, _sessions, _sessions_sql
from .registry import DEFAULT, SQL, long, query

# Ground truth: a user is a case, its days are the truth; some documents have a fault


def _documents(spark, sf):
    days = records.valid_time_cards(src.time_cards(spark, sf)).where("date IS NOT NULL")
    c = F.col("case_id")
    day = F.struct("date", F.when(c % 13 == 0, "25h").otherwise(F.col("clock_in")).alias("clock_in"), F.col("break_start"), F.lit("").alias("break_end"), F.col("clock_out"))
    rows = days.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", day.alias("r")))), lambda x: x["r"]).alias("time_cards"))
    pages = F.map_from_arrays(F.array(F.lit("1"), F.lit("2")), F.array(F.lit("CARTAO_PONTO"), F.when(c % 7 == 0, "OUTRO").otherwise("HOLERITE")))
    item = F.struct(F.lit("3/2024").alias("competence"), F.lit("Item").alias("item_name"), F.when(c % 11 == 0, "x").otherwise(F.concat(F.lit("-"), c.cast("string"), F.lit(".129"))).alias("amount"))
    return rows.select("case_id", F.when(c % 17 == 0, "[").otherwise(F.to_json(F.struct(pages.alias("pages"), "time_cards", F.array(item).alias("payslips")))).alias("document"))


_BAD = "CASE WHEN case_id % 17 = 0 THEN 'document' WHEN case_id % 7 = 0 THEN 'pages' WHEN case_id % 13 = 0 THEN 'clock_in' WHEN case_id % 11 = 0 THEN 'amount' END"


@query(f"""WITH {S.VALID} SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY row_no) - 1 AS BIGINT) AS pos, date, clock_in, break_start, CAST(NULL AS VARCHAR) AS break_end, clock_out
FROM valid WHERE date IS NOT NULL AND {_BAD} IS NULL""")
def truth_days(spark, sf):
    return evaluate.truth_tables(_documents(spark, sf))[1].select("case_id", *long("pos"), "date", "clock_in", "break_start", "break_end", "clock_out")


@query(f"""WITH {S.VALID}, c AS (SELECT DISTINCT case_id FROM valid WHERE date IS NOT NULL)
SELECT case_id, '2024-03' AS competence, 'Item' AS item_name, round(case_id + 0.129::DOUBLE, 2) AS amount FROM c WHERE {_BAD} IS NULL""")
def truth_items(spark, sf):
    return evaluate.truth_tables(_documents(spark, sf))[2].select("case_id", "competence", "item_name", "amount")


@query(f"WITH {S.VALID}, c AS (SELECT DISTINCT case_id FROM valid WHERE date IS NOT NULL) SELECT case_id, {_BAD} AS problem FROM c WHERE {_BAD} IS NOT NULL")
def truth_problems(spark, sf):
    return evaluate.truth_tables(_documents(spark, sf))[3]


# Whole cases: days of a user and items of a supplier with one number are a case


def _scores(spark, sf):
    rows = records.valid_time_cards(src.time_cards(spark, sf))
    truth = rows.where("date IS NOT NULL AND source_page <= 3").withColumn("nth", F.row_number().over(Window.partitionBy("case_id", "date").orderBy("row_no")))
    days = evaluate.day_scores(truth.where("nth = 1").select("case_id", "date", *records.TIMES), rows.where("source_page <> 2"))
    items = records.valid_payslips(src.payslips(spark, sf))
    found = evaluate.item_scores(items.where("source_page <= 5"), items.where("source_page >= 3"))
    pages = rows.select("case_id", F.col("source_page").alias("page_number")).distinct()
    sent = evaluate.page_scores(pages.where("page_number <= 3"), pages.where("page_number >= 2").withColumn("overflow", F.col("page_number") == 5))
    kind = lambda k: F.when(F.col("page_number") % k == 0, "HOLERITE").otherwise("CARTAO_PONTO").alias("document_type")
    classes = evaluate.class_scores(pages.where("page_number <= 4").select("*", kind(2)), pages.where("page_number >= 2").select("*", kind(3)))
    return evaluate.case_scores(sent, classes, days, found)


@query(f"""WITH {S.VALID}, p AS (SELECT DISTINCT case_id, source_page AS n FROM valid),
a AS (SELECT case_id, count(*) FILTER (n <= 3) AS page_relevant, count(*) FILTER (n IN (2, 3, 4)) AS page_sent, count(*) FILTER (n IN (2, 3)) AS page_hit, count(*) FILTER (n >= 2) AS class_classified,
  count(*) FILTER (CASE WHEN n <= 4 THEN CASE WHEN n % 2 = 0 THEN 'H' ELSE 'C' END ELSE 'I' END = CASE WHEN n % 3 = 0 THEN 'H' ELSE 'C' END AND n >= 2) AS class_correct FROM p GROUP BY 1),
d AS ({SQL['eval_time_cards']}), i AS ({SQL['eval_payslips_exact']})
SELECT coalesce(a.case_id, i.case_id) AS case_id, coalesce(page_relevant, 0) AS page_relevant, coalesce(page_sent, 0) AS page_sent, coalesce(page_hit, 0) AS page_hit, {_RATIO.format(a='page_hit', b='page_relevant')} AS page_recall,
  coalesce(class_classified, 0) AS class_classified, coalesce(class_correct, 0) AS class_correct, coalesce(d.fields, 0) AS day_fields, coalesce(d.correct, 0) AS day_correct, d.day_recall AS day_day_recall,
  coalesce(i.matched, 0) AS item_matched, i.precision AS item_precision
FROM a FULL JOIN i ON a.case_id = i.case_id LEFT JOIN d ON a.case_id = d.case_id""")
def evaluate_cases(spark, sf):
    return _scores(spark, sf).select(
        "case_id", "page_relevant", "page_sent", "page_hit", "page_recall", "class_classified", "class_correct", "day_fields", "day_correct", "day_day_recall", "item_matched", "item_precision")


_SCORE = "case_id bigint, layout string, scan string, day_correct bigint, day_fields bigint"


@query(f"""WITH d AS ({SQL['eval_time_cards']}), n AS (SELECT case_id, correct, fields, 'l' || (case_id % 3) AS layout FROM d)
SELECT layout, count(*) AS cases, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(fields) AS BIGINT) AS fields, {_RATIO.format(a='sum(correct)', b='sum(fields)')} AS accuracy FROM n GROUP BY GROUPING SETS ((layout), ())""")
def metrics_of_runs(spark, sf):
    """Two runs append the metrics of their cases as JSON, the second those that the first left out; all files are read again and summed."""
    rows = _scores(spark, sf).where("day_fields > 0").select("case_id", F.concat(F.lit("l"), F.col("case_id") % 3).alias("layout"), F.lit("s").alias("scan"), "day_correct", "day_fields")
    path = files.shared_folder(spark, "metrics")
    files.write_metrics(rows.where("case_id % 2 = 0"), path)
    files.write_metrics(rows, path, files.read_metrics(spark, path, _SCORE))
    return evaluate.totals(files.read_metrics(spark, path, _SCORE).withColumnsRenamed({"day_correct": "correct", "day_fields": "fields"}), ["layout"])


#: Cases whose truth files lie in one folder, which one stream reads.
FOLDER_CASES = 10_000
_PREDICTED = "case_id % 4 <> 0 OR row_no % 3 <> 0"


@query(f"""WITH {S.VALID}, c AS (SELECT DISTINCT case_id FROM valid WHERE date IS NOT NULL),
v AS (SELECT * FROM valid WHERE date IS NOT NULL),
f AS (SELECT case_id, date, row_no, row_number() OVER (PARTITION BY case_id, date ORDER BY row_no) AS nth, clock_in, break_start, clock_out FROM v),
p AS (SELECT DISTINCT ON (case_id, date) * FROM f WHERE {_PREDICTED} ORDER BY case_id, date, row_no),
s AS (SELECT t.case_id, 4 * count(*) AS day_fields, sum((t.clock_in IS NOT DISTINCT FROM p.clock_in)::INT + (t.break_start IS NOT DISTINCT FROM p.break_start)::INT + 1 + (t.clock_out IS NOT DISTINCT FROM p.clock_out)::INT) AS day_correct
  FROM f t LEFT JOIN p ON t.case_id = p.case_id AND t.date = p.date GROUP BY 1)
SELECT case_id, {_BAD} AS problem, CASE WHEN {_BAD} IS NULL THEN day_fields ELSE 0 END AS day_fields, CAST(CASE WHEN {_BAD} IS NULL THEN day_correct ELSE 0 END AS BIGINT) AS day_correct FROM c LEFT JOIN s USING (case_id)""")
def truth_files_scored(spark, sf):
    """Truth as a file for each case, in two deliveries and in folders of some ``FOLDER_CASES`` cases; each file is scored once, by the run that finds it new."""
    documents = files.kept(_documents(spark, sf), "documents")
    folder = F.pmod(F.xxhash64("case_id"), F.lit(1 + documents.count() // FOLDER_CASES)).cast("string").alias("folder")
    truth = documents.select("case_id", folder, F.concat(F.col("case_id").cast("string"), F.lit(".json")).alias("file_name"), F.col("document").cast("binary").alias("content"))
    cards = records.valid_time_cards(src.time_cards(spark, sf)).where("date IS NOT NULL").where(_PREDICTED)
    cards = files.kept(cards.select(folder, F.col("case_id").cast("string").alias("case_id"), "row_no", "date", "clock_in", "break_start", F.lit(None).cast("string").alias("break_end"), "clock_out", "ambiguous"), "cards", "folder")
    slips = spark.createDataFrame([], "case_id string, competence string, amount double, label_key string, row_no bigint")
    path, out, check = (files.shared_folder(spark, n) for n in ("truth", "scores", "checkpoint"))
    for delivery in (0, 1):
        case_files.write_files(truth.where(F.pmod("case_id", F.lit(2)) == delivery).drop("case_id"), path)
        stream_evaluation.score_folders(spark, path, lambda rows, name: stream_evaluation.day_and_item_scores(rows, cards.where(F.col("folder") == name), slips), out, check)
    scores = spark.read.parquet(out)
    return scores.select(F.col("case_id").cast("bigint").alias("case_id"), "problem", "day_fields", "day_correct")


@query("""WITH c AS (SELECT DISTINCT user_id AS case_id, 'l' || (user_id % 3) AS layout, 's' || (user_id % 2) AS scan FROM events)
SELECT case_id FROM c WHERE layout || '/' || scan IN ('l0/s0', 'l1/s1') AND case_id % 4 <> 1 ORDER BY case_id LIMIT 20""")
def next_cases(spark, sf):
    """The next 20 cases of a resumed run."""
    c = F.col("case_id")
    cases = src.table(spark, sf, "events").select(F.col("user_id").alias("case_id")).distinct().select("case_id", F.concat(F.lit("l"), c % 3).alias("layout"), F.concat(F.lit("s"), c % 2).alias("scan"))
    return evaluate.next_cases(cases, cases.where(c % 4 == 1), 20, ["l0/s0", "l1/s1"]).select("case_id")


# Uploads


@query(f"""WITH {_FILES}, r AS (SELECT *, sum(size) OVER (PARTITION BY case_id ORDER BY file_pos) AS used FROM (SELECT * REPLACE (CASE WHEN page_id % 19 = 0 THEN 0 ELSE size END AS size) FROM files))
SELECT page_id, CAST(used AS BIGINT) AS used, CASE WHEN used > 20000 THEN 'FILE_TOO_LARGE' WHEN size = 0 THEN 'EMPTY_FILE' ELSE 'OK' END AS state FROM r""")
def upload_states(spark, sf):
    rows = _files(spark, sf).withColumn("size", F.when(F.col("page_id") % 19 == 0, 0).otherwise(F.col("size")))
    return intake.over_budget(rows, 20_000).select("page_id", "used", "state")


@query(f"""WITH {_FILES}, k AS (SELECT *, ends_with(lower(filename), '.pdf') OR lower(trim(split_part(coalesce(content_type, ''), ';', 1))) = 'application/pdf' OR regexp_matches(lower(filename), '[.](jpg|jpeg|png|webp)$') AS known
  FROM (SELECT * REPLACE (CASE WHEN case_id % 2 = 1 THEN 'scan.pdf' ELSE filename END AS filename) FROM files)),
s AS (SELECT case_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (NOT known) AS unknown FROM k GROUP BY 1)
SELECT case_id, files, bytes, CASE WHEN files > 60 THEN 'TOO_MANY_FILES' WHEN unknown > 0 THEN 'UNKNOWN_KIND' WHEN bytes > 83886080 THEN 'FILE_TOO_LARGE' ELSE 'OK' END AS state FROM s""")
def upload_checks(spark, sf):
    rows = _files(spark, sf).withColumn("filename", F.when(F.col("case_id") % 2 == 1, "scan.pdf").otherwise(F.col("filename")))
    return intake.upload_checks(rows, DEFAULT.most_files, DEFAULT.most_upload_bytes)


_PDFS = """pdfs AS (SELECT page_id, page_id // 8 AS case_id, page_id % 8 AS file_pos, CASE WHEN page_id % 97 = 0 THEN 0 ELSE 1 + length(html) % 4 END AS n_pages, page_id % 89 = 5 AS encrypted FROM pages)"""


def _pdfs(spark, sf):
    k = F.col("page_id")
    return src.table(spark, sf, "pages").select(
        "page_id", F.floor(k / 8).alias("case_id"), (k % 8).alias("file_pos"), F.when(k % 97 == 0, 0).otherwise(1 + F.length("html") % 4).cast("bigint").alias("n_pages"), (k % 89 == 5).alias("encrypted"))


@query(f"""WITH {_PDFS}, g AS (SELECT *, bool_or(encrypted OR n_pages < 1) OVER (PARTITION BY case_id) AS spoilt FROM pdfs)
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY file_pos, page_pos) AS page_number, file_pos, page_pos FROM (SELECT case_id, file_pos, unnest(range(1, n_pages + 1)) AS page_pos FROM g WHERE NOT spoilt)""")
def assembled_pages(spark, sf):
    return intake.assembled(_pdfs(spark, sf))[0].select("case_id", *long("page_number", "file_pos", "page_pos"))


@query(f"WITH {_PDFS} SELECT case_id, file_pos, 'INVALID_PDF' AS state FROM pdfs WHERE encrypted OR n_pages < 1")
def assembled_faults(spark, sf):
    return intake.assembled(_pdfs(spark, sf))[1].select("case_id", *long("file_pos"), "state")


@query(f"WITH {_PDFS} SELECT page_id, CAST(coalesce(sum(n_pages) OVER (PARTITION BY case_id ORDER BY file_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first_page FROM pdfs")
def page_starts(spark, sf):
    return intake.page_starts(_pdfs(spark, sf)).select("page_id", *long("first_page"))


# Sessions and runs


@query(f"""WITH {_sessions_sql(900)} SELECT session_key, session_no, epoch_us(last_ts) + 900000000 AS expires_us, (epoch_us(last_ts) + 900000000 + 59999999) // 60000000 * 60000000 AS swept_us FROM found""")
def session_sweeps(spark, sf):
    found = intake.expired(_sessions(spark, sf, DEFAULT.session_seconds), DEFAULT.session_seconds, DEFAULT.sweep_seconds)
    return found.select("session_key", *long("session_no"), "expires_us", "swept_us")


@query()
def session_admissions(spark, sf):
    """Users are dealt to four stores of one session each; a store's sessions last six hours past their last event."""
    found = intake.expired(_sessions(spark, sf, 21_600), 21_600)
    asked = found.select((F.col("session_key") % 4).alias("store"), F.concat_ws("-", "session_key", "session_no").alias("session"), F.unix_micros(F.col("first_ts").cast("timestamp")).alias("start_us"), "expires_us")
    return intake.admitted(asked, 1)


@query("""WITH r AS (SELECT user_id AS queue, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth, event_id, event_id % 6 AS calls, CAST(event_id % 50 AS DOUBLE) AS elapsed FROM events),
p AS (SELECT *, greatest(calls * 60.0::DOUBLE / 4 - elapsed, 0.0::DOUBLE) AS pause FROM r)
SELECT queue, nth, pause, coalesce(sum(elapsed + pause) OVER (PARTITION BY queue ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS starts_at FROM p""")
def paced_runs(spark, sf):
    k = F.col("event_id")
    runs = src.table(spark, sf, "events").select(
        F.col("user_id").alias("queue"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("nth"), (k % 6).alias("calls"), (k % 50).cast("double").alias("elapsed"))
    return intake.paced(runs, DEFAULT.calls_per_minute).select("queue", *long("nth"), "pause", "starts_at")


_LOG = """log AS (SELECT user_id AS run_id, event_id, ts, CASE row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 6
  WHEN 1 THEN 'accepted' WHEN 2 THEN 'processing' WHEN 3 THEN CASE WHEN event_id % 5 = 0 THEN 'paused' ELSE 'completed' END WHEN 4 THEN CASE WHEN event_id % 3 = 0 THEN 'processing' ELSE 'failed' END ELSE 'discarded' END AS status FROM events),
pairs AS (SELECT run_id, event_id, epoch_us(ts) AS at_us, lag(status) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS before, status FROM log),
moves AS (SELECT * FROM (VALUES {moves}) m(a, b))""".format(moves=", ".join(f"('{a}', '{b}')" for a, b in [("", "accepted"), *((a, b) for a, after in intake.MOVES.items() for b in after)]))


def _log(spark, sf):
    """Runs of users whose states go wrong now and then; every fourth event stands twice, once with a later time."""
    k, w = F.col("event_id"), Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.row_number().over(w) % 6
    status = F.when(n == 1, "accepted").when(n == 2, "processing").when(n == 3, F.when(k % 5 == 0, "paused").otherwise("completed")).when(n == 4, F.when(k % 3 == 0, "processing").otherwise("failed")).otherwise("discarded")
    rows = src.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("at"), status.alias("status"))
    again = rows.where("event_id % 4 = 0").withColumn("at", F.col("at") + F.expr("INTERVAL 1 SECOND"))
    return rows.union(again)


@query(f"""WITH {_LOG} SELECT run_id, event_id, at_us, before, status, CASE WHEN status = 'paused' THEN 'unknown' WHEN before IS NULL THEN 'start' ELSE 'move' END AS fault
FROM pairs WHERE NOT EXISTS (SELECT 1 FROM moves WHERE a = coalesce(before, '') AND b = status)""")
def status_faults(spark, sf):
    faults = intake.lifecycle(_log(spark, sf))[1]
    return faults.select("run_id", "event_id", F.unix_micros("at").alias("at_us"), "before", "status", "fault")


@query(f"""WITH {_LOG} SELECT before, status, count(*) AS n, count(DISTINCT run_id) AS runs FROM pairs
WHERE EXISTS (SELECT 1 FROM moves WHERE a = coalesce(before, '') AND b = status) GROUP BY ALL""")
def status_moves(spark, sf):
    good = intake.lifecycle(_log(spark, sf))[0]
    return good.groupBy("before", "status").agg(F.count("*").alias("n"), F.count_distinct("run_id").alias("runs"))


@query("""WITH c AS (SELECT user_id AS run_id, event_id, ts, event_type AS status, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
d AS (SELECT * FROM c WHERE b IS NULL OR b <> status)
SELECT run_id, event_id, status, epoch_us(ts) AS at_us, epoch_us(lead(ts) OVER (PARTITION BY run_id ORDER BY ts, event_id)) AS until_us FROM d""")
def status_spans(spark, sf):
    rows = intake.status_spans(src.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), "event_id", F.col("event_type").alias("status")))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rows.select("run_id", "event_id", "status", us("at").alias("at_us"), us("until").alias("until_us"))
