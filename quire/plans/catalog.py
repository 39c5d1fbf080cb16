"""The engine's queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import TEST_WORDS
from ..functions import text as T
from ..operators import answers, cells, evaluate, export, grid, intake, records, review, sheets, triage, visual
from ..sources import case_files, files
from ..sources import tables as src
from . import inputs_sql as S
from .registry import DEFAULT, QUERIES, SMALL, SPARSE, SQL, long, query

# Triage


def _signals(spark, sf, config=TEST_WORDS):
    return triage.scored(src.numbered(triage.read_pages(src.page_texts(spark, sf), config)), src.toc(spark, sf), config)


@query(f"WITH {S.SIGNALS} SELECT case_id, CAST(page_number AS BIGINT) AS page_number, keywords, CAST(strong AS BIGINT) AS strong, CAST(weak AS BIGINT) AS weak FROM signals")
def text_fold_keyword_hits(spark, sf):
    return _signals(spark, sf).select("case_id", *long("page_number"), "keywords", *long("strong", "weak"))


@query(f"WITH {S.SIGNALS} SELECT case_id, CAST(page_number AS BIGINT) AS page_number, CAST(patterns AS BIGINT) AS patterns FROM signals")
def pattern_counts(spark, sf):
    return _signals(spark, sf).select("case_id", *long("page_number", "patterns"))


@query(f"WITH {S.SIGNALS} SELECT case_id, count(*) AS pages, count(*) FILTER (calculation) AS calculation_pages, count(*) FILTER (is_primary) AS primary_pages FROM signals GROUP BY 1")
def calculation_pages(spark, sf):
    return triage.page_counts(_signals(spark, sf)).select("case_id", "pages", "calculation_pages", "primary_pages")


@query(f"WITH {S.SIGNALS} SELECT case_id, CAST(page_number AS BIGINT) AS page_number, is_primary, round(score, 6) AS score FROM signals")
def page_scores(spark, sf):
    return _signals(spark, sf).select("case_id", *long("page_number"), F.col("primary").alias("is_primary"), F.round("score", 6).alias("score"))


@query(f"WITH {S.SIGNALS} SELECT case_id, CAST(page_number AS BIGINT) AS page_number FROM hits")
def toc_semi_join(spark, sf):
    return triage.toc_hits(src.toc(spark, sf), TEST_WORDS).select("case_id", *long("page_number"))


@query(f"WITH {S.SIGNALS} SELECT case_id, CAST(page_number AS BIGINT) AS page_number FROM signals WHERE is_primary")
def primary_pages(spark, sf):
    return _signals(spark, sf).where("primary").select("case_id", *long("page_number"))


@query(f"WITH {S.neighbors(SPARSE)} SELECT case_id, CAST(page_number AS BIGINT) AS page_number, score FROM near WHERE neighbor")
def neighbor_pages(spark, sf):
    return triage.with_neighbors(_signals(spark, sf, SPARSE), SPARSE).where("neighbor").select("case_id", *long("page_number"), "score")


def _ranked_sql(cap: int) -> str:
    return f"""WITH {S.NEIGHBORS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, page_number) AS rank FROM near WHERE is_primary OR neighbor)
SELECT case_id, CAST(page_number AS BIGINT) AS page_number, rank, round(score, 6) AS score, rank > {cap} AS overflow FROM ranked"""


def _ranked(rows):
    return rows.select("case_id", *long("page_number", "rank"), F.round("score", 6).alias("score"), "overflow")


@query(_ranked_sql(25))
def triage_candidates(spark, sf):
    return _ranked(triage.triage(_signals(spark, sf), TEST_WORDS))


@query(_ranked_sql(2))
def triage_small_cap(spark, sf):
    return _ranked(triage.triage(_signals(spark, sf), SMALL))


@query(f"""WITH {S.NEIGHBORS},
f AS (SELECT *, row_number() OVER (PARTITION BY case_id, is_primary ORDER BY score DESC, page_number) AS r FROM near WHERE is_primary OR neighbor),
u AS (SELECT case_id, page_number, score + CASE WHEN is_primary AND r <= 10 AND table_hint THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM f),
ranked AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, page_number) AS rank FROM u)
SELECT case_id, CAST(page_number AS BIGINT) AS page_number, rank, round(score, 6) AS score, rank > 25 AS overflow FROM ranked""")
def triage_table_rerank(spark, sf):
    return _ranked(triage.triage(_signals(spark, sf), TEST_WORDS, tables=True))


@query("""WITH p AS (SELECT conv_id AS case_id, turn + 1 AS page_number, max(turn + 1) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT case_id, page_number, page_number AS rank FROM p WHERE n <= 25""")
def triage_all_pages_mode(spark, sf):
    return triage.all_pages(src.table(spark, sf, "conversations").select(F.col("conv_id").alias("case_id"), (F.col("turn") + 1).alias("page_number")), TEST_WORDS)


@query(f"""WITH {S.SIGNALS},
d AS (SELECT DISTINCT case_id, page_number FROM signals WHERE weak > 0),
i AS (SELECT *, page_number - row_number() OVER (PARTITION BY case_id ORDER BY page_number) AS island FROM d),
r AS (SELECT case_id, min(page_number) AS a, max(page_number) AS b FROM i GROUP BY case_id, island)
SELECT case_id, CAST(a AS BIGINT) AS first, CAST(b AS BIGINT) AS last, CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END AS label FROM r""")
def page_ranges(spark, sf):
    return triage.page_ranges(_signals(spark, sf).where("weak > 0")).select("case_id", *long("first", "last"), "label")


@query("SELECT conv_id AS case_id, turn, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 5 AS BIGINT) AS call FROM conversations")
def call_batches(spark, sf):
    rows = src.table(spark, sf, "conversations").select(F.col("conv_id").alias("case_id"), "turn")
    return triage.batches(rows, DEFAULT.pages_per_call, "turn").select("case_id", "turn", *long("call"))


# Scalar functions


@query(f"WITH {S.CARDS} SELECT case_id, row_no, {', '.join(f'{S.clock(t)} AS {t}' for t in S.TIMES)}, {S.date('date_raw')} AS date FROM cards")
def normalize_times_and_dates(spark, sf):
    return src.time_cards(spark, sf).select("case_id", *long("row_no"), *(T.normalized_time(F.col(t)).alias(t) for t in S.TIMES), T.normalized_date(F.col("date_raw")).alias("date"))


@query(f"WITH {S.SLIPS}, m AS (SELECT competence, {S.month('competence')} AS month, count(*) AS n FROM slips GROUP BY 1, 2) SELECT *, month[6:7] || '/' || month[1:4] AS printed FROM m")
def normalize_competences(spark, sf):
    rows = src.payslips(spark, sf).groupBy("competence", T.normalized_month(F.col("competence")).alias("month")).agg(F.count("*").alias("n"))
    return rows.withColumn("printed", T.month_br(F.col("month")))


@query(f"SELECT p_partkey, {S.label_key('x')} AS label_key, {S.slug('x')} AS slug FROM (SELECT p_partkey, ' Ação  ' || p_name || ' / É' || p_type AS x FROM part)")
def label_keys_slugs(spark, sf):
    label = F.concat(F.lit(" Ação  "), "p_name", F.lit(" / É"), "p_type")
    return src.table(spark, sf, "part").select("p_partkey", T.label_key(label).alias("label_key"), T.slug(label).alias("slug"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, replace(c::VARCHAR, '.', ',') AS printed, translate(format('{:,.2f}', c::DOUBLE), ',.', '.,') AS grouped, c::DOUBLE AS parsed FROM a""")
def amount_roundtrip(spark, sf):
    amount = F.col("l_extendedprice")
    return src.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.amount_br(amount).alias("printed"), T.grouped_br(amount).alias("grouped"), T.parsed_br(T.grouped_br(amount)).cast("double").alias("parsed"))


_TOKEN = """CASE k % 6 WHEN 0 THEN lpad(h::VARCHAR, 2, '0') || ':' || lpad(m::VARCHAR, 2, '0') WHEN 1 THEN lpad(h::VARCHAR, 2, '0') || lpad(m::VARCHAR, 2, '0')
  WHEN 2 THEN lpad(h::VARCHAR, 2, '0') || '3' || lpad(m::VARCHAR, 2, '0') WHEN 3 THEN replace(lpad(h::VARCHAR, 2, '0'), '0', 'O') || ';' || lpad(m::VARCHAR, 2, '0')
  WHEN 4 THEN '''' || h || '.' || lpad(m::VARCHAR, 2, '0') || '*' ELSE 'ab' || h END"""


def _tokens(spark, sf):
    two = lambda c: F.format_string("%02d", c)
    h, m, k = F.hour("ts"), F.minute("ts"), F.col("event_id") % 6
    token = F.when(k == 0, F.concat(two(h), F.lit(":"), two(m))).when(k == 1, F.concat(two(h), two(m))).when(k == 2, F.concat(two(h), F.lit("3"), two(m))).when(k == 3, F.concat(F.replace(two(h), F.lit("0"), F.lit("O")), F.lit(";"), two(m))).when(k == 4, F.concat(F.lit("'"), h.cast("string"), F.lit("."), two(m), F.lit("*"))).otherwise(F.concat(F.lit("ab"), h.cast("string")))
    return src.table(spark, sf, "events").select("event_id", token.alias("token"))


_PLAIN = """translate(upper(regexp_replace(token, '^[.,;|''"*()]+|[.,;|''"*()]+$', '', 'g')), 'OCDQB€$', '0000885')"""


@query(rf"""WITH t AS (SELECT event_id, {_TOKEN} AS token FROM (SELECT event_id, event_id AS k, hour(ts) AS h, minute(ts) AS m FROM events)),
p AS (SELECT event_id, token, {_PLAIN} AS x FROM t),
s AS (SELECT *, CASE WHEN regexp_matches(x, '^(\d{{1,2}})[:;.](\d{{2}})$') THEN '^(\d{{1,2}})[:;.](\d{{2}})$' WHEN regexp_matches(x, '^\d{{4}}$') THEN 'b'
  WHEN regexp_matches(x, '^\d{{2}}[\d+]\d{{2}}$') THEN 'c' END AS shape FROM p),
v AS (SELECT event_id, token, TRY_CAST(CASE WHEN shape IN ('b', 'c') THEN x[1:2] WHEN shape IS NOT NULL THEN regexp_extract(x, '^(\d{{1,2}})[:;.]', 1) END AS INT) AS h,
  TRY_CAST(CASE WHEN shape IS NOT NULL THEN x[-2:] END AS INT) AS m FROM s)
SELECT event_id, token, CASE WHEN h <= 23 AND m <= 59 THEN lpad(h::VARCHAR, 2, '0') || ':' || lpad(m::VARCHAR, 2, '0') END AS time FROM v""")
def ocr_token_times(spark, sf):
    return _tokens(spark, sf).select("event_id", "token", T.read_time(F.col("token")).alias("time"))


_DAYS = "['SEG','TER','QUA','QUI','SEX','SAB','DOM']"
_NOISY = f"(CASE event_id % 5 WHEN 0 THEN w WHEN 1 THEN w[1] || 'X' || w[3] WHEN 2 THEN w[2:3] WHEN 3 THEN 'Z' || w[2:3] ELSE lower(w) || '.' END)"


def _noisy_weekdays(spark, sf):
    days = F.array(*map(F.lit, T.WEEKDAYS))
    rows = src.table(spark, sf, "events").select("event_id", F.element_at(days, F.weekday("ts") + 1).alias("w"))
    k, cut = F.col("event_id") % 5, lambda a, n: F.substring("w", a, n)
    return rows.select("event_id", "w", F.when(k == 0, F.col("w")).when(k == 1, F.concat(cut(1, 1), F.lit("X"), cut(3, 1))).when(k == 2, cut(2, 2)).when(k == 3, F.concat(F.lit("Z"), cut(2, 2))).otherwise(F.concat(F.lower("w"), F.lit("."))).alias("token"))


@query(f"""WITH t AS (SELECT event_id, {_NOISY} AS token FROM (SELECT event_id, {_DAYS}[isodow(ts)] AS w FROM events)),
l AS (SELECT event_id, token, regexp_replace(upper(token), '[^A-ZÜ]', '', 'g')[1:3] AS raw FROM t),
f AS (SELECT event_id, token, CASE raw WHEN 'SES' THEN 'SEG' WHEN 'SEK' THEN 'SEX' WHEN 'QUT' THEN 'QUI' WHEN 'QÜI' THEN 'QUI' ELSE raw END AS x FROM l),
c AS (SELECT *, list_filter({_DAYS}, lambda d: CASE WHEN length(x) = 2 THEN d[2:3] = x ELSE (d[1] = x[1])::INT + (d[2] = x[2])::INT + (d[3] = x[3])::INT = 2 END) AS near FROM f)
SELECT event_id, token, CASE WHEN list_contains({_DAYS}, x) THEN x WHEN length(x) IN (2, 3) AND len(near) = 1 THEN near[1] END AS weekday FROM c""")
def ocr_weekdays(spark, sf):
    return _noisy_weekdays(spark, sf).select("event_id", "token", T.read_weekday(F.col("token")).alias("weekday"))


# Validation and reconciliation


def _cards(spark, sf):
    return records.reconciled_time_cards(src.time_cards(spark, sf))


def _kept_cards(spark, sf):
    return _cards(spark, sf).where("kept")


_TIMES = ", ".join(S.TIMES)


@query(f"WITH {S.VALID} SELECT case_id, row_no, day_key, {_TIMES}, array_to_string(missing, ',') AS missing, array_to_string(ambiguous, ',') AS ambiguous FROM valid")
def validate_time_cards(spark, sf):
    return records.valid_time_cards(src.time_cards(spark, sf)).select("case_id", *long("row_no"), "day_key", *S.TIMES, F.array_join("missing", ",").alias("missing"), F.array_join("ambiguous", ",").alias("ambiguous"))


@query(f"WITH {S.VALID_SLIPS} SELECT case_id, row_no, competence, item_name, label_key, CASE WHEN no_month THEN 'competence' ELSE '' END AS ambiguous FROM vslips")
def validate_payslips(spark, sf):
    return records.valid_payslips(src.payslips(spark, sf)).select("case_id", *long("row_no"), "competence", "item_name", "label_key", F.array_join("ambiguous", ",").alias("ambiguous"))


@query(f"WITH {S.REC_CARDS} SELECT case_id, row_no, day_key, CAST(source_page AS BIGINT) AS source_page, value_key FROM rec WHERE kept")
def dedup_time_cards(spark, sf):
    return _kept_cards(spark, sf).select("case_id", *long("row_no"), "day_key", *long("source_page"), "value_key")


def _conflict_sql(rec: str, group: str) -> str:
    return f"""WITH {rec},
c AS (SELECT case_id, {group}, value_key, min(row_no) AS r FROM rec WHERE kept AND disputed GROUP BY ALL),
v AS (SELECT case_id, {group}, string_agg(value_key, '; ' ORDER BY r) AS found_values FROM c GROUP BY ALL),
p AS (SELECT case_id, {group}, array_to_string(list_sort(list(DISTINCT source_page)), ',') AS source_pages FROM rec WHERE kept AND disputed GROUP BY ALL)
SELECT v.*, p.source_pages FROM v JOIN p USING (case_id, {group})"""


@query(_conflict_sql(S.REC_CARDS, "day_key"))
def conflicts_time_cards(spark, sf):
    return records.conflicts(_cards(spark, sf), ["day_key"])


def _slips(spark, sf):
    return records.reconciled_payslips(src.payslips(spark, sf))


@query(f"WITH {S.REC_SLIPS} SELECT case_id, row_no, competence, label_key, value_key FROM rec WHERE kept")
def dedup_payslips(spark, sf):
    return _slips(spark, sf).where("kept").select("case_id", *long("row_no"), "competence", "label_key", "value_key")


@query(_conflict_sql(S.REC_SLIPS, "competence, label_key"))
def conflicts_payslips(spark, sf):
    return records.conflicts(_slips(spark, sf), ["competence", "label_key"])


@query(f"""WITH {S.REC_SLIPS},
k AS (SELECT case_id, competence, CAST(CAST(base_salary AS DECIMAL(18,2)) AS VARCHAR) AS s, row_no, source_page FROM rec WHERE kept AND base_salary IS NOT NULL),
f AS (SELECT case_id, competence, s, min(row_no) AS r FROM k GROUP BY ALL),
v AS (SELECT case_id, competence, string_agg(s, '; ' ORDER BY r) AS found_values, count(*) AS n FROM f GROUP BY ALL),
p AS (SELECT case_id, competence, list_sort(list(DISTINCT source_page)) AS p FROM k GROUP BY ALL)
SELECT case_id, competence, found_values, array_to_string(p, ',') AS source_pages FROM v JOIN p USING (case_id, competence) WHERE n > 1 AND len(p) > 1""")
def base_salary_conflicts(spark, sf):
    return records.salary_conflicts(_slips(spark, sf))


# Cells


@query(f"WITH {S.SCHEDULE} SELECT case_id, CAST(weekday AS BIGINT) AS weekday, CAST(in_min AS BIGINT) AS in_min, CAST(out_min AS BIGINT) AS out_min FROM schedule")
def observed_schedule(spark, sf):
    return cells.schedule(src.marks(spark, sf), DEFAULT).select("case_id", *long("weekday", "in_min", "out_min"))


def _resolved(spark, sf):
    marks = src.marks(spark, sf)
    return cells.resolved(marks, cells.schedule(marks, DEFAULT), DEFAULT)


@query(f"""WITH {S.RESOLVED} SELECT cell_id, first_read IS NOT NULL AND coalesce(abs({S.minutes('first_read')} - usual) <= 75, true) AS plausible, model_read IS NOT NULL
  AND coalesce(abs({S.minutes('model_read')} - usual) <= 75, false) AS model_plausible FROM agreed""")
def plausible_marks(spark, sf):
    marks = src.marks(spark, sf)
    rows = cells.with_usual(marks, cells.schedule(marks, DEFAULT))
    return rows.select("cell_id", cells.plausible("first_read", DEFAULT, False).alias("plausible"), cells.plausible("model_read", DEFAULT, True).alias("model_plausible"))


@query(f"WITH {S.RESOLVED} SELECT cell_id, agreed, local FROM near_usual")
def consensus_cells(spark, sf):
    return _resolved(spark, sf).select("cell_id", "agreed", "local")


@query(f"WITH {S.RESOLVED} SELECT cell_id, source, value FROM resolved")
def second_reader_vote(spark, sf):
    return _resolved(spark, sf).select("cell_id", "source", "value")


@query(f"""WITH {S.RESOLVED},
o AS (SELECT *, bool_or(value IS NULL) OVER (PARTITION BY case_id, slot) AS open FROM resolved),
s AS (SELECT case_id, slot, (row_number() OVER (PARTITION BY case_id ORDER BY slot) - 1) // 4 AS call FROM (SELECT DISTINCT case_id, slot FROM o WHERE open))
SELECT o.case_id, CAST(o.slot AS BIGINT) AS slot, cell_id, row_number() OVER (PARTITION BY o.case_id, o.slot ORDER BY md5('0-' || cell_id)) AS row_pos,
  CAST(call AS BIGINT) AS call FROM o JOIN s ON o.case_id = s.case_id AND o.slot = s.slot WHERE open""")
def strip_batches(spark, sf):
    return cells.strips(_resolved(spark, sf), DEFAULT).select("case_id", *long("slot"), "cell_id", *long("row_pos", "call"))


@query(f"""WITH {S.RESOLVED},
d AS (SELECT case_id, day, max(CASE WHEN slot = 0 THEN value END) AS clock_in, max(CASE WHEN slot = 1 THEN value END) AS clock_out, bool_or(slot = 0
  AND value IS NULL) AS a, bool_or(slot = 1 AND value IS NULL) AS b, bool_or(coalesce(source = 'model', false)) AS m FROM resolved GROUP BY 1, 2)
SELECT case_id, day, clock_in, clock_out, concat_ws(',', CASE WHEN a THEN 'clock_in' END, CASE WHEN b THEN 'clock_out' END) AS ambiguous, CASE WHEN a
  OR b THEN 0.3::DOUBLE WHEN m THEN 0.85::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM d""")
def entries_from_cells(spark, sf):
    return cells.entries(_resolved(spark, sf), DEFAULT)


@query(f"""WITH {S.RESOLVED} SELECT coalesce(source, 'none') AS source, count(*) FILTER (value = first_read) AS correct, count(*) FILTER (value IS NULL) AS review,
  count(*) FILTER (value <> first_read) AS silent_errors FROM resolved GROUP BY 1""")
def strategy_outcomes(spark, sf):
    return cells.outcomes(_resolved(spark, sf), "first_read")


# Dates of rows


@query("""WITH d AS (SELECT DISTINCT user_id AS case_id, CAST(ts AS DATE) AS day FROM events),
r AS (SELECT case_id, day, row_number() OVER (PARTITION BY case_id ORDER BY day) AS pos, min(day) OVER (PARTITION BY case_id) AS start FROM d),
g AS (SELECT *, isodow(day) - 1 AS w, lag(isodow(day) - 1) OVER (PARTITION BY case_id ORDER BY pos) AS b FROM r),
s AS (SELECT case_id, pos, start, CASE WHEN b IS NULL THEN ((w - (isodow(start) - 1)) % 7 + 7) % 7 ELSE 1 + ((w - b - 1) % 7 + 7) % 7 END AS gap FROM g)
SELECT case_id, pos, start + CAST(sum(gap) OVER (PARTITION BY case_id ORDER BY pos) AS INTEGER) AS date FROM s""")
def weekday_sync_dates(spark, sf):
    days = src.table(spark, sf, "events").select(F.col("user_id").alias("case_id"), F.to_date("ts").alias("day")).distinct()
    w = Window.partitionBy("case_id")
    rows = days.select("case_id", F.row_number().over(w.orderBy("day")).alias("pos"), F.weekday("day").alias("weekday"), F.min("day").over(w).alias("start"))
    return grid.synced_dates(rows).select("case_id", *long("pos"), "date")


@query(r"""WITH t AS (SELECT o_orderkey, 'de ' || strftime(o_orderdate, '%d/%m/%Y') || ' à ' || CASE WHEN o_orderkey % 3 = 0 THEN '20/08/2932'
  WHEN o_orderkey % 3 = 1 THEN '31/02/2000' ELSE strftime(o_orderdate + INTERVAL 30 DAY, '%d/%m/%Y') END AS x FROM orders),
p AS (SELECT o_orderkey, CAST(try_strptime(x[4:13], '%d/%m/%Y') AS DATE) AS s, CAST(try_strptime(x[17:26], '%d/%m/%Y') AS DATE) AS e FROM t)
SELECT o_orderkey, s AS start, CASE WHEN coalesce(date_diff('day', s, e) BETWEEN 6 AND 62, false) THEN e WHEN day(s) > 28 THEN s + 30
  ELSE CAST(s + INTERVAL 1 MONTH AS DATE) - 1 END AS end_day, coalesce(date_diff('day', s, e) BETWEEN 6 AND 62, false) AS printed FROM p""")
def period_parse(spark, sf):
    k, br = F.col("o_orderkey") % 3, lambda d: F.date_format(d, "dd/MM/yyyy")
    end = F.when(k == 0, "20/08/2932").when(k == 1, "31/02/2000").otherwise(br(F.date_add(F.to_date("o_orderdate"), 30)))
    found = grid.period(F.concat(F.lit("de "), br(F.col("o_orderdate")), F.lit(" à "), end))
    return src.table(spark, sf, "orders").select("o_orderkey", found.alias("p")).select("o_orderkey", "p.start", F.col("p.end").alias("end_day"), "p.printed")


_VOTES = "r AS (SELECT user_id AS case_id, event_id % 31 AS pos, CAST(ts AS DATE) AS day FROM events)"


@query(f"""WITH {_VOTES},
v AS (SELECT case_id, day - CAST(pos AS INTEGER) AS start, count(*) AS n, min(pos) AS first FROM r GROUP BY 1, 2),
b AS (SELECT *, sum(n) OVER (PARTITION BY case_id) AS n_rows, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, first, start DESC) AS k FROM v)
SELECT case_id, start, n AS votes, CAST(n_rows AS BIGINT) AS n_rows FROM b WHERE k = 1 AND n >= greatest(2, 0.03::DOUBLE * n_rows)""")
def start_vote(spark, sf):
    rows = src.table(spark, sf, "events").select(F.col("user_id").alias("case_id"), (F.col("event_id") % 31).alias("pos"), F.to_date("ts").alias("read_date"))
    return _latest_start(rows)


def _latest_start(rows):
    return grid.start_vote(rows, 2, 0.03)


@query("""WITH r AS (SELECT o_custkey AS case_id, CAST(o_orderdate AS DATE) AS d, month(o_orderdate + INTERVAL 3 DAY) AS m FROM orders),
s AS (SELECT case_id, k AS shift, count(*) FILTER (month(d + CAST(k AS INTEGER)) = m) AS agree FROM r, range(-15, 16) t(k) GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY agree DESC, abs(shift), shift) AS n FROM s)
SELECT case_id, shift AS best_shift, agree FROM b WHERE n = 1""")
def month_shift_vote(spark, sf):
    rows = src.table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.to_date("o_orderdate").alias("date"), F.month(F.date_add(F.to_date("o_orderdate"), 3)).alias("printed_month"))
    return grid.month_shift(rows).select("case_id", *long("best_shift", "agree"))


@query("""WITH d AS (SELECT DISTINCT user_id AS case_id, CAST(ts AS DATE) AS day FROM events),
e AS (SELECT case_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY 1)
SELECT * FROM e ANTI JOIN d USING (case_id, day)""")
def unread_days(spark, sf):
    return grid.unread_days(src.table(spark, sf, "events").select(F.col("user_id").alias("case_id"), F.to_date("ts").alias("day")))


@query("""WITH w AS (SELECT user_id AS case_id, CAST(ts AS DATE) AS line, event_id AS pos, hour(ts) * 60 + minute(ts) AS x, event_type AS text FROM events),
c AS (SELECT DISTINCT case_id, line, slot, 480 + 540 * slot AS cx FROM w, range(0, 2) t(slot)),
n AS (SELECT w.case_id, w.line, slot, text, abs(x - cx) AS away, pos FROM w JOIN c ON w.case_id = c.case_id AND w.line = c.line WHERE abs(x - cx) <= 150),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, line, slot ORDER BY away, pos) AS k FROM n)
SELECT case_id, line, slot, text, CAST(away AS BIGINT) AS away FROM r WHERE k = 1""")
def nearest_column_words(spark, sf):
    words = src.table(spark, sf, "events").select(F.col("user_id").alias("case_id"), F.to_date("ts").alias("line"), F.col("event_id").alias("pos"), (F.hour("ts") * 60 + F.minute("ts")).alias("x"), F.col("event_type").alias("text"))
    columns = words.select("case_id", "line").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumns({"x": 480 + 540 * F.col("slot"), "width": F.lit(300)})
    return grid.nearest_words(words, columns).select("case_id", "line", *long("slot"), "text", *long("away"))


# Whole sheets: what was printed on them is what comes out

_SHEET = """e AS (SELECT user_id AS case_id, CAST(ts AS DATE) AS day, min(strftime(ts, '%H:%M')) AS a, max(strftime(ts, '%H:%M')) AS b, count(*) AS n, min(event_id) AS k FROM events GROUP BY 1, 2),
p AS (SELECT DISTINCT case_id, CAST(date_trunc('month', day) AS DATE) AS month FROM e), q AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY month) AS BIGINT) AS page_number FROM p),
c AS (SELECT case_id, page_number, month, CAST(unnest(generate_series(month, last_day(month), INTERVAL 1 DAY)) AS DATE) AS day FROM q),
d AS (SELECT c.*, a, b, n, k FROM c LEFT JOIN e USING (case_id, day) WHERE NOT (c.case_id % 3 = 1 AND isodow(day) = 3)),
good AS (SELECT case_id, page_number FROM d GROUP BY 1, 2 HAVING count(*) FILTER (n > 1 AND k % 7 > 1) >= 3), r AS (SELECT *, 315 + 12 * (case_id % 4) AS ex, 70 + 3 * (case_id % 3) AS cw FROM d JOIN good USING (case_id, page_number))"""


@query("""WITH e AS (SELECT user_id AS case_id, CAST(ts AS DATE) AS day, min(strftime(ts, '%H:%M')) AS a, max(strftime(ts, '%H:%M')) AS b, count(*) AS n, min(event_id) AS k FROM events GROUP BY 1, 2),
f AS (SELECT case_id, day, CASE WHEN n = 1 THEN [a, 'Esquecimento'] WHEN k % 7 = 0 THEN [a || '.' || b] WHEN k % 7 = 1 THEN [b] ELSE [a, b] END AS ws FROM e WHERE NOT (case_id % 3 = 1 AND isodow(day) = 3))
SELECT case_id, CAST(260 + 34 * day(day) AS BIGINT) AS y, CAST(len(ws) AS BIGINT) AS n, array_to_string(ws, ' ') AS words FROM f""")
def ocr_tsv_words(spark, sf):
    found = sheets.tsv_words(src.sheets(spark, sf)).where("y BETWEEN 260 AND 1400 AND x > 300")
    lines = found.groupBy("case_id", "page_number", "y").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda w: w["text"]), " ").alias("words"))
    return lines.where("words NOT LIKE 'DESC%'").select("case_id", *long("y", "n"), "words")


def _sheet_rows(spark, sf):
    return sheets.sheet_rows(sheets.tsv_words(src.sheets(spark, sf)))


@query(f"""WITH {_SHEET} SELECT case_id, page_number, CAST(count(*) AS BIGINT) AS n_rows, month AS start, CAST(last_day(month) AS DATE) AS end_day, true AS confirmed,
  CAST(min(ex) AS BIGINT) AS entry_x, CAST(min(ex + cw + 45) AS BIGINT) AS exit_x, CAST(min(cw) AS BIGINT) AS width, CAST(19 + case_id % 3 AS BIGINT) AS height FROM r
  GROUP BY case_id, page_number, month""")
def sheet_pages(spark, sf):
    found = sheets.sheet_pages(_sheet_rows(spark, sf))
    return found.select("case_id", *long("page_number", "n_rows"), "start", F.col("end").alias("end_day"), "confirmed", *long("entry_x", "exit_x", "width", "height"))


@query(f"""WITH {_SHEET}, s AS (SELECT *, unnest(CASE WHEN n = 1 THEN [{{'slot': CASE WHEN a >= '13:00' THEN 1 ELSE 0 END, 'first_read': a, 'x': ex + 2, 'w': cw - 4}}]
WHEN k % 7 = 0 THEN [{{'slot': 0, 'first_read': a, 'x': ex - 5, 'w': cw}}, {{'slot': 1, 'first_read': b, 'x': ex + cw + 45, 'w': cw - 25}}]
WHEN k % 7 = 1 THEN [{{'slot': 0, 'first_read': NULL, 'x': ex, 'w': cw}}, {{'slot': 1, 'first_read': b, 'x': ex + cw + 45, 'w': cw}}]
ELSE [{{'slot': 0, 'first_read': a, 'x': ex, 'w': cw}}, {{'slot': 1, 'first_read': b, 'x': ex + cw + 45, 'w': cw}}] END) AS u FROM r WHERE n IS NOT NULL)
SELECT case_id, page_number, day, CAST(u.slot AS BIGINT) AS slot, u.first_read AS first_read, n = 1 AS single_mark, CAST(u.x AS BIGINT) AS x, CAST(u.w AS BIGINT) AS w FROM s""")
def sheet_cells(spark, sf):
    return sheets.row_cells(_sheet_rows(spark, sf)).select("case_id", *long("page_number"), "day", *long("slot"), "first_read", "single_mark", *long("x", "w"))


@query("""SELECT doc_id, md5(lower(strip_accents(lower(text)))) AS folded, contains(strip_accents(lower(text)), 'official') OR contains(strip_accents(lower(text)), 'tion') AS hit FROM documents WHERE text IS NOT NULL""")
def fold_ligatures(spark, sf):
    """Texts as PDFs hold them, with ligatures, full-width letters and digits, fold to the plain ones."""
    printed = F.translate(F.col("text"), "0123456789toc", "０１２３４５６７８９ｔｏｃ")
    for plain, ligature in (("ffi", "ﬃ"), ("fi", "ﬁ"), ("ff", "ﬀ"), ("fl", "ﬂ")):
        printed = F.replace(printed, F.lit(plain), F.lit(ligature))
    folds = src.table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", T.folded(printed).alias("t"))
    return folds.select("doc_id", F.md5("t").alias("folded"), (F.contains("t", F.lit("official")) | F.contains("t", F.lit("tion"))).alias("hit"))


@query(f"""WITH {_SHEET},
l AS (SELECT case_id, page_number, month, max(day) AS last FROM r GROUP BY ALL),
w AS (SELECT case_id, page_number, day, CASE WHEN n = 1 AND (k % 3 = 0 OR a >= '13:00') THEN NULL WHEN n > 1 AND k % 7 = 1 THEN NULL ELSE a END AS clock_in,
  CASE WHEN n > 1 THEN b WHEN k % 3 <> 0 AND a >= '13:00' THEN a END AS clock_out, CASE WHEN n > 1 AND k % 7 = 1 THEN 'clock_in' ELSE '' END AS ambiguous,
  CASE WHEN n > 1 AND k % 7 = 1 THEN 0.3::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM r WHERE n IS NOT NULL)
SELECT case_id, page_number, CAST(day AS DATE) AS day, clock_in, clock_out, ambiguous, confidence FROM w
UNION ALL SELECT case_id, page_number, CAST(day AS DATE), NULL, NULL, 'clock_in,clock_out', 0.0::DOUBLE
  FROM (SELECT case_id, page_number, last, unnest(generate_series(month, last, INTERVAL 1 DAY)) AS day FROM l WHERE case_id % 3 = 1) WHERE isodow(day) = 3""")
def sheet_entries(spark, sf):
    """Whole sheets to entries, lone marks without a time among them: every work day has one."""
    rows = sheets.sheet_rows(sheets.tsv_words(src.sheets(spark, sf, bare=True)))
    days = sheets.work_days(rows)
    read = sheets.cells_of(days).withColumns({"cell_id": F.col("slot").cast("bigint"), "value": F.col("first_read"), "source": F.when(F.col("first_read").isNotNull(), "local")})
    unread = sheets.sheet_unread(rows).withColumn("confirmed", F.lit(True))
    found = cells.time_card_entries(read, unread, DEFAULT, days)
    return found.select("case_id", *long("page_number"), "day", "clock_in", "clock_out", F.array_join("ambiguous", ",").alias("ambiguous"), "confidence")


@query(f"""WITH {_SHEET},
l AS (SELECT case_id, page_number, month, max(day) AS last FROM r GROUP BY ALL)
SELECT case_id, page_number, CAST(day AS DATE) AS day FROM (SELECT case_id, page_number, last, unnest(generate_series(month, last, INTERVAL 1 DAY)) AS day FROM l
  WHERE case_id % 3 = 1) WHERE isodow(day) = 3""")
def sheet_unread(spark, sf):
    return sheets.sheet_unread(_sheet_rows(spark, sf)).select("case_id", *long("page_number"), "day")


@query(f"""WITH {_SHEET} SELECT case_id, page_number, day, slot, (day(day) % 10) / 10 * 0.1::DOUBLE >= 0.04::DOUBLE AND n > 1 AND w >= 0.8 * cw AS passes FROM (SELECT *, CASE
  WHEN n = 1 THEN cw - 4 WHEN k % 7 = 0 AND slot = 1 THEN cw - 25 ELSE cw END AS w FROM (SELECT *, CAST(unnest(CASE WHEN n = 1 THEN [CASE WHEN a >= '13:00' THEN 1
  ELSE 0 END] ELSE [0, 1] END) AS BIGINT) AS slot FROM r WHERE n IS NOT NULL))""")
def cell_gate(spark, sf):
    found = sheets.row_cells(_sheet_rows(spark, sf)).withColumns({"ink_ratio": F.dayofmonth("day") % 10 / 10 * 0.1, "has_letters": F.col("single_mark")})
    return found.select("case_id", *long("page_number"), "day", *long("slot"), sheets.passes_gate().alias("passes"))


@query("""WITH w AS (SELECT user_id AS case_id, CAST(ts AS DATE) AS day, event_id, hour(ts) * 60 + minute(ts) + 10.0 AS mid, event_type AS t FROM events),
s AS (SELECT DISTINCT case_id, day, k AS span FROM w, range(0, 23) r(k)),
m AS (SELECT case_id, day, t, event_id, min(span) AS span FROM w JOIN s USING (case_id, day) WHERE mid >= 60 * span AND mid < 60 * span + 90 GROUP BY ALL),
g AS (SELECT case_id, day, span, string_agg(t, '' ORDER BY event_id) AS text FROM m GROUP BY ALL)
SELECT case_id, day, span, coalesce(text, '') AS text FROM s LEFT JOIN g USING (case_id, day, span)""")
def words_in_spans(spark, sf):
    words = src.table(spark, sf, "events").select(F.col("user_id").alias("case_id"), F.to_date("ts").alias("day"), F.col("event_id").alias("pos"), F.col("event_id").alias("x"), (F.hour("ts") * 60 + F.minute("ts")).alias("y"), F.lit(20).alias("h"), F.col("event_type").alias("text"))
    spans = words.select("case_id", "day").distinct().withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(22)))).withColumns({"top": 60 * F.col("span"), "bottom": 60 * F.col("span") + 90})
    return sheets.span_texts(words, spans, ["case_id", "day"]).select("case_id", "day", *long("span"), "text")


@query("""WITH e AS (SELECT user_id AS session_key, epoch_us(ts) AS us, CASE WHEN event_id % 11 = 0 THEN 'delete' WHEN event_id % 3 = 0 THEN 'put' ELSE 'get' END AS kind FROM events),
o AS (SELECT *, CASE kind WHEN 'delete' THEN 0 WHEN 'put' THEN 1 ELSE 2 END AS o FROM e),
b AS (SELECT *, coalesce(us - lag(us) OVER w >= 86400000000, true) OR lag(kind) OVER w = 'delete' AS fresh FROM o WINDOW w AS (PARTITION BY session_key ORDER BY us, o)),
n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY session_key ORDER BY us, o ROWS UNBOUNDED PRECEDING) AS block FROM b),
p AS (SELECT session_key, block, min(us) AS begun FROM n WHERE kind = 'put' GROUP BY ALL)
SELECT session_key, make_timestamp(min(us) FILTER (kind <> 'delete')) AS first_ts, make_timestamp(max(us) FILTER (kind <> 'delete')) AS last_ts, count(*) FILTER (kind <> 'delete') AS n, bool_or(kind = 'delete') AS deleted
FROM n JOIN p USING (session_key, block) WHERE us > begun OR us = begun AND o > 0 GROUP BY session_key, block""")
def session_lives(spark, sf):
    """Events are puts, gets and deletes of a session for each user."""
    k = F.col("event_id")
    kind = F.when(k % 11 == 0, "delete").when(k % 3 == 0, "put").otherwise("get")
    return intake.session_lives(src.table(spark, sf, "events").select(F.col("user_id").alias("session_key"), "ts", kind.alias("kind")), 86_400)


@query("""WITH w AS (SELECT event_id AS pos, CAST(event_id % 20000 * 10 AS BIGINT) AS y, event_type AS t FROM events),
s AS (SELECT p_partkey AS span, p_partkey * 10 - 7 AS top, p_partkey * 10 + CASE WHEN p_partkey % 100 = 0 THEN 300 ELSE 8 END AS bottom FROM part),
m AS (SELECT pos, t, min(span) AS span FROM w JOIN s ON y + 1 >= top AND y + 1 < bottom GROUP BY ALL)
SELECT span, md5(coalesce(string_agg(t, '' ORDER BY pos), '')) AS text FROM s LEFT JOIN m USING (span) GROUP BY span""")
def words_in_one_long_strip(spark, sf):
    """One strip with a span for each part, some thirty times as high as others."""
    words = src.table(spark, sf, "events").select(F.lit(1).alias("strip"), F.col("event_id").alias("pos"), F.col("event_id").alias("x"), (F.col("event_id") % 20_000 * 10).alias("y"), F.lit(2).alias("h"), F.col("event_type").alias("text"))
    k = F.col("p_partkey")
    spans = src.table(spark, sf, "part").select(F.lit(1).alias("strip"), k.alias("span"), (k * 10 - 7).alias("top"), (k * 10 + F.when(k % 100 == 0, 300).otherwise(8)).alias("bottom"))
    return sheets.span_texts(words, spans, ["strip"]).select("span", F.md5("text").alias("text"))


@query(f"""WITH {S.RESOLVED},
o AS (SELECT *, bool_or(value IS NULL) OVER (PARTITION BY case_id, slot) AS open FROM resolved)
SELECT cell_id, first_read AS model_read FROM o WHERE open AND NOT (case_id % 4 = 0 AND slot = 1)""")
def strip_answers(spark, sf):
    """The second reader says what the first one did, but drops a row of some strips."""
    asked = cells.strips(_resolved(spark, sf), DEFAULT).withColumn("strip_id", F.concat_ws("-", "case_id", "slot"))
    said = asked.groupBy("case_id", "slot", "strip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_pos", "first_read"))), lambda r: r["first_read"]).alias("values"))
    short = (F.col("case_id") % 4 == 0) & (F.col("slot") == 1)
    said = said.withColumn("values", F.when(short, F.slice("values", F.lit(2), F.size("values"))).otherwise(F.col("values")))
    body = F.to_json(F.struct(F.collect_list(F.struct(F.col("strip_id").alias("id"), "values")).alias("strips")))
    told = said.groupBy("case_id").agg(F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("answer"))
    return answers.strip_reads(asked.select("case_id", "strip_id", "row_pos", "cell_id"), told).select("cell_id", "model_read")


@query("""WITH t AS (SELECT l_suppkey AS case_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS amount FROM lineitem),
p AS (SELECT case_id, amount + CASE l_orderkey % 3 WHEN 0 THEN 0.005::DOUBLE WHEN 1 THEN -0.004::DOUBLE ELSE 0.02::DOUBLE END AS other FROM t)
SELECT case_id, l_orderkey, l_linenumber, l_partkey, amount FROM t WHERE EXISTS (SELECT 1 FROM p WHERE p.case_id = t.case_id AND abs(t.amount - p.other) < 0.006::DOUBLE)""")
def model_amounts_within(spark, sf):
    truth = src.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("case_id"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("amount"))
    k = F.col("l_orderkey") % 3
    said = truth.select("case_id", (F.col("amount") + F.when(k == 0, 0.005).when(k == 1, -0.004).otherwise(0.02)).alias("amount"))
    return evaluate.within(truth, said, ["case_id"])


# Export


@query(f"WITH {S.SHIFTS} SELECT case_id, date, CAST(n_shifts AS BIGINT) AS n_shifts, CAST(dropped AS BIGINT) AS dropped, omitted FROM workdays")
def workday_shifts(spark, sf):
    return export.workdays(_kept_cards(spark, sf), DEFAULT).select("case_id", "date", *long("n_shifts", "dropped"), "omitted")


_SHIFT_COLUMNS = ", ".join(f"s[{k}][1] AS start_{k}, s[{k}][2] AS end_{k}" for k in range(1, 7))


@query(f"WITH {S.SHIFTS} SELECT case_id, date, {_SHIFT_COLUMNS} FROM daily WHERE len(s) > 0 OR half = 0")
def workday_pivot(spark, sf):
    return export.day_columns(_kept_cards(spark, sf), DEFAULT)


@query(f"WITH {S.SHIFTS} SELECT case_id, line FROM workdays WHERE NOT omitted")
def export_csv_lines(spark, sf):
    return export.workdays(_kept_cards(spark, sf), DEFAULT).where("NOT omitted").select("case_id", "line")


@query(f"""WITH {S.SHIFTS},
h AS (SELECT case_id, sum(incomplete) AS incomplete, sum(unread) AS unread FROM shifts GROUP BY 1),
w AS (SELECT case_id, count(*) FILTER (NOT omitted) AS days, count(*) FILTER (omitted) AS omitted, sum(CASE WHEN omitted THEN 0 ELSE dropped END) AS dropped
  FROM workdays GROUP BY 1),
f AS (SELECT case_id, count(*) FILTER (date IS NULL) AS skipped, count(*) FILTER (date IS NOT NULL AND list_contains(ambiguous, 'date')) AS unconfirmed FROM rec
  WHERE kept GROUP BY 1)
SELECT case_id, skipped, unconfirmed, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in ('incomplete', 'unread', 'days', 'omitted', 'dropped'))} FROM f LEFT
  JOIN h USING (case_id) LEFT JOIN w USING (case_id)""")
def export_summary(spark, sf):
    return export.summary(_kept_cards(spark, sf), DEFAULT)


_HISTORY = f"""{S.REC_SLIPS}, k AS (SELECT * FROM rec WHERE kept AND NOT no_month), items AS (SELECT case_id, label_key, competence, sum(CAST(amount AS DECIMAL(18,2))) AS amount, count(*) AS n FROM k GROUP BY ALL),
names AS (SELECT case_id, label_key, arg_min(item_name, row_no) AS label FROM k GROUP BY ALL), base AS (SELECT case_id, competence, arg_min(CAST(base_salary AS DECIMAL(18,2)), row_no) AS amount FROM k WHERE base_salary IS NOT NULL GROUP BY ALL),
history AS (SELECT case_id, label_key, competence, amount, n, label, false AS is_base FROM items JOIN names USING (case_id, label_key)
  UNION ALL SELECT case_id, 'salario-base', competence, amount, 1, 'Salário-base', true FROM base WHERE case_id NOT IN (SELECT case_id FROM names WHERE {S.slug('label')} = 'salario_base'))"""


@query(f"WITH {_HISTORY} SELECT case_id, label_key, competence, CAST(amount AS VARCHAR) AS amount, n FROM history")
def history_pivot(spark, sf):
    return export.histories(_slips(spark, sf).where("kept"), DEFAULT).select("case_id", "label_key", "competence", F.col("amount").cast("string").alias("amount"), *long("n"))


@query(f"""WITH {_HISTORY},
f AS (SELECT *, dense_rank() OVER (PARTITION BY case_id ORDER BY is_base DESC, label_key) AS no FROM history)
SELECT case_id, 'historico_salarial_' || lpad(no::VARCHAR, 2, '0') || '_' || {S.slug('label')} || '.csv' AS file_name, competence,
  competence[6:7] || '/' || competence[1:4] || ';' || replace(amount::VARCHAR, '.', ',') || ';;;;' AS line FROM f""")
def history_files(spark, sf):
    return export.history_lines(export.histories(_slips(spark, sf).where("kept"), DEFAULT)).select("case_id", "file_name", "competence", "line")


@query(f"""WITH {S.REC_SLIPS}, g AS (SELECT case_id, label_key, competence, count(*) FILTER (no_month) AS bad, count(*) FILTER (NOT no_month) AS good FROM rec WHERE kept GROUP BY ALL)
SELECT case_id, CAST(sum(bad) AS BIGINT) AS skipped_payslips, CAST(sum(greatest(good - 1, 0)) AS BIGINT) AS summed FROM g GROUP BY 1""")
def export_slip_summary(spark, sf):
    return export.slip_summary(_slips(spark, sf).where("kept"))


_NOTES = ", ".join(f"CASE WHEN {c} > 0 THEN '{words}: ' || {c} END" for c, words in export.NOTES.items())


@query(f"""WITH d AS ({SQL['export_summary']}), s AS ({SQL['export_slip_summary']}), c AS (SELECT * FROM d FULL JOIN s USING (case_id)),
l AS ({SQL['history_files']}), m AS (SELECT case_id, '- ' || file_name || ': ' || count(*) AS line FROM l GROUP BY case_id, file_name),
f AS (SELECT case_id, list(line ORDER BY line) AS files FROM m GROUP BY 1),
t AS (SELECT coalesce(c.case_id, f.case_id) AS case_id, list_concat(list_filter([{_NOTES}], lambda x: x IS NOT NULL), coalesce(files, [])) AS said FROM c FULL JOIN f ON c.case_id = f.case_id)
SELECT case_id, chr(65279) || CASE WHEN len(said) = 0 THEN '{export.NOTHING}' ELSE array_to_string(said, chr(13) || chr(10)) END || chr(13) || chr(10) AS text FROM t""")
def export_readme(spark, sf):
    slips = _slips(spark, sf).where("kept")
    counters = export_summary(spark, sf).join(export.slip_summary(slips), "case_id", "full")
    return export.notes(counters, export.history_lines(export.histories(slips, DEFAULT)))


@query(f"""WITH l AS ({SQL['history_files']}) SELECT case_id, file_name, sha256(encode('{export.HISTORY_HEADER}' || chr(13) || chr(10) || string_agg(line, chr(13) || chr(10) ORDER BY competence))) AS sha,
  CAST(octet_length(encode('{export.HISTORY_HEADER}' || chr(13) || chr(10) || string_agg(line, chr(13) || chr(10) ORDER BY competence))) AS BIGINT) AS n_bytes FROM l GROUP BY ALL""")
def history_file_bytes(spark, sf):
    files = export.history_files(export.history_lines(export.histories(_slips(spark, sf).where("kept"), DEFAULT)))
    return files.select("case_id", "file_name", F.sha2("content", 256).alias("sha"), F.length("content").cast("bigint").alias("n_bytes"))


_LATIN_HEADER = " || '\\xED'::BLOB || ".join(f"encode('{part}')" for part in export.DAY_HEADER.split("í"))


@query(f"""WITH {S.SHIFTS}, l AS (SELECT case_id, {_LATIN_HEADER} || encode(chr(13) || chr(10) || string_agg(line, chr(13) || chr(10) ORDER BY date)) AS content FROM workdays WHERE NOT omitted GROUP BY 1)
SELECT case_id, sha256(content) AS sha, CAST(octet_length(content) AS BIGINT) AS n_bytes FROM l""")
def workday_file_bytes(spark, sf):
    files = export.day_files(_kept_cards(spark, sf), DEFAULT)
    return files.select("case_id", F.sha2("content", 256).alias("sha"), F.length("content").cast("bigint").alias("n_bytes"))


@query(f"""WITH w AS ({SQL['workday_file_bytes']}), h AS ({SQL['history_file_bytes']})
SELECT case_id, 'cartao_ponto_jornada.csv' AS file_name, sha, n_bytes FROM w UNION ALL SELECT case_id, file_name, sha, n_bytes FROM h""")
def exported_files(spark, sf):
    """The files of all cases on disk, read back."""
    path = files.shared_folder(spark, "export")
    days = export.day_files(_kept_cards(spark, sf), DEFAULT).select(F.col("case_id").cast("string").alias("folder"), F.lit(export.DAY_FILE).alias("file_name"), "content")
    items = export.history_files(export.history_lines(export.histories(_slips(spark, sf).where("kept"), DEFAULT)))
    case_files.write_files(days.union(items.select(F.col("case_id").cast("string"), "file_name", "content")), path)
    found = case_files.read_files(spark, path)
    return found.select(F.col("folder").cast("bigint").alias("case_id"), "file_name", F.sha2("content", 256).alias("sha"), F.length("content").cast("bigint").alias("n_bytes"))


@query(f"WITH {S.REC_CARDS}, d AS (SELECT case_id || '/' || day_key AS case_id, kept AND disputed AS open FROM rec) SELECT case_id FROM d GROUP BY case_id HAVING NOT bool_or(open)")
def export_gate(spark, sf):
    """Each day of a user as a case of its own."""
    rows = _cards(spark, sf).withColumn("case_id", F.concat(F.col("case_id").cast("string"), F.lit("/"), "day_key"))
    return export.open_cases(rows, records.conflicts(rows, ["day_key"]))


# Review


@query(f"""WITH {S.VALID},
e AS (SELECT case_id, row_no, CASE WHEN source_page <= 2 THEN '09:00' END AS t, source_page = 5 AS other FROM valid WHERE source_page <= 2 OR source_page = 5)
SELECT v.case_id, v.row_no, coalesce(t, clock_in) AS clock_in, CASE WHEN other THEN '18:00' ELSE clock_out END AS clock_out, CASE
  WHEN e.case_id IS NOT NULL THEN 1.0::DOUBLE ELSE confidence END AS confidence, array_to_string(CASE WHEN e.case_id IS NULL THEN missing ELSE [] END, ',') AS missing,
  array_to_string(CASE WHEN e.case_id IS NULL THEN ambiguous ELSE list_filter(ambiguous, lambda x: x = 'date') END, ',') AS ambiguous FROM valid v LEFT
  JOIN e ON v.case_id = e.case_id AND v.row_no = e.row_no""")
def review_edits(spark, sf):
    rows = records.valid_time_cards(src.time_cards(spark, sf))
    edit = lambda where, field, value: rows.where(where).select("case_id", "row_no", F.lit(field).alias("field"), F.lit(value).alias("new_value"))
    done = review.edited(rows, edit("source_page <= 2", "clock_in", "09:00").union(edit("source_page = 5", "clock_out", "18:00")))
    return done.select("case_id", *long("row_no"), "clock_in", "clock_out", "confidence", F.array_join("missing", ",").alias("missing"), F.array_join("ambiguous", ",").alias("ambiguous"))


@query(f"""WITH {S.REC_CARDS},
c AS (SELECT case_id, day_key, max(source_page) AS keep_page FROM rec WHERE kept AND disputed GROUP BY ALL)
SELECT r.case_id, r.row_no, r.day_key, CAST(r.source_page AS BIGINT) AS source_page FROM rec r LEFT JOIN c ON r.case_id = c.case_id AND r.day_key = c.day_key
  WHERE r.kept AND (keep_page IS NULL OR source_page = keep_page)""")
def review_keep_page(spark, sf):
    rows = _kept_cards(spark, sf)
    choices = rows.where("disputed").groupBy("case_id", "day_key").agg(F.max("source_page").alias("keep_page"))
    return review.kept_pages(rows, choices, ["day_key"]).select("case_id", *long("row_no"), "day_key", *long("source_page"))


@query(f"""WITH {S.REC_SLIPS},
c AS (SELECT case_id, competence, max(base_salary) AS s FROM rec WHERE kept AND base_salary IS NOT NULL GROUP BY ALL)
SELECT r.case_id, r.row_no, coalesce(s, base_salary) AS base_salary FROM rec r LEFT JOIN c ON r.case_id = c.case_id AND r.competence = c.competence WHERE kept""")
def review_base_salary(spark, sf):
    rows = _slips(spark, sf).where("kept")
    choices = rows.where("base_salary IS NOT NULL").groupBy("case_id", "competence").agg(F.max("base_salary").alias("salary"))
    return review.chosen_salaries(rows, choices).select("case_id", *long("row_no"), "base_salary")


@query(f"WITH {S.VALID} SELECT case_id, row_no, array_to_string(CASE WHEN source_page = 3 THEN list_filter(ambiguous, lambda x: x <> 'date') ELSE ambiguous END, ',') AS ambiguous FROM valid")
def review_confirm_dates(spark, sf):
    rows = records.valid_time_cards(src.time_cards(spark, sf))
    return review.confirmed_dates(rows, rows.where("source_page = 3")).select("case_id", *long("row_no"), F.array_join("ambiguous", ",").alias("ambiguous"))


@query(f"WITH {S.VALID} SELECT case_id, row_no FROM valid WHERE confidence < 0.5 OR len(missing) > 0 OR len(ambiguous) > 0")
def attention_rows(spark, sf):
    return review.needs_attention(records.valid_time_cards(src.time_cards(spark, sf))).select("case_id", *long("row_no"))


# Model answers: a conversation is a case, its turns are pages asked in calls of five


def _asked(spark, sf):
    rows = src.table(spark, sf, "conversations").select(F.col("conv_id").alias("case_id"), (F.col("turn") + 1).cast("int").alias("page_number"), F.length("text").alias("size"))
    return triage.batches(rows, DEFAULT.pages_per_call)


def _answers(asked):
    """JSON of each call: a wrong type, a confidence out of range, missing pages, repeated and invented ones."""
    n, p = F.col("size"), F.col("page_number")
    kind = F.when(n % 5 == 0, "carta").when(n % 2 == 0, "HOLERITE").otherwise("CARTAO_PONTO")
    page = F.struct(F.when(n % 13 == 0, p + 90).otherwise(p).alias("page_number"), kind.alias("document_type"), F.when(n % 7 == 0, 2.0).otherwise((n % 100) / 100.0).alias("confidence"))
    rows = asked.where(n % 11 != 0).groupBy("case_id", "call").agg(F.array_sort(F.collect_list(F.struct("page_number", page.alias("p")))).alias("all"))
    return rows.select("case_id", "call", F.concat(F.lit("```json\n"), F.to_json(F.struct(F.transform("all", lambda x: x["p"]).alias("pages"))), F.lit("\n```")).alias("answer"))


_ASKED = """asked AS (SELECT conv_id AS case_id, turn + 1 AS page_number, length(text) AS n FROM conversations),
good AS (SELECT case_id, page_number, CASE WHEN n % 2 = 0 THEN 'HOLERITE' ELSE 'CARTAO_PONTO' END AS document_type, n % 100 / 100.0::DOUBLE AS confidence FROM asked
  WHERE n % 11 <> 0 AND n % 5 <> 0 AND n % 7 <> 0 AND n % 13 <> 0)"""


@query(f"WITH {_ASKED} SELECT * FROM good")
def model_answers_join(spark, sf):
    asked = _asked(spark, sf)
    return answers.classified(asked, _answers(asked)).select("case_id", *long("page_number"), "document_type", "confidence")


# Evaluation


_RATIO = "round(CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} END, 4)"


@query(f"""WITH {S.NEIGHBORS},
r AS (SELECT case_id, page_number, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, page_number) > 2 AS overflow FROM near WHERE is_primary OR neighbor),
t AS (SELECT DISTINCT p.case_id, p.page_number FROM pages p JOIN labels l ON p.doc_id = l.doc_id WHERE quality = 1),
b AS (SELECT coalesce(t.case_id, r.case_id) AS case_id, t.case_id IS NOT NULL AS t, coalesce(NOT overflow, false) AS s, coalesce(overflow, false) AS o FROM t FULL
  JOIN r ON t.case_id = r.case_id AND t.page_number = r.page_number),
c AS (SELECT case_id, count(*) FILTER (t) AS relevant, count(*) FILTER (s) AS sent, count(*) FILTER (t AND s) AS hit, count(*) FILTER (t AND o) AS in_overflow FROM b GROUP BY 1)
SELECT *, {_RATIO.format(a='hit', b='relevant')} AS recall, {_RATIO.format(a='hit', b='sent')} AS precision FROM c""")
def eval_triage(spark, sf):
    signals = _signals(spark, sf)
    truth = signals.join(src.table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id").select("case_id", "page_number").distinct()
    return evaluate.page_scores(truth, triage.triage(signals, SMALL))


@query(f"""WITH {_ASKED}, t AS (SELECT case_id, page_number, CASE WHEN n % 3 = 0 THEN 'CARTAO_PONTO' ELSE 'HOLERITE' END AS want FROM asked WHERE n % 3 <> 2),
b AS (SELECT coalesce(t.case_id, g.case_id) AS case_id, want, document_type AS got, coalesce(document_type = coalesce(want, 'IRRELEVANTE'), false) AS ok FROM t FULL JOIN good g ON t.case_id = g.case_id AND t.page_number = g.page_number),
c AS (SELECT case_id, count(got) AS classified, count(*) FILTER (ok) AS correct, count(*) FILTER (want IS NOT NULL AND NOT ok) AS relevant_missed FROM b GROUP BY 1)
SELECT *, {_RATIO.format(a='correct', b='classified')} AS accuracy FROM c""")
def eval_classification(spark, sf):
    asked = _asked(spark, sf)
    kind = F.when(F.col("size") % 3 == 0, "CARTAO_PONTO").otherwise("HOLERITE")
    truth = asked.where("size % 3 <> 2").select("case_id", "page_number", kind.alias("document_type"))
    return evaluate.class_scores(truth, answers.classified(asked, _answers(asked)))


@query(f"""WITH {S.VALID}, f AS (SELECT *, row_number() OVER (PARTITION BY case_id, date ORDER BY row_no) AS nth FROM valid WHERE date IS NOT NULL AND source_page <> 2), p AS (SELECT * FROM f WHERE nth = 1), t AS (SELECT * EXCLUDE nth FROM (SELECT *, row_number() OVER (PARTITION BY case_id, date ORDER BY row_no) AS nth FROM valid WHERE date IS NOT NULL AND source_page <= 3) WHERE nth = 1),
j AS (SELECT t.case_id, t.date, p.case_id IS NOT NULL AS found, coalesce(list_contains(p.ambiguous, 'date'), false) AS pending, unnest([{', '.join(f"{{'n': '{x}', 'w': t.{x}, 'g': p.{x}}}" for x in S.TIMES)}]) AS u FROM t LEFT JOIN p ON t.case_id = p.case_id AND t.date = p.date),
c AS (SELECT case_id, count(*) AS fields, count(*) FILTER (u.w IS NOT DISTINCT FROM u.g) AS correct, count(*) FILTER (u.w IS NULL AND u.g IS NOT NULL) AS invented, count(*) FILTER (u.w IS NOT NULL) AS marks, count(*) FILTER (u.w IS NOT NULL AND u.g IS NULL) AS empty, count(*) FILTER (u.w <> u.g AND NOT pending) AS wrong, count(*) FILTER (u.w <> u.g AND pending) AS date_pending, count(*) FILTER (found) // 4 AS found_days,
  count(DISTINCT date) AS expected_days, {', '.join(f"round(count(*) FILTER (u.n = '{x}' AND u.w IS NOT DISTINCT FROM u.g)::DOUBLE / count(*) FILTER (u.n = '{x}'), 4) AS accuracy_{x}" for x in S.TIMES)} FROM j GROUP BY 1),
x AS (SELECT p.case_id, count(*) AS extra_days FROM p ANTI JOIN t USING (case_id, date) GROUP BY 1), o AS (SELECT case_id, count(*) FILTER (list_contains(ambiguous, 'date')) AS unconfirmed_days FROM p GROUP BY 1)
SELECT c.*, coalesce(extra_days, 0) AS extra_days, coalesce(unconfirmed_days, 0) AS unconfirmed_days, {_RATIO.format(a='found_days', b='expected_days')} AS day_recall, {_RATIO.format(a='correct', b='fields')} AS accuracy FROM c LEFT JOIN x ON c.case_id = x.case_id LEFT JOIN o ON c.case_id = o.case_id""")
def eval_time_cards(spark, sf):
    rows = records.valid_time_cards(src.time_cards(spark, sf))
    return evaluate.day_scores(_first_of_day(rows), rows.where("source_page <> 2"))


def _first_of_day(rows):
    truth = rows.where("date IS NOT NULL AND source_page <= 3")
    return truth.withColumn("nth", F.row_number().over(Window.partitionBy("case_id", "date").orderBy("row_no"))).where("nth = 1").select("case_id", "date", *S.TIMES)


_ITEMS = """n AS (SELECT case_id, competence, CAST(amount AS DECIMAL(18,2)) AS cents, label_key, row_number() OVER (PARTITION BY case_id, competence,
  CAST(amount AS DECIMAL(18,2)) ORDER BY row_no) AS nth, {p} FROM vslips WHERE {w})"""


@query(f"""WITH {S.VALID_SLIPS}, {_ITEMS.format(p='1 AS t', w='source_page <= 5')}, m AS (SELECT case_id, competence, CAST(amount AS DECIMAL(18,2)) AS cents, label_key,
  row_number() OVER (PARTITION BY case_id, competence, CAST(amount AS DECIMAL(18,2)) ORDER BY row_no) AS nth FROM vslips WHERE source_page >= 3),
b AS (SELECT coalesce(n.case_id, m.case_id) AS case_id, n.label_key AS want, m.label_key AS got FROM n FULL JOIN m ON n.case_id = m.case_id
  AND n.competence = m.competence AND n.cents = m.cents AND n.nth = m.nth),
c AS (SELECT case_id, count(want) AS expected, count(got) AS predicted, count(*) FILTER (want IS NOT NULL AND got IS NOT NULL) AS matched,
  count(*) FILTER (want = got) AS named FROM b GROUP BY 1)
SELECT *, {_RATIO.format(a='matched', b='expected')} AS recall, {_RATIO.format(a='matched', b='predicted')} AS precision FROM c""")
def eval_payslips_exact(spark, sf):
    rows = records.valid_payslips(src.payslips(spark, sf))
    return evaluate.item_scores(rows.where("source_page <= 5"), rows.where("source_page >= 3"))


@query(f"""WITH RECURSIVE {S.VALID_SLIPS},
t AS (SELECT case_id, competence, list({{'row_no': row_no, 'amount': amount}} ORDER BY row_no) AS ts FROM vslips WHERE source_page <= 5 AND amount IS NOT NULL GROUP BY ALL),
p AS (SELECT case_id, competence, list({{'row_no': row_no, 'amount': amount}} ORDER BY row_no) AS ps FROM vslips WHERE source_page >= 3 AND amount IS NOT NULL GROUP BY ALL),
g AS (
  SELECT case_id, competence, ts, ps, 0 AS k, NULL::BIGINT AS row_no, NULL::BIGINT AS taken, []::BIGINT[] AS used FROM t JOIN p USING (case_id, competence)
  UNION ALL
  SELECT case_id, competence, ts, ps, k + 1, row_no, c, CASE WHEN c IS NULL THEN used ELSE list_append(used, c) END FROM (
    SELECT case_id, competence, ts, ps, k, used, ts[k + 1].row_no AS row_no, list_filter(ps, lambda x: abs(x.amount - ts[k + 1].amount) <= 0.01::DOUBLE AND NOT list_contains(used, x.row_no))[1].row_no AS c
    FROM g WHERE k < len(ts)))
SELECT case_id, competence, row_no, taken FROM g WHERE taken IS NOT NULL""")
def eval_payslips_greedy(spark, sf):
    rows = records.valid_payslips(src.payslips(spark, sf))
    return evaluate.greedy_matches(rows.where("source_page <= 5"), rows.where("source_page >= 3"))


@query("""WITH c AS (SELECT event_type AS model, user_id % 2 AS thinking, CASE WHEN event_id % 17 <> 0 THEN value END AS latency, event_id % 900 + 100 AS tokens_in, event_id % 70 AS tokens_out, event_id % 7 AS ok, 6 + event_id % 2 AS total FROM events),
m AS (SELECT model, thinking, count(*) AS calls, count(*) FILTER (latency IS NULL) AS failures, greatest(count(latency), 1) AS answered, CAST(sum(CAST(latency AS DECIMAL(18,2))) AS DOUBLE) AS all_latency, max(latency) AS most_latency,
  coalesce(sum(tokens_in) FILTER (latency IS NOT NULL), 0) AS i, coalesce(sum(tokens_out) FILTER (latency IS NOT NULL), 0) AS o, sum(ok)::DOUBLE AS ok, sum(total)::DOUBLE AS total FROM c GROUP BY 1, 2)
SELECT model, thinking, calls, failures, round(all_latency / answered, 4) AS mean_latency, most_latency, CAST(i // answered AS BIGINT) AS tokens_in_each, CAST(o // answered AS BIGINT) AS tokens_out_each, round(100.0::DOUBLE * ok / total, 2) AS percent FROM m""")
def model_compare(spark, sf):
    """An event is a call: its type is the model, its value the latency."""
    k = F.col("event_id")
    calls = src.table(spark, sf, "events").select(
        F.col("event_type").alias("model"), (F.col("user_id") % 2).alias("thinking"), F.when(k % 17 != 0, F.col("value")).alias("latency"), (k % 900 + 100).alias("tokens_in"), (k % 70).alias("tokens_out"), (k % 7).alias("ok"), (6 + k % 2).alias("total"))
    return evaluate.model_scores(calls, ["model", "thinking"])


@query(f"""WITH {S.RESOLVED},
s AS (SELECT case_id, CAST(case_id % 3 AS BIGINT) AS layout, CAST(case_id % 2 AS BIGINT) AS scan, count(*) AS fields, count(*) FILTER (value = first_read) AS correct
  FROM resolved GROUP BY 1, 2, 3),
g AS (SELECT layout, scan, count(*) AS cases, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(fields) AS BIGINT) AS fields FROM s GROUP BY GROUPING SETS ((layout, scan), ()))
SELECT *, {_RATIO.format(a='correct', b='fields')} AS accuracy FROM g""")
def eval_summary_grouping_sets(spark, sf):
    scores = _resolved(spark, sf).groupBy("case_id", (F.col("case_id") % 3).alias("layout"), (F.col("case_id") % 2).alias("scan")).agg(F.count("*").alias("fields"), F.count_if(F.col("value") == F.col("first_read")).alias("correct"))
    return evaluate.totals(scores, ["layout", "scan"])


# Uploads and sessions


_FILES = """files AS (SELECT page_id, page_id // 100 * 2 + (page_id % 100 >= 70)::INT AS case_id, page_id % 100 AS file_pos, length(html) AS size, CASE page_id % 4 WHEN 0 THEN 'F' || (page_id % 7) || '.PDF'
  WHEN 1 THEN 'img' || (page_id % 5) || '.jpeg' ELSE split_part(url, '?', 1) END AS filename, CASE page_id % 3 WHEN 0 THEN 'text/html'
  WHEN 1 THEN 'Application/PDF; v=1' END AS content_type FROM pages)"""


def _files(spark, sf):
    k = F.col("page_id")
    name = F.when(k % 4 == 0, F.concat(F.lit("F"), (k % 7).cast("string"), F.lit(".PDF"))).when(k % 4 == 1, F.concat(F.lit("img"), (k % 5).cast("string"), F.lit(".jpeg"))).otherwise(F.split_part("url", F.lit("?"), F.lit(1)))
    return src.table(spark, sf, "pages").select("page_id", (F.floor(k / 100) * 2 + (k % 100 >= 70).cast("int")).alias("case_id"), (k % 100).alias("file_pos"), F.length("html").cast("bigint").alias("size"), name.alias("filename"), F.when(k % 3 == 0, "text/html").when(k % 3 == 1, "Application/PDF; v=1").alias("content_type"))


@query(f"""WITH {_FILES} SELECT page_id, CASE WHEN ends_with(lower(filename), '.pdf') OR lower(trim(split_part(coalesce(content_type, ''), ';', 1))) IN ('application/pdf',
  'application/x-pdf') THEN 'pdf' WHEN regexp_matches(lower(filename), '\\.(jpg|jpeg|png|webp)$') THEN 'image' END AS kind FROM files""")
def upload_kinds(spark, sf):
    return _files(spark, sf).select("page_id", intake.upload_kind(F.col("filename"), F.col("content_type")).alias("kind"))


@query(f"""WITH {_FILES},
r AS (SELECT page_id, CAST(sum(size) OVER (PARTITION BY case_id ORDER BY file_pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM files)
SELECT page_id, used, used > 20000 AS too_large FROM r""")
def upload_budget(spark, sf):
    return intake.over_budget(_files(spark, sf), 20_000).select("page_id", "used", "too_large")


@query(f"""WITH {_FILES},
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, filename, size // 1000, page_id % 2 ORDER BY file_pos) AS nth FROM files)
SELECT page_id, case_id, filename FROM r WHERE nth = 1""")
def merge_files(spark, sf):
    files = _files(spark, sf).withColumns({"size": F.floor(F.col("size") / 1000), "modified": F.col("page_id") % 2})
    return intake.merged_files(files).select("page_id", "case_id", "filename")


def _sessions_sql(seconds: int) -> str:
    return f"""g AS (SELECT user_id AS session_key, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < {seconds * 1000000} THEN 0 ELSE 1 END AS new
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(new) OVER (PARTITION BY session_key ORDER BY ts) AS no FROM g),
found AS (SELECT session_key, CAST(no AS BIGINT) AS session_no, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM n GROUP BY 1, 2)"""


def _sessions(spark, sf, seconds):
    return intake.sessions(src.table(spark, sf, "events").select(F.col("user_id").alias("session_key"), "ts"), seconds)


@query(f"WITH {_sessions_sql(21600)} SELECT session_key, session_no, n, epoch_us(first_ts) AS first_us, epoch_us(last_ts) AS last_us FROM found")
def session_activity(spark, sf):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return _sessions(spark, sf, 21_600).select("session_key", "session_no", "n", us("first_ts").alias("first_us"), us("last_ts").alias("last_us"))


@query(f"""WITH {_sessions_sql(900)},
s AS (SELECT epoch_us(first_ts) AS moment, 1 AS d FROM found UNION ALL SELECT epoch_us(last_ts) + 900000000, -1 FROM found),
r AS (SELECT moment, sum(d) OVER (ORDER BY moment, d ROWS UNBOUNDED PRECEDING) AS live, moment // 86400000000 AS day, sum(d) OVER (PARTITION BY moment // 86400000000) AS c FROM s),
b AS (SELECT day, max(live) AS peak, max(c) AS c FROM r GROUP BY 1),
e AS (SELECT *, coalesce(sum(c) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT DATE '1970-01-01' + CAST(day AS INTEGER) AS day, CAST(greatest(peak, before) AS BIGINT) AS live, greatest(peak, before) > 8 AS full_up FROM e""")
def session_capacity(spark, sf):
    return intake.concurrency(_sessions(spark, sf, DEFAULT.session_seconds), DEFAULT.session_seconds).withColumn("full_up", F.col("live") > DEFAULT.most_sessions)


@query("SELECT user_id AS run_id, arg_max(event_type, (epoch_us(ts), event_id)) AS status, epoch_us(max(ts)) AS at_us FROM events GROUP BY 1")
def job_status_latest(spark, sf):
    rows = intake.latest_status(src.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), "event_id", F.col("event_type").alias("status")))
    return rows.select("run_id", "status", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"))


from . import evaluation, flow, pages, readings, results  # noqa: E402, F401  (they register their queries)
