"""The inputs of ``sources.tables`` and the steps that queries share, as named parts of SQL."""

from __future__ import annotations

from ..config import TEST_WORDS

TIMES = ("clock_in", "break_start", "break_end", "clock_out")
TIME = r"^(\d{1,2})\s*[:hH.]\s*(\d{2})$"


def clock(x: str) -> str:
    h, m = (f"TRY_CAST(regexp_extract(trim({x}), '{TIME}', {k}) AS INTEGER)" for k in (1, 2))
    return f"(CASE WHEN {h} <= 23 AND {m} <= 59 THEN lpad({h}::VARCHAR, 2, '0') || ':' || lpad({m}::VARCHAR, 2, '0') END)"


def date(x: str) -> str:
    return rf"(CASE WHEN regexp_matches(trim({x}), '^\d{{4}}-\d{{1,2}}-\d{{1,2}}$') THEN strftime(try_strptime(trim({x}), '%Y-%m-%d'), '%Y-%m-%d') WHEN regexp_matches(trim({x}), '^\d{{1,2}}/\d{{1,2}}/\d{{4}}$') THEN strftime(try_strptime(trim({x}), '%d/%m/%Y'), '%Y-%m-%d') END)"


def month(x: str) -> str:
    iso, br = r"^(\d{4})-(\d{1,2})$", r"^(\d{1,2})/(\d{4})$"
    y = f"(CASE WHEN regexp_matches(trim({x}), '{iso}') THEN regexp_extract(trim({x}), '{iso}', 1) WHEN regexp_matches(trim({x}), '{br}') THEN regexp_extract(trim({x}), '{br}', 2) END)"
    m = f"TRY_CAST(CASE WHEN regexp_matches(trim({x}), '{iso}') THEN regexp_extract(trim({x}), '{iso}', 2) WHEN regexp_matches(trim({x}), '{br}') THEN regexp_extract(trim({x}), '{br}', 1) END AS INTEGER)"
    return f"(CASE WHEN {m} BETWEEN 1 AND 12 THEN {y} || '-' || lpad({m}::VARCHAR, 2, '0') END)"


def minutes(x: str) -> str:
    return f"(CAST({x}[1:2] AS INTEGER) * 60 + CAST({x}[4:5] AS INTEGER))"


def fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def label_key(x: str) -> str:
    return rf"regexp_replace({fold(f'trim({x})')}, '\s+', ' ', 'g')"


def slug(x: str) -> str:
    return f"coalesce(nullif(left(trim(regexp_replace({fold(x)}, '[^a-z0-9]+', '_', 'g'), '_'), 40), ''), 'verba')"


PAGES = """pages AS (
  SELECT source || '/' || (doc_id // 1000) AS case_id, row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) AS page_number, coalesce(text, '') AS text, doc_id
  FROM documents)"""
TOC = """toc AS (
  SELECT 'src' || (item_id % 20) || '/' || (item_id // 100) AS case_id, item_id // 20 % 5 * 3 + 1 AS page_number, text AS title, item_id
  FROM benchmark)"""


def signals(config) -> str:
    """Pages with the signals of ``config``; its patterns may hold no quotes."""
    words = [*config.strong, *config.weak]
    found = lambda ws: " + ".join(f"contains(f, '{w}')::INT" for w in ws)
    names = ", ".join(f"CASE WHEN contains(f, '{w}') THEN '{w}' END" for w in words)
    hits = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in config.patterns)
    marked = " OR ".join(f"contains(f, '{m}')" for m in config.markers)
    return f"""{PAGES}, {TOC},
hits AS (SELECT DISTINCT case_id, page_number FROM toc WHERE regexp_matches({fold('title')}, '{'|'.join(words)}')),
read AS (SELECT *, {fold('text')} AS f FROM pages),
counted AS (
  SELECT r.case_id, r.page_number, r.doc_id, {found(config.strong)} AS strong, {found(config.weak)} AS weak, concat_ws('|', {names}) AS keywords,
    {hits} AS patterns, {marked} AS calculation, contains(text, '|') AS table_hint, length(text) / 484704.0::DOUBLE AS density, h.case_id IS NOT NULL AS in_toc,
    length(regexp_replace(text, '\\s', '', 'g')) <= {config.most_visual_text} AS little_text
  FROM read r LEFT JOIN hits h ON r.case_id = h.case_id AND r.page_number = h.page_number),
signals AS (
  SELECT *, NOT calculation AND (strong > 0 OR patterns >= {config.least_patterns} OR in_toc) AS is_primary,
    300.0::DOUBLE * strong + 50.0::DOUBLE * weak + 10.0::DOUBLE * least(patterns, 20) + 30.0::DOUBLE * in_toc::INT + 10.0::DOUBLE * density AS score
  FROM counted)"""


def neighbors(config) -> str:
    return f"""{signals(config)},
beside AS (
  SELECT *, coalesce(lag(is_primary AND keywords <> '') OVER w, false) OR coalesce(lead(is_primary AND keywords <> '') OVER w, false) AS b
  FROM signals WINDOW w AS (PARTITION BY case_id ORDER BY page_number)),
near AS (
  SELECT * REPLACE (CASE WHEN b AND NOT calculation AND NOT is_primary AND patterns > 0 AND keywords = '' THEN 5.0::DOUBLE ELSE score END AS score),
    b AND NOT calculation AND NOT is_primary AND patterns > 0 AND keywords = '' AS neighbor
  FROM beside)"""


SIGNALS, NEIGHBORS = signals(TEST_WORDS), neighbors(TEST_WORDS)

CARDS = """raw AS (
  SELECT user_id AS case_id, strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 END AS source_page,
    lpad((min(hour(ts)) // 6 * 6)::VARCHAR, 2, '0') AS h1, lpad((max(hour(ts)) // 6 * 6)::VARCHAR, 2, '0') AS h2, count(*) AS n, min(event_id) AS k, min(value) AS v
  FROM events GROUP BY 1, 2, 3),
cards AS (
  SELECT case_id, source_page, k, row_number() OVER (PARTITION BY case_id ORDER BY day, source_page) AS row_no,
    CASE WHEN k % 11 = 0 THEN strftime(CAST(day AS DATE), '%-d/%-m/%Y') WHEN k % 23 = 0 THEN day || 'x' ELSE day END AS date_raw,
    CASE WHEN k % 13 = 0 THEN '25:00' WHEN k % 7 = 0 THEN h1 || 'h05' ELSE h1 || ':05' END AS clock_in,
    CASE WHEN n > 1 THEN h1 || ':40' END AS break_start,
    CASE WHEN n > 1 AND k % 5 <> 0 THEN h2 || ':50' END AS break_end,
    CASE WHEN k % 9 <> 0 THEN h2 || ':55' END AS clock_out,
    CAST(floor(v * 100) AS BIGINT) % 100 / 100.0::DOUBLE AS confidence
  FROM raw)"""
_ok = ", ".join(f"{clock(t)} AS {t}_ok" for t in TIMES)
_unread = ", ".join(f"CASE WHEN {t} IS NOT NULL AND {t}_ok IS NULL THEN '{t}' END" for t in TIMES)
_given = ", ".join(f"CASE WHEN {t}_ok IS NOT NULL THEN '{t}' END" for t in TIMES)
_absent = ", ".join(f"CASE WHEN {a}_ok IS NULL AND {b}_ok IS NOT NULL AND NOT list_contains(amb, '{a}') THEN '{a}' WHEN {b}_ok IS NULL AND {a}_ok IS NOT NULL AND NOT list_contains(amb, '{b}') THEN '{b}' END" for a, b in (("clock_in", "clock_out"), ("break_start", "break_end")))
VALID = f"""{CARDS},
norm AS (SELECT *, {date('date_raw')} AS date, {_ok} FROM cards),
flagged AS (SELECT *, list_filter([CASE WHEN date IS NULL THEN 'date' END, {_unread}], lambda x: x IS NOT NULL) AS amb,
    list_filter([{', '.join(minutes(f'{t}_ok') for t in TIMES)}], lambda x: x IS NOT NULL) AS m FROM norm),
wrapped AS (SELECT *, list_filter([{_absent}], lambda x: x IS NOT NULL) AS missing, list_filter([{_given}], lambda x: x IS NOT NULL) AS given,
    len(list_filter(range(2, len(m) + 1), lambda i: m[i] < m[i - 1])) AS wraps FROM flagged),
valid AS (SELECT case_id, row_no, source_page, confidence, date, coalesce(date, date_raw) AS day_key, {', '.join(f'{t}_ok AS {t}' for t in TIMES)}, missing,
    CASE WHEN len(m) < 2 OR (wraps <= 1 AND m[-1] + 1440 * wraps - m[1] < 1440) THEN amb ELSE list_concat(amb, list_filter(given, lambda x: NOT list_contains(amb, x))) END AS ambiguous
  FROM wrapped)"""


def reconciled(rows: str, group: str, value: str) -> str:
    """``rec`` with kept and disputed, of a named relation."""
    return f"""keyed AS (SELECT *, {value} AS value_key FROM {rows}),
spread AS (SELECT *, min(source_page) OVER g <> max(source_page) OVER g AS on_pages, min(value_key) OVER g <> max(value_key) OVER g AS many_values,
    first_value(source_page) OVER (PARTITION BY case_id, {group}, value_key ORDER BY confidence DESC, source_page) AS best_page
  FROM keyed WINDOW g AS (PARTITION BY case_id, {group})),
picked AS (SELECT *, NOT on_pages OR source_page = best_page AS kept FROM spread),
rec AS (SELECT *, on_pages AND many_values AND min(CASE WHEN kept THEN source_page END) OVER g <> max(CASE WHEN kept THEN source_page END) OVER g AS disputed
  FROM picked WINDOW g AS (PARTITION BY case_id, {group}))"""


DAY_VALUE = "concat_ws('/', " + ", ".join(f"coalesce({t}, '-')" for t in TIMES) + ")"
REC_CARDS = f"{VALID}, {reconciled('valid', 'day_key', DAY_VALUE)}"

SLIPS = """slips AS (
  SELECT l_suppkey AS case_id, CASE WHEN l_orderkey % 4 = 0 THEN strftime(l_shipdate, '%-m/%Y') ELSE strftime(l_shipdate, '%Y-%m') END AS competence,
    CASE WHEN l_linenumber % 3 = 0 THEN ' ' || lower(p_type) WHEN l_linenumber % 3 = 1 THEN upper(p_type[1]) || lower(p_type[2:]) ELSE p_type END AS item_name,
    l_extendedprice AS amount, CASE WHEN l_partkey % 4 = 0 THEN 1000.0::DOUBLE + l_partkey % 3 END AS base_salary, l_linenumber AS source_page,
    CAST(1 - l_discount AS DECIMAL(4,2)) AS confidence,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN l_orderkey % 4 = 0 THEN strftime(l_shipdate, '%-m/%Y') ELSE strftime(l_shipdate, '%Y-%m') END, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS row_no
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
VALID_SLIPS = f"""{SLIPS},
vslips AS (SELECT * EXCLUDE (competence, item_name), coalesce({month('competence')}, competence) AS competence, trim(item_name) AS item_name, {label_key('item_name')} AS label_key, {month('competence')} IS NULL AS no_month FROM slips)"""
REC_SLIPS = f"{VALID_SLIPS}, {reconciled('vslips', 'competence, label_key', 'CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR)')}"

MARKS = """firsts AS (
  SELECT user_id AS case_id, CAST(ts AS DATE) AS day, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS slot, min(hour(ts)) AS h, min(event_id) AS k
  FROM events GROUP BY 1, 2, 3),
marks AS (
  SELECT case_id, day, slot, k AS cell_id, t0 AS first_read, CASE WHEN k % 6 = 0 THEN t1 ELSE t0 END AS reread_1, CASE WHEN k % 10 <> 0 THEN t0 END AS reread_2,
    CASE WHEN k % 4 = 0 THEN t1 WHEN k % 4 <> 3 THEN t0 END AS model_read, isodow(day) - 1 AS weekday, k,
    month(day) AS page_number, (case_id + month(day)) % 3 <> 0 AS confirmed, k % 9 = 0 AS single_mark
  FROM (SELECT *, lpad(h::VARCHAR, 2, '0') || ':' || lpad((k % 60)::VARCHAR, 2, '0') AS t0, lpad(((h + 1) % 24)::VARCHAR, 2, '0') || ':' || lpad((k % 60)::VARCHAR, 2, '0') AS t1 FROM firsts))"""
SCHEDULE = f"""{MARKS},
samples AS (SELECT case_id, weekday, list_sort(list({minutes('first_read')}) FILTER (slot = 0)) AS a, list_sort(list({minutes('first_read')}) FILTER (slot = 1)) AS b FROM marks GROUP BY 1, 2),
schedule AS (SELECT case_id, weekday, a[len(a) // 2 + 1] AS in_min, b[len(b) // 2 + 1] AS out_min FROM samples WHERE len(a) >= 3 AND len(b) >= 3)"""
RESOLVED = f"""{SCHEDULE},
agreed AS (
  SELECT m.*, CASE WHEN first_read = reread_1 AND first_read = reread_2 THEN first_read END AS agreed, CASE WHEN slot = 0 THEN in_min ELSE out_min END AS usual
  FROM marks m LEFT JOIN schedule s ON m.case_id = s.case_id AND m.weekday = s.weekday),
near_usual AS (SELECT *, agreed IS NOT NULL AND coalesce(abs({minutes('agreed')} - usual) <= 75, true) AS local, coalesce(abs({minutes('model_read')} - usual) <= 75, false) AS model_near FROM agreed),
resolved AS (SELECT *, CASE WHEN local AND NOT coalesce(model_read <> agreed, false) THEN 'local' WHEN NOT local AND model_near THEN 'model' END AS source,
    CASE WHEN local AND NOT coalesce(model_read <> agreed, false) THEN agreed WHEN NOT local AND model_near THEN model_read END AS value FROM near_usual)"""

SHIFTS = f"""{REC_CARDS},
paired AS (
  SELECT *, CASE WHEN break_start IS NOT NULL OR break_end IS NOT NULL THEN [[clock_in, break_start], [break_end, clock_out]] ELSE [[clock_in, clock_out]] END AS pairs
  FROM rec WHERE kept AND date IS NOT NULL AND NOT list_contains(ambiguous, 'date')),
shifts AS (
  SELECT *, list_filter(pairs, lambda p: p[1] IS NOT NULL AND p[2] IS NOT NULL) AS complete, len(list_filter(pairs, lambda p: (p[1] IS NULL) <> (p[2] IS NULL))) AS incomplete,
    {' + '.join(f"(list_contains(ambiguous, '{t}') AND {t} IS NULL)::INT" for t in TIMES)} AS unread
  FROM paired),
daily AS (SELECT case_id, date, flatten(list(complete ORDER BY row_no)) AS s, sum(incomplete + unread) AS half FROM shifts GROUP BY 1, 2),
workdays AS (
  SELECT case_id, date, len(s) AS n_shifts, greatest(len(s) - 6, 0) AS dropped, len(s) = 0 AND half > 0 AS omitted,
    strftime(CAST(date AS DATE), '%d/%m/%Y') || ';' || array_to_string(list_concat(flatten(s[1:6]), list_transform(range(0, 12 - 2 * least(len(s), 6)), lambda i: '')), ';') AS line
  FROM daily)"""
