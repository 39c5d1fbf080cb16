"""Queries of whole results: rows from model answers, validation of a case, conflicts, saved reviews."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import answers, cells, records, results, review, triage
from ..sources import tables as src
from ..sources.files import kept
from . import inputs_sql as S
from .registry import DEFAULT, long, query

# Model answers: a conversation is a case, its turns are pages asked in calls of five. What a page holds follows from the
# length of its text: rows with and without faults, faulty pages, pages that were not asked, lists and conflicts.


def _asked(spark, sf):
    rows = src.table(spark, sf, "conversations").select(F.col("conv_id").alias("case_id"), (F.col("turn") + 1).cast("int").alias("page_number"), F.length("text").alias("n"))
    return triage.batches(rows, DEFAULT.pages_per_call)


def _text(x):
    return x.cast("string")


def _answers(asked):
    n, p = F.col("n"), F.col("page_number")
    upto = lambda k: F.when(n % k > 0, F.sequence(F.lit(1), (n % k).cast("int"))).otherwise(F.array().cast("array<int>"))
    two = lambda x: F.format_string("%02d", x.cast("int"))
    day = lambda i: F.when((n + i) % 9 != 0, F.concat(F.lit("2024-"), two(1 + n % 12), F.lit("-"), two(1 + (n + i) % 28)))
    days = F.transform(upto(4), lambda i: F.struct(
        day(i).alias("date"), F.lit("08:00").alias("clock_in"), F.when(i % 2 == 0, F.concat(F.lit("17:0"), _text(i))).alias("clock_out"), F.lit(999).alias("source_page"),
        F.when((n + i) % 6 == 0, "1.5").otherwise("0.9").alias("confidence")))
    items = F.transform(upto(3), lambda i: F.struct(
        F.concat(F.lit("2024-"), two(1 + n % 12)).alias("competence"), F.concat(F.lit("Item "), _text(i)).alias("item_name"),
        F.when((n + i) % 8 == 0, "x").otherwise(_text((n * i / 4).cast("decimal(18,2)"))).alias("amount"), F.lit("0.8").alias("confidence")))
    conflict = F.struct(F.when(n % 6 != 0, F.concat(F.lit("pages["), _text(p), F.lit("]"))).alias("field"), F.array(F.parse_json(_text(n)), F.parse_json(F.concat(F.lit('"'), _text(n), F.lit('"'))), F.parse_json(F.lit('{"a":null}'))).alias("values"), F.array(p).alias("source_pages"))
    page = F.struct(
        F.when(n % 13 == 0, p + 90).otherwise(p).alias("page_number"), F.when(n % 5 == 0, "carta").when(n % 2 == 0, "HOLERITE").otherwise("CARTAO_PONTO").alias("document_type"),
        F.when(n % 7 == 0, 2.0).otherwise((n % 100) / 100.0).alias("confidence"), days.alias("time_cards"), items.alias("payslips"),
        F.when(n % 3 == 0, F.array(F.lit("clock_in"), F.lit("date"))).alias("missing_fields"), F.when(n % 4 == 0, F.array(F.lit("amount"))).alias("ambiguous_fields"),
        F.when(n % 3 == 1, F.array(conflict)).alias("conflicts"))
    rows = asked.where(n % 11 != 0).groupBy("case_id", "call").agg(F.array_sort(F.collect_list(F.struct("page_number", F.to_json(page).alias("p")))).alias("all"))
    return rows.select("case_id", "call", F.concat(F.lit("```json\n"), F.lit('{"pages":['), F.array_join(F.transform("all", lambda x: x["p"]), ","), F.lit("]}\n```")).alias("answer"))


def _pages(spark, sf):
    asked = _asked(spark, sf)
    return results.model_pages(asked, _answers(asked))


_GOOD = """asked AS (SELECT conv_id AS case_id, turn + 1 AS page_number, length(text) AS n FROM conversations),
good AS (SELECT * FROM asked WHERE n % 11 <> 0 AND n % 5 <> 0 AND n % 7 <> 0 AND n % 13 <> 0)"""
_DAYS = f"""{_GOOD},
days AS (
  SELECT case_id, page_number AS source_page, i - 1 AS pos, '2024-' || lpad((1 + n % 12)::VARCHAR, 2, '0') || '-' || lpad((1 + (n + i) % 28)::VARCHAR, 2, '0') AS date,
    CASE WHEN i % 2 = 0 THEN '17:0' || i END AS clock_out
  FROM (SELECT *, unnest(range(1, n % 4 + 1)) AS i FROM good WHERE n % 2 = 1) WHERE (n + i) % 9 <> 0 AND (n + i) % 6 <> 0)"""


@query(f"""WITH {_DAYS} SELECT case_id, CAST(source_page AS BIGINT) AS source_page, CAST(pos AS BIGINT) AS pos, date, '08:00' AS clock_in, clock_out, 0.9::DOUBLE AS confidence FROM days""")
def model_rows_time_cards(spark, sf):
    rows = results.time_card_rows(_pages(spark, sf))
    return rows.select("case_id", *long("source_page", "pos"), F.col("date_raw").alias("date"), "clock_in", "clock_out", "confidence")


@query(f"""WITH {_GOOD} SELECT case_id, CAST(page_number AS BIGINT) AS source_page, CAST(i - 1 AS BIGINT) AS pos, '2024-' || lpad((1 + n % 12)::VARCHAR, 2, '0') AS competence,
  'Item ' || i AS item_name, CAST(CAST(n * i AS DECIMAL(18,2)) / 4 AS DOUBLE) AS amount
FROM (SELECT *, unnest(range(1, n % 3 + 1)) AS i FROM good WHERE n % 2 = 0) WHERE (n + i) % 8 <> 0""")
def model_rows_payslips(spark, sf):
    return results.payslip_rows(_pages(spark, sf)).select("case_id", *long("source_page", "pos"), "competence", "item_name", "amount")


_PAGE_FLAGS = f"""{_GOOD},
page_flags AS (
  SELECT case_id, page_number AS source_page, 'missing' AS kind, k AS pos, CASE k WHEN 0 THEN 'clock_in' ELSE 'date' END AS flag FROM good, range(0, 2) t(k) WHERE n % 3 = 0
  UNION ALL SELECT case_id, page_number, 'ambiguous', 0, 'amount' FROM good WHERE n % 4 = 0)"""
_STATED = f"""{_PAGE_FLAGS},
stated AS (
  SELECT case_id, page_number AS source_page, 'pages[' || page_number || ']' AS field, '[' || n || ',"' || n || '",{{"a":null}}]' AS found_values, page_number::VARCHAR AS source_pages
  FROM good WHERE n % 3 = 1 AND n % 6 <> 0)"""


@query(f"WITH {_PAGE_FLAGS} SELECT case_id, CAST(source_page AS BIGINT) AS source_page, kind, CAST(pos AS BIGINT) AS pos, flag FROM page_flags")
def model_page_flags(spark, sf):
    return results.page_flags(_pages(spark, sf)).select("case_id", *long("source_page"), "kind", *long("pos"), "flag")


@query(f"WITH {_STATED} SELECT case_id, CAST(source_page AS BIGINT) AS source_page, field, found_values, source_pages FROM stated")
def model_conflicts(spark, sf):
    return results.model_conflicts(_pages(spark, sf)).select("case_id", *long("source_page"), "field", "found_values", "source_pages")


@query(f"""WITH {_DAYS}, {S.RESOLVED},
l AS (SELECT case_id, strftime(day, '%Y-%m-%d') AS date, max(CASE WHEN slot = 0 THEN value END) AS clock_in, max(CASE WHEN slot = 1 THEN value END) AS clock_out,
  bool_or(value IS NULL) AS open, bool_or(coalesce(source = 'model', false)) AS m FROM resolved GROUP BY ALL)
SELECT case_id, date, '08:00' AS clock_in, clock_out, 0.9::DOUBLE AS confidence, 'model' AS origin FROM days
UNION ALL SELECT case_id, date, clock_in, clock_out, CASE WHEN open THEN 0.3::DOUBLE WHEN m THEN 0.85::DOUBLE ELSE 0.95::DOUBLE END, 'local' FROM l""")
def merged_time_cards(spark, sf):
    marks = src.marks(spark, sf)
    local = cells.entries(cells.resolved(marks, cells.schedule(marks, DEFAULT), DEFAULT), DEFAULT).withColumn("date_raw", F.date_format("day", "yyyy-MM-dd")).drop("day", "ambiguous")
    rows = results.with_local(results.time_card_rows(_pages(spark, sf)), local)
    return rows.select("case_id", F.col("date_raw").alias("date"), "clock_in", "clock_out", "confidence", "origin")


# Validation of whole results: time cards of a user, pay items of a supplier and answers of a conversation with one number are a case


def _result(spark, sf):
    """Validated rows, written once: conflicts, flags and counters all read them."""
    return tuple(kept(rows, "validated") for rows in results.validated(src.time_cards(spark, sf), src.payslips(spark, sf)))


def _stated(spark, sf):
    return results.model_conflicts(_pages(spark, sf)).select("case_id", F.col("source_page").alias("place"), "field", "found_values", "source_pages")


_RESULT = f"""{S.REC_CARDS.replace('keyed AS', 'ckeyed AS').replace('FROM keyed', 'FROM ckeyed').replace('spread AS', 'cspread AS').replace('FROM spread', 'FROM cspread')
  .replace('picked AS', 'cpicked AS').replace('FROM picked', 'FROM cpicked').replace('rec AS (', 'crec AS (')},
{S.REC_SLIPS}"""


@query(f"""WITH {_RESULT}
SELECT 'time_card' AS kind, case_id, CAST(row_no AS BIGINT) AS row_no, row_number() OVER (PARTITION BY case_id ORDER BY day_key, source_page, row_no) AS place FROM crec WHERE kept
UNION ALL SELECT 'payslip', case_id, row_no, row_number() OVER (PARTITION BY case_id ORDER BY competence, source_page, row_no) FROM rec WHERE kept""")
def validated_order(spark, sf):
    cards, slips = (rows.where("kept").select("case_id", *long("row_no", "place")) for rows in _result(spark, sf))
    kind = lambda k: F.lit(k).alias("kind")
    return cards.select(kind("time_card"), "*").union(slips.select(kind("payslip"), "*"))


_JSON_TIMES = "to_json({" + ", ".join(f"'{t}': {t}" for t in S.TIMES) + "})::VARCHAR"
_DERIVED_SLIPS = """ic AS (SELECT case_id, competence, label_key, CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR) AS j, min(row_no) AS r FROM rec WHERE kept AND disputed GROUP BY ALL),
iv AS (SELECT case_id, competence, label_key, '[' || string_agg(j, ',' ORDER BY r) || ']' AS found_values FROM ic GROUP BY ALL),
ip AS (SELECT case_id, competence, label_key, arg_min(item_name, row_no) AS item, array_to_string(list_sort(list(DISTINCT source_page)), ',') AS source_pages, min(row_no) AS r
  FROM rec WHERE kept AND disputed GROUP BY ALL),
sk AS (SELECT case_id, competence, CAST(CAST(base_salary AS DECIMAL(18,2)) AS VARCHAR) AS j, row_no, source_page FROM rec WHERE kept AND base_salary IS NOT NULL),
sf AS (SELECT case_id, competence, j, min(row_no) AS r FROM sk GROUP BY ALL),
sv AS (SELECT case_id, competence, '[' || string_agg(j, ',' ORDER BY r) || ']' AS found_values, count(*) AS n, min(r) AS r FROM sf GROUP BY ALL),
sp AS (SELECT case_id, competence, list_sort(list(DISTINCT source_page)) AS p FROM sk GROUP BY ALL),
from_slips AS (
  SELECT case_id, 2 AS part, ip.r, 'payslips[' || competence || '|' || item || ']' AS field, found_values, source_pages FROM iv JOIN ip USING (case_id, competence, label_key)
  UNION ALL SELECT case_id, 3, sv.r, 'payslips[' || competence || '].base_salary', found_values, array_to_string(p, ',') FROM sv JOIN sp USING (case_id, competence) WHERE n > 1 AND len(p) > 1)"""
_CONFLICTS = f"""{_RESULT}, {_STATED}, {_DERIVED_SLIPS},
dc AS (SELECT case_id, day_key, {_JSON_TIMES} AS j, min(row_no) AS r FROM crec WHERE kept AND disputed GROUP BY ALL),
dv AS (SELECT case_id, day_key, '[' || string_agg(j, ',' ORDER BY r) || ']' AS found_values, min(r) AS r FROM dc GROUP BY ALL),
dp AS (SELECT case_id, day_key, array_to_string(list_sort(list(DISTINCT source_page)), ',') AS source_pages FROM crec WHERE kept AND disputed GROUP BY ALL),
from_all AS (
  SELECT case_id, 0 AS part, source_page AS r, field, found_values, source_pages FROM stated
  UNION ALL SELECT case_id, 1, r, 'time_cards[' || day_key || ']', found_values, source_pages FROM dv JOIN dp USING (case_id, day_key)
  UNION ALL SELECT * FROM from_slips),
conflicts AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY part, r, field) AS seq, field, found_values, source_pages FROM from_all)"""


def _conflicts(spark, sf):
    return results.all_conflicts(_stated(spark, sf), *_result(spark, sf))


@query(f"WITH {_CONFLICTS} SELECT case_id, seq, field, found_values, source_pages FROM conflicts")
def validated_conflicts(spark, sf):
    return _conflicts(spark, sf).select("case_id", *long("seq"), "field", "found_values", "source_pages")


@query(f"""WITH {_RESULT}, {_PAGE_FLAGS},
c AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY day_key, source_page, row_no) AS place FROM crec WHERE kept),
s AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY competence, source_page, row_no) AS place FROM rec WHERE kept),
u AS (
  SELECT case_id, kind, 0 AS part, source_page * 10 + pos AS place, 0 AS pos, flag FROM page_flags
  UNION ALL SELECT case_id, 'missing', 1, place, generate_subscripts(missing, 1), unnest(missing) FROM c
  UNION ALL SELECT case_id, 'ambiguous', 1, place, generate_subscripts(ambiguous, 1), unnest(ambiguous) FROM c
  UNION ALL SELECT case_id, 'ambiguous', 2, place, 0, 'competence' FROM s WHERE no_month),
f AS (SELECT case_id, kind, flag, min((part, place, pos)) AS spot FROM u GROUP BY ALL)
SELECT case_id, coalesce(string_agg(flag, ',' ORDER BY spot) FILTER (kind = 'missing'), '') AS missing, coalesce(string_agg(flag, ',' ORDER BY spot) FILTER (kind = 'ambiguous'), '') AS ambiguous
FROM f GROUP BY case_id""")
def result_flags(spark, sf):
    stated = results.page_flags(_pages(spark, sf)).select("case_id", "kind", (F.col("source_page") * 10 + F.col("pos")).alias("place"), "flag")
    found = results.result_flags(stated, *_result(spark, sf))
    return found.select("case_id", F.array_join("missing", ",").alias("missing"), F.array_join("ambiguous", ",").alias("ambiguous"))


@query(f"""WITH {_CONFLICTS},
a AS (SELECT case_id, count(*) FILTER (kept) AS time_cards, count(*) FILTER (NOT kept) AS d1, count(*) FILTER (kept AND len(missing) + len(ambiguous) > 0) AS f1 FROM crec GROUP BY 1),
b AS (SELECT case_id, count(*) FILTER (kept) AS payslips, count(*) FILTER (NOT kept) AS d2, count(*) FILTER (kept AND no_month) AS f2 FROM rec GROUP BY 1),
n AS (SELECT case_id, count(*) AS conflicts FROM conflicts GROUP BY 1)
SELECT case_id, coalesce(time_cards, 0) AS time_cards, coalesce(payslips, 0) AS payslips, coalesce(d1, 0) + coalesce(d2, 0) AS duplicates_removed, coalesce(f1, 0) + coalesce(f2, 0) AS flagged,
  coalesce(conflicts, 0) AS conflicts FROM a FULL JOIN b USING (case_id) FULL JOIN n USING (case_id)""")
def validate_result(spark, sf):
    """The counters of each validated case; rows, conflicts and flags are queries of their own."""
    cards, slips = _result(spark, sf)
    return results.result_counts(cards, slips, results.all_conflicts(_stated(spark, sf), cards, slips))


@query(f"""WITH {_RESULT}, {_STATED}, {_DERIVED_SLIPS},
left_over AS (SELECT case_id, 0 AS part, source_page AS r, field, found_values, source_pages FROM stated UNION ALL SELECT * FROM from_slips)
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY part, r, field) AS seq, field, found_values, source_pages FROM left_over""")
def review_save(spark, sf):
    """The reviewer keeps the last page of each disputed day; what the model stated and what pay items still give stays open."""
    cards, slips = _result(spark, sf)
    conflicts = results.all_conflicts(_stated(spark, sf), cards, slips)
    stay = cards.where("kept")
    choices = stay.where("disputed").groupBy("case_id", "day_key").agg(F.max("source_page").alias("keep_page"))
    days = review.kept_pages(stay, choices, ["day_key"]).withColumn("date_raw", F.col("day_key"))
    days = days.select("case_id", "row_no", "source_page", "date_raw", *records.TIMES, "confidence", "missing", "ambiguous")
    items = slips.where("kept").select("case_id", "row_no", "source_page", "competence", "item_name", "amount", "base_salary", "confidence", "ambiguous")
    saved = results.saved_review(days, items, conflicts)[2]
    return saved.select("case_id", *long("seq"), "field", "found_values", "source_pages")


_FIELDS = r"""f AS (SELECT p_partkey, p_name AS item, CASE p_partkey % 7 WHEN 0 THEN 'time_cards[2024-01-0' || (p_partkey % 9) || ']' WHEN 1 THEN 'payslips[2024-01|a]' || p_name || ']'
    WHEN 2 THEN 'payslips[2024-0' || (1 + p_partkey % 9) || '].base_salary' WHEN 3 THEN 'time_cards[]' WHEN 4 THEN 'payslips[' || p_name || ']' WHEN 5 THEN 'payslips[2024-02|' || p_name || ']' ELSE p_name END AS field,
    CASE p_partkey % 3 WHEN 0 THEN (p_partkey - 100) || '.50' WHEN 1 THEN '{"clock_in":"08:0' || (p_partkey % 9) || '","break_start":null,"clock_out":"17:00"}' ELSE to_json(p_name)::VARCHAR END AS value FROM part)"""


@query(rf"""WITH {_FIELDS}, k AS (SELECT *, CASE WHEN regexp_full_match(field, 'payslips\[([^\]]+)\]\.base_salary') THEN 'base_salary' WHEN regexp_full_match(field, 'payslips\[([^|\]]+)\|(.+)\]') THEN 'payslip'
  WHEN regexp_full_match(field, 'time_cards\[([^\]]+)\]') THEN 'time_card' END AS kind FROM f)
SELECT p_partkey, field, kind, CASE kind WHEN 'time_card' THEN field[12:-2] WHEN 'base_salary' THEN split_part(field[10:], ']', 1) WHEN 'payslip' THEN split_part(field[10:], '|', 1) END AS day_or_month,
  CASE WHEN kind = 'payslip' THEN field[strpos(field, '|') + 1:-2] END AS item, kind IS NOT NULL AS derived, field || ':' || (p_partkey % 4) || ',' || (p_partkey % 4 + 3) AS conflict_key,
  CASE p_partkey % 3 WHEN 0 THEN CASE WHEN value[1:1] = '-' THEN '-' ELSE '' END || 'R$ ' || translate(format('{{:,.2f}}', abs(value::DOUBLE)), ',.', '.,')
    WHEN 1 THEN 'in: 08:0' || (p_partkey % 9) || ' · out: 17:00' ELSE k.item END AS label
FROM k""")
def conflict_fields(spark, sf):
    k, name, text = F.col("p_partkey"), F.col("p_name"), lambda x: x.cast("string")
    field = (
        F.when(k % 7 == 0, F.concat(F.lit("time_cards[2024-01-0"), text(k % 9), F.lit("]"))).when(k % 7 == 1, F.concat(F.lit("payslips[2024-01|a]"), name, F.lit("]")))
        .when(k % 7 == 2, F.concat(F.lit("payslips[2024-0"), text(1 + k % 9), F.lit("].base_salary"))).when(k % 7 == 3, "time_cards[]")
        .when(k % 7 == 4, F.concat(F.lit("payslips["), name, F.lit("]"))).when(k % 7 == 5, F.concat(F.lit("payslips[2024-02|"), name, F.lit("]"))).otherwise(name)
    )
    value = F.when(k % 3 == 0, F.concat(text(k - 100), F.lit(".50"))).when(k % 3 == 1, F.concat(F.lit('{"clock_in":"08:0'), text(k % 9), F.lit('","break_start":null,"clock_out":"17:00"}'))).otherwise(F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('\\"')), F.lit('"')))
    rows = src.table(spark, sf, "part").select("p_partkey", field.alias("field"), value.alias("value"), F.concat_ws(",", text(k % 4), text(k % 4 + 3)).alias("pages"))
    return rows.withColumn("c", results.conflict_field(F.col("field"))).select(
        "p_partkey", "field", "c.*", results.is_derived(F.col("field")).alias("derived"), results.conflict_key(F.col("field"), F.col("pages")).alias("conflict_key"), results.value_label(F.parse_json("value")).alias("label"))


@query(f"""WITH {_CONFLICTS}, v AS (SELECT case_id, seq, field, unnest(from_json(found_values, '["JSON"]')) AS v, generate_subscripts(from_json(found_values, '["JSON"]'), 1) AS place FROM conflicts)
SELECT case_id, seq, place, json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS is_number, CASE
  WHEN json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CASE WHEN v::DOUBLE < 0 THEN '-' ELSE '' END || 'R$ ' || translate(format('{{:,.2f}}', abs(v::DOUBLE)), ',.', '.,')
  WHEN json_type(v) = 'VARCHAR' THEN v ->> '$'
  WHEN coalesce(v ->> 'clock_in', v ->> 'clock_out', v ->> 'break_start', v ->> 'break_end') IS NULL
    THEN CASE WHEN list_contains(json_keys(v), 'clock_in') THEN '{{"break_end":null,"break_start":null,"clock_in":null,"clock_out":null}}' ELSE v::VARCHAR END
  ELSE concat_ws(' · ', 'in: ' || (v ->> 'clock_in'), 'out: ' || (v ->> 'clock_out'), 'int. start: ' || (v ->> 'break_start'), 'int. end: ' || (v ->> 'break_end')) END AS label FROM v""")
def conflict_value_labels(spark, sf):
    """Every value of every conflict of whole results, those of the model and derived ones, by its own type."""
    rows = _conflicts(spark, sf).select("case_id", *long("seq"), F.posexplode(results.typed_values(F.col("found_values"))).alias("place", "v"))
    number = F.schema_of_variant("v").rlike("^(BIGINT|DECIMAL|DOUBLE)").alias("is_number")
    return rows.select("case_id", "seq", (F.col("place") + 1).cast("bigint").alias("place"), number, results.value_label(F.col("v")).alias("label"))


@query(f"""WITH {S.VALID}, u AS (SELECT case_id, row_no, unnest(list_concat(missing, ambiguous)) AS flag FROM valid)
SELECT flag, CASE flag WHEN 'date' THEN 'data' WHEN 'clock_in' THEN 'entrada' WHEN 'clock_out' THEN 'saída' WHEN 'break_start' THEN 'início do intervalo' WHEN 'break_end' THEN 'fim do intervalo' END AS label,
  count(*) AS n FROM u GROUP BY 1, 2""")
def flag_labels(spark, sf):
    rows = records.valid_time_cards(src.time_cards(spark, sf)).select(F.explode(F.concat("missing", "ambiguous")).alias("flag"))
    return rows.groupBy("flag", results.field_label(F.col("flag")).alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH {S.VALID} SELECT case_id, array_to_string(list_sort(list(DISTINCT source_page)), ',') AS pages FROM valid WHERE list_contains(ambiguous, 'date') GROUP BY 1")
def unconfirmed_pages(spark, sf):
    rows = results.unconfirmed_pages(records.valid_time_cards(src.time_cards(spark, sf)))
    return rows.select("case_id", F.array_join("pages", ",").alias("pages"))


_SAID = ", ".join(f"'{k}': '{v}'" for k, v in results.NOTES.items())


@query(f"""WITH a AS (SELECT conv_id AS case_id, count(*) AS pages, count(*) FILTER (length(text) % 4 <> 0) AS candidates, count(*) FILTER (length(text) % 4 <> 0 AND length(text) % 3 = 0) AS classified,
  count(*) FILTER (length(text) % 4 <> 0 AND length(text) % 6 = 3) AS extracted FROM conversations GROUP BY 1),
n AS (SELECT case_id, CASE WHEN case_id % 10 = 0 THEN 'no_key' WHEN candidates = 0 THEN 'no_candidates' WHEN classified = 0 THEN 'unclassified' WHEN case_id % 3 = 0 AND extracted = 0 THEN 'all_pages_empty'
  WHEN pages <= 4 AND extracted = 0 THEN 'short_empty' WHEN case_id % 3 = 0 THEN 'all_pages' ELSE 'ranked' END AS note FROM a)
SELECT case_id, note, MAP {{{_SAID}}}[note] AS said FROM n""")
def pipeline_notes(spark, sf):
    n = F.length("text")
    rows = src.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(
        F.count("*").alias("pages"), F.count_if(n % 4 != 0).alias("candidates"), F.count_if((n % 4 != 0) & (n % 3 == 0)).alias("classified"), F.count_if((n % 4 != 0) & (n % 6 == 3)).alias("extracted"))
    rows = rows.withColumns({"has_key": F.col("case_id") % 10 != 0, "all_pages": F.col("case_id") % 3 == 0, "short_document": F.col("pages") <= 4})
    return rows.withColumn("note", results.pipeline_note()).select("case_id", "note", results.note_text(F.col("note")).alias("said"))


@query(f"""WITH {_GOOD} SELECT case_id, page_number FROM asked ANTI JOIN good USING (case_id, page_number)
UNION SELECT conv_id, turn + 101 FROM conversations WHERE turn % 3 = 0""")
def unclassified_pages(spark, sf):
    """Pages without a valid answer, and pages past the candidates that were never sent."""
    asked = _asked(spark, sf)
    overflow = src.table(spark, sf, "conversations").where("turn % 3 = 0").select(F.col("conv_id").alias("case_id"), (F.col("turn") + 101).alias("page_number"))
    return answers.unclassified(asked, answers.classified(asked, _answers(asked)), overflow).select("case_id", *long("page_number"))
