"""The whole job as queries: pages of the documents, answers that say what each page's number gives, rows, conflicts and exported lines."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..config import TEST_WORDS
from ..operators import flow
from . import inputs_sql as S
from .catalog import _signals
from .registry import SQL, long, query


def _ask(asked):
    """A stand-in for the model: pages whose number 11 divides get no answer, of four pages one is a payslip; a day comes again 28 pages on, mostly with the same times."""
    p = F.col("page_number")
    two = lambda x: F.format_string("%02d", x.cast("int"))
    day = F.struct(
        F.concat(F.lit("2024-01-"), two(1 + p % 28)).alias("date"), F.when(p % 2 == 0, "08:00").otherwise("08h05").alias("clock_in"), F.when(p % 5 != 0, "17:00").alias("clock_out"), F.lit("0.9").alias("confidence"))
    item = F.struct(
        F.concat(F.lit("2024-"), two(1 + p % 9)).alias("competence"), F.concat(F.lit("Item "), (p % 3).cast("string")).alias("item_name"), F.concat(p.cast("string"), F.lit(".50")).alias("amount"), F.lit("0.8").alias("confidence"))
    slip = p % 4 == 3
    page = F.struct(
        p.cast("string").alias("page_number"), F.when(slip, "HOLERITE").otherwise("CARTAO_PONTO").alias("document_type"), F.lit(0.9).alias("confidence"),
        F.when(~slip, F.array(day)).alias("time_cards"), F.when(slip, F.array(item)).alias("payslips"))
    rows = asked.where(p % 11 != 0).groupBy("case_id", "call").agg(F.array_join(F.array_sort(F.collect_list(F.to_json(page))), ",").alias("pages"))
    return rows.select("case_id", "call", F.concat(F.lit('```json\n{"pages":['), "pages", F.lit("]}\n```")).alias("answer"))


def _job(spark, sf):
    return flow.run(_signals(spark, sf), _ask, TEST_WORDS)


_FLOW_CARDS = f"""r AS ({SQL['triage_candidates']}),
sent AS (SELECT case_id, page_number AS p, (row_number() OVER (PARTITION BY case_id ORDER BY page_number) - 1) // 5 AS call FROM r WHERE NOT overflow),
cards AS (
  SELECT case_id, p AS source_page, row_number() OVER (PARTITION BY case_id ORDER BY p) AS row_no, '2024-01-' || lpad((1 + p % 28)::VARCHAR, 2, '0') AS date_raw,
    CASE WHEN p % 2 = 0 THEN '08:00' ELSE '08h05' END AS clock_in, NULL::VARCHAR AS break_start, NULL::VARCHAR AS break_end, CASE WHEN p % 5 <> 0 THEN '17:00' END AS clock_out, 0.9::DOUBLE AS confidence
  FROM sent WHERE p % 11 <> 0 AND p % 4 <> 3)"""
_FLOW_SLIPS = """slips AS (
  SELECT case_id, p AS source_page, row_number() OVER (PARTITION BY case_id ORDER BY p) AS row_no, '2024-' || lpad((1 + p % 9)::VARCHAR, 2, '0') AS competence, 'Item ' || (p % 3) AS item_name,
    p + 0.5::DOUBLE AS amount, NULL::DOUBLE AS base_salary, 0.8::DOUBLE AS confidence
  FROM sent WHERE p % 11 <> 0 AND p % 4 = 3)"""
_OWN = re.sub(r"\b(keyed|spread|picked|rec)\b", r"s\1", S.REC_SLIPS.replace(S.SLIPS, _FLOW_SLIPS))
_FLOW = f"""{S.SHIFTS.replace(S.CARDS, _FLOW_CARDS)}, {_OWN},
conflict AS (SELECT DISTINCT case_id, day_key AS of FROM rec WHERE kept AND disputed UNION ALL SELECT DISTINCT case_id, competence || '|' || label_key FROM srec WHERE kept AND disputed),
lines AS (SELECT case_id, date, line FROM workdays WHERE NOT omitted AND case_id NOT IN (SELECT case_id FROM conflict))"""


@query(f"WITH {_FLOW} SELECT case_id, date, line FROM lines")
def flow_lines(spark, sf):
    """What a job exports of all cases: from the documents' pages through triage, calls, answers, validation and the gate."""
    return _job(spark, sf).lines


@query(f"""WITH {_FLOW},
a AS (SELECT case_id, count(*) AS sent, count(DISTINCT call) AS calls FROM sent GROUP BY 1),
u AS (SELECT case_id, count(*) AS unclassified FROM (SELECT case_id FROM sent WHERE p % 11 = 0 UNION ALL SELECT case_id FROM r WHERE overflow) GROUP BY 1),
b AS (SELECT case_id, count(*) AS time_cards FROM rec WHERE kept GROUP BY 1), c AS (SELECT case_id, count(*) AS payslips FROM srec WHERE kept GROUP BY 1),
d AS (SELECT case_id, count(*) AS conflicts FROM conflict GROUP BY 1), e AS (SELECT case_id, count(*) AS lines FROM lines GROUP BY 1)
SELECT case_id, sent, calls, coalesce(unclassified, 0) AS unclassified, coalesce(time_cards, 0) AS time_cards, coalesce(payslips, 0) AS payslips, coalesce(conflicts, 0) AS conflicts, coalesce(lines, 0) AS lines
FROM a LEFT JOIN u USING (case_id) LEFT JOIN b USING (case_id) LEFT JOIN c USING (case_id) LEFT JOIN d USING (case_id) LEFT JOIN e USING (case_id)""")
def flow_cases(spark, sf):
    return flow.case_counts(_job(spark, sf)).select("case_id", *long("sent", "calls", "unclassified", "time_cards", "payslips", "conflicts", "lines"))
