"""Cases of the operators that the driver's tables don't hold."""

import datetime as dt
import unicodedata
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.config import Config
from quire.functions import text as T
from quire.operators import cells, evaluate, export, flow, grid, intake, records, results, triage, visual
from quire.sources import case_files, files
from quire.streaming import evaluation as scoring
from quire.streaming import lifecycle
from quire.streaming import sessions as stream

TIME_CASES = {"08:00": "08:00", "8:00": "08:00", "8h00": "08:00", " 17.30 ": "17:30", "23:59": "23:59", "24:00": None, "08:60": None, "0800": None, "8": None, "x": None, "": None}
DATE_CASES = {"2024-03-04": "2024-03-04", "2024-3-4": "2024-03-04", "04/03/2024": "2024-03-04", "2024-02-30": None, "31/04/2024": None, "2024/03/04": None, "x": None}
MONTH_CASES = {"2024-03": "2024-03", "2024-3": "2024-03", "03/2024": "2024-03", "3/2024": "2024-03", "2024-13": None, "13/2024": None, "2024": None}
READ_CASES = {"8:05": "08:05", "1259": "12:59", "17300": "17:00", "O8;OO": "08:00", "0B:15": "08:15", "25:00": None, "12:61": None, "abc": None}
DAY_CASES = {"SEG": "SEG", "GUA": "QUA", "GUI": "QUI", "UA": "QUA", "SES": "SEG", "COM": "DOM", "Não": None, "X": None}
AMOUNT_CASES = {"3.500,00": 3500.0, "3500,5": 3500.5, "3500": 3500.0, " 1.234.567,89 ": 1234567.89, "-98,55": -98.55, "3,500.00": None, "35.00,00": None, "abc": None, "": None, "1,234": None}


@pytest.mark.parametrize("f, cases", [(T.normalized_time, TIME_CASES), (T.normalized_date, DATE_CASES), (T.normalized_month, MONTH_CASES), (T.read_time, READ_CASES), (T.read_weekday, DAY_CASES), (lambda c: T.parsed_br(c).cast("double"), AMOUNT_CASES)])
def test_scalars(spark, f, cases):
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", f(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == cases


def test_folding_is_the_decomposition_of_every_character(spark):
    """All assigned characters, alone and between others, against the standard library."""
    known = [chr(c) for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co")]
    some = [(c, f"x{c}Á{c}{c}") for c in known]
    got = spark.createDataFrame(some, "a string, b string").repartition(4).select("a", "b", T.folded(F.col("a")).alias("fa"), T.folded(F.col("b")).alias("fb")).collect()
    assert len(got) == len(known) > 140_000
    bad = [(r["a"], r["fa"]) for r in got if r["fa"] != T.fold(r["a"]) or r["fb"] != T.fold(r["b"])]
    assert not bad, (len(bad), bad[:20])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aÇ ﬁﬆＡ９½ºª…한글각é\u0301Ⅷ㎏ﷺ😀x", max_size=30), max_size=6))
def test_folding_of_texts(spark, some):
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(some)], "k int, t string").orderBy("k").select(T.folded(F.col("t"))).collect()]
    assert got == [T.fold(t) for t in some]


def test_keywords_in_ligatures_and_full_width(spark):
    df = spark.createDataFrame([("Diário oﬁcial, ＨＯＬＥＲＩＴＥ de ½ mês, 1ª via",)], "t string").select(T.folded(F.col("t")), T.label_key(F.lit(" Salário ＢＡＳＥ ")), T.slug(F.lit("Adicional ﬁxo 50％")))
    assert tuple(df.first()) == ("diario oficial, holerite de 1\u20442 mes, 1a via", "salario base", "adicional_fixo_50")


def test_folding_and_slugs(spark):
    row = spark.createDataFrame([("  Salário   BASE ", "Hóras/Éxtras 50% " * 5, "!!!")], "a string, b string, c string").select(T.label_key(F.col("a")), T.slug(F.col("a")), T.slug(F.col("b")), T.slug(F.col("c")), T.amount_br(F.lit(1234.5)), T.grouped_br(F.lit(1234567.5))).first()
    assert tuple(row) == ("salario base", "salario_base", ("horas_extras_50_" * 5)[:40], "verba", "1234,50", "1.234.567,50")


@pytest.mark.parametrize("times, valid", [("08:00 12:00 13:00 17:00", True), ("22:00 02:00 03:00 06:00", True), ("08:00 - - -", True), ("08:00 12:00 11:00 17:00", False), ("08:00 18:00 19:00 17:00", False)])
def test_chronology(spark, times, valid):
    columns = [F.lit(None if t == "-" else t).cast("string") for t in times.split()]
    assert spark.range(1).select(T.chronological(columns)).first()[0] is valid


CARD = "case_id int, row_no int, date_raw string, clock_in string, break_start string, break_end string, clock_out string, source_page int, confidence double"


def cards(spark, *rows):
    return spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], CARD)


def reconciled(spark, *values):
    """(clock_out, page, confidence) of one day: pages kept and conflicts."""
    rows = records.reconciled_time_cards(cards(spark, *[("2024-03-04", "08:00", None, None, out, page, conf) for out, page, conf in values]))
    return sorted(r["source_page"] for r in rows.where("kept").collect()), [(r["found_values"], r["source_pages"]) for r in records.conflicts(rows, ["day_key"]).collect()]


def test_reconciling(spark):
    assert reconciled(spark, ("17:00", 3, 0.6), ("17:00", 7, 0.95)) == ([7], [])
    assert reconciled(spark, ("17:00", 3, 0.9), ("18:00", 7, 0.9)) == ([3, 7], [("08:00/-/-/17:00; 08:00/-/-/18:00", "3,7")])
    assert reconciled(spark, ("17:00", 3, 0.9), ("18:00", 3, 0.9)) == ([3, 3], [])
    assert reconciled(spark, ("17:00", 3, 0.9), ("18:00", 3, 0.9), ("17:00", 7, 0.1)) == ([3, 3], [])
    assert reconciled(spark, ("17:00", 3, 0.1), ("18:00", 3, 0.9), ("17:00", 7, 0.9))[1] != []
    assert reconciled(spark, ("17:00", 3, 0.5), ("17:00", 7, 0.5)) == ([3], [])


def test_validation_is_idempotent(spark):
    rows = records.valid_time_cards(cards(spark, ("4/3/2024", "8h00", "12:00", None, "25:00", 1, 0.5), ("x", None, None, None, None, 1, 0.5), ("2024-03-05", "08:00", "12:00", "11:00", "17:00", 1, 0.5)))
    got = {r["row_no"]: (r["date"], r["missing"], r["ambiguous"]) for r in rows.collect()}
    assert got == {0: ("2024-03-04", ["break_end"], ["clock_out"]), 1: (None, [], ["date"]), 2: ("2024-03-05", [], ["clock_in", "break_start", "break_end", "clock_out"])}
    again = records.valid_time_cards(rows.drop("date", "missing", "ambiguous", "day_key"))
    assert [r["clock_in"] for r in again.orderBy("row_no").collect()] == [r["clock_in"] for r in rows.orderBy("row_no").collect()]


def test_workday_layout(spark):
    rows = records.valid_time_cards(cards(spark, ("2021-05-03", "08:00", "12:00", "13:00", "17:30", 1, 0.9), ("2021-05-04", None, None, None, None, 1, 0.9), ("2021-05-05", "08:00", None, None, None, 1, 0.9), *[("2021-05-06", f"{h:02d}:00", None, None, f"{h:02d}:30", 1, 0.9) for h in range(8, 16)]))
    days = export.workdays(rows, Config())
    assert [r["line"] for r in days.where("NOT omitted").orderBy("date").collect()] == ["03/05/2021;08:00;12:00;13:00;17:30" + ";" * 8, "04/05/2021" + ";" * 12, "06/05/2021;" + ";".join(f"{h:02d}:00;{h:02d}:30" for h in range(8, 14))]
    assert [(r["dropped"], r["omitted"]) for r in days.orderBy("date").collect()] == [(0, False), (0, False), (0, True), (2, False)]
    content = export.file_bytes(days.where("NOT omitted"), ["case_id"], "date", "Data", "ISO-8859-1").first()["content"]
    assert content.startswith(b"Data\r\n03/05/2021;08:00") and not content.endswith(b"\n") and content.count(b"\r\n") == 3


def test_histories(spark):
    rows = spark.createDataFrame([(1, 0, "2024-12", " Prêmio ", 1000.0, 500.0, 1, 0.9), (1, 1, "2024-12", "PREMIO", 244.5, None, 1, 0.9), (1, 2, "2025-01", "Prêmio", 1.0, 510.0, 1, 0.9), (2, 0, "2024-12", "salario base", 7.0, 500.0, 1, 0.9)], "case_id int, row_no int, competence string, item_name string, amount double, base_salary double, source_page int, confidence double")
    lines = export.history_lines(export.histories(records.valid_payslips(rows), Config())).orderBy("case_id", "file_name", "competence")
    assert [(r["file_name"], r["line"].split(";")[:2]) for r in lines.collect()] == [
        ("historico_salarial_01_salario_base.csv", ["12/2024", "500,00"]), ("historico_salarial_01_salario_base.csv", ["01/2025", "510,00"]),
        ("historico_salarial_02_premio.csv", ["12/2024", "1244,50"]), ("historico_salarial_02_premio.csv", ["01/2025", "1,00"]), ("historico_salarial_01_salario_base.csv", ["12/2024", "7,00"])]


def test_triage(spark):
    pages = spark.createDataFrame([(1, 1, "nada"), (1, 2, "CARTÃO DE PONTO entrada saída"), (1, 3, "08:00 e 17:00"), (1, 4, "09:00"), (1, 5, "cartão de ponto planilha de cálculo"), *[(2, p, "holerite") for p in range(1, 28)]], "case_id int, page_number int, text string")
    toc = spark.createDataFrame([], "case_id int, page_number int, title string")
    got = triage.triage(triage.signals(pages, toc, Config()), Config())
    assert [(r["page_number"], r["rank"]) for r in got.where("case_id = 1").orderBy("rank").collect()] == [(2, 1), (3, 2)]
    assert got.where("case_id = 2 AND NOT overflow").count() == 25 and got.where("case_id = 2 AND overflow").count() == 2


def test_triage_of_scanned_pages(spark):
    text, scan = lambda c, p, t: (c, p, t, 0, 0.0), lambda c, p: (c, p, "", 1, 1.0)
    # 1: scans alone; 2: text with scans beside it, over 15 pages; 3: over 25 text pages; 4: 24 text pages and two scans; 5: text neighbours are no scans; 6: short, some scans without bands
    pages = [scan(1, p) for p in range(1, 31)]
    pages += [scan(2, p) if p in (1, 3, 4, 9) else text(2, p, "holerite" if p == 2 else "nada") for p in range(1, 17)]
    pages += [text(3, p, "holerite") for p in range(1, 27)] + [scan(3, 27)]
    pages += [text(4, p, "holerite") for p in range(1, 25)] + [scan(4, 25), scan(4, 26)]
    pages += [text(5, 1, "holerite"), (5, 2, "08:00", 1, 0.1), text(5, 3, "nada")]
    pages += [scan(6, p) for p in range(1, 5)]
    bands = {**{(1, p): p for p in range(1, 31)}, (2, 1): 2, (2, 3): 5, (2, 4): 5, (2, 9): 9, (3, 27): 20, (4, 25): 10, (4, 26): 12, (5, 2): 4, (6, 1): 0, (6, 2): 9, (6, 3): 3, (6, 4): 30}
    pages = spark.createDataFrame(pages, "case_id int, page_number int, text string, n_images int, coverage double")
    ink = spark.createDataFrame([(c, p, 0.9 if (c, p) == (6, 4) else 0.2, b, 1) for (c, p), b in bands.items()], "case_id int, page_number int, ink_ratio double, bands int, ruled int")
    toc = spark.createDataFrame([], "case_id int, page_number int, title string")
    got = triage.triage(triage.signals(pages, toc, Config()), Config(), profile=ink).orderBy("case_id", "rank").collect()
    sent = lambda c, over: [r["page_number"] for r in got if r["case_id"] == c and r["overflow"] == over]
    assert (sent(1, False), sent(1, True)) == ([*range(30, 7, -1), 7], []) and len(sent(1, False)) == 24
    assert sent(2, False) == [2, 9, 3]
    assert sent(3, False) == list(range(1, 26)) and sent(3, True) == [26, 27]
    assert sent(4, False) == [*range(1, 25), 26] and sent(4, True) == [25]
    assert sent(5, False) == [1, 2] and [r["score"] for r in got if r["case_id"] == 5][1] == Config().neighbor_score
    assert sent(6, False) == [2, 3, 1, 4]
    whole = triage.triage(triage.signals(pages, toc, Config()), Config(), profile=ink, keep_all_up_to=16).where("NOT overflow").orderBy("case_id", "rank").collect()
    assert [r["page_number"] for r in whole if r["case_id"] == 2] == list(range(1, 17)) and [r["page_number"] for r in whole if r["case_id"] == 3] == list(range(1, 26))


def test_raster(spark):
    """Bands are stretches of inked rows, ruled rows hold a run of ink; the threshold comes from the whole page."""
    white, dots, rule = [250] * 100, [0, 0] + [250] * 98, [250] * 40 + [0] * 6 + [250] * 54
    one = [250] * 99 + [0]
    pages = {1: [white, dots, dots, white, rule, one, dots], 2: [white] * 3, 3: [[0] * 100] * 4, 4: [rule] * 17 + [white] + [dots, white] * 2}
    rows = spark.createDataFrame([(1, p, k, r) for p, rs in pages.items() for k, r in enumerate(rs)], "case_id int, page_number int, row_no int, pixels array<int>")
    got = {r["page_number"]: r for r in visual.ink_profile(rows, Config()).collect()}
    assert {p: (r["width"], r["height"], r["bands"], r["ruled"]) for p, r in got.items()} == {1: (100, 7, 3, 1), 2: (100, 3, 0, 0), 3: (100, 4, 0, 0), 4: (100, 22, 3, 17)}
    assert got[1]["ink_ratio"] == 13 / 700 and got[3]["ink_ratio"] == 0
    found = visual.visual_candidates(visual.ink_profile(rows, Config()), Config()).collect()
    assert [(r["page_number"], r["accepted"], r["score"]) for r in found] == [(4, True, 23.0)]


def test_rows_of_model_answers(spark):
    good = {"date": "2024-01-02", "clock_in": "08:00", "source_page": 9, "confidence": 0.9}
    page = lambda n, kind="CARTAO_PONTO", **more: {"page_number": n, "document_type": kind, "confidence": 0.8, **more}
    answer = {"pages": [
        page("1", time_cards=[good, {**good, "date": None}, {**good, "confidence": 2}, {**good, "confidence": "x"}], payslips=[{"competence": "2024-01"}]),
        page(2, "HOLERITE", payslips=[{"competence": "2024-01", "item_name": "a", "amount": "12.5", "confidence": 1}, {"competence": "2024-01", "item_name": "a", "amount": "?", "confidence": 1}], time_cards=[good]),
        page(3, "OUTRO"), page(3, time_cards=[good]), page(7), page(4, conflicts=[{"field": "x", "values": [1, "1", {"a": None}, 2.50, True, None, [1]], "source_pages": [4]}, {"values": []}], missing_fields=["date"]), {"page_number": 5},
    ]}
    asked = spark.createDataFrame([(1, 0, n) for n in range(1, 7)], "case_id int, call int, page_number int")
    told = spark.createDataFrame([(1, 0, "```json\n" + json.dumps(answer) + "\n```"), (1, 0, "no json")], "case_id int, call int, answer string")
    pages = results.model_pages(asked, told)
    assert sorted((r["page_number"], r["document_type"]) for r in pages.collect()) == [(1, "CARTAO_PONTO"), (2, "HOLERITE"), (3, "CARTAO_PONTO"), (4, "CARTAO_PONTO"), (5, "IRRELEVANTE")]
    assert sorted((r["source_page"], r["pos"], r["date_raw"]) for r in results.time_card_rows(pages).collect()) == [(1, 0, "2024-01-02"), (3, 0, "2024-01-02")]
    assert [(r["source_page"], r["amount"]) for r in results.payslip_rows(pages).collect()] == [(2, 12.5)]
    assert [(r["field"], r["found_values"], r["source_pages"]) for r in results.model_conflicts(pages).collect()] == [("x", '[1,"1",{"a":null},2.5,true,null,[1]]', "4")]
    assert [(r["source_page"], r["kind"], r["flag"]) for r in results.page_flags(pages).collect()] == [(4, "missing", "date")]


def test_labels_of_typed_values(spark):
    cases = {
        "1": "R$ 1,00", '"1"': "1", "-1234567.895": "-R$ 1.234.567,90", "1e3": "R$ 1.000,00", '"R$ 5"': "R$ 5", "true": "true", "null": "null", "[1,2]": "[1,2]", '{"a":null}': '{"a":null}', "{}": "{}",
        '{"clock_out":"17:00","clock_in":"08:00","break_start":"","break_end":null}': "in: 08:00 · out: 17:00", '{"break_end":"13:00","clock_in":8}': "in: 8 · int. end: 13:00",
    }
    whole = "[" + ",".join(cases) + "]"
    rows = spark.createDataFrame([(whole,), ("{}",), ("no",), (None,)], "t string").select(results.typed_values(F.col("t")).alias("vs"))
    assert [r[0] for r in rows.select(F.size("vs")).collect()] == [len(cases), None, None, None]
    assert [r[0] for r in rows.select(F.explode("vs").alias("v")).select(results.value_label(F.col("v"))).collect()] == list(cases.values())


def test_saved_review(spark):
    rows = cards(spark, ("2024-01-02", "08:00", None, None, "17:00", 1, 0.9), ("2024-01-02", "09:00", None, None, "17:00", 2, 0.9)).withColumn("case_id", F.lit(1))
    items = spark.createDataFrame([(1, 0, "2024-01", "A]b", 1.0, None, 1, 0.9), (1, 1, "2024-01", "a]B", 2.0, None, 2, 0.9)], "case_id int, row_no int, competence string, item_name string, amount double, base_salary double, source_page int, confidence double")
    stated = spark.createDataFrame([(1, 1, "free", '["x"]', "1")], "case_id int, place int, field string, found_values string, source_pages string")
    found = results.all_conflicts(stated, *results.validated(rows, items))
    assert [(r["seq"], r["field"], r["found_values"]) for r in found.orderBy("seq").collect()] == [
        (1, "free", '["x"]'),
        (2, "time_cards[2024-01-02]", '[{"clock_in":"08:00","break_start":null,"break_end":null,"clock_out":"17:00"},{"clock_in":"09:00","break_start":null,"break_end":null,"clock_out":"17:00"}]'),
        (3, "payslips[2024-01|A]b]", "[1.00,2.00]"),
    ]
    saved = results.saved_review(rows.where("source_page = 2"), items, found)[2]
    assert [r["field"] for r in saved.orderBy("seq").collect()] == ["free", "payslips[2024-01|A]b]"]


@pytest.mark.parametrize("field, kind, key, item", [
    ("time_cards[2024-01-02]", "time_card", "2024-01-02", None), ("time_cards[]", None, None, None), ("payslips[2024-01|a]b]", "payslip", "2024-01", "a]b"), ("payslips[2024-01].base_salary", "base_salary", "2024-01", None),
    ("payslips[2024-01|x].base_salary", "base_salary", "2024-01|x", None), ("payslips[a]", None, None, None), ("xtime_cards[1]", None, None, None),
])
def test_conflict_fields(spark, field, kind, key, item):
    r = spark.range(1).select(results.conflict_field(F.lit(field)).alias("c"), results.is_derived(F.lit(field)).alias("d")).first()
    assert (r["c"]["kind"], r["c"]["day_or_month"], r["c"]["item"], r["d"]) == (kind, key, item, kind is not None)


def test_observed_counters(spark):
    rows, seen = results.observed(spark.range(10), "pages", n=F.count(F.lit(1)), odd=F.count_if(F.col("id") % 2 == 1))
    rows.collect()
    assert seen.get == {"n": 10, "odd": 5}


def test_schedule_and_votes(spark):
    monday, tuesday = dt.date(2025, 7, 21), dt.date(2025, 7, 22)
    rows = [(1, monday + dt.timedelta(7 * k), s, 10 * k + s, t, t, t, None) for k in range(3) for s, t in ((0, "10:00"), (1, "17:00"))]
    rows += [(1, tuesday, 0, 90, "23:00", "23:00", "22:00", "08:00"), (1, monday, 0, 91, "10:30", "10:30", "10:30", "10:31"), (1, monday, 1, 92, "03:00", "03:00", "03:00", "17:10"), (1, monday, 1, 93, "03:00", "04:00", None, "17:10")]
    marks = spark.createDataFrame(rows, "case_id int, day date, slot int, cell_id int, first_read string, reread_1 string, reread_2 string, model_read string")
    times = cells.schedule(marks, Config())
    assert [tuple(r) for r in times.collect()] == [(1, 0, 600, 1020)]
    got = {r["cell_id"]: (r["value"], r["source"]) for r in cells.resolved(marks, times, Config()).collect()}
    assert (got[0], got[90], got[91], got[92], got[93]) == (("10:00", "local"), (None, None), (None, None), ("17:10", "model"), ("17:10", "model"))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=12), st.integers(0, 6))
def test_synced_dates_equal_a_loop(spark, weekdays, first):
    start = dt.date(2024, 1, 1) + dt.timedelta(first)
    rows = spark.createDataFrame([(1, k, w, start) for k, w in enumerate(weekdays)], "case_id int, pos int, weekday int, start date")
    at, expected = start, []
    for w in weekdays:
        while at.weekday() != w:
            at += dt.timedelta(1)
        expected.append(at)
        at += dt.timedelta(1)
    assert [r["date"] for r in grid.synced_dates(rows).orderBy("pos").collect()] == expected


def test_greedy_matching(spark):
    rows = lambda *a: spark.createDataFrame([(1, "2024-03", k, x) for k, x in enumerate(a)], "case_id int, competence string, row_no long, amount double")
    got = evaluate.greedy_matches(rows(100.0, 100.005, 50.0), rows(100.004, 99.995, 70.0)).collect()
    assert sorted((r["row_no"], r["taken"]) for r in got) == [(0, 0), (1, 1)]


def greedily(truth, predicted, tolerance):
    """An independent loop: each row of truth takes the first unused prediction of its month within reach."""
    used, out = set(), []
    for case, month, row, amount in truth:
        for k, (c, m, taken, other) in enumerate(predicted):
            if k not in used and (c, m) == (case, month) and None not in (amount, other) and abs(other - amount) <= tolerance:
                used.add(k)
                out.append((case, month, row, taken))
                break
    return sorted(out)


@pytest.mark.parametrize("kind", ["few amounts", "chain", "ties", "spread", "exact"])
def test_greedy_matching_equals_a_loop(spark, kind):
    r = random.Random(3)
    amount = {"few amounts": lambda k: r.randrange(60) / 200, "chain": lambda k: (k if r.random() < 0.5 else 39 - k) / 100, "ties": lambda k: r.choice((1.0, 1.01, 1.02)), "spread": lambda k: r.random(), "exact": lambda k: r.randrange(9) / 4}[kind]
    tolerance = {"few amounts": 0.004, "exact": 0.0}.get(kind, 0.0100001)
    make = lambda: [(k % 2, "2024-0" + str(1 + k % 3 // 2), k, None if k == 5 else amount(k)) for k in range(80)]
    truth, predicted = make(), make()[::1 if kind == "ties" else -1]
    predicted = sorted(predicted, key=lambda x: x[2])
    frame = lambda rows: spark.createDataFrame(rows, "case_id int, competence string, row_no long, amount double")
    got = evaluate.greedy_matches(frame(truth), frame(predicted), tolerance)
    expected = greedily(truth, predicted, tolerance)
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 10
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert evaluate.greedy_matches(frame(truth), frame([]), tolerance).count() == 0


def test_session_gap_is_inclusive(spark):
    t = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([("a", t), ("a", t + dt.timedelta(seconds=899)), ("a", t + dt.timedelta(seconds=899 + 900))], "session_key string, ts timestamp")
    assert sorted(r["n"] for r in intake.sessions(events, 900).collect()) == [1, 2]


def test_session_stream(spark, tmp_path):
    r, t = random.Random(1), dt.datetime(2024, 1, 1)
    rows = [(f"u{r.randrange(5)}", t + dt.timedelta(seconds=r.randrange(40_000))) for _ in range(80)]
    events = spark.createDataFrame(rows, "session_key string, ts timestamp")
    late = spark.createDataFrame([("end", t + dt.timedelta(days=3))], "session_key string, ts timestamp")
    for k, part in enumerate((events, late, late)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    stream.run_once(stream.session_stream(source, 900), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = spark.read.parquet(f"{tmp_path}/out").where("session_key <> 'end'")
    assert sorted((r["session_key"], r["n"]) for r in got.collect()) == sorted((r["session_key"], r["n"]) for r in intake.sessions(events, 900).collect())


def test_class_scores(spark):
    truth = spark.createDataFrame([(1, 2, "HOLERITE"), (1, 3, "CARTAO_PONTO"), (1, 4, "HOLERITE"), (2, 1, "HOLERITE")], "case_id int, page_number int, document_type string")
    found = spark.createDataFrame([(1, 1, "IRRELEVANTE"), (1, 2, "HOLERITE"), (1, 3, "HOLERITE"), (1, 5, "HOLERITE"), (3, 1, "IRRELEVANTE")], "case_id int, page_number int, document_type string")
    got = {r["case_id"]: tuple(r)[1:] for r in evaluate.class_scores(truth, found).collect()}
    assert got == {1: (4, 2, 2, 0.5), 2: (0, 0, 1, None), 3: (1, 1, 0, 1.0)}


def test_model_scores(spark):
    calls = spark.createDataFrame([("a", 1.0, 10, 3, 1, 2), ("a", 2.5, 15, 4, 2, 2), ("a", None, 99, 9, 0, 2), ("b", None, None, None, 0, 0)], "model string, latency double, tokens_in long, tokens_out long, ok long, total long")
    got = {r["model"]: tuple(r)[1:] for r in evaluate.model_scores(calls, ["model"]).collect()}
    assert got == {"a": (3, 1, 1.75, 2.5, 12, 3, 50.0), "b": (1, 1, None, None, 0, 0, None)}


def test_plausible(spark):
    rows = spark.createDataFrame([(1, "08:00", 480), (2, "09:15", 480), (3, "09:16", 480), (4, "09:16", None), (5, None, None)], "id int, reading string, usual int")
    got = rows.orderBy("id").select(cells.plausible("reading", Config(), False).alias("a"), cells.plausible("reading", Config(), True).alias("b")).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, True), (False, False), (True, False), (False, False)]


def test_notes(spark):
    zero = {"days": 0, "incomplete": 0, "unconfirmed": 0, "unread": 0, "omitted": 0, "dropped": 0, "skipped": 0}
    counters = spark.createDataFrame([{"case_id": 1, **zero, "days": 2, "dropped": 1}, {"case_id": 2, **zero}], "case_id int, " + ", ".join(f"{c} long" for c in zero))
    lines = spark.createDataFrame([(1, "b.csv", "x"), (1, "a.csv", "x"), (1, "a.csv", "y"), (3, "c.csv", "z")], "case_id int, file_name string, line string")
    got = {r["case_id"]: r["text"] for r in export.notes(counters, lines).collect()}
    assert got == {
        1: "﻿Dias exportados: 2\r\nTurnos além do limite do dia, deixados de fora: 1\r\n- a.csv: 2\r\n- b.csv: 1\r\n",
        2: f"﻿{export.NOTHING}\r\n",
        3: "﻿- c.csv: 1\r\n",
    }


def test_starts_with_equal_votes_seen_at_once(spark):
    """Of starts with as many votes and the same first row the latest wins, in whatever order rows come; one without a date never."""
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(6)]
    rows = [(c, 2, d) for c in range(40) for d in random.Random(c).sample([*days, None], 7)] + [(40, 1, days[0]), (40, 2, days[5])]
    votes = grid.start_vote(spark.createDataFrame(rows, "case_id int, pos int, read_date date"), 1, 0.0)
    assert sorted(map(tuple, votes.collect())) == [(c, days[3], 1, 7) for c in range(40)] + [(40, days[0] - dt.timedelta(1), 1, 2)]


def test_admissions_turn_away_past_the_cap(spark):
    r = random.Random(6)
    asked = [(s, f"{s}-{k}", start := r.randrange(3_000), start + r.randrange(1, 200)) for s in range(3) for k in range(120)]
    got = {x["session"]: x["admitted"] for x in intake.admitted(spark.createDataFrame(asked, "store int, session string, start_us long, expires_us long"), 3).collect()}
    live, want = {}, {}
    for store, name, start, end in sorted(asked, key=lambda x: (x[2], x[1])):
        held = live[store] = [e for e in live.get(store, []) if e > start]
        want[name] = len(held) < 3
        if want[name]:
            held.append(end)
    assert got == want and not all(got.values())


def test_truth_files(spark, tmp_path):
    day = {"date": "1/2/2024", "clock_in": "8h00", "clock_out": ""}
    cases = {
        "a": {"pages": {"1": "CARTAO_PONTO"}, "time_cards": [day], "payslips": [{"competence": "2/2024", "item_name": "x", "amount": -10.126}]}, "b": {"pages": {"0": "HOLERITE"}}, "c": {"pages": {"1": "?"}},
        "d": {"time_cards": [{**day, "clock_in": "secret"}]}, "e": {"payslips": [{"competence": "2024-13", "amount": 1}]}, "f": {"payslips": [{"competence": "2024-12", "amount": None}]}, "g": {"time_cards": [{**day, "date": None}]},
    }
    for name, case in cases.items():
        (tmp_path / f"{name}.gabarito.json").write_text(json.dumps(case))
    pages, days, items, problems = evaluate.truth_tables(files.truth_documents(spark, f"{tmp_path}/*.json", ".gabarito.json"))
    assert [tuple(r) for r in pages.collect()] == [("a", 1, "CARTAO_PONTO")]
    assert [tuple(r) for r in days.collect()] == [("a", 0, "2024-02-01", "08:00", None, None, None)]
    assert [tuple(r) for r in items.collect()] == [("a", 0, "2024-02", "x", 10.13)]
    assert {r["case_id"]: r["problem"] for r in problems.collect()} == {"b": "pages", "c": "pages", "d": "clock_in", "e": "competence", "f": "amount", "g": "date"}


def test_metrics_are_appended_once(spark, tmp_path):
    scores, path = spark.createDataFrame([(1, 2), (2, 3)], "case_id long, correct long"), f"{tmp_path}/m"
    files.write_metrics(scores.where("case_id = 1"), path)
    files.write_metrics(scores.withColumn("correct", F.lit(9).cast("long")), path, files.read_metrics(spark, path, "case_id long"))
    assert sorted(map(tuple, files.read_metrics(spark, path, "case_id long, correct long").collect())) == [(1, 2), (2, 9)]


def test_entries_of_a_page(spark):
    day = dt.date(2024, 5, 6)
    rows = [(1, 2, day, 0, 10, "08:00", "local", False, False), (1, 2, day, 1, 11, None, None, False, False), (1, 2, day + dt.timedelta(1), 1, 12, None, None, True, False), (1, 3, day, 0, 13, "07:00", "model", False, True)]
    cells_ = spark.createDataFrame(rows, "case_id int, page_number int, day date, slot int, cell_id long, value string, source string, single_mark boolean, confirmed boolean")
    unread = spark.createDataFrame([(1, 2, dt.date(2024, 5, 9), False)], "case_id int, page_number int, day date, confirmed boolean")
    got = [(r["page_number"], r["day"].day, r["clock_in"], r["ambiguous"], r["confidence"], r["review_cells"], r["competence"]) for r in cells.time_card_entries(cells_, unread, Config()).orderBy("page_number", "day").collect()]
    assert got == [
        (2, 6, "08:00", ["date", "clock_out"], 0.3, {"clock_out": 11}, "2024-05"), (2, 7, None, ["date", "clock_in", "clock_out"], 0.3, {"clock_in": 12}, "2024-05"),
        (2, 9, None, ["date", "clock_in", "clock_out"], 0.0, {}, "2024-05"), (3, 6, "07:00", [], 0.85, {"clock_in": 13}, "2024-05"),
    ]


def test_files_of_cases(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = [(str(k % 3), f"{k}.csv", bytes([k, 0, 255])) for k in range(9)] + [("é", "a b.txt", None)]
    frame = lambda some: spark.createDataFrame(some, "folder string, file_name string, content binary")
    case_files.write_files(frame(rows).repartition(4), path)
    read = lambda: sorted((r["folder"], r["file_name"], bytes(r["content"])) for r in case_files.read_files(spark, path).collect())
    on_disk = lambda: sorted((p.parent.name, p.name, p.read_bytes()) for p in (tmp_path / "out").rglob("*") if p.is_file())
    expected = sorted((a, b, c or b"") for a, b, c in rows)
    assert on_disk() == expected and read() == [r for r in expected if r[2]]
    case_files.write_files(frame([("0", "0.csv", b"new"), ("4", "x", b"")]), path)
    assert on_disk() == sorted([r for r in expected if r[:2] != ("0", "0.csv")] + [("0", "0.csv", b"new"), ("4", "x", b"")])
    case_files.write_files(frame([("5", "only", b"1")]), path, overwrite=True)
    assert on_disk() == [("5", "only", b"1")]


@pytest.mark.parametrize("bad", [("1", "../x", b""), ("1", None, b""), ("1", "0.csv", b"again"), (None, "x", b"")])
def test_a_failed_task_leaves_no_file(spark, tmp_path, bad):
    rows = [(str(k), "0.csv", b"x") for k in range(5)] + [bad]
    with pytest.raises(Exception, match="no name for a file"):
        case_files.write_files(spark.createDataFrame(rows, "folder string, file_name string, content binary").repartition(3), f"{tmp_path}/out")
    assert [p for p in tmp_path.rglob("*") if p.is_file() or p.name.startswith(".staging")] == []


def lives(events, seconds):
    """An independent loop over a store of sessions: events (key, second, kind)."""
    out, store = [], {}
    for key, at, kind in sorted(events, key=lambda e: (e[1], ("delete", "put", "get").index(e[2]))):
        life = store.get(key)
        if life and at - life[1] >= seconds:
            out.append((key, *store.pop(key), False))
            life = None
        if kind == "delete":
            if life:
                out.append((key, *store.pop(key), True))
        elif life or kind == "put":
            store[key] = (life[0] if life else at, at, (life[2] if life else 0) + 1)
    return sorted(out + [(k, *v, False) for k, v in store.items()])


def some_events(seed, n=240):
    r = random.Random(seed)
    return [(r.choice("abcd"), 1_000_000 + r.randrange(0, 1500) * 10, r.choice(["put", "get", "get", "delete"] if r.random() < 0.5 else ["put", "get"])) for _ in range(n)]


def as_lives(rows):
    second = lambda t: int(t.timestamp())
    return sorted((r["session_key"], second(r["first_ts"]), second(r["last_ts"]), r["n"], r["deleted"]) for r in rows)


SESSION_EVENTS = "session_key string, ts timestamp, kind string"


@pytest.mark.parametrize("seed", [1, 2])
def test_lives_of_sessions_equal_a_loop(spark, seed):
    events = some_events(seed)
    df = spark.createDataFrame([(k, dt.datetime.fromtimestamp(s, dt.timezone.utc), kind) for k, s, kind in events], SESSION_EVENTS)
    assert as_lives(intake.session_lives(df, 200).collect()) == lives(events, 200)


def test_life_stream_equals_the_batch(spark, tmp_path):
    """Files come one by one, events within them and across them out of order; one comes too late and doesn't count."""
    stream.use_rocksdb(spark)
    at = lambda s: dt.datetime.fromtimestamp(s, dt.timezone.utc)
    events = sorted(some_events(7), key=lambda e: e[1])
    r = random.Random(4)
    order = sorted(events, key=lambda e: e[1] + r.uniform(0, 500))  # by half the lateness that is allowed
    files_of = [order[k : k + 60] for k in range(0, len(order), 60)]
    late, end = [("a", 1_000_010, "put"), ("new", 1_000_020, "put")], [("end", 1_100_000, "put")]
    source = tmp_path / "in"
    source.mkdir()
    found = stream.life_stream(spark.readStream.schema(SESSION_EVENTS).option("maxFilesPerTrigger", 1).parquet(str(source)), 200, "1000 seconds")
    for k, part in enumerate([*files_of, late, end]):
        spark.createDataFrame([(key, at(s), kind) for key, s, kind in part], SESSION_EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        stream.run_once(found, f"{tmp_path}/out", f"{tmp_path}/check")
    got = as_lives(spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == lives(events, 200)
    assert "new" not in {x[0] for x in got}


def test_new_truth_files_are_scored_once(spark, tmp_path):
    source, out, check = (f"{tmp_path}/{n}" for n in ("truth", "out", "check"))
    (tmp_path / "truth").mkdir()
    put = lambda name, text: (tmp_path / "truth" / f"{name}.json").write_text(text)
    seen = []

    def score(rows):
        seen.append(sorted(r["case_id"] for r in rows.collect()))
        return rows.select("case_id", F.length("document").alias("n"))

    run = lambda: scoring.score_new(scoring.truth_stream(spark, source), score, out, check)
    got = lambda: sorted((r["case_id"], r["n"]) for r in spark.read.parquet(out).collect())
    put("a", "{}"), put("b", "[\n1]")
    run()
    assert got() == [("a", 2), ("b", 4)]
    put("c", "x")
    run(), run()
    assert got() == [("a", 2), ("b", 4), ("c", 1)] and seen == [["a", "b"], ["c"]]
    (tmp_path / "check" / "commits" / "1").unlink()  # as if the driver was lost between the batch's end and its commit
    crc = tmp_path / "check" / "commits" / ".1.crc"
    crc.unlink(missing_ok=True)
    run()
    assert got() == [("a", 2), ("b", 4), ("c", 1)] and seen[-1] == ["c"] and len(seen) == 3


def test_truth_files_are_scored_by_folders(spark, tmp_path):
    """A stream for each folder, also one that comes later; files of earlier runs are not scored again."""
    out, check, seen = f"{tmp_path}/out", f"{tmp_path}/check", []

    def score(rows, name):
        seen.append((name, sorted(r["case_id"] for r in rows.collect())))
        return rows.select("case_id", F.length("document").alias("n"))

    def run(*some):
        case_files.write_files(spark.createDataFrame([(f, f"{c}.json", t.encode()) for f, c, t in some], "folder string, file_name string, content binary"), f"{tmp_path}/truth")
        scoring.score_folders(spark, f"{tmp_path}/truth", score, out, check)

    run(("0", "a", "{}"), ("1", "b", "[1]"), ("1", "c", "x"))
    assert seen == [("0", ["a"]), ("1", ["b", "c"])]
    run(("1", "d", "{}"), ("2", "e", "12345"))
    assert seen[2:] == [("1", ["d"]), ("2", ["e"])]
    got = spark.read.parquet(out).collect()
    assert sorted((r["folder"], r["case_id"], r["n"]) for r in got) == [(0, "a", 2), (1, "b", 3), (1, "c", 1), (1, "d", 2), (2, "e", 5)]


def test_a_log_takes_each_event_once(spark, tmp_path):
    at = lambda s: dt.datetime.fromtimestamp(1_000_000 + s, dt.timezone.utc)
    source = tmp_path / "in"
    source.mkdir()
    events = spark.readStream.schema(lifecycle.LOG).option("maxFilesPerTrigger", 1).parquet(str(source))
    parts = [[("r", 1, 0, "accepted"), ("r", 2, 5, "processing"), ("r", 1, 0, "accepted")], [("r", 2, 6, "processing"), ("s", 1, 7, "completed")], [("r", 3, 9, "completed"), ("r", 2, 5, "processing")]]
    for part in parts:
        spark.createDataFrame([(run, k, at(s), status) for run, k, s, status in part], lifecycle.LOG).coalesce(1).write.mode("append").parquet(str(source))
        lifecycle.append(events, f"{tmp_path}/log", f"{tmp_path}/check")
    log = lifecycle.read_log(spark, f"{tmp_path}/log")
    assert sorted((r["run_id"], r["event_id"], r["status"]) for r in log.collect()) == [("r", 1, "accepted"), ("r", 2, "processing"), ("r", 3, "completed"), ("s", 1, "completed")]
    good, faults = intake.lifecycle(log)
    assert sorted((r["before"] or "", r["status"]) for r in good.collect()) == [("", "accepted"), ("accepted", "processing"), ("processing", "completed")]
    assert [(r["run_id"], r["fault"]) for r in faults.collect()] == [("s", "start")]


def test_moves_of_a_lifecycle(spark):
    states = ["accepted", "processing", "completed", "failed", "discarded", "expired", "lost", None]
    pairs = [(a, b) for a in states for b in states]
    rows = [(k, 2 * k + j, j, s) for k, pair in enumerate(pairs) for j, s in enumerate(pair)] * 2
    good, faults = intake.lifecycle(spark.createDataFrame(rows, "run_id int, event_id int, at int, status string"))
    moved = {(r["before"], r["status"]) for r in good.collect() if r["before"]}
    assert moved == {(a, b) for a, after in intake.MOVES.items() for b in after}
    assert good.count() + faults.count() == len(rows) / 2
    assert {(r["status"], r["fault"]) for r in faults.collect() if r["at"] == 0} == {(s, "start") for s in states[1:6]} | {("lost", "unknown"), (None, "unknown")}


def test_a_whole_job(spark):
    """Counters are observed while the job's tables are written; a case with a conflict exports nothing."""
    pages = spark.createDataFrame([("a", 1, "holerite 1"), ("a", 2, "cartão de ponto"), ("b", 1, "cartão de ponto"), ("b", 2, "cartão de ponto"), ("c", 1, "nada")], "case_id string, page_number int, text string")
    toc = spark.createDataFrame([], "case_id string, page_number int, title string")
    row = lambda n, clock: {"page_number": n, "document_type": "CARTAO_PONTO", "confidence": 1, "time_cards": [{"date": "2024-05-02", "clock_in": clock, "clock_out": "17:00", "confidence": 1}]}
    said = {"a": [row(1, "08:00"), row(2, "8h00")], "b": [row(1, "08:00"), row(2, "09:00")]}
    told = spark.createDataFrame([(c, 0, json.dumps({"pages": p})) for c, p in said.items()], "case_id string, call int, answer string")
    job = flow.run(triage.signals(pages, toc, Config()), lambda asked: told, Config())
    assert {n: o.get for n, o in job.seen.items()} == {
        "triage": {"candidates": 4, "overflow": 0}, "classification": {"pages": 4, "relevant": 4}, "time_cards": {"rows": 4, "duplicates": 1, "disputed": 2}, "payslips": {"rows": 0, "duplicates": 0, "disputed": 0},
    }
    assert [(r["case_id"], r["line"]) for r in job.lines.collect()] == [("a", "02/05/2024;08:00;17:00" + ";" * 10)]
    got = {r["case_id"]: r.asDict() for r in flow.case_counts(job).collect()}
    assert got == {c: {"case_id": c, "sent": 2, "calls": 1, "unclassified": 0, "time_cards": n, "payslips": 0, "conflicts": k, "lines": 1 - k} for c, n, k in (("a", 1, 0), ("b", 2, 1))}
