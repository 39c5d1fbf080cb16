"""Tables rebuilt from words. A sheet is written as it looks on paper, a character to ten pixels; the cases follow the operator's rules one by one."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quire.functions.text import WEEKDAYS
from quire.operators import sheets

WORDS = "case_id int, page_number int, pos int, line_key string, x int, y int, w int, h int, text string"
CELL, LINE = 10, 30
DAY = dt.timedelta(days=1)


def printed(page: str, number: int = 1, shuffle: int = 0):
    """Words of a page: a word starts where its first character stands and is as wide as it is long. Words are met in a shuffled order of lines."""
    rows = []
    lines = list(enumerate(page.split("\n")))
    random.Random(shuffle).shuffle(lines)
    for y, line in lines:
        at = 0
        for text in line.split():
            at = line.index(text, at)
            rows.append((7, number, len(rows), f"line {y}", at * CELL, y * LINE, len(text) * CELL, 16, text))
            at += len(text)
    return rows


def read(spark, *pages):
    rows = [r for k, page in enumerate(pages, 1) for r in printed(page, k, shuffle=k)]
    return sheets.sheet_rows(spark.createDataFrame(rows, WORDS))


def line(day: dt.date, left: str = "07:10", right: str = "16:05", weekday: str | None = None, date: str = "%d/%m/%Y") -> str:
    return f"{day.strftime(date):<12}{weekday or WEEKDAYS[day.weekday()]:<8}{left:<10}{right}"


def page(lines: list[str], first: dt.date, last: dt.date, header: str = "Período {a} a {b}") -> str:
    return "\n".join([header.format(a=f"{first:%d/%m/%Y}", b=f"{last:%d/%m/%Y}"), "", *lines, "Saldo do mês 00:00"])


def span(first: dt.date, n: int) -> list[dt.date]:
    return [first + k * DAY for k in range(n)]


def facts(rows):
    """Of each page: whether its dates are confirmed, the days of its rows, and the days that no row has."""
    out = {p["page_number"]: [p["confirmed"], [], []] for p in sheets.sheet_pages(rows).collect()}
    for k, found in ((1, rows.select("page_number", "day")), (2, sheets.sheet_unread(rows))):
        for r in sorted(found.collect(), key=lambda r: r["day"]):
            out[r["page_number"]][k].append(r["day"])
    return out


START = dt.date(2022, 9, 12)  # a Monday
TEN = span(START, 10)


def test_lines_in_their_places_have_the_days_of_the_period(spark):
    years = span(dt.date(2019, 12, 27), 12)
    got = facts(read(spark, page([line(d) for d in TEN], TEN[0], TEN[-1]), page([line(d) for d in years], years[0], years[-1])))
    assert got == {1: [True, TEN, []], 2: [True, years, []]}


def test_a_few_misread_weekdays_do_not_matter_where_every_day_has_its_line(spark):
    lines = [line(d, weekday="DOM" if k in (2, 5) else None) for k, d in enumerate(TEN)]
    assert facts(read(spark, page(lines, TEN[0], TEN[-1]))) == {1: [True, TEN, []]}


@pytest.mark.parametrize("lost", [{4}, {3, 4}, {1, 8}])
def test_lines_that_are_lost_leave_days_unread(spark, lost):
    lines = [line(d) for k, d in enumerate(TEN) if k not in lost]
    assert facts(read(spark, page(lines, TEN[0], TEN[-1]))) == {1: [True, [d for k, d in enumerate(TEN) if k not in lost], [TEN[k] for k in sorted(lost)]]}


@pytest.mark.parametrize("years", [-1, 1])
def test_most_years_of_the_lines_mend_the_period(spark, years):
    moved = lambda d: d.replace(year=d.year + years)
    assert facts(read(spark, page([line(d) for d in TEN], moved(TEN[0]), moved(TEN[-1])))) == {1: [True, TEN, []]}


def test_an_impossible_end_is_a_month_after_the_start(spark):
    month = span(START, 30)
    lines = [line(d) for d in month]
    assert facts(read(spark, page(lines, START, START, "Período {a} a 11/10/2922"))) == {1: [True, month, []]}


def test_most_printed_dates_move_the_start(spark):
    late = START + 5 * DAY
    assert facts(read(spark, page([line(d) for d in TEN], late, late + 9 * DAY)))[1][:2] == [True, TEN]


def test_dates_that_months_do_not_bear_out_are_not_confirmed(spark):
    """The lines turn to October after five rows, but the header's period ends in September; no line has a whole date to vote by."""
    cut = ["~/" + line(d, date="%m/%Y") for d in span(dt.date(2022, 9, 26), 10)]
    early = dt.date(2022, 9, 16)
    got = facts(read(spark, page(cut, early, early + 9 * DAY)))
    assert got == {1: [False, span(early, 10), []]}


def test_tables_end_and_need_rows(spark):
    after = page([line(d) for d in TEN], TEN[0], TEN[-1]) + "\n" + line(TEN[-1] + DAY)
    short = page([line(d) for d in TEN[:4]], TEN[0], TEN[3])
    single = page([line(d, right="") for d in TEN], TEN[0], TEN[-1])
    assert facts(read(spark, after, short, single, "Petição inicial", page([line(d) for d in TEN], TEN[0], TEN[-1], "Folha de {a}"))) == {1: [True, TEN, []]}


def test_cells(spark):
    """Columns are where most times stand; what a row prints there, or leaves out, makes its cells."""
    odd = {
        0: ("FOLGA DESCANSO", ""),
        1: ("16:40", "     Esquecimento"),  # one time, marked as lone: an exit, as it is late
        2: ("07:1O", "16:O5"),  # letters read as digits
        3: ("07:12.16:03xxxxx", ""),  # both times in one word
        4: ("", "16:20"),  # no entry: its usual box
        5: ("", "                    Esquecimento"),  # the sign of a lone mark and no time
        6: ("FERIADO 1", "  16:11"),  # digits at the exit
    }
    lines = [line(d, *odd.get(k, ("07:10", "16:05"))) for k, d in enumerate(span(START, 14))]
    days = sheets.work_days(read(spark, page(lines, START, START + 13 * DAY)))
    got = {(r["day"] - START).days: [(c["slot"], c["first_read"], c["single_mark"], c["x"]) for c in r["cells"]] for r in days.collect()}
    assert sorted(got) == list(range(1, 14))
    assert got[1] == [(1, "16:40", True, 200)]
    assert [c[:2] for c in got[2]] == [(0, "07:10"), (1, "16:05")]
    assert [c[:2] for c in got[3]] == [(0, "07:12"), (1, "16:03")]
    assert got[4] == [(0, None, False, 200), (1, "16:20", False, 300)]
    assert got[5] == []
    assert [c[:2] for c in got[6]] == [(0, None), (1, "16:11")]
    assert got[9] == [(0, "07:10", False, 200), (1, "16:05", False, 300)]
    assert sheets.row_cells(read(spark, page(lines, START, START + 13 * DAY))).count() == sum(map(len, got.values()))


@pytest.mark.parametrize("seed", range(3))
def test_random_sheets_come_back(spark, seed):
    """Any period, random lines lost and weekdays misread: what has its line keeps its day, and the rest is unread."""
    r = random.Random(seed)
    pages, expected = [], {}
    for k in range(1, 7):
        first, n = dt.date(2018, 1, 1) + r.randrange(2_000) * DAY, r.randint(14, 40)
        days = span(first, n)
        lost = set(r.sample(range(1, n - 1), r.randint(0, 2)))
        misread = set() if lost else set(r.sample(range(n), n // 6))
        lines = [line(d, weekday=WEEKDAYS[(d.weekday() + 2) % 7] if j in misread else None) for j, d in enumerate(days) if j not in lost]
        pages.append(page(lines, days[0], days[-1]))
        expected[k] = [True, [d for j, d in enumerate(days) if j not in lost], [days[j] for j in sorted(lost)]]
    assert facts(read(spark, *pages)) == expected


def test_tsv(spark):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    fields = lambda x, text, line_no=8: "\t".join(map(str, (5, 1, 2, 1, line_no, 1, x, 44, 31, 12, 77, text)))
    tsv = "\r\n".join([head, fields(3, "  16:05\t"), fields(4, "   "), fields("?", "lost"), "5\t1\t2", fields(90, "DOM", 9)])
    rows = spark.createDataFrame([(1, 1, tsv), (1, 2, ""), (1, 3, None)], "case_id int, page_number int, tsv string")
    got = sheets.tsv_words(rows).select("page_number", "pos", "line_key", "x", "y", "w", "h", "text").orderBy("pos")
    assert [tuple(r) for r in got.collect()] == [(1, 1, "2-1-8", 3, 44, 31, 12, "16:05"), (1, 5, "2-1-9", 90, 44, 31, 12, "DOM")]
    assert got.where(F.col("page_number") > 1).isEmpty()


def test_spans_of_any_height(spark):
    """Spans from a hundredth to some thousands high, overlapping, empty, upside down, without a place or strip, against a loop."""
    r = random.Random(5)
    spans = [(c, k, t := r.choice([r.uniform(-50, 900), float(r.randrange(-32, 900))]), t + r.choice([0.01, 0.5, 1.0, 3.0, 8.0, 64.0, 4_000.0, 0.0, -2.0])) for c in ("a", "b") for k in range(60)]
    words = [(c, k, r.randrange(40), r.choice([r.uniform(-60, 950), float(r.randrange(-64, 900))]), r.choice([0.0, 2.0, 7.0]), f"{c}{k} ") for c in ("a", "b", "c") for k in range(80)]
    spans += [("a", 60, None, 5.0), ("a", 61, 5.0, None), (None, 0, 0.0, 900.0)]
    words += [("a", 80, 1, None, 2.0, "x"), (None, 0, 1, 10.0, 2.0, "x")]
    got = sheets.span_texts(spark.createDataFrame(words, "strip string, pos int, x int, y double, h double, text string"), spark.createDataFrame(spans, "strip string, span int, top double, bottom double"), ["strip"])
    held = {}
    for c, pos, x, y, h, text in words:
        at = [k for s, k, top, bottom in spans if s == c and None not in (c, y, top, bottom) and top <= y + h / 2 < bottom]
        if at:
            held.setdefault((c, min(at)), []).append((x, pos, text))
    want = {(s, k): "".join(t for *_, t in sorted(held.get((s, k), []))) for s, k, *_ in spans}
    rows = got.collect()
    assert {(r["strip"], r["span"]): r["text"] for r in rows} == want and len(rows) == len(spans) and sum(map(bool, want.values())) > 10


def test_spans_are_not_sent_whole_to_tasks(spark):
    """Spans are many times the rows that they are made of, which Spark doesn't foresee: the only broadcast is of the powers of two between their heights."""
    words = spark.range(1_000).selectExpr("id DIV 10 AS strip", "id AS pos", "1 AS x", "id AS y", "2 AS h", "'w' AS text")
    spans = words.select("strip").distinct().selectExpr("strip", "explode(sequence(0, 2000)) AS span").selectExpr("*", "10 * span AS top", "10 * span + 15 AS bottom")
    found = sheets.span_texts(words, spans, ["strip"])
    assert found.where("text <> ''").count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 2
