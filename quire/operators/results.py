"""Results of a case: rows from model answers, whole-result validation, conflicts as records, and what a saved review leaves.

Everything is keyed by case; a case's rows, conflicts and flags are separate tables that share the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import cents, grouped_br
from . import records
from .answers import TYPES, answer_pages
from .records import TIMES

#: Types of pages that hold time cards and payslips.
TIME_CARD, PAYSLIP = TYPES[:2]
#: Shapes of the names of conflicts that are derived from rows; others come from the model.
SALARY_FIELD, PAYSLIP_FIELD, TIME_CARD_FIELD = r"^payslips\[([^\]]+)\]\.base_salary$", r"^payslips\[([^|\]]+)\|(.+)\]$", r"^time_cards\[([^\]]+)\]$"
#: Names of fields as shown.
LABELS = {
    "date": "data", "competence": "competência", "clock_in": "entrada", "clock_out": "saída", "break_start": "início do intervalo", "break_end": "fim do intervalo",
    "item_name": "verba", "amount": "valor", "base_salary": "salário-base", "overtime_paid_hours": "horas extras pagas",
}


# Rows from model answers


def model_pages(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """The first valid answer for each page that was asked in its call, with its nested rows."""
    rows = asked.select("case_id", "call", "page_number").join(answer_pages(answers), ["case_id", "call", "page_number"])
    first = Window.partitionBy("case_id", "page_number").orderBy("call", "pos")
    return rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "pos")


def _children(pages: DataFrame, column: str, kind: str) -> DataFrame:
    """Rows of pages of a type; their page is the page that was asked, whatever the answer says. Rows without a confidence from 0 to 1 go."""
    rows = pages.where(F.col("document_type") == kind).select("case_id", F.col("page_number").alias("source_page"), F.posexplode(column).alias("pos", "r"))
    rows = rows.select("case_id", "source_page", "pos", "r.*").drop("page")
    return rows.withColumn("confidence", F.col("confidence").try_cast("double")).where(F.col("confidence").between(0, 1))


def time_card_rows(pages: DataFrame) -> DataFrame:
    """case_id, source_page, pos, date_raw, the four times, confidence and the answer's flags; rows without a date go."""
    rows = _children(pages, "time_cards", TIME_CARD).where("date IS NOT NULL").withColumnRenamed("date", "date_raw")
    empty = F.array().cast("array<string>")
    return rows.select("case_id", "source_page", "pos", "date_raw", *TIMES, "confidence", F.coalesce("missing_fields", empty).alias("missing"), F.coalesce("ambiguous_fields", empty).alias("ambiguous"))


def payslip_rows(pages: DataFrame) -> DataFrame:
    """case_id, source_page, pos, competence, item_name, amount, base_salary, confidence; rows without a month, a name or an amount, or with a salary that is no number, go."""
    rows = _children(pages, "payslips", PAYSLIP).withColumns({"amount_ok": F.col("amount").try_cast("double"), "salary_ok": F.col("base_salary").try_cast("double")})
    rows = rows.where("competence IS NOT NULL AND item_name IS NOT NULL AND amount_ok IS NOT NULL AND (base_salary IS NULL OR salary_ok IS NOT NULL)")
    return rows.select("case_id", "source_page", "pos", "competence", "item_name", F.col("amount_ok").alias("amount"), F.col("salary_ok").alias("base_salary"), "confidence")


def model_conflicts(pages: DataFrame) -> DataFrame:
    """case_id, source_page, pos, field, found_values (JSON), source_pages of the conflicts that answers name; those without a field, values or pages go."""
    rows = pages.select("case_id", F.col("page_number").alias("source_page"), F.posexplode("conflicts").alias("pos", "r")).select("case_id", "source_page", "pos", "r.*")
    rows = rows.where("field IS NOT NULL AND values IS NOT NULL AND source_pages IS NOT NULL")
    return rows.select("case_id", "source_page", "pos", "field", F.to_json("values").alias("found_values"), F.array_join("source_pages", ",").alias("source_pages"))


def page_flags(pages: DataFrame) -> DataFrame:
    """case_id, source_page, kind (missing or ambiguous), pos, flag of the pages' own lists."""
    one = lambda kind: pages.select("case_id", F.col("page_number").alias("source_page"), F.lit(kind).alias("kind"), F.posexplode(f"{kind}_fields").alias("pos", "flag"))
    return one("missing").union(one("ambiguous"))


def with_local(model_rows: DataFrame, local_rows: DataFrame) -> DataFrame:
    """The model's rows and those read locally, as one bag; columns that one side lacks are null."""
    return model_rows.withColumn("origin", F.lit("model")).unionByName(local_rows.withColumn("origin", F.lit("local")), allowMissingColumns=True)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds row_no, the place in the case's result."""
    return rows.withColumn("row_no", F.row_number().over(Window.partitionBy("case_id").orderBy(*order)))


# Conflicts as records


def json_times() -> Column:
    return F.to_json(F.struct(*(F.col(t).alias(t) for t in TIMES)), {"ignoreNullFields": "false"})


def _conflicts(rows: DataFrame, group: list[str], field: Column, value: Column) -> DataFrame:
    """A record for each disputed group of reconciled rows: field, found_values (a JSON list, each value once, in row order), source_pages, first_row."""
    found = rows.where("kept AND disputed").withColumns({"field_": field, "json_": value}).groupBy("case_id", *group)
    values = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "json_"))), lambda x: x["json_"]))
    return found.agg(
        F.min_by("field_", "row_no").alias("field"), F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")).alias("found_values"),
        F.array_join(F.array_sort(F.collect_set("source_page")), ",").alias("source_pages"), F.min("row_no").alias("first_row"),
    ).select("case_id", "field", "found_values", "source_pages", "first_row")


def derived_conflicts(cards: DataFrame, slips: DataFrame) -> list[DataFrame]:
    """Of reconciled time cards, of reconciled payslips, and of base salaries."""
    days = _conflicts(cards, ["day_key"], F.concat(F.lit("time_cards["), "day_key", F.lit("]")), json_times())
    items = _conflicts(slips, ["competence", "label_key"], F.concat(F.lit("payslips["), "competence", F.lit("|"), "item_name", F.lit("]")), cents(F.col("amount")).cast("string"))
    known = slips.where("kept AND base_salary IS NOT NULL").withColumn("salary", cents(F.col("base_salary")).cast("string"))
    values = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "salary"))), lambda x: x["salary"]))
    months = known.groupBy("case_id", "competence").agg(values.alias("v"), F.array_sort(F.collect_set("source_page")).alias("p"), F.min("row_no").alias("first_row"))
    salaries = months.where("size(v) > 1 AND size(p) > 1").select(
        "case_id", F.concat(F.lit("payslips["), "competence", F.lit("].base_salary")).alias("field"),
        F.concat(F.lit("["), F.array_join("v", ","), F.lit("]")).alias("found_values"), F.array_join("p", ",").alias("source_pages"), "first_row")
    return [days, items, salaries]


def all_conflicts(stated: DataFrame, cards: DataFrame, slips: DataFrame) -> DataFrame:
    """The ``stated`` conflicts (case_id, place, field, found_values, source_pages), then those of days, items and salaries, numbered by ``seq`` in each case."""
    parts = [stated.withColumnRenamed("place", "first_row"), *derived_conflicts(cards, slips)]
    rows = reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)])
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("case_id").orderBy("part", "first_row", "field"))).drop("part", "first_row")


def conflict_field(field: Column) -> Column:
    """Struct of kind (time_card, payslip, base_salary; null for a conflict that is not derived), day_or_month and item."""
    def made(kind: str, pattern: str, item: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.regexp_extract(field, pattern, 1).alias("day_or_month"), item.alias("item"))

    none = F.lit(None).cast("string")
    return (
        F.when(field.rlike(SALARY_FIELD), made("base_salary", SALARY_FIELD, none))
        .when(field.rlike(PAYSLIP_FIELD), made("payslip", PAYSLIP_FIELD, F.regexp_extract(field, PAYSLIP_FIELD, 2)))
        .when(field.rlike(TIME_CARD_FIELD), made("time_card", TIME_CARD_FIELD, none))
        .otherwise(F.struct(none.alias("kind"), none.alias("day_or_month"), none.alias("item")))
    )


def is_derived(field: Column) -> Column:
    return field.rlike(SALARY_FIELD) | field.rlike(PAYSLIP_FIELD) | field.rlike(TIME_CARD_FIELD)


def conflict_key(field: Column, pages: Column) -> Column:
    return F.concat_ws(":", field, pages)


def field_label(field: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(F.element_at(names, field), field)


def typed_values(found_values: Column) -> Column:
    """The values of a conflict, a JSON list, each of its own type; null if it is no list."""
    return F.try_variant_get(F.try_parse_json(found_values), "$", "array<variant>")


def value_label(value: Column) -> Column:
    """A number as currency (not a text of digits); the times of an object that are given, entry and exit first; a text as it is; anything else as JSON, an object's keys in alphabetical order."""
    kind = F.schema_of_variant(value)
    field = lambda t: F.try_variant_get(value, f"$.{t}", "string")
    short = (("clock_in", "in"), ("clock_out", "out"), ("break_start", "int. start"), ("break_end", "int. end"))
    parts = F.concat_ws(" · ", *(F.when(F.coalesce(field(t), F.lit("")) != "", F.concat(F.lit(f"{n}: "), field(t))) for t, n in short))
    amount = F.round(F.try_variant_get(value, "$", "decimal(38,6)"), 2)
    money = F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("R$ "), grouped_br(F.abs(amount)))
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & amount.isNotNull()
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))
    return F.when(number, money).when(kind.startswith("OBJECT") & (parts != ""), parts).otherwise(text)


# Validation of a whole result


def validated(cards: DataFrame, slips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw rows validated and reconciled; rows that stay have ``place``, their order by day or month, page and row."""
    place = lambda rows, by: rows.withColumn("place", F.when(F.col("kept"), F.row_number().over(Window.partitionBy("case_id", "kept").orderBy(by, "source_page", "row_no"))))
    return place(records.reconciled_time_cards(cards), "day_key"), place(records.reconciled_payslips(slips), "competence")


def result_flags(stated: DataFrame, cards: DataFrame, slips: DataFrame) -> DataFrame:
    """case_id, missing, ambiguous: the flags of the pages (``stated``: case_id, kind, place, flag), of time cards and of payslips, in this order, each once.

    Only the first place of each flag goes into a list, so a case's list is as short as its flags are few."""
    of = lambda rows, kind, part: rows.where("kept").select(
        "case_id", F.lit(kind).alias("kind"), F.lit(part).alias("part"), "place", F.posexplode(kind).alias("pos", "flag"))
    parts = [stated.select("case_id", "kind", F.lit(0).alias("part"), "place", F.lit(0).alias("pos"), "flag"), of(cards, "missing", 1), of(cards, "ambiguous", 1), of(slips, "ambiguous", 2)]
    first = reduce(DataFrame.union, parts).groupBy("case_id", "kind", "flag").agg(F.min(F.struct("part", "place", "pos")).alias("at"))
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "flag")))), lambda x: x["flag"])
    return first.groupBy("case_id").agg(listed("missing").alias("missing"), listed("ambiguous").alias("ambiguous"))


def result_counts(cards: DataFrame, slips: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Counters of a validated result by case: rows that stay, duplicates removed, rows with a flag, conflicts."""
    flagged = lambda *lists: F.count_if(F.col("kept") & (sum((F.size(c) for c in lists), F.lit(0)) > 0))
    a = cards.groupBy("case_id").agg(F.count_if("kept").alias("time_cards"), F.count_if(~F.col("kept")).alias("d1"), flagged("missing", "ambiguous").alias("f1"))
    b = slips.groupBy("case_id").agg(F.count_if("kept").alias("payslips"), F.count_if(~F.col("kept")).alias("d2"), flagged("ambiguous").alias("f2"))
    c = conflicts.groupBy("case_id").agg(F.count("*").alias("conflicts"))
    n = lambda *cs: sum((F.coalesce(F.col(x), F.lit(0)) for x in cs), F.lit(0)).cast("bigint")
    return a.join(b, "case_id", "full").join(c, "case_id", "full").select(
        "case_id", n("time_cards").alias("time_cards"), n("payslips").alias("payslips"), n("d1", "d2").alias("duplicates_removed"), n("f1", "f2").alias("flagged"), n("conflicts").alias("conflicts"))


def observed(result: DataFrame, name: str, **counters: Column):
    """``result`` with an observation that holds the counters once an action has run; only counts leave the executors."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return result.observe(seen, *(c.alias(n) for n, c in counters.items())), seen


def saved_review(cards: DataFrame, slips: DataFrame, open_conflicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edited rows validated again, and the conflicts: of the open ones those that the model stated, then what the rows still give. Lists of whole pages don't come back."""
    cards, slips = validated(cards, slips)
    stated = open_conflicts.where(~is_derived(F.col("field"))).select("case_id", F.col("seq").alias("place"), "field", "found_values", "source_pages")
    return cards, slips, all_conflicts(stated, cards, slips)


def unconfirmed_pages(cards: DataFrame) -> DataFrame:
    """Pages of each case that have rows with a date to confirm."""
    return cards.where(F.array_contains("ambiguous", "date")).groupBy("case_id").agg(F.array_sort(F.collect_set("source_page")).alias("pages"))


#: What is said about a case, by what happened; words of our own.
NOTES = {
    "no_key": "Somente triagem local; nenhuma página foi enviada ao modelo.",
    "no_candidates": "Nenhuma página candidata.",
    "unclassified": "Nenhuma das páginas candidatas foi classificada.",
    "all_pages_empty": "Todas as páginas foram lidas; nenhuma traz cartão de ponto ou holerite.",
    "short_empty": "Documento curto lido; nenhuma página traz cartão de ponto ou holerite.",
    "all_pages": "Todas as páginas foram lidas, sem triagem.",
    "ranked": "Triagem e leitura das candidatas concluídas.",
}


def pipeline_note() -> Column:
    """The branch of ``NOTES`` for has_key, candidates, classified, extracted, all_pages and short_document; the first that holds."""
    nothing = F.col("extracted") == 0
    return (
        F.when(~F.col("has_key"), "no_key").when(F.col("candidates") == 0, "no_candidates").when(F.col("classified") == 0, "unclassified")
        .when(F.col("all_pages") & nothing, "all_pages_empty").when(F.col("short_document") & nothing, "short_empty").when(F.col("all_pages"), "all_pages").otherwise("ranked")
    )


def note_text(note: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in NOTES.items() for x in pair)), note)

