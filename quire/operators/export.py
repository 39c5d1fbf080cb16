"""Fixed-layout CSV lines: workdays, histories, their counters and the gate before them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import amount_br, cents, label_key, month_br, slug
from .records import TIMES

#: Name of the file of workdays, first lines of the files, their character sets.
DAY_FILE = "cartao_ponto_jornada.csv"
DAY_HEADER = ";".join(["Data", *(f"{x}{k}" for k in range(1, 7) for x in ("Entrada", "Saída"))])
HISTORY_HEADER = "MES_ANO;VALOR;FGTS;FGTS_REC.;CONTRIBUICAO_SOCIAL;CONTRIBUICAO_SOCIAL_REC."
DAY_CHARSET, HISTORY_CHARSET = "ISO-8859-1", "UTF-8"
UNSAFE = '[;"\r\n]'
#: Words of the notes, by counter.
NOTES = {
    "days": "Dias exportados", "incomplete": "Turnos incompletos, deixados de fora", "unconfirmed": "Registros com data a confirmar, deixados de fora", "unread": "Horários a conferir, deixados vazios",
    "omitted": "Dias sem turno completo, deixados de fora", "dropped": "Turnos além do limite do dia, deixados de fora", "skipped": "Registros com data inválida, deixados de fora",
    "summed": "Lançamentos somados a outro da mesma verba e competência", "skipped_payslips": "Lançamentos com competência inválida, deixados de fora",
}
NOTHING = "Nada foi extraído"


def with_shifts(cards: DataFrame) -> DataFrame:
    """Adds ``complete`` (pairs of times), ``incomplete`` and ``unread`` counts to validated rows."""
    broken = F.col("break_start").isNotNull() | F.col("break_end").isNotNull()
    pair = lambda a, b: F.struct(F.col(a).alias("start"), F.col(b).alias("end"))
    pairs = F.when(broken, F.array(pair("clock_in", "break_start"), pair("break_end", "clock_out"))).otherwise(F.array(pair("clock_in", "clock_out")))
    both, none = lambda p: p["start"].isNotNull() & p["end"].isNotNull(), lambda p: p["start"].isNull() & p["end"].isNull()
    unread = sum((F.when(F.array_contains("ambiguous", t) & F.col(t).isNull(), 1).otherwise(0) for t in TIMES), F.lit(0))
    return cards.withColumn("pairs", pairs).withColumns({"complete": F.filter("pairs", both), "incomplete": F.size(F.filter("pairs", lambda p: ~both(p) & ~none(p))), "unread": unread}).drop("pairs")


def shifts(cards: DataFrame) -> DataFrame:
    """``with_shifts`` of the rows that have a confirmed date."""
    return with_shifts(cards.where(F.col("date").isNotNull() & ~F.array_contains("ambiguous", "date")))


def workdays(cards: DataFrame, config: Config) -> DataFrame:
    """A row for each case and day: up to ``most_shifts`` shifts in row order, and whether the day is left out."""
    found = shifts(cards).groupBy("case_id", "date").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "complete"))), lambda x: x["complete"])).alias("all_shifts"), F.sum(F.col("incomplete") + F.col("unread")).alias("half"))
    kept = F.slice("all_shifts", 1, config.most_shifts)
    cells = F.flatten(F.transform(kept, lambda s: F.array(s["start"], s["end"])))
    padded = F.concat(cells, F.array_repeat(F.lit(""), 2 * config.most_shifts - F.size(cells)))
    return found.select("case_id", "date", F.size("all_shifts").alias("n_shifts"), F.greatest(F.size("all_shifts") - config.most_shifts, F.lit(0)).alias("dropped"), ((F.size("all_shifts") == 0) & (F.col("half") > 0)).alias("omitted"), F.concat_ws(";", F.date_format(F.to_date("date"), "dd/MM/yyyy"), F.array_join(padded, ";")).alias("line"))


def day_columns(cards: DataFrame, config: Config) -> DataFrame:
    """Workdays that are exported, with their shifts in columns start_1, end_1 to the last of ``most_shifts``; null where a day has fewer."""
    days = workdays(cards, config).where("NOT omitted").select("case_id", "date", F.split("line", ";").alias("cells"))
    at = lambda k: F.nullif(F.element_at("cells", k), F.lit(""))
    return days.select("case_id", "date", *(at(2 * k + e).alias(f"{name}_{k}") for k in range(1, config.most_shifts + 1) for e, name in ((0, "start"), (1, "end"))))


def months(slips: DataFrame, config: Config) -> DataFrame:
    """One row for each case, label and month of the rows that stay, from one aggregation: sum and number of its amounts, the label and the base salary of its first rows.

    The months' rows are all that later steps need; labels and salaries come from windows over a case's months, not from the items again."""
    named = slips.where(~F.array_contains("ambiguous", "competence")).groupBy("case_id", "label_key", "competence").agg(
        F.sum(cents(F.col("amount"))).alias("amount"), F.count("*").alias("n"), F.min(F.struct("row_no", "item_name")).alias("first"),
        F.min(F.when(F.col("base_salary").isNotNull(), F.struct("row_no", cents(F.col("base_salary")).alias("salary")))).alias("pay"))
    case, label, month = (Window.partitionBy("case_id", *keys) for keys in ([], ["label_key"], ["competence"]))
    named = named.withColumn("label", F.min("first").over(label)["item_name"]).withColumn("month_pay", F.min("pay").over(month)).withColumn("nth", F.row_number().over(month.orderBy("label_key")))
    is_base = slug(F.col("label")) == slug(F.lit(config.base_salary_label))
    return named.withColumn("has_base", F.max(is_base).over(case)).select(
        "case_id", "label_key", "competence", F.col("amount").cast("decimal(28,2)").alias("amount"), "n", "label", F.when(~F.col("has_base") & (F.col("nth") == 1), F.col("month_pay.salary")).alias("salary"))


def histories(slips: DataFrame, config: Config) -> DataFrame:
    """A row for each case, label and month: the sum of its amounts and how many rows were merged; base salaries as a label of their own unless an item has its slug."""
    base = F.lit(config.base_salary_label)
    item = F.struct("label_key", "amount", "n", "label", F.lit(False).alias("is_base"))
    salary = F.struct(label_key(base).alias("label_key"), F.col("salary").cast("decimal(28,2)").alias("amount"), F.lit(1).cast("bigint").alias("n"), base.alias("label"), F.lit(True).alias("is_base"))
    both = F.array_compact(F.array(item, F.when(F.col("salary").isNotNull(), salary)))
    return months(slips, config).select("case_id", "competence", F.inline(both)).select("case_id", "label_key", "competence", "amount", "n", "label", "is_base")


def history_lines(rows: DataFrame) -> DataFrame:
    """Each line of each file, with the file's name."""
    order = Window.partitionBy("case_id").orderBy(F.desc("is_base"), "label_key")
    numbered = rows.withColumn("file_no", F.dense_rank().over(order))
    name = F.concat(F.lit("historico_salarial_"), F.format_string("%02d", "file_no"), F.lit("_"), slug(F.regexp_replace("label", UNSAFE, " ")), F.lit(".csv"))
    line = F.concat(month_br(F.col("competence")), F.lit(";"), amount_br(F.col("amount")), F.lit(";;;;"))  # what a slip doesn't say stays empty
    return numbered.select("case_id", name.alias("file_name"), "competence", "n", "is_base", line.alias("line"))


def file_bytes(lines: DataFrame, group: list[str], order: str, header: str, charset: str) -> DataFrame:
    """The content of each file: header and lines, CR LF between them and none at the end; what the charset lacks becomes a question mark."""
    text = F.concat_ws("\r\n", F.lit(header), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\r\n"))
    if charset.lower() == "iso-8859-1":
        text = F.regexp_replace(text, r"[^\x00-\xFF]", "?")
    return lines.groupBy(*group).agg(F.encode(text, charset).alias("content"))


def summary(cards: DataFrame, config: Config) -> DataFrame:
    """Counters of a case's workday export: one aggregation by case and day, one by case."""
    dated = F.col("date").isNotNull()
    unsure = dated & F.array_contains("ambiguous", "date")
    rows = with_shifts(cards).withColumn("used", dated & ~unsure)
    of = lambda c: F.sum(F.when(F.col("used"), F.col(c)).otherwise(0))
    days = rows.groupBy("case_id", F.when(F.col("used"), F.col("date")).alias("date")).agg(
        F.count_if(~dated).alias("skipped"), F.count_if(unsure).alias("unconfirmed"), of("incomplete").alias("incomplete"), of("unread").alias("unread"),
        F.sum(F.when(F.col("used"), F.size("complete")).otherwise(0)).alias("n_shifts"))
    omitted = F.col("date").isNotNull() & (F.col("n_shifts") == 0) & (F.col("incomplete") + F.col("unread") > 0)
    kept = F.col("date").isNotNull() & ~omitted
    total = lambda c: F.sum(c).cast("bigint").alias(c)
    return days.groupBy("case_id").agg(
        total("skipped"), total("unconfirmed"), total("incomplete"), total("unread"), F.count_if(kept).alias("days"), F.count_if(omitted).alias("omitted"),
        F.sum(F.when(kept, F.greatest(F.col("n_shifts") - config.most_shifts, F.lit(0))).otherwise(0)).cast("bigint").alias("dropped"))


def slip_summary(slips: DataFrame) -> DataFrame:
    """Counters of a case's history export: rows without a valid month, and rows that were added to another of their label and month."""
    rows = slips.withColumn("bad", F.array_contains("ambiguous", "competence"))
    groups = rows.groupBy("case_id", "label_key", "competence").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    return groups.groupBy("case_id").agg(F.sum("bad").alias("skipped_payslips"), F.sum(F.greatest(F.col("good") - 1, F.lit(0))).alias("summed"))


def notes(counters: DataFrame, lines: DataFrame) -> DataFrame:
    """The text that goes with a case's files: a line for each of the ``counters`` above zero and for each history file; it starts with a byte-order mark and ends its lines with CR LF."""
    files = lines.groupBy("case_id", "file_name").agg(F.count("*").alias("n"))
    file = F.concat(F.lit("- "), "file_name", F.lit(": "), F.col("n").cast("string"))
    files = files.groupBy("case_id").agg(F.array_sort(F.collect_list(file)).alias("files"))
    said = [F.when(F.col(c) > 0, F.concat(F.lit(f"{words}: "), F.col(c).cast("string"))) for c, words in NOTES.items() if c in counters.columns]
    text = F.concat(F.array_compact(F.array(*said)), F.coalesce("files", F.array().cast("array<string>")))
    body = F.when(F.size(text) == 0, F.array(F.lit(NOTHING))).otherwise(text)
    return counters.join(files, "case_id", "full").select("case_id", F.concat(F.lit("\ufeff"), F.array_join(body, "\r\n"), F.lit("\r\n")).alias("text"))


def day_files(cards: DataFrame, config: Config) -> DataFrame:
    """Each case's file of workdays."""
    return file_bytes(workdays(cards, config).where("NOT omitted"), ["case_id"], "date", DAY_HEADER, DAY_CHARSET)


def history_files(lines: DataFrame) -> DataFrame:
    """Each case's history files, a month a line."""
    return file_bytes(lines, ["case_id", "file_name"], "competence", HISTORY_HEADER, HISTORY_CHARSET)


def open_cases(rows: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Cases that may be exported: those without a conflict."""
    return rows.select("case_id").distinct().join(conflicts.select("case_id").distinct(), "case_id", "left_anti")
