"""A job from pages to export: triage, calls, answers, rows, validation, conflicts, gate and lines, for many cases at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import Config
from ..sources.files import kept
from . import answers, export, records, results, triage


@dataclass
class Job:
    """What a job leaves at its steps; ``seen`` are the counters of triage, classification and validation, observed while their tables are written."""

    candidates: DataFrame
    asked: DataFrame
    pages: DataFrame
    unclassified: DataFrame
    cards: DataFrame
    slips: DataFrame
    conflicts: DataFrame
    flags: DataFrame
    lines: DataFrame
    seen: dict[str, Observation]


def run(signals: DataFrame, ask: Callable[[DataFrame], DataFrame], config: Config, local: DataFrame | None = None) -> Job:
    """Run all steps on the pages' ``signals``. ``ask`` gets the pages of each call (case_id, page_number, call) and gives the answers (case_id, call, answer).

    Time cards that were read elsewhere (``local``) join those of the model. The steps that several later ones read are written once: what was asked, the pages' answers, the
    validated rows. Only cases without a conflict are exported."""
    seen = {}

    def observed(table: DataFrame, name: str, /, **counters) -> DataFrame:
        watched, seen[name] = results.observed(table, name, **counters)
        return kept(watched, name)

    candidates = observed(triage.triage(signals, config).select("case_id", "page_number", "rank", "score", "overflow"), "triage", candidates=F.count(F.lit(1)), overflow=F.count_if("overflow"))
    asked = triage.batches(candidates.where("NOT overflow").select("case_id", "page_number"), config.pages_per_call)
    pages = results.model_pages(asked, ask(asked))
    pages = observed(pages, "classification", pages=F.count(F.lit(1)), relevant=F.count_if(F.col("document_type") != answers.TYPES[2]))
    cards = results.time_card_rows(pages)
    cards = results.numbered(cards if local is None else results.with_local(cards, local), "source_page", "pos").drop("pos")
    slips = results.numbered(results.payslip_rows(pages), "source_page", "pos").drop("pos")
    cards, slips = results.validated(cards, slips)
    counters = {"rows": F.count(F.lit(1)), "duplicates": F.count_if(~F.col("kept")), "disputed": F.count_if(F.col("kept") & F.col("disputed"))}
    cards, slips = observed(cards, "time_cards", **counters), observed(slips, "payslips", **counters)
    stated = results.model_conflicts(pages).select("case_id", F.col("source_page").alias("place"), "field", "found_values", "source_pages")
    conflicts = results.all_conflicts(stated, cards, slips)
    flags = results.result_flags(results.page_flags(pages).select("case_id", "kind", (F.col("source_page") * 10 + F.col("pos")).alias("place"), "flag"), cards, slips)
    free = export.open_cases(cards.where("kept"), conflicts)
    lines = export.workdays(cards.where("kept").join(free, "case_id", "left_semi"), config).where("NOT omitted").select("case_id", "date", "line")
    unclassified = answers.unclassified(asked, pages, candidates.where("overflow"))
    return Job(candidates, asked, pages, unclassified, cards, slips, conflicts, flags, lines, seen)


def case_counts(job: Job) -> DataFrame:
    """A row for each case that has a candidate: pages sent, calls, pages without an answer, rows that stay, conflicts, exported lines."""
    sent = job.asked.groupBy("case_id").agg(F.count("*").alias("sent"), F.count_distinct("call").alias("calls"))
    count = lambda rows, name: rows.groupBy("case_id").agg(F.count("*").alias(name))
    parts = [count(job.unclassified, "unclassified"), count(job.cards.where("kept"), "time_cards"), count(job.slips.where("kept"), "payslips"), count(job.conflicts, "conflicts"), count(job.lines, "lines")]
    for part in parts:
        sent = sent.join(part, "case_id", "left")
    names = ("unclassified", "time_cards", "payslips", "conflicts", "lines")
    return sent.select("case_id", "sent", "calls", *(F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names))
