"""Thresholds and word lists of the case-file engine; every one can be replaced."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Words, markers and patterns of the page triage.
    strong: tuple[str, ...] = ("cartão de ponto", "horas trabalhadas", "holerite", "salário bruto", "contracheque")
    weak: tuple[str, ...] = ("entrada", "saída", "inss", "fgts")
    markers: tuple[str, ...] = (
        "planilha de calculo", "memoria de calculo", "demonstrativo de calculo", "calculo de liquidacao", "liquidacao de sentenca", "atualizacao monetaria", "correcao monetaria",
        "indice de correcao", "juros de mora", "juros moratorios", "laudo pericial", "pje-calc", "pjecalc",
    )
    patterns: tuple[str, ...] = (r"\b\d{1,2}:\d{2}\b", r"\b\d{1,3}(?:\.\d{3})*,\d{2}\b")
    table_mark: str = "|"
    # Scores and limits of the page triage.
    strong_score: float = 300.0
    weak_score: float = 50.0
    pattern_score: float = 10.0
    most_patterns: int = 20
    table_score: float = 50.0
    toc_score: float = 30.0
    neighbor_score: float = 5.0
    least_patterns: int = 4
    candidates: int = 25
    all_pages_up_to: int = 25
    all_visual_up_to: int = 15
    table_checks: int = 10
    page_area: float = 612.0 * 792.0
    # Visual pages.
    ink_relative: float = 0.7
    most_visual_text: int = 200
    raster_coverage: float = 0.85
    least_ink: float = 0.0005
    most_ink: float = 0.5
    least_bands: int = 8
    least_neighbor_bands: int = 3
    least_ruled: int = 16
    least_row_ink: float = 0.005
    least_rule: float = 0.06
    # Time-card cells and confidences.
    tolerance: int = 75
    least_samples: int = 3
    confidence_local: float = 0.95
    confidence_model: float = 0.85
    confidence_pending: float = 0.3
    # Export.
    most_shifts: int = 6
    base_salary_label: str = "Salário-base"
    # Batches, uploads and sessions.
    pages_per_call: int = 5
    strips_per_call: int = 4
    most_upload_bytes: int = 80 * 1024 * 1024
    most_files: int = 60
    calls_per_minute: int = 4
    sweep_seconds: int = 60
    session_seconds: int = 900
    most_sessions: int = 8


#: The driver's test documents hold none of the words above; these occur in them.
TEST_WORDS = Config(strong=("license", "apache"), weak=("the", "und", "les"), markers=("###",), patterns=(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", r"\d{16}"), least_patterns=2)
