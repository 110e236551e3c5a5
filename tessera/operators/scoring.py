"""Accuracy harness: answers and rows against golds, by failure class."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.verify import figures

TOLERANCE_PCT = 0.5


@dataclass(frozen=True)
class Case:
    """``kind``: scalar, scalar_row, rows_prefix (names, figures and order) or rows_contains."""

    question: str
    kind: str
    gold: object
    tolerance_pct: float = TOLERANCE_PCT


def close(value: float, gold: float, tolerance_pct: float = TOLERANCE_PCT) -> bool:
    return abs(value - gold) <= max(abs(gold) * tolerance_pct / 100, 0.005)


def score_case(case: Case, answer: str, rows: list[list]) -> tuple[bool, bool]:
    """B1: (the answer has the gold, the rows have it)."""
    said = figures(answer)
    cells = [float(c) for r in rows for c in r if isinstance(c, (int, float)) and not isinstance(c, bool)]
    has = lambda name: any(str(name).lower() == str(c).lower() for r in rows for c in r)
    near = lambda xs, g: any(close(x, float(g), case.tolerance_pct) for x in xs)
    if case.kind == "scalar":
        return near(said, case.gold), near(cells, case.gold)
    if case.kind == "scalar_row":
        name, value = case.gold
        return str(name).lower() in answer.lower() and near(said, value), has(name) and near(cells, value)
    golds = [g if isinstance(g, (list, tuple)) else (None, g) for g in case.gold]
    told = all((n is None or str(n).lower() in answer.lower()) and near(said, x) for n, x in golds)
    fits = lambda r, g: (g[0] is None or any(str(g[0]).lower() == str(c).lower() for c in r)) and near([float(c) for c in r if isinstance(c, (int, float)) and not isinstance(c, bool)], g[1])
    if case.kind == "rows_prefix":
        return told, len(rows) >= len(golds) and all(fits(r, g) for r, g in zip(rows, golds, strict=False))
    return told, all(any(fits(r, g) for r in rows) for g in golds)


def score_table(results: DataFrame, gold: DataFrame, tolerance_pct: float = TOLERANCE_PCT) -> DataFrame:
    """B1, B2 over tables: per case, whether its value is within the tolerance of its gold (case, value / gold)."""
    ok = F.abs(F.col("value") - F.col("gold")) <= F.greatest(F.abs("gold") * (tolerance_pct / 100), F.lit(0.005))
    return gold.join(results, "case", "left").select("case", F.coalesce(ok, F.lit(False)).alias("ok"))


@dataclass
class Report:
    records: list[dict] = field(default_factory=list)

    def add(self, case: Case, result) -> None:
        """B2: one question's outcome."""
        told, ran = score_case(case, result.answer, result.rows)
        self.records.append({"question": case.question, "match": told, "exec_match": ran, "attempts": result.attempts, "failures": [f.value for f in result.failures], "seconds": result.seconds})

    def aggregate(self) -> dict:
        n = len(self.records) or 1
        bad = {"unknown_column", "ungrounded_answer"}
        return {
            "cases": len(self.records), "exact_match": sum(r["match"] for r in self.records) / n, "execution_accuracy": sum(r["exec_match"] for r in self.records) / n,
            "retry_rate": sum(r["attempts"] > 1 for r in self.records) / n, "hallucination_rate": sum(bool(bad & set(r["failures"])) for r in self.records) / n,
            "seconds": sum(r["seconds"] for r in self.records),
        }

    def compare(self, baseline: dict) -> dict:
        """Differences to an earlier aggregate."""
        return {k: v - baseline[k] for k, v in self.aggregate().items() if isinstance(baseline.get(k), (int, float))}
