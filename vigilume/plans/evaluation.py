"""The evaluation report of scored test windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from vigilume.config import THRESHOLD_METHODS
from vigilume.operators import metrics
from vigilume.session import stored
from vigilume.sources.artifacts import save_report


def evaluate(
    test: DataFrame,
    calibration: DataFrame,
    truth: DataFrame | None = None,
    sessions: DataFrame | None = None,
    methods: Sequence[str] = THRESHOLD_METHODS,
    excluded_scenarios: Sequence[int] = (),
) -> dict[str, DataFrame]:
    """Every part of the report as a table. Users are judged at best F1 where it is among the methods."""
    if excluded_scenarios and truth is not None:
        test = metrics.exclude_scenarios(test, truth, excluded_scenarios)
    steps = stored(metrics.ladder(test), "ladder")
    limits = stored(metrics.thresholds(steps, calibration, methods), "limits")
    best = "best_f1" if "best_f1" in methods else methods[0]
    judged = metrics.judge(test, limits.where(F.col("method") == best))
    per_user = stored(metrics.detection_latency(metrics.per_user_breakdown(judged), truth), "per-user")
    report = {
        "global_metrics": metrics.ranking_metrics(steps),
        "score_separation": metrics.score_separation(test, steps),
        "threshold_results": metrics.threshold_metrics(steps, limits),
        "per_user_results": per_user,
        "user_level_metrics": metrics.user_level_metrics(judged),
        "detection_latency_summary": metrics.latency_summary(per_user),
    }
    if truth is not None:
        report["per_scenario_results"] = metrics.per_scenario(judged, truth)
        if sessions is not None:
            report["session_level_metrics"] = metrics.session_metrics(judged, sessions, truth)
    return report


def write_evaluation(report: dict[str, DataFrame], home: str) -> None:
    for part, table in report.items():
        save_report(table, f"{home}/{part}")
