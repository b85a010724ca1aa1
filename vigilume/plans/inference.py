"""Scoring a date range with saved artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilume.config import Settings
from vigilume.functions.folded import FOLD
from vigilume.operators import metrics, scoring, triage
from vigilume.plans.prepare import Inputs, Prepared, day_features
from vigilume.session import stored
from vigilume.sources import logs
from vigilume.sources.artifacts import Artifacts, save_report, save_scores


def inference_features(
    inputs: Inputs,
    cfg: Settings,
    fitted: Artifacts,
    users: list[str] | DataFrame | None = None,
    date_range: tuple[str, str] | None = None,
) -> DataFrame:
    """Features of the given users and dates, scaled and encoded without fitting.

    Dates and users are restricted on the event scan. Per-user z-scores see only the days read. The days are folded
    (``functions.folded``).
    """
    events = inputs.events
    if date_range is not None:
        events = logs.events_in_range(events, *date_range, cfg)
    if users is not None:
        events = logs.for_users(events, users)
    return fitted.apply(day_features(inputs.with_events(events), cfg))


def dense_scores(days: DataFrame, cfg: Settings, since: str | None = None) -> DataFrame:
    """A score for every window that ends on an active day; ``since`` drops those ending earlier."""
    errors = scoring.day_error(scoring.profile_errors(days, cfg.vector, cfg.profile_days), cfg.behavioural, cfg.profile_days)
    scored = scoring.window_score(errors, cfg.lookback, 1, cfg)
    return scored if since is None else scored.where(F.col("end_date") >= F.lit(since).cast("date"))


def calibration_limit(ready: Prepared, cfg: Settings, method: str = "percentile_95") -> DataFrame:
    """One row: a threshold from the windows of validation (else training) users."""
    days = ready.scaled_folded(cfg)
    errors = scoring.day_error(scoring.profile_errors(days, cfg.vector, cfg.profile_days), cfg.behavioural, cfg.profile_days)
    scored = stored(scoring.window_score(errors, cfg.lookback, cfg.stride, cfg), "calibration")
    return metrics.thresholds(None, scoring.calibration_scores(scored, ready.splits), [method])


def score_range(days: DataFrame, limit: DataFrame, cfg: Settings, since: str | None = None) -> DataFrame:
    """Risk per user from inference features and a threshold row."""
    return triage.user_risk(metrics.judge(dense_scores(days, cfg, since), limit))


def write_risk_report(days: DataFrame, limit: DataFrame, method: str, cfg: Settings, home: str) -> None:
    """Scores, one JSON line per user (with top windows and indicators), and the report summary.

    Users are written as lines of a table, so a report has no size limit.
    """
    errors = scoring.profile_errors(days, cfg.vector, cfg.profile_days)
    errors = stored(errors.select("user_id", "date", "is_insider", *[c for c in errors.columns if c in (*cfg.vector, *FOLD)]), "errors")
    scored = stored(scoring.window_score(scoring.day_error(errors, cfg.behavioural, cfg.profile_days), cfg.lookback, 1, cfg), "scores")
    save_scores(scored, f"{home}/scores")
    judged = metrics.judge(scored, limit)
    risk = triage.user_risk(judged)
    best = triage.top_windows(scored).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "score", F.col("end_date").alias("date")))).alias("top_anomalous_windows")
    )
    found = triage.risk_indicators(scoring.unfold_errors(errors, cfg.vector, cfg.profile_days), judged, cfg.vector, cfg.lookback, 1)
    save_report(risk.join(best, "user_id", "left").join(found, "user_id", "left"), f"{home}/users")
    save_report(triage.report_metadata(judged, method), f"{home}/metadata")
    save_report(triage.severity_counts(risk), f"{home}/by_severity")
