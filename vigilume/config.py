"""Settings and the fixed feature lists of the behaviour model."""

from __future__ import annotations

from dataclasses import dataclass

# Feature names, in the order in which a day vector is laid out.
CONTINUOUS = (
    "http_request_count",
    "unique_domains",
    "emails_sent",
    "total_attachments",
    "external_email_count",
    "unique_recipients",
    "file_copy_count",
    "exe_copy_count",
    "doc_copy_count",
    "archive_copy_count",
    "usb_connect_count",
    "usb_disconnect_count",
    "total_actions",
    "num_sessions",
    "active_hours",
    "after_hours_ratio",
    "after_hours_actions",
    "peak_hour_concentration",
    "num_distinct_pcs",
    "openness",
    "conscientiousness",
    "extraversion",
    "agreeableness",
    "neuroticism",
)
INTERACTION = (
    "file_usb_interaction",
    "external_email_attachments",
    "http_after_hours",
    "email_after_hours",
)
SESSION = (
    "sess_count",
    "mean_session_duration",
    "max_session_duration",
    "std_session_duration",
    "total_session_time",
    "num_after_hours_sessions",
    "after_hours_session_ratio",
    "earliest_session_hour",
    "latest_session_hour",
    "session_hour_spread",
    "mean_session_event_count",
    "max_session_event_count",
    "mean_session_entropy",
    "num_usb_sessions",
    "num_exe_sessions",
    "longest_inter_session_gap",
    "usb_after_hours_sessions",
    "file_heavy_sessions",
    "short_usb_sessions",
)
CYCLICAL = ("day_of_week_sin", "day_of_week_cos")
BINARY = (
    "is_weekend",
    "role_changed",
    "dept_changed",
    "functional_unit_changed",
    "terminated_flag",
)
CONTEXT_ONLY = ("openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism")
CATEGORICAL = ("user_id", "pc", "role", "department", "functional_unit")
USER_NORMALIZED = (
    "http_request_count",
    "emails_sent",
    "file_copy_count",
    "total_actions",
    "sess_count",
    "mean_session_duration",
    "total_session_time",
)
# Fields kept as they are; every other count or duration is log1p-transformed.
UNLOGGED = (
    "num_sessions",
    "active_hours",
    "after_hours_ratio",
    "peak_hour_concentration",
    "num_distinct_pcs",
    "openness",
    "conscientiousness",
    "extraversion",
    "agreeableness",
    "neuroticism",
    "std_session_duration",
    "after_hours_session_ratio",
    "earliest_session_hour",
    "latest_session_hour",
    "session_hour_spread",
    "mean_session_entropy",
)
# Functional unit codes.
FUNCTIONAL_UNIT_CODES = {
    "Administration": 1,
    "ResearchAndEngineering": 2,
    "Manufacturing": 3,
    "Finance": 4,
    "SalesAndMarketing": 5,
    "PurchasingAndContracts": 6,
}
# Threshold methods, and those that look at test labels.
THRESHOLD_METHODS = (
    "best_f1",
    "percentile_99",
    "percentile_95",
    "mean_plus_3std",
    "fixed_recall_95",
    "fixed_recall_99",
)
LABEL_AWARE_METHODS = ("best_f1", "fixed_recall_95", "fixed_recall_99")


@dataclass(frozen=True)
class Settings:
    """Parameters shared by the operators; defaults suit a corpus of many months."""

    internal_domain: str = "@dtaa.com"
    dataset: str = "4.2"
    work_start: int = 8
    work_end: int = 18
    pairing_hours: int = 12
    session_cap_min: float = 720.0
    heavy_files: int = 10
    short_session_min: float = 15.0
    rolling_window: int = 20
    lookback: int = 60
    stride: int = 5
    min_days: int | None = None
    train_share: float = 0.70
    val_share: float = 0.15
    seed: int = 42
    copies: int = 5
    noise_std: float = 0.05
    dropout_rate: float = 0.1
    scale_range: tuple[float, float] = (0.9, 1.1)
    mean_weight: float = 0.5
    max_weight: float = 0.5
    profile_days: int = 20
    #: Events listed for a session in drill-downs (None: all); counts, flags and risk come from all of them.
    shown_events: int | None = 10
    categorical: tuple[str, ...] = CATEGORICAL
    normalized: tuple[str, ...] = USER_NORMALIZED

    @property
    def user_relative(self) -> list[str]:
        """Per-user z-score and rolling columns, grouped by their base column."""
        return [f"{c}_{s}" for c in self.normalized for s in ("zscore", "rolling_mean", "rolling_std")]

    @property
    def scaled(self) -> list[str]:
        return [*CONTINUOUS, *INTERACTION, *SESSION, *self.user_relative]

    @property
    def vector(self) -> list[str]:
        """All numeric columns of a day, scaled ones first."""
        return [*self.scaled, *CYCLICAL, *BINARY]

    @property
    def behavioural(self) -> list[str]:
        """The columns that enter a score: all but the context-only ones."""
        missing = [c for c in CONTEXT_ONLY if c not in self.vector]
        if missing:
            raise ValueError(f"context-only columns are not part of the day vector: {missing}")
        return [c for c in self.vector if c not in CONTEXT_ONLY]
