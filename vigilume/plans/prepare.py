"""From the unified log and its context tables to features, splits and fitted artifacts."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from vigilume.config import Settings
from vigilume.functions.folded import unfold
from vigilume.operators import context, daily, features, sessions, windows
from vigilume.session import stored
from vigilume.sources import artifacts


@dataclass(frozen=True)
class Inputs:
    """The event log and its context; ``truth`` is None where nothing is known."""

    events: DataFrame
    snapshots: DataFrame
    traits: DataFrame
    truth: DataFrame | None = None

    def with_events(self, events: DataFrame) -> Inputs:
        return replace(self, events=events)


def merged_days(events: DataFrame, cfg: Settings) -> DataFrame:
    """Daily activity with the session statistics of the day.

    Gaps are read on the way from sessions to days, so the sessions are paired once.
    """
    features = sessions.session_features(sessions.sessions(events, cfg), events, cfg, hosts=False)
    stats = sessions.daily_session_stats(sessions.add_gaps(features), cfg)
    return sessions.merge_sessions(daily.daily_activity(events, cfg), stats)


def enriched_days(inputs: Inputs, cfg: Settings) -> DataFrame:
    return context.enrich(merged_days(inputs.events, cfg), inputs.snapshots, inputs.traits, inputs.truth)


def enriched_folded(inputs: Inputs, cfg: Settings) -> DataFrame:
    """The same with one row per user and day (``functions.folded``)."""
    return context.enrich_folded(merged_days(inputs.events, cfg), inputs.snapshots, inputs.traits, inputs.truth)


def day_features(inputs: Inputs, cfg: Settings) -> DataFrame:
    """Unscaled features of every user and active day, folded."""
    days = windows.min_days_filter(enriched_folded(inputs, cfg), cfg.min_days)
    return features.featured(days, cfg)


@dataclass(frozen=True)
class Prepared:
    """Stored features with the user splits and the parameters fitted on the training users.

    ``days`` are folded; what is scaled and encoded has a row for each change row and trait row of a day.
    """

    days: DataFrame
    splits: DataFrame
    scaler: DataFrame
    dictionaries: dict[tuple[str, ...], DataFrame] = field(default_factory=dict, repr=False, compare=False)

    def scaled(self, cfg: Settings) -> DataFrame:
        return unfold(self.scaled_folded(cfg))

    def scaled_folded(self, cfg: Settings) -> DataFrame:
        return features.apply_scaler(self.days, self.scaler, cfg.scaled)

    def dictionary(self, cfg: Settings) -> DataFrame:
        """Fitted and stored at its first use: every encoded column reads it."""
        columns = tuple(cfg.categorical)
        if columns not in self.dictionaries:
            self.dictionaries[columns] = stored(features.fit_dictionary(self.days, columns), "dictionary")
        return self.dictionaries[columns]

    def encoded(self, cfg: Settings) -> DataFrame:
        frequent = features.frequent_values(self.days, cfg.categorical)
        return unfold(features.encode(self.scaled_folded(cfg), self.dictionary(cfg), cfg.categorical, frequent))


def prepare(inputs: Inputs, cfg: Settings) -> Prepared:
    """Compute the features once, store them, and fit on the training users."""
    days = stored(day_features(inputs, cfg), "features")
    splits = stored(windows.split_users(days, cfg), "splits")
    train = days.join(splits.where(F.col("split") == "train"), "user_id", "left_semi")
    return Prepared(days, splits, stored(features.fit_scaler(train, cfg.scaled), "scaler"))


def save_prepared(ready: Prepared, inputs: Inputs, cfg: Settings, home: str) -> None:
    """Write the scaled days by split, the artifacts and the sessions under ``home``."""
    artifacts.save(f"{home}/artifacts", ready.scaler, ready.dictionary(cfg), cfg)
    artifacts.save_days(ready.encoded(cfg), ready.splits, f"{home}/days")
    artifacts.save_sessions(sessions.sessions(inputs.events, cfg), f"{home}/sessions")


def training_windows(ready: Prepared, cfg: Settings) -> DataFrame:
    """Windows of all splits with their split, checked for leaks."""
    coded = [f"{c}_encoded" for c in cfg.categorical]
    cut = stored(windows.sliding_windows(ready.encoded(cfg), cfg.vector, coded, cfg.lookback, cfg.stride), "windows")
    windows.check_clean_splits(cut, ready.splits)
    return cut.join(ready.splits, "user_id")
