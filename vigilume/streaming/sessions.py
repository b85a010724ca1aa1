"""Live logon-to-logoff pairing.

Marks are keyed by (user, machine, time bin): a bin is as wide as the pairing limit, and a Logoff goes to its own bin and the one
before. Each bin keeps two lists, of its Logons and its Logoffs, to which a batch appends its new marks; nothing else is
written. A Logon gives its session at once, with the end that holds while no Logoff is known, and again whenever a Logoff changes that
end; the newest row of a session counts. A timer forgets a bin once the watermark shows that no Logoff within the limit can still arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigilume.config import Settings
from vigilume.functions.columns import after_hours, epoch_instant, from_micros, is_activity, micros, one

HOUR_US = 3_600_000_000
#: What makes a session, for reading the newest row of each; ``nth`` tells Logons of one instant apart.
SESSION_KEYS = ["user_id", "pc", "session_start", "nth"]
_OUT = "user_id string, pc string, start_us bigint, nth int, end_us bigint"


def live_sessions(events: DataFrame, cfg: Settings, late: str = "1 day") -> DataFrame:
    """Sessions of an event stream, for the update output mode: new ones, and those whose end has changed."""
    limit = cfg.pairing_hours * HOUR_US

    # nested, so that it travels to the workers whole
    class PairMarks(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.logons = handle.getListState("logons", "us bigint")
            self.logoffs = handle.getListState("logoffs", "us bigint")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
            parts = list(rows)
            off = np.concatenate([p["off"].to_numpy(dtype=bool) for p in parts])
            us = np.concatenate([p["us"].to_numpy(dtype="int64") for p in parts])
            logons, logoffs = (np.array([r[0] for r in state.get()], dtype="int64") for state in (self.logons, self.logoffs))
            for state, new in ((self.logons, us[~off]), (self.logoffs, us[off])):
                if len(new):
                    state.appendList([(int(u),) for u in new])
            # known Logons first among those of one instant, so that each keeps its number
            starts = np.concatenate([logons, us[~off]])
            paired = not any(k is None or k != k for k in key[:2])
            before = np.concatenate([next_off(logons, logoffs, paired), np.full((~off).sum(), -2)])
            order = np.argsort(starts, kind="stable")
            starts, before = starts[order], before[order]
            after = next_off(starts, np.concatenate([logoffs, us[off]]), paired)
            changed = after != before
            first = np.searchsorted(starts, starts, side="left")
            self.handle.registerTimer((int(key[2]) + 2) * limit // 1000 + 1)
            if changed.any():
                yield pd.DataFrame(
                    {
                        "user_id": key[0], "pc": key[1], "start_us": starts[changed],
                        "nth": (np.arange(len(starts)) - first)[changed].astype("int32"),
                        "end_us": pd.array([None if e < 0 else e for e in after[changed].tolist()], dtype="Int64"),
                    }
                )

        def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
            self.logons.clear()
            self.logoffs.clear()
            return iter([])

        def close(self) -> None:
            pass

    def next_off(starts: np.ndarray, logoffs: np.ndarray, paired: bool) -> np.ndarray:
        """The first strictly later Logoff within the limit, -1 without one."""
        if not paired or not len(logoffs):
            return np.full(len(starts), -1)
        logoffs = np.sort(logoffs)
        at = np.searchsorted(logoffs, starts, side="right")
        found = logoffs[np.minimum(at, len(logoffs) - 1)]
        return np.where((at < len(logoffs)) & (found - starts <= limit), found, -1)

    us = micros(F.col("datetime"))
    home = F.floor(us / F.lit(limit)).cast("long")
    off = is_activity("Logoff")
    marks = (
        events.where(F.col("activity").isin("Logon", "Logoff"))
        .withColumn("ts", epoch_instant(F.col("datetime")))
        .withWatermark("ts", late)
        .select("ts", "user_id", "pc", us.alias("us"), off.alias("off"), F.explode(F.when(off, F.array(home - 1, home)).otherwise(F.array(home))).alias("bin"))
    )
    paired = marks.groupBy("user_id", "pc", "bin").transformWithStateInPandas(PairMarks(), _OUT, "update", "eventtime")
    midnight = F.expr("cast(date_add(cast(session_start as date), 1) as timestamp_ntz) - interval 1 second")
    timed = paired.select("user_id", "pc", "nth", from_micros(F.col("start_us")).alias("session_start"), from_micros(F.col("end_us")).alias("paired"))
    ended = timed.withColumn("session_end", F.coalesce("paired", midnight))
    minutes = F.timestamp_diff("MICROSECOND", F.col("session_start"), F.col("session_end")) / F.lit(60e6)
    return ended.select(
        "user_id", "pc", "nth", F.to_date("session_start").alias("session_date"), "session_start", "session_end",
        F.hour("session_start").alias("hour_of_start"), F.least(minutes, F.lit(cfg.session_cap_min)).alias("duration_min"),
        one(after_hours(F.hour("session_start"), cfg)).alias("is_after_hours"),
    )
