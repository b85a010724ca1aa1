"""One row of activity counts per (user, active day).

An event is turned into up to four tagged keys (hour, machine, web host, recipient). Counting per
(user, day, tag, key) first makes every distinct count, the busiest hour and the most used machine
a plain second aggregate: two hash shuffles, each after map-side combining, and a day that holds a
large share of all events is spread over its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilume.config import Settings
from vigilume.functions.columns import (
    ARCHIVE, DOCUMENT, EXECUTABLE, after_hours, has_suffix, host_of, is_activity, lacks_domain, one,
)

DAILY_COLUMNS = (
    "http_request_count", "unique_domains", "emails_sent", "total_attachments",
    "external_email_count", "unique_recipients", "file_copy_count", "exe_copy_count",
    "doc_copy_count", "archive_copy_count", "usb_connect_count", "usb_disconnect_count",
    "total_actions", "num_sessions", "active_hours", "after_hours_ratio", "after_hours_actions",
    "peak_hour_concentration", "num_distinct_pcs",
)


def _event_measures(cfg: Settings) -> dict[str, Column]:
    """Per-event amounts whose sums over a day are daily columns."""
    file = is_activity("File")
    external = (
        lacks_domain(F.col("to_addr"), cfg.internal_domain)
        | lacks_domain(F.col("cc"), cfg.internal_domain)
        | lacks_domain(F.col("bcc"), cfg.internal_domain)
    )
    attached = F.coalesce(F.col("attachments").try_cast("int"), F.lit(0))
    return {
        "http_request_count": one(is_activity("Http")),
        "emails_sent": one(is_activity("Email")),
        "total_attachments": F.when(is_activity("Email"), attached).otherwise(0),
        "external_email_count": one(is_activity("Email") & external),
        "file_copy_count": one(file),
        "exe_copy_count": one(file & has_suffix(F.col("filename"), EXECUTABLE)),
        "doc_copy_count": one(file & has_suffix(F.col("filename"), DOCUMENT)),
        "archive_copy_count": one(file & has_suffix(F.col("filename"), ARCHIVE)),
        "usb_connect_count": one(is_activity("Connect")),
        "usb_disconnect_count": one(is_activity("Disconnect")),
        "num_sessions": one(is_activity("Logon")),
        "after_hours_actions": one(after_hours(F.hour("datetime"), cfg)),
    }


def daily_activity(events: DataFrame, cfg: Settings) -> DataFrame:
    measures = _event_measures(cfg)
    keys = {
        "hour": F.hour("datetime").cast("string"),
        "pc": F.col("pc"),
        "host": F.when(is_activity("Http"), host_of(F.col("url"))),
        "to": F.when(is_activity("Email"), F.col("to_addr")),
    }
    # amounts and keys are computed once per event, below the unpivot
    measured = events.select(
        "user_id", F.to_date("datetime").alias("date"),
        *[expr.alias(name) for name, expr in {**measures, **keys}.items()],
    )
    tagged = measured.unpivot(["user_id", "date", *measures], list(keys), "tag", "key").where(F.col("key").isNotNull())
    keyed = tagged.groupBy("user_id", "date", "tag", "key").agg(
        F.count("*").alias("n"), *[F.sum(m).alias(m) for m in measures]
    )
    # every event carries exactly one hour tag, so amounts are summed over those rows only
    on_hour = F.col("tag") == "hour"
    days = keyed.groupBy("user_id", "date").agg(
        *[F.sum(F.when(on_hour, F.col(m))).alias(m) for m in measures],
        F.sum(F.when(on_hour, F.col("n"))).alias("total_actions"),
        F.max(F.when(on_hour, F.col("n"))).alias("_busiest"),
        F.count_if(on_hour).alias("active_hours"),
        F.count_if(F.col("tag") == "pc").alias("num_distinct_pcs"),
        F.count_if(F.col("tag") == "host").alias("unique_domains"),
        F.count_if(F.col("tag") == "to").alias("unique_recipients"),
        # most used machine, ties to the smallest name
        F.min(F.when(F.col("tag") == "pc", F.struct(-F.col("n"), "key")))["key"].alias("pc"),
    )
    total = F.col("total_actions").cast("double")
    return days.select(
        "user_id",
        "date",
        F.weekday("date").alias("dow"),
        "pc",
        *[
            (F.col("after_hours_actions") / total).alias(c) if c == "after_hours_ratio"
            else (F.col("_busiest") / total).alias(c) if c == "peak_hour_concentration"
            else F.col(c)
            for c in DAILY_COLUMNS
        ],
    )


def peak_hours(events: DataFrame) -> DataFrame:
    """Share of a day's events in its busiest hour, as a two-level count."""
    hourly = events.groupBy("user_id", F.to_date("datetime").alias("date"), F.hour("datetime").alias("hour")).count()
    return hourly.groupBy("user_id", "date").agg(
        F.max("count").alias("busiest_hour_actions"),
        F.sum("count").alias("total_actions"),
        (F.max("count") / F.sum("count").cast("double")).alias("peak_hour_concentration"),
    )
