"""Logon-to-logoff sessions, what happened in them, and their daily statistics.

Nothing here pairs sessions with events. Events and session borders are put into one time-ordered stream for each (user,
machine), and a session's amount is the running total at its end minus the one at its start. The streams are scanned in
ranges with a carry (``ordering.segmented``), so a machine with most of all events is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vigilume.config import SESSION, Settings
from vigilume.functions.columns import (
    EXECUTABLE, after_hours, has_suffix, host_of, is_activity, lacks_domain, micros, minutes_between, one,
)
from vigilume.functions.ordering import segmented

HOUR_US = 3_600_000_000
KEY = ["session_id", "user_id", "pc", "session_start"]
# Activities with a count of their own in a session (Logon and Logoff are none).
MIX = ("File", "Email", "Http", "Connect", "Disconnect")


def sessions(events: DataFrame, cfg: Settings) -> DataFrame:
    """Every Logon, closed by the first later Logoff of the same user and machine within the pairing
    limit, else at 23:59:59 of its day. A later Logon does not close a session."""
    limit = cfg.pairing_hours * HOUR_US
    marks = (
        events.where(F.col("activity").isin("Logon", "Logoff"))
        .select("user_id", "pc", "datetime", micros(F.col("datetime")).alias("us"), is_activity("Logoff").alias("off"))
    )
    joinable = ~F.col("off") | (F.col("user_id").isNotNull() & F.col("pc").isNotNull())
    # backwards in time, a Logoff of the same instant after the Logon: the latest one met is the next strictly later one
    paired = segmented(
        marks.where(joinable), ["user_id", "pc"], [F.col("us").desc(), F.col("off").asc()],
        latest={"next_off": F.when(F.col("off"), F.col("datetime"))}, keep=~F.col("off"),
    )
    same = W.partitionBy("user_id", "pc", "us").orderBy("us")
    logons = paired.withColumn("nth", F.row_number().over(same))
    usable = F.col("pc").isNotNull() & (micros(F.col("next_off")) - F.col("us") <= limit)
    day = F.to_date("datetime")
    midnight = F.expr("cast(date_add(cast(datetime as date), 1) as timestamp_ntz) - interval 1 second")
    closed = logons.select(
        F.xxhash64("user_id", "pc", "datetime", "nth").alias("session_id"),
        "user_id", "pc",
        day.alias("session_date"),
        F.col("datetime").alias("session_start"),
        F.when(usable, F.col("next_off")).otherwise(midnight).alias("session_end"),
        F.coalesce(usable, F.lit(False)).alias("closed_by_logoff"),
        F.hour("datetime").alias("hour_of_start"),
    )
    return closed.select(
        "*",
        F.least(minutes_between(F.col("session_start"), F.col("session_end")), F.lit(cfg.session_cap_min)).alias("duration_min"),
        one(after_hours(F.col("hour_of_start"), cfg)).alias("is_after_hours"),
    )


def _inside(events: DataFrame) -> DataFrame:
    """Events that can count towards a session."""
    return events.where(
        ~F.col("activity").isin("Logon", "Logoff") & F.col("user_id").isNotNull() & F.col("pc").isNotNull()
    )


def session_activities(events: DataFrame) -> list[str]:
    """Activities of events that can count towards a session, in order: a code list, one column each."""
    return sorted(r[0] for r in _inside(events).select("activity").distinct().collect() if r[0] is not None)


def session_counts(sess: DataFrame, events: DataFrame, cfg: Settings) -> DataFrame:
    """Additive per-session amounts, without distinct hosts; one row per session.

    ``kinds`` holds the number of events of every activity that ``events`` know, in alphabetical order.
    """
    kinds = session_activities(events)
    exe = is_activity("File") & has_suffix(F.col("filename"), EXECUTABLE)
    measures = {f"_kind_{i}": one(is_activity(a)) for i, a in enumerate(kinds)} | {
        "n_external": one(is_activity("Email") & lacks_domain(F.col("to_addr"), cfg.internal_domain)),
        "n_exe": one(exe),
        "session_attachment_count": F.when(
            is_activity("Email"), F.coalesce(F.col("attachments").try_cast("int"), F.lit(0))
        ).otherwise(0),
    }
    facts = ["session_date", "session_end", "duration_min", "is_after_hours", "hour_of_start"]
    flow = _inside(events).select(
        "user_id", "pc", micros(F.col("datetime")).alias("us"), F.lit(1).alias("rank"), F.lit(0).alias("sign"),
        *[m.alias(f"_m_{n}") for n, m in measures.items()],
    )
    start, end = micros(F.col("session_start")), micros(F.col("session_end"))
    # a border is read before (rank 0) or after (rank 2) the events of its instant
    opening = F.col("sign") < 0
    borders = (
        sess.select(*KEY, *facts, start.alias("s"), F.greatest(start, end).alias("e"), (end < start).alias("empty"))
        .withColumn("sign", F.explode(F.array(F.lit(-1), F.lit(1))))
        .select(
            *KEY, *facts, "sign", F.when(opening, F.col("s")).otherwise(F.col("e")).alias("us"),
            F.when(opening | F.col("empty"), 0).otherwise(2).alias("rank"),
        )
    )
    stream = flow.unionByName(borders, allowMissingColumns=True)
    read = segmented(
        stream, ["user_id", "pc"], [F.col("us").asc(), F.col("rank").asc()], totals={n: F.col(f"_m_{n}") for n in measures}, keep=F.col("sign") != 0
    )
    summed = read.groupBy(*KEY, *facts).agg(*[F.sum(F.col("sign") * F.col(n)).alias(n) for n in measures])
    every = [F.col(f"_kind_{i}") for i in range(len(kinds))]
    of = dict(zip(kinds, every))
    none = F.lit(0).cast("long")
    return summed.select(
        *KEY, *facts, *[of.get(a, none).alias(f"n_{a.lower()}") for a in MIX],
        (F.array(*every) if every else F.array().cast("array<bigint>")).alias("kinds"),
        "n_external", "n_exe", "session_attachment_count",
    )


def session_hosts(sess: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct web hosts per session.

    Sessions that share an end form a bundle: bundles closed by a Logoff do not overlap each other,
    nor do those closed by the end of a day, so an event lies in two bundles of each kind at most: the one that ends next,
    and the one after where that one ends at the event's instant. A host counts for a session when its last visit within
    the bundle is not before the session's start.
    """
    bundle = ["user_id", "pc", "closed_by_logoff", "end_us"]
    spans = sess.where(F.col("session_end") >= F.col("session_start")).select(
        *KEY, "closed_by_logoff", micros(F.col("session_start")).alias("us"), micros(F.col("session_end")).alias("end_us")
    )
    ends = (
        spans.groupBy(*bundle).agg(F.min("us").alias("lo"))
        .select("user_id", "pc", "closed_by_logoff", F.col("end_us").alias("us"), F.struct("lo", "end_us").alias("mark"))
        # met before the visits of its instant, and after them
        .withColumn("rank", F.explode(F.array(F.lit(0), F.lit(2))))
    )
    visits = (
        _inside(events).where(is_activity("Http") & F.col("url").isNotNull())
        .select("user_id", "pc", micros(F.col("datetime")).alias("us"), host_of(F.col("url")).alias("host"), F.lit(1).alias("rank"))
        .withColumn("closed_by_logoff", F.explode(F.array(F.lit(True), F.lit(False))))
    )
    stream = visits.unionByName(ends, allowMissingColumns=True)
    ahead = segmented(
        stream, ["user_id", "pc", "closed_by_logoff"], [F.col("us").desc(), F.col("rank").asc()],
        latest={"here": F.when(F.col("rank") == 0, F.col("mark")), "after": F.when(F.col("rank") == 2, F.col("mark"))}, keep=F.col("rank") == 1,
    )
    last = (
        ahead.select("user_id", "pc", "closed_by_logoff", "us", "host", F.explode(F.array_distinct(F.array("here", "after"))).alias("m"))
        .where(F.col("m.lo") <= F.col("us"))
        .groupBy("user_id", "pc", "closed_by_logoff", F.col("m.end_us").alias("end_us"), "host")
        .agg(F.max("us").alias("us"))
        .drop("host")
        .withColumn("visit", F.lit(1))
    )
    counted = segmented(
        spans.unionByName(last, allowMissingColumns=True), bundle, [F.col("us").desc(), F.col("visit").asc_nulls_last()],
        totals={"session_unique_domains": F.col("visit")}, keep=F.col("visit").isNull(),
    )
    return counted.select(*KEY, F.col("session_unique_domains").cast("long"))


def session_features(sess: DataFrame, events: DataFrame, cfg: Settings, hosts: bool = True) -> DataFrame:
    """Counts, flags and entropy (bits) of the mix of activities per session."""
    counts = session_counts(sess, events, cfg)
    total = F.col("session_event_count")
    entropy = F.aggregate(
        "kinds", F.lit(0.0), lambda a, n: a - F.when(n > 0, n / total * F.log2(n / total)).otherwise(0.0)
    )
    events_in = F.aggregate("kinds", F.lit(0).cast("long"), lambda a, n: a + n)
    out = counts.withColumn("session_event_count", events_in).select(
        *KEY, "session_date", "session_end", "duration_min", "is_after_hours", "hour_of_start",
        "session_event_count",
        F.col("n_file").alias("session_file_count"),
        F.col("n_email").alias("session_email_count"),
        F.col("n_http").alias("session_http_count"),
        one(F.col("n_connect") > 0).alias("session_usb_used"),
        one(F.col("n_external") > 0).alias("session_external_email"),
        one(F.col("n_exe") > 0).alias("session_exe_copied"),
        "session_attachment_count",
        F.when(total > 0, entropy).otherwise(0.0).alias("session_event_entropy"),
    )
    if not hosts:
        return out
    distinct = session_hosts(sess, events)
    return out.join(distinct, KEY, "left").na.fill(0, ["session_unique_domains"])


def add_gaps(sess: DataFrame) -> DataFrame:
    """Add ``gap``: minutes since the end of the session that started before, of the same user and day."""
    ordered = segmented(
        sess, ["user_id", "session_date"], [F.col(c).asc() for c in ("session_start", "pc", "session_id")], previous={"_end": F.col("session_end")}
    )
    return ordered.withColumn("gap", minutes_between(F.col("_end"), F.col("session_start"))).drop("_end")


def session_gaps(sess: DataFrame) -> DataFrame:
    """Longest non-negative gap per user and day, where there is one."""
    gaps = add_gaps(sess.select(*KEY, "session_date", "session_end")).where(F.col("gap") >= 0)
    return gaps.groupBy("user_id", F.col("session_date").alias("date")).agg(F.max("gap").alias("longest_inter_session_gap"))


def daily_session_stats(features: DataFrame, cfg: Settings) -> DataFrame:
    """Session statistics per user and day; with a ``gap`` column also the longest gap (0 without one)."""
    longest = [F.coalesce(F.max(F.when(F.col("gap") >= 0, F.col("gap"))), F.lit(0.0)).alias("longest_inter_session_gap")]
    dur, after = F.col("duration_min"), F.col("is_after_hours")
    usb = F.col("session_usb_used") == 1
    return features.groupBy("user_id", F.col("session_date").alias("date")).agg(
        F.count("*").alias("sess_count"),
        F.avg(dur).alias("mean_session_duration"),
        F.max(dur).alias("max_session_duration"),
        F.stddev_pop(dur).alias("std_session_duration"),
        F.sum(dur).alias("total_session_time"),
        F.sum(after).alias("num_after_hours_sessions"),
        F.avg(after).alias("after_hours_session_ratio"),
        F.min("hour_of_start").alias("earliest_session_hour"),
        F.max("hour_of_start").alias("latest_session_hour"),
        (F.max("hour_of_start") - F.min("hour_of_start")).alias("session_hour_spread"),
        F.avg("session_event_count").alias("mean_session_event_count"),
        F.max("session_event_count").alias("max_session_event_count"),
        F.avg("session_event_entropy").alias("mean_session_entropy"),
        F.sum("session_usb_used").alias("num_usb_sessions"),
        F.sum("session_exe_copied").alias("num_exe_sessions"),
        F.count_if(usb & (after == 1)).alias("usb_after_hours_sessions"),
        F.count_if(F.col("session_file_count") > cfg.heavy_files).alias("file_heavy_sessions"),
        F.count_if(usb & (dur < cfg.short_session_min)).alias("short_usb_sessions"),
        *(longest if "gap" in features.columns else []),
    )


def merge_sessions(days: DataFrame, stats: DataFrame) -> DataFrame:
    """Daily rows with the session statistics of the day (gaps included), 0 where there was no session."""
    joined = days.join(stats, ["user_id", "date"], "left")
    return joined.na.fill(0, list(SESSION)).select(*days.columns, *SESSION)
