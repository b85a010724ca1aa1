"""Severity, risk indicators, drill-downs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vigilume.config import Settings
from vigilume.functions.columns import is_activity, micros, ratio, with_scalars
from vigilume.functions.ordering import ranked
from vigilume.operators.metrics import last_interval
from vigilume.session import stored

# Indicator texts by feature.
INDICATOR_TEXT = {
    "http_request_count": "Web browsing anomaly",
    "unique_domains": "Web browsing anomaly",
    "emails_sent": "Email volume deviation",
    "total_attachments": "Email attachment anomaly",
    "external_email_count": "External email spike",
    "unique_recipients": "Unusual email recipients",
    "file_copy_count": "File copy anomaly",
    "exe_copy_count": "Executable file copying",
    "doc_copy_count": "Document copying anomaly",
    "archive_copy_count": "Archive file copying",
    "usb_connect_count": "USB device usage anomaly",
    "usb_disconnect_count": "USB device usage anomaly",
    "total_actions": "Overall activity spike",
    "openness": "Personality trait deviation",
    "conscientiousness": "Personality trait deviation",
    "extraversion": "Personality trait deviation",
    "agreeableness": "Personality trait deviation",
    "neuroticism": "Personality trait deviation",
    "file_usb_interaction": "File copy with USB device",
    "external_email_attachments": "External email with attachments",
    "http_after_hours": "After-hours web browsing",
    "email_after_hours": "After-hours email activity",
    "sess_count": "Unusual number of sessions",
    "mean_session_duration": "Unusual session duration pattern",
    "max_session_duration": "Unusually long session",
    "std_session_duration": "Erratic session durations",
    "total_session_time": "Unusual total session time",
    "num_after_hours_sessions": "After-hours session activity",
    "after_hours_session_ratio": "High after-hours session ratio",
    "earliest_session_hour": "Unusually early session start",
    "latest_session_hour": "Unusually late session start",
    "session_hour_spread": "Wide session time spread",
    "mean_session_event_count": "Unusual events per session",
    "max_session_event_count": "Session with high event count",
    "mean_session_entropy": "Unusual session activity mix",
    "num_usb_sessions": "Multiple USB sessions",
    "num_exe_sessions": "Sessions with executable copies",
    "longest_inter_session_gap": "Unusual gap between sessions",
    "usb_after_hours_sessions": "After-hours USB session",
    "file_heavy_sessions": "Sessions with heavy file copying",
    "short_usb_sessions": "Short USB grab session",
    "http_request_count_zscore": "Web browsing deviation from user baseline",
    "http_request_count_rolling_mean": "Web browsing rolling average",
    "http_request_count_rolling_std": "Web browsing rolling variability",
    "emails_sent_zscore": "Email volume deviation from user baseline",
    "emails_sent_rolling_mean": "Email volume rolling average",
    "emails_sent_rolling_std": "Email volume rolling variability",
    "file_copy_count_zscore": "File copy deviation from user baseline",
    "file_copy_count_rolling_mean": "File copy rolling average",
    "file_copy_count_rolling_std": "File copy rolling variability",
    "total_actions_zscore": "Activity level deviation from user baseline",
    "total_actions_rolling_mean": "Activity level rolling average",
    "total_actions_rolling_std": "Activity level rolling variability",
    "sess_count_zscore": "Session count deviation from user baseline",
    "sess_count_rolling_mean": "Session count rolling average",
    "sess_count_rolling_std": "Session count rolling variability",
    "mean_session_duration_zscore": "Session duration deviation from user baseline",
    "mean_session_duration_rolling_mean": "Session duration rolling average",
    "mean_session_duration_rolling_std": "Session duration rolling variability",
    "total_session_time_zscore": "Total session time deviation from user baseline",
    "total_session_time_rolling_mean": "Total session time rolling average",
    "total_session_time_rolling_std": "Total session time rolling variability",
    "is_weekend": "Weekend activity",
    "role_changed": "Role change detected",
    "dept_changed": "Department change detected",
    "functional_unit_changed": "Functional unit change detected",
    "terminated_flag": "Termination flag",
}
# File endings that the drill-down treats as executable (case matters).
DRILLDOWN_EXECUTABLE = (".exe", ".msi", ".bat")
TOP_WINDOWS = 5
BIN_US = 6 * 3_600_000_000


def indicator_text(feature: str) -> str:
    """Text for a feature: its own, that of its base feature, or a generic one."""
    suffix = next((s for s in ("_zscore", "_rolling_mean", "_rolling_std") if feature.endswith(s)), "")
    base = feature.removesuffix(suffix)
    known = INDICATOR_TEXT.get(feature) or INDICATOR_TEXT.get(base)
    if known:
        return known
    note = {"": "", "_zscore": " (deviation from user baseline)"}.get(suffix, " (rolling statistic)")
    return f"Anomalous {base}{note}"


def severity(rate: Column, top: Column, threshold: Column, flagged: Column | None = None) -> Column:
    """HIGH, MEDIUM or LOW; with ``flagged`` given, NORMAL when nothing is flagged."""
    level = F.when((rate > 0.5) | (top > 2 * threshold), "HIGH").when(rate > 0.25, "MEDIUM")
    if flagged is None:
        return level.otherwise("LOW")
    return level.when(flagged > 0, "LOW").otherwise("NORMAL")


def user_risk(judged: DataFrame) -> DataFrame:
    """Risk summary per user from judged windows (one threshold)."""
    users = judged.groupBy("user_id").agg(
        F.count("*").alias("total_sequences"), F.sum("pred").alias("flagged_sequences"),
        F.max("score").alias("top"), F.avg("score").alias("mean"), F.max("threshold").alias("threshold"),
    )
    rate = ratio(F.col("flagged_sequences"), F.col("total_sequences"))
    return users.select(
        "user_id",
        severity(rate, F.col("top"), F.col("threshold"), F.col("flagged_sequences")).alias("severity"),
        F.round("top", 6).alias("anomaly_score_max"),
        F.round("mean", 6).alias("anomaly_score_mean"),
        "total_sequences", "flagged_sequences",
        F.round(rate, 4).alias("detection_rate"),
    )


def top_windows(scores: DataFrame, k: int = TOP_WINDOWS) -> DataFrame:
    """The k highest windows of every user; Spark keeps k per user before the shuffle."""
    best = W.partitionBy("user_id").orderBy(F.col("score").desc(), F.col("end_date").desc(), F.col("seq_no").desc())
    return (
        scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("user_id", "rank", "seq_no", "end_date", F.round("score", 6).alias("score"))
    )


def top_users(risk: DataFrame, k: int) -> DataFrame:
    """The k users with the highest score."""
    return risk.orderBy(F.col("anomaly_score_max").desc(), "user_id").limit(k)


def severity_counts(risk: DataFrame) -> DataFrame:
    return risk.where(F.col("severity") != "NORMAL").groupBy("severity").agg(F.count("*").alias("users"))


def risk_indicators(
    errors: DataFrame, judged: DataFrame, features: list[str], lookback: int, stride: int, top: int = 3
) -> DataFrame:
    """(user_id, indicators): texts of the features with the largest mean squared error over the flagged windows of a user.

    ``errors`` has one row per day with the squared error of every feature; a padded day counts as 0. A day counts once for
    each flagged window that covers it: the number of such windows is the number of them that begin in the days up to it.
    """
    flagged = judged.where(F.col("pred") == 1).select("user_id", (F.col("seq_no") * stride).alias("_first")).distinct()
    starts = flagged.groupBy("user_id").agg(F.collect_set("_first").alias("_starts"))  # bounded by a user's days
    order = W.partitionBy("user_id").orderBy("date")
    begins = F.array_contains("_starts", (F.row_number().over(order) - 1).cast("long"))
    days = errors.select("user_id", "date", *features).join(starts, "user_id").withColumn("_begins", begins.cast("int"))
    covered = days.withColumn("_cover", F.sum("_begins").over(order.rowsBetween(-(lookback - 1), 0)))
    size = F.max(F.size("_starts")) * F.lit(float(lookback))
    means = covered.groupBy("user_id").agg(*[(F.sum(F.col(f) * F.col("_cover")) / size).alias(f) for f in features])
    ordered = F.sort_array(
        F.array(*[F.struct(F.col(f).alias("e"), F.lit(i).alias("i"), F.lit(indicator_text(f)).alias("text")) for i, f in enumerate(features)]),
        asc=False,
    )
    return means.select("user_id", F.array_distinct(F.slice(ordered, 1, top)["text"]).alias("indicators"))


def flagged_dates(judged: DataFrame) -> DataFrame:
    """The dates of every user's flagged windows."""
    return judged.where((F.col("pred") == 1) & F.col("end_date").isNotNull()).select("user_id", F.col("end_date").alias("date")).distinct()


def session_events(targets: DataFrame, events: DataFrame) -> DataFrame:
    """All events of the user, on any machine, inside each session of ``targets``.

    Sessions and events meet in time bins, each event in one; an event log with a ``date`` column is also joined by date, so
    that only the folders of the dates in question are read.
    """
    keys = ["session_id", "user_id", "pc", "session_start"]
    spans = targets.select(*keys, micros(F.col("session_start")).alias("s"), micros(F.col("session_end")).alias("e"))
    bin_of = lambda us: F.floor(us / F.lit(BIN_US)).cast("long")
    marks = spans.where(F.col("e") >= F.col("s")).select("*", F.explode(F.sequence(bin_of(F.col("s")), bin_of(F.col("e")))).alias("bin"))
    detail = F.coalesce(
        "filename", "url", F.when(is_activity("Email"), F.concat(F.lit("to: "), F.coalesce("to_addr", F.lit("")))), "activity"
    )
    on, dated = ["user_id", "bin"], [c for c in ("date",) if c in events.columns]
    if dated:
        on += dated
        marks = marks.withColumn("date", F.date_from_unix_date((F.col("bin") * BIN_US / F.lit(86_400_000_000)).cast("int")))
    log = events.select(
        "user_id", micros(F.col("datetime")).alias("us"), "id", "datetime", F.col("activity").alias("type"), detail.alias("detail"), *dated
    ).withColumn("bin", bin_of(F.col("us")))
    return log.join(marks, on).where(F.col("us").between(F.col("s"), F.col("e"))).select(*keys, "us", "id", "datetime", "type", "detail")


def first_events(inside: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` events (None: all) of each session, numbered; Spark keeps so many per task before the shuffle."""
    keys = ["session_id", "user_id", "pc", "session_start"]
    numbered = inside.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy("us", "id")))
    return (numbered if limit is None else numbered.where(F.col("nth") <= limit)).select(*keys, "nth", "datetime", "type", "detail")


def session_drilldown(judged: DataFrame, sessions: DataFrame, events: DataFrame, cfg: Settings) -> DataFrame:
    """Sessions of the flagged dates with a risk level, indicators and a summary, from all events of the session.

    The list of events shows the first ``cfg.shown_events`` of a session of medium or high risk.
    """
    keys = ["session_id", "user_id", "pc", "session_start"]
    dates = flagged_dates(judged)
    targets = stored(
        sessions.join(dates, (sessions["user_id"] == dates["user_id"]) & (sessions["session_date"] == dates["date"]), "left_semi"), "targets"
    )
    inside = stored(session_events(targets, events), "session-events")
    shown = first_events(inside, cfg.shown_events).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("nth", F.col("datetime").alias("time"), "type", "detail"))).alias("events")
    )
    executable = F.col("detail").endswith(DRILLDOWN_EXECUTABLE[0]) | F.col("detail").endswith(DRILLDOWN_EXECUTABLE[1]) | F.col("detail").endswith(DRILLDOWN_EXECUTABLE[2])
    by_type = inside.groupBy(*keys, "type").agg(
        F.count("*").alias("n"), F.min(F.struct("us", "id")).alias("first"), F.max(executable).alias("exe")
    )
    mix = by_type.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("first", F.concat(F.col("n").cast("string"), F.lit(" "), F.col("type")).alias("text"))))["text"].alias("mix"),
        F.bool_or(F.col("type").isin("Connect", "Disconnect")).alias("usb"), F.bool_or("exe").alias("exe"),
        F.bool_or(F.col("type") == "File").alias("file"),
    )
    none = F.array().cast("array<struct<nth:int,time:timestamp_ntz,type:string,detail:string>>")
    no = F.lit(False)
    out = targets.join(shown, keys, "left").join(mix, keys, "left").select(
        *targets.columns, F.coalesce("events", none).alias("events"), "mix",
        F.coalesce("usb", no).alias("usb"), F.coalesce("exe", no).alias("exe"), F.coalesce("file", no).alias("file"),
    )
    usb, exe, file = F.col("usb"), F.col("exe"), F.col("file")
    late, brief = F.col("is_after_hours") == 1, F.col("duration_min") < 15
    risk = (
        F.when(exe, "high").when(usb, F.when(late, "high").otherwise("medium"))
        .when(late & brief, "high").when(late, "medium").otherwise("low")
    )
    notes = F.array_compact(
        F.array(
            F.when(late, F.concat(F.lit("After-hours session ("), F.col("hour_of_start").cast("string"), F.lit(":00)"))),
            F.when(brief, "Short session (<15 min)"),
            F.when(usb, "USB device activity"),
            F.when(exe, "Executable file copied"),
            F.when(file & brief, "File activity in short session"),
        )
    )
    head = F.concat(F.bround("duration_min", 0).cast("int").cast("string"), F.lit("-min session"))
    summary = F.when(F.size("mix") > 0, F.concat(head, F.lit(": "), F.array_join("mix", ", "))).otherwise(head)
    return out.select(
        "user_id", F.col("session_date").alias("date"), "session_id", "pc", "session_start", "session_end",
        F.round("duration_min", 1).alias("duration_min"), risk.alias("risk"), notes.alias("indicators"),
        summary.alias("summary"), "events",
    ).withColumn(
        "events", F.when(F.col("risk").isin("medium", "high"), F.col("events")).otherwise(none)
    )


def alerts(
    breakdown: DataFrame,
    judged: DataFrame,
    indicators: DataFrame | None = None,
    truth: DataFrame | None = None,
    drilldown: DataFrame | None = None,
) -> DataFrame:
    """One nested row per caught user of a breakdown or latency table, or of ``flagged_users`` where there are no labels.

    The detection summary has what the table knows. ``drilldown`` adds the flagged dates with the number of their sessions and the
    highest risk; the sessions themselves are the rows of ``alert_sessions``.
    ``alert_id`` numbers the user among all users of the table in name order.
    """
    limit = judged.agg(F.max("threshold").alias("_threshold"))
    placed = with_scalars(ranked(breakdown, "user_id", "_place"), limit).where(F.col("detected") > 0)
    best = top_windows(judged).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("score").alias("anomaly_score"), F.col("end_date").alias("timestamp")))).alias("top_anomalous_windows")
    )
    out = placed.join(best, "user_id", "left")
    extra: list[Column] = []
    if indicators is not None:
        out = out.join(indicators, "user_id", "left")
        extra.append(F.coalesce("indicators", F.array().cast("array<string>")).alias("risk_indicators"))
    if truth is not None:
        known = [c for c in ("scenario", "truth_start", "truth_end", "details") if c in out.columns]
        out = out.drop(*known).join(last_interval(truth), "user_id", "left")
        extra += [
            F.col("scenario"), F.col("details").alias("scenario_description"),
            F.struct(F.col("truth_start").alias("start"), F.col("truth_end").alias("end")).alias("ground_truth_window"),
        ]
    if drilldown is not None:
        level = F.max(F.when(F.col("risk") == "high", 3).when(F.col("risk") == "medium", 2).otherwise(1))
        per_date = drilldown.groupBy("user_id", "date").agg(F.count("*").alias("sessions"), level.alias("level"))
        risk = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("level")).alias("risk")
        # bounded by a user's flagged dates
        days = per_date.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("date", "sessions", risk))).alias("session_drilldown"))
        out = out.join(days, "user_id", "left")
        extra.append(F.col("session_drilldown"))
    number = F.lpad(F.col("_place").cast("string"), F.greatest(F.lit(3), F.length(F.col("_place").cast("string"))), F.lit("0"))
    return out.select(
        F.concat(F.lit("INSIDER-"), "user_id", F.lit("-"), number).alias("alert_id"),
        severity(F.col("detection_rate"), F.col("max_score"), F.col("_threshold")).alias("severity"),
        "user_id",
        F.struct(
            "total_sequences", F.col("detected").alias("flagged_sequences"), "detection_rate",
            F.col("max_score").alias("max_anomaly_score"), F.col("mean_score").alias("mean_anomaly_score"),
            *[
                F.col(c).alias(name)
                for c, name in (
                    ("insider_sequences", "insider_sequences"), ("latency_sequences", "latency_sequences"),
                    ("first_detection_date", "first_detection"), ("latency_hours", "latency_hours"), ("lead_time_hours", "lead_time_hours"),
                )
                if c in breakdown.columns
            ],
        ).alias("detection_summary"),
        "top_anomalous_windows",
        *extra,
    )


def alert_sessions(alerts: DataFrame, drilldown: DataFrame) -> DataFrame:
    """One row per session behind an alert, by (alert_id, date, session_start): the drill-down of the users that have one."""
    first = ("alert_id", "date", "session_start")
    rows = drilldown.join(alerts.select("alert_id", "user_id"), "user_id")
    return rows.select(*first, *[c for c in drilldown.columns if c not in first])


def flagged_users(judged: DataFrame) -> DataFrame:
    """All users of judged windows without labels, as a breakdown: ``detected`` counts flagged windows, the rate is their share."""
    return judged.groupBy("user_id").agg(
        F.count("*").alias("total_sequences"), F.sum("pred").cast("long").alias("detected"),
        F.max("score").alias("max_score"), F.avg("score").alias("mean_score"),
    ).withColumn("detection_rate", ratio(F.col("detected"), F.col("total_sequences")))


def alert_summary(alerts: DataFrame, breakdown: DataFrame, judged: DataFrame, method: str) -> DataFrame:
    """One row: what was evaluated, the number of alerts in all and by severity, and of users missed (``missed_users`` lists them)."""
    count = lambda level: F.count_if(F.col("severity") == level).alias(level.lower())
    totals = alerts.agg(F.count("*").alias("total_alerts"), count("HIGH"), count("MEDIUM"), count("LOW"))
    missed = missed_users(breakdown).agg(F.count("*").alias("users_missed"))
    return with_scalars(with_scalars(report_metadata(judged, method), totals), missed)


def missed_users(breakdown: DataFrame) -> DataFrame:
    return breakdown.where(F.col("detected") == 0).select("user_id")


def report_metadata(judged: DataFrame, method: str) -> DataFrame:
    """One row: what was evaluated under which threshold."""
    users = judged.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("pred").alias("f"), F.max("threshold").alias("t"))
    return users.agg(
        F.lit(method).alias("threshold_method"), F.round(F.max("t"), 6).alias("threshold_value"),
        F.count("*").alias("total_users"), F.count_if(F.col("f") > 0).alias("flagged_users"),
        F.sum("n").alias("total_sequences"), F.sum("f").alias("flagged_sequences"),
    )

