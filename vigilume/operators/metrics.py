"""Thresholds and detection metrics from scored windows.

Scored windows are (user_id, seq_no, copy, end_date, label, score); a window is flagged when its score
reaches the threshold. Everything that depends on the order of scores is read off the *ladder*: one row
per distinct score with running counts, built without a global sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vigilume.config import LABEL_AWARE_METHODS, THRESHOLD_METHODS
from vigilume.functions.columns import one, ratio, with_scalars
from vigilume.functions.ordering import running_totals

TINY = 1e-10


def window_order() -> Column:
    """The order of a user's windows."""
    return F.struct("copy", "end_date", "seq_no")


def ladder(scores: DataFrame) -> DataFrame:
    """Per distinct score: n, pos, neg, their running counts from the lowest score up (``*_le``),
    the pos and neg of the next lower score, and the class totals."""
    label = F.col("label")
    steps = scores.groupBy("score").agg(
        F.count("*").alias("n"),
        F.count_if(label == 1).alias("pos"),
        F.count_if(label == 0).alias("neg"),
    )
    climbing = running_totals(
        steps, "score",
        {"n_le": F.col("n"), "pos_le": F.col("pos"), "neg_le": F.col("neg")},
        previous=["pos", "neg"],
    )
    totals = scores.agg(F.count_if(label == 1).alias("all_pos"), F.count_if(label == 0).alias("all_neg"))
    return with_scalars(climbing, totals)


def percentiles(steps: DataFrame, probs: Mapping[str, float], count: str = "n") -> DataFrame:
    """One row of exact percentiles (linear interpolation) of the scores counted in ``count``."""
    up_to = f"{count}_le"
    sized = with_scalars(steps, steps.agg(F.max(up_to).alias("_size")))
    below = F.col(up_to) - F.col(count)

    def at(index: Column) -> Column:
        """Score with the given 0-based place."""
        return F.max(F.when((below <= index) & (index < F.col(up_to)), F.col("score")))

    parts = {}
    for name, p in probs.items():
        place = (F.col("_size") - 1) * F.lit(p)
        parts[f"_lo_{name}"] = at(F.floor(place))
        parts[f"_hi_{name}"] = at(F.ceil(place))
        parts[f"_w_{name}"] = F.max(place - F.floor(place))
    row = sized.agg(*[e.alias(n) for n, e in parts.items()])
    return row.select(
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in probs
        ]
    )


def _at_least(column: str, total: Column) -> Column:
    """Count of the class at or above the score of a ladder row."""
    return total - F.col(f"{column}_le") + F.col(column)


def pr_curve(steps: DataFrame) -> DataFrame:
    """Precision and recall at every distinct score."""
    tp = _at_least("pos", F.col("all_pos"))
    flagged = tp + _at_least("neg", F.col("all_neg"))
    return steps.select(
        F.col("score").alias("threshold"), ratio(tp, flagged).alias("precision"), ratio(tp, F.col("all_pos")).alias("recall")
    )


def roc_curve(steps: DataFrame) -> DataFrame:
    """False and true positive rate at every distinct score."""
    return steps.select(
        F.col("score").alias("threshold"),
        ratio(_at_least("neg", F.col("all_neg")), F.col("all_neg")).alias("fpr"),
        ratio(_at_least("pos", F.col("all_pos")), F.col("all_pos")).alias("tpr"),
    )


def ranking_metrics(steps: DataFrame) -> DataFrame:
    """One row: average precision and AUROC (ties count half); 0 and 0.5 when a class is absent."""
    tp = _at_least("pos", F.col("all_pos"))
    flagged = tp + _at_least("neg", F.col("all_neg"))
    pos, neg = F.max("all_pos").cast("double"), F.max("all_neg").cast("double")
    gain = F.sum(F.col("pos") * ratio(tp, flagged))
    won = F.sum(F.col("pos") * (F.col("neg_le") - F.col("neg") * F.lit(0.5)))
    both = (pos > 0) & (neg > 0)
    return steps.agg(
        F.when(both, gain / pos).otherwise(0.0).alias("auprc"),
        F.when(both, won / (pos * neg)).otherwise(0.5).alias("auroc"),
    )


def best_f1(steps: DataFrame) -> DataFrame:
    """One row: the score with the highest F1, the lowest such score on ties."""
    p, r = F.col("precision"), F.col("recall")
    f1 = 2 * p * r / (p + r + F.lit(TINY))
    return pr_curve(steps).agg(F.max_by("threshold", F.struct(f1, -F.col("threshold"))).alias("threshold"))


def fixed_recall(steps: DataFrame, target: float) -> DataFrame:
    """One row: the score whose recall is nearest to ``target``, the highest such score on ties.

    A point of the ROC curve on a straight stretch, i.e. whose next lower score adds the same counts,
    is not a candidate; the ends are.
    """
    ends = steps.agg(F.min("score").alias("_low"), F.max("score").alias("_high"))
    straight = (F.col("pos") == F.col("prev_pos")) & (F.col("neg") == F.col("prev_neg"))
    end = (F.col("score") == F.col("_low")) | (F.col("score") == F.col("_high"))
    corners = with_scalars(steps, ends).where(end | ~straight)
    off = F.abs(F.col("tpr") - F.lit(target))
    return roc_curve(corners).agg(F.min_by("threshold", F.struct(off, -F.col("threshold"))).alias("threshold"))


def calibration_thresholds(cal_scores: DataFrame) -> DataFrame:
    """One row: the thresholds that need no labels."""
    steps = cal_scores.groupBy("score").agg(F.count("*").alias("n"))
    steps = running_totals(steps, "score", {"n_le": F.col("n")})
    spread = cal_scores.agg((F.avg("score") + 3 * F.stddev_pop("score")).alias("mean_plus_3std"))
    return with_scalars(percentiles(steps, {"percentile_99": 0.99, "percentile_95": 0.95}), spread)


#: Size of the quantile sketches: a percentile's rank is off by 0.5 % of the scores or less, in 99 of 100 cases.
SKETCH_SIZE = 1024


def score_sketches(scores: DataFrame, size: int = SKETCH_SIZE) -> DataFrame:
    """(date, n, sketch): a mergeable quantile sketch of the scores of the windows that end on each date."""
    return scores.groupBy(F.col("end_date").alias("date")).agg(
        F.count("score").alias("n"), F.kll_sketch_agg_double(F.col("score").cast("double"), F.lit(size)).alias("sketch")
    ).where(F.col("n") > 0)


def sketched_percentiles(sketches: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """(method, threshold) by merging sketches of any dates: the scores themselves aren't read again.

    :func:`percentiles` is exact and stays the default; this is for calibration over very many scores, or when a date is added.
    """
    # without a sketch there is no percentile: an empty sketch has none
    merged = sketches.agg(F.kll_merge_agg_double("sketch").alias("_all"), F.count("*").alias("_n"))
    cells = [F.struct(F.lit(n).alias("method"), F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double("_all", F.lit(p))).alias("threshold")) for n, p in probs.items()]
    return merged.select(F.inline(F.array(*cells))).where(F.col("threshold").isNotNull())


def thresholds(test_steps: DataFrame | None, cal_scores: DataFrame, methods: Sequence[str] = THRESHOLD_METHODS) -> DataFrame:
    """(method, threshold, is_oracle), one row per method; label-aware methods need the test ladder."""
    unknown = set(methods) - set(THRESHOLD_METHODS)
    if unknown:
        raise ValueError(f"unknown threshold methods {sorted(unknown)}")
    free = [m for m in methods if m not in LABEL_AWARE_METHODS]
    parts = []
    if free:
        row = calibration_thresholds(cal_scores)
        pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("threshold")) for m in free])
        parts.append(row.select(F.inline(pairs)).withColumn("is_oracle", F.lit(False)))
    for m in methods:
        if m not in LABEL_AWARE_METHODS:
            continue
        if test_steps is None:
            raise ValueError(f"{m} needs labelled test scores")
        row = best_f1(test_steps) if m == "best_f1" else fixed_recall(test_steps, int(m[-2:]) / 100)
        parts.append(row.select(F.lit(m).alias("method"), "threshold", F.lit(True).alias("is_oracle")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lookup_threshold(known: DataFrame, method: str, cal_scores: DataFrame) -> DataFrame:
    """One row (method, threshold): the requested method, else the first known fallback, else from
    the calibration scores."""
    order = [method, "best_f1", "percentile_99", "mean_plus_3std", "percentile_95"]
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method"))
    usable = known.select("method", "threshold", place.alias("place")).where(F.col("place") > 0)
    spare = "mean_plus_3std" if method == "mean_plus_3std" else "percentile_99"
    computed = calibration_thresholds(cal_scores).select(
        F.concat(F.lit("calibration "), F.lit(spare)).alias("method"), F.col(spare).alias("threshold"), F.lit(len(order) + 1).alias("place")
    )
    first = usable.unionByName(computed).agg(F.min_by(F.struct("method", "threshold"), "place").alias("t"))
    return first.select("t.*")


def judge(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """Every window with its verdict ``pred`` under every method (a handful of rows in ``limits``)."""
    packed = limits.agg(F.collect_list(F.struct(*limits.columns)).alias("_limits"))
    return (
        with_scalars(scores, packed).select(*scores.columns, F.inline("_limits"))
        .withColumn("pred", one(F.col("score") >= F.col("threshold")))
    )


def confusion(judged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates per group of ``by``; a rate without a denominator is 0."""
    y, p = F.col("label") == 1, F.col("pred") == 1
    cells = judged.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"),
        F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"),
    )
    return confusion_rates(cells, by)


def confusion_rates(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rates of counted cells."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return cells.select(
        *by, "tp", "tn", "fp", "fn",
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(fp, fp + tn).alias("fpr"),
        ratio(fn, fn + tp).alias("fnr"),
        ratio(tn, tn + fp).alias("specificity"),
    )


def threshold_metrics(steps: DataFrame, limits: DataFrame) -> DataFrame:
    """Counts and rates under each of a handful of thresholds, from the ladder of distinct scores in one aggregate.

    What lies below a threshold is the running count of the highest score under it; without a threshold nothing is flagged.
    """
    rows = limits.select("method", "threshold", "is_oracle").collect()  # one for each method
    total = lambda kind: F.coalesce(F.max(f"all_{kind}"), F.lit(0)).cast("long")
    below = lambda kind, t: total(kind) if t is None else F.coalesce(F.max(F.when(F.col("score") < F.lit(t), F.col(f"{kind}_le"))), F.lit(0)).cast("long")
    cells = [
        F.struct(
            F.lit(r["method"]).alias("method"), F.lit(r["threshold"]).cast("double").alias("threshold"), F.lit(r["is_oracle"]).alias("is_oracle"),
            (total("pos") - below("pos", r["threshold"])).alias("tp"), below("neg", r["threshold"]).alias("tn"),
            (total("neg") - below("neg", r["threshold"])).alias("fp"), below("pos", r["threshold"]).alias("fn"),
        )
        for r in rows
    ]
    counted = steps.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    return confusion_rates(counted, ["method", "threshold", "is_oracle"])


def score_separation(scores: DataFrame, steps: DataFrame) -> DataFrame:
    """One row: how far apart the scores of the two classes lie."""
    def of(label: int) -> Column:
        return F.when(F.col("label") == label, F.col("score"))

    moments = scores.agg(
        F.avg(of(0)).alias("normal_mean"), F.stddev_pop(of(0)).alias("normal_std"),
        F.avg(of(1)).alias("insider_mean"), F.stddev_pop(of(1)).alias("insider_std"),
    )
    normal = percentiles(steps, {"normal_median": 0.5, "normal_p95": 0.95}, "neg")
    insider = percentiles(steps, {"insider_median": 0.5}, "pos")
    row = with_scalars(with_scalars(moments, normal), insider)
    share = with_scalars(steps, normal.select("normal_p95")).agg(
        ratio(F.sum(F.when(F.col("score") < F.col("normal_p95"), F.col("pos")).otherwise(0)), F.max("all_pos"))
        .alias("overlap_below_normal_p95")
    )
    floor = F.lit(TINY)
    return with_scalars(row, share).select(
        "*",
        (F.col("insider_mean") / F.greatest("normal_mean", floor)).alias("mean_ratio"),
        (F.col("insider_median") / F.greatest("normal_median", floor)).alias("median_ratio"),
    )


def user_level_metrics(judged: DataFrame) -> DataFrame:
    """Confusion of users: positive, or flagged, when any of their windows is."""
    users = judged.groupBy("user_id").agg(F.max("label").alias("label"), F.max("pred").alias("pred"))
    totals = users.agg(
        F.count("*").alias("total_users"), F.count_if(F.col("label") == 1).alias("insider_users"),
        F.count_if(F.col("label") == 0).alias("normal_users"),
    )
    return with_scalars(confusion(users), totals)


def per_user_breakdown(judged: DataFrame) -> DataFrame:
    """Detection per positive user. Windows are ordered by (copy, end_date, seq_no); the latency is
    the number of windows from the first positive to the first detected one, -1 when none is.

    The two windows are found by a plain aggregate and the windows between them are then counted, so
    no user's windows are gathered or sorted in one place.
    """
    positive = F.col("label") == 1
    hit = positive & (F.col("pred") == 1)
    order = window_order()
    users = judged.groupBy("user_id").agg(
        F.count("*").alias("total_sequences"),
        F.count_if(positive).alias("insider_sequences"),
        F.count_if(hit).alias("detected"),
        F.max("score").alias("max_score"),
        F.avg("score").alias("mean_score"),
        F.min(F.when(positive, order)).alias("first_positive"),
        F.min(F.when(hit, order)).alias("first_detected"),
    ).where(F.col("insider_sequences") > 0)
    waited = (
        judged.join(users.select("user_id", "first_positive", "first_detected").where(F.col("first_detected").isNotNull()), "user_id")
        .groupBy("user_id")
        .agg(F.count_if((order >= F.col("first_positive")) & (order < F.col("first_detected"))).alias("waited"))
    )
    return users.join(waited, "user_id", "left").select(
        "user_id", "total_sequences", "insider_sequences", "detected",
        ratio(F.col("detected"), F.col("insider_sequences")).alias("detection_rate"),
        "max_score", "mean_score",
        F.coalesce("waited", F.lit(-1)).alias("latency_sequences"),
        F.col("first_positive.end_date").alias("first_insider_date"),
        F.col("first_detected.end_date").alias("first_detection_date"),
    )


def last_interval(truth: DataFrame) -> DataFrame:
    """One truth interval per user, the latest where there are several; unknown scenario is 0."""
    last = F.max_by(F.struct("scenario", "start_date", "end_date", "details"), F.struct("start_date", "end_date"))
    return truth.groupBy("user_id").agg(last.alias("t")).select(
        "user_id",
        F.coalesce("t.scenario", F.lit(0)).alias("scenario"),
        F.col("t.start_date").alias("truth_start"),
        F.col("t.end_date").alias("truth_end"),
        F.coalesce("t.details", F.lit("")).alias("details"),
    )


def detection_latency(breakdown: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Latency in whole hours and in days (-1 when missed), and lead time to the end of the truth
    interval in hours."""
    hours = F.date_diff("first_detection_date", "first_insider_date") * F.lit(24.0)
    out = breakdown.select(
        "*",
        F.coalesce(hours, F.lit(-1.0)).alias("latency_hours"),
        F.coalesce(F.round(hours / 24.0, 2), F.lit(-1.0)).alias("latency_days"),
    )
    if truth is None:
        return out
    lead = F.timestamp_diff("MICROSECOND", F.col("first_detection_date").cast("timestamp_ntz"), F.col("truth_end"))
    return out.join(last_interval(truth), "user_id", "left").withColumn(
        "lead_time_hours", F.round(lead / F.lit(3600e6), 1)
    )


def latency_summary(latencies: DataFrame) -> DataFrame:
    """One row over the users of a latency table (one row per positive user, whole-number latencies)."""
    caught = F.col("detected") > 0
    steps = F.when(caught, F.col("latency_sequences"))
    hours = F.when(caught & (F.col("latency_hours") >= 0), F.col("latency_hours"))
    return latencies.agg(
        F.count_if(caught).alias("caught_users"),
        F.count_if(~caught).alias("missed_users"),
        F.count("*").alias("total_insider_users"),
        F.avg(steps).alias("mean_latency_sequences"),
        F.percentile(steps, 0.5).alias("median_latency_sequences"),
        F.round(F.avg(hours), 1).alias("mean_latency_hours"),
        F.round(F.percentile(hours, 0.5), 1).alias("median_latency_hours"),
        F.round(F.min(hours), 1).alias("min_latency_hours"),
        F.round(F.max(hours), 1).alias("max_latency_hours"),
    )


def per_scenario(judged: DataFrame, truth: DataFrame) -> DataFrame:
    """Window and user recall of positive users by scenario, 0 for users without one."""
    positive = F.col("label") == 1
    users = judged.groupBy("user_id").agg(
        F.count_if(positive).alias("pos"), F.count_if(positive & (F.col("pred") == 1)).alias("hit")
    ).where(F.col("pos") > 0)
    tagged = users.join(last_interval(truth).select("user_id", "scenario"), "user_id", "left").na.fill(0, ["scenario"])
    sums = tagged.groupBy("scenario").agg(
        F.sum("pos").alias("insider_sequences"), F.sum("hit").alias("detected_sequences"),
        F.count("*").alias("insider_users"), F.count_if(F.col("hit") > 0).alias("users_detected"),
    )
    return sums.select(
        "*",
        ratio(F.col("detected_sequences"), F.col("insider_sequences")).alias("sequence_recall"),
        ratio(F.col("users_detected"), F.col("insider_users")).alias("user_recall"),
    )


def exclude_scenarios(scores: DataFrame, truth: DataFrame, scenarios: Sequence[int]) -> DataFrame:
    """Scores without the users of the given scenarios."""
    out = last_interval(truth).where(F.col("scenario").isin(list(scenarios))).select("user_id")
    return scores.join(out, "user_id", "left_anti")


def session_metrics(judged: DataFrame, sessions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of session-level metrics for labelled users.

    Windows and sessions are counted per (user, day) first and meet as counts, so no window is paired
    with a session; a day counts as often as windows end on it.
    """
    windows = judged.where(F.col("end_date").isNotNull()).groupBy("user_id", F.col("end_date").alias("day")).agg(
        F.count("*").alias("w"), F.sum("pred").alias("flagged")
    )
    per_day = sessions.groupBy("user_id", F.col("session_date").alias("day")).agg(
        F.count("*").alias("s"), F.max("is_after_hours").alias("late")
    )
    midnight = F.col("day").cast("timestamp_ntz")
    days = (
        windows.join(last_interval(truth), "user_id").join(per_day, ["user_id", "day"], "left").na.fill(0, ["s", "late"])
        .withColumn("true_day", one((midnight >= F.col("truth_start")) & (midnight <= F.col("truth_end"))))
    )
    c = F.col
    sums = days.agg(
        *[
            F.coalesce(F.sum(e), F.lit(0)).alias(n)
            for n, e in {
                "total_insider_sessions": c("true_day") * c("w") * c("s"),
                "flagged_insider_sessions": c("true_day") * c("flagged") * c("s"),
                "total_flagged_sessions": c("flagged") * c("s"),
                "total_flagged_days": c("flagged"),
                "correct_localizations": c("true_day") * c("flagged") * c("late"),
            }.items()
        ]
    )
    precision = c("flagged_insider_sessions") / F.greatest("total_flagged_sessions", F.lit(1))
    recall = c("flagged_insider_sessions") / F.greatest("total_insider_sessions", F.lit(1))
    return sums.select(
        "*",
        F.round(precision, 4).alias("session_precision"),
        F.round(recall, 4).alias("session_recall"),
        F.round(2 * precision * recall / F.greatest(precision + recall, F.lit(TINY)), 4).alias("session_f1"),
        F.round(c("correct_localizations") / F.greatest("total_flagged_days", F.lit(1)), 4).alias("session_localization_accuracy"),
    )
