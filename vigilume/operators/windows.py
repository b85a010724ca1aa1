"""User splits and sliding windows of active days.

A window is addressed by (user_id, seq_no); everything about it is joined by that key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vigilume.config import Settings
from vigilume.functions.columns import with_scalars
from vigilume.functions.folded import is_folded
from vigilume.functions.ordering import ranked

WINDOW = ["user_id", "seq_no"]


def split_users(days: DataFrame, cfg: Settings) -> DataFrame:
    """(user_id, split): users with any positive day are tested, the others are cut by hash order."""
    users = days.groupBy("user_id").agg(F.max("is_insider").alias("positive"))
    normal = users.where(F.col("positive") == 0).select(
        "user_id", F.md5(F.concat_ws("|", F.lit(cfg.seed).cast("string"), "user_id")).alias("draw")
    )
    placed = ranked(normal, "draw", "place")
    sized = with_scalars(placed, normal.agg(F.count("*").alias("n")))
    n_train = F.floor(F.col("n") * F.lit(cfg.train_share))
    n_val = F.floor(F.col("n") * F.lit(cfg.val_share))
    split = F.when(F.col("place") <= n_train, "train").when(F.col("place") <= n_train + n_val, "val").otherwise("test")
    return sized.select("user_id", split.alias("split")).unionByName(
        users.where(F.col("positive") == 1).select("user_id", F.lit("test").alias("split"))
    )


def min_days_filter(days: DataFrame, min_days: int | None) -> DataFrame:
    """Drop users with fewer active days; no limit keeps everyone. Folded days count as often as they stand for."""
    if min_days is None:
        return days
    active = (F.sum("_copies") if is_folded(days) else F.count("*")).over(W.partitionBy("user_id"))
    return days.withColumn("_active", active).where(F.col("_active") >= min_days).drop("_active")


def window_days(days: DataFrame, lookback: int, stride: int) -> DataFrame:
    """Every (window, day) pair with its position 0..lookback-1.

    A user with fewer days than ``lookback`` has one window whose first positions stay empty; an
    incomplete tail gives no window. The user shuffle also serves later grouping by window.
    """
    user = W.partitionBy("user_id")
    numbered = days.select(
        "*",
        (F.row_number().over(user.orderBy("date")) - 1).alias("_rn"),
        F.count("*").over(user).cast("int").alias("_n"),
    )
    rn, n = F.col("_rn"), F.col("_n")
    short = n < lookback
    first = F.greatest(F.lit(0), F.ceil((rn - (lookback - 1)) / F.lit(float(stride))))
    last = F.least(F.floor(rn / F.lit(float(stride))), F.floor((n - lookback) / F.lit(float(stride))))
    covered = F.when(short, F.array(F.lit(0).cast("long"))).when(first <= last, F.sequence(first, last))
    return numbered.withColumn("seq_no", F.explode(covered)).select(
        *days.columns,
        "seq_no",
        F.when(short, rn + lookback - n).otherwise(rn - F.col("seq_no") * stride).cast("int").alias("pos"),
        F.when(short, lookback - n).otherwise(0).alias("padding"),
    )


def window_totals(days: DataFrame, lookback: int, stride: int, **totals: Column) -> DataFrame:
    """(user_id, seq_no, padding) and the given aggregates of every window, without pairing windows with days.

    Each aggregate runs over the last ``lookback`` days of a user, and the days on which a window ends are kept.
    """
    user = W.partitionBy("user_id")
    frame = user.orderBy("date").rowsBetween(-(lookback - 1), 0)
    ended = days.select(
        "user_id",
        (F.row_number().over(user.orderBy("date")) - lookback).alias("_past"),
        F.count("*").over(user).cast("int").alias("_n"),
        *[total.over(frame).alias(name) for name, total in totals.items()],
    )
    past, n = F.col("_past"), F.col("_n")
    short = n < lookback
    return ended.where(F.when(short, past == n - lookback).otherwise((past >= 0) & (past % stride == 0))).select(
        "user_id", F.when(short, 0).otherwise(past / stride).cast("long").alias("seq_no"),
        F.when(short, lookback - n).otherwise(0).alias("padding"), *totals,
    )


def window_labels(members: DataFrame) -> DataFrame:
    """Label (any positive day), first and last date, and padding of every window."""
    return members.groupBy(*WINDOW).agg(
        F.max("is_insider").alias("label"),
        F.min("date").alias("first_date"),
        F.max("date").alias("end_date"),
        F.max("padding").alias("padding"),
        F.count("*").alias("n_days"),
    )


def sliding_windows(
    days: DataFrame, vector: Sequence[str], codes: Sequence[str], lookback: int, stride: int
) -> DataFrame:
    """One row per window with its days as an array of (pos, date, x, cat), zero-padded on the left.

    The array is framed on a user's days, and the days on which a window ends are kept: no day is copied to windows and shuffled.
    """
    day = days.select(
        "user_id", "date", "is_insider",
        F.array(*[F.col(c).cast("double") for c in vector]).alias("x"),
        F.array(*[F.col(c).cast("int") for c in codes]).cast("array<int>").alias("cat"),
    )
    framed = window_totals(
        day, lookback, stride,
        label=F.max("is_insider"), end_date=F.max("date"), _framed=F.collect_list(F.struct("date", "x", "cat")),
    )
    placed = F.transform(
        "_framed",
        lambda e, i: F.struct((F.col("padding") + i).cast("int").alias("pos"), e["date"].alias("date"), e["x"].alias("x"), e["cat"].alias("cat")),
    )
    rows = framed.select(*WINDOW, "label", "end_date", "padding", placed.alias("days"))
    empty = F.struct(
        F.lit(0).alias("pos"),
        F.lit(None).cast("date").alias("date"),
        F.array_repeat(F.lit(0.0), len(vector)).alias("x"),
        F.array_repeat(F.lit(0), len(codes)).alias("cat"),
    )
    blank = F.transform(
        F.array_repeat(empty, F.col("padding")),
        lambda e, i: F.struct(i.alias("pos"), e["date"].alias("date"), e["x"].alias("x"), e["cat"].alias("cat")),
    )
    return rows.select(*WINDOW, "label", "end_date", "padding", F.concat(blank, F.col("days")).alias("days"))


def check_clean_splits(windows: DataFrame, splits: DataFrame) -> None:
    """Raise when a training or validation window is positive."""
    leaks = (
        windows.join(splits, "user_id").where(F.col("split").isin("train", "val"))
        .agg(F.count_if(F.col("label") == 1).alias("n")).first()["n"]
    )
    if leaks:
        raise ValueError(f"{leaks} positive windows in the training or validation split")
