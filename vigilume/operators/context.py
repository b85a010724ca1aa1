"""User context from monthly directory snapshots, trait scores and truth intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from vigilume.functions.columns import month_of, with_scalars
from vigilume.functions.folded import FLAGS, SCORES, map_traits, unfold
from vigilume.schema import TRAITS

PROFILE = ("role", "department", "functional_unit")
CHANGE_FLAGS = {"role": "role_changed", "department": "dept_changed", "functional_unit": "fu_changed"}


def latest_profile(snapshots: DataFrame) -> DataFrame:
    """The last known profile of every user."""
    carried = [c for c in snapshots.columns if c not in ("user_id", "ldap_month")]
    last = F.max_by(F.struct(*carried), F.struct("ldap_month", *carried))
    return snapshots.groupBy("user_id").agg(last.alias("p")).select("user_id", "p.*")


def attribute_changes(snapshots: DataFrame) -> DataFrame:
    """Change flags against the user's previous snapshot (rows per user: one per month)."""
    history = W.partitionBy("user_id").orderBy("ldap_month")
    with_previous = snapshots.select(
        "user_id", "ldap_month", *CHANGE_FLAGS,
        *[F.lag(c).over(history).alias(f"was_{c}") for c in CHANGE_FLAGS],
    )
    return with_previous.where(F.col("was_role").isNotNull()).select(
        "user_id", "ldap_month",
        *[F.when(F.col(c) != F.col(f"was_{c}"), 1).otherwise(0).alias(flag) for c, flag in CHANGE_FLAGS.items()],
    )


def terminations(snapshots: DataFrame) -> DataFrame:
    """First month in which a user of the preceding snapshot is absent."""
    present = snapshots.select("user_id", "ldap_month").distinct()
    # the calendar: one short array of months
    calendar = present.agg(F.array_sort(F.collect_set("ldap_month")).alias("_months"))
    after = F.get("_months", F.array_position("_months", F.col("ldap_month")).cast("int"))
    expected = (
        with_scalars(present, calendar).select("user_id", after.alias("ldap_month")).where(F.col("ldap_month").isNotNull())
    )
    gone = expected.join(present, ["user_id", "ldap_month"], "left_anti")
    return gone.groupBy("user_id").agg(F.min("ldap_month").alias("termination_month"))


def trait_medians(traits: DataFrame) -> DataFrame:
    """One row: the median of every trait (integer scores, so few distinct values)."""
    return traits.agg(*[F.percentile(t, 0.5).alias(f"median_{t}") for t in TRAITS.values()])


def impute_traits(df: DataFrame, traits: DataFrame) -> DataFrame:
    """Join trait scores by user; missing ones become the population median."""
    joined = df.join(traits, "user_id", "left")
    filled = with_scalars(joined, trait_medians(traits))
    return filled.select(
        *df.columns,
        *[F.coalesce(F.col(t).cast("double"), F.col(f"median_{t}")).alias(t) for t in TRAITS.values()],
    )


def flag_truth_days(days: DataFrame, truth: DataFrame) -> DataFrame:
    """Add ``is_insider``: the day, taken as midnight, lies in a truth interval of its user.

    Intervals become the set of days they cover, so that this is an equality join on the key the days
    are already partitioned by, and two intervals never duplicate a day.
    """
    first = F.date_add(F.to_date("start_date"), F.when(F.to_date("start_date").cast("timestamp_ntz") < F.col("start_date"), 1).otherwise(0))
    last = F.to_date("end_date")
    covered = (
        truth.select("user_id", first.alias("_first"), last.alias("_last")).where(F.col("_first") <= F.col("_last"))
        .select("user_id", F.explode(F.sequence("_first", "_last")).alias("date")).distinct()
        .withColumn("_hit", F.lit(1))
    )
    return days.join(covered, ["user_id", "date"], "left").select(*days.columns, F.coalesce("_hit", F.lit(0)).alias("is_insider"))


def fold_changes(days: DataFrame, changes: DataFrame) -> DataFrame:
    """Add ``_changes``: the change flags of the day's month, one row of zeros where there are none.

    Rows of one key come last first, as a broadcast join yields them; windows by date meet them in this order.
    """
    flags = [F.col(c).alias(name) for c, name in zip(CHANGE_FLAGS.values(), FLAGS, strict=True)]
    months = changes.groupBy(F.col("user_id").alias("_user"), F.col("ldap_month").alias("_month")).agg(F.reverse(F.collect_list(F.struct(*flags))).alias("_flags"))
    on = (F.col("user_id") == F.col("_user")) & (month_of(F.col("date")) == F.col("_month"))
    none = F.array(F.struct(*[F.lit(0).alias(f) for f in FLAGS]))
    return days.join(months, on, "left").select(*days.columns, F.coalesce("_flags", none).alias("_changes"))


def fold_traits(days: DataFrame, traits: DataFrame) -> DataFrame:
    """Add ``_traits``: the user's trait rows; missing scores become the population median."""
    known = traits.groupBy("user_id").agg(F.reverse(F.collect_list(F.struct(*[F.col(t).cast("double").alias(t) for t in SCORES]))).alias("_known"))
    none = F.array(F.struct(*[F.lit(None).cast("double").alias(t) for t in SCORES]))
    joined = days.join(known, "user_id", "left").select(*days.columns, F.coalesce("_known", none).alias("_traits"))
    filled = with_scalars(joined, trait_medians(traits))
    return filled.select(*days.columns, map_traits(lambda t, x: F.coalesce(x, F.col(f"median_{t}"))))


def add_terminated(days: DataFrame, ended: DataFrame) -> DataFrame:
    """``terminated_flag``: the day's month is the termination month or later."""
    return days.join(ended, "user_id", "left").select(
        *days.columns,
        F.when(month_of(F.col("date")) >= F.col("termination_month"), 1).otherwise(0).alias("terminated_flag"),
    )


def enrich_folded(days: DataFrame, snapshots: DataFrame, traits: DataFrame, truth: DataFrame | None) -> DataFrame:
    """Days with profile, traits, change flags, termination and (when known) the truth flag; traits and change flags are folded.

    The days have one row per user and active day, and so has the result. Joins by (user, day) come first, on the partitioning
    of the days, and joins by user last, so that the per-user windows that follow need no shuffle of
    their own. Spark picks broadcast or shuffle from the measured size of the context tables.
    """
    out = days.withColumn("is_insider", F.lit(0)) if truth is None else flag_truth_days(days, truth)
    out = fold_changes(out, attribute_changes(snapshots))
    out = out.join(latest_profile(snapshots).select("user_id", *PROFILE), "user_id", "left")
    out = add_terminated(fold_traits(out, traits), terminations(snapshots))
    copies = F.size("_changes").cast("long") * F.size("_traits")
    return out.select("*", F.lit(0).cast("long").alias("_first"), copies.alias("_copies"), F.lit(0).cast("long").alias("_place"))


def enrich(days: DataFrame, snapshots: DataFrame, traits: DataFrame, truth: DataFrame | None) -> DataFrame:
    """:func:`enrich_folded` with a row for each change row and trait row of a day."""
    rows = unfold(enrich_folded(days, snapshots, traits, truth))
    return rows.select(*days.columns, "is_insider", *FLAGS, *PROFILE, *SCORES, "terminated_flag")
