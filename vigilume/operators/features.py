"""Day features: logs, interactions, per-user relations, calendar, codes and scaling.

All windows here run over one user's active days (one row per day), so a group is bounded by the
calendar however many events a user has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vigilume.config import CONTINUOUS, SESSION, UNLOGGED, Settings
from vigilume.functions.columns import one, require, with_scalars
from vigilume.functions.folded import FLAGS, FOLD, SCORES, is_folded, map_traits, set_apart, trait_copies
from vigilume.functions.ordering import ranked

LOGGED = [c for c in (*CONTINUOUS, *SESSION) if c not in UNLOGGED]
SMALLEST_STD = 1e-8


def interaction_columns() -> dict[str, Column]:
    """log1p of products of raw counts."""
    c = F.col
    late = one(c("after_hours_actions") > 0)
    return {
        "file_usb_interaction": F.log1p(c("file_copy_count") * one(c("usb_connect_count") > c("usb_disconnect_count"))),
        "external_email_attachments": F.log1p(c("external_email_count") * c("total_attachments")),
        "http_after_hours": F.log1p(c("http_request_count") * late),
        "email_after_hours": F.log1p(c("emails_sent") * late),
    }


def log_features(days: DataFrame) -> DataFrame:
    """Interactions from raw counts, and log1p of the counts and durations, in one projection."""
    logged = {c: F.log1p(c).alias(c) for c in LOGGED}
    return days.select(
        *[logged.get(c, F.col(c)) for c in days.columns],
        *[e.alias(n) for n, e in interaction_columns().items()],
    )


def user_relative(days: DataFrame, cfg: Settings) -> DataFrame:
    """Per-user z-score over the whole history, and rolling mean and deviation over active days.

    Folded days count as often as they stand for; see :func:`_relative_of_folded`.
    """
    if is_folded(days):
        return _relative_of_folded(days, cfg)
    whole = W.partitionBy("user_id")
    recent = whole.orderBy("date").rowsBetween(-(cfg.rolling_window - 1), 0)
    added = []
    for c in cfg.normalized:
        x = F.col(c)
        spread = F.greatest(F.stddev_pop(x).over(whole), F.lit(SMALLEST_STD))
        added += [
            ((x - F.avg(x).over(whole)) / spread).alias(f"{c}_zscore"),
            F.avg(x).over(recent).alias(f"{c}_rolling_mean"),
            F.coalesce(F.stddev_pop(x).over(recent), F.lit(0.0)).alias(f"{c}_rolling_std"),
        ]
    return days.select("*", *added)


def _relative_of_folded(days: DataFrame, cfg: Settings) -> DataFrame:
    """:func:`user_relative` of the rows behind folded days, which follow each other in the order of their pairs.

    The rolling values of a row reach back over ``rolling_window`` rows. From so many rows of one day on they see that day only and
    are all the same, so those rows stay folded, and each one before them becomes a row of its own.
    """
    reach, whole, copies = cfg.rolling_window, W.partitionBy("user_id"), F.col("_copies")
    known = {c: F.sum(F.when(F.col(c).isNotNull(), copies)).over(whole) for c in cfg.normalized}
    means = days.select("*", *[(F.sum(F.col(c) * copies).over(whole) / n).alias(f"_mean_{c}") for c, n in known.items()])
    squares = {c: F.sum((F.col(c) - F.col(f"_mean_{c}")) * (F.col(c) - F.col(f"_mean_{c}")) * copies).over(whole) for c in known}
    spreads = means.select("*", *[F.greatest(F.sqrt(squares[c] / n), F.lit(SMALLEST_STD)).alias(f"_spread_{c}") for c, n in known.items()])
    related = spreads.select(*days.columns, *[((F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_spread_{c}")).alias(f"{c}_zscore") for c in known])
    apart = set_apart(related, reach - 1)
    recent = whole.orderBy("date", "_place").rowsBetween(-(reach - 1), 0)
    return apart.select(
        "*", *[F.avg(c).over(recent).alias(f"{c}_rolling_mean") for c in known],
        *[F.coalesce(F.stddev_pop(c).over(recent), F.lit(0.0)).alias(f"{c}_rolling_std") for c in known],
    )


def calendar(days: DataFrame) -> DataFrame:
    angle = F.lit(2.0) * F.pi() * F.col("dow") / F.lit(7.0)
    return days.select(
        "*",
        F.sin(angle).alias("day_of_week_sin"),
        F.cos(angle).alias("day_of_week_cos"),
        one(F.col("dow") >= 5).alias("is_weekend"),
    )


def featured(enriched: DataFrame, cfg: Settings) -> DataFrame:
    """All unscaled features of a day, with keys, category values and the truth flag; of folded days folded."""
    out = calendar(user_relative(log_features(enriched), cfg))
    folded = is_folded(out)
    keys = ["user_id", "date", "is_insider", *[c for c in cfg.categorical if c != "user_id"]]
    vector = [c for c in cfg.vector if not (folded and c in (*FLAGS, *SCORES))]
    require(out, [*keys, *vector], "featured")
    return out.select(*keys, *vector, *(FOLD if folded else ()))


def fit_dictionary(days: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, code): dense codes from 0 in value order, NULL last.

    Distinct values are ranked range by range, since user and machine names may be many.
    """
    text = days.select(*[F.col(c).cast("string").alias(c) for c in columns])
    distinct = text.unpivot([], list(columns), "feature", "value").distinct()
    return ranked(distinct, "value", "place", by=["feature"]).select(
        "feature", "value", (F.col("place") - 1).cast("int").alias("code")
    )


def dictionary_sizes(dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of codes per feature; a feature without a dictionary is an error."""
    sizes = dictionary.groupBy("feature").agg(F.count("*").alias("size"))
    absent = set(columns) - {r["feature"] for r in sizes.select("feature").collect()}
    if absent:
        raise ValueError(f"no dictionary for {sorted(absent)}")
    return sizes


def frequent_values(days: DataFrame, columns: Sequence[str], most: int = 64, tracked: int = 4096) -> dict[str, list[str | None]]:
    """Of each column the values that hold most days, by a frequent-items sketch: ``most`` at the most.

    The sketch (a merged Misra-Gries summary of ``tracked`` counters) is an aggregate, so it takes one pass and a bounded row
    for each task; it names every value that holds more than one day in ``tracked`` (times 4/3).
    """
    tagged = days.select(*[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")).alias(c) for c in columns])
    found = tagged.agg(*[F.expr(f"approx_top_k(`{c}`, {most}, {tracked})").alias(c) for c in columns]).first()
    return {c: [None if item[0] == "n" else item[0][1:] for item in found[c] or []] for c in columns}


def encode(
    days: DataFrame, dictionary: DataFrame, columns: Sequence[str], frequent: dict[str, list[str | None]] | None = None
) -> DataFrame:
    """Add ``<column>_encoded``; a value that is not in the dictionary gets the largest code + 1.

    Small dictionaries are broadcast by Spark on their measured size. For large ones, ``frequent`` (of :func:`frequent_values`) keeps
    values with very many days out of the shuffled join: their codes are broadcast, a bounded number, and their days are
    dealt evenly.
    """
    unseen = dictionary.agg(
        *[F.coalesce(F.max(F.when(F.col("feature") == c, F.col("code"))) + 1, F.lit(0)).alias(f"_unseen_{c}") for c in columns]
    )
    out = with_scalars(days, unseen)
    for c in columns:
        codes = dictionary.where(F.col("feature") == c).select(F.col("value").alias("_value"), F.col("code").alias(f"_code_{c}"))
        if frequent and frequent.get(c):
            out = _join_frequent(out, codes, c, frequent[c])
        else:
            out = out.join(codes, F.col(c).cast("string").eqNullSafe(F.col("_value")), "left").drop("_value")
    return out.select(
        *days.columns, *[F.coalesce(f"_code_{c}", f"_unseen_{c}").alias(f"{c}_encoded") for c in columns]
    )


def _join_frequent(days: DataFrame, codes: DataFrame, column: str, values: list[str | None]) -> DataFrame:
    named = [v for v in values if v is not None]

    def is_frequent(value: Column) -> Column:
        return F.when(value.isNull(), F.lit(None in values)).otherwise(value.isin(named))

    own, code = F.col(column).cast("string"), f"_code_{column}"
    hot = codes.where(is_frequent(F.col("_value"))).withColumnRenamed(code, "_hot")
    with_hot = days.join(F.broadcast(hot), own.eqNullSafe(F.col("_value")), "left").drop("_value")
    # keys of frequent values match nothing and lie apart, so their days go to all tasks
    apart = F.concat(F.lit("hot "), F.pmod(F.xxhash64(*[F.col(c) for c in days.columns]), F.lit(4096)).cast("string"))
    tagged = lambda value: F.coalesce(F.concat(F.lit("v"), value), F.lit("n"))
    rest = codes.where(~is_frequent(F.col("_value"))).select(tagged(F.col("_value")).alias("_other"), code)
    keyed = with_hot.withColumn("_key", F.when(is_frequent(own), apart).otherwise(tagged(own)))
    joined = keyed.join(rest, F.col("_key") == F.col("_other"), "left")
    return joined.select(*days.columns, F.coalesce("_hot", code).alias(code))


def fit_scaler(train_days: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, std) over the training days; a constant feature gets std 1.

    One narrow aggregate over (place, value): two aggregates for each of very many columns make code too large to be compiled.
    Folded days count as often as they stand for.
    """
    if is_folded(train_days):
        stats = _folded_stats(train_days, columns)
    else:
        values = F.array(*[F.col(c).cast("double") for c in columns])
        stats = (
            train_days.select(F.posexplode(values).alias("place", "value"))
            .groupBy("place").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
        )
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("place"))
    return stats.where(F.col("mean").isNotNull()).select(
        name.alias("feature"), "mean", F.when(F.col("std") < SMALLEST_STD, 1.0).otherwise(F.col("std")).alias("std")
    )


def _folded_stats(days: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(place, mean, std) of the rows behind folded days; deviations are summed from the known mean, so none is lost in a difference."""
    cell = lambda c, value, copies: F.struct(F.lit(list(columns).index(c)).alias("place"), value.alias("value"), copies.alias("copies"))
    own = [c for c in columns if c not in SCORES]
    cells = days.select(F.inline(F.array(*[cell(c, F.col(c).cast("double"), F.col("_copies")) for c in own])))
    if scores := [c for c in columns if c in SCORES]:
        held = days.select(F.inline(F.arrays_zip(F.col("_traits").alias("t"), trait_copies().alias("n"))))
        cells = cells.unionByName(held.select(F.inline(F.array(*[cell(c, F.col("t")[c], F.col("n")) for c in scores]))))
    known = cells.where(F.col("value").isNotNull())
    means = known.groupBy("place").agg((F.sum(F.col("value") * F.col("copies")) / F.sum("copies")).alias("mean"))
    found = means.agg(F.map_from_entries(F.collect_list(F.struct("place", "mean"))).alias("m"))  # one entry per feature
    by_place = found.select(F.array(*[F.col("m")[i] for i in range(len(columns))]).alias("_means"))
    mean = F.get("_means", F.col("place"))
    off = F.col("value") - mean
    return with_scalars(known, by_place).groupBy("place").agg(
        F.first(mean).alias("mean"), F.sqrt(F.sum(off * off * F.col("copies")) / F.sum("copies")).alias("std")
    )


def apply_scaler(days: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale ``columns``; all other columns stay. The scaler must cover exactly these columns. Folded days stay folded."""
    fitted = {r["feature"]: (r["mean"], r["std"]) for r in scaler.collect()}
    if set(fitted) != set(columns):
        raise ValueError(f"scaler and features differ in {sorted(set(fitted) ^ set(columns))}")
    by_fit = lambda c, x: (x - F.lit(fitted[c][0])) / F.lit(fitted[c][1])
    scaled = {c: by_fit(c, F.col(c)).alias(c) for c in columns}
    if is_folded(days):
        scaled["_traits"] = map_traits(lambda c, x: by_fit(c, x) if c in fitted else x)
    return days.select(*[scaled.get(c, F.col(c)) for c in days.columns])
