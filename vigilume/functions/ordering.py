"""Running totals and ranks over a whole table without sorting it in one task.

Rows are range-partitioned by key, and the partition number is stored with them. Totals then run inside
each range and are shifted by the totals of the ranges before it; only the table of ranges (one row per
shuffle partition and ``by`` group) is handled in one place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vigilume.session import stored


def running_totals(
    df: DataFrame,
    key: str,
    totals: Mapping[str, Column],
    by: Sequence[str] = (),
    previous: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running totals in ascending ``key`` order, NULL last.

    ``key`` is unique within ``by``, and ``by`` has few distinct values. For every column in
    ``previous`` the value on the preceding row is added as ``prev_<column>``. The ranges are written
    to the shared folder: they are read twice and must be the same both times.
    """
    cols = df.columns
    ranged = stored(
        df.select("*", *[expr.alias(f"_t_{name}") for name, expr in totals.items()])
        .repartitionByRange(*by, F.col(key).asc_nulls_last())
        .withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    order = W.partitionBy(*by, "_range").orderBy(F.col(key).asc_nulls_last())
    local = order.rowsBetween(W.unboundedPreceding, 0)
    last = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"))
    per_range = ranged.groupBy(*by, "_range").agg(
        *[F.sum(f"_t_{n}").alias(f"_s_{n}") for n in totals],
        *[F.max_by(c, last).alias(f"_l_{c}") for c in previous],
    )
    ranges = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("_range")
    before = ranges.rowsBetween(W.unboundedPreceding, -1)
    shift = per_range.select(
        *[F.col(b).alias(f"_by_{b}") for b in by],
        F.col("_range").alias("_at"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals],
        *[F.lag(f"_l_{c}").over(ranges).alias(f"_p_{c}") for c in previous],
    )
    same_range = F.col("_range") == F.col("_at")
    for b in by:
        same_range = same_range & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    local_rows = ranged.select(
        *cols, "_range",
        *[F.sum(f"_t_{n}").over(local).alias(f"_w_{n}") for n in totals],
        *[F.lag(c).over(order).alias(f"_g_{c}") for c in previous],
        F.row_number().over(order).alias("_row"),
    )
    # one row per shuffle partition and `by` group
    joined = local_rows.join(F.broadcast(shift), same_range)
    return joined.select(
        *cols,
        *[(F.col(f"_w_{n}") + F.col(f"_o_{n}")).alias(n) for n in totals],
        *[
            F.when(F.col("_row") == 1, F.col(f"_p_{c}")).otherwise(F.col(f"_g_{c}")).alias(f"prev_{c}")
            for c in previous
        ],
    )


def ranked(df: DataFrame, key: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Add the 1-based rank of every (unique) key within ``by``."""
    return running_totals(df, key, {name: F.lit(1).cast("long")}, by=by)


def segmented(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column] | None = None,
    latest: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    keep: Column | None = None,
) -> DataFrame:
    """Scans that start anew at each key ``by``, in the order of ``order``, without a task for a key.

    Rows are range-partitioned by key and order, so a key with many rows lies in several ranges. Each range is scanned by
    itself, key by key; what its last key has come to is carried into the ranges in which that key goes on. ``totals`` are
    inclusive running sums (NULL counts as 0); ``latest`` the last non-NULL value on the row or before it; ``previous`` the value on
    the row before. Only rows with ``keep`` are returned, and only these (and a row for each range) are stored. Rows that are equal
    in key and order lie in one range; which comes first among them is open. NULL keys are keys of their own.
    """
    totals, latest, previous = totals or {}, latest or {}, previous or {}
    spark = df.sparkSession
    wanted = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prepared = df.select(
        "*", wanted.alias("_keep"),
        *[F.coalesce(x, F.lit(0)).alias(f"_t_{n}") for n, x in totals.items()],
        *[x.alias(f"_t_{n}") for n, x in {**latest, **previous}.items()],
    )
    ranged = prepared.repartitionByRange(ranges, *by, *order).withColumn("_range", F.spark_partition_id()).repartitionById(ranges, F.col("_range"))
    inside = W.partitionBy("_range", *by).orderBy(*order)
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    scanned = ranged.select(
        *df.columns, "_keep", "_range",
        *[F.sum(f"_t_{n}").over(so_far).alias(f"_l_{n}") for n in totals],
        *[F.last(f"_t_{n}", ignorenulls=True).over(so_far).alias(f"_l_{n}") for n in latest],
        *[F.struct(F.lag(f"_t_{n}").over(inside).alias("before"), F.col(f"_t_{n}").alias("own"), (F.row_number().over(inside) == 1).alias("first")).alias(f"_l_{n}") for n in previous],
        F.lead(F.lit(1)).over(W.partitionBy("_range").orderBy(*by, *order)).isNull().alias("_last"),
    )
    kept = stored(scanned.where("_keep or _last"), "segments")
    # one row for each range: what it hands on, with what its last key had when it began
    ends = kept.where("_last").select("_range", F.struct(*[F.col(b) for b in by]).alias("_key"), *[f"_l_{n}" for n in {**totals, **latest, **previous}])
    over_key = W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, 0)
    handed = ends.select(
        "_range", "_key",
        *[F.sum(f"_l_{n}").over(over_key).alias(f"_c_{n}") for n in totals],
        *[F.last(f"_l_{n}", ignorenulls=True).over(over_key).alias(f"_c_{n}") for n in latest],
        *[F.col(f"_l_{n}.own").alias(f"_c_{n}") for n in previous],
    )
    onward = W.partitionBy(F.lit(0)).orderBy("_range")
    carried = handed.select(
        F.col("_range").alias("_at"), F.lag("_key").over(onward).alias("_from"),
        *[F.lag(f"_c_{n}").over(onward).alias(f"_c_{n}") for n in {**totals, **latest, **previous}],
    )
    rows = kept.where("_keep").join(F.broadcast(carried), F.col("_range") == F.col("_at"))
    goes_on = F.col("_from").isNotNull()
    for b in by:
        goes_on = goes_on & F.col(b).eqNullSafe(F.col(f"_from.{b}"))
    from_before = lambda n: F.when(goes_on, F.col(f"_c_{n}"))
    return rows.select(
        *df.columns,
        *[(F.col(f"_l_{n}") + F.coalesce(from_before(n), F.lit(0))).alias(n) for n in totals],
        *[F.coalesce(F.col(f"_l_{n}"), from_before(n)).alias(n) for n in latest],
        *[F.when(F.col(f"_l_{n}.first"), from_before(n)).otherwise(F.col(f"_l_{n}.before")).alias(n) for n in previous],
    )
