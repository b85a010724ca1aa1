"""Table profiles, context summaries and the tables behind charts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from vigilume.functions.columns import with_scalars
from vigilume.operators.metrics import percentiles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
SHOWN_TEXT = 50


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def table_counts(spark: SparkSession, tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """(table, rows, status); a table that is None is reported as missing."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit("ok").alias("status"))
        for name, df in tables.items() if df is not None
    ]
    missing = [(name, 0, "not found") for name, df in tables.items() if df is None]
    if missing or not parts:
        parts.append(spark.createDataFrame(missing, "table string, rows bigint, status string"))
    return _union(parts)


def schema_listing(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def sample_rows(df: DataFrame, limit: int = 10) -> DataFrame:
    """The first rows as text: NULL spelled out, long text cut at fifty characters."""
    def shown(c: str):
        text = F.col(c).cast("string")
        cut = F.when(F.length(text) > SHOWN_TEXT, F.concat(F.substring(text, 1, SHOWN_TEXT - 3), F.lit("...")))
        return F.coalesce(cut, text, F.lit("NULL")).alias(c)

    return df.limit(limit).select(*[shown(c) for c in df.columns])


def numeric_profile(df: DataFrame) -> DataFrame:
    """(column, non_null, distinct_values, min, max, avg) of every numeric column.

    Values are counted per (column, value) first, which makes the distinct counts plain counts.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    if not names:
        raise ValueError("no numeric column")
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    values = numbers.unpivot([], names, "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))
    present = F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)
    return values.groupBy("column").agg(
        F.sum(present).alias("non_null"),
        F.count("value").alias("distinct_values"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (F.sum(F.col("value") * F.col("n")) / F.sum(present)).alias("avg"),
    )


def top_values(df: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent values of every text column, ties in value order."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        raise ValueError("no text column")
    counts = (
        df.select(*names).unpivot([], names, "column", "value").where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count("*").alias("n"))
    )
    place = F.row_number().over(W.partitionBy("column").orderBy(F.col("n").desc(), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def event_overview(events: DataFrame) -> DataFrame:
    """(metric, value) rows: time range, days, users, machines and counts by activity."""
    keyed = events.select(
        "datetime", F.to_date("datetime").cast("string").alias("day"), F.col("user_id").alias("user"), "pc", "activity"
    )
    keys = keyed.unpivot(["datetime"], ["day", "user", "pc", "activity"], "tag", "key").groupBy("tag", "key").agg(
        F.count("*").alias("n"), F.min("datetime").alias("first"), F.max("datetime").alias("last")
    )
    is_tag = lambda t: (F.col("tag") == t) & F.col("key").isNotNull()
    row = keys.agg(
        F.date_format(F.min("first"), "yyyy-MM-dd HH:mm:ss").alias("first_event"),
        F.date_format(F.max("last"), "yyyy-MM-dd HH:mm:ss").alias("last_event"),
        F.count_if(is_tag("day")).cast("string").alias("days"),
        F.count_if(is_tag("user")).cast("string").alias("users"),
        F.min(F.when(is_tag("user"), F.col("key"))).alias("first_user"),
        F.max(F.when(is_tag("user"), F.col("key"))).alias("last_user"),
        F.count_if(is_tag("pc")).cast("string").alias("pcs"),
        F.coalesce(F.sum(F.when((F.col("tag") == "pc") & F.col("key").isNull(), F.col("n"))), F.lit(0)).cast("string").alias("null_pcs"),
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in row.columns])
    activity = keys.where(F.col("tag") == "activity").select(
        F.concat(F.lit("activity "), F.coalesce("key", F.lit("NULL"))).alias("metric"), F.col("n").cast("string").alias("value")
    )
    return row.select(F.inline(pairs)).unionByName(activity)


def top_users_sample(events: DataFrame, users: int = 3, rows: int = 5) -> DataFrame:
    """The busiest users, each with their first events."""
    counts = events.groupBy("user_id").agg(F.count("*").alias("events"))
    best = counts.orderBy(F.col("events").desc(), "user_id").limit(users)
    # `users` rows
    chosen = events.join(F.broadcast(best), "user_id")
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("datetime", "id"))
    return chosen.withColumn("nth", nth).where(F.col("nth") <= rows).select(
        "user_id", "events", "nth", "datetime", "activity", "pc",
        F.substring("url", 1, 40).alias("url"), F.substring("to_addr", 1, 30).alias("to_addr"),
    )


def context_summary(truth: DataFrame, traits: DataFrame, changes: DataFrame, ended: DataFrame) -> DataFrame:
    """(part, item, value) rows printed while context tables are built."""
    names = [c for c in traits.columns if c != "user_id"]
    row = traits.agg(*[F.struct(F.min(t).alias("lo"), F.max(t).alias("hi")).alias(t) for t in names])
    ranges = F.array(
        *[F.struct(F.lit(f"{t} {side}").alias("item"), F.col(t)[key].cast("long").alias("value")) for t in names for side, key in (("min", "lo"), ("max", "hi"))]
    )
    flags = [c for c in changes.columns if c.endswith("_changed")]
    totals = changes.agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in flags])
    sums = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("long").alias("value")) for c in totals.columns])
    return _union(
        [
            truth.groupBy("scenario").agg(F.count("*").alias("value")).select(
                F.lit("scenario").alias("part"), F.col("scenario").cast("string").alias("item"), "value"
            ),
            row.select(F.lit("trait").alias("part"), F.inline(ranges)),
            totals.select(F.lit("changes").alias("part"), F.inline(sums)),
            ended.groupBy("termination_month").agg(F.count("*").alias("value")).select(
                F.lit("terminated").alias("part"), F.col("termination_month").alias("item"), "value"
            ),
        ]
    )


def score_histogram(scores: DataFrame, steps: DataFrame, edges: int = 120) -> DataFrame:
    """(label, bin, n, density) between the lowest score and the 99.5th percentile, by class.

    ``edges`` evenly spaced edges bound ``edges - 1`` bins. Where all scores are equal they fall into bin 0, without a density.
    """
    bins = edges - 1
    span = with_scalars(scores.agg(F.min("score").alias("_lo")), percentiles(steps, {"_hi": 0.995}))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    at = F.when(width > 0, F.floor(F.try_divide(F.col("score") - F.col("_lo"), width)).cast("int")).otherwise(0)
    placed = (
        with_scalars(scores.select("label", "score"), span.select("_lo", "_hi"))
        .where(F.col("score") <= F.col("_hi"))
        .select("label", F.least(at, F.lit(bins - 1)).alias("bin"), width.alias("_width"))
    )
    counts = placed.groupBy("label", "bin").agg(F.count("*").alias("n"), F.max("_width").alias("_width"))
    whole = F.sum("n").over(W.partitionBy("label"))  # at most `bins` rows per class
    return counts.select("label", "bin", "n", F.try_divide(F.col("n"), whole * F.col("_width")).alias("density"))


def long_form(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, metric, value): chart tables from wide ones."""
    return df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(list(keys), list(values), "metric", "value")


def confusion_cells(metrics: DataFrame) -> DataFrame:
    """The 2x2 cells of one confusion row."""
    cells = F.array(
        *[
            F.struct(F.lit(t).alias("truth"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
            for t, p, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
        ]
    )
    return metrics.select(F.inline(cells))


def session_confusion(session_metrics: DataFrame) -> DataFrame:
    """Session cells of a session metrics row; true negatives are unknown and shown as 0."""
    c = F.col
    return confusion_cells(
        session_metrics.select(
            F.lit(0).cast("long").alias("tn"),
            (c("total_flagged_sessions") - c("flagged_insider_sessions")).alias("fp"),
            (c("total_insider_sessions") - c("flagged_insider_sessions")).alias("fn"),
            c("flagged_insider_sessions").alias("tp"),
        )
    )


def timeline(latencies: DataFrame) -> DataFrame:
    """Truth window, first positive and first detection of every positive user."""
    return latencies.select(
        "user_id", "truth_start", "truth_end", "first_insider_date", "first_detection_date",
        F.when(F.col("detected") > 0, "caught").otherwise("missed").alias("outcome"),
    )


def scatter_points(scores: DataFrame, seed: int) -> DataFrame:
    """Points of a score scatter plot with a hash to order them by instead of a shuffle."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), "user_id", F.col("seq_no").cast("string"), F.col("copy").cast("string")))
    return scores.select("user_id", "seq_no", "copy", "label", "score", draw.alias("draw"))
