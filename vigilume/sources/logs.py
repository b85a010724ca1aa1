"""Reading raw logs, and the unified event table."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.errors import AnalysisException

from vigilume.config import FUNCTIONAL_UNIT_CODES, Settings
from vigilume.functions.columns import log_time
from vigilume.schema import EVENT_COLUMNS, LABELS, LOG_SCHEMAS, PSYCHOMETRIC, SNAPSHOT, TRAITS

# Activity names set at union time; the other logs carry their own.
LOG_ACTIVITY = {"email": "Email", "file": "File", "http": "Http"}
_RENAMED = {"user": "user_id", "to": "to_addr"}


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The columns of ``schema`` from CSV files with a header, found by name; quoted text may hold commas.

    Other columns and their order don't matter, but all files of one read share one header. A column that is missing
    raises; a value that isn't of the column's type becomes NULL. Mail bodies with line breaks need ``multiLine`` files.
    """
    header = spark.read.csv(path, header=True, escape='"').columns
    missing = [c for c in schema.names if c not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(header)}")
    text = StructType([StructField(c, StringType()) for c in header])
    raw = spark.read.schema(text).csv(path, header=True, escape='"', enforceSchema=False)
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])


def is_absent(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has ended: Spark leaves a marker then."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


@dataclass(frozen=True)
class Conversion:
    """What became of a file: rows of its target, or why there is none."""

    rows: int = 0
    kept: bool = False
    error: str | None = None


def csv_to_parquet(spark: SparkSession, jobs: dict[str, tuple[str, str, StructType]]) -> dict[str, Conversion]:
    """Convert each ``name: (csv, parquet, schema)``; a complete target is kept, what an aborted run has left is replaced.

    A file that cannot be converted does not stop the others.
    """
    outcome = {}
    for name, (source, target, schema) in jobs.items():
        try:
            kept = is_complete(spark, target)
            if not kept:
                read_csv(spark, source, schema).write.mode("overwrite").parquet(target, compression="snappy")
            outcome[name] = Conversion(spark.read.schema(schema).parquet(target).count(), kept)
        except Exception as e:  # noqa: BLE001 - collected per file
            outcome[name] = Conversion(error=f"{type(e).__name__}: {str(e).splitlines()[0]}")
    return outcome


def log_events(log: DataFrame, kind: str) -> DataFrame:
    """One raw log projected to the columns it shares with the event table."""
    activity = F.lit(LOG_ACTIVITY[kind]) if kind in LOG_ACTIVITY else F.col("activity")
    kept = [c for c in log.columns if c not in ("date", "activity")]
    return log.select(
        log_time(F.col("date")).alias("datetime"),
        activity.alias("activity"),
        *[F.col(c).alias(_RENAMED.get(c, c)) for c in kept],
    )


def unify_events(logs: dict[str, DataFrame]) -> DataFrame:
    """Union of the given logs on the full event schema; a log that is absent adds no rows."""
    if not logs:
        raise ValueError("no activity log was given")
    if "http" not in logs:
        warnings.warn("no http log: web activity will be missing", stacklevel=2)
    parts = [log_events(logs[k], k) for k in LOG_SCHEMAS if k in logs]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    absent = [F.lit(None).cast(t).alias(c) for c, t in EVENT_COLUMNS.items() if c not in union.columns]
    return union.select("*", *absent).select(*EVENT_COLUMNS)


def load_logs(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The Parquet logs found under ``root``."""
    found = {}
    for kind in LOG_SCHEMAS:
        try:
            found[kind] = spark.read.schema(LOG_SCHEMAS[kind]).parquet(f"{root}/{kind}.parquet")
        except AnalysisException as e:
            if not is_absent(e):
                raise
    return found


def write_events(events: DataFrame, target: str) -> None:
    """Store events partitioned by date, so that a date range reads only its own folders."""
    (
        events.withColumn("date", F.to_date("datetime"))
        .write.mode("overwrite").partitionBy("date").parquet(target, compression="snappy")
    )


def read_snapshots(spark: SparkSession, glob: str) -> DataFrame:
    """All monthly directory files, tagged with the month in their name."""
    month = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    return read_csv(spark, glob, SNAPSHOT).select("*", month.alias("ldap_month"))


def traits(raw: DataFrame) -> DataFrame:
    return raw.select("user_id", *[F.col(c).alias(n) for c, n in TRAITS.items()])


def read_traits(spark: SparkSession, path: str) -> DataFrame | None:
    """Trait scores by user, or None when the file is absent."""
    try:
        return traits(read_csv(spark, path, PSYCHOMETRIC))
    except AnalysisException as e:
        if not is_absent(e):
            raise
        return None


def truth_intervals(raw: DataFrame, cfg: Settings) -> DataFrame:
    """Label intervals of the chosen data set, with parsed times."""
    return raw.where(F.col("dataset") == cfg.dataset).select(
        "dataset", "scenario", "details",
        F.col("user").alias("user_id"),
        log_time(F.col("start")).alias("start_date"),
        log_time(F.col("end")).alias("end_date"),
    )


def read_truth(spark: SparkSession, path: str, cfg: Settings) -> DataFrame:
    return truth_intervals(read_csv(spark, path, LABELS), cfg)


def unit_codes(spark: SparkSession, codes: dict[str, int] = FUNCTIONAL_UNIT_CODES) -> DataFrame:
    return spark.createDataFrame(list(codes.items()), "name string, code int")


def encode_units(df: DataFrame, column: str, codes: dict[str, int] = FUNCTIONAL_UNIT_CODES) -> DataFrame:
    """Add ``code`` from the configured (fixed, small) code list; NULL for unknown names."""
    lookup = unit_codes(df.sparkSession, codes).withColumnRenamed("name", column)
    return df.join(F.broadcast(lookup), column, "left")


def events_in_range(events: DataFrame, start: str, end: str, cfg: Settings) -> DataFrame:
    """Events of [start, end], with enough earlier days to fill rolling windows and look-backs."""
    first = F.date_sub(F.lit(start).cast("date"), cfg.lookback + cfg.rolling_window)
    last = F.lit(end).cast("date")
    if "date" in events.columns:  # partition column
        return events.where(F.col("date").between(first, last))
    after = F.date_add(last, 1).cast("timestamp_ntz")
    return events.where((F.col("datetime") >= first.cast("timestamp_ntz")) & (F.col("datetime") < after))


def for_users(df: DataFrame, users: list[str] | DataFrame) -> DataFrame:
    """Rows of the given users: a short list is pushed into the scan, a table is semi-joined."""
    if isinstance(users, DataFrame):
        return df.join(users.select("user_id"), "user_id", "left_semi")
    return df.where(F.col("user_id").isin(users))
