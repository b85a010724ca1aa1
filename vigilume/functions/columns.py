"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilume.config import Settings

# Time format of the raw logs.
LOG_TIME = "M/d/yyyy HH:mm:ss"

# File types by suffix (matched on the lower-cased name).
EXECUTABLE = r"\.(exe|msi|bat|cmd)$"
DOCUMENT = r"\.(doc|docx|pdf|xls|xlsx|ppt|pptx|txt|csv)$"
ARCHIVE = r"\.(zip|rar|7z|tar|gz)$"


def log_time(text: Column) -> Column:
    return F.to_timestamp_ntz(text, F.lit(LOG_TIME))


def is_activity(name: str) -> Column:
    return F.col("activity") == name


def one(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also where it is NULL)."""
    return F.when(condition, 1).otherwise(0)


def host_of(url: Column) -> Column:
    """Host of an url without its port; '' where the url has no host part."""
    return F.split_part(F.split_part(url, F.lit("/"), F.lit(3)), F.lit(":"), F.lit(1))


def lacks_domain(address: Column, domain: str) -> Column:
    return ~F.coalesce(address, F.lit("")).contains(domain)


def has_suffix(name: Column, pattern: str) -> Column:
    return F.lower(name).rlike(pattern)


def after_hours(hour: Column, cfg: Settings) -> Column:
    return (hour < cfg.work_start) | (hour >= cfg.work_end)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def minutes_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(60e6)


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def unit_hash(*parts: Column) -> Column:
    """Uniform number in [0, 1) from the text of the parts; the same on every run and partitioning."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0 where den is 0."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of an aggregate without grouping (exactly one row) to every row."""
    packed = one_row.select(F.struct(*[F.col(c) for c in one_row.columns])).scalar()
    return df.withColumn("_scalars", packed).select(*df.columns, "_scalars.*")


def require(df: DataFrame, columns: list[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: columns {missing} are missing")


def from_micros(us: Column) -> Column:
    """The zone-less timestamp so many microseconds after 1970, whatever the session's time zone."""
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01").cast("timestamp_ntz"))


def epoch_instant(ts: Column) -> Column:
    """A zone-less timestamp as an instant, as if it were UTC, for watermarks: the session's time zone plays no part."""
    return F.timestamp_micros(micros(ts))
