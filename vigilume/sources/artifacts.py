"""Preprocessing artifacts: scaler, dictionaries and column lists as three small tables of one version.

A version is a folder ``version=<n>`` under the home. Its tables are written beside it and appear all at once, by one
rename; a write that breaks off leaves the versions as they were, and a reader only ever sees tables that belong together.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilume.config import Settings
from vigilume.operators.features import apply_scaler, encode


@dataclass(frozen=True)
class Artifacts:
    scaler: DataFrame
    dictionary: DataFrame
    columns: dict[str, list[str]]

    def apply(self, days: DataFrame) -> DataFrame:
        """Scale and encode with the saved parameters; nothing is fitted. Folded days stay folded."""
        return encode(apply_scaler(days, self.scaler, self.columns["scaled"]), self.dictionary, self.columns["categorical"])


TABLES = ("scaler", "dictionary", "columns")


def _folder(spark: SparkSession, home: str) -> tuple:
    """The file system of ``home`` and the maker of its paths."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path(home).getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, home: str) -> list[int]:
    """Numbers of the complete versions under ``home``, rising."""
    files, path = _folder(spark, home)
    if not files.exists(path(home)):
        return []
    names = (status.getPath().getName() for status in files.listStatus(path(home)))
    return sorted(int(m[1]) for m in (re.fullmatch(r"version=(\d+)", n) for n in names) if m)


def save(home: str, scaler: DataFrame, dictionary: DataFrame, cfg: Settings) -> int:
    """Write the next version and return its number; earlier ones stay for those who read them."""
    spark = scaler.sparkSession
    named = {"scaled": cfg.scaled, "vector": cfg.vector, "categorical": cfg.categorical}
    rows = [(group, i, c) for group, names in named.items() for i, c in enumerate(names)]
    columns = spark.createDataFrame(rows, "kind string, place int, name string")
    pending = f"{home}/.pending-{uuid.uuid4().hex}"
    for name, table in zip(TABLES, (scaler, dictionary, columns), strict=True):
        table.write.parquet(f"{pending}/{name}")
    files, path = _folder(spark, home)
    while True:
        number = max(versions(spark, home), default=0) + 1
        target = path(f"{home}/version={number}")
        # a version that another writer has made meanwhile is left alone, and the next number tried
        if not files.exists(target) and files.rename(path(pending), target):
            return number


def load(spark: SparkSession, home: str, version: int | None = None) -> Artifacts:
    """The newest version, or the given one; all its tables or, where there is none, FileNotFoundError."""
    known = versions(spark, home)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no preprocessing artifacts under {home}; fit and save them first")
    source = f"{home}/version={known[-1] if version is None else version}"
    scaler, dictionary, columns = (spark.read.parquet(f"{source}/{t}") for t in TABLES)
    grouped = columns.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("c")).collect()
    return Artifacts(scaler, dictionary, {r["kind"]: [c["name"] for c in r["c"]] for r in grouped})


def save_days(days: DataFrame, splits: DataFrame, target: str) -> None:
    """Scaled days with keys, codes and labels, one folder per split."""
    days.join(splits, "user_id").write.mode("overwrite").partitionBy("split").parquet(target, compression="snappy")


def save_sessions(sessions: DataFrame, target: str) -> None:
    """Replace the stored sessions."""
    sessions.write.mode("overwrite").parquet(target, compression="snappy")


def load_days(spark: SparkSession, source: str, split: str | None = None) -> DataFrame:
    """Stored days; with ``split`` only that folder is read."""
    days = spark.read.parquet(source)
    return days if split is None else days.where(F.col("split") == split)


def save_sketches(sketches: DataFrame, target: str) -> None:
    """One folder for each date; dates that are written again are replaced, the others stay."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(target)


def load_sketches(spark: SparkSession, source: str) -> DataFrame:
    return spark.read.parquet(source)


def load_scores(spark: SparkSession, source: str) -> DataFrame:
    return spark.read.parquet(source)


def load_sessions(spark: SparkSession, source: str) -> DataFrame:
    """Stored sessions; order by user and start where they are shown."""
    return spark.read.parquet(source)


def save_scores(scores: DataFrame, target: str) -> None:
    scores.write.mode("overwrite").parquet(target, compression="snappy")


def save_report(report: DataFrame, target: str) -> None:
    """A nested report as JSON lines."""
    report.write.mode("overwrite").json(target)
