"""Live daily counts over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from vigilume.config import Settings
from vigilume.functions.columns import after_hours, epoch_instant, from_micros, host_of, is_activity
from vigilume.session import shared_dir

LATE = "1 day"


def live_daily(events: DataFrame, cfg: Settings, late: str = LATE) -> DataFrame:
    """Counts per user and day, for the update output mode.

    A day stays open for ``late`` after its end; later events are dropped by the watermark. Distinct hosts are exact: a host's
    first visit of a user and day passes a deduplication and is counted in the aggregate behind it. Its state is
    kept by day, so it ends with the day's; a deduplication within the watermark would forget a host ``late`` after its first visit.
    """
    timed = events.withColumn("ts", epoch_instant(F.col("datetime"))).withWatermark("ts", late)
    day = F.window("ts", "1 day").alias("day")
    counted = timed.select(day, "user_id", F.lit(1).alias("event"), "activity", F.hour("datetime").alias("hour"))
    hosts = (
        timed.select(day, "user_id", F.when(is_activity("Http"), host_of(F.col("url"))).alias("host"))
        .where(F.col("host").isNotNull()).dropDuplicates(["day", "user_id", "host"])
        .select("day", "user_id", F.lit(0).alias("event"), F.lit(None).cast("string").alias("activity"), F.lit(None).cast("int").alias("hour"))
    )
    is_event = F.col("event") == 1
    return (
        counted.unionByName(hosts).groupBy("day", "user_id")
        .agg(
            F.count_if(is_event).alias("total_actions"),
            F.count_if(is_activity("Logon")).alias("num_sessions"),
            F.count_if(is_activity("Http")).alias("http_request_count"),
            F.count_if(is_activity("Email")).alias("emails_sent"),
            F.count_if(is_activity("File")).alias("file_copy_count"),
            F.count_if(is_activity("Connect")).alias("usb_connect_count"),
            F.count_if(after_hours(F.col("hour"), cfg)).alias("after_hours_actions"),
            F.count_if(~is_event).alias("unique_domains"),
        )
        .select("user_id", F.to_date(from_micros(F.unix_micros("day.start"))).alias("date"), *COUNTS)
    )


COUNTS = [
    "total_actions", "num_sessions", "http_request_count", "emails_sent", "file_copy_count", "usb_connect_count", "after_hours_actions",
    "unique_domains",
]
#: A state store that writes what has changed in a batch, not the whole state; keyed lists and timers need it.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def run_available(counts: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Process what is there, then read the result: the last written row per key.

    Each batch writes its changed rows to a folder of its own, so a repeated batch replaces itself. The query gets its
    state store with its start; the session keeps its own setting.
    """
    spark = counts.sparkSession
    home = shared_dir(spark, "stream")
    schema = counts.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/rows/batch={number}")

    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        query = (
            counts.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/checkpoint")
            .trigger(availableNow=True).foreachBatch(keep).start()
        )
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    query.awaitTermination()
    rows = spark.read.schema(schema.add("batch", "long")).option("basePath", f"{home}/rows").parquet(f"{home}/rows/batch=*")
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("batch").desc()))
    return rows.withColumn("_newest", newest).where(F.col("_newest") == 1).drop("_newest", "batch")
