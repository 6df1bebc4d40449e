"""Structured Streaming forms of the batch operators, with checkpoints and without driver-side sinks.

Two kinds of plan. Windowed counts are streaming aggregations in update mode, whose state ends with the watermark.
Folds that can be put together from parts (states, receipts) need no state at all: every micro-batch writes the parts
of its own events, built-in aggregates only, and a reader merges them. ``drain`` runs a query over what is there
(available now) into Parquet in the shared folder; a batch overwrites its own directory, so a retried batch writes once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occura import shared
from occura.operators import telemetry

LATE = "1 hour"
EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, directory: str, files_per_batch: int = 1000) -> DataFrame:
    """The events table of a data directory as a file stream."""
    return spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(directory)


def timed(stream: DataFrame, column: str = "ts", late: str = LATE) -> DataFrame:
    """With an event time column ``at`` and a watermark on it."""
    return stream.withColumn("at", F.col(column).cast("timestamp")).withWatermark("at", late)


def rate_per_minute(requests: DataFrame) -> DataFrame:
    """(ip, minute, used) in tumbling minutes."""
    w = F.window("at", "1 minute")
    return timed(requests, "created_at").groupBy("ip", w.alias("w")).agg(F.count("*").alias("used")).select("ip", F.floor(F.unix_seconds("w.start") / 60).alias("minute"), "used")


def traffic_bins(requests: DataFrame, width: int) -> DataFrame:
    """(bin, requests, errors) in tumbling bins that saw a request."""
    w = F.window("at", f"{width} seconds")
    out = timed(requests, "created_at").groupBy(w.alias("w")).agg(F.count("*").alias("requests"), F.count(F.when(F.col("status") >= 500, 1)).alias("errors"))
    return out.select(F.floor(F.unix_seconds("w.start") / width).alias("bin"), "requests", "errors")


def first_deliveries(deliveries: DataFrame, late: str = LATE) -> DataFrame:
    """One delivery of each key; repeats up to ``late`` after it are dropped, then its state ends."""
    return timed(deliveries, late=late).dropDuplicatesWithinWatermark(["key"])


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    out = timed(stream).groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def drain(stream: DataFrame, mode: str, each: Callable[[DataFrame], DataFrame] | None = None, timeout: int = 240) -> DataFrame:
    """Runs the stream over everything there is and returns its output with the number of its ``batch``.

    ``each`` is applied to every micro-batch before it is written. A batch that comes again replaces what it wrote. A
    query that does not end within ``timeout`` seconds is stopped and raises.
    """
    spark = stream.sparkSession
    base = shared.path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        write_batch(each(batch) if each else batch, number, f"{base}/out")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    try:
        if not query.awaitTermination(timeout):
            raise TimeoutError("the stream did not end in time")
    finally:
        query.stop()
    return spark.read.parquet(f"{base}/out")


def write_batch(batch: DataFrame, number: int, path: str) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def latest(updates: DataFrame, *key: str) -> DataFrame:
    """The newest row of each key from the output of an update-mode query."""
    rest = [c for c in updates.columns if c not in (*key, "batch")]
    return updates.groupBy(*key).agg(F.max(F.struct("batch", *rest)).alias("r")).select(*key, *[f"r.{c}" for c in rest])


def stream_rate_per_minute(spark: SparkSession, d: str, as_requests) -> DataFrame:
    return latest(drain(rate_per_minute(as_requests(events(spark, d))), "update"), "ip", "minute")


def stream_traffic_bins(spark: SparkSession, d: str, as_requests, width: int) -> DataFrame:
    return latest(drain(traffic_bins(as_requests(events(spark, d)), width), "update"), "bin")


def folded_state(reviews: DataFrame) -> DataFrame:
    """The state of (user, item) after a stream of reviews: parts per micro-batch, merged when read."""
    return telemetry.state_of(telemetry.merged_state(drain(reviews.withColumn("ts", F.col("ts").cast("timestamp")), "append", telemetry.state_parts)))


def receipts(deliveries: DataFrame) -> DataFrame:
    """Outcomes of a stream of deliveries under their keys: parts per micro-batch, merged when read."""
    return telemetry.merged_receipts(drain(deliveries, "append", telemetry.receipt_parts))


def peak_per_second(requests: DataFrame) -> DataFrame:
    """The busiest second of a stream: counts per second and micro-batch, added up when read."""
    parts = drain(requests, "append", lambda batch: batch.groupBy(telemetry.seconds("created_at").alias("s")).agg(F.count("*").alias("n")))
    return parts.groupBy("s").agg(F.sum("n").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("peak_qps"))


def newest_per_key(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key of a stream: the newest of each micro-batch, compared again when read."""
    return telemetry.latest_per_key(drain(stream, "append", lambda batch: telemetry.latest_per_key(batch, key, order)).drop("batch"), key, order)
