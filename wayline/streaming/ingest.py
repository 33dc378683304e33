"""Streaming ingest of event files: an extension, not part of the batch analyses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayline.session import scratch
from wayline.sources.versions import append

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", schema: str = EVENTS, per_trigger: int = 64) -> DataFrame:
    """Event files as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def once(events: DataFrame, key: str = "event_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each event once among those that come within ``late`` of each other; state is dropped after it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, width: str, by: Sequence[str], at: str = "ts", value: str = "value") -> DataFrame:
    """(window_start, by, n, total) of tumbling windows."""
    out = events.groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def append_log(events: DataFrame, path: str, checkpoint: str, key: Sequence[str] = ("event_id",)) -> StreamingQuery:
    """Appends events to a table of versions; a batch that is repeated after a failure adds nothing twice, and other
    writers may append meanwhile."""
    write = lambda batch, _: append(batch, path, key) and None
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(totals: DataFrame, name: str) -> DataFrame:
    """The totals of a stream over all files that are there now: each batch replaces the table of totals, which stays in
    shared storage and is never gathered by the driver."""
    spark = totals.sparkSession
    path = scratch(spark, name)
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/table")
    run = totals.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(totals.schema).parquet(f"{path}/table")
