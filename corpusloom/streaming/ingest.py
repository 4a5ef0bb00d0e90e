"""Event streams: exactly-once ingest, counters by event time with late data, and files seen before.

The origin has no streams; these are extensions that reuse the batch operators' semantics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def event_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """The parquet files of a folder as a stream with the event time as ``at``."""
    read = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return read.withColumn("at", F.col("ts").cast("timestamp"))


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once, remembered for as long as late data may come."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, size: str = "1 day", late: str | None = "1 hour") -> DataFrame:
    """window start, event_type, n, total of tumbling windows; ``late`` is None where the stream has its watermark already."""
    marked = events if late is None else events.withWatermark("at", late)
    w = marked.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user by event time."""
    s = events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("s"), "user_id").agg(F.count("*").alias("n_events"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_events")


def monthly_counters(events: DataFrame) -> DataFrame:
    """Calls by event type and calendar month, kept for good (no watermark): the counters of the quotas."""
    return events.groupBy("event_type", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("used"))


def run_available(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> None:
    """Everything that is there now, exactly once a checkpoint, to parquet (append) or a table in memory (complete)."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    query = writer.format("parquet").option("path", out).start() if mode == "append" else writer.format("memory").queryName(out).start()
    query.awaitTermination()
