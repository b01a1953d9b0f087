"""Streams: keyed state by micro-batches, event windows, feedback and logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docspark.operators.merge import upsert
from docspark.sources.versions import Versions


def file_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files: int = 64) -> DataFrame:
    """New files of a folder as a stream, a bounded number in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process all that is there in batches and stop; a restart goes on after the last finished batch."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_into(versions: Versions, name: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that merges rows into a versioned table; other tables of the store stay as they are.

    A batch that comes again changes nothing: the same rows replace themselves. Rows that
    come late, after a newer one of their key, change nothing either.
    """

    def handle(batch: DataFrame, _: int) -> None:
        known = name in (versions.manifest() or {}).get("tables", [])
        versions.publish({name: upsert(versions.table(name) if known else batch.limit(0), batch, key, order)})

    return handle


def tumbling(events: DataFrame, width: str, late: str, time: str = "ts", *by: str) -> DataFrame:
    """Counts and sums by windows of ``width``; rows later than ``late`` are left out of a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sliding(events: DataFrame, width: str, slide: str, late: str, time: str = "ts", *by: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(events: DataFrame, gap: str, late: str, key: str = "user_id", time: str = "ts") -> DataFrame:
    """Sessions of each key: events no further apart than ``gap``."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def feedback(events: DataFrame) -> DataFrame:
    """Feedback rows as they are kept: verdict, the question's first 500 characters, who and when."""
    return events.select("ts", F.lower("verdict").alias("verdict"), F.substring("question", 1, 500).alias("question"), "user_name", "user_id", "channel_id", "post_id")


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a log of JSON lines."""
    df.write.mode("append").json(path)


def feedback_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
