"""Answers with the feedback they got, as a join of two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWERS = "request_id string, question string, confidence string, at timestamp"
FEEDBACK = "request_id string, verdict string, at timestamp"


def with_feedback(answers: DataFrame, feedback: DataFrame, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``request_id, question, confidence, at, verdict, feedback_at`` of every answer, with the feedback that came ``within`` that time after it.

    Events that come again count once (by request id, as long as the watermark remembers it).
    An answer without feedback comes out, with nulls, when none can come any more: after the
    watermark of both streams has passed its time. Events that are later than ``late`` behind
    their stream are left out.
    """
    a = answers.select("request_id", "question", "confidence", "at").withWatermark("at", late).dropDuplicatesWithinWatermark(["request_id"])
    f = feedback.select(F.col("request_id").alias("of"), F.lower("verdict").alias("verdict"), F.col("at").alias("feedback_at")).withWatermark("feedback_at", late).dropDuplicatesWithinWatermark(["of"])
    bound = (F.col("request_id") == F.col("of")) & (F.col("feedback_at") >= F.col("at")) & (F.col("feedback_at") <= F.col("at") + F.expr(f"interval {within}"))
    return a.join(f, bound, "left_outer").drop("of")


def follow(spark: SparkSession, answers: str, feedback: str, log: str, checkpoint: str, within: str = "1 hour", late: str = "2 hours") -> None:
    """Join all new files of two folders and append the result to a folder; another call goes on where this one ended."""
    read = lambda path, schema: spark.readStream.schema(schema).parquet(path)
    out = with_feedback(read(answers, ANSWERS), read(feedback, FEEDBACK), within, late)
    out.writeStream.outputMode("append").format("parquet").option("path", log).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def verdicts(rows: DataFrame) -> DataFrame:
    """Answers by confidence and verdict; without feedback: none."""
    return rows.groupBy("confidence", F.coalesce("verdict", F.lit("none")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
