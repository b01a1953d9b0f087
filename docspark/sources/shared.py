"""The folder that driver and executors share, and tables in it that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
#: Keys that are broadcast at most (bytes, 24 for each); more are joined by a shuffle.
MOST_KEYS = 32 << 20


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that executors see too: in ``spark.checkpoint.dir`` of the session or its context; a local one only for a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp()}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Let no Arrow batch hold more than BATCH_BYTES: ten thousand rows may be long texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(name) or "").rstrip("bB")
    if not now.isdigit() or int(now) <= 0 or int(now) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of each query go when it ends: else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def hinted(keys: DataFrame, n: int) -> DataFrame:
    """``keys`` to join with: ``n`` of them are broadcast if they are few."""
    return F.broadcast(keys) if 24 * n <= MOST_KEYS else keys


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a written table, which a lost executor doesn't take with it."""
    at = folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
