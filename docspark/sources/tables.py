"""Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A table of fewer files than cores and less than this is dealt out: its few row groups keep only a few cores busy.
SMALL_BYTES = 256 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table by name, dealt out to all cores if it is small."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL_BYTES and len(df.inputFiles()) < cores else df
