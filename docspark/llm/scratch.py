"""Durable intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset
(tests on one machine) a temporary folder is made and set.  Tables are written as
Parquet, so a lost executor never takes part of an intermediate result with it,
and lineage ends at the written files.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from docspark.sources.shared import bound_batches
from docspark.sources.tables import read_table

#: Written tables, each with a weak reference to what their plans read.
_made: dict[str, Any] = {}
_own: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared folder named by the session. Where none is set, a local one, which only a local session can share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="docspark-"))
        spark.sparkContext.setCheckpointDir(_own[0])
    return f"file://{_own[0]}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the result has no lineage."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    # every plan over the table, derived ones too, holds this one object
    index = back._jdf.queryExecution().analyzed().relation().location()
    if not _made:
        atexit.unregister(_clean_up)
        atexit.register(_clean_up, spark)
    _made[path] = spark.sparkContext._jvm.java.lang.ref.WeakReference(index)
    return back


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def sweep(spark: SparkSession) -> None:
    """Delete the written tables that no DataFrame reads any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _delete(spark, [path for path, index in _made.items() if index.get() is None])


def release(*tables: DataFrame) -> None:
    """Delete written tables before their DataFrames go. Only for callers whose later plans no longer read them."""
    for df in tables:
        root_of = df._jdf.queryExecution().analyzed().relation().location().rootPaths().head().toString()
        _delete(df.sparkSession, [path for path in _made if path.rsplit("/", 1)[1] == root_of.rsplit("/", 1)[1]])


def tidy(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete these written tables, and let Spark's cleaner drop the shuffles of jobs that are over."""
    release(*tables)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        del _made[name]
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def _clean_up(spark: SparkSession) -> None:
    """When the driver's process ends in order, its tables go; a stopped session leaves them to the folder's owner."""
    if spark.sparkContext._jsc is not None:
        _delete(spark, list(_made))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return read_table(spark, sf_dir, name) if name == "documents" else spark.read.parquet(f"{sf_dir}/{name}.parquet")
