"""Crawl state kept by key in a stream: a value for each page, a timer for its expiry.

A batch of fetches touches only the state of its own pages, and what comes out is the log of
their changes; the state table is the last entry of each page. The state store's checkpoint
makes a restart go on after the last finished batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A log of changes; times are microseconds inside the processor.
CHANGES = "url string, change string, content_hash string, first_seen long, last_seen long, last_changed long, step long"
_entry = Row("url", "change", "content_hash", "first_seen", "last_seen", "last_changed", "step")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PageState(StatefulProcessor):
    """First and last fetch of a page, its content and when that changed last.

    Fetches are taken in the order of time, ties by their content. One that is older than the
    last known fetch is late, one that was seen already is a repeat: neither changes anything.
    ``gone`` ends a page, ``ok`` without content demotes it, and ``error`` and ``robots`` only
    keep a known page alive. A page that isn't fetched for ``keep_ms`` expires.
    """

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", "content_hash string, first_seen long, last_seen long, last_changed long, last_key string, step long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        state = self.page.get() if self.page.exists() else None
        known = None if state is None else list(state)
        out = []
        for r in sorted(rows, key=lambda r: (r["t"], r["status"], r["content_hash"] or "")):
            name = f"{r['status']} {r['content_hash'] or ''}"
            if known and known[2] is not None and (r["t"] < known[2] or r["t"] == known[2] and name <= known[4]):
                continue  # late, or seen already
            change = self._change(r, known)
            if change in ("gone", "demoted"):
                # the time stays, so that older fetches are still known to be late
                known = [None, None, r["t"], None, name, known[5] + 1]
                out.append(_entry(key[0], change, *known[:4], known[5]))
                continue
            if change in ("skipped", "failed") and (known is None or known[1] is None):
                continue
            step = known[5] + 1 if known else 1
            if known is None or known[1] is None:
                known = [r["content_hash"], r["t"], r["t"], r["t"], name, step]
            else:
                fresh = change == "updated"
                known = [r["content_hash"] if fresh else known[0], known[1], r["t"], r["t"] if fresh else known[3], name, step]
            out.append(_entry(key[0], change, *known[:4], step))
        if out:
            self.page.update(tuple(known))
            if self.keep_ms is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(known[2] // 1000 + self.keep_ms)
        yield from out

    @staticmethod
    def _change(r: Row, known: list | None) -> str:
        alive = known is not None and known[1] is not None
        if r["status"] == "gone":
            return "gone" if alive else "skipped"
        if r["status"] == "not_modified":
            return "unchanged" if alive else "skipped"
        if r["status"] != "ok":
            return "failed"
        if r["content_hash"] is None:
            return "demoted" if alive else "skipped"
        if not alive:
            return "added"
        return "unchanged" if known[0] == r["content_hash"] else "updated"

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        if self.page.exists():
            state = self.page.get()
            if state[1] is not None:
                yield _entry(key[0], "expired", None, None, state[2], None, state[5] + 1)
            self.page.clear()

    def close(self) -> None:
        pass


def changes(fetches: DataFrame, late: str = "0 seconds", keep_ms: int | None = None) -> DataFrame:
    """The log of changes (CHANGES) of a stream of fetches (``url, status, content_hash, at``).

    Fetches that come more than ``late`` behind the greatest time of earlier batches are left
    out by the watermark. With ``keep_ms`` pages expire so long after their last fetch.
    """
    spark = fetches.sparkSession
    spark.conf.set(_PROVIDER, _ROCKS)  # the store that keeps timers and named values
    rows = fetches.select("url", "status", "content_hash", "at", F.unix_micros("at").alias("t")).withWatermark("at", late)
    out = rows.groupBy("url").transformWithState(PageState(keep_ms), CHANGES, "Update", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("first_seen", "last_seen", "last_changed")})


def state_of(log: DataFrame) -> DataFrame:
    """The pages that are alive after a log of changes, each by its last entry."""
    order = W.partitionBy("url").orderBy(F.desc("last_seen"), F.desc("step"))
    last = log.withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return last.where(~F.col("change").isin("gone", "demoted", "expired")).select("url", "content_hash", "first_seen", "last_seen", "last_changed")


def follow(spark: SparkSession, source: str, log: str, checkpoint: str, schema: str, late: str = "0 seconds", keep_ms: int | None = None, files: int = 64) -> None:
    """Take all new files of fetches in a folder to the log, and stop; another call goes on where this one ended."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    changes(stream, late, keep_ms).writeStream.outputMode("update").foreachBatch(_append(log)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _append(log: str):
    def write(batch: DataFrame, number: int) -> None:
        # a batch that comes again replaces itself
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return write
