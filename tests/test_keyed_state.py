"""Crawl state by key over several batches: late and repeated fetches, expiry, a restart, and the batch form."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docspark.operators import crawl
from docspark.streaming import keyed

SCHEMA = "url string, status string, content_hash string, at timestamp"
T0 = datetime(2024, 1, 1)


def at(h):
    return T0 + timedelta(hours=h)


def test_batches_with_late_and_repeated_fetches(spark, tmp_path):
    folder, log, point = (f"file://{tmp_path}/{n}" for n in ("in", "log", "cp"))
    batches = [
        [("a", "ok", "1", at(0)), ("b", "ok", "1", at(0)), ("c", "error", None, at(0)), ("d", "ok", "1", at(0)), ("a", "ok", "1", at(0)), ("e", "ok", None, at(0))],
        [("a", "ok", "2", at(5)), ("b", "not_modified", None, at(5)), ("d", "gone", None, at(5)), ("c", "ok", "9", at(5))],
        [("a", "ok", "0", at(3)), ("a", "ok", "2", at(5)), ("d", "ok", "1", at(4)), ("c", "error", None, at(6))],  # late, repeated, late, failed
        [("d", "ok", "3", at(8)), ("b", "ok", None, at(8)), ("c", "ok", "9", at(7))],
    ]
    for rows in batches:  # each batch is a run of its own on the same checkpoint
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        keyed.follow(spark, folder, log, point, SCHEMA, late="100 hours")
    got = {r.url: (r.content_hash, r.first_seen, r.last_seen, r.last_changed) for r in keyed.state_of(spark.read.parquet(log)).collect()}
    assert got == {"a": ("2", at(0), at(5), at(5)), "c": ("9", at(5), at(7), at(5)), "d": ("3", at(8), at(8), at(8))}
    entries = spark.read.parquet(log).groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in entries if r["count"]}.keys() <= {0, 1, 2, 3, 4, 5, 6, 7} and sum(r["count"] for r in entries) == 3 + 4 + 1 + 3


def test_expiry_by_timers(spark, tmp_path):
    folder, log, point = (f"file://{tmp_path}/{n}" for n in ("in", "log", "cp"))
    hour = 3_600_000
    for rows in ([("a", "ok", "1", at(0)), ("b", "ok", "1", at(0))], [("b", "ok", "1", at(9))], [("c", "ok", "1", at(30))], [("d", "ok", "1", at(31))]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        keyed.follow(spark, folder, log, point, SCHEMA, keep_ms=20 * hour)
    changes = {(r.url, r.change) for r in spark.read.parquet(log).collect()}
    assert ("a", "expired") in changes and {r.url for r in keyed.state_of(spark.read.parquet(log)).collect()} >= {"c", "d"}
    assert "a" not in {r.url for r in keyed.state_of(spark.read.parquet(log)).collect()}


def test_one_run_equals_the_batch_form(spark, tmp_path):
    first = [(f"u{i}", "ok", f"h{i}", at(0)) for i in range(20)]
    status = ["ok", "gone", "error", "not_modified"]
    second = [(f"u{i}", status[i % 4], f"h{i + i % 3}" if i % 4 == 0 and i % 5 else None, at(24)) for i in range(5, 30)]
    folder, log, point = (f"file://{tmp_path}/{n}" for n in ("in", "log", "cp"))
    for rows in (first, second):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        keyed.follow(spark, folder, log, point, SCHEMA)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    got = keyed.state_of(spark.read.parquet(log)).select("url", "content_hash", day("first_seen"), day("last_seen"), day("last_changed"))
    state = crawl.next_state(spark.createDataFrame([], "url string, content_hash string, first_seen string, last_seen string, last_changed string"), spark.createDataFrame([(u, "added", h) for u, _, h, _ in first], "url string, change string, content_hash string"), spark.createDataFrame([], "url string"), "2024-01-01")
    fetched = spark.createDataFrame(second, SCHEMA)
    change = crawl.classify(fetched, state)
    gone = change.where("change in ('gone', 'demoted')").select("url")
    want = crawl.next_state(state, change.where("not (change = 'unchanged' and content_hash is null)"), gone, "2024-01-02")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
