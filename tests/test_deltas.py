"""Counts under deltas, and answers joined with feedback over several batches."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docspark.operators import counts
from docspark.sources.versions import Versions
from docspark.streaming import joined


def test_counts_follow_every_delta(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(counts, "FOLD", 3)
    versions = Versions(spark, f"file://{tmp_path}/kb")
    kept = counts.Kept(versions, "counts", ["source", "h"])
    live: dict = {}
    schema = "k long, source string, h string"
    steps = [
        ([(i, "ab"[i % 2], f"t{i % 7}") for i in range(40)], []),
        ([(i, "c", f"t{i % 3}") for i in range(5, 15)], [1, 2, 99]),
        ([(50, None, "t0"), (51, None, None)], [50]),
        ([(i, "a", "t1") for i in range(30, 45)], list(range(20, 25))),
        ([], list(range(5, 15))),
        ([(1, "b", "t9")], []),
    ]
    for fresh, gone in steps:
        old = spark.createDataFrame([(k, *v) for k, v in live.items()], schema)
        change = counts.images(old, spark.createDataFrame(fresh, schema), spark.createDataFrame([(k,) for k in gone], "k long"), "k")
        kept.apply(change)
        live.update({k: (s, h) for k, s, h in fresh})
        for k in gone:
            live.pop(k, None)
        want: dict = {}
        for s, h in live.values():
            want.setdefault(s, []).append(h)
        got = {r.source: (r.n, r.members) for r in kept.counts(["source"]).collect()}
        assert got == {s: (len(h), len(set(h))) for s, h in want.items()}
        assert sum(r.n for r in kept.counts([]).collect()) == len(live)
    assert len(versions.manifest()["tables"]) <= 3
    # an update reads its images alone, no kept table
    plan = kept._sum(change, "sign")._jdf.queryExecution().executedPlan().toString()
    assert "counts-" not in plan


def test_feedback_joins_answers_of_several_batches(spark, tmp_path):
    a, f, log, point = (f"file://{tmp_path}/{n}" for n in ("a", "f", "log", "cp"))
    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)

    def come(answers, feedback):
        for rows, schema, at in ((answers, joined.ANSWERS, a), (feedback, joined.FEEDBACK, f)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
        joined.follow(spark, a, f, log, point)

    come([("1", "q", "high", t(0)), ("2", "q", "low", t(0.5)), ("3", "q", "low", t(1)), ("1", "q", "high", t(0))], [("1", "UP", t(0.2)), ("1", "UP", t(0.2))])
    come([("4", "q", "none", t(2)), ("3", "q", "low", t(1))], [("2", "down", t(0.9)), ("3", "up", t(2.5)), ("9", "up", t(2))])  # 3: too late for its answer
    come([("5", "q", "low", t(30))], [("5", "up", t(30.5)), ("4", "down", t(2.5))])  # 4's feedback is behind no watermark yet
    come([("0", "end", "x", t(99))], [("0", "end", t(99))])
    come([("0", "end", "x", t(199))], [("0", "end", t(199))])
    got = sorted((r.request_id, r.verdict) for r in spark.read.parquet(log).where("question <> 'end'").collect())
    assert got == [("1", "up"), ("2", "down"), ("3", None), ("4", "down"), ("5", "up")]
    assert {(r.confidence, r.verdict): r.n for r in joined.verdicts(spark.read.parquet(log).where("question <> 'end'")).collect()} == {("high", "up"): 1, ("low", "down"): 1, ("low", "none"): 1, ("none", "down"): 1, ("low", "up"): 1}
    assert spark.read.parquet(log).where(F.col("request_id") == "1").count() == 1
