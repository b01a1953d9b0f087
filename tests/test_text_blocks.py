"""Blocks made from texts in batches, and how an update deals out its documents."""

import pyarrow as pa
from pyspark.sql import functions as F

from docspark import kb
from docspark.operators import chunking, segments
from docspark.settings import DEFAULT


def test_a_range_in_several_batches_is_one_block():
    rows = [(0, 1, ["a", "b", "a"]), (0, 2, []), (0, 3, ["a"]), (3, 4, ["c"]), (3, 5, ["a", "c"]), (3, 6, ["c", "c", "c"]), (7, 7, []), (9, 8, ["b"])]
    want = {("a", 0): ([(1, 2, 3), (3, 1, 1)], 2, 1), ("b", 0): ([(1, 1, 3)], 1, 3), ("a", 3): ([(5, 1, 2)], 1, 2), ("c", 3): ([(4, 1, 1), (5, 1, 2), (6, 3, 3)], 3, 1), ("b", 9): ([(8, 1, 1)], 1, 1)}
    whole = pa.table({"range": pa.array([r[0] for r in rows], pa.int64()), "id": pa.array([r[1] for r in rows], pa.int64()), "tokens": pa.array([r[2] for r in rows], pa.list_(pa.string()))})
    for size in range(1, len(rows) + 1):
        got = [r for b in segments._blocks_by_range(iter(whole.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert len(got) == len(want)
        assert {(r["term"], r["range"]): ([tuple(e.values()) for e in r["entries"]], r["most_tf"], r["least_dl"]) for r in got} == want
    assert list(segments._blocks_by_range(iter([whole.slice(1, 1).to_batches()[0], whole.slice(0, 0).to_batches()[0] if whole.slice(0, 0).to_batches() else whole.slice(6, 1).to_batches()[0]]))) == []


def test_blocks_of_texts_equal_those_of_entries(spark):
    text = F.when(F.col("id") % 7 > 0, F.concat_ws(" ", F.lit("A a"), (F.col("id") % 5).cast("string"), F.lit("É\tb"), (F.col("id") % 3).cast("string"))).otherwise("")
    placed = spark.range(200).select((F.col("id") % 9).alias("range"), F.concat(F.lit("k"), F.col("id")).alias("id"), text.alias("text")).repartition(3, "range")
    words = placed.select("range", "id", segments.whitespace_tokens(F.col("text")).alias("tokens"))
    entries = words.select("range", "id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("range", "term", "id", "dl").agg(F.count(F.lit(1)).cast("int").alias("tf"))
    made = segments.Segments._text_blocks(placed)
    rows = lambda df: sorted(map(tuple, df.select("term", "range", "most_tf", "least_dl", F.sort_array("entries").cast("string")).collect()))
    assert rows(made) == rows(segments.Segments._blocks(entries))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan


def test_an_update_chunks_on_all_cores(spark, tmp_path, monkeypatch):
    seen = []
    chunk = chunking.chunk_documents
    monkeypatch.setattr(chunking, "chunk_documents", lambda docs, *a: seen.append(docs) or chunk(docs, *a))
    store = kb.Store(spark, f"file://{tmp_path}/kb", DEFAULT)
    docs = spark.range(40).selectExpr("cast(id as string) as document_id", "concat('https://x.org/', id) as url", "concat('t', id) as title", "'src' as source", "repeat(concat('Plain words of ', id, '. '), 30) as text", "'2024' as updated_at")
    store.update(docs.where("document_id % 2 = 0"))
    store.update(docs.where("document_id % 2 = 1"))
    for df in seen:  # of the second update too, whose pieces stand beside kept ones
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert store.versions.table("documents").count() == 40
