"""Cells and codes: recall against all vectors, filters before the probe, small and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.operators import cells


def brute(df, k, where="true"):
    rows = df.where(where).collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    out = []
    for r in df.where("vec_id % 20 = 0").collect():
        order = np.lexsort((ids, -(x @ np.array(r.embedding, float))))[:k]
        out += [(r.vec_id, int(i)) for i in ids[order]]
    return out


def asked(df):
    return df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))


def test_recall_of_every_twentieth_vector(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = cells.CellIndex.build(df, "vec_id", "embedding")
    got = index.search(asked(df), 10, -(-len(index.centres) * 7 // 10), 100).cache()
    want = spark.createDataFrame(brute(df, 10), "query long, id long")
    assert got.groupBy("query").count().where("count <> 10").count() == 0
    assert cells.recall(got, want) >= 0.9
    # every vector is indexed once
    ids = np.concatenate([np.frombuffer(r.ids, "<i8") for r in index.blocks.collect()])
    assert sorted(ids.tolist()) == list(range(2000))


def test_all_cells_and_survivors_are_exact(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 7)
    monkeypatch.setattr(cells, "PACK", 3)
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = cells.CellIndex.build(df, "vec_id", "embedding", where=F.col("label") == 3)
    got = index.search(asked(df), 5, 10**6, 10**6).collect()
    want = brute(df, 5, "label = 3")
    assert sorted((r.query, r["rank"], r.id) for r in got) == sorted((q, i % 5, v) for i, (q, v) in enumerate(want))


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    df = spark.createDataFrame([(i, [float(i), 1.0, 0.0]) for i in range(n)], "vec_id long, embedding array<double>")
    index = cells.CellIndex.build(df, "vec_id", "embedding")
    got = index.search(asked(df), 2, 1000, 1000).collect()
    assert [(r.query, r.id) for r in sorted(got, key=lambda r: r["rank"])] == ([] if n == 0 else [(0, i) for i in range(min(n, 2))])
