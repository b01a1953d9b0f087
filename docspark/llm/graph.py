"""Connected components: local forests, then alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm import scratch

#: Edges that one task replaces by a forest (16 bytes each).
TASK_EDGES = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges and the least node that each reaches over them."""
    names, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = codes[: len(u)], codes[len(u) :]
    root = np.arange(len(names))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:  # every node points at its root
            up = root[root]
            if (up == root).all():
                break
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return names, names[root]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if both:
        node, root = forest(np.concatenate([x for x, _ in both]), np.concatenate([x for _, x in both]))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["u", "v"])


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges ``u > v``. A node's neighbours never meet in one place: only their least does."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.unionByName(least.where("u > m").select("u", F.col("m").alias("v"))).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``u``, ``v``), itself the least node of its component included.

    Edges may repeat or point either way; loops only name their node. Tasks of TASK_EDGES
    edges replace theirs by a forest. The forests of several tasks are joined by star steps
    until the edges no longer change; every step is a written table, so lineage stays short.
    """
    edges = scratch.written(edges.select("u", "v"), "edges")
    tasks = max(1, math.ceil(edges.count() / TASK_EDGES))
    found = scratch.written(edges.repartition(tasks).mapInArrow(_forests, "u long, v long"), "edges")
    if tasks > 1:
        now, state = scratch.written(found.where("u <> v").distinct(), "edges"), None
        while True:
            sums = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
            if sums == state or not sums[0]:
                break
            state, now = sums, scratch.written(_stars(now), "edges")
        roots = now.unionByName(now.select(F.col("v").alias("u"), "v"))
        alone = found.where("u = v").select("u", "v").join(now.select("u"), "u", "left_anti")
        found = roots.unionByName(alone).distinct()
    return found.toDF("node", "component")
