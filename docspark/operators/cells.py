"""Approximate dense search: coarse cells, product codes of residuals, exact scores of survivors.

Cells are fitted by Spark's k-means over all vectors. What a vector differs from its cell's
centre by is kept as one byte for each of PARTS parts, by codebooks from a bounded sample
(SAMPLE rows, those of least hash); every vector is indexed. A question looks only into its
nearest cells: estimates from codes choose its survivors there, and inner products of the
vectors themselves rank them. Blocks of a cell and packs of its questions have a bounded
size, so no cell, however full, is one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARTS, ENTRIES, SAMPLE, SEED = 16, 256, 20_000, 7
#: Vectors of a block, and questions of a pack.
BLOCK_ROWS, PACK = 8192, 256


def codebooks(residuals: np.ndarray, parts: int, entries: int = ENTRIES, rounds: int = 8) -> np.ndarray:
    """``parts, entries, size``: k-means of each part of a sample, from evenly spaced rows."""
    rows = residuals.reshape(len(residuals), parts, -1)
    books = rows[np.linspace(0, len(rows) - 1, entries).astype(int)].transpose(1, 0, 2).copy()
    for p in range(parts):
        x = rows[:, p]
        for _ in range(rounds):
            code = _nearest(x, books[p])
            count = np.bincount(code, minlength=entries)
            for j in range(x.shape[1]):
                total = np.bincount(code, x[:, j], entries)
                books[p][count > 0, j] = total[count > 0] / count[count > 0]
    return books


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)


def encode(residuals: np.ndarray, books: np.ndarray) -> np.ndarray:
    rows = residuals.reshape(len(residuals), len(books), -1)
    return np.stack([_nearest(rows[:, p], books[p]) for p in range(len(books))], 1).astype(np.uint8)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


@dataclass(frozen=True)
class CellIndex:
    """``blocks``: ``cell, ids, codes`` of some vectors of a cell together; ``centres`` and ``books`` have a fixed size."""

    rows: DataFrame
    blocks: DataFrame
    centres: np.ndarray
    books: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, key: str, vector: str, cells: int | None = None, where: Column | None = None) -> CellIndex:
        """Index all vectors (not null, of one length that PARTS or its half divides, else coded whole); keys are distinct longs.

        With ``where`` only its rows are there to be found: a filter goes before any probe.
        """
        rows = vectors if where is None else vectors.where(where)
        rows = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        n = rows.count()
        if not n:
            return cls(rows, vectors.sparkSession.createDataFrame([], "cell int, ids binary, codes binary"), np.empty((0, 0)), np.empty((0, 0, 0)))
        k = min(n, cells or max(2, min(4096, round(math.sqrt(n) / 2))))
        if k > 1:
            model = KMeans(k=k, maxIter=10, seed=SEED, featuresCol="x").fit(rows.select(array_to_vector("v").alias("x")))
            centres = np.array(model.clusterCenters())
        else:  # one cell around the least id's vector: any centre serves
            centres = np.array([rows.orderBy("id").select("v").first()["v"]])
        length = centres.shape[1]
        parts = next(p for p in (PARTS, PARTS // 2, PARTS // 4, 1) if length % p == 0)
        sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(SAMPLE, (1 << 21) // length))).select("v").collect()])
        books = codebooks(sample - centres[_nearest(sample, centres)], parts)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(1))
                    cell = _nearest(x, centres)
                    codes = encode(x - centres[cell], books)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["cell", "id", "code"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple[int, bytes]]] = {}

            def block(cell: int) -> pa.RecordBatch:
                own = held.pop(cell)
                ids = np.array([i for i, _ in own], "<i8").tobytes()
                return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([ids], pa.binary()), pa.array([b"".join(c for _, c in own)], pa.binary())], ["cell", "ids", "codes"])

            for batch in batches:
                for cell, i, code in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                    for full in [c for c in held if c != cell]:  # rows come by cell
                        yield block(full)
                    held.setdefault(cell, []).append((i, code))
                    if len(held[cell]) >= BLOCK_ROWS:
                        yield block(cell)
            for cell in list(held):
                yield block(cell)

        coded = rows.mapInArrow(place, "cell int, id long, code binary")
        ordered = coded.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
        return cls(rows, ordered.mapInArrow(pack, "cell int, ids binary, codes binary"), centres, books)

    def search(self, queries: DataFrame, k: int, probes: int, survivors: int) -> DataFrame:
        """``query, id, score, rank`` (from 0) of the ``k`` nearest found for each of ``queries`` (``query, v``).

        Each looks into ``probes`` cells; its best ``survivors`` by estimate are scored exactly.
        Equal scores stand by id.
        """
        centres, books = self.centres, self.books
        probes = min(probes, len(centres))

        def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and probes:
                    x = _matrix(batch.column(1))
                    near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                    at = np.repeat(np.arange(batch.num_rows), probes)
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), batch.column(0).take(pa.array(at)), pa.array([x[i].tobytes() for i in at.tolist()], pa.binary())], ["cell", "query", "v"])

        asked = queries.select(F.col("query").cast("long").alias("query"), F.col("v").cast("array<double>").alias("v"))
        aimed = asked.mapInArrow(aim, "cell int, query long, v binary")
        packs = aimed.groupBy("cell", F.pmod(F.xxhash64("query"), F.lit(max(1, queries.count() // PACK))).alias("pack")).agg(F.collect_list(F.struct("query", "v")).alias("asked"))

        def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cell, ids, codes, asked in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                    ids, codes = np.frombuffer(ids, "<i8"), np.frombuffer(codes, np.uint8).reshape(-1, len(books))
                    out_q, out_i, out_s = [], [], []
                    for one in asked:
                        q = np.frombuffer(one["v"])
                        table = np.einsum("pes,ps->pe", books, q.reshape(len(books), -1))
                        score = q @ centres[cell] + table[np.arange(len(books)), codes].sum(1)
                        best = np.argpartition(-score, survivors)[:survivors] if len(score) > survivors else np.arange(len(score))
                        out_q.append(np.full(len(best), one["query"])), out_i.append(ids[best]), out_s.append(score[best])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_i, out_s)], ["query", "id", "estimate"])

        met = self.blocks.join(packs, "cell").select("cell", "ids", "codes", "asked").mapInArrow(estimate, "query long, id long, estimate double")
        best = W.partitionBy("query").orderBy(F.desc("estimate"), "id")
        kept = met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= survivors).select("query", "id")
        full = kept.join(self.rows, "id").withColumnRenamed("v", "w").join(asked, "query")
        exact = full.select("query", "id", F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("score"))
        rank = W.partitionBy("query").orderBy(F.desc("score"), "id")
        return exact.withColumn("rank", F.row_number().over(rank) - 1).where(F.col("rank") < k)


def recall(found: DataFrame, want: DataFrame) -> float:
    """The share of ``want`` (``query, id``) that stands in ``found``."""
    both = want.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    hit, n = both.agg(F.count("hit"), F.count(F.lit(1))).first()
    return hit / n if n else 1.0
