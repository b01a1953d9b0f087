"""Near-duplicate vectors by an epsilon grid order join (Böhm et al., 2001) on unit vectors.

Cosine t of unit vectors is distance sqrt(2 - 2 t), here EPS. So:

1. Equal vectors are one node with a weight. Nodes are projected on their AXES leading
   principal axes; what is left of the length is one more coordinate, so that distances of
   the projections are never greater than those of the vectors.
2. Nodes are sorted by the grid cells (of side EPS) of these coordinates, in ranges, and the
   sequence is cut into tiles of bounded bytes, each with the box that holds it.
3. Intervals of the sequence are joined recursively: of two intervals whose boxes are
   further apart than EPS no pair is looked at; of others the parts are joined. Down to tiles
   this is a join of light rows, a level at a time; then a task has two tiles and goes on
   inside them, down to blocks of LEAF vectors, whose products decide.
4. No pair leaves its task: only a sum of links for each node and a forest of the links do.

What can't be skipped grows with the square of the vectors that lie near one another in the
leading coordinates; axes and tile sizes change the work, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm import scratch
from docspark.llm.codes import MOST_BROADCAST, usable, usual_length
from docspark.llm.graph import components, forest

#: Principal axes of the boxes, and the components that they are taken from (the first ones of longer vectors).
AXES, FITTED = 16, 256
#: Bytes of a tile's vectors, at least and at most; between, a sixteenth of all.
SMALL_TILE, LARGE_TILE = 1 << 18, 1 << 23
#: Vectors of a block whose products are taken at once.
LEAF = 512
#: Links of a task that are replaced by a forest at a time.
LINKS = 1 << 20
#: Intervals that an interval of the next level holds, as a power of two.
FAN = 4


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1 in doubles; they are scaled by their greatest component first, so that no square overflows or vanishes."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def coordinates(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The projection of unit rows on the axes, and the length of the rest."""
    p = x @ axes
    return np.column_stack([p, np.sqrt(np.maximum(0, 1 - (p * p).sum(1)))])


def apart(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> float:
    """The squared distance of two boxes."""
    gap = np.maximum(0, np.maximum(lo_b - hi_a, lo_a - hi_b))
    return float((gap * gap).sum())


def _apart(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    gaps = F.zip_with(F.zip_with(lo_b, hi_a, lambda x, y: x - y), F.zip_with(lo_a, hi_b, lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)


def principal(nodes: DataFrame, length: int) -> np.ndarray:
    """The leading principal axes of all unit vectors, as columns; they have no part in components beyond FITTED."""
    d = min(length, FITTED)
    upper = np.triu_indices(d)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = unit(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))[:, :d]
                total += x.T @ x
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(total[upper])], ["at", "n"])

    rows = nodes.select("v").mapInArrow(products, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros((d, d))
    both[upper[0][rows["at"]], upper[1][rows["at"]]] = rows["n"]
    _, vectors = np.linalg.eigh(both + np.triu(both, 1).T)
    axes = np.zeros((length, min(AXES, d)))
    axes[:d] = vectors[:, ::-1][:, : axes.shape[1]]
    return axes


def tiles(nodes: DataFrame, axes: np.ndarray, eps: float, width: int, bytes_of_all: int) -> DataFrame:
    """``tile, at, node, weight, v, lo, hi``: the sequence in grid order, cut into tiles; ``at`` follows the sequence."""
    most = min(max(bytes_of_all // 16, SMALL_TILE), LARGE_TILE)
    rows = max(LEAF, most // (width * axes.shape[0]))
    parts = max(1, math.ceil(bytes_of_all / most))
    dtype = np.float32 if width == 4 else np.float64

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                raw = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                p = coordinates(unit(raw), axes)
                cells = np.floor(p / eps).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, cells.shape[1]), pa.int32()), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in raw.astype(dtype)], pa.binary()), lists, pa.array(p[:, 0])], ["node", "weight", "v", "cells", "first"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tile(part: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            raw = b"".join(r[2] for r in part)
            p = coordinates(unit(np.frombuffer(raw, dtype).reshape(len(part), -1)), axes)
            numbers = [pa.array([np.array([r[i] for r in part], "<i8").tobytes()], pa.binary()) for i in (0, 1)]
            boxes = [pa.array([b.tolist()], pa.list_(pa.float64())) for b in (p.min(0), p.max(0))]
            return pa.RecordBatch.from_arrays([*numbers, pa.array([raw], pa.binary()), *boxes], ["node", "weight", "v", "lo", "hi"])

        held: list[tuple[int, int, bytes]] = []
        for batch in batches:
            held.extend(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            while len(held) >= 2 * rows:  # a rest of one tile or two stays
                yield tile(held[:rows])
                held = held[rows:]
        if len(held) > rows:
            yield tile(held[: len(held) // 2])
            held = held[len(held) // 2 :]
        if held:
            yield tile(held)

    placed = nodes.select("node", "weight", "v").mapInArrow(place, "node long, weight long, v binary, cells array<int>, first double")
    ordered = placed.repartitionByRange(parts, "cells", "first", "node").sortWithinPartitions("cells", "first", "node").select("node", "weight", "v")
    made = ordered.mapInArrow(cut, "node binary, weight binary, v binary, lo array<double>, hi array<double>")
    # the upper bits of the number are the range's
    return scratch.written(made.withColumn("tile", F.monotonically_increasing_id()).withColumn("at", F.shiftright("tile", 33)), "tiles")


def near_tiles(boxes: DataFrame, eps: float) -> DataFrame:
    """``a, b`` (``a <= b``) of the tiles whose boxes are within ``eps``, by joining intervals of the sequence level by level."""
    limit = eps * eps * (1 + 1e-9)
    axes = len(boxes.select("lo").first()[0])
    hull = [F.array(*[f(F.col(c)[i]) for i in range(axes)]).alias(c) for c, f in (("lo", F.min), ("hi", F.max))]
    top = boxes.agg(F.max("at")).first()[0]
    levels = [boxes.select(F.col("tile").alias("name"), F.col("at").alias("up"), "lo", "hi")]
    shift = 0
    while shift == 0 or top >> (shift - FAN):
        level = boxes.groupBy(F.shiftright("at", shift).alias("name")).agg(*hull)
        levels.append(scratch.written(level.withColumn("up", F.shiftright("name", FAN)), "boxes"))
        shift += FAN
    pairs = levels[-1].select(F.col("name").alias("a"), F.col("name").alias("b"))  # one interval holds all
    for below in reversed(levels[:-1]):
        left, right = (below.select(*[F.col(c).alias(f"{s}_{c}") for c in below.columns]) for s in "ab")
        both = pairs.join(left, F.col("a") == F.col("a_up")).join(right, F.col("b") == F.col("b_up")).where(F.col("a_name") <= F.col("b_name"))
        near = both.where(_apart(F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi")) <= limit)
        pairs = scratch.written(near.select(F.col("a_name").alias("a"), F.col("b_name").alias("b")), "near")
    return pairs


class Links:
    """Links between two tiles: their sums by node and a forest of them."""

    def __init__(self, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...] | None, axes: np.ndarray, threshold: float, eps: float):
        """``a`` and ``b`` are ``node, weight, raw vectors``; without ``b`` the tile is joined with itself."""
        self.same, self.threshold, self.limit = b is None, threshold, eps * eps * (1 + 1e-9)
        self.sides = []
        for node, weight, raw in (a,) if b is None else (a, b):
            x = unit(raw)
            self.sides.append((node, weight, x, x.astype(np.float32), coordinates(x, axes), np.zeros(len(node), np.int64)))
        self.slack = 1e-5 + 2.5e-7 * axes.shape[0]
        self.u, self.v, self.held = [], [], 0
        left, right = self.sides[0], self.sides[-1]
        self._join(0, len(left[0]), 0, len(right[0]))

    def _join(self, a0: int, a1: int, b0: int, b1: int) -> None:
        left, right = self.sides[0], self.sides[-1]
        if a0 >= a1 or b0 >= b1 or self.same and b1 <= a0:
            return
        p, q = left[4][a0:a1], right[4][b0:b1]
        if not (self.same and a0 == b0) and apart(p.min(0), p.max(0), q.min(0), q.max(0)) > self.limit:
            return
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            self._compare(a0, a1, b0, b1)
            return
        if self.same and a0 == b0 and a1 == b1:  # pairs of one interval: each is looked at once
            mid = (a0 + a1) // 2
            self._join(a0, mid, a0, mid)
            self._join(a0, mid, mid, a1)
            self._join(mid, a1, mid, a1)
        elif a1 - a0 >= b1 - b0:
            mid = (a0 + a1) // 2
            self._join(a0, mid, b0, b1)
            self._join(mid, a1, b0, b1)
        else:
            mid = (b0 + b1) // 2
            self._join(a0, a1, b0, mid)
            self._join(a0, a1, mid, b1)

    def _compare(self, a0: int, a1: int, b0: int, b1: int) -> None:
        left, right = self.sides[0], self.sides[-1]
        rough = left[3][a0:a1] @ right[3][b0:b1].T
        own = self.same and a0 == b0
        if own:
            rough[np.tril_indices(len(rough))] = -1
        if rough.max(initial=-1) < self.threshold - self.slack:
            return
        linked = left[2][a0:a1] @ right[2][b0:b1].T >= self.threshold
        if own:
            linked &= np.triu(np.ones(linked.shape, bool), 1)
        if not linked.any():
            return
        left[5][a0:a1] += linked @ right[1][b0:b1]
        right[5][b0:b1] += left[1][a0:a1] @ linked
        i, j = np.nonzero(linked)
        self.u.append(left[0][a0:a1][i])
        self.v.append(right[0][b0:b1][j])
        self.held += len(i)
        if self.held > LINKS:
            self._forest()

    def _forest(self) -> None:
        node, root = forest(np.concatenate(self.u), np.concatenate(self.v))
        some = node != root
        self.u, self.v, self.held = [node[some]], [root[some]], int(some.sum())

    def rows(self) -> pa.RecordBatch:
        """``u, v, links``: sums of links have no ``v``, links of the forest no ``links``."""
        nodes = np.concatenate([s[0][s[5] > 0] for s in self.sides])
        sums = np.concatenate([s[5][s[5] > 0] for s in self.sides])
        if self.held:
            self._forest()
        u, v = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (self.u, self.v))
        none = lambda n: pa.nulls(n, pa.int64())
        columns = [pa.array(np.concatenate([nodes, u])), pa.concat_arrays([none(len(nodes)), pa.array(v)]), pa.concat_arrays([pa.array(sums), none(len(u))])]
        return pa.RecordBatch.from_arrays(columns, ["u", "v", "links"])


def links(cut: DataFrame, pairs: DataFrame, axes: np.ndarray, threshold: float, eps: float, width: int) -> DataFrame:
    """Sums of links and forests (as in ``Links.rows``) of all pairs of near tiles."""
    dtype = np.float32 if width == 4 else np.float64

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(batch: pa.RecordBatch, row: int, at: int) -> tuple[np.ndarray, ...]:
            node, weight, raw = (batch.column(at + i)[row].as_py() for i in range(3))
            return np.frombuffer(node, "<i8"), np.frombuffer(weight, "<i8"), np.frombuffer(raw, dtype).reshape(len(node) // 8, -1)

        for batch in batches:
            for row in range(batch.num_rows):
                b = side(batch, row, 5) if batch.column(0)[row].as_py() != batch.column(1)[row].as_py() else None
                yield Links(side(batch, row, 2), b, axes, threshold, eps).rows()

    left = cut.select(F.col("tile").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("node", "weight", "v")])
    right = cut.select(F.col("tile").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("node", "weight", "v")])
    return pairs.join(left, "a").join(right, "b").select("a", "b", *left.columns[1:], *right.columns[1:]).mapInArrow(compare, "u long, v long, links long")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, n_links, component_id, kept``, a row for each vector.

    Vectors are linked if their cosine, in doubles, is ``threshold`` or more (above 0);
    ``n_links`` counts the other rows that a row is linked with, ``component_id`` is the least
    id that its links reach. Vectors that are null, empty or all zero, hold nulls or numbers
    that aren't finite, or have another length than the most frequent one, are linked with
    nothing. Rows with equal vectors are linked, repeated rows too; a null id comes after all
    others. Other columns are ignored, and an empty table gives an empty result.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    eps = math.sqrt(2 - 2 * threshold) + 1e-7
    given = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    fit = usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    length = usual_length(given.where(fit), "v")
    if length is None:
        return given.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    width = 4 if given.schema["v"].dataType.elementType.typeName() == "float" else 8
    # equal vectors are told by 128 bits
    fit &= F.size("v") == length
    names = [F.when(fit, F.xxhash64(F.lit(k), "v")).alias(f"h{k}") for k in (1, 2)]
    named = given.select("id", "v", *names)
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id"))
    nodes = named.where("h1 is not null").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("weight"), least.alias("least"))
    nodes = scratch.written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    axes = principal(nodes, length)
    cut = tiles(nodes, axes, eps, width, nodes.count() * length * width)
    pairs = near_tiles(cut.select("tile", "at", "lo", "hi"), eps)
    found = scratch.written(links(cut, pairs, axes, threshold, eps, width), "links")
    scratch.release(cut)

    sums = found.where("links is not null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    parts = components(found.where("v is not null").select("u", "v"))
    of_parts = parts.join(nodes.select("node", "least"), "node")
    heads = scratch.written(of_parts.groupBy("component").agg(F.min("least").alias("head")), "components")
    linked = of_parts.join(F.broadcast(heads) if 32 * heads.count() <= MOST_BROADCAST else heads, "component").select("node", "head")
    per_node = nodes.select("node", "h1", "h2", "weight", "least").join(sums, "node", "left").join(linked, "node", "left")
    n = F.coalesce("links", F.lit(0).cast("long")) + F.col("weight") - 1
    # a table of its own, so that the join's hot names (copies) can be split
    per_node = scratch.written(per_node.select("h1", "h2", n.alias("n"), F.coalesce("head", "least")["id"].alias("head")), "heads")
    out = named.select("id", "h1", "h2").join(per_node, ["h1", "h2"], "left")
    component = F.when(F.col("n").isNotNull(), F.col("head")).otherwise(F.col("id"))
    return out.select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
