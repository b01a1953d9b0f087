"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact check.

1. Every text becomes its set of word shingles, a signature of HASHES minima and BANDS
   band keys. Equal sets are one node from here on, so exact copies cost nothing further.
2. In each band bucket all nodes are paired with up to three pivots: the least name, the
   greatest and the least by another hash (sums that are combined before the shuffle).
3. A pair's signatures are compared BATCH values at a time. With a uniform prior the
   similarity has a beta posterior; a pair is dropped as soon as the chance that it reaches
   the threshold is below MISS. Survivors are checked on their full sets, and links are
   contracted to components.
4. A bucket whose nodes then lie in one component, or were all paired, is done. In the others
   the nodes outside the largest component are compared with all nodes, tile by tile, in the
   same way: sizes, signatures batch by batch, then full sets. Tiles have a bounded weight, a
   pair is looked at in the first band that it shares alone, and no pair leaves its task: one
   link for each node and component does. So no link between components is lost.

With 32 bands of 4 the chance that a pair at similarity 0.8 shares no bucket is 5e-8.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from docspark.llm import graph, scratch
from docspark.llm.words import mix, shingle_sets, slices

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 32
#: The chance, at any one look, of dropping a pair whose similarity reaches the threshold.
MISS = 1e-7
#: Weight of a tile's nodes and of the tiles that a task gets together, in shingles (8 bytes each).
TILE, TASK = 1 << 18, 1 << 19
#: Pairs of a tile that are compared at a time.
PAIRS = 1 << 18
#: Ids of candidate documents (8 bytes each) are broadcast up to this many bytes; beyond, they are joined by a shuffle.
MOST_BROADCAST = 8 << 20

_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_A = (_SEEDS[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_SEEDS[HASHES:] >> np.uint64(32)).astype(np.uint32)


def minima(sets: np.ndarray) -> np.ndarray:
    """The HASHES minima of one non-empty set of 64-bit shingles."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(low, (x[i : i + 512, None] * _A + _B).min(0), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low.reshape(BANDS, ROWS)[:, r])
    return key.view(np.int64)


def node_of(s: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets have equal names."""
    if not len(s):
        return 0
    both = np.bitwise_xor.reduce(mix(s)) ^ mix(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
    return int(mix(np.array([both]) + np.uint64(len(s)))[0].view(np.int64))


def least_matches(compared: int, threshold: float, miss: float = MISS) -> int:
    """The fewest matches among ``compared`` values that leave P(similarity >= threshold) at ``miss`` or more.

    With a uniform prior the posterior is Beta(m + 1, compared - m + 1), whose upper tail at
    t is the chance of at most m successes in compared + 1 trials of probability t.
    """
    n, tail = compared + 1, 0.0
    for m in range(compared + 1):
        tail += math.comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if tail >= miss:
            return m
    return compared


def signatures(docs: DataFrame, key: str, text: str, width: int, tie: str | None = None) -> DataFrame:
    """``id, tie, n, node, signature, bands`` of every document; ``n`` is the size of its set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, sig, band = [], [], [], []
            for s in (s for part in slices(batch.column(1)) for s in shingle_sets(part, width)):
                n.append(len(s))
                node.append(node_of(s))
                low = minima(s).astype("<u2") if len(s) else None  # bands are those of the shortened values
                sig.append(None if low is None else low.tobytes())
                band.append(None if low is None else bands(low))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary()), pa.array(band, pa.list_(pa.int64()))], ["id", "tie", "n", "node", "signature", "bands"])

    by = F.col(tie) if tie else F.lit(None)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), by.cast("string").alias("tie"))
    return rows.mapInArrow(sign, "id long, tie string, n long, node long, signature binary, bands array<long>")


def plausible(a: Column, b: Column, threshold: float) -> Column:
    """Whether two signatures survive the sequential test."""
    least = [least_matches(k, threshold) for k in range(BATCH, HASHES + 1, BATCH)]

    @pandas_udf("boolean")
    def test(x: pd.Series, y: pd.Series) -> pd.Series:
        alive = np.ones(len(x), bool)
        if len(x):
            u, v = (np.frombuffer(b"".join(s), "<u2").reshape(-1, HASHES) for s in (x, y))
            count = np.zeros(len(x), np.int64)
            for k, need in enumerate(least):
                at = np.flatnonzero(alive)
                count[at] += (u[at, k * BATCH : (k + 1) * BATCH] == v[at, k * BATCH : (k + 1) * BATCH]).sum(1)
                alive[at] = count[at] >= need
        return pd.Series(alive)

    return test(a, b)


def first_band(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first band in which pairs of signatures agree; BANDS where none does."""
    same = (x == y).reshape(-1, BANDS, ROWS).all(2)
    return np.where(same.any(1), same.argmax(1), BANDS)


def tile_links(rows: pa.Table, threshold: float, percent: int) -> pa.Table:
    """Links ``u, v`` of the tiles of a task: one at most for each left node and component of right nodes."""
    least = [least_matches(k, threshold) for k in range(BATCH, HASHES + 1, BATCH)]
    rows = rows.sort_by([(c, "ascending") for c in ("band", "i", "j", "is_left", "node")]).combine_chunks()
    band, at, i, j, is_left, outside, node, component, n = (rows.column(c).to_numpy() for c in ("band", "at", "i", "j", "is_left", "outside", "node", "component", "n"))
    sig = np.frombuffer(b"".join(rows.column("signature").to_pylist()), "<u2").reshape(-1, HASHES)
    sets = rows.column("shingles").combine_chunks()
    sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
    flat, ends = sets.flatten().to_numpy(), np.cumsum(n)
    own = lambda k: flat[ends[k] - n[k] : ends[k]]
    new = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]]))
    us, vs = [], []
    for a, b in zip(new[:-1].tolist(), new[1:].tolist(), strict=True):
        m = a + int(b - a - is_left[a:b].sum())  # right nodes come first; in a bucket of one tile the left ones are among them
        left = np.arange(m, b) if m < b else a + np.flatnonzero(outside[a:b])
        mark: np.ndarray | None = None
        step = max(1, PAIRS // max(m - a, 1))
        for c in range(0, len(left), step):
            x = np.repeat(left[c : c + step], m - a)
            y = np.tile(np.arange(a, m), len(x) // max(m - a, 1))
            # the sizes alone bound the similarity from above; of two left nodes in one tile, one looks
            ok = (component[x] != component[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & ~((m == b) & outside[y] & (y < x))
            x, y = x[ok], y[ok]
            count = np.zeros(len(x), np.int64)
            for k, need in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                count += (sig[x, part] == sig[y, part]).sum(1)
                keep = count >= need
                x, y, count = x[keep], y[keep], count[keep]
            keep = first_band(sig[x], sig[y]) == at[x]
            x, y, count = x[keep], y[keep], count[keep]
            order = np.lexsort((-count, x))
            x, y = x[order], y[order]
            bounds = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.empty(0, np.int64)
            for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                k, near = int(x[p]), y[p:q]
                if q - p <= 8:
                    shared = np.array([np.isin(own(k), own(r), assume_unique=True).sum() for r in near.tolist()])
                else:  # many: count on all right nodes of the tile at once
                    if mark is None:
                        code = np.unique(flat[ends[a] - n[a] : ends[b - 1]], return_inverse=True)[1]
                        mark, base = np.zeros(int(code.max()) + 1, np.int32), int(ends[a] - n[a])
                    mine = code[ends[k] - n[k] - base : ends[k] - base]
                    mark[mine] = 1
                    shared = np.add.reduceat(mark[code[: ends[m - 1] - base]], ends[a:m] - n[a:m] - base)[near - a]
                    mark[mine] = 0
                near = near[100 * shared >= percent * (n[near] + n[k] - shared)]
                _, one = np.unique(component[near], return_index=True)
                us.extend([node[k]] * len(one))
                vs.extend(node[near[one]])
    u, v = np.array(us, np.int64), np.array(vs, np.int64)
    return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})


def tiles(open_rows: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Links ``u, v`` between components in open buckets (``band, at, node, component, n, signature, shingles``).

    The nodes outside a bucket's largest component (left) meet all its nodes (right). Both
    sides are dealt into tiles of about TILE, and a task gets pairs of tiles of TASK or so
    together, whatever the bucket's size. Nodes of a bucket of one tile are sent once.
    """
    weight = F.col("n") + HASHES // 4
    shares = open_rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("k"), F.sum(weight).alias("w"))
    bulk = shares.groupBy("band").agg(F.max(F.struct("k", "component", "w")).alias("top"), F.sum("w").alias("all"))
    outer = F.col("all") - F.col("top.w")
    bulk = scratch.written(bulk.select("band", F.col("top.component").alias("largest"), outer.alias("outer"), "all", F.ceil(outer / TILE).cast("int").alias("lefts"), F.ceil(F.col("all") / TILE).cast("int").alias("rights")), "bulk")
    # the number of tasks follows from a sum over the buckets alone
    total = bulk.agg(F.sum(F.when(F.col("rights") == 1, F.col("all")).otherwise(F.col("outer") * F.col("rights") + F.col("all") * F.col("lefts")))).first()[0] or 0
    tasks = max(1, math.ceil(total / TASK))
    cut = open_rows.join(bulk.drop("outer", "all"), "band").withColumns({"h": F.xxhash64("node", "band"), "outside": F.col("component") != F.col("largest")})
    # a right row goes to each tile of left rows, a left row to each tile of right rows
    sides = F.array(F.lit(False), F.col("outside") & (F.col("rights") > 1))
    spread = cut.select("*", F.explode(F.array_distinct(sides)).alias("is_left")).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("is_left"), F.col("rights")).otherwise(F.col("lefts")) - 1)))
    i = F.when(F.col("is_left"), F.pmod("h", "lefts").cast("int")).otherwise(F.col("other"))
    j = F.when(F.col("is_left"), F.col("other")).otherwise(F.pmod("h", "rights").cast("int"))
    dealt = spread.select("band", "at", i.alias("i"), j.alias("j"), "is_left", "outside", "node", "component", "n", "signature", "shingles")

    def compare(rows: pa.Table) -> pa.Table:
        return tile_links(rows, threshold, percent)

    # pairs of tiles are dealt by hash before they are grouped, so that a task is a group
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("band", "i", "j"), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(compare, "u long, v long").distinct()


class Verifier:
    """Exact links among pairs of nodes, from the sets of the documents' whole texts."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, key: str, text: str, width: int, percent: int):
        self.docs, self.nodes, self.key, self.text, self.width, self.percent = docs, nodes, key, text, width, percent

    def sets(self, wanted: DataFrame) -> DataFrame:
        """``node, shingles`` of every wanted ``node`` (distinct), each read from one of its documents."""
        ids = scratch.written(self.nodes.join(wanted, "node", "left_semi").select("node", "least.id"), "wanted")
        small = 8 * ids.count() <= MOST_BROADCAST
        width = self.width

        def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch.column(0)):
                    own = shingle_sets(part, width)
                    yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in own], pa.int64()), pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))], ["node", "shingles"])

        rows = self.docs.select(F.col(self.key).cast("long").alias("id"), F.col(self.text).alias("text"))
        distinct = ids.select("id").distinct()
        rows = rows.join(F.broadcast(distinct) if small else distinct, rows["id"].eqNullSafe(distinct["id"]), "left_semi")
        found = rows.select("text").mapInArrow(shingle, "node long, shingles array<long>")
        # repeated ids may bring other nodes, or one node twice
        own = ids.select("node")
        return scratch.written(found.join(F.broadcast(own) if small else own, "node", "left_semi").dropDuplicates(["node"]), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``u, v`` (a written table) whose sets are similar enough."""
        sets = self.sets(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        left = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
        both = left.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
        shared = F.size(F.array_intersect("a", "b"))
        union = F.size("a") + F.size("b") - F.col("shared")
        return both.withColumn("shared", shared).where(100 * F.col("shared") >= self.percent * union).select("u", "v")


def _placed(members: DataFrame, parts: DataFrame) -> DataFrame:
    return members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, tie: str | None = None) -> DataFrame:
    """``id, tie, n_shingles, component_id, kept``, a row for each document.

    Documents whose sets share at least ``percent`` hundredths of their union are linked;
    ``component_id`` is the least id reachable. Null and empty texts, and texts without
    words, have no shingles and are linked with nothing. Copies of a text, repeated rows
    too, are one node; a null id comes after all others and stays null in the result.
    With ``tie`` (a column) only the rows of the least id that also have the least tie are
    kept. An empty table gives an empty result; other columns are ignored.
    """
    threshold = percent / 100
    rows = scratch.written(signatures(docs, key, text, width, tie), "signatures")
    # nulls last: a struct compares its fields in order
    name = F.struct(F.col("id").isNull().alias("none"), "id", "tie")
    nodes = scratch.written(rows.where("n > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "signature", "bands")], F.min(name).alias("least")), "nodes")
    exact = Verifier(docs, nodes, key, text, width, percent)

    in_bands = nodes.select("node", F.posexplode("bands").alias("at", "band"))
    third = F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"]
    pivots = in_bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("top"), third.alias("third"), F.count(F.lit(1)).alias("k")).where("low <> top")
    members = scratch.written(in_bands.join(scratch.written(pivots, "pivots"), "band"), "members")
    pairs = members.select("node", F.explode(F.array("low", "top", "third")).alias("p")).where("node <> p").select(F.least("node", "p").alias("u"), F.greatest("node", "p").alias("v")).distinct()
    side = nodes.select("node", "n", "signature")
    links = scratch.written(exact.links(scratch.written(_plausible_pairs(pairs, side, threshold), "pairs")), "links")
    parts = graph.components(links)

    # a bucket is done if all its pairs hold a pivot
    rest = F.col("k") - F.when((F.col("third") == F.col("low")) | (F.col("third") == F.col("top")), 2).otherwise(3)
    placed = scratch.written(_placed(members.where(rest >= 2).select("band", "at", "node"), parts), "placed")
    split = placed.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("band")
    split = scratch.written(split, "split")
    open_rows = scratch.written(placed.join(F.broadcast(split) if 8 * split.count() <= MOST_BROADCAST else split, "band", "left_semi"), "open")
    if not open_rows.isEmpty():
        sets = exact.sets(open_rows.select("node").distinct())
        full = scratch.written(tiles(open_rows.join(side, "node").join(sets, "node"), threshold, percent), "links")
        parts = graph.components(links.unionByName(full))

    of_parts = parts.join(nodes.select("node", "least"), "node")
    heads = of_parts.groupBy("component").agg(F.min("least").alias("head"))
    linked = of_parts.join(heads, "component").select("node", "head")
    # a table of its own, so that the join's hot nodes (copies) can be split
    head = scratch.written(nodes.select("node", "least").join(linked, "node", "left").select("node", F.coalesce("head", "least").alias("head")), "heads")
    found = rows.select("id", "tie", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(head, "node", "left")
    kept = (F.col("n") == 0) | (F.col("id").eqNullSafe(F.col("head.id")) & F.col("tie").eqNullSafe(F.col("head.tie")))
    return found.select("id", "tie", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("head.id")).otherwise(F.col("id")).alias("component_id"), kept.alias("kept"))


def _plausible_pairs(pairs: DataFrame, side: DataFrame, threshold: float) -> DataFrame:
    """The pairs that survive the size bound and the sequential test of their signatures."""
    both = pairs.join(side.toDF("v", "m", "y"), "v").join(side.toDF("u", "n", "x"), "u")
    both = both.where(F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9)
    return both.where(plausible(F.col("x"), F.col("y"), threshold)).select("u", "v")
