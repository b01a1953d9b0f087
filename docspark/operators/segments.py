"""A lexical index that grows by immutable segments: BM25 with deltas, tombstones and bounds of blocks.

A segment holds what one update added and took away:

* ``postings``: for each term and range of documents one row, the block of their entries, with
  the greatest tf and the least length in it; a file holds whole ranges by term, so that a
  term's blocks fill as many tasks and files as they need;
* ``docs``: the terms of each document, so that a later removal knows what to take back;
* ``gone``: ids that are dead in all older segments;
* ``terms``, ``stats``, ``hist``: what the update adds to document frequencies, to the number
  and length of documents, and to the number of terms of each frequency. They are sums, so the
  weights of the whole corpus follow from adding up all segments, and equal those of an index
  that is built anew.

An update tokenizes its own texts alone. When the newest segments are of like size they are
merged into one, dead entries left out, so there are about log(n) of them.

A search first reads only the bounds of the question's blocks. It scores the documents of
the best ranges, whose k-th score is a threshold, and then only the ranges whose bound
reaches it; all other blocks' entries aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.functions.text import whitespace_tokens
from docspark.operators.lexical import FLOOR, K1, B
from docspark.sources.shared import bound_batches, hinted
from docspark.sources.versions import Versions

TABLES = ("postings", "docs", "gone", "terms", "stats", "hist")
#: Documents of a range, about; a block has at most so many entries.
RANGE_DOCS = 32
#: Words of the documents whose postings one task makes, about.
TASK_WORDS = 2 << 20
#: Segments of like size (each at most FACTOR times all newer ones together) that are merged.
MERGE, FACTOR = 4, 4
#: Ranges, or dead documents, that are broadcast at most (bytes, 24 for each); more are joined by a shuffle.
MOST_BROADCAST = 8 << 20


def _name(seq: int, table: str) -> str:
    return f"lexical-{seq:08d}-{table}"


def _weight(n: Column | float, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def _sums(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.sum(value).alias(value)).where(F.col(value) != 0)


def _blocks_of(rows: pa.Table) -> pa.RecordBatch:
    """The blocks of whole ranges, from the tokens (``range, id, tokens``) of their documents."""
    rows = rows.combine_chunks()
    ranges, dl = rows["range"].to_numpy(), pc.list_value_length(rows["tokens"]).to_numpy().astype(np.int32)
    words = pc.list_flatten(rows["tokens"]).combine_chunks().dictionary_encode()
    at = pc.list_parent_indices(rows["tokens"]).to_numpy()
    # entries by term, then by row, and so by range
    keys, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(dl) + at, return_counts=True)
    code, row = np.divmod(keys, len(dl))
    tf = tf.astype(np.int32)
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(ranges[row]) != 0)]))
    entries = pa.StructArray.from_arrays([rows["id"].take(pa.array(row)).combine_chunks(), pa.array(tf), pa.array(dl[row])], ["id", "tf", "dl"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)).astype(np.int32)), entries)
    most, least = np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl[row], starts)
    return pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[starts])), pa.array(ranges[row[starts]]), lists, pa.array(most), pa.array(least)], ["term", "range", "entries", "most_tf", "least_dl"])


def _blocks_by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's documents, which come in the order of their ranges: the last range of a batch waits for the next one."""
    waiting: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        last = int(np.searchsorted(rows["range"].to_numpy(), rows["range"][-1].as_py())) if len(rows) else 0
        if len(rows) and (last or waiting and waiting[-1]["range"][-1] != rows["range"][0]):
            whole = pa.concat_tables([*waiting, rows.slice(0, last)])
            waiting = []
            if pc.sum(pc.list_value_length(whole["tokens"])).as_py():
                yield _blocks_of(whole)
        waiting.append(rows.slice(last))
    if waiting:
        whole = pa.concat_tables(waiting)
        if pc.sum(pc.list_value_length(whole["tokens"])).as_py():
            yield _blocks_of(whole)


@dataclass(frozen=True)
class Answer:
    """Ranked hits, and how many of the question's blocks were read for them."""

    hits: DataFrame
    blocks: int
    read: int


class Segments:
    """The segments of one version of a store."""

    def __init__(self, versions: Versions, version: str | None = None):
        self.versions, self.version = versions, version or versions.current()
        self.spark = versions.spark
        names = (versions.manifest(self.version) or {}).get("tables", []) if self.version else []
        self.seqs = sorted({int(n.split("-")[1]) for n in names if n.startswith("lexical-")})

    def table(self, name: str, seqs: list[int] | None = None) -> DataFrame:
        """A table of all (or the given) segments, with its segment as ``seq``."""
        parts = [self.versions.table(_name(s, name), self.version).withColumn("seq", F.lit(s)) for s in (self.seqs if seqs is None else seqs)]
        return reduce(DataFrame.unionByName, parts)

    def alive(self, rows: DataFrame) -> DataFrame:
        """Rows (``seq, id, ...``) whose document no newer segment has taken away."""
        gone = self.table("gone").groupBy("id").agg(F.max("seq").alias("until"))
        return rows.join(gone, (rows["id"] == gone["id"]) & (rows["seq"] < gone["until"]), "left_anti")

    # ---- updates

    def add(self, staged: str, rows: DataFrame, removed: DataFrame, key: str = "id", text: str = "text") -> int:
        """Write a segment of ``rows`` (new or in place of those of their key; keys are distinct) and ``removed`` keys into a staged version.

        ``self`` is the state before. Gives the segment's number.
        """
        seq = (self.seqs[-1] if self.seqs else 0) + 1
        tokens = rows.select(F.col(key).alias("id"), whitespace_tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
        self._write(staged, seq, {"docs": tokens.select("id", F.size("tokens").alias("dl"), F.array_distinct("tokens").alias("terms"))})
        docs = self._own(staged, seq, "docs")
        self._write(staged, seq, {"gone": removed.select(F.col(key).alias("id")).unionByName(docs.select("id")).distinct()})
        gone = self._own(staged, seq, "gone")
        # texts, not their words, go to the tasks of their ranges: all that follows stays there
        placed = self._placed(rows.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), docs)
        added = docs.select("id", "dl", "terms", F.lit(1).cast("long").alias("sign"))
        if self.seqs:
            # who dies is told by ids alone: terms don't move to meet them where they are few
            dying = self.alive(self.table("docs").select("seq", "id").join(gone, "id", "left_semi"))
            dead = self.table("docs").join(hinted(dying, dying.count()), ["seq", "id"], "left_semi").select("id", "dl", "terms", F.lit(-1).cast("long").alias("sign"))
            added = added.unionByName(dead)
        terms = _sums(added.select(F.explode("terms").alias("term"), F.col("sign").alias("df")), "term", "df")
        stats = added.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0)).alias("words"))
        self._write(staged, seq, {"postings": self._text_blocks(placed), "terms": terms, "stats": stats})
        self._write(staged, seq, {"hist": self._moves(self._own(staged, seq, "terms"))})
        return seq

    def _moves(self, delta: DataFrame) -> DataFrame:
        """How a delta of frequencies changes the number of terms of each frequency: only its own terms are looked up."""
        both = delta.select("term", F.lit(0).cast("long").alias("old"), F.col("df").alias("change"))
        if self.seqs:
            old = self.table("terms").join(delta.select("term"), "term", "left_semi").select("term", F.col("df").alias("old"), F.lit(0).cast("long").alias("change"))
            both = both.unionByName(old)
        moved = both.groupBy("term").agg(F.sum("old").alias("old"), F.sum("change").alias("change"))
        steps = F.array(F.struct(F.col("old").alias("df"), F.lit(-1).cast("long").alias("terms")), F.struct((F.col("old") + F.col("change")).alias("df"), F.lit(1).cast("long").alias("terms")))
        return _sums(moved.select(F.inline(steps)).where("df > 0"), "df", "terms")

    def _placed(self, rows: DataFrame, docs: DataFrame) -> DataFrame:
        """``rows`` with the range of their document, dealt out by it to tasks of about TASK_WORDS."""
        n, words = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        ranges = max(1, n // RANGE_DOCS)
        tasks = max(min(ranges, self.spark.sparkContext.defaultParallelism), words // TASK_WORDS + 1)
        return rows.withColumn("range", F.pmod(F.xxhash64("id"), F.lit(ranges))).repartition(tasks, "range")

    @staticmethod
    def _text_blocks(placed: DataFrame) -> DataFrame:
        """Blocks of texts that were dealt out by range. A batch holds a few ranges, whose entries are counted and grouped at once."""
        bound_batches(placed.sparkSession)
        key = placed.schema["id"].dataType.simpleString()
        words = placed.sortWithinPartitions("range").select("range", "id", whitespace_tokens(F.col("text")).alias("tokens"))
        made = words.mapInArrow(_blocks_by_range, f"term string, range bigint, entries array<struct<id: {key}, tf: int, dl: int>>, most_tf int, least_dl int")
        return made.sortWithinPartitions("term", "range")

    @staticmethod
    def _blocks(placed: DataFrame) -> DataFrame:
        """Blocks of entries that were dealt out by range: nothing moves any more."""
        made = placed.groupBy("term", "range").agg(F.collect_list(F.struct("id", "tf", "dl")).alias("entries"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"))
        return made.sortWithinPartitions("term", "range")

    def merge(self, staged: str) -> list[int]:
        """In a staged version, merge the newest segments into one if enough of them are of like size; gives the merged ones.

        ``self`` is the state in the staged version. Only live entries are taken over; ids that
        are dead in still older segments stay known.
        """
        counts = (self.versions.manifest(self.version) or {}).get("counts", {})
        size = lambda s: counts.get(_name(s, "docs"), 0) + counts.get(_name(s, "gone"), 0)
        run: list[int] = []
        for s in reversed(self.seqs):
            if run and size(s) > FACTOR * sum(map(size, run)):
                break
            run.append(s)
        if len(run) < MERGE:
            return []
        run.sort()
        seq = self.seqs[-1] + 1
        entries = self.table("postings", run).select("seq", "term", F.inline("entries"))
        docs = self.alive(self.table("docs", run)).select("id", "dl", "terms")
        gone = self.table("gone", run).select("id").distinct() if run[0] != self.seqs[0] else self.table("gone", run).select("id").limit(0)
        self._write(staged, seq, {"docs": docs, "gone": gone, "terms": _sums(self.table("terms", run), "term", "df"), "hist": _sums(self.table("hist", run), "df", "terms"), "stats": self.table("stats", run).agg(F.sum("n").alias("n"), F.sum("words").alias("words"))})
        # dead documents are few and light: entries don't move to meet them
        light = self.table("docs", run).select("seq", "id")
        dead = light.join(self.alive(light), ["seq", "id"], "left_anti")
        small = 24 * dead.count() <= MOST_BROADCAST
        live = entries.join(F.broadcast(dead) if small else dead, ["seq", "id"], "left_anti").select("term", "id", "tf", "dl")
        self._write(staged, seq, {"postings": self._blocks(self._placed(live, self._own(staged, seq, "docs")))})
        self.versions.forget(staged, [_name(s, t) for s in run for t in TABLES])
        return run

    def _write(self, staged: str, seq: int, tables: dict[str, DataFrame]) -> None:
        self.versions.complete(staged, {_name(seq, t): df for t, df in tables.items()})

    def _own(self, staged: str, seq: int, table: str) -> DataFrame:
        return self.versions.table(_name(seq, table), staged)

    # ---- questions

    def weights(self, query: str) -> tuple[dict[str, float], float]:
        """The weight of each known word of a question, times the number of times it stands there, and the mean length of documents."""
        words = query.lower().split()
        if not self.seqs or not words:
            return {}, 1.0
        n, total = self.table("stats").agg(F.sum("n"), F.sum("words")).first()
        rows = self.table("terms").where(F.col("term").isin(list(dict.fromkeys(words)))).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").collect()  # a row a word
        idf = {r.term: math.log(n - r.df + 0.5) - math.log(r.df + 0.5) for r in rows}
        if any(v < 0 for v in idf.values()):
            hist = _sums(self.table("hist"), "df", "terms")
            mean = hist.agg(F.sum(F.col("terms") * _weight(F.lit(float(n)), F.col("df"))) / F.sum("terms")).first()[0]
            idf = {t: FLOOR * mean if v < 0 else v for t, v in idf.items()}
        return {t: words.count(t) * v for t, v in idf.items()}, total / n if n else 1.0

    def search(self, query: str, k: int, among: DataFrame | None = None) -> DataFrame:
        """``id, bm25_score, lexical_score, rank`` of the best ``k``, as ``LexicalIndex.search`` gives them for the live documents."""
        return self.ask(query, k, among).hits

    def ask(self, query: str, k: int, among: DataFrame | None = None) -> Answer:
        weights, mean = self.weights(query)
        none = self.spark.createDataFrame([], "id string, bm25_score double, lexical_score double, rank int")
        if not weights or not mean:
            return Answer(none, 0, 0)
        of = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        part = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
        postings = self.table("postings").where(F.col("term").isin(list(weights)))
        # a weight below 0 adds at most nothing
        bound = F.greatest(of[F.col("term")], F.lit(0.0)) * part(F.col("most_tf"), F.col("least_dl"))
        bounds = postings.groupBy("seq", "range").agg(F.sum(bound).alias("bound"), F.count(F.lit(1)).alias("blocks"))
        blocks, ranges = bounds.agg(F.sum("blocks"), F.count(F.lit(1))).first()
        if not blocks:
            return Answer(none, 0, 0)

        def scored(chosen: DataFrame, small: bool) -> DataFrame:
            rows = postings.join(F.broadcast(chosen) if small else chosen, ["seq", "range"], "left_semi").select("seq", "term", F.inline("entries"))
            if among is not None:
                rows = rows.join(among.select("id"), "id", "left_semi")
            sums = rows.groupBy("seq", "id").agg(F.round(F.sum(of[F.col("term")] * part(F.col("tf"), F.col("dl"))), 9).alias("bm25_score"))
            return self.alive(sums).select("id", "bm25_score").where("bm25_score > 0").orderBy(F.desc("bm25_score"), "id").limit(k)

        first = bounds.orderBy(F.desc("bound"), "seq", "range").limit(2 * k + 8).select("seq", "range", "blocks", "bound").collect()  # a few ranges
        head = self.spark.createDataFrame([(r["seq"], r["range"]) for r in first], "seq int, range long")
        best = scored(head, True).collect() if ranges > len(first) else []  # k rows
        floor = best[-1].bm25_score - 1e-8 if len(best) == k else 0.0
        rest = bounds.where(F.col("bound") >= floor)
        n, held = rest.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.count(F.lit(1))).first()
        read = n + sum(r["blocks"] for r in first if best and r["bound"] < floor)
        hits = scored(rest.select("seq", "range"), 24 * held <= MOST_BROADCAST)
        top = F.max("bm25_score").over(W.partitionBy())  # over k rows
        rank = F.row_number().over(W.orderBy(F.desc("bm25_score"), "id")) - 1
        return Answer(hits.select("id", "bm25_score", F.round(F.col("bm25_score") / top, 4).alias("lexical_score"), rank.alias("rank")), blocks, read)


def update(versions: Versions, rows: DataFrame, removed: DataFrame | None = None, key: str = "id", text: str = "text") -> dict[str, Any]:
    """Publish a version of a store with a segment more: ``rows`` are new or changed, ``removed`` keys go."""
    before = Segments(versions)
    staged = versions.stage({})["version"]
    before.add(staged, rows, rows.select(key).limit(0) if removed is None else removed, key, text)
    merged = Segments(versions, staged).merge(staged)
    versions.activate(staged)
    return {"version": staged, "segments": len(Segments(versions).seqs), "merged": len(merged)}
