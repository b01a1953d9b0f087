"""Ranked lexical search for a set of queries by sort-based accumulation.

1. One pass over the documents keeps, of each text, its number of terms and its postings:
   the terms that some query has, with their frequencies. Each task also counts in how many
   of its documents a term stands, so the corpus statistics are sums of a few rows a task.
2. A second pass reads the postings alone. A task has a range of documents; for a slice of
   them all matched arrays of (query, document, impact) are laid end to end, the packed keys
   ``query * documents + document`` are radix sorted 16 bits at a time, and one ``reduceat``
   gives every score. Each query keeps its k best of the task in a heap.
3. A window over those few rows for each task and query gives the k best of all.

Queries are taken in blocks of bounded vocabulary, each with a pass of its own, so that no
table of terms grows with their number. Scores are integers and exact.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.llm import scratch

#: Bytes of the queries of one block: their terms are sent to every task.
BLOCK_BYTES = 4 << 20
#: Matched (query, document, impact) entries that are accumulated at a time, and documents whose numbers stand in one key.
ENTRIES, MOST_DOCUMENTS = 1 << 21, 1 << 16
#: Texts are split this many bytes at a time, at a place between terms.
CHUNK = 1 << 22

# A-Z in lower case; every ASCII character that is neither letter nor digit separates.
_CLASS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in lists of bounded length; together they are all its terms in order."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_CLASS)
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= CHUNK else data.rfind(b" ", at, at + CHUNK) + 1
        if end <= at:  # one term is longer than a chunk
            end = data.find(b" ", at + CHUNK) + 1 or len(data)
        yield data[at:end].split()
        at = end


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The stable order of non-negative keys below ``2 ** bits``, 16 bits at a time from the lowest."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def accumulate(doc: np.ndarray, term: np.ndarray, value: np.ndarray, first: np.ndarray, queries: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query, document, score`` of matched postings; the queries of term t are ``queries[first[t] : first[t + 1]]``."""
    many = first[term + 1] - first[term]
    entry = np.repeat(np.arange(len(term)), many)
    within = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)
    key = queries[first[term[entry]] + within].astype(np.int64) * documents + doc[entry]
    if not len(key):
        return key, key, key
    order = radix_order(key, max(1, int(key.max()).bit_length()))
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    score = np.add.reduceat(value[entry][order], new)
    return key[new] // documents, key[new] % documents, score


class Best:
    """The k best documents of each query so far: higher scores first, then lower ids, null ids last."""

    def __init__(self, k: int, queries: int):
        self.k, self.heaps, self.floor = k, [[] for _ in range(queries)], np.zeros(queries, np.int64)

    def add(self, query: np.ndarray, ids: list[int | None], score: np.ndarray) -> None:
        for i in np.flatnonzero((score >= self.floor[query]) & (score > 0)).tolist():
            q, d = int(query[i]), ids[i]
            # the least entry goes first: low scores, then null ids, then high ids
            entry = (int(score[i]), d is not None, -(d or 0))
            heap = self.heaps[q]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.floor[q] = heap[0][0]

    def rows(self) -> tuple[list[int], list[int], list[int | None]]:
        flat = [(q, s, -d if known else None) for q, heap in enumerate(self.heaps) for s, known, d in heap]
        return [f[0] for f in flat], [f[1] for f in flat], [f[2] for f in flat]


def postings(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """``id, n, term, tf`` of every document with terms, and for each task one row without ``n`` but with ``df``.

    ``term`` and ``tf`` name the terms of ``vocabulary`` in the text; ``df`` has a number for
    each of them, ``documents`` and ``words`` count the task's documents with terms and their terms.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, words = np.zeros(len(vocabulary), np.int64), 0, 0
        number = vocabulary.get
        for batch in batches:
            ids, ns, found, tfs = [], [], [], []
            for i, one in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, count = 0, Counter()
                for part in terms(one.as_py()):
                    n += len(part)
                    count.update(map(number, part))
                count.pop(None, None)
                if n:
                    documents, words = documents + 1, words + n
                    ids.append(i), ns.append(n)
                    found.append(np.fromiter(count.keys(), np.int32, len(count)))
                    tfs.append(np.fromiter(count.values(), np.int64, len(count)))
                    df[found[-1]] += 1
            none = pa.nulls(len(ids), pa.int64())
            yield _rows(pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), found, tfs, none, none, pa.nulls(len(ids), pa.list_(pa.int64())))
        one = lambda v: pa.array([v], pa.int64())
        yield _rows(one(None), one(None), [None], [None], one(documents), one(words), pa.array([df], pa.list_(pa.int64())))

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(read, "id long, n long, term array<int>, tf array<long>, documents long, words long, df array<long>")


def _rows(ids: pa.Array, ns: pa.Array, term: list, tf: list, documents: pa.Array, words: pa.Array, df: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, ns, pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64())), documents, words, df], ["id", "n", "term", "tf", "documents", "words", "df"])


def scored(found: DataFrame, weights: np.ndarray, first: np.ndarray, queries: np.ndarray, n_queries: int, n_docs: int, n_words: int, k: int) -> DataFrame:
    """``query, score, id``: the k best of each query in each task's range of ``postings``."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, n_queries)
        for batch in batches:
            ids, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            lists = batch.column(2)
            ends = lists.offsets.to_numpy().astype(np.int64)
            term, tf = lists.values.to_numpy()[ends[0] : ends[-1]].astype(np.int64), batch.column(3).values.to_numpy()
            tf = tf[batch.column(3).offsets[0].as_py() :][: len(term)]
            ends = ends - ends[0]
            doc = np.repeat(np.arange(len(ids)), np.diff(ends))
            m = 10 + (90 * n * n_docs) // n_words
            value = weights[term] * impact(tf, m[doc])
            some = value > 0
            term, value, doc = term[some], value[some], doc[some]
            # a slice of documents at a time, so that its entries are bounded
            size = np.concatenate([[0], np.cumsum((first[term + 1] - first[term]))])
            edge = np.searchsorted(doc, np.arange(len(ids) + 1))
            a = 0
            while a < len(ids):
                b = int(np.searchsorted(size[edge], size[edge[a]] + ENTRIES, "right")) - 1
                b = min(max(b, a + 1), a + MOST_DOCUMENTS, len(ids))
                part = slice(edge[a], edge[b])
                q, d, score = accumulate(doc[part] - a, term[part], value[part], first, queries, b - a)
                best.add(q, [ids[a + x] for x in d.tolist()], score)
                a = b
        q, s, d = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(s, pa.int64()), pa.array(d, pa.int64())], ["query", "score", "id"])

    return found.where("n is not null").select("id", "n", "term", "tf").mapInArrow(rank, "query int, score long, id long")


def _block(docs: DataFrame, items: list[Any], key: str, text: str, k: int) -> DataFrame:
    """``query, rank, id, score`` for the collected queries (``query``, ``text``) of one block."""
    numbered: dict[bytes, int] = {}
    own = [sorted({numbered.setdefault(t, len(numbered)) for part in terms(r["text"]) for t in part}) for r in items]
    pairs = sorted((t, q) for q, ts in enumerate(own) for t in ts)
    term_of, query_of = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    first = np.searchsorted(term_of, np.arange(len(numbered) + 1))
    found = scratch.written(postings(docs, key, text, numbered), "postings")
    tasks = found.where("df is not null")
    n_docs, n_words = tasks.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    df = np.zeros(len(numbered), np.int64)
    for t, n in tasks.select(F.posexplode("df").alias("t", "n")).groupBy("t").agg(F.sum("n")).where("`sum(n)` > 0").collect():  # at most the block's terms
        df[t] = n
    weights = np.array([weight(int(x), n_docs) for x in df], np.int64)
    local = scored(found, weights, first, query_of, len(items), n_docs, max(n_words, 1), k)
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(q, r["query"]) for q, r in enumerate(items)], "query int, name long")
    return ranked.join(F.broadcast(names), "query").select(F.col("name").alias("query"), "rank", "id", "score")


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item, rank, id, score``: the ``k`` best documents of each item with a score above 0.

    Terms are the longest runs of letters, digits and characters beyond ASCII, with A-Z in
    lower case. Items and documents without terms (null, empty) get and give nothing, and the
    latter count in no statistic. Equal scores stand by ascending id, null ids last; repeated
    rows are documents, or items, of their own. Without documents or items the result is empty.
    Other columns are ignored. ``item`` has the type of ``item_key``.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_key).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    asked = scratch.written(asked.withColumn("query", F.monotonically_increasing_id()), "queries")
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    found = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select("query", "text").collect()  # bounded: about BLOCK_BYTES
        if rows:
            found.append(scratch.written(_block(docs, rows, key, text, k), "ranked"))
    if not found:
        found = [spark.createDataFrame([], "query long, rank int, id long, score long")]
    return reduce(DataFrame.unionByName, found).join(asked.select("query", "item"), "query").select("item", "rank", "id", "score")
