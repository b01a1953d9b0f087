"""Packing of documents into sequences in the order of a space-filling curve.

A document becomes a vector of hashed token counts, projected to DIMENSIONS coordinates by
signs that a hash gives; its cell on a fixed grid has a place on the Hilbert curve. All
documents, ordered by that key, are one stream of tokens that is cut every ``length``
tokens, so neighbours on the curve share sequences and only the last one is padded.
"""

from __future__ import annotations

import base64
import math
import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docspark.llm import scratch

DIMENSIONS, BITS = 4, 10
#: Documents of one range of the curve (their light rows only).
RANGE_ROWS = 50_000
END_ID = 1
#: Characters on which the two libraries' pre-tokenizers rest on the same old Unicode classes.
_PLAIN = r"[\x00-\x1B\x20-\x7E\xA0-ɏ‐-‧‰-⁞]*"


class Encoder:
    """Token ids of the ``tokenizers`` file at ``json_path``, special strings included.

    Where the same vocabulary is also at hand as ranks, plain Latin text goes through the
    faster library, which gives the same ids; everything else goes through ``tokenizers``.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        import json
        import re

        from tokenizers import Tokenizer

        self.slow, self.fast, self.plain = Tokenizer.from_file(json_path), None, re.compile(_PLAIN)
        with open(json_path) as f:
            special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.marks = tuple(special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast and self.plain.fullmatch(text) and not any(m in text for m in self.marks):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(json_path: str, ranks_path: str | None, pattern: str | None) -> Encoder:
    """One encoder a Python worker, kept between tasks."""
    kept: dict[Any, Encoder] = sys.__dict__.setdefault("_docspark_encoders", {})
    key = (json_path, ranks_path)
    if key not in kept:
        kept[key] = Encoder(json_path, ranks_path, pattern)
    return kept[key]


def project(ids: np.ndarray) -> np.ndarray:
    """DIMENSIONS coordinates: the sum over the tokens of signs hashed from the id, by the root of the length."""
    values, n = np.unique(ids, return_counts=True)
    h = (values.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    weight = np.sqrt(n)
    norm = math.sqrt(float(n.sum())) or 1.0
    return np.array([float((weight * (1 - 2 * ((h >> np.uint64(40 + d)) & np.uint64(1)).astype(np.float64))).sum()) / norm for d in range(DIMENSIONS)])


def grid(x: np.ndarray) -> list[int]:
    """Coordinates to cells: the logistic curve spreads them over the grid without looking at other rows."""
    top = (1 << BITS) - 1
    return [int(v) for v in np.clip(top / (1 + np.exp(-np.clip(x, -30, 30) / 2)), 0, top)]


def hilbert_key(cells: list[int], bits: int = BITS) -> int:
    """Position on the Hilbert curve of a cell (Skilling, 2004: axes to transpose)."""
    x, n = list(cells), len(cells)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    key = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | ((v ^ t) >> b & 1)
    return key


def tokenized(docs: DataFrame, json_path: str, ranks_path: str | None, pattern: str | None, key: str, text: str) -> DataFrame:
    """``doc, curve, doc_tokens, ids`` (little-endian uint16 or uint32, END_ID last), a row for each document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(json_path, ranks_path, pattern)
        for batch in batches:
            curve, n, ids, wide = [], [], [], []
            for t in batch.column(1):
                own = np.append(enc.ids(t.as_py() or ""), np.uint32(END_ID))
                curve.append(hilbert_key(grid(project(own[:-1]))))
                n.append(len(own))
                wide.append(int(own.max()) > 0xFFFF)
                ids.append(own.astype("<u4" if wide[-1] else "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(curve, pa.int64()), pa.array(n, pa.int64()), pa.array(wide, pa.bool_()), pa.array(ids, pa.binary())], ["doc", "curve", "doc_tokens", "wide", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(encode, "doc long, curve long, doc_tokens long, wide boolean, ids binary")


def pack(docs: DataFrame, length: int, json_path: str, ranks_path: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens.

    Columns: the key, ``start``, ``length``, ``ids`` (or ``ids_crc32`` with ``digest``),
    ``doc_tokens``, ``sequence_id``, ``offset``. Every id of every document is in exactly
    one piece. Null and empty texts are the end id alone; repeated ids are documents of
    their own; an empty table has no pieces. Documents of one key on the curve (copies)
    are ordered by id, so a group of copies is spread over ranges like any other rows.
    """
    spark = docs.sparkSession
    tokens = scratch.written(tokenized(docs, json_path, ranks_path, pattern, key, text).withColumn("row", F.monotonically_increasing_id()), "tokens", "zstd")
    light = tokens.select("row", "doc", "curve", "doc_tokens")
    ranges = max(1, math.ceil(light.count() / RANGE_ROWS))
    # Ranges are cut by the composite order, then kept with their number: nothing is cut twice.
    cut = light.repartitionByRange(ranges, "curve", "doc", "row").withColumn("range", F.spark_partition_id())
    cut = scratch.written(cut, "curve")
    sums = cut.groupBy("range").agg(F.sum("doc_tokens").alias("n"))
    before = sums.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))  # a row for each range
    within = F.sum("doc_tokens").over(W.partitionBy("range").orderBy("curve", "doc", "row")) - F.col("doc_tokens")
    at = cut.withColumn("within", within).join(F.broadcast(before), "range").select("row", (F.col("within") + F.col("before")).alias("at"))
    placed = tokens.join(at, "row")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            rows: list[list[Any]] = [[] for _ in range(7)]
            for doc, wide, raw, g in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    sequence, offset = divmod(g + start, length)
                    n = min(length - offset, len(ids) - start)
                    own = ids[start : start + n].tobytes()
                    for into, v in zip(rows, (doc, start, n, zlib.crc32(own) if digest else own, len(ids), sequence, offset), strict=True):
                        into.append(v)
                    start += n
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names)

    names = [key, "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"]
    schema = f"`{key}` long, start long, length long, {'ids_crc32 long' if digest else 'ids binary'}, doc_tokens long, sequence_id long, offset long"
    return placed.select("doc", "wide", "ids", "at").mapInArrow(pieces, schema)
