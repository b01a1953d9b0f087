"""Exact vector search, a hashing embedder and a cache of embeddings by content."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def dot(vector: Column, query: list[float]) -> Column:
    """Inner product in double precision with a vector given here."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def bucket(token: str, dim: int) -> int:
    return int(hashlib.sha256(token.encode()).hexdigest()[:8], 16) % dim


def hashed_embedding(text: Column, dim: int) -> Column:
    """A unit vector of token counts in hashed buckets; without tokens it is zero.

    It stands in for a model: any function from a text column to such a vector serves.
    """

    @pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for texts in batches:
            out = []
            for t in texts:
                v = np.zeros(dim)
                for token, n in Counter(re.findall("[a-z0-9]+", t.lower()) if isinstance(t, str) else []).items():
                    if token not in known:
                        if len(known) > 200_000:  # the cache is bounded, not what it answers
                            known.clear()
                        known[token] = bucket(token, dim)
                    v[known[token]] += n
                length = math.sqrt(float(v @ v))
                out.append((v / length if length else v).astype(np.float32))
            yield pd.Series(out)

    return embed(text)


def embed_query(text: str, dim: int) -> list[float]:
    """The same vector for one text on the driver."""
    v = [0.0] * dim
    for t in re.findall("[a-z0-9]+", text.lower()):
        v[bucket(t, dim)] += 1
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def search(rows: DataFrame, key: str, vector: str, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """``id, score, rank`` (from 0) of the ``k`` nearest by inner product; filters apply before the search.

    Only the key and the score reach the top-k; other columns are joined back by callers.
    """
    own = rows if where is None else rows.where(where)
    best = own.select(F.col(key).alias("id"), dot(F.col(vector), query).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")) - 1)  # over k rows


def metadata_filter(source: str | None = None, category: str | None = None, author: str | None = None, year: str | None = None) -> Column:
    """Source equal, category and author contained, date beginning with the year; case doesn't matter, "all" is no filter."""
    out = F.lit(True)
    if source and source.lower() != "all":
        out = out & (F.lower("source") == source.lower())
    if category and category.lower() != "all":
        out = out & F.lower("category").contains(category.lower())
    if author:
        out = out & F.lower("author").contains(author.lower())
    if year:
        out = out & F.col("date").startswith(str(year))
    return F.coalesce(out, F.lit(False))


def cache_misses(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks whose hash has no cached vector."""
    return chunks.join(cache, "chunk_hash", "left_anti")


def embed_with_cache(chunks: DataFrame, cache: DataFrame, embed: Callable[[Column], Column], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Vectors of all chunks, and the cache with the new ones: only misses are embedded, each hash once."""
    fresh = cache_misses(chunks, cache).groupBy("chunk_hash").agg(F.min(text).alias("t")).select("chunk_hash", embed(F.col("t")).alias("embedding"))
    full = cache.select("chunk_hash", "embedding").unionByName(fresh)
    return chunks.join(full, "chunk_hash"), full


def cache_prune(cache: DataFrame, live: DataFrame) -> DataFrame:
    return cache.join(live.select("chunk_hash").distinct(), "chunk_hash", "left_semi")
