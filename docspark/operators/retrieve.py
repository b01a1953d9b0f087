"""Hybrid retrieval: rank fusion, boosts, selection and the evidence gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.functions import entities
from docspark.functions import text as T
from docspark.functions.urls import is_low_value
from docspark.settings import DEFAULT, SOURCE_PRIORITY, Settings


def fuse(dense: DataFrame, lexical: DataFrame, k: int = DEFAULT.rrf_k) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (``id, rank, ...``; ranks from 0), as a full outer join."""
    d = dense.select("id", F.col("rank").alias("dense_rank"), F.col("score"))
    x = lexical.select("id", F.col("rank").alias("lexical_rank"), "bm25_score", "lexical_score")
    both = d.join(x, "id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c) + 1), F.lit(0.0))
    return both.select("id", "dense_rank", "lexical_rank", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"), (part("dense_rank") + part("lexical_rank")).alias("rrf_score"))


def source_priority(source: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SOURCE_PRIORITY.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(source)), F.lit(1))


def boosted(score: Column, source: Column, settings: Settings = DEFAULT) -> Column:
    return score * (1.0 + (source_priority(source) - 1) * settings.source_priority_boost)


def select_hits(ranked: DataFrame, k: int, settings: Settings = DEFAULT) -> DataFrame:
    """The best ``k`` hits, at most two of a document, evidence first.

    ``ranked`` has ``id, document_id, rrf_score, dense_rank, lexical_rank, low_value``.
    Pages of low value are used only if there is nothing else. Equal scores keep the
    order of the dense list, then of the lexical one.
    """
    order = [F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"), F.col("id")]
    doc = F.coalesce(F.col("document_id").cast("string"), F.col("id").cast("string"))
    capped = ranked.withColumn("__n", F.row_number().over(W.partitionBy(doc, "low_value").orderBy(*order))).where(F.col("__n") <= settings.max_per_document)
    # candidates are as few as the two lists are long
    chosen = capped.withColumn("__only", F.min(F.col("low_value").cast("int")).over(W.partitionBy())).where(F.col("low_value").cast("int") == F.col("__only"))
    return chosen.orderBy(*order).limit(k).withColumn("position", F.row_number().over(W.orderBy(*order))).drop("__n", "__only")


def lexical_verified(query: str, chunk_text: Column, settings: Settings = DEFAULT) -> Column:
    """Whether a chunk holds every salient token of a short query."""
    import re

    salient = [t for t in re.findall("[a-z0-9]+", query.lower()) if len(t) >= 3 and t not in T.QUERY_STOP]
    if not salient or len(salient) > settings.max_salient:
        return F.lit(False)
    return F.size(F.array_except(F.array(*[F.lit(t) for t in salient]), T.alnum_tokens(chunk_text))) == 0


def retrieve(chunks: DataFrame, dense: DataFrame, lexical: DataFrame, query: str, k: int = DEFAULT.top_k, settings: Settings = DEFAULT) -> DataFrame:
    """Hits for a query from its two ranked lists, with scores, flags and positions.

    ``chunks``: ``id, document_id, text`` and, where known, ``source, author, title, url, meta_header``.
    The text joins only the candidates, never the whole ranking.
    """
    have = set(chunks.columns)
    col = lambda c: F.col(c) if c in have else F.lit("")
    full = fuse(dense, lexical, settings.rrf_k).join(chunks, "id")
    names = entities.person_names(query)
    by_author = entities.author_matches(col("author"), names) if names and entities.is_authorship_query(query) else F.lit(False)
    full = full.withColumns({
        "author_verified": by_author,
        "lexical_verified": lexical_verified(query, T.search_text(col("meta_header"), F.col("text")), settings),
        "low_value": is_low_value(col("url"), col("title"), F.length(T.strip(F.col("text"))), settings.min_evidence_chars),
    })
    score = boosted(F.col("rrf_score"), col("source"), settings)
    full = full.withColumn("rrf_score", F.when(F.col("author_verified"), score * settings.author_boost).otherwise(score))
    return select_hits(full, k, settings)


def evidence(hits: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row: best scores, flags, the confidence tier and whether the evidence suffices."""
    best = hits.agg(
        F.coalesce(F.max("score"), F.lit(0.0)).alias("best_cosine"),
        F.coalesce(F.max("lexical_score"), F.lit(0.0)).alias("best_lexical"),
        F.coalesce(F.bool_or("lexical_verified"), F.lit(False)).alias("any_lexical"),
        F.coalesce(F.bool_or("author_verified"), F.lit(False)).alias("any_author"),
    )
    b = F.col("best_cosine")
    tier = F.when(b >= settings.conf_high, "high").when((b >= settings.conf_medium) | F.col("any_lexical"), "medium").when(b >= settings.min_score, "low").when(F.col("any_author"), "medium").otherwise("none")
    return best.withColumns({"confidence": tier, "sufficient": (b >= settings.min_score) | F.col("any_lexical") | F.col("any_author")})


def evidence_filter(hits: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Hits that can support a citation; if none can, all of them."""
    weak = (F.col("score") != 0) & (F.col("score") < settings.min_score) & ~F.col("lexical_verified") & ~F.col("author_verified")
    keep = (~F.col("low_value") & ~weak).cast("int")
    return hits.withColumn("__keep", keep).withColumn("__any", F.max("__keep").over(W.partitionBy())).where("__keep = __any").drop("__keep", "__any")
