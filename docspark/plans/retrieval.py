"""Queries of retrieval: BM25, dense search, fusion, selection and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators import dense, lexical, retrieve
from docspark.settings import DEFAULT
from docspark.sources.tables import read_table

QUERY = "with nicht avec under the that queda"
K = 5


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # texts are worth dealing out; narrow tables are read faster as they are
    return read_table(spark, sf, name) if name in ("documents", "pages") else spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The documents table in the library's terms; the first line is the title."""
    title = F.substring(F.substring_index("text", "\n", 1), 1, 80)
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("lang"), F.lit("/doc-"), F.col("doc_id").cast("string"))
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), title.alias("title"), url.alias("url"), "source", F.col("lang").alias("language"), "text")


def _vector(spark: SparkSession, sf: str) -> list[float]:
    """The query vector: that of row 0."""
    return list(_t(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def _lexical(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return lexical.LexicalIndex.build(_t(spark, sf, "documents"), "doc_id", "text").search(QUERY, k)


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    got = _lexical(spark, sf, 15)
    return got.select(F.col("id").alias("doc_id"), F.round("bm25_score", 6).alias("bm25_score"), F.col("lexical_score"), F.col("rank").cast("long").alias("rank"))


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    got = dense.search(_t(spark, sf, "embeddings"), "vec_id", "embedding", _vector(spark, sf), 10)
    return got.select(F.col("id").alias("vec_id"), F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def dense_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    got = dense.search(_t(spark, sf, "embeddings"), "vec_id", "embedding", _vector(spark, sf), 10, F.col("label") == 3)
    return got.select(F.col("id").alias("vec_id"), F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    near = dense.search(_t(spark, sf, "embeddings"), "vec_id", "embedding", _vector(spark, sf), 36 * K)
    return retrieve.fuse(near, _lexical(spark, sf, 3 * K))


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    got = _fused(spark, sf)
    return got.select(F.col("id").alias("doc_id"), F.coalesce(F.col("dense_rank"), F.lit(-1)).cast("long").alias("dense_rank"), F.coalesce(F.col("lexical_rank"), F.lit(-1)).cast("long").alias("lexical_rank"), F.round("rrf_score", 8).alias("rrf_score"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    near = dense.search(_t(spark, sf, "embeddings"), "vec_id", "embedding", _vector(spark, sf), 36 * K)
    # each source is one document here, so that the cap of two chunks matters
    chunks = corpus(spark, sf).withColumn("document_id", F.col("source"))
    return retrieve.retrieve(chunks, near, _lexical(spark, sf, 3 * K), QUERY, K)


def hybrid_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    got = _hits(spark, sf)
    return got.select(F.col("id").alias("doc_id"), "document_id", F.round("rrf_score", 8).alias("rrf_score"), F.round("score", 5).alias("score"), "lexical_score", "lexical_verified", F.col("position").cast("long").alias("position"))


def evidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    got = retrieve.evidence(_hits(spark, sf))
    return got.select(F.round("best_cosine", 5).alias("best_cosine"), "best_lexical", "any_lexical", "any_author", "confidence", "sufficient")


def source_boost(spark: SparkSession, sf: str) -> DataFrame:
    """The boost of each source of a small dimension: those with a tier and any other."""
    rows = _t(spark, sf, "documents").select(F.when(F.col("doc_id") % 4 == 0, "commit_kb").when(F.col("doc_id") % 4 == 1, "Website").otherwise(F.col("source")).alias("source"), "doc_id")
    return rows.groupBy("source").agg(F.round(F.sum(retrieve.boosted(F.lit(1.0), F.col("source"), DEFAULT)), 4).alias("boosted"), F.count(F.lit(1)).alias("n"))


_BM25 = f"""
q AS (SELECT term, CAST(count(*) AS DOUBLE) AS qf FROM (SELECT unnest(string_split('{QUERY}', ' ')) AS term) GROUP BY term),
tok AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
post AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY ALL),
idf AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), stats),
floored AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf) ELSE idf END AS idf FROM idf),
scored AS (
  SELECT id, round(sum(qf * idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 9) AS s
  FROM post JOIN q USING (term) JOIN floored USING (term), stats GROUP BY id),
lex AS (
  SELECT id, s AS bm25_score, round(s / max(s) OVER (), 4) AS lexical_score, row_number() OVER (ORDER BY s DESC, id) - 1 AS rank
  FROM (SELECT * FROM scored ORDER BY s DESC, id LIMIT {{k}}) WHERE s > 0)"""
_DENSE = """
dense AS (
  SELECT vec_id AS id, score, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS rank FROM (
    SELECT e.vec_id, list_dot_product(e.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) v WHERE {where} ORDER BY score DESC, vec_id LIMIT {k}))"""
_FUSED = "WITH " + _BM25.format(k=3 * K) + "," + _DENSE.format(where="true", k=36 * K) + """,
fused AS (
  SELECT coalesce(d.id, x.id) AS id, d.rank AS dense_rank, x.rank AS lexical_rank, coalesce(d.score, 0) AS score, coalesce(x.lexical_score, 0) AS lexical_score,
    coalesce(1.0::DOUBLE / (60 + d.rank + 1), 0) + coalesce(1.0::DOUBLE / (60 + x.rank + 1), 0) AS rrf_score
  FROM dense d FULL JOIN lex x ON d.id = x.id)"""
_HITS = _FUSED + f""",
ranked AS (
  SELECT f.*, source AS document_id, length(trim(text, E' \\n\\t\\r')) < 200 AS low,
    len(list_filter(list_distinct(['with', 'nicht', 'avec', 'under', 'the', 'that', 'queda']), lambda t: length(t) >= 3 AND t NOT IN ('with', 'the', 'that')
      AND NOT list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), t))) = 0 AS lexical_verified
  FROM fused f JOIN documents ON id = doc_id),
capped AS (SELECT *, row_number() OVER (PARTITION BY document_id, low ORDER BY rrf_score DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST, id) AS n FROM ranked),
hits AS (
  SELECT *, row_number() OVER (ORDER BY rrf_score DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST, id) AS position
  FROM capped WHERE n <= 2 AND low = (SELECT min(low) FROM capped) QUALIFY position <= {K})"""

QUERIES = {f.__name__: f for f in (bm25_topk, dense_topk, dense_topk_filtered, rrf_fusion, hybrid_retrieve, evidence_gate, source_boost)}
SQL = {
    "bm25_topk": "WITH " + _BM25.format(k=15) + " SELECT id AS doc_id, round(bm25_score, 6) AS bm25_score, lexical_score, rank FROM lex",
    "dense_topk": "WITH " + _DENSE.format(where="true", k=10) + " SELECT id AS vec_id, round(score, 5) AS score, rank FROM dense",
    "dense_topk_filtered": "WITH " + _DENSE.format(where="label = 3", k=10) + " SELECT id AS vec_id, round(score, 5) AS score, rank FROM dense",
    "rrf_fusion": _FUSED + " SELECT id AS doc_id, coalesce(dense_rank, -1) AS dense_rank, coalesce(lexical_rank, -1) AS lexical_rank, round(rrf_score, 8) AS rrf_score FROM fused",
    "hybrid_retrieve": _HITS + " SELECT id AS doc_id, document_id, round(rrf_score, 8) AS rrf_score, round(score, 5) AS score, CAST(lexical_score AS DOUBLE) AS lexical_score, lexical_verified, position FROM hits",
    "evidence_gate": _HITS + """, best AS (SELECT coalesce(max(score), 0) AS c, coalesce(max(lexical_score), 0) AS l, coalesce(bool_or(lexical_verified), false) AS x FROM hits)
SELECT round(c, 5) AS best_cosine, CAST(l AS DOUBLE) AS best_lexical, x AS any_lexical, false AS any_author,
  CASE WHEN c >= 0.62 THEN 'high' WHEN c >= 0.48 OR x THEN 'medium' WHEN c >= 0.35 THEN 'low' ELSE 'none' END AS confidence, c >= 0.35 OR x AS sufficient FROM best""",
    "source_boost": """SELECT source, round(sum(1.0::DOUBLE + (CASE lower(source) WHEN 'commit_kb' THEN 3 WHEN 'staff_handbook' THEN 2 WHEN 'website' THEN 2 ELSE 1 END - 1) * 0.12::DOUBLE), 4) AS boosted, count(*) AS n
FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN 'commit_kb' WHEN doc_id % 4 = 1 THEN 'Website' ELSE source END AS source FROM documents) GROUP BY source""",
}
