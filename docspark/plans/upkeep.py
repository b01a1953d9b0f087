"""Queries of corpus maintenance, crawl runs, validation, versions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import urls
from docspark.operators import chunking, crawl, dense, merge, validate
from docspark.plans.corpus import SQL as CORPUS_SQL
from docspark.plans.retrieval import _t, corpus
from docspark.sources.shared import folder as _shared
from docspark.streaming import state


def collapse_by_url(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of one address: the richest stays, the first of equals."""
    none = F.lit(None).cast("string")
    rows = _t(spark, sf, "pages").select("page_id", "url", F.length("html").cast("long").alias("chars"))
    rich = merge.richness(none, none, none, F.lit(0), F.lit(True), F.floor(F.col("chars") / 1000), none)
    return merge.collapse(rows, merge.identity(F.col("url"), F.col("page_id")), rich, "page_id").select("page_id", "chars", F.col("collapsed").cast("long").alias("collapsed"))


def _delta(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = _t(spark, sf, "documents").select("doc_id", "source", "text")
    old = docs.where("doc_id % 3 > 0").withColumn("version", F.lit(1))
    new = docs.where("doc_id % 4 = 0").withColumn("version", F.lit(2)).unionByName(docs.where("doc_id % 8 = 0").withColumn("version", F.lit(3)))
    return old, new, docs.where("doc_id % 10 = 1").select("doc_id")


def merge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old, new, gone = _delta(spark, sf)
    return merge.upsert(old, new, "doc_id", "version", gone).groupBy("source", "version").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def merge_summary(spark: SparkSession, sf: str) -> DataFrame:
    old, new, gone = _delta(spark, sf)
    return merge.delta_counts(old, new, "doc_id", gone)


def local_changed_only(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select("doc_id", urls.content_hash(F.col("text")).alias("content_hash"))
    known = docs.where("doc_id % 5 > 0").withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, F.lit("old")).when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(F.col("content_hash")))
    return merge.changed_only(docs, known, "doc_id", "content_hash").select("doc_id")


def crawl_delta(spark: SparkSession, sf: str) -> DataFrame:
    fetches, known = _crawl_tables(spark, sf)
    return crawl.classify(fetches, known).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def _crawl_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A run's fetches and the state before it, made from the pages by their number; each page has its own address."""
    pages = _t(spark, sf, "pages").select("page_id", F.concat(F.lit("https://example.org/p/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 20 == 3, ".pdf").otherwise("")).alias("url"), F.substring(F.md5("html"), 1, 8).alias("h"))
    known = pages.where("page_id % 4 > 0").select("url", F.when(F.col("page_id") % 5 == 0, F.lit("old")).otherwise(F.col("h")).alias("content_hash"), F.lit("2024-01-01").alias("first_seen"), F.lit("2024-01-01").alias("last_seen"), F.lit("2024-01-01").alias("last_changed"))
    status = F.when(F.col("page_id") % 13 == 0, "gone").when(F.col("page_id") % 11 == 0, "error").when(F.col("page_id") % 7 == 0, "not_modified").otherwise("ok")
    fetches = pages.where("page_id % 9 > 0").select("url", status.alias("status"), F.when((status == "ok") & (F.col("page_id") % 17 > 0), F.col("h")).alias("content_hash"))
    return fetches, known


def removal_guard(spark: SparkSession, sf: str) -> DataFrame:
    fetches, known = _crawl_tables(spark, sf)
    runs = [("incremental", True, False), ("capped", True, True), ("full", False, False)]
    out = None
    for name, incremental, capped in runs:
        one = crawl.removals(known, fetches, incremental, capped).agg(F.count(F.lit(1)).alias("removed")).select(F.lit(name).alias("run"), "removed")
        out = one if out is None else out.unionByName(one)
    return out


def crawl_state(spark: SparkSession, sf: str) -> DataFrame:
    fetches, known = _crawl_tables(spark, sf)
    got = crawl.next_state(known, crawl.classify(fetches, known), crawl.removals(known, fetches, True, False), "2024-02-01")
    return got.groupBy("first_seen", "last_seen", "last_changed").agg(F.count(F.lit(1)).alias("n"))


def link_graph_bfs(spark: SparkSession, sf: str) -> DataFrame:
    """Depth of each page in a graph where page n links to 2n + 1, 3n + 1 and back to n / 2."""
    pages = _t(spark, sf, "pages").select(F.col("page_id").alias("n"))
    edges = pages.select(F.col("n").cast("string").alias("src"), F.explode(F.array(F.col("n") * 2 + 1, F.col("n") * 3 + 1, F.floor(F.col("n") / 2)).cast("array<string>")).alias("dst"))
    edges = edges.join(pages.select(F.col("n").cast("string").alias("dst")), "dst", "left_semi").select("src", "dst")
    got = crawl.frontier(edges, pages.where("n = 0").select(F.col("n").cast("string").alias("url")), 4)
    return got.select(F.col("url").cast("long").alias("page_id"), F.col("depth").cast("long").alias("depth"))


def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 24).alias("chunk_hash"))
    return dense.cache_misses(rows, rows.where("doc_id % 3 = 0").select("chunk_hash").distinct()).select("doc_id")


def cache_prune(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 24).alias("chunk_hash"))
    return dense.cache_prune(rows, rows.where("doc_id % 3 = 0")).select("doc_id")


def exact_dup_groups(spark: SparkSession, sf: str) -> DataFrame:
    return validate.duplicates(_t(spark, sf, "documents"), urls.content_hash(F.col("text")))


def first_of_each_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    return chunking.first_of_each(rows, ["h"], [F.col("doc_id")]).select("doc_id")


def _checked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = corpus(spark, sf).select("document_id", F.when(F.col("id") % 50 > 0, F.col("url")).otherwise(F.lit(" ")).alias("url"), F.when(F.col("id") % 40 > 0, F.col("title")).alias("title"), F.lit("").alias("author"), F.when(F.col("id") % 2 == 0, F.lit("2024-01-01")).alias("date"), F.when(F.col("id") % 100 == 0, F.lit("local")).otherwise(F.col("source")).alias("source"), "text")
    chunks = corpus(spark, sf).select(F.col("id").cast("string").alias("chunk_id"), F.when(F.col("id") % 60 == 0, F.col("id") + 1_000_000).otherwise(F.col("id")).alias("document_id"), "title", "text", F.when(F.col("id") % 30 > 0, F.col("title")).otherwise(F.lit("")).alias("meta_header"), F.md5("text").alias("chunk_hash"))
    return docs, chunks


def validate_report(spark: SparkSession, sf: str) -> DataFrame:
    return validate.validate(*_checked(spark, sf))


def orphan_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs, chunks = _checked(spark, sf)
    return validate.orphans(chunks, docs).select("chunk_id", "document_id")


def version_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Which of a table of versions (here: the days and hours with events) stay: the newest five and the active one."""
    from docspark.sources.versions import retention

    versions = _t(spark, sf, "events").select(F.date_format("ts", "yyyyMMdd'T'HH").alias("version")).distinct()
    return retention(versions, "20240103T07", 5)


# ---- streams -----------------------------------------------------------------------------


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def window_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    got = state.tumbling(_events(spark, sf), "1 day", "1 hour", "ts", "event_type")
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def window_sliding(spark: SparkSession, sf: str) -> DataFrame:
    got = state.sliding(_events(spark, sf), "12 hours", "6 hours", "1 hour")
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def window_sessions(spark: SparkSession, sf: str) -> DataFrame:
    got = state.sessions(_events(spark, sf), "6 hours", "1 hour")
    return got.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def _streamed(spark: SparkSession, sf: str) -> DataFrame:
    schema = _t(spark, sf, "events").schema
    return state.file_stream(spark, f"{sf}/events.parquet*", schema)


def stream_feedback_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Feedback read as a stream, appended to a log by micro-batches and counted."""
    at = _shared(spark, "feedback")

    def each(batch: DataFrame, _: int) -> None:
        rows = batch.select("ts", F.when(F.col("event_type") == "purchase", "Helpful").otherwise("not_helpful").alias("verdict"), F.col("props").alias("question"), F.col("user_id").cast("string").alias("user_name"), F.col("user_id").cast("string").alias("user_id"), F.lit("c").alias("channel_id"), F.lit("p").alias("post_id"))
        state.append_log(state.feedback(rows), f"{at}/log")

    state.drain(_streamed(spark, sf), each, f"{at}/checkpoint").awaitTermination()
    return state.feedback_counts(spark.read.schema("verdict string").json(f"{at}/log"))


def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Daily windows over the events as a stream, written by micro-batches; the last state of each window counts."""
    at = _shared(spark, "tumbling")
    windows = state.tumbling(_streamed(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "1 hour", "ts", "event_type")
    query = windows.writeStream.outputMode("update").foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{at}/out")).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(f"{at}/out").groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_state_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of each user, kept in a versioned table that micro-batches merge into."""
    from docspark.sources.versions import Versions

    at = _shared(spark, "state")
    versions = Versions(spark, f"{at}/kb")
    handle = state.upsert_into(versions, "last", "user_id", "event_id")
    state.drain(_streamed(spark, sf).select("user_id", "event_id", "event_type"), handle, f"{at}/checkpoint").awaitTermination()
    return versions.table("last").select("user_id", "event_id", "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        collapse_by_url, merge_upsert, merge_summary, local_changed_only, crawl_delta, removal_guard, crawl_state, link_graph_bfs, cache_misses, cache_prune, exact_dup_groups, first_of_each_text, validate_report, orphan_chunks,
        version_retention, window_tumbling, window_sliding, window_sessions, stream_feedback_counts, stream_tumbling, stream_state_upsert,
    )
}
CANONICAL = CORPUS_SQL["url_canonical"]
_RUN = """
p AS (SELECT page_id, substr(md5(html), 1, 8) AS h, page_id % 20 = 3 AS pdf FROM pages),
k AS (SELECT page_id, pdf, CASE WHEN page_id % 5 = 0 THEN 'old' ELSE h END AS old FROM p WHERE page_id % 4 > 0),
f AS (SELECT page_id, s, CASE WHEN s = 'ok' AND page_id % 17 > 0 THEN h END AS new FROM (SELECT *, CASE WHEN page_id % 13 = 0 THEN 'gone' WHEN page_id % 11 = 0 THEN 'error' WHEN page_id % 7 = 0 THEN 'not_modified' ELSE 'ok' END AS s FROM p WHERE page_id % 9 > 0)),
c AS (SELECT page_id, new, CASE WHEN s = 'gone' THEN 'gone' WHEN s = 'not_modified' THEN 'unchanged' WHEN s = 'error' THEN 'failed' WHEN new IS NULL THEN CASE WHEN old IS NOT NULL THEN 'demoted' ELSE 'skipped' END
  WHEN old IS NULL THEN 'added' WHEN new = old THEN 'unchanged' ELSE 'updated' END AS change FROM f LEFT JOIN k USING (page_id)),
r AS (SELECT page_id FROM k WHERE NOT pdf AND page_id NOT IN (SELECT page_id FROM f WHERE s <> 'gone'))"""
_MERGED = """
docs AS (SELECT doc_id, source FROM documents), old AS (SELECT *, 1 AS version FROM docs WHERE doc_id % 3 > 0),
new AS (SELECT *, CASE WHEN doc_id % 8 = 0 THEN 3 ELSE 2 END AS version FROM docs WHERE doc_id % 4 = 0)"""
_TITLE = "substr(split_part(text, chr(10), 1), 1, 80)"
SQL = {
    "collapse_by_url": f"""WITH k AS (SELECT page_id, length(html) AS chars, canonical_url FROM pages JOIN ({CANONICAL}) USING (page_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY floor(chars / 1000) DESC, page_id) AS n, count(*) OVER (PARTITION BY canonical_url) - 1 AS collapsed FROM k)
SELECT page_id, chars, collapsed FROM r WHERE n = 1""",
    "merge_upsert": "WITH " + _MERGED + """, m AS (SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT * FROM new)
SELECT source, version, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM m WHERE doc_id % 10 <> 1 GROUP BY ALL""",
    "merge_summary": "WITH " + _MERGED + """, j AS (SELECT coalesce(o.doc_id, n.doc_id) AS id, o.doc_id AS o, n.doc_id AS n FROM old o FULL JOIN new n ON o.doc_id = n.doc_id)
SELECT count(*) FILTER (o IS NULL) AS added, count(*) FILTER (o IS NOT NULL AND n IS NOT NULL) AS updated, count(*) FILTER (id % 10 = 1) AS removed, count(*) FILTER (id % 10 <> 1) AS total,
count(*) FILTER (o IS NULL) + count(*) FILTER (o IS NOT NULL AND n IS NOT NULL) + count(*) FILTER (id % 10 = 1) AS changed FROM j""",
    "local_changed_only": "SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0",
    "crawl_delta": "WITH " + _RUN + " SELECT change, count(*) AS n FROM c GROUP BY change",
    "removal_guard": "WITH " + _RUN + " SELECT 'incremental' AS run, count(*) AS removed FROM r UNION ALL SELECT 'capped', 0 UNION ALL SELECT 'full', 0",
    "crawl_state": "WITH " + _RUN + """, kept AS (SELECT * FROM c WHERE change NOT IN ('gone', 'demoted', 'skipped')),
j AS (SELECT coalesce(k.page_id, kept.page_id) AS id, k.page_id AS known, change FROM k FULL JOIN kept ON k.page_id = kept.page_id)
SELECT CASE WHEN known IS NULL THEN '2024-02-01' ELSE '2024-01-01' END AS first_seen, CASE WHEN change IS NULL THEN '2024-01-01' ELSE '2024-02-01' END AS last_seen, CASE WHEN change IN ('added', 'updated') THEN '2024-02-01' WHEN known IS NULL THEN NULL ELSE '2024-01-01' END AS last_changed, count(*) AS n
FROM j WHERE id NOT IN (SELECT page_id FROM r) AND NOT (known IS NULL AND coalesce(change, '') = 'failed') GROUP BY ALL""",
    "link_graph_bfs": """WITH RECURSIVE e AS (SELECT page_id AS s, unnest([page_id * 2 + 1, page_id * 3 + 1, page_id // 2]) AS t FROM pages),
b AS (SELECT 0::BIGINT AS page_id, 0::BIGINT AS depth UNION SELECT t, depth + 1 FROM b JOIN e ON s = page_id JOIN pages p ON p.page_id = t WHERE depth < 4)
SELECT page_id, min(depth) AS depth FROM b GROUP BY page_id""",
    "cache_misses": "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)",
    "cache_prune": "SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents WHERE doc_id % 3 = 0)",
    "exact_dup_groups": "SELECT substr(sha256(text), 1, 24) AS value, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "first_of_each_text": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "validate_report": f"""
WITH d AS (SELECT doc_id, doc_id % 50 = 0 AS no_url, doc_id % 40 = 0 OR trim({_TITLE}, E' \\t\\n\\r') = '' AS no_title, CASE WHEN doc_id % 100 = 0 THEN 'local' ELSE source END AS source, text FROM documents),
t AS (SELECT doc_id, text, length(text) AS n, trim({_TITLE}, E' \\t\\n\\r') = '' AS no_title FROM documents)
SELECT * FROM (VALUES
 ('info', 'documents', (SELECT count(*) FROM d)), ('error', 'missing_id', 0), ('error', 'empty_text', (SELECT count(*) FROM d WHERE trim(text, E' \\t\\n\\r') = '')),
 ('error', 'missing_url', (SELECT count(*) FROM d WHERE no_url AND source <> 'local')), ('warning', 'local_without_url', (SELECT count(*) FROM d WHERE no_url AND source = 'local')),
 ('warning', 'missing_title', (SELECT count(*) FROM d WHERE no_title)), ('warning', 'missing_author', (SELECT count(*) FROM d)), ('warning', 'missing_date', (SELECT count(*) FROM d WHERE doc_id % 2 = 1)),
 ('info', 'chunks', (SELECT count(*) FROM d)), ('warning', 'oversized_chunks', (SELECT count(*) FROM t WHERE n > 2640)), ('warning', 'undersized_chunks', (SELECT count(*) FROM t WHERE n < 200)),
 ('warning', 'chunks_without_header', (SELECT count(*) FROM t WHERE doc_id % 30 = 0 OR no_title)), ('warning', 'chunks_without_title', (SELECT count(*) FROM t WHERE no_title)),
 ('warning', 'duplicate_chunks', (SELECT count(*) - count(DISTINCT text) FROM t)), ('error', 'duplicate_urls', 0),
 ('warning', 'duplicate_texts', (SELECT count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1))), ('error', 'duplicate_ids', 0),
 ('error', 'orphan_chunks', (SELECT count(*) FROM documents WHERE doc_id % 60 = 0))) v(severity, "check", n)""",
    "orphan_chunks": "SELECT CAST(doc_id AS VARCHAR) AS chunk_id, doc_id + 1000000 AS document_id FROM documents WHERE doc_id % 60 = 0",
    "version_retention": "SELECT version, row_number() OVER (ORDER BY version DESC) <= 5 OR version = '20240103T07' AS kept FROM (SELECT DISTINCT strftime(ts, '%Y%m%dT%H') AS version FROM events)",
    "window_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "window_sliding": """SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1""",
    "window_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""",
    "stream_feedback_counts": "SELECT CASE WHEN event_type = 'purchase' THEN 'helpful' ELSE 'not_helpful' END AS verdict, count(*) AS n FROM events GROUP BY 1",
    "stream_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_state_upsert": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
}
