"""Queries of what grows by deltas and of indexed searches: segments, collapse in the merge, patterns, names, cells, keyed state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import entities
from docspark.operators import cells, counts, merge, patterns, segments
from docspark.plans.retrieval import _BM25, QUERY, _t
from docspark.sources.shared import durable
from docspark.sources.shared import folder as _shared
from docspark.sources.versions import Versions
from docspark.streaming import joined, keyed

THREE = "nicht zwischen policy"
PATTERNS = ["nicht|avec", "th(e|at) [a-z]+tion", "qu(e|i)da+", "[0-9]{4}-[0-9]{2}", "license.*rights", "un.er the"]


def _hits(got: DataFrame) -> DataFrame:
    return got.select(F.col("id").alias("doc_id"), F.round("bm25_score", 6).alias("bm25_score"), "lexical_score", F.col("rank").cast("long").alias("rank"))


def bm25_segments(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 after three updates and a removal: English documents, all others, French ones with another text; two sources go."""
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "text")
    versions = Versions(spark, f"{_shared(spark, 'segments')}/kb")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    for rows in (docs.where(english), docs.where(~english), docs.where("lang = 'fr'").withColumn("text", F.concat("text", F.lit(" under that under")))):
        segments.update(versions, rows.select("id", "text"))
    segments.update(versions, docs.select("id", "text").limit(0), docs.where("source in ('src1', 'src3')").select("id"))
    return _hits(segments.Segments(versions).search(QUERY, 15))


def bm25_three_words(spark: SparkSession, sf: str) -> DataFrame:
    """A three-word question to a written index, of whose blocks only those are read whose bound reaches the threshold."""
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    versions = Versions(spark, f"{_shared(spark, 'blocks')}/kb")
    segments.update(versions, docs)
    return _hits(segments.Segments(versions).search(THREE, 10))


def regex_search(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that match each of some patterns, case apart, through the trigram index."""
    at = f"{_shared(spark, 'trigrams')}/index"
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    patterns.build(docs, "doc_id", "text").write.parquet(at)
    index = spark.read.parquet(at)
    found = [patterns.search(docs, index, p, "doc_id", "text").select(F.lit(p).alias("pattern"), "doc_id") for p in PATTERNS]
    return reduce(DataFrame.unionByName, found)


def name_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Names of customers and suppliers against author fields made of both tables."""
    customers, suppliers = _t(spark, sf, "customer"), _t(spark, sf, "supplier")
    names = customers.select("c_name", F.concat(F.lit("Dr. "), "c_name").alias("name")).unionByName(suppliers.select(F.col("s_name").alias("c_name"), F.concat(F.lit("Ann  "), "s_name").alias("name")))
    number = F.lpad(F.col("s_suppkey").cast("string"), 9, "0")
    authors = suppliers.select("s_suppkey", F.concat(F.lit("Prof. Customer#"), number, F.lit("; Bo "), "s_name").alias("author"))
    authors = authors.unionByName(suppliers.select((-1 - F.col("s_suppkey")).alias("s_suppkey"), F.concat(F.lit("CUSTOMER#"), number).alias("author")))
    return entities.name_pairs(names.withColumnRenamed("c_name", "of"), authors, "of", "name", "s_suppkey", "author")


def collapse_in_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Documents after two deltas in which two documents each share an address: the richest stays.

    The second delta brings a fifth of the documents again with a longer text, and late rows that change nothing.
    """
    docs = _t(spark, sf, "documents").select("doc_id", F.concat(F.lit("https://www.x.org/a/"), F.floor(F.col("doc_id") / 2).cast("string"), F.when(F.col("doc_id") % 2 == 0, "/").otherwise("")).alias("url"), "text", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("updated_at"))
    longer = docs.where("doc_id % 5 = 0").withColumns({"text": F.concat("text", F.lit(" and more"), F.repeat("text", 1)), "updated_at": F.concat(F.lit("1"), "updated_at")})
    late = docs.where("doc_id % 3 = 0").withColumns({"text": F.lit("late"), "updated_at": F.lit("")})
    none = F.lit(None).cast("string")
    rich = merge.richness(none, none, none, F.lit(0), F.lit(True), F.length(F.coalesce("text", F.lit(""))), F.col("updated_at"))
    now = docs.limit(0)
    for delta in (docs, longer.unionByName(late)):
        fresh = merge.effective(now, delta, "doc_id", "updated_at")
        fresh = durable(fresh, "fresh")
        merged = durable(merge.replaced(now, fresh, "doc_id"), "merged")
        now = durable(merged.join(merge.collapse_touched(merged, fresh, "doc_id", merge.identity(F.col("url"), F.col("doc_id")), rich), "doc_id", "left_anti"), "now")
    return now.select("doc_id", F.md5("text").alias("h"), "updated_at")


def dense_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest found of every twentieth vector among all, through cells and codes (a test measures the recall)."""
    rows = _t(spark, sf, "embeddings")
    index = cells.CellIndex.build(rows, "vec_id", "embedding")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    probes = -(-len(index.centres) * 7 // 10)
    return index.search(asked, 10, probes, 100).select("query", F.col("id").alias("vec_id"), F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def crawl_state_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Events as fetches of pages, in two runs of a stream on one checkpoint: the state of every page."""
    at = _shared(spark, "keyed")
    kind = F.col("event_type")
    status = F.when(kind == "error", "error").when((kind == "signup") & (F.col("value") < 20), "gone").when(kind == "signup", "not_modified").otherwise("ok")
    fetches = _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("url"), status.alias("status"), F.when(status == "ok", F.col("event_type")).alias("content_hash"), F.col("ts").cast("timestamp").alias("at"))
    schema = "url string, status string, content_hash string, at timestamp"
    later = F.col("at") >= F.lit("2024-01-16").cast("timestamp")
    for part in (~later, later):
        fetches.where(part).write.mode("append").parquet(f"{at}/fetches")
        keyed.follow(spark, f"{at}/fetches", f"{at}/log", f"{at}/checkpoint", schema)
    state = keyed.state_of(spark.read.parquet(f"{at}/log"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return state.select(F.col("url").cast("long").alias("user_id"), "content_hash", text("first_seen"), text("last_seen"), text("last_changed"))


def counts_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and distinct texts of each source, kept up over three deltas: all documents, French ones move to another source, long ones go."""
    docs = _t(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("h"), "lang", F.length("text").alias("n_text"))
    kept = counts.Kept(Versions(spark, f"{_shared(spark, 'counts')}/kb"), "counts", ["source", "h"])
    none = docs.limit(0)
    kept.apply(counts.images(none, docs, none.select("doc_id"), "doc_id"))
    moved = docs.where("lang = 'fr'").withColumn("source", F.lit("french"))
    kept.apply(counts.images(docs, moved, none.select("doc_id"), "doc_id"))
    now = merge.replaced(docs, moved, "doc_id")
    kept.apply(counts.images(now, none, now.where("n_text > 5000").select("doc_id"), "doc_id"))
    return kept.counts(["source"]).select("source", "n", F.col("members").alias("texts"))


def feedback_join(spark: SparkSession, sf: str) -> DataFrame:
    """Events as answers, errors and purchases as feedback on the event before, some of it twice: verdicts by kind, from two streams in two runs."""
    at = _shared(spark, "joined")
    events = _t(spark, sf, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    answers = events.select(F.col("event_id").cast("string").alias("request_id"), F.lit("q").alias("question"), F.col("event_type").alias("confidence"), F.col("ts").alias("at"))
    given = events.where("event_type in ('error', 'purchase')").select((F.col("event_id") - 1).cast("string").alias("request_id"), F.when(F.col("event_type") == "error", "DOWN").otherwise("up").alias("verdict"), F.col("ts").alias("at"))
    later = F.col("at") >= F.lit("2024-01-16").cast("timestamp")
    # the last rows move both watermarks on, so that all answers without feedback come out
    end = lambda schema, row: spark.createDataFrame([row], schema).withColumn("at", F.lit("2034-01-01").cast("timestamp"))
    for part in (~later, later):
        answers.where(part).write.mode("append").parquet(f"{at}/answers")
        given.where(part).unionByName(given.where(part & (F.col("verdict") == "up"))).write.mode("append").parquet(f"{at}/feedback")
        joined.follow(spark, f"{at}/answers", f"{at}/feedback", f"{at}/log", f"{at}/checkpoint")
    end("request_id string, question string, confidence string", ("end", "end", "end")).write.mode("append").parquet(f"{at}/answers")
    end("request_id string, verdict string", ("end", "end")).write.mode("append").parquet(f"{at}/feedback")
    joined.follow(spark, f"{at}/answers", f"{at}/feedback", f"{at}/log", f"{at}/checkpoint")
    return joined.verdicts(spark.read.parquet(f"{at}/log").where("question <> 'end'"))


QUERIES = {f.__name__: f for f in (bm25_segments, bm25_three_words, regex_search, name_pairs, collapse_in_merge, dense_cells, crawl_state_stream, counts_kept, feedback_join)}
_LEX = "SELECT id AS doc_id, round(bm25_score, 6) AS bm25_score, lexical_score, rank FROM lex"
SQL = {
    "bm25_segments": """WITH live AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN text || ' under that under' ELSE text END AS text FROM documents WHERE source IS NULL OR source NOT IN ('src1', 'src3')),"""
    + _BM25.format(k=15).replace("FROM documents", "FROM live") + _LEX,
    "bm25_three_words": "WITH " + _BM25.format(k=10).replace(QUERY, THREE) + _LEX,
    "regex_search": "SELECT pattern, doc_id FROM documents, (SELECT unnest([" + ", ".join(f"'{p}'" for p in PATTERNS) + "]) AS pattern) WHERE regexp_matches(text, pattern, 'i')",
    "name_pairs": """WITH n AS (SELECT c_name AS "of", lower(c_name) AS form, lower(c_name) AS last FROM customer UNION ALL SELECT s_name, 'ann ' || lower(s_name), lower(s_name) FROM supplier),
a AS (SELECT s_suppkey, 'customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '; bo ' || lower(s_name) AS author FROM supplier UNION ALL SELECT -1 - s_suppkey, 'customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') FROM supplier),
w AS (SELECT s_suppkey, unnest(regexp_split_to_array(author, '[ ;]+')) AS word FROM a),
p AS (SELECT "of", s_suppkey, true AS exact FROM n JOIN a ON form = author UNION ALL SELECT DISTINCT "of", s_suppkey, false FROM n JOIN w ON last = word WHERE length(word) >= 4)
SELECT "of", s_suppkey, bool_or(exact) AS exact FROM p GROUP BY ALL""",
    "collapse_in_merge": """WITH d AS (SELECT doc_id, text, doc_id // 2 AS address, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS updated_at FROM documents),
one AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY address ORDER BY length(coalesce(text, '')) DESC, updated_at DESC) = 1),
again AS (SELECT doc_id, text || ' and more' || text AS text, address, '1' || updated_at AS updated_at FROM d WHERE doc_id % 5 = 0),
late AS (SELECT doc_id, 'late' AS text, address, '' AS updated_at FROM d WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM one) AND doc_id % 5 <> 0),
two AS (SELECT * FROM one WHERE doc_id NOT IN (SELECT doc_id FROM again) UNION ALL SELECT * FROM again UNION ALL SELECT * FROM late)
SELECT doc_id, md5(text) AS h, updated_at FROM two QUALIFY row_number() OVER (PARTITION BY address ORDER BY length(coalesce(text, '')) DESC, updated_at DESC) = 1""",
    "crawl_state_stream": """WITH f AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, status, h) AS n FROM (
    SELECT user_id, ts, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' AND value < 20 THEN 'gone' WHEN event_type = 'signup' THEN 'not_modified' ELSE 'ok' END AS status,
      CASE WHEN event_type NOT IN ('error', 'signup') THEN event_type END AS h FROM events)),
ended AS (SELECT user_id, coalesce(max(n) FILTER (status = 'gone'), 0) AS e FROM f GROUP BY user_id),
begun AS (SELECT user_id, min(n) AS b FROM f JOIN ended USING (user_id) WHERE n > e AND status = 'ok' GROUP BY user_id),
alive AS (SELECT f.* FROM f JOIN begun USING (user_id) WHERE n >= b),
ok AS (SELECT *, lag(h) OVER (PARTITION BY user_id ORDER BY n) AS before FROM alive WHERE status = 'ok'),
last AS (SELECT user_id, arg_max(h, n) AS content_hash, min(ts) AS first_seen, max(ts) FILTER (before IS NULL OR before <> h) AS last_changed FROM ok GROUP BY user_id)
SELECT user_id, content_hash, strftime(first_seen, '%Y-%m-%d %H:%M:%S.%f') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_seen, strftime(last_changed, '%Y-%m-%d %H:%M:%S.%f') AS last_changed
FROM alive JOIN last USING (user_id) GROUP BY ALL""",
    "counts_kept": """SELECT CASE WHEN lang = 'fr' THEN 'french' ELSE source END AS source, count(*) AS n, count(DISTINCT md5(text)) + CASE WHEN count(*) > count(text) THEN 1 ELSE 0 END AS texts
FROM documents WHERE length(text) IS NULL OR length(text) <= 5000 GROUP BY 1""",
    "feedback_join": """WITH f AS (SELECT event_id - 1 AS request, ts AS came, CASE WHEN event_type = 'error' THEN 'down' ELSE 'up' END AS verdict FROM events WHERE event_type IN ('error', 'purchase'))
SELECT event_type AS confidence, coalesce(verdict, 'none') AS verdict, count(*) AS n FROM events e LEFT JOIN f ON request = event_id AND came >= ts AND came <= ts + INTERVAL 1 HOUR GROUP BY ALL""",
}
