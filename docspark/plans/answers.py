"""Queries of grounding and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import text as X
from docspark.operators import answer, grounding
from docspark.plans.retrieval import _t, corpus


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """An answer for every document, from all of its text: the second half with markers, over the first half as three sources."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = _t(spark, sf, "documents").select("doc_id", text.alias("text"), F.floor(F.length(text) / 2).cast("int").alias("half"))
    third, i = F.floor(F.col("half") / 3).cast("int"), (F.col("doc_id") % 5).cast("int").cast("string")
    said = F.substring("text", F.col("half") + 1, F.length("text"))
    marked = F.concat(said, F.lit(" [Source "), i, F.lit("]. Then [source 2] , and [ Source 9 ] [Source "), i, F.lit("]."))
    source = lambda s, start, n: F.struct(F.lit(s).alias("title"), F.substring("text", start, n).alias("text"))
    sources = F.array(source("a", F.lit(1), third), source("b", third + 1, third), source("c", 2 * third + 1, F.col("half") - 2 * third))
    return d.select("doc_id", F.when(F.col("doc_id") % 6 == 0, said).otherwise(marked).alias("answer"), sources.alias("sources"))


def citation_parse(spark: SparkSession, sf: str) -> DataFrame:
    numbers = lambda c: F.array_join(c.cast("array<string>"), ",")
    return _answers(spark, sf).select("doc_id", numbers(grounding.cited(F.col("answer"))).alias("cited"), numbers(grounding.valid_citations(F.col("answer"), F.lit(3))).alias("valid"))


def grounding_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """The share of a text's first half that stands in its second."""
    half = F.floor(F.length("text") / 2).cast("int")
    rows = _t(spark, sf, "documents").select("doc_id", F.substring("text", F.lit(1), half).alias("a"), F.substring("text", half + 1, F.length("text")).alias("b"))
    return rows.select("doc_id", F.round(X.overlap_ratio(F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))), 6).alias("overlap"))


def verify_citations(spark: SparkSession, sf: str) -> DataFrame:
    got = grounding.verify(_answers(spark, sf))
    return got.select("doc_id", "grounded", F.size("kept").cast("long").alias("kept"), F.col("dropped_uncited").cast("long").alias("dropped"), F.size(grounding.cited(F.col("answer"))).cast("long").alias("markers"))


def citation_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """The answers with their markers renumbered."""
    rows = _answers(spark, sf)
    return rows.select("doc_id", F.md5(grounding.renumbered(F.col("answer"), grounding.valid_citations(F.col("answer"), F.lit(3)))).alias("answer"))


def context_pack(spark: SparkSession, sf: str) -> DataFrame:
    got = grounding.context_pack(_t(spark, sf, "documents").select("source", "doc_id", "text"), ["source"], "doc_id", "text")
    return got.select("source", "doc_id", F.length("text").cast("long").alias("chars"))


def doc_text_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts of eight neighbours and one language as one document, whose number grows with the table's."""
    rows = _t(spark, sf, "documents").select("lang", F.floor(F.col("doc_id") / 8).alias("document"), F.col("doc_id").alias("position"), "text")
    got = grounding.merge_documents(rows, ["lang"], "document", "position", "text")
    return got.select("lang", "document", "position", F.md5("text").alias("text"))


def cited_sources(spark: SparkSession, sf: str) -> DataFrame:
    shown = grounding.displayed_sources(F.col("answer"), F.col("sources"))
    return _answers(spark, sf).select("doc_id", F.array_join(F.transform(shown, lambda s: s["title"]), ",").alias("shown"))


def followup_fallback(spark: SparkSession, sf: str) -> DataFrame:
    got = answer.follow_up(_t(spark, sf, "conversations"))
    return got.select("conv_id", F.md5("resolved").alias("resolved"))


def answer_contract(spark: SparkSession, sf: str) -> DataFrame:
    """One whole answer over the documents as chunks, with hashed vectors and the extractive generator."""
    kb = answer.KnowledgeBase.build(corpus(spark, sf), dim=32)
    return kb.answer("What is worthless about the thing with nicht?").drop("request_id", "latency_ms", "retrieval_ms", "generation_ms")


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A chat's suggestions for the first document of each source."""
    first = corpus(spark, sf).groupBy("source").agg(F.min_by("title", "id").alias("title"))
    return first.select("source", F.md5(F.array_join(answer.suggestions(F.col("title"), F.col("source")), "|")).alias("suggestions"))


QUERIES = {f.__name__: f for f in (citation_parse, grounding_overlap, verify_citations, citation_rewrite, context_pack, doc_text_merge, cited_sources, followup_fallback, answer_contract, run_summary)}
_TOK = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: NOT list_contains(['" + "', '".join(X.GROUNDING_STOP) + "'], t)))"
_HALF = "CAST(length(coalesce(text, '')) // 2 AS BIGINT)"
_FIRST, _SECOND = f"substr(coalesce(text, ''), 1, {_HALF})", f"substr(coalesce(text, ''), {_HALF} + 1)"
_THIRDS = f"substr({_FIRST}, 1, {_HALF} // 3) || ' ' || substr({_FIRST}, {_HALF} // 3 + 1, {_HALF} // 3) || ' ' || substr({_FIRST}, 2 * ({_HALF} // 3) + 1)"
_A = """a AS (SELECT doc_id, text, CASE WHEN doc_id % 6 = 0 THEN [] WHEN doc_id % 5 = 2 THEN [2, 9] ELSE [doc_id % 5, 2, 9] END AS cited FROM documents),
v AS (SELECT *, list_filter(cited, lambda i: i BETWEEN 1 AND 3) AS valid FROM a)"""
SQL = {
    "citation_parse": "WITH " + _A + " SELECT doc_id, coalesce(array_to_string(cited, ','), '') AS cited, coalesce(array_to_string(valid, ','), '') AS valid FROM v",
    "grounding_overlap": f"""WITH t AS (SELECT doc_id, {_TOK.format(_FIRST)} AS a, {_TOK.format(_SECOND)} AS b FROM documents)
SELECT doc_id, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / len(a) END, 6) AS overlap FROM t""",
    "verify_citations": "WITH " + _A + f""", o AS (SELECT v.*, {_TOK.format(_SECOND)} AS w, {_TOK.format(_THIRDS)} AS c FROM v),
g AS (SELECT *, len(valid) > 0 OR (len(w) > 0 AND len(list_intersect(w, c))::DOUBLE / greatest(len(w), 1) >= 0.18) AS grounded FROM o)
SELECT doc_id, grounded, CAST(CASE WHEN len(valid) > 0 THEN len(valid) WHEN grounded THEN 1 ELSE 0 END AS BIGINT) AS kept, CAST(3 - CASE WHEN len(valid) > 0 THEN len(valid) WHEN grounded THEN 1 ELSE 0 END AS BIGINT) AS dropped, CAST(len(valid) AS BIGINT) AS markers FROM g""",
    "citation_rewrite": "WITH " + _A + f""", m AS (SELECT doc_id, {_SECOND} AS said, cited, list_transform([doc_id % 5, 2, 9], lambda i: CASE WHEN list_contains(valid, i) THEN '[Source ' || list_position(valid, i) || ']' ELSE '' END) AS k FROM v)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(said || CASE WHEN len(cited) = 0 THEN '' ELSE ' ' || k[1] || '. Then ' || k[2] || ' , and ' || k[3] || ' ' || k[1] || '.' END, '[ \\t]{{2,}}', ' ', 'g'), '\\s+([.,;:])', '\\1', 'g'), E' \\t\\n\\r')) AS answer FROM m""",
    "context_pack": """WITH w AS (SELECT source, doc_id, length(text) AS n, row_number() OVER x AS r, coalesce(sum(length(text)) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents WINDOW x AS (PARTITION BY source ORDER BY doc_id))
SELECT source, doc_id, CASE WHEN n > 12000 THEN 12001 ELSE n END AS chars FROM w WHERE r = 1 OR (before < 12000 AND before + n <= 12000)""",
    "doc_text_merge": """WITH t AS (SELECT lang, CAST(floor(doc_id / 8) AS BIGINT) AS document, doc_id, trim(coalesce(text, ''), E' \\t\\n\\r') AS t FROM documents),
f AS (SELECT lang, document, t, min(doc_id) AS p FROM t GROUP BY ALL), m AS (SELECT lang, document, min(doc_id) AS position FROM t GROUP BY ALL),
j AS (SELECT lang, document, string_agg(t, chr(10) || chr(10) ORDER BY p) AS s FROM f WHERE t <> '' GROUP BY ALL)
SELECT lang, document, position, md5(substr(coalesce(s, ''), 1, 4000)) AS text FROM m LEFT JOIN j USING (lang, document)""",
    "cited_sources": "WITH " + _A + " SELECT doc_id, CASE WHEN len(valid) = 0 THEN 'a' ELSE array_to_string(list_transform(valid, lambda i: ['a', 'b', 'c'][i]), ',') END AS shown FROM v",
    "followup_fallback": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations),
u AS (SELECT conv_id, turn, text FROM l WHERE n <= 6 AND lower(role) = 'user'), q AS (SELECT conv_id, arg_max(text, turn) AS q FROM u GROUP BY conv_id),
b AS (SELECT u.conv_id, arg_max(text, turn) AS b FROM u JOIN q ON u.conv_id = q.conv_id AND text <> q GROUP BY u.conv_id)
SELECT conv_id, md5(CASE WHEN b IS NULL THEN q ELSE q || ' (regarding: ' || b || ')' END) AS resolved FROM q LEFT JOIN b USING (conv_id)""",
    "run_summary": """WITH f AS (SELECT source, arg_min(substr(split_part(text, chr(10), 1), 1, 80), doc_id) AS t FROM documents GROUP BY source)
SELECT source, md5('What else does ' || t || ' say?|What are the main points of ' || t || '?|What else is there on ' || source || '?') AS suggestions FROM f""",
}
