"""Checks of a document and chunk table, as rows ``severity, check, n``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import blank_to_null
from docspark.functions.urls import canonical
from docspark.settings import DEFAULT, Settings


def _none(c: Column) -> Column:
    return blank_to_null(c.cast("string")).isNull()


def duplicates(df: DataFrame, key: Column) -> DataFrame:
    """Values that stand in more than one row, with their counts."""
    return df.groupBy(key.alias("value")).agg(F.count(F.lit(1)).alias("n")).where("value is not null and n > 1")


def _report(row: DataFrame, checks: list[tuple[str, str]]) -> DataFrame:
    """The columns of a one-row frame as rows."""
    args = ", ".join(f"'{severity}', '{name}', cast(`{name}` as bigint)" for severity, name in checks)
    return row.selectExpr(f"stack({len(checks)}, {args}) as (severity, check, n)")


def validate(docs: DataFrame, chunks: DataFrame, local_sources: tuple[str, ...] = ("local", "staff_handbook"), settings: Settings = DEFAULT) -> DataFrame:
    """All checks: one aggregation over each table, one more for each kind of duplicate (each reads its own columns alone), one anti-join for orphans.

    ``docs``: ``document_id, url, title, author, date, source, text``; ``chunks``:
    ``chunk_id, document_id, title, text, meta_header, chunk_hash``.
    """
    local = F.lower(F.coalesce("source", F.lit(""))).isin(*local_sources)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    of_docs = docs.agg(
        F.count(F.lit(1)).alias("documents"), n(_none(F.col("document_id"))).alias("missing_id"), n(_none(F.col("text"))).alias("empty_text"),
        n(_none(F.col("url")) & ~local).alias("missing_url"), n(_none(F.col("url")) & local).alias("local_without_url"),
        n(_none(F.col("title"))).alias("missing_title"), n(_none(F.col("author"))).alias("missing_author"), n(_none(F.col("date"))).alias("missing_date"),
    )
    size = F.length(F.coalesce("text", F.lit("")))
    of_chunks = chunks.agg(
        F.count(F.lit(1)).alias("chunks"), n(size > int(2.2 * settings.chunk_size)).alias("oversized_chunks"), n(size < max(40, settings.chunk_min)).alias("undersized_chunks"),
        n(_none(F.col("meta_header"))).alias("chunks_without_header"), n(_none(F.col("title"))).alias("chunks_without_title"),
        (F.count("chunk_hash") - F.countDistinct("chunk_hash")).alias("duplicate_chunks"),
    )
    address = F.when(~_none(F.col("url")), canonical(F.col("url")))
    same_url = duplicates(docs, address).agg(F.count(F.lit(1)).alias("duplicate_urls"))
    same_text = duplicates(docs, F.when(~_none(F.col("text")), F.sha2("text", 256))).agg(F.count(F.lit(1)).alias("duplicate_texts"))
    same_id = duplicates(docs, F.col("document_id").cast("string")).agg(F.count(F.lit(1)).alias("duplicate_ids"))
    lost = orphans(chunks, docs).agg(F.count(F.lit(1)).alias("orphan_chunks"))
    parts = [
        _report(of_docs, [("info", "documents"), ("error", "missing_id"), ("error", "empty_text"), ("error", "missing_url"), ("warning", "local_without_url"), ("warning", "missing_title"), ("warning", "missing_author"), ("warning", "missing_date")]),
        _report(of_chunks, [("info", "chunks"), ("warning", "oversized_chunks"), ("warning", "undersized_chunks"), ("warning", "chunks_without_header"), ("warning", "chunks_without_title"), ("warning", "duplicate_chunks")]),
        _report(same_url, [("error", "duplicate_urls")]), _report(same_text, [("warning", "duplicate_texts")]), _report(same_id, [("error", "duplicate_ids")]), _report(lost, [("error", "orphan_chunks")]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphans(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks whose document isn't there."""
    return chunks.join(docs.select("document_id"), "document_id", "left_anti")


def passed(report: DataFrame) -> DataFrame:
    """One row: ``ok`` if no error has a count, with the numbers of failed checks."""
    bad = lambda s: F.count_if((F.col("severity") == s) & (F.col("n") > 0))
    return report.agg((bad("error") == 0).alias("ok"), bad("error").alias("errors"), bad("warning").alias("warnings"))
