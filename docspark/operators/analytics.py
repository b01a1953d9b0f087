"""Corpus, query-log and event analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import blank_to_null


def counts(df: DataFrame, *by: str, most: int | None = None) -> DataFrame:
    """Rows for each value, the most frequent first; ties by value."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return out if most is None else out.orderBy(F.desc("n"), *by).limit(most)


def exploded_counts(df: DataFrame, values: Column, most: int) -> DataFrame:
    """The most frequent members of a list column."""
    return counts(df.select(F.explode(values).alias("value")), "value", most=most)


def index_stats(chunks: DataFrame) -> DataFrame:
    """Chunks by source and by category, and over all, with their documents, in one pass (blank category: uncategorized)."""
    rows = chunks.withColumns({"source": F.col("source"), "category": F.coalesce(blank_to_null(F.col("category")), F.lit("uncategorized"))})
    out = rows.groupingSets([["source"], ["category"], []], "source", "category").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("document_id").alias("documents"), F.grouping_id().alias("level"))
    return out.select("source", "category", "chunks", "documents", F.col("level").cast("int").alias("level"))


def composition(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by two columns with subtotals."""
    return df.rollup(outer, inner).agg(F.count(F.lit(1)).alias("n"))


def coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """For each field the percentage of rows where it is known."""
    total = F.count(F.lit(1))
    row = df.agg(*[F.round(F.count_if(blank_to_null(F.col(f).cast("string")).isNotNull()) * 100.0 / F.greatest(total, F.lit(1)), 1).alias(f) for f in fields])
    args = ", ".join(f"'{f}', `{f}`" for f in fields)
    return row.selectExpr(f"stack({len(fields)}, {args}) as (field, percent)")


def facets(df: DataFrame, field: str) -> DataFrame:
    """Distinct known values in order."""
    v = blank_to_null(F.col(field))
    return df.select(v.alias("value")).where(v.isNotNull() & ~F.lower(v).isin("unknown", "n/a")).distinct()


def chunk_summary(chunks: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """One row: total, those of the priority source, mean and greatest length."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    return chunks.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.lower(source) == "commit_kb").alias("commit"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_chars"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_chars"))


def chunks_by_source(chunks: DataFrame, source: str = "source") -> DataFrame:
    """Chunks of each source; a blank one is unknown."""
    return counts(chunks.select(F.lower(F.coalesce(blank_to_null(F.col(source)), F.lit("unknown"))).alias("source")), "source")


def top_categories(log: DataFrame, most: int = 6) -> DataFrame:
    """The categories that answers of a query log were most often about."""
    known = log.select(blank_to_null(F.col("top_category")).alias("category")).where("category is not null")
    return counts(known, "category", most=most)


def explorer_filter(source: str | None = None, category: str | None = None, author: str | None = None, tag: str | None = None, year: str | None = None, kind: str | None = None) -> Column:
    """Filters over ``records.derived`` documents: source, category, year and kind equal, author and tag contained, case apart."""
    holds = lambda v: lambda x: F.lower(x).contains(v)
    out = F.lit(True)
    for name, value in (("doc_source", source), ("category", category), ("doc_year", year), ("doc_kind", kind)):
        if value:
            out = out & (F.lower(F.coalesce(F.col(name), F.lit(""))) == value.lower())
    for name, value in (("doc_authors", author), ("doc_tags", tag)):
        if value:
            out = out & F.array_contains(F.transform(name, holds(value.lower())), True)
    return out


def explore(df: DataFrame, text: str | None = None, where: Column | None = None, order: str = "document_id", page: int = 1, size: int = 100) -> DataFrame:
    """One page of documents whose title or text contains a phrase (as it is, case apart)."""
    out = df if where is None else df.where(where)
    if text:
        t = text.lower()
        out = out.where(F.lower("title").contains(t) | F.lower("text").contains(t))
    return out.orderBy(order).offset((page - 1) * size).limit(size)


def query_log_stats(log: DataFrame) -> DataFrame:
    """One row: queries, mean time, grounded and unanswered ones, and counts of each confidence."""
    n = lambda c: F.count_if(c).alias
    tier = F.lower("confidence")
    return log.agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg("elapsed"), 4).alias("avg_elapsed"), n(F.col("grounded"))("grounded"), n(~F.col("grounded"))("no_evidence"),
        *[n(tier == t)(f"conf_{t}") for t in ("high", "medium", "low", "none")],
    )


def latest(df: DataFrame, order: str, most: int) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(most)
