"""Sources of an answer: merging, packing, citations and whether they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.settings import DEFAULT, Settings

# The marker of a source in an answer, and the format that some titles end in.
MARKER = r"(?i)\[\s*Source\s*(\d+)\s*\]"
FORMAT_SUFFIX = r"(?i)\s*\[(?:pdf|html?)\]\s*$"
# What a marker that goes leaves behind: several spaces, and space before a stop.
GAPS = ((r"[ \t]{2,}", " "), (r"\s+(?=[.,;:])", ""))


def document_key(document_id: Column, title: Column, source: Column) -> Column:
    """A document's identity: its id, else its title (without a format suffix) and source."""
    named = F.regexp_replace(T.strip(F.coalesce(title, F.lit(""))), FORMAT_SUFFIX, "")
    bare = F.lower(F.regexp_replace(named, r"\s+", " "))
    by_title = F.concat(F.lit("t:"), bare, F.lit("|"), F.lower(T.strip(F.coalesce(source, F.lit("")))))
    return F.coalesce(F.concat(F.lit("id:"), T.blank_to_null(document_id.cast("string"))), by_title)


def merge_documents(hits: DataFrame, group: list[str], key: str, position: str, text: str, cap: int = DEFAULT.merge_cap) -> DataFrame:
    """One row for each document of a group, at its first position, with its distinct texts joined and capped."""
    # Whole texts are told apart, by a hash that is as good as the text; then only those that begin before the cap are gathered.
    t = T.strip(F.coalesce(F.col(text), F.lit("")))
    rows = hits.select(*group, key, F.col(position).alias("__p"), t.alias("__t"))
    rows = rows.select(*group, key, "__p", F.sha2("__t", 256).alias("__h"), F.length("__t").alias("__n"), F.substring("__t", 1, cap).alias("__t"))
    each = rows.groupBy(*group, key, "__h", "__n").agg(F.min(F.struct("__p", "__t")).alias("__m")).select(*group, key, "__h", "__n", "__m.*")
    w = W.partitionBy(*group, key).orderBy("__p", "__t", "__h").rowsBetween(W.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(F.when(F.col("__n") > 0, F.col("__n") + 2)).over(w), F.lit(0))
    # a text that begins at the cap or one behind still has its line ends, which stand before it, below the cap
    shown = F.when((F.col("__n") > 0) & (F.col("__taken") < cap + 2), F.struct("__p", "__t", "__h"))
    both = each.withColumn("__taken", taken).groupBy(*group, key).agg(F.min("__p").alias(position), F.array_sort(F.collect_list(shown)).alias("__all"))
    return both.select(*group, key, position, F.substring(F.array_join(F.transform("__all", lambda x: x["__t"]), "\n\n"), 1, cap).alias(text))


def context_pack(blocks: DataFrame, group: list[str], position: str, text: str, budget: int = DEFAULT.max_context_chars) -> DataFrame:
    """Blocks that fit a budget of characters in order: the first is cut if it alone is too long, the rest end before the first that doesn't fit."""
    w = W.partitionBy(*group).orderBy(position) if group else W.orderBy(position)
    n = F.length(text)
    # what is taken so far; a first block that is cut takes more than the budget, so none follows it
    rows = blocks.withColumns({"__first": F.row_number().over(w) == 1, "__before": F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    rows = rows.withColumn("__fits", F.col("__first") | ((F.col("__before") < budget) & (F.col("__before") + n <= budget)))
    rows = rows.where("__fits")
    return rows.withColumn(text, F.when(n > budget, F.concat(F.substring(text, 1, budget), F.lit("…"))).otherwise(F.col(text))).drop("__first", "__before", "__fits")


def source_header(fields: dict[str, Column], number: Column) -> Column:
    """The line above a source's text in the context: its number and title and what else is known of it."""
    parts = [F.concat(F.lit("[Source "), number.cast("string"), F.lit("] "), F.coalesce(fields.get("title", F.lit(None)), F.lit("Untitled")))]
    for name, label in (("author", "author"), ("date", "published"), ("updated_date", "updated")):
        if name in fields:
            parts.append(F.concat(F.lit(f"{label}: "), T.blank_to_null(fields[name])))
    parts.append(F.concat(F.lit("category: "), F.coalesce(T.blank_to_null(fields["category"]) if "category" in fields else F.lit(None), F.lit("—"))))
    for name in ("section", "tags"):
        if name in fields:
            parts.append(F.concat(F.lit(f"{name}: "), T.blank_to_null(fields[name])))
    parts.append(F.concat(F.lit("source: "), F.coalesce(fields.get("source_name", F.lit("")), F.lit(""))))
    parts.append(F.concat(F.lit("url: "), F.coalesce(fields.get("url", F.lit("")), F.lit(""))))
    return F.concat_ws(" | ", *parts)


def numbered_blocks(sources: DataFrame, position: str, text: str, fields: dict[str, Column]) -> DataFrame:
    """``sources`` with ``block``: the line that names a source, by its place in the order, above its text."""
    number = F.row_number().over(W.orderBy(position))  # over the few sources of one answer
    return sources.withColumn("block", F.concat(source_header(fields, number), F.lit("\n"), F.col(text)))


def _numbers(answer: Column) -> Column:
    """The number in each marker; null where it is too large for a source."""
    return F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(MARKER), F.lit(1)), lambda x: x.try_cast("int"))


def cited(answer: Column) -> Column:
    """The distinct source numbers of an answer in the order of their first marker."""
    return F.array_distinct(F.array_compact(_numbers(answer)))


def valid_citations(answer: Column, n: Column) -> Column:
    return F.filter(cited(answer), lambda i: (i >= 1) & (i <= n))


def renumbered(answer: Column, order: Column) -> Column:
    """Markers by their place in ``order``; markers outside it are taken out, with the spaces they leave."""
    between = F.split(answer, MARKER, -1)
    places = F.transform(_numbers(answer), lambda n: F.array_position(order, n))
    marker = lambda k: F.when(k > 0, F.concat(F.lit("[Source "), k.cast("string"), F.lit("]"))).otherwise("")
    out = F.array_join(F.zip_with(between, places, lambda text, k: F.concat(text, F.coalesce(marker(k), F.lit("")))), "")
    for gap, by in GAPS:
        out = F.regexp_replace(out, gap, by)
    return T.strip(out)


def verify(answers: DataFrame, answer: str = "answer", sources: str = "sources", settings: Settings = DEFAULT) -> DataFrame:
    """Answers (with ``sources: array<struct<text, ...>>``) checked against their sources.

    Adds ``cited, kept, grounded, overlap, dropped_uncited`` and the rewritten answer. With
    valid citations exactly the cited sources stay; without any, an answer that shares enough
    tokens with the sources keeps the first one, and any other is not grounded.
    """
    n = F.size(F.coalesce(F.col(sources), F.array()))
    overlap = T.overlap_ratio(F.col(answer), F.array_join(F.transform(sources, lambda s: F.coalesce(s["text"], F.lit(""))), " "))
    rows = answers.withColumns({"cited": valid_citations(F.col(answer), n), "overlap": overlap})
    has = F.size("cited") > 0
    grounded = has | (F.col("overlap") >= settings.grounding_min_overlap)
    kept = F.when(has, F.transform("cited", lambda i: F.element_at(sources, i))).when(grounded & (n > 0), F.slice(sources, 1, 1)).otherwise(F.slice(sources, 1, 0))
    rows = rows.withColumns({"grounded": grounded, "kept": kept, answer: F.when(has, renumbered(F.col(answer), F.col("cited"))).otherwise(T.strip(F.coalesce(F.col(answer), F.lit(""))))})
    return rows.withColumn("dropped_uncited", n - F.size("kept"))


def displayed_sources(visible: Column, sources: Column) -> Column:
    """The sources that the visible text cites; without a marker the first one."""
    order = F.filter(cited(visible), lambda i: (i >= 1) & (i <= F.size(sources)))
    return F.when(F.size(order) > 0, F.transform(order, lambda i: F.element_at(sources, i))).otherwise(F.slice(sources, 1, 1))
