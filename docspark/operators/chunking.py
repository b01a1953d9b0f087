"""Documents to overlapping chunks of whole sentences."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from docspark.functions import text as T
from docspark.functions.urls import content_hash
from docspark.settings import DEFAULT, Settings
from docspark.sources.shared import bound_batches


def sentences(c: Column) -> Column:
    """Sentence-like units: split at line ends and after . ! ? before white space."""
    parts = F.split(F.regexp_replace(c, "[ \t]+", " "), r"\n+|(?<=[.!?])\s+")
    return F.filter(F.transform(parts, T.strip), lambda s: s != "")


def _sums(parts: list[str]) -> list[int]:
    """Where each part begins if one character stands behind each."""
    return list(accumulate((len(p) + 1 for p in parts), initial=0))


def _reach(sums: list[int], begin: int, room: int) -> int:
    """The end of the longest run of parts from ``begin`` that takes ``room`` at most."""
    return bisect_right(sums, sums[begin] + room) - 1


def by_words(sentence: str, size: int) -> list[str]:
    """A sentence in runs of words of ``size`` characters at most; a longer word is a run of its own."""
    words = sentence.split(" ")
    sums, out, at = _sums(words), [], 0
    while at < len(words):
        end = max(at + 1, _reach(sums, at, size + 1))
        out.append(" ".join(words[at:end]))
        at = end
    return out


def pack(units: list[str], size: int = DEFAULT.chunk_size, overlap: int = DEFAULT.chunk_overlap, least: int = DEFAULT.chunk_min) -> list[str]:
    """Chunks of whole sentences under a soft limit, each beginning with the last sentences of the one before.

    A chunk is a range of units, so its end and the start of the next follow by binary
    search in the sums of their lengths (a space behind each). It ends before the unit that
    would make it longer than ``size``; the next one begins with the longest tail of units
    that takes ``overlap`` at most, and always takes that unit. A sentence above the limit
    ends the chunk before it; its full runs of words are chunks of their own, and the last
    run is a unit behind the tail, from which the limit counts anew. Chunks below ``least``
    and chunks equal to the one before are left out.
    """
    parts: list[str] = []
    cuts: list[tuple[int, list[str]]] = []
    for u in units:
        if len(u) > size:
            *full, u = by_words(u, size)
            cuts.append((len(parts), full))
        parts.append(u)
    sums, out = _sums(parts), []

    def give(length: int, chunk: str) -> None:
        if length >= least and (not out or out[-1] != chunk):
            out.append(chunk)

    def give_range(a: int, b: int) -> None:
        chunk = " ".join(parts[a:b]).strip()
        give(len(chunk), chunk)

    def tail(a: int, b: int) -> int:
        return max(a, bisect_left(sums, sums[b] - overlap))

    begin = end = 0
    limit = size  # the sum that the chunk's end may reach
    for stop, full in [*cuts, (len(parts), [])]:
        must = begin == end  # the next unit goes in whatever its length
        while end < stop:
            end = min(stop, max(end + must, bisect_right(sums, limit) - 1))
            must = False
            if end < stop:
                give_range(begin, end)
                begin = tail(begin, end)
                limit, must = sums[begin] + size, True
        if stop < len(parts):
            if begin < end:
                give_range(begin, end)
                begin = tail(begin, end)
            for run in full:
                give(len(run), run.strip())
            end = stop + 1
            limit = sums[stop] + 1 + size
    if begin < end:
        give_range(begin, end)
    return out


#: The last character of a unit, and the white space behind it; its first class is what a scan looks for.
_UNIT_END = re.compile(r"([.!?\n])(?:(?<=\n)|\s+)")


def units_of(text: str) -> list[str]:
    """``sentences`` of one text."""
    parts = _UNIT_END.split(T.shortened(text.replace("\t", " "), "  ", " "))
    return [s for s in (*(u.strip() for u in map(str.__add__, parts[::2], parts[1::2])), parts[-1].strip()) if s]


def packed(text: Column, settings: Settings = DEFAULT) -> Column:
    """Pieces of a text with their quality: lines cleaned, sentences split and packed."""
    size, overlap, least, lines = settings.chunk_size, settings.chunk_overlap, settings.chunk_min, settings.line_quality_min

    @pandas_udf("array<struct<text: string, quality: double>>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: [{"text": p, "quality": T.quality(p)} for p in pack(units_of(T.without_garbage(t, lines)), size, overlap, least)] if isinstance(t, str) else [])

    return run(text)


def chunk_documents(docs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Chunks of documents (``document_id, text`` and any metadata; ``pdf_pages`` if present).

    Text is cleaned line by line, split, packed and filtered by quality; ids count the packed
    pieces, so a dropped piece leaves a gap. Documents with pages are chunked page by page.
    ``ord`` is the position in document order and decides which of equal chunks stays.
    """
    bound_batches(docs.sparkSession)
    paged = "pdf_pages" in docs.columns
    body = F.struct(F.lit(None).cast("int").alias("page_number"), F.col("text").alias("text"))
    units = F.when(F.size("pdf_pages") > 0, F.col("pdf_pages")).otherwise(F.array(body)) if paged else F.array(body)
    rows = docs.withColumn("__unit", F.explode(units)).withColumns({"page_number": F.col("__unit.page_number"), "__text": T.clean_text(F.coalesce(F.col("__unit.text"), F.lit("")))})
    rows = rows.withColumn("__pieces", packed(F.col("__text"), settings))
    kept = [c for c in docs.columns if c not in ("text", "pdf_pages")]
    # without "outer" Spark asks first whether there are pieces, and packs each text twice; rows without any have no quality
    pieces = rows.select(*kept, "page_number", F.posexplode_outer("__pieces").alias("chunk_index", "__p")).select(*kept, "page_number", "chunk_index", "__p.text", "__p.quality")
    pieces = pieces.where(F.col("quality") >= settings.quality_min)
    page = F.when(F.col("page_number").isNotNull(), F.concat(F.lit("_p"), F.col("page_number").cast("string"))).otherwise(F.lit(""))
    pieces = pieces.withColumn("chunk_id", F.concat(F.col("document_id").cast("string"), page, F.lit("_c"), F.col("chunk_index").cast("string")))
    fields = {c: F.col(c) for c in ("title", "subtitle", "author", "date", "updated_date", "category", "section", "document_type", "source_name") if c in docs.columns}
    if "tags" in docs.columns:
        fields["tags"] = T.joined(F.col("tags"))
    header = T.meta_header(fields) if fields else F.lit("")
    pieces = pieces.withColumn("meta_header", header)
    return pieces.withColumns({"chunk_hash": content_hash(T.search_text(F.col("meta_header"), F.col("text"))), "chunk_order": F.col("chunk_index")})


def first_of_each(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a given order (the survivor never depends on partitions)."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__rank = 1").drop("__rank")


def drop_repeats(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before in their group."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(order))
    return df.withColumn("__before", before).where(~F.col(value).eqNullSafe(F.col("__before")) | F.col("__before").isNull()).drop("__before")
