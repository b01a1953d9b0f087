"""JSON Lines and other file sources and sinks, and the normalisation of raw documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions import dates
from docspark.functions import text as X
from docspark.functions.dates import date_from_dashed_path
from docspark.functions.urls import content_hash
from docspark.settings import SOURCE_NAMES

DOCUMENT = "document_id string, url_hash string, page_id string, original_url string, url string, canonical_url string, title string, subtitle string, author string, authors array<string>, date string, updated_date string, category string, section string, tags array<string>, breadcrumbs array<string>, language string, document_type string, source string, source_name string, source_type string, text string, text_length int, content_hash string, pdf_urls array<string>, pdf_url string, pdf_pages array<struct<page_number: int, text: string>>, discovery_method string, extraction_method string, scraped_at string, updated_at string"
#: Names under which raw records carry a field, in order of preference.
ALIASES = {
    "document_id": ("document_id", "id", "url_hash"), "url": ("url", "original_url", "page_url", "link"), "text": ("text", "content", "body"), "title": ("title", "name", "heading"),
    "author": ("author", "byline"), "date": ("date", "published", "published_date"), "source": ("source", "source_type"), "category": ("category", "section"), "document_type": ("document_type", "type"),
}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def read_jsonl(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """Records of a JSON Lines file; a missing file is an empty table, lines that aren't JSON are skipped."""
    kind = T._parse_datatype_string(schema)
    if not _exists(spark, path):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).option("mode", "DROPMALFORMED").json(path)


def malformed_lines(spark: SparkSession, path: str) -> int:
    """How many lines aren't JSON, which ``read_jsonl`` skips; blank lines don't count."""
    return spark.read.text(path).where("trim(value) <> '' and try_parse_json(value) is null").count()


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Flat columns with a header; lists are joined by semicolons."""
    flat = [F.concat_ws("; ", F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.StructType, T.MapType))]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def normalize(raw: DataFrame, source: str = "local", prefix: str = "doc", order: str | None = None) -> DataFrame:
    """Raw records to documents: aliases resolved once, text cleaned, dates parsed (from the address where missing), empty texts left out.

    Ids that are missing become ``prefix_0001`` and so on in the given order (a record's
    content decides without one).
    """
    have = set(raw.columns)
    pick = lambda f: X.first_of(*[F.col(c).cast("string") for c in ALIASES[f] if c in have]) if any(c in have for c in ALIASES[f]) else F.lit(None).cast("string")
    authors = X.blank_to_null(F.element_at("authors", 1)) if "authors" in have else F.lit(None).cast("string")
    out = raw.withColumns({f"__{f}": pick(f) for f in ALIASES})
    text = X.clean_text(F.coalesce("__text", F.lit("")))
    url = F.coalesce("__url", F.lit(""))
    date = F.coalesce(X.blank_to_null(dates.parse_date(F.col("__date"))), X.blank_to_null(date_from_dashed_path(url)), F.lit(""))
    src = F.coalesce("__source", F.lit(source))
    names = F.create_map(*[F.lit(x) for kv in SOURCE_NAMES.items() for x in kv])
    docs = out.select(
        F.col("__document_id").alias("document_id"), url.alias("url"), F.coalesce("__title", F.lit("Untitled")).alias("title"), F.coalesce("__author", authors, F.lit("")).alias("author"), date.alias("date"),
        F.coalesce("__category", F.lit("")).alias("category"), F.coalesce("__document_type", F.lit("")).alias("document_type"), src.alias("source"), F.coalesce(F.try_element_at(names, F.lower(src)), src).alias("source_name"),
        text.alias("text"), F.length(text).alias("text_length"), content_hash(text).alias("content_hash"), *([F.col(order).alias("__order")] if order else []),
    ).where("text <> ''")
    # only records without an id are numbered
    known, missing = docs.where("document_id is not null"), docs.where("document_id is null")
    rank = _numbered(missing, [F.col("__order")] if order else [F.col("content_hash"), F.col("url")], order is not None)
    named = rank.withColumn("document_id", F.concat(F.lit(f"{prefix}_"), F.when(F.col("__n") < 10_000, F.lpad(F.col("__n").cast("string"), 4, "0")).otherwise(F.col("__n").cast("string"))))
    return known.unionByName(named.drop("__n")).drop("__order")


def _numbered(rows: DataFrame, by: list[Column], given: bool, blocks: int = 256) -> DataFrame:
    """``rows`` with ``__n``, their place from 1 in the order of ``by``.

    No task gets all rows: they fall into blocks that follow the order, each is numbered
    alone, and the counts of the blocks before (``blocks`` rows for numbers, as many as there are
    beginnings of two characters for text) are added.
    """
    first = by[0]
    kind = dict(rows.dtypes)["__order"] if given else "string"
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp") or kind.startswith("decimal"):
        value = F.unix_date(first).cast("double") if kind == "date" else first.cast("double")
        cuts = rows.select(F.percentile_approx(value, [i / blocks for i in range(1, blocks)], 100 * blocks)).first()[0] or []
        block = F.when(value.isNull(), -1).otherwise(F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(cuts))]), lambda x: x < value)) if cuts else F.lit(0))
    else:
        block = F.coalesce(F.substring(first.cast("string"), 1, 2), F.lit(""))
    placed = rows.withColumn("__block", block)
    sizes = placed.groupBy("__block").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__block", (F.sum("n").over(W.orderBy("__block")) - F.col("n")).alias("__before"))
    own = F.row_number().over(W.partitionBy("__block").orderBy(*by))
    return placed.withColumn("__own", own).join(before, "__block").withColumn("__n", F.col("__own") + F.col("__before")).drop("__block", "__own", "__before")


def with_pdf_pages(rows: DataFrame, pages: str = "pdf_pages") -> DataFrame:
    """Documents whose text, where empty, is that of their extracted pages."""
    whole = F.array_join(F.transform(pages, lambda p: F.coalesce(p["text"], F.lit(""))), "\n\n")
    return rows.withColumn("text", F.coalesce(X.blank_to_null(F.col("text")), X.blank_to_null(whole), F.lit("")))


def enrich(docs: DataFrame) -> DataFrame:
    """Fill missing dates, authors and categories from the address and the text."""
    from docspark.functions.entities import author_from_text
    from docspark.functions.dates import date_from_plain_path
    from docspark.functions.urls import category_of

    url, text = F.col("url"), F.col("text")
    found = {
        "date": X.first_of(F.col("date"), date_from_dashed_path(url), date_from_plain_path(url), dates.date_from_text(text)),
        "author": X.first_of(F.col("author"), author_from_text(text)),
        "category": X.first_of(F.col("category"), category_of(url)),
    }
    return docs.withColumns({k: F.coalesce(v, F.lit("")) for k, v in found.items()})
