"""Records of documents and chunks: cleaning by field class, several sources as one, derived columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from docspark.functions import text as X
from docspark.functions import urls
from docspark.functions.dates import year_of
from docspark.functions.entities import plausible_person
from docspark.operators.merge import changed_only
from docspark.settings import SOURCE_NAMES, SOURCE_PRIORITY
from docspark.sources import jsonl

# Fields that hold text, addresses, and long texts.
TEXT_FIELDS = "title text content source source_name category author date snippet description summary excerpt".split()
URL_FIELDS = "url page_url original_url pdf_url source_url link".split()


def clean_value(c: Column, kind: T.DataType) -> Column:
    """Any value as clean text: null is empty, the members of a list have spaces between, everything else is its text, repaired."""
    if isinstance(kind, T.ArrayType):
        c = F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    elif isinstance(kind, T.MapType):
        c = F.array_join(F.transform(F.map_values(c), lambda x: x.cast("string")), " ")
    return X.clean_broken(c.cast("string"))


def _repaired_list(c: Column) -> Column:
    @pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda v: None if v is None else [X.whitespace_normalized(X.repair(x)) if isinstance(x, str) and X.broken(x) else x for x in v])

    return run(c)


def clean_record(df: DataFrame) -> DataFrame:
    """Every field cleaned as its name and type ask for, in one select.

    Addresses are repaired and trimmed, text fields repaired and their white space made
    normal; other strings and lists of strings are touched only where they are broken. All
    other types, and nulls of text fields, stay as they are.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            if f.name in URL_FIELDS:
                c = urls.clean_url(c)
            else:
                must = F.lit(True) if f.name in TEXT_FIELDS else X.is_broken(c)
                c = F.when(c.isNotNull() & must, X.clean_broken(c)).otherwise(c)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = _repaired_list(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """The deltas of several sources as one table; ``source`` is the part's name where a row has none, missing columns are null."""
    whole = None
    for name, df in parts.items():
        own = F.coalesce(X.blank_to_null(F.col("source")), F.lit(name)) if "source" in df.columns else F.lit(name)
        df = df.withColumn("source", own)
        whole = df if whole is None else whole.unionByName(df, allowMissingColumns=True)
    if whole is None:
        raise ValueError("no source is given")
    return whole


def local_documents(spark: SparkSession, files: list[tuple[str, str, str]], known: DataFrame, schema: str = jsonl.DOCUMENT) -> DataFrame:
    """Documents of files kept by hand (``path, source, source_name``) that are new or whose text has changed.

    A document without an id has one from its source and the hash of its address (else of
    its text). A missing file has no documents. ``known``: ``document_id, content_hash``.
    """
    parts = []
    for path, source, name in files:
        rows = jsonl.read_jsonl(spark, path, schema)
        rows = rows.withColumns({"source": X.first_of(F.col("source"), F.lit(source)), "source_name": X.first_of(F.col("source_name"), F.lit(name)), "content_hash": urls.content_hash(F.coalesce("text", F.lit("")))})
        own = F.concat(F.lit(f"{source}_"), urls.content_hash(F.coalesce(X.blank_to_null(F.col("url")), F.col("text"), F.lit(""))))
        parts.append(rows.withColumn("document_id", F.coalesce(X.blank_to_null(F.col("document_id")), own)))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return changed_only(whole, known, "document_id", "content_hash")


def source_of(source: Column, source_type: Column) -> Column:
    """A document's source in lower case, else its type, else ``local``."""
    return F.lower(X.first_of(source, source_type, F.lit("local")))


def source_display(source: Column) -> Column:
    """A source's name for people: the known one, else its words with capitals."""
    known = F.create_map(*[F.lit(x) for kv in SOURCE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(source)), F.initcap(F.replace(source, F.lit("_"), F.lit(" "))))


def not_people(docs: DataFrame) -> DataFrame:
    """One row, ``names``: the authors of some documents, in lower case, that are a category, tag or kind of any of them.

    Authors and terms meet in a join of distinct values, so only what both have comes together.
    """
    rows = _derived(docs, None)
    low = lambda c: F.lower(X.strip(c)).alias("term")
    parts = [rows.select(F.explode(F.transform("doc_tags", lambda t: F.lower(X.strip(t)))).alias("term")), rows.select(low(F.col("doc_kind")))]
    parts += [rows.select(low(F.col(c))) for c in ("category", "section") if c in docs.columns]
    terms = parts[0]
    for p in parts[1:]:
        terms = terms.unionByName(p)
    authors = rows.select(F.explode(F.transform("doc_authors", lambda a: F.lower(a))).alias("term")).distinct()
    return authors.join(terms.distinct(), "term", "left_semi").agg(F.collect_set("term").alias("names"))


def derived(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Columns for analytics: ``doc_source, source_display, doc_year, doc_tags, doc_authors`` and ``doc_kind`` of ``docs``.

    Authors are the plausible ones of the list, else the single author; of names that differ
    in case alone the first stays. With ``terms`` (the row of ``not_people``) names that are
    topics of the corpus are no authors.
    """
    if terms is None:
        return _derived(docs, None)
    own = terms.select(F.col("names").alias("__no_names"))
    return _derived(docs.crossJoin(F.broadcast(own)), F.col("__no_names")).drop("__no_names")  # one row


def _derived(docs: DataFrame, no_names: Column | None) -> DataFrame:
    have = set(docs.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    some = lambda c: F.filter(F.transform(c, X.strip), lambda x: x != "")
    tags = some(F.coalesce(F.col("tags"), F.array())) if "tags" in have else F.array().cast("array<string>")
    single = some(F.array(F.coalesce(col("author"), F.lit(""))))
    names = F.when(F.size(some(F.coalesce(F.col("authors"), F.array()))) > 0, some(F.col("authors"))).otherwise(single) if "authors" in have else single
    people = F.filter(names, lambda x: plausible_person(x, no_names))
    lows = F.transform(people, F.lower)
    people = F.filter(people, lambda x, i: F.array_position(lows, F.lower(x)) == i + 1)
    of = source_of(col("source"), col("source_type"))
    pdf = F.coalesce((of == "pdf") | (col("source_type") == "pdf") | X.blank_to_null(col("pdf_url")).isNotNull(), F.lit(False))
    kind = urls.kind_of(F.coalesce(X.first_of(col("url"), col("original_url")), F.lit("")), (col("document_type"), col("category"), col("section")), pdf, of)
    return docs.withColumns({"doc_source": of, "source_display": source_display(of), "doc_year": F.coalesce(year_of(X.strip(col("date"))), F.lit("")), "doc_tags": tags, "doc_authors": people, "doc_kind": kind})


def sources_in_order(docs: DataFrame) -> DataFrame:
    """``source, tier, display`` of all sources, the highest tier first, then by name."""
    tiers = F.create_map(*[F.lit(x) for kv in SOURCE_PRIORITY.items() for x in kv])
    tier = F.coalesce(F.try_element_at(tiers, F.col("source")), F.lit(1))
    return docs.select(F.lower("source").alias("source")).distinct().select("source", tier.alias("tier"), source_display(F.col("source")).alias("display")).orderBy(F.desc("tier"), "source")


def distinct_urls(docs: DataFrame, url: str = "url") -> DataFrame:
    """One row: how many addresses differ in more than case and a slash at the end."""
    return docs.agg(F.countDistinct(F.lower(F.regexp_replace(X.strip(F.col(url)), "/+$", ""))).alias("urls"))


def previews(rows: DataFrame, docs: DataFrame, key: str = "document_id", most: int = 320) -> DataFrame:
    """``rows`` with the beginning of their document's text; rows without a document have none."""
    return rows.join(docs.select(key, X.snippet(F.col("text"), most).alias("preview")), key, "left")
