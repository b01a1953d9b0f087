"""Keyed maintenance of a document table: collapsing, upserts, deletes and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import blank_to_null
from docspark.functions.urls import canonical


def richness(author: Column, date: Column, section: Column, n_tags: Column, is_html: Column, length: Column, scraped: Column) -> Column:
    """A key that is greater for a richer document: known fields first, then length and recency."""
    known = lambda c: blank_to_null(c).isNotNull().cast("int")
    return F.struct(known(author).alias("a"), known(date).alias("d"), known(section).alias("s"), n_tags.alias("n"), is_html.cast("int").alias("h"), length.alias("l"), F.coalesce(scraped, F.lit("")).alias("at"))


def identity(url: Column, key: Column) -> Column:
    """What makes a document the same: its canonical address, else its own key."""
    return F.coalesce(canonical(blank_to_null(url)), F.concat(F.lit("id:"), key.cast("string")))


def collapse(docs: DataFrame, by: Column, rich: Column, order: str) -> DataFrame:
    """The richest document of each identity; the first in ``order`` of equals. One shuffle, combined on the map side."""
    rows = docs.withColumns({"__by": by, "__rich": rich})
    whole = F.struct(*docs.columns)
    # a greater key wins, then the smaller order
    best = rows.groupBy("__by").agg(F.max_by(whole, F.struct(F.col("__rich"), (-F.col(order)).alias("o"))).alias("__best"), F.count(F.lit(1)).alias("__n"))
    return best.select("__best.*", (F.col("__n") - 1).alias("collapsed"))


def collapse_touched(docs: DataFrame, touched: DataFrame, key: str, by: Column, rich: Column) -> DataFrame:
    """Keys of ``docs`` that give way to a richer document of their identity.

    Only identities of the ``touched`` keys are looked at: the others were collapsed before.
    Equals are told apart by a hash of the key.
    """
    rows = docs.select(key, by.alias("__by"), F.struct(rich.alias("r"), F.xxhash64(key).alias("h"), F.col(key).alias("k")).alias("__rich"))
    own = rows.join(touched.select(key).distinct(), key, "left_semi").select("__by").distinct()
    rows = rows.join(own, "__by", "left_semi")
    best = rows.groupBy("__by").agg(F.max("__rich")["k"].alias("__best"))
    return rows.join(best, "__by").where(~F.col(key).eqNullSafe(F.col("__best"))).select(key)


def effective(existing: DataFrame, delta: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of a delta that count: of a repeated key the last in ``order``, and none that comes before the existing row of its key.

    Nulls come first; of equals the delta's row counts.
    """
    by = F.struct(F.col(order).isNotNull(), F.col(order))
    last = delta.groupBy(key).agg(F.max_by(F.struct(*[c for c in delta.columns if c != key]), by).alias("__r")).select(key, "__r.*")
    if order in existing.columns:
        # of the existing rows only keys and order travel
        old = existing.select(key, F.struct(F.col(order).isNotNull(), F.col(order)).alias("__old"))
        last = last.join(old, key, "left").where(F.col("__old").isNull() | (by >= F.col("__old"))).drop("__old")
    return last


def effective_keys(existing: DataFrame, delta: DataFrame, key: str, order: str) -> DataFrame:
    """The keys of the rows of a delta that count; only keys and order travel."""
    by = F.struct(F.col(order).isNotNull(), F.col(order))
    last = delta.groupBy(key).agg(F.max(by).alias("__new"))
    if order in existing.columns:
        last = last.join(existing.select(key, by.alias("__old")), key, "left").where(F.col("__old").isNull() | (F.col("__new") >= F.col("__old")))
    return last.select(key)


def upsert(existing: DataFrame, delta: DataFrame, key: str, order: str, removed: DataFrame | None = None) -> DataFrame:
    """``existing`` with the delta's effective rows in place of those with their key, and without the removed keys.

    Of a repeated key the row that is last in ``order`` counts. A row of the delta that comes
    before the existing one in ``order`` is late and changes nothing; of equals the delta's counts.
    Nulls come first.
    """
    return replaced(existing, effective(existing, delta, key, order), key, removed)


def replaced(existing: DataFrame, rows: DataFrame, key: str, removed: DataFrame | None = None) -> DataFrame:
    """``existing`` with ``rows`` (of distinct keys) in place of those with their key, and without the removed keys."""
    merged = existing.join(rows.select(key), key, "left_anti").unionByName(rows.select(*existing.columns))
    return merged if removed is None else merged.join(removed.select(key).distinct(), key, "left_anti")


def delta_counts(existing: DataFrame, delta: DataFrame, key: str, removed: DataFrame) -> DataFrame:
    """One row: ``added, updated, removed, changed, total`` of an upsert by a delta's effective rows."""
    keys = existing.select(key, F.lit(1).alias("old")).join(delta.select(key).distinct().withColumn("new", F.lit(1)), key, "full_outer").join(removed.select(key).distinct().withColumn("gone", F.lit(1)), key, "left")
    n = lambda c: F.count_if(c).cast("long")
    gone = F.col("gone").isNotNull()
    out = keys.agg(n(F.col("new").isNotNull() & F.col("old").isNull()).alias("added"), n(F.col("new").isNotNull() & F.col("old").isNotNull()).alias("updated"), n(gone).alias("removed"), n(~gone).alias("total"))
    return out.withColumn("changed", F.col("added") + F.col("updated") + F.col("removed"))


def changed_only(current: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """Rows that are new or whose value differs from the known one (nulls compare as values)."""
    old = known.select(key, F.col(value).alias("__old"), F.lit(True).alias("__known"))
    rows = current.join(old, key, "left").where(F.col("__known").isNull() | ~F.col(value).eqNullSafe(F.col("__old")))
    return rows.drop("__old", "__known")


def would_empty(before: int, after: int) -> bool:
    """The guard against a delta that takes every document away; both counts are of before and after the merge."""
    return before > 0 and after == 0
