"""Crawl runs over a log of fetches: changes, removals, state and the frontier."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions.urls import canonical, should_follow, should_keep
from docspark.settings import DEFAULT, Settings
from docspark.sources import html
from docspark.sources.shared import durable

#: Outcomes that count as seen: a page that failed or was forbidden may still exist.
SEEN = ("ok", "not_modified", "error", "robots")


def classify(fetches: DataFrame, state: DataFrame) -> DataFrame:
    """``url, change, content_hash`` of one run: added, updated, unchanged, failed, gone or demoted.

    ``fetches``: ``url, status, content_hash`` (null hash on an ok page: it is no document any
    more, so a known one is demoted). ``state``: ``url, content_hash``.
    """
    both = fetches.select("url", "status", F.col("content_hash").alias("new")).join(state.select("url", F.col("content_hash").alias("old"), F.lit(True).alias("known")), "url", "left")
    change = (
        F.when(F.col("status").isin("gone"), "gone")
        .when(F.col("status") == "not_modified", "unchanged")
        .when(F.col("status").isin("error", "robots"), "failed")
        .when(F.col("new").isNull(), F.when(F.col("known"), "demoted").otherwise("skipped"))
        .when(F.col("known").isNull(), "added")
        .when(F.col("new") == F.col("old"), "unchanged")
        .otherwise("updated")
    )
    return both.select("url", change.alias("change"), F.coalesce("new", "old").alias("content_hash"))


def removals(state: DataFrame, fetches: DataFrame, incremental: bool, capped: bool) -> DataFrame:
    """Known pages to delete: not seen in a complete incremental run, or gone. Never PDFs, never after a capped run."""
    pages = state.where(~F.lower(F.substring_index("url", "?", 1)).endswith(".pdf"))
    if not incremental or capped:
        return pages.limit(0).select("url")
    return pages.join(fetches.where(F.col("status").isin(*SEEN)).select("url"), "url", "left_anti").select("url")


def next_state(state: DataFrame, changes: DataFrame, gone: DataFrame, now: str) -> DataFrame:
    """State after a run: ``url, content_hash, first_seen, last_seen, last_changed``."""
    both = state.join(changes.where("change not in ('gone', 'demoted', 'skipped')").select("url", "change", F.col("content_hash").alias("new")), "url", "full_outer").join(gone, "url", "left_anti")
    both = both.where("not (change is null and first_seen is null)").where(~((F.col("change") == "failed") & F.col("first_seen").isNull()) | F.col("change").isNull())
    seen = F.col("change").isNotNull()
    fresh = F.col("change").isin("added", "updated")
    return both.select(
        "url",
        F.when(fresh, F.col("new")).otherwise(F.coalesce("content_hash", "new")).alias("content_hash"),
        F.coalesce("first_seen", F.lit(now)).alias("first_seen"),
        F.when(seen, F.lit(now)).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(F.coalesce(fresh, F.lit(False)), F.lit(now)).otherwise(F.col("last_changed")).alias("last_changed"),
    )


def fetch_plan(state: DataFrame, urls: DataFrame) -> DataFrame:
    """Addresses with the headers of a conditional request, where the state knows them."""
    return urls.join(state.select("url", "etag", "last_modified"), "url", "left").select("url", F.create_map(F.lit("If-None-Match"), F.col("etag"), F.lit("If-Modified-Since"), F.col("last_modified")).alias("headers")).withColumn("headers", F.map_filter("headers", lambda k, v: v.isNotNull()))


def frontier(edges: DataFrame | Callable[[DataFrame], DataFrame], seeds: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """``url, depth`` of pages within ``depth`` links of the seeds, each at its least depth; ``most`` caps a crawl.

    ``edges``: ``src, dst``, or a function that gives those of a level's pages (``url``), so
    that only pages that are reached are looked into. Each level is one join with the edges
    and one anti-join with what is known, and a written table, so the plan doesn't grow with
    the depth.
    """
    of = edges if callable(edges) else lambda level: level.select(F.col("url").alias("src")).join(edges, "src")
    known = level = durable(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "level")
    for d in range(1, depth + 1):
        found = of(level.select("url")).select(F.col("dst").alias("url")).distinct().join(known.select("url"), "url", "left_anti").withColumn("depth", F.lit(d))
        level = durable(found, "level")
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known.orderBy("depth", "url").limit(most) if most is not None else known


def robots_rules(lines: DataFrame) -> DataFrame:
    """``host, allow, prefix`` from lines of robots files (``host, line``) that hold for all agents."""
    from pyspark.sql import Window as W

    row = lines.withColumns({"key": F.lower(F.trim(F.substring_index("line", ":", 1))), "value": F.trim(F.regexp_extract("line", r"^[^:]*:\s*([^#]*)", 1))})
    agent = F.last(F.when(F.col("key") == "user-agent", F.col("value")), True).over(W.partitionBy("host").orderBy("n"))
    return row.withColumn("agent", agent).where((F.col("agent") == "*") & F.col("key").isin("allow", "disallow") & (F.col("value") != "")).select("host", (F.col("key") == "allow").alias("allow"), F.col("value").alias("prefix"))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, allowed``: the longest matching rule decides, allow before disallow; without rules everything is."""
    from docspark.functions.urls import host, path

    rows = urls.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    hit = rows.join(rules, "host", "left").where(F.col("prefix").isNull() | F.expr("startswith(path, prefix)"))
    best = hit.groupBy("url").agg(F.max_by("allow", F.struct(F.length("prefix"), F.col("allow").cast("int"))).alias("allow"))
    return rows.select("url").join(best, "url", "left").select("url", F.coalesce("allow", F.lit(True)).alias("allowed"))


@dataclass(frozen=True)
class Run:
    """What a crawl run leaves: documents that are new or changed, addresses whose documents go, the state, and a row of counts."""

    documents: DataFrame
    removed: DataFrame
    state: DataFrame
    counts: DataFrame


def run(fetches: DataFrame, state: DataFrame, seeds: DataFrame, hosts: list[str], now: str, source: str = "website", robots: DataFrame | None = None, exclude: tuple[str, ...] = (), incremental: bool = True, settings: Settings = DEFAULT) -> Run:
    """One crawl of a site over its fetch log (``url, status, html``): follow, fetch, extract, compare, remove.

    Pages are reached from the seeds over internal links that may be followed, within the
    settings' depth and number of pages; what the rules of robots files forbid counts as seen
    but gives no document. ``state`` is that of ``next_state``.
    """
    at = fetches.withColumn("url", canonical(F.col("url"))).dropDuplicates(["url"])
    pages = at.where("status = 'ok'")

    def edges(level: DataFrame) -> DataFrame:  # links of the level's pages alone
        return html.links(pages.join(level, "url", "left_semi")).where(should_follow(F.col("dst"), hosts, list(exclude)))

    starts = seeds.select(canonical(F.col("url")).alias("url")).distinct()
    reached = frontier(edges, starts, settings.crawl_max_depth, settings.crawl_max_pages)
    capped = reached.count() >= settings.crawl_max_pages
    seen = at.join(reached.select("url"), "url", "left_semi")
    if robots is not None:
        seen = seen.join(allowed(seen.select("url"), robots), "url").withColumn("status", F.when(F.col("allowed"), F.col("status")).otherwise("robots")).drop("allowed")
    docs = html.documents(seen.where("status = 'ok'"), source, settings.min_evidence_chars).where(should_keep(F.col("url"), list(exclude)))
    hashed = seen.select("url", "status").join(docs.select("url", "content_hash"), "url", "left")
    changes = classify(hashed, state)
    gone = removals(state, hashed, incremental, capped).unionByName(changes.where("change in ('gone', 'demoted')").join(state.select("url"), "url", "left_semi").select("url")).distinct()
    fresh = docs.join(changes.where("change in ('added', 'updated')").select("url"), "url", "left_semi")
    counts = changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))
    return Run(fresh, gone, next_state(state, changes, gone, now), counts)
