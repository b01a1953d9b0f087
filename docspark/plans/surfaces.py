"""Queries of sources and sinks, records, crawling and what answers show."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import dates, entities, urls
from docspark.functions import text as X
from docspark.kb import Store
from docspark.operators import analytics, chunking, crawl, dense, grounding, lexical, records, retrieve, shown
from docspark.plans.corpus import _CHUNKS, _CLEAN, _HOST, _SCORED, _TRIM, ALL_LINES
from docspark.plans.retrieval import _BM25, _HITS, QUERY, _hits, _t, corpus
from docspark.plans.retrieval import SQL as RETRIEVAL_SQL
from docspark.settings import LENGTH_BUDGETS
from docspark.sources import html, jsonl, runs
from docspark.sources.shared import folder as _shared
from docspark.sources.versions import Versions


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents")


# ---- files and versions --------------------------------------------------------------------


def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as JSON lines in two parts, read back and made normal."""
    at = f"{_shared(spark, 'lines')}/docs"
    rows = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("document_id"), "source", "text")
    jsonl.write_jsonl(rows.where("cast(document_id as bigint) % 2 = 0"), at)
    jsonl.write_jsonl(rows.where("cast(document_id as bigint) % 2 = 1"), at, append=True)
    got = jsonl.normalize(jsonl.read_jsonl(spark, at))
    return got.select("document_id", "source", F.md5("text").alias("text"), F.col("text_length").cast("long").alias("text_length"))


def generated_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Records without ids: numbered in the order of their numbers."""
    rows = _docs(spark, sf).select(F.col("doc_id").alias("n"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("own"), F.col("doc_id"))).alias("id"), "text")
    got = jsonl.normalize(rows, prefix="rec", order="n")
    return got.select("document_id", F.md5("text").alias("text"))


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    at = f"{_shared(spark, 'csv')}/docs"
    jsonl.write_csv(_docs(spark, sf).select("doc_id", "source", F.array("lang", "source").alias("tags"), F.struct("lang").alias("left_out")), at)
    return spark.read.option("header", True).csv(at).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "tags")


def versions_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a table beside one that stays, a package of the second taken over elsewhere, and the first after going back."""
    root = _shared(spark, "versions")
    store, copy = Versions(spark, f"{root}/a"), Versions(spark, f"{root}/b")
    docs = _docs(spark, sf).select("doc_id", "source")
    store.publish({"documents": docs.where("doc_id % 2 = 0"), "sources": docs.select("source").distinct()})
    store.publish({"documents": docs})
    runs.package(store, f"{root}/package")
    runs.install(copy, f"{root}/package")
    store.rollback()
    count = lambda df, name: df.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("at"), "source", "n")
    return count(store.table("documents"), "before").unionByName(count(copy.table("documents"), "package")).unionByName(count(copy.table("sources"), "kept"))


def run_history(spark: SparkSession, sf: str) -> DataFrame:
    """A run for each day of events, and the latest of them."""
    root = _shared(spark, "runs")
    days = _t(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("started_at")).agg(F.count(F.lit(1)).alias("added"))
    runs.record_all(days.withColumn("status", F.lit("ok")), root)
    return runs.history(spark, root).select(F.col("started_at").alias("day"), "added")


# ---- text and fields ------------------------------------------------------------------------


def escapes(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.concat(F.lit("<a href='x'>*&_#|`"), F.coalesce("text", F.lit("")))
    link = F.when(F.col("doc_id") % 3 == 0, F.lit(" HTTPS://x.org/a ")).when(F.col("doc_id") % 3 == 1, F.lit("javascript:x")).otherwise(F.lit("/a"))
    return _docs(spark, sf).select("doc_id", F.md5(X.markdown_escape(marked)).alias("markdown"), F.md5(X.html_escape(marked)).alias("html"), X.safe_href(link).alias("href"))


def truncated(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.md5(X.truncate(F.col("text"))).alias("short"), F.md5(X.snippet(F.col("text"))).alias("snippet"))


def plausible_names(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a text's first two words could be a person's name."""
    name = F.substring_index("text", " ", 2)
    return _docs(spark, sf).select("doc_id", F.coalesce(entities.plausible_person(name), F.lit(False)).alias("plausible"))


def author_match(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as authors, with honorifics and other names beside, against two of them."""
    n = F.initcap("n_name")
    own = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("Dr. "), n)).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("Jane Doe, A. "), n)).otherwise(n)
    return _t(spark, sf, "nation").select("n_nationkey", entities.author_matches(own, ["Prof Kenya", "John Brazil", "Iraq Peru"]).alias("matches"))


def dates_in_text(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate")
    shapes = ["MMMM d, yyyy", "d MMMM yyyy", "yyyy-MM-dd", "d/M/yyyy", "MMMM yyyy"]
    raw = F.element_at(F.array(*[F.date_format(d, s) for s in shapes], F.lit("soon")), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return _t(spark, sf, "orders").select("o_orderkey", dates.date_from_text(F.concat(F.lit("It was said on "), raw, F.lit(", and more."))).alias("found"))


def weekly_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The next run on a Monday at 18 o'clock after each event."""
    after = F.col("ts").cast("timestamp")
    return _t(spark, sf, "events").select("event_id", F.date_format(dates.next_weekly(after), "yyyy-MM-dd HH:mm").alias("next"))


def garbage_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with a line of noise put above: what stays and how many lines go."""
    noise = F.lit("─│┌ ▒▓ ─│┌ ▒▓\n")
    got = X.clean_lines(F.concat(F.when(F.col("doc_id") % 4 == 0, noise).otherwise(F.lit("")), F.lit("A plain line.\n"), F.col("source")))
    return _docs(spark, sf).select("doc_id", got["text"].alias("kept"), F.size(got["dropped"]).cast("long").alias("dropped"))


def record_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    """Records with broken text in fields of each class."""
    bad = F.lit("Itâ€™s  cafÃ© ")
    rows = _docs(spark, sf).select(
        "doc_id", F.concat(bad, F.col("source")).alias("title"), F.concat(F.lit(" https://x.org/cafÃ©/"), F.col("source"), F.lit(" ")).alias("url"),
        F.when(F.col("doc_id") % 2 == 0, bad).otherwise(F.lit("two  spaces ")).alias("note"), F.array(bad, F.lit("two  spaces "), F.col("lang")).alias("tags"), F.lit(None).cast("string").alias("author"),
    )
    return records.clean_record(rows).withColumn("tags", F.array_join("tags", "|"))


def source_union(spark: SparkSession, sf: str) -> DataFrame:
    """Three sources' deltas as one table, with a column that only one has."""
    docs = _docs(spark, sf)
    parts = {
        "website": docs.where("doc_id % 3 = 0").select("doc_id", F.lit(None).cast("string").alias("source"), "lang"),
        "commit_kb": docs.where("doc_id % 3 = 1").select("doc_id"),
        "local": docs.where("doc_id % 3 = 2").select("doc_id", "source"),
    }
    return records.union_sources(parts).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


def source_order(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select(F.when(F.col("doc_id") % 50 == 0, "Commit_KB").when(F.col("doc_id") % 50 == 1, "website").otherwise(F.col("source")).alias("source"))
    return records.sources_in_order(docs).select("source", F.col("tier").cast("long").alias("tier"), "display")


def weak_urls(spark: SparkSession, sf: str) -> DataFrame:
    return records.distinct_urls(_t(spark, sf, "pages"))


def derived_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Analytics columns of documents with authors, tags and dates made from their fields; a language, which is a tag too, is no author."""
    docs = _docs(spark, sf).select(
        "doc_id", F.when(F.col("doc_id") % 4 > 0, F.initcap("source")).alias("source"), F.lit("PDF").alias("source_type"), F.array(F.lit(" a "), F.lit(""), F.col("lang")).alias("tags"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("Jane Doe"), F.lit("jane doe"), F.lit("3"), F.initcap("lang"))).alias("authors"), F.lit("Ann Lee").alias("author"), F.concat(F.lit(" "), 2000 + F.col("doc_id") % 25, F.lit("-01-02")).alias("date"), F.lit("https://x.org/a").alias("url"),
    )
    got = records.derived(docs, records.not_people(docs))
    return got.select("doc_id", "doc_source", "source_display", "doc_year", F.array_join("doc_tags", ",").alias("tags"), F.array_join("doc_authors", ",").alias("authors"), "doc_kind")


def explorer_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """One page of documents by source, author, tag, year and kind."""
    docs = _docs(spark, sf).select(
        F.col("doc_id").alias("document_id"), F.lit("t").alias("title"), "text", "source", F.array(F.concat(F.lit("Tag "), F.col("lang"))).alias("tags"), F.when(F.col("doc_id") % 3 > 0, "Jane Doe").otherwise("Ann Lee").alias("author"),
        F.concat(2000 + F.col("doc_id") % 4, F.lit("-01-02")).alias("date"), F.when(F.col("doc_id") % 2 == 0, "https://x.org/blogs/a").otherwise("https://x.org/a").alias("url"),
    )
    where = analytics.explorer_filter(author="jane", tag="EN", year="2002", kind="blog")
    return analytics.explore(records.derived(docs), None, where, size=30).select(F.col("document_id").alias("doc_id"), "doc_kind", "doc_year")


def capped_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.md5(X.capped(F.col("text"), 1000, " (cut)")).alias("text"))


def previews(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "labels").select(F.col("doc_id").alias("document_id"), "quality")
    got = records.previews(rows, _docs(spark, sf).select(F.col("doc_id").alias("document_id"), "text"))
    return got.select("document_id", F.md5("preview").alias("preview"))


def chunks_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.chunks_by_source(_docs(spark, sf).withColumn("source", F.when(F.col("doc_id") % 9 > 0, F.col("source")).otherwise(F.lit(" "))))


def log_top_categories(spark: SparkSession, sf: str) -> DataFrame:
    log = _t(spark, sf, "events").select(F.when(F.col("user_id") % 5 > 0, F.concat("event_type", (F.col("user_id") % 5).cast("string"))).otherwise(F.lit(" ")).alias("top_category"))
    return analytics.top_categories(log)


# ---- crawling -------------------------------------------------------------------------------


def resolved_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of five shapes on every page."""
    link = F.element_at(F.array(*[F.lit(x) for x in ("/a/b", "//y.org/c", "https://z.org/d", " /e ", "?q=1")]), (F.col("page_id") % 5 + 1).cast("int"))
    base = F.concat(F.lit("https://"), urls.host(F.col("url")), F.lit("/dir/page"))
    return _t(spark, sf, "pages").select("page_id", urls.resolve(link, base).alias("resolved"))


def fetch_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Conditional requests for all pages, of which some are known."""
    pages = _t(spark, sf, "pages").select("page_id", F.concat(F.lit("https://x.org/"), F.col("page_id")).alias("url"))
    known = pages.where("page_id % 3 > 0").select("url", F.md5("url").alias("etag"), F.when(F.col("page_id") % 2 == 0, F.lit("Mon, 01 Jan 2024 00:00:00 GMT")).alias("last_modified"))
    got = crawl.fetch_plan(known, pages.select("url"))
    return got.select("url", F.coalesce(F.try_element_at("headers", F.lit("If-None-Match")), F.lit("")).alias("etag"), F.size("headers").cast("long").alias("headers"))


def robots_allowed(spark: SparkSession, sf: str) -> DataFrame:
    """Which pages a robots file for all hosts allows; the longest rule counts."""
    pages = _t(spark, sf, "pages").select("url").distinct()
    lines = ["User-agent: Other", "Disallow: /", "User-agent: *", "Disallow: /de/", "Allow: /de/1", "Disallow: /es/2 # some", "Disallow:"]
    hosts = pages.select(urls.host(F.col("url")).alias("host")).distinct()
    rules = crawl.robots_rules(hosts.select("host", F.posexplode(F.array(*[F.lit(x) for x in lines])).alias("n", "line")))
    return crawl.allowed(pages, rules)


def sitemap_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a sitemap index with a map for each last digit, one of which names the index again."""
    pages = _t(spark, sf, "pages").select("page_id", (F.col("page_id") % 10).alias("k"))
    loc = lambda tag, c: F.concat(F.lit(f"<{tag}><loc> "), c, F.lit(f" </loc></{tag}>"))
    page = F.concat(F.lit("https://"), F.when(F.col("page_id") % 7 == 0, F.lit("other")).otherwise(F.lit("www.x")), F.lit(".org/p"), F.col("page_id"))
    at = lambda k: F.concat(F.lit("https://x.org/map"), k, F.lit(".xml"))
    wrap = lambda tag, c: F.concat(F.lit(f'<{tag} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), c, F.lit(f"</{tag}>"))
    maps = pages.groupBy("k").agg(F.array_join(F.collect_list(loc("url", page)), "").alias("body"))
    maps = maps.select(at(F.col("k")).alias("url"), wrap("urlset", F.col("body")).alias("xml"))
    top = spark.range(9).agg(F.array_join(F.collect_list(loc("sitemap", at(F.col("id")))), "").alias("body"))
    top = top.select(F.lit("https://x.org/index.xml").alias("url"), wrap("sitemapindex", F.concat("body", loc("sitemap", F.lit("https://x.org/index.xml")))).alias("xml"))
    return html.sitemap_walk(maps.unionByName(top), ["https://x.org/index.xml"], ["x.org"])


# ---- vectors, filters and answers ---------------------------------------------------------------


def embedding_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of all documents, two thirds of them from the cache: those carry a mark that new ones don't."""
    docs = _docs(spark, sf).select("doc_id", F.substring(F.sha2("text", 256), 1, 24).alias("chunk_hash"), "text")
    cache = docs.where("doc_id % 3 > 0").select("chunk_hash", F.array(F.lit(9.0).cast("float")).alias("embedding")).distinct()
    got, _ = dense.embed_with_cache(docs, cache, lambda c: dense.hashed_embedding(c, 16))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return got.select("doc_id", (F.size("embedding") == 1).alias("cached"), F.round(norm, 4).alias("norm"), F.round(F.array_max("embedding").cast("double"), 4).alias("top"))


def metadata_filters(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf).select("doc_id", F.initcap("source").alias("source"), F.concat(F.lit("About "), F.col("lang")).alias("category"), F.lit("A. Writer").alias("author"), F.concat(2000 + F.col("doc_id") % 4, F.lit("-05-01")).alias("date"))
    asked = {"source": dense.metadata_filter(source="SRC1"), "category": dense.metadata_filter(source="all", category="EN"), "year": dense.metadata_filter(author="writer", year="2001"), "none": dense.metadata_filter()}
    rows = docs.agg(*[F.count_if(c).alias(k) for k, c in asked.items()])
    return rows.selectExpr("stack(4, 'source', source, 'category', category, 'year', year, 'none', none) as (filter, n)")


def filtered_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """The best of one language: the filter holds before the list is cut."""
    docs = _docs(spark, sf)
    got = lexical.LexicalIndex.build(docs, "doc_id", "text").search(QUERY, 10, docs.where("lang = 'es'").select(F.col("doc_id").alias("id")))
    return got.select(F.col("id").alias("doc_id"), F.round("bm25_score", 6).alias("bm25_score"), F.col("rank").cast("long").alias("rank"))


def context_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of twelve documents at a time, an answer's sources, with the lines that name them, as many as fit the budget."""
    docs = corpus(spark, sf).withColumns({"answer": F.floor(F.col("id") / 12), "n": F.col("id") % 12 + 1})
    fields = {"title": F.col("title"), "category": F.when(F.col("id") % 2 == 0, F.col("language")), "source_name": F.col("source"), "url": F.col("url")}
    blocks = docs.withColumn("block", F.concat(grounding.source_header(fields, F.col("n")), F.lit("\n"), F.col("text")))
    got = grounding.context_pack(blocks, ["answer"], "n", "block")
    return got.select("answer", F.col("id").alias("doc_id"), F.md5("block").alias("block"))


def _drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in Markdown with headings, points and references, and two sources."""
    lead = F.substring_index(F.regexp_replace("text", r"[\s\[\]*#•]+", " "), " ", 8)
    text = F.concat(lead, F.lit(" [Source 2].\n## Key Points\n- one [source 1]\n\n* two\n3) three [ 2 ]\nno point\n1. four\n• five\n**Sources:**\n- a\n"), F.when(F.col("doc_id") % 2 == 0, F.lit("References\nb")).otherwise(F.lit("")))
    source = lambda t, u: F.struct(F.lit(t).alias("title"), F.col("lang").alias("category"), F.lit(u).alias("url"), F.col("text").alias("text"))
    return _docs(spark, sf).select("doc_id", lead.alias("lead"), text.alias("answer"), F.array(source("a", "https://x.org/a"), source("b", "ftp://x.org/b"), source("a", "https://x.org/a")).alias("sources"))


def answer_sections(spark: SparkSession, sf: str) -> DataFrame:
    got = _drafts(spark, sf).withColumn("s", shown.sections(F.col("answer")))
    # a section has no white space at its ends, also where the text has none or begins with a mark
    return got.select("doc_id", (F.col("s.answer") == X.strip(F.concat("lead", F.lit(" [Source 2].")))).alias("answer"), F.col("s.sources").alias("sources"), F.col("s.references").alias("references"), F.array_join(shown.points(F.col("s.details"), 4), ";").alias("points"), F.md5(shown.without_references(F.col("answer"))).alias("plain"))


def shown_cards(spark: SparkSession, sf: str) -> DataFrame:
    got = shown.shown_sources(_drafts(spark, sf))
    card = F.transform("cards", lambda c: F.concat_ws(" ", c["number"].cast("string"), c["title"], c["category"], c["url"], F.md5(c["preview"])))
    return got.select("doc_id", F.array_join(card, ";").alias("cards"))


def related_documents(spark: SparkSession, sf: str) -> DataFrame:
    got = shown.related(_drafts(spark, sf).select("doc_id", "sources"), "doc_id", "sources")
    return got.select("doc_id", F.col("position").cast("long").alias("position"), "title", "url")


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose date, author or category is missing and stands in the address or the text."""
    n = F.col("doc_id")
    day = F.date_format(F.date_add(F.lit("2020-01-01"), (n % 900).cast("int")), "yyyy-MM-dd")
    url = F.concat(F.lit("https://x.org/"), F.when(n % 3 == 0, "isro-news/").otherwise("misc/"), F.when(n % 2 == 0, day).otherwise(F.replace(day, F.lit("-"), F.lit(""))), F.lit("-title"))
    rows = _docs(spark, sf).select("doc_id", url.alias("url"), F.when(n % 5 == 0, "1999-09-09").alias("date"), F.when(n % 4 == 0, F.lit(" ")).otherwise(F.lit("Own Name")).alias("author"), F.lit("").alias("category"), F.concat(F.lit("Report\nBy Jane Smith\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return jsonl.enrich(rows).select("doc_id", "date", "author", "category")


def pdf_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text is that of their pages, and the pages of their chunks."""
    half = F.floor(F.length("text") / 2).cast("int")
    page = lambda k, t: F.struct(F.lit(k).alias("page_number"), t.alias("text"))
    pages = F.array(page(1, F.substring("text", F.lit(1), half)), page(2, F.substring("text", half + 1, F.length("text"))))
    rows = _docs(spark, sf).select(F.col("doc_id").alias("document_id"), F.lit(" ").alias("text"), pages.alias("pdf_pages"))
    whole = jsonl.with_pdf_pages(rows).select("document_id", F.md5("text").alias("text"))
    pieces = chunking.chunk_documents(rows).groupBy("document_id").agg(F.count_if(F.col("chunk_id").startswith(F.concat(F.col("document_id"), F.lit("_p"), F.col("page_number"), F.lit("_c")))).alias("named"), F.count(F.lit(1)).alias("n"))
    return whole.join(pieces, "document_id", "left").select("document_id", "text", (F.coalesce("named", F.lit(0)) == F.coalesce("n", F.lit(0))).alias("named"))


def linked_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Markers as links to their sources' addresses, where these are safe."""
    text = F.concat(F.col("source"), F.lit(" [Source 1] and [2], [3](https://z.org) [[1]](https://x.org) [source 9]."))
    links = F.array(F.concat(F.lit("https://x.org/"), F.col("doc_id")), F.when(F.col("doc_id") % 2 == 0, F.lit("HTTP://y.org")).otherwise(F.lit("javascript:x")))
    return _docs(spark, sf).select("doc_id", X.linkify(text, links).alias("linked"))


def layout_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Broken text repaired in place, and addresses."""
    bad = F.concat(F.lit("â€œIt  isâ€\x9d â€” "), F.col("source"), F.lit("\n\n\n  Itâ€?s weâre"))
    return _docs(spark, sf).select("doc_id", X.repaired(bad).alias("text"), X.is_broken(bad).alias("was"), X.is_broken(F.col("source")).alias("is"), urls.clean_url(F.concat(F.lit(" https://x.org/Ã©/"), F.col("source"), F.lit("\n"))).alias("url"))


def evidence_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Hits that can support a citation."""
    got = retrieve.evidence_filter(_hits(spark, sf))
    return got.select(F.col("id").alias("doc_id"), F.col("position").cast("long").alias("position"))


def index_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The best documents by a lexical index that was written and read back."""
    at = f"{_shared(spark, 'index')}/lexical"
    lexical.LexicalIndex.build(_docs(spark, sf), "doc_id", "text").save(at)
    got = lexical.LexicalIndex.load(spark, at).search(QUERY, 15)
    return got.select(F.col("id").alias("doc_id"), F.round("bm25_score", 6).alias("bm25_score"), "lexical_score", F.col("rank").cast("long").alias("rank"))


def store_updates(spark: SparkSession, sf: str) -> DataFrame:
    """A store filled in two updates, the second with late rows and a removal: what its tables hold."""
    store = Store(spark, f"{_shared(spark, 'store')}/kb", replace(ALL_LINES, embedding_dim=16))
    docs = corpus(spark, sf).drop("id").where(X.blank_to_null(F.col("text")).isNotNull()).withColumn("updated_at", F.lit("2024-02-01"))
    store.update(docs.where("document_id % 3 > 0"))
    late = docs.where("document_id % 3 = 1").withColumns({"text": F.lit("late"), "updated_at": F.lit("2024-01-01")})
    store.update(docs.where("document_id % 3 = 0").unionByName(late), docs.where("document_id % 50 = 7").select("document_id"))
    n = lambda name: store.versions.table(name).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"))
    return n("documents").unionByName(n("chunks")).unionByName(n("vectors"))


def length_modes(spark: SparkSession, sf: str) -> DataFrame:
    """For each length of an answer, how many documents fit its budget whole, and the tokens that the others have beyond it."""
    tokens = _docs(spark, sf).select(X.approx_token_count(F.coalesce(F.col("text"), F.lit(""))).alias("tokens"))
    modes = F.create_map(*[F.lit(x) for kv in LENGTH_BUDGETS.items() for x in kv])
    each = tokens.select("tokens", F.explode(modes).alias("mode", "budget"))
    return each.groupBy("mode").agg(F.count_if(F.col("tokens") <= F.col("budget")).alias("whole"), F.sum(F.greatest(F.lit(0).cast("long"), F.col("tokens") - F.col("budget"))).alias("beyond"))


QUERIES = {
    f.__name__: f
    for f in (
        jsonl_round_trip, generated_ids, csv_round_trip, versions_round_trip, run_history, escapes, truncated, plausible_names, author_match, dates_in_text, weekly_runs, garbage_lines, record_cleaning, source_union, source_order, weak_urls,
        derived_columns, previews, chunks_by_source, log_top_categories, resolved_links, fetch_headers, robots_allowed, sitemap_pages, embedding_cache, metadata_filters, filtered_bm25, context_blocks, answer_sections, shown_cards, related_documents, length_modes,
        enriched, explorer_filtered, capped_texts, pdf_documents, linked_answers, layout_repair, evidence_kept, index_round_trip, store_updates,
    )
}
_MARKED = "'<a href=''x''>*&_#|`' || coalesce(text, '')"
_HTML = _MARKED
for _a, _b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
    _HTML = f"replace({_HTML}, '{_a if _a != chr(39) * 2 else chr(39) * 2}', '{_b}')"
_TITLE = "substr(split_part(text, chr(10), 1), 1, 80)"
_LEAD = r"array_to_string(string_split(regexp_replace(text, '[\s\x0B\[\]*#•]+', ' ', 'g'), ' ')[1:8], ' ')"
_SNIP = "CASE WHEN length({0}) <= {1} THEN {0} ELSE " + _TRIM.format("substr({0}, 1, {1})") + " || '…' END"
SQL = {
    "jsonl_round_trip": f"SELECT CAST(doc_id AS VARCHAR) AS document_id, source, md5({_CLEAN}) AS text, CAST(length({_CLEAN}) AS BIGINT) AS text_length FROM documents WHERE {_CLEAN} <> ''",
    "generated_ids": f"""WITH d AS (SELECT doc_id, {_CLEAN} AS t FROM documents WHERE {_CLEAN} <> '')
SELECT 'own' || doc_id AS document_id, md5(t) AS text FROM d WHERE doc_id % 3 = 0 UNION ALL
SELECT 'rec_' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END, md5(t) FROM (SELECT t, row_number() OVER (ORDER BY doc_id) AS n FROM d WHERE doc_id % 3 > 0)""",
    "csv_round_trip": "SELECT doc_id, source, lang || '; ' || source AS tags FROM documents",
    "versions_round_trip": """SELECT 'before' AS at, source, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY source UNION ALL SELECT 'package', source, count(*) FROM documents GROUP BY source
UNION ALL SELECT DISTINCT 'kept', source, 1 FROM documents""",
    "run_history": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS added FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 12",
    "escapes": rf"""SELECT doc_id, md5(regexp_replace({_MARKED}, '([\\`*_\[\]<>#|])', '\\\1', 'g')) AS markdown, md5({_HTML}) AS html,
CASE doc_id % 3 WHEN 0 THEN 'HTTPS://x.org/a' ELSE '#' END AS href FROM documents""",
    "truncated": f"""SELECT doc_id, md5(CASE WHEN length(text) <= 300 THEN text ELSE regexp_replace(substr(text, 1, 300), ' [^ ]*$', '') || '…' END) AS short,
md5({_SNIP.format(_TRIM.format("coalesce(text, '')"), 280)}) AS snippet FROM documents""",
    "plausible_names": f"""WITH n AS (SELECT doc_id, {_TRIM.format("array_to_string(string_split(text, ' ')[1:2], ' ')")} AS n FROM documents)
SELECT doc_id, coalesce(length(n) BETWEEN 2 AND 40 AND regexp_matches(n, '\\p{{L}}') AND len(regexp_split_to_array(n, '\\s+')) <= 5 AND CASE WHEN len(regexp_split_to_array(n, '\\s+')) > 1 THEN regexp_matches(n, '(?:^|\\s)\\p{{Lu}}') ELSE regexp_matches(n, '^\\p{{Lu}}\\p{{L}}*$') END
AND lower(n) NOT IN {entities.TOPICS} AND NOT regexp_matches(lower(n), '{"|".join(entities.ORGANISATIONS)}'), false) AS plausible FROM n""",
    "author_match": "SELECT n_nationkey, n_name IN ('KENYA', 'BRAZIL', 'PERU') AS matches FROM nation",
    "dates_in_text": """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN '' WHEN o_orderkey % 6 = 4 THEN strftime(o_orderdate, '%Y-%m-01') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS found FROM orders""",
    "weekly_runs": """WITH w AS (SELECT event_id, ts, date_trunc('week', ts) + INTERVAL 18 HOUR AS r FROM events) SELECT event_id, strftime(CASE WHEN r > ts THEN r ELSE r + INTERVAL 7 DAY END, '%Y-%m-%d %H:%M') AS next FROM w""",
    "garbage_lines": "SELECT doc_id, 'A plain line.' || chr(10) || source AS kept, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS dropped FROM documents",
    "record_cleaning": "SELECT doc_id, 'It’s café ' || source AS title, 'https://x.org/café/' || source AS url, CASE WHEN doc_id % 2 = 0 THEN 'It’s café' ELSE 'two  spaces ' END AS note, 'It’s café|two  spaces |' || lang AS tags, NULL::VARCHAR AS author FROM documents",
    "source_union": "SELECT CASE doc_id % 3 WHEN 0 THEN 'website' WHEN 1 THEN 'commit_kb' ELSE source END AS source, CASE WHEN doc_id % 3 = 0 THEN lang END AS lang, count(*) AS n FROM documents GROUP BY ALL",
    "source_order": """WITH s AS (SELECT DISTINCT CASE WHEN doc_id % 50 = 0 THEN 'commit_kb' WHEN doc_id % 50 = 1 THEN 'website' ELSE lower(source) END AS source FROM documents)
SELECT source, CASE source WHEN 'commit_kb' THEN 3 WHEN 'website' THEN 2 ELSE 1 END::BIGINT AS tier, CASE source WHEN 'commit_kb' THEN 'Commit KB' WHEN 'website' THEN 'Website' ELSE upper(source[1]) || source[2:] END AS display FROM s""",
    "weak_urls": r"SELECT count(DISTINCT lower(regexp_replace(trim(url), '/+$', ''))) AS urls FROM pages",
    "derived_columns": """SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN lower(source) ELSE 'pdf' END AS doc_source, CASE WHEN doc_id % 4 > 0 THEN upper(source[1]) || lower(source[2:]) ELSE 'Pdf' END AS source_display, CAST(2000 + doc_id % 25 AS VARCHAR) AS doc_year, 'a,' || lang AS tags,
CASE WHEN doc_id % 2 = 0 THEN 'Jane Doe' ELSE 'Ann Lee' END AS authors, CASE WHEN doc_id % 4 > 0 THEN 'Web page' ELSE 'PDF' END AS doc_kind FROM documents""",
    "previews": f"SELECT l.doc_id AS document_id, md5({_SNIP.format(_TRIM.format('text'), 320)}) AS preview FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id",
    "chunks_by_source": "SELECT CASE WHEN doc_id % 9 > 0 THEN lower(source) ELSE 'unknown' END AS source, count(*) AS n FROM documents GROUP BY 1",
    "log_top_categories": "SELECT event_type || user_id % 5 AS category, count(*) AS n FROM events WHERE user_id % 5 > 0 GROUP BY 1 ORDER BY n DESC, category LIMIT 6",
    "resolved_links": f"SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://' || {_HOST} || '/a/b' WHEN 1 THEN 'https://y.org/c' WHEN 2 THEN 'https://z.org/d' WHEN 3 THEN 'https://' || {_HOST} || '/e' ELSE 'https://' || {_HOST} || '/dir/page?q=1' END AS resolved FROM pages",
    "fetch_headers": "SELECT 'https://x.org/' || page_id AS url, CASE WHEN page_id % 3 > 0 THEN md5('https://x.org/' || page_id) ELSE '' END AS etag, CASE WHEN page_id % 3 = 0 THEN 0 WHEN page_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS headers FROM pages",
    "robots_allowed": r"""WITH p AS (SELECT DISTINCT url, regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '^([^?#]*)', 1) AS path FROM pages)
SELECT url, CASE WHEN starts_with(path, '/de/1') THEN true ELSE NOT (starts_with(path, '/de/') OR starts_with(path, '/es/2')) END AS allowed FROM p""",
    "sitemap_pages": "SELECT 'https://www.x.org/p' || page_id AS url FROM pages WHERE page_id % 7 > 0 AND page_id % 10 < 9",
    "embedding_cache": """WITH known AS (SELECT DISTINCT text FROM documents WHERE doc_id % 3 > 0),
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents WHERE text NOT IN (SELECT text FROM known)),
n AS (SELECT doc_id, CAST('0x' || substr(sha256(t), 1, 8) AS BIGINT) % 16 AS b, count(*) AS n FROM tok GROUP BY ALL),
v AS (SELECT doc_id, max(n) / sqrt(sum(n * n)) AS top FROM n GROUP BY doc_id)
SELECT doc_id, text IN (SELECT text FROM known) AS cached, CASE WHEN text IN (SELECT text FROM known) THEN 81.0 WHEN top IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS norm, round(CASE WHEN text IN (SELECT text FROM known) THEN 9.0 ELSE coalesce(top, 0) END::FLOAT::DOUBLE, 4) AS top FROM documents LEFT JOIN v USING (doc_id)""",
    "metadata_filters": """SELECT 'source' AS filter, count(*) FILTER (lower(source) = 'src1') AS n FROM documents UNION ALL SELECT 'category', count(*) FILTER (contains('about ' || lang, 'en')) FROM documents
UNION ALL SELECT 'year', count(*) FILTER (doc_id % 4 = 1) FROM documents UNION ALL SELECT 'none', count(*) FROM documents""",
    "filtered_bm25": "WITH " + _BM25.format(k=10).replace("SELECT * FROM scored ORDER", "SELECT scored.* FROM scored JOIN documents ON id = doc_id AND lang = 'es' ORDER") + " SELECT id AS doc_id, round(bm25_score, 6) AS bm25_score, rank FROM lex",
    "context_blocks": f"""WITH f AS (SELECT lang AS language, doc_id, source, text, doc_id // 12 AS answer, doc_id % 12 + 1 AS n FROM documents),
b AS (SELECT answer, doc_id, n, concat_ws(' | ', '[Source ' || n || '] ' || coalesce({_TITLE}, 'Untitled'), 'category: ' || CASE WHEN doc_id % 2 = 0 THEN language ELSE '—' END, 'source: ' || source, 'url: ' || 'https://' || source || '.example.org/' || language || '/doc-' || doc_id) || chr(10) || text AS block FROM f),
w AS (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY answer ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY answer ORDER BY n) AS k FROM b)
SELECT answer, doc_id, md5(CASE WHEN length(block) > 12000 THEN substr(block, 1, 12000) || '…' ELSE block END) AS block FROM w WHERE k = 1 OR (before < 12000 AND before + length(block) <= 12000)""",
    "answer_sections": rf"""WITH d AS (SELECT doc_id, {_LEAD} AS lead FROM documents)
SELECT doc_id, true AS answer, '- a' AS sources, CASE WHEN doc_id % 2 = 0 THEN 'b' ELSE '' END AS references, 'one [source 1];two;three [ 2 ];four' AS points,
md5({_TRIM.format("lead || '.' || chr(10) || '## Key Points' || chr(10) || '- one ' || chr(10) || chr(10) || '* two' || chr(10) || '3) three ' || chr(10) || 'no point' || chr(10) || '1. four' || chr(10) || '• five' || chr(10) || '**Sources:**' || chr(10) || '- a' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'References' || chr(10) || 'b' ELSE '' END")}) AS plain FROM d""",
    "shown_cards": f"""WITH p AS (SELECT doc_id, lang, md5({_SNIP.format(_TRIM.format('text'), 320)}) AS p FROM documents)
SELECT doc_id, '1 b ' || lang || ' # ' || p || ';2 a ' || lang || ' https://x.org/a ' || p AS cards FROM p""",
    "related_documents": "SELECT doc_id, 0::BIGINT AS position, 'a' AS title, 'https://x.org/a' AS url FROM documents UNION ALL SELECT doc_id, 1, 'b', 'ftp://x.org/b' FROM documents",
    "explorer_filtered": "SELECT doc_id, 'Blog' AS doc_kind, '2002' AS doc_year FROM documents WHERE doc_id % 3 > 0 AND lang = 'en' AND doc_id % 4 = 2 ORDER BY doc_id LIMIT 30",
    "capped_texts": "SELECT doc_id, md5(CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, 1, 994) || ' (cut)' END) AS text FROM documents",
    "enriched": """WITH d AS (SELECT doc_id, strftime(DATE '2020-01-01' + CAST(doc_id % 900 AS INTEGER), '%Y-%m-%d') AS day FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '1999-09-09' ELSE day END AS date, CASE WHEN doc_id % 4 = 0 THEN 'Jane Smith' ELSE 'Own Name' END AS author, CASE WHEN doc_id % 3 = 0 THEN 'Space Policy' ELSE '' END AS category FROM d""",
    "pdf_documents": f"""WITH d AS (SELECT doc_id, text, length(text) // 2 AS h FROM documents)
SELECT doc_id AS document_id, md5({_TRIM.format("substr(text, 1, h) || chr(10) || chr(10) || substr(text, h + 1)")}) AS text, true AS named FROM d""",
    "linked_answers": """SELECT doc_id, source || ' [[1]](https://x.org/' || doc_id || ') and ' || CASE WHEN doc_id % 2 = 0 THEN '[[2]](HTTP://y.org)' ELSE '[2]' END || ', [3](https://z.org) [[1]](https://x.org) [source 9].' AS linked FROM documents""",
    "layout_repair": """SELECT doc_id, '“It  is” — ' || source || chr(10) || chr(10) || chr(10) || '  It’s we’re' AS text, true AS was, false AS is, 'https://x.org/é/' || source AS url FROM documents""",
    "evidence_kept": _HITS + """, k AS (SELECT *, CASE WHEN NOT low AND NOT (score <> 0 AND score < 0.35 AND NOT lexical_verified) THEN 1 ELSE 0 END AS keep FROM hits)
SELECT id AS doc_id, position FROM k WHERE keep = (SELECT max(keep) FROM k)""",
    "index_round_trip": RETRIEVAL_SQL["bm25_topk"],
    "store_updates": f"""WITH {_CHUNKS.strip().replace("FROM documents)", f"FROM documents WHERE {_TRIM.format('text')} <> '' AND doc_id % 50 <> 7)", 1)}
{_SCORED}, k AS (SELECT count(DISTINCT chunk_hash) AS n FROM q WHERE quality >= 0.5)
SELECT 'documents' AS table, count(*) AS n FROM documents WHERE {_TRIM.format('text')} <> '' AND doc_id % 50 <> 7 UNION ALL SELECT 'chunks', n FROM k UNION ALL SELECT 'vectors', n FROM k""",
    "length_modes": """WITH t AS (SELECT CAST(floor(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) * 1.33::DOUBLE) AS BIGINT) AS tokens FROM documents)
SELECT mode, count(*) FILTER (tokens <= budget) AS whole, CAST(sum(greatest(0, tokens - budget)) AS BIGINT) AS beyond FROM t, (VALUES ('short', 600), ('normal', 1300), ('detailed', 2600)) m(mode, budget) GROUP BY mode""",
}
