"""Queries against their SQL on texts that part the two easily."""

import duckdb
import pytest

from docspark.plans import catalog
from docspark.sources import html

LONG = " ".join(["Ein Satz steht hier und sagt nichts Neues."] * 8)


def rows(spark, tmp_path, name, table, data, schema):
    """A query's rows and those of its SQL on one small table."""
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = [tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect()]
    return sorted(map(repr, got)), sorted(map(repr, db.execute(catalog.oracle_sql()[name]).fetchall()))


DOCS = "doc_id long, text string, lang string, source string"


def test_answer_sections_keep_space_that_no_reference_left(spark, tmp_path):
    texts = ["That*** atly.###", "one two [three] four", "Aiè.", "a, b ; c .", "x" * 30]
    got, want = rows(spark, tmp_path, "answer_sections", "documents", [(i, t, "en", "s") for i, t in enumerate(texts)], DOCS)
    assert got == want


@pytest.mark.parametrize("name", ["chunk_dedupe", "chunk_documents"])
def test_chunks_keep_every_line(spark, tmp_path, name):
    texts = [f"{LONG}\nLa la éçèê.\n{LONG}", f"{LONG}\nStüä.", LONG]
    got, want = rows(spark, tmp_path, name, "documents", [(i, t, "fr", "s") for i, t in enumerate(texts)], DOCS)
    assert got == want and len(got) >= 3


def test_chunk_stats_keep_every_line(spark, tmp_path):
    # 195 characters in a line, and a short one of accented letters that makes a chunk of them
    texts = [f"{LONG[:194]}.\nÄöüß äöüß.", LONG]
    got, want = rows(spark, tmp_path, "chunk_stats", "documents", [(i, t, "de", "commit_kb") for i, t in enumerate(texts)], DOCS)
    assert got == want and got[0].startswith("(2, 2,")


def test_merged_text_ends_in_the_line_ends_before_the_cap(spark, tmp_path):
    # two texts of 3,998 characters with what is between them: the third begins at 4,000
    texts = {0: "a" * 2830, 1: "b" * 1166, 2: "c" * 99, 8: "d" * 3999, 9: "e", 16: "f" * 4000, 17: "g", 24: "h" * 3998, 25: "i"}
    got, want = rows(spark, tmp_path, "doc_text_merge", "documents", [(i, t, "de", "s") for i, t in texts.items()], DOCS)
    assert got == want


def test_html_titles_as_they_stand(spark, tmp_path):
    pages = ["<html lang=\"de\"><title>T</title><h1> Und &amp; so &quot;x </h1>", "<h1>cut &amp", "<h1> </h1><title>A &lt; b", "<p>none", "<h1>one<b>two</b></h1>"]
    got, want = rows(spark, tmp_path, "html_title", "pages", [(i, f"https://x.org/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    assert got == want


def test_answer_sections_of_texts_that_are_empty_or_begin_with_a_gap(spark, tmp_path):
    texts = ["", " ", "\n", "# Heading of it", "* one [two] three", "\n\nText below. "]
    got, want = rows(spark, tmp_path, "answer_sections", "documents", [(i, t, "en", "s") for i, t in enumerate(texts)], DOCS)
    assert got == want


def test_meta_header_counts_the_gap_above_a_blank_text(spark, tmp_path):
    texts = ["", " ", "\n", "\nbelow ", "Untitled", "One.\nTwo."]
    got, want = rows(spark, tmp_path, "meta_header", "documents", [(i, t, "en", "s") for i, t in enumerate([*texts, None])] + [(9, "\nx", "en", None)], DOCS)
    assert got == want


def test_html_extract_leaves_references_that_a_cut_has_opened(spark, tmp_path):
    cuts = ["&", "&q", "&quo", "&quot", "&quot;", "&am", "&amp", "&amp;", "&lt", "&gt", "&lt;b&gt;", "&amp;quot;", "&quotx", "&notit;", "&copy", "a &amp b &quot c"]
    body = "<p>Some plain words that fill the article up to forty characters.</p>"
    page = lambda cut: f'<!DOCTYPE html><html lang="en"><head><title>t</title><script>var t="&quot";</script></head><body><article><h1>A title {cut}</h1>{body}<p>{cut}</p></article></body></html>'
    got, want = rows(spark, tmp_path, "html_extract", "pages", [(i, f"https://x.org/{i}", page(c)) for i, c in enumerate(cuts)], "page_id long, url string, html string")
    assert got == want


def test_scripts_and_addresses_keep_what_looks_like_a_reference():
    page = html.read_page('<script type="application/ld+json">{"author": "A &copy B &quot"}</script><a href="/x?a=1&copy=2&amp;b=3">T &copy; &quot</a>', "https://x.org/")
    assert page["ld"] == ['{"author": "A &copy B &quot"}'] and page["links"] == ["https://x.org/x?a=1&copy=2&b=3"]
    assert page["text"] == "T © &quot"
