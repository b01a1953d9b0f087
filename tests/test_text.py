from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspark.functions import dates, entities, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first().r


def test_whitespace(spark):
    assert one(spark, "a\r\n\r\n\r\n\r\nb  \t c ", text.clean_text) == "a\n\nb c"
    assert one(spark, " a b \n c\r d ", text.normalize_whitespace) == "a b\nc\nd"


def test_repair_of_misread_text():
    assert text.repair("Itâ€™s cafÃ© Â£5 â€” ok") == "It’s café £5 — ok"
    assert text.repair("Itâ€?s â€œquotedâ€ aÂ b, \u00e2\u0080\u009bx") == "It’s “quoted” a b, ‘x"
    assert text.repair("weâre here â not there") == "we’re here – not there"
    for fine in ("Alcântara Grâce château", "plain", "naïve é"):
        assert text.repair(fine) == fine


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé’—â Ã©\n", max_size=40))
def test_repair_is_idempotent_on_its_result(s):
    once = text.repair(text.repair(text.repair(s)))
    assert text.repair(once) == once


def test_quality(spark):
    assert one(spark, "plain clean words", text.quality_score) == 1.0
    assert one(spark, "", text.quality_score) == 1.0
    assert one(spark, "®ØÙÚÛÜ ÝÞßà×ÙÚ", text.quality_score) < 0.5
    assert one(spark, "décideurs réseau Alcântara", text.quality_score) == 1.0
    r = one(spark, "good line here\n\x01\x02\x03ØÙÚÛÜ\nmore", text.clean_lines)
    assert r.text == "good line here\nmore" and len(r.dropped) == 1


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="abeé ØÙÚ\n\x01漢1.", max_size=30), min_size=1, max_size=20))
def test_quality_is_the_same_in_python(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.q for r in rows.select(text.quality_score(F.col("t")).alias("q")).collect()]
    assert [round(q, 9) for q in got] == [round(text.quality(t), 9) for t in texts]


def test_tokens(spark):
    assert one(spark, "What is ATP? the big ATP", text.salient_tokens) == ["atp", "big", "atp"]
    assert one(spark, "A b,c", text.whitespace_tokens) == ["a", "b,c"]
    assert one(spark, "one two three", text.approx_token_count) == 3


def test_truncate(spark):
    assert one(spark, "word " * 100, lambda c: text.truncate(c, 12)) == "word word…"
    assert one(spark, "short", lambda c: text.truncate(c, 12)) == "short"


def test_header(spark):
    row = spark.createDataFrame([("T", " ", "x")], "title string, category string, source_name string")
    cols = {c: F.col(c) for c in row.columns}
    assert row.select(text.meta_header(cols)).first()[0] == "Title: T\nSource: x"
    assert row.select(text.meta_header({"title": F.lit("Untitled")})).first()[0] == ""


def test_linkify(spark):
    row = spark.createDataFrame([("a [Source 1] b [2] c [3]", ["https://x.org", "javascript:y"])], "a string, u array<string>")
    once = row.withColumn("a", text.linkify(F.col("a"), F.col("u")))
    want = "a [[1]](https://x.org) b [2] c [3]"
    assert once.first().a == want
    assert once.withColumn("a", text.linkify(F.col("a"), F.col("u"))).first().a == want


def test_dates(spark):
    for raw, want in {"2024-03-01": "2024-03-01", "1 March 2024": "2024-03-01", "March 1, 2024": "2024-03-01", "01-03-2024": "2024-03-01", "01/03/2024": "2024-03-01", "March 2024": "2024-03-01", "2024": "2024-01-01", "soon": "soon", "2024-13-45": "2024-13-45"}.items():
        assert one(spark, raw, dates.parse_date) == want
    assert one(spark, "/blog/2024-03-01-title", dates.date_from_dashed_path) == "2024-03-01"
    assert one(spark, "/blog/1999-03-01-title", dates.date_from_dashed_path) == ""
    assert one(spark, "text of March 3, 2021 and more", dates.date_from_text) == "2021-03-03"


def test_people(spark):
    assert entities.person_names("What has Dr Jane Smith written about trade?") == ["Jane Smith"]
    assert entities.person_names("what is trade policy?") == []
    assert entities.person_names("Which Papers are from Lighthouse?", no_names=("Lighthouse",)) == ["Papers"]
    assert entities.is_authorship_query("the works by her") and entities.is_authorship_query("contributions of hers") and not entities.is_authorship_query("essays by her")
    assert entities.is_authorship_query("Which articles did she write?") and not entities.is_authorship_query("Who is Jane Smith?")
    rows = spark.createDataFrame([("Jane Smith",), ("A. Jones, J. Smith",), ("Smithson",), (None,)], "a string")
    assert [r.m for r in rows.select(entities.author_matches(F.col("a"), ["Jane Smith"]).alias("m")).collect()] == [True, True, False, False]
    assert one(spark, "Written by Jane Smith on a day", entities.author_from_text) == "Jane Smith"
