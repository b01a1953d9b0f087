import pytest
from pyspark.sql import functions as F

from docspark.functions import urls


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first().r


def test_canonical(spark):
    want = "https://x.org/a?b=2&c=1"
    for u in ("https://www.x.org/a/?c=1&b=2#top", "HTTPS://X.org/a?utm_source=q&b=2&c=1", " https://x.org/a//?b=2&c=1&ref=z "):
        assert one(spark, u, urls.canonical) == want
    assert one(spark, "http://x.org", urls.canonical) == "http://x.org/"
    once = one(spark, "https://www.x.org/a/?c=1&b", urls.canonical)
    assert one(spark, once, urls.canonical) == once


def test_scope(spark):
    inside = lambda c: urls.is_internal(c, ["x.org"])
    assert one(spark, "https://www.x.org/a", inside)
    assert not one(spark, "https://evil-x.org/a", inside)
    assert not one(spark, "https://x.org.evil.example/a", inside)


def test_pages(spark):
    low = lambda c: urls.is_low_value(c, F.lit("Some article"), F.lit(500))
    assert one(spark, "https://x.org/tag/y", low) and one(spark, "https://x.org/blogs/", low) and one(spark, "https://x.org/", low)
    assert not one(spark, "https://x.org/blogs/some-post", low)
    assert one(spark, "News", lambda c: urls.is_low_value(F.lit("https://x.org/a/b"), c, F.lit(500)))
    assert one(spark, "https://x.org/a/b", lambda c: urls.is_low_value(c, F.lit("t"), F.lit(10)))
    assert one(spark, "https://x.org/A.PDF?x=1", urls.is_pdf)
    assert one(spark, "../b", lambda c: urls.resolve(c, F.lit("https://x.org/a/c"))) == "https://x.org/b"


@pytest.mark.parametrize(
    ("url", "category", "source_type", "kind"),
    [
        ("https://x.org/semiconductor-chips/", "Semiconductors", "page", "Web page"),
        ("https://x.org/playbook/1", "China Studies", "playbook", "Playbook"),
        ("https://x.org/reports/2", "", "report", "Publication"),
        ("https://x.org/Blogs/space-policy", "Space Policy", "blog", "Blog"),
        ("https://x.org/about", "", "page", "Web page"),
    ],
)
def test_rules_of_addresses(spark, url, category, source_type, kind):
    assert (one(spark, url, urls.category_of), one(spark, url, urls.source_type_of), one(spark, url, urls.kind_of)) == (category, source_type, kind)


def test_kinds(spark):
    at = "https://x.org/a"
    assert one(spark, at, lambda u: urls.kind_of(u, pdf=F.lit(True))) == "PDF"
    assert one(spark, at, lambda u: urls.kind_of(u, (F.lit("Working Paper"), F.lit(None)))) == "Publication"
    assert one(spark, at, lambda u: urls.kind_of(u, (F.lit("our series"),), more={"Podcast": ["our series"]})) == "Podcast"
    assert one(spark, at, lambda u: urls.kind_of(u, source=F.lit("commit_kb"))) == "Commit page"
    assert one(spark, at, lambda u: urls.source_type_of(u, "commit_kb")) == "kb" and one(spark, None, urls.category_of) == ""
