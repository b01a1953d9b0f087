import json
import re

import pytest
from pyspark.sql import functions as F

from docspark.functions import jsonld
from docspark.sources import html, jsonl
from docspark.sources.versions import Versions
from docspark.streaming import state


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "title": "T", "content": "body  text", "url": "https://x.org/2024-03-01-t"}\n\nnot json\n{"title": "U", "text": "more"}\n{"text": " "}\n')
    schema = "id string, title string, content string, text string, url string, date string"
    raw = jsonl.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", schema)
    docs = {r.document_id: r for r in jsonl.normalize(raw.where("title is not null or text is not null")).collect()}
    assert docs["1"].text == "body text" and docs["1"].date == "2024-03-01" and docs["doc_0001"].title == "U"
    assert jsonl.malformed_lines(spark, f"file://{tmp_path}/a.jsonl") == 1
    assert jsonl.read_jsonl(spark, f"file://{tmp_path}/none.jsonl").count() == 0
    jsonl.write_csv(jsonl.normalize(raw), f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == 2


PAGE = """<html lang="en"><head><title>Site</title><meta property="og:title" content="The Title"><meta name="keywords" content="a, b">
<script type="application/ld+json">{"@graph": [{"@type": "Article", "author": {"name": "Jane Smith"}, "datePublished": "2024-03-01T10:00:00Z", "keywords": "b, c",}]}</script></head>
<body><nav><a href="/home">Home</a></nav><article><h1>Heading</h1><p>First &amp; foremost, a paragraph of text that is long enough.</p><a href="/f.pdf?x=1">file</a><a href="mailto:a@b.c">m</a></article><footer>foot</footer></body></html>"""


def test_page(spark):
    rows = [("https://x.org/p", PAGE), (None, None), ("u", "<p>unclosed")]
    got, none, unclosed = [r.page for r in html.extract(spark.createDataFrame(rows, "url string, html string")).collect()]
    assert (got["title"], got["author"], got["date"], got["lang"]) == ("The Title", "Jane Smith", "2024-03-01", "en")
    assert got["tags"] == ["b", "c", "a"] and got["pdf_urls"] == ["https://x.org/f.pdf?x=1"]
    assert "First & foremost" in got["text"] and "foot" not in got["text"] and "Home" not in got["text"]
    assert none["text"] == "" and unclosed["text"] == "unclosed" and none["links"] == [] and none["breadcrumbs"] == []


def plain_facts(scripts):
    """What JSON-LD says, by a walk over Python's objects."""
    found, queue = {}, []
    for raw in scripts:
        for attempt in (raw, re.sub(r",\s*([}\]])", r"\1", raw)):
            try:
                queue.append(json.loads(attempt))
                break
            except ValueError:
                pass
    while queue:
        x = queue.pop(0)
        if isinstance(x, list):
            queue += x
        elif isinstance(x, dict):
            queue += x.get("@graph") if isinstance(x.get("@graph"), list) else []
            if x.get("@type") == "BreadcrumbList":
                items = x.get("itemListElement") or []
                found.setdefault("breadcrumbs", [str(i.get("name") or (i.get("item") or {}).get("name") or "") if isinstance(i, dict) else "" for i in items])
            for key in ("author", "datePublished", "keywords", "articleSection", "headline"):
                if x.get(key):
                    found.setdefault(key, x[key])
    return found


def plain_names(v):
    if isinstance(v, str):
        return [s.strip() for s in v.split(",") if s.strip()]
    if isinstance(v, dict):
        return plain_names(v.get("name") or "")
    return [n for x in v for n in plain_names(x)] if isinstance(v, list) else []


def test_json_ld_by_a_plain_walk(spark):
    pages = [
        ['{"author": "A B, C D", "headline": "one"}', '{"author": "later", "datePublished": "2024-01-02"}'],
        ['[{"author": [{"name": "A"}, "B", {"name": ""}, ["C", {"name": "D"}]]}, {"headline": ""}, {"headline": "two"}]'],
        ['{"@graph": [{"@graph": [{"headline": "deep"}]}, {"headline": "higher"}], "keywords": ["x, y", "z"]}'],
        ['{"@type": "BreadcrumbList", "itemListElement": [{"name": "a"}, {"item": {"name": "b"}}, {"position": 3}, "s"]}', '{"@type": "BreadcrumbList", "itemListElement": [{"name": "no"}]}'],
        ["no json", "{broken", '{"headline": "fine", }', "[1, 2,]", "null", '"text"'],
        ['{"author": {"name": ["P", "Q"]}, "articleSection": ["s", "t"], "datePublished": 20240102, "headline": 0}'],
        ['{"author": null, "keywords": [], "headline": false}', '{"keywords": {}, "author": {"name": "Z"}}'],
        [],
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, ld array<string>").withColumn("o", jsonld.objects("ld"))
    of = lambda k: jsonld.field(F.col("o"), k)
    got = df.select("i", jsonld.breadcrumbs(F.col("o")).alias("breadcrumbs"), *[jsonld.names(of(k)).alias(k) for k in ("author", "keywords", "articleSection")], *[jsonld.text(of(k)).alias(k) for k in ("headline", "datePublished")])
    for r in got.collect():
        want = plain_facts(pages[r.i])
        assert r.breadcrumbs == want.get("breadcrumbs"), r.i
        assert all(r[k] == plain_names(want.get(k)) for k in ("author", "keywords", "articleSection")), r.i
        assert all(r[k] == (str(want[k]) if k in want else None) for k in ("headline", "datePublished")), r.i


def test_documents_of_pages(spark):
    pages = spark.createDataFrame([("https://x.org/p", PAGE), ("https://x.org/q", "<p>thin</p>"), (None, None)], "url string, html string")
    got = html.documents(pages, least=20).collect()
    assert [r.url for r in got] == ["https://x.org/p"] and got[0].document_id.startswith("website_")


def test_sitemap(spark):
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://x.org/a </loc></url><url><loc>https://x.org/b</loc></url></urlset>'
    assert {r.url for r in html.sitemap_urls(spark.createDataFrame([(xml,)], "xml string")).collect()} == {"https://x.org/a", "https://x.org/b"}


def test_versions(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/kb")
    assert v.current() is None and v.list() == []
    first = v.publish({"docs": spark.range(3)})["version"]
    second = v.publish({"docs": spark.range(5)})["version"]
    assert v.current() == second and v.table("docs").count() == 5 and v.manifest()["counts"] == {"docs": 5}
    assert v.rollback()["version"] == first and v.table("docs").count() == 3
    for n in range(6):
        v.publish({"docs": spark.range(n)})
    assert len(v.list()) == 5
    with pytest.raises(ValueError):
        v.rollback("no such version")


def test_state_by_micro_batches_is_idempotent(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, o int, t string").write.parquet(f"file://{tmp_path}/in/1")
    v = Versions(spark, f"file://{tmp_path}/kb")
    handle = state.upsert_into(v, "t", "k", "o")
    stream = state.file_stream(spark, f"file://{tmp_path}/in/*", "k int, o int, t string")
    state.drain(stream, handle, f"file://{tmp_path}/cp").awaitTermination()
    handle(spark.read.parquet(f"file://{tmp_path}/in/1"), 0)
    assert {(r.k, r.t) for r in v.table("t").collect()} == {(1, "b"), (2, "c")}


def test_feedback_is_cut(spark):
    row = spark.createDataFrame([("t", "Helpful", "q" * 900, "u", "1", "c", "p")], "ts string, verdict string, question string, user_name string, user_id string, channel_id string, post_id string")
    got = state.feedback(row).first()
    assert got.verdict == "helpful" and len(got.question) == 500 and json.loads(json.dumps(got.asDict()))
