import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspark.operators import analytics, answer, chunking, crawl, dense, grounding, lexical, merge, retrieve, validate
from docspark.settings import Settings


def test_settings_ignore_blank_and_malformed_values():
    s = Settings.from_env({"DOCSPARK_TOP_K": " ", "DOCSPARK_CHUNK_SIZE": "x", "DOCSPARK_MIN_SCORE": "0.5"})
    assert (s.top_k, s.chunk_size, s.min_score) == (5, 1200, 0.5)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab .", min_size=1, max_size=90).filter(str.strip), max_size=30))
def test_packing_keeps_its_limits(units):
    got = chunking.pack(units, size=80, overlap=20, least=10)
    assert all(10 <= len(c) <= 80 + 20 + 50 for c in got)
    assert all(a != b for a, b in zip(got, got[1:]))


def test_packing_splits_long_sentences_and_drops_short_rests():
    words = " ".join(f"w{i}" for i in range(40))
    got = chunking.pack([words], size=50, overlap=10, least=20)
    assert all(len(c) <= 51 for c in got) and " ".join(got).startswith("w0 w1")
    assert chunking.pack(["short"], size=50, overlap=10, least=20) == []


def test_chunks_of_documents(spark):
    text = "A sentence of some length stands here. " * 60
    rows = [("d1", "T", text, None), ("d2", "P", "", [(1, text), (2, text)]), ("d3", "S", "tiny", None), ("d4", "N", None, None)]
    docs = spark.createDataFrame(rows, "document_id string, title string, text string, pdf_pages array<struct<page_number: int, text: string>>")
    got = chunking.chunk_documents(docs).collect()
    assert {r.document_id for r in got} == {"d1", "d2"}
    assert {r.page_number for r in got if r.document_id == "d2"} == {1, 2}
    assert all(r.meta_header.startswith("Title: ") and len(r.chunk_hash) == 24 for r in got)
    assert "d1_c0" in {r.chunk_id for r in got} and "d2_p1_c0" in {r.chunk_id for r in got}


@pytest.fixture(scope="module")
def chunks(spark):
    long = " filler words to be long enough" * 8
    rows = [
        (1, "a", "monetary policy and inflation" + long, "website", "Jane Smith", "Policy", "https://x.org/p/1"),
        (2, "a", "inflation again and again" + long, "website", "Jane Smith", "Policy", "https://x.org/p/2"),
        (3, "a", "inflation for a third time" + long, "website", "Jane Smith", "Policy", "https://x.org/p/3"),
        (4, "b", "ATP stands for all things policy" + long, "commit_kb", "", "Pod", "https://x.org/p/4"),
        (5, "c", "gardens and flowers" + long, "local", "", "Home", "https://x.org/p/5"),
        (6, "d", "inflation list", "website", "", "News", "https://x.org/news/"),
    ]
    return spark.createDataFrame(rows, "id long, document_id string, text string, source string, author string, title string, url string")


def test_bm25_and_its_floor(chunks):
    index = lexical.LexicalIndex.build(chunks, "id", "text")
    got = index.search("inflation inflation", 10).collect()
    assert [r.rank for r in got] == list(range(len(got))) and all(r.bm25_score > 0 for r in got)
    assert index.search("absent", 5).count() == 0 and index.search("", 5).count() == 0


def test_retrieval_caps_documents_and_holds_listings_back(chunks):
    kb = answer.KnowledgeBase.build(chunks, dim=64)
    got = kb.retrieve("what about inflation", 5).collect()
    assert sum(r.document_id == "a" for r in got) <= 2 and 6 not in {r.id for r in got}
    only = kb.retrieve("ATP", 3, where=F.col("source") == "commit_kb").collect()
    assert {r.id for r in only} == {4} and only[0].lexical_verified


def test_author_boost(chunks):
    kb = answer.KnowledgeBase.build(chunks, dim=64)
    got = kb.retrieve("Which articles has Jane Smith written?", 3).collect()
    assert got[0].author_verified and got[0].author == "Jane Smith"


def test_answers(spark, chunks):
    kb = answer.KnowledgeBase.build(chunks, dim=64)
    good = kb.answer("inflation policy").first()
    assert good.grounded and good.sources and "[Source 1]" in good.answer and all(s.url for s in good.sources)
    for q in ("", "zebra quasar xylophone"):
        bad = kb.answer(q).first()
        assert not bad.grounded and not bad.sources and bad.answer == answer.REFUSAL


def test_gate_tiers(spark):
    def tier(score, lex=False, author=False):
        row = spark.createDataFrame([(score, 0.0, lex, author)], "score double, lexical_score double, lexical_verified boolean, author_verified boolean")
        r = retrieve.evidence(row).first()
        return r.confidence, r.sufficient

    assert tier(0.7) == ("high", True) and tier(0.5) == ("medium", True) and tier(0.4) == ("low", True)
    assert tier(0.1) == ("none", False) and tier(0.1, lex=True) == ("medium", True) and tier(0.1, author=True) == ("medium", True)
    empty = spark.createDataFrame([], "score double, lexical_score double, lexical_verified boolean, author_verified boolean")
    assert retrieve.evidence(empty).first().confidence == "none"


def test_evidence_filter_never_empties(spark):
    rows = [(1, 0.1, False, False, False), (2, 0.0, True, False, True)]
    hits = spark.createDataFrame(rows, "id int, score double, lexical_verified boolean, author_verified boolean, low_value boolean")
    assert {r.id for r in retrieve.evidence_filter(hits).collect()} == {1, 2}
    assert {r.id for r in retrieve.evidence_filter(hits.unionByName(spark.createDataFrame([(3, 0.6, False, False, False)], hits.schema))).collect()} == {3}


def test_citations(spark):
    schema = "answer string, sources array<struct<title: string, text: string>>"
    s = [("a", "alpha beta"), ("b", "gamma"), ("c", "delta")]
    rows = spark.createDataFrame([("x [Source 3] y [Source 1] , z [Source 9].", s), ("alpha beta", s), ("nothing shared at all", s), ("", s)], schema)
    got = grounding.verify(rows).collect()
    assert got[0].answer == "x [Source 1] y [Source 2], z." and [k.title for k in got[0].kept] == ["c", "a"] and got[0].grounded and got[0].dropped_uncited == 1
    assert got[1].grounded and [k.title for k in got[1].kept] == ["a"]
    assert not got[2].grounded and not got[2].kept and not got[3].grounded


def test_context_budget(spark):
    rows = spark.createDataFrame([(1, "a" * 50), (2, "b" * 30), (3, "c" * 40), (4, "d")], "p int, t string")
    assert [r.p for r in grounding.context_pack(rows, [], "p", "t", 100).orderBy("p").collect()] == [1, 2]
    cut = grounding.context_pack(rows, [], "p", "t", 20).collect()
    assert len(cut) == 1 and cut[0].t == "a" * 20 + "…"


def test_merge(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", 0)], "k int, t string, o int")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (4, "z", 1)], "k int, t string, o int")
    gone = spark.createDataFrame([(3,)], "k int")
    want = {(1, "a"), (2, "y"), (4, "z")}
    assert {(r.k, r.t) for r in merge.upsert(old, new, "k", "o", gone).collect()} == want
    assert {(r.k, r.t) for r in merge.upsert(old, new.orderBy(F.desc("o")), "k", "o", gone).repartition(3).collect()} == want
    c = merge.delta_counts(old, new, "k", gone).first()
    assert (c.added, c.updated, c.removed, c.total) == (1, 1, 1, 3)
    assert merge.would_empty(3, 0) and not merge.would_empty(0, 0)


def test_collapse_prefers_the_richer_then_the_first(spark):
    rows = [(1, "https://x.org/a/", "", 5), (2, "https://www.x.org/a?utm_source=q", "Jane", 5), (3, "https://x.org/b", "", 5), (4, "https://x.org/b/", "", 5), (5, None, "", 1), (6, "", "", 1)]
    docs = spark.createDataFrame(rows, "o int, url string, author string, n int")
    none = F.lit("")
    got = merge.collapse(docs, merge.identity(F.col("url"), F.col("o")), merge.richness(F.col("author"), none, none, F.lit(0), F.lit(True), F.col("n"), none), "o").collect()
    assert {(r.o, r.collapsed) for r in got} == {(2, 1), (3, 1), (5, 0), (6, 0)}


def test_three_crawl_runs(spark):
    schema = "url string, status string, content_hash string"
    state = spark.createDataFrame([], "url string, content_hash string, first_seen string, last_seen string, last_changed string")
    runs = [
        [("/a", "ok", "1"), ("/b", "ok", "2"), ("/c", "ok", "3")],
        [("/a", "ok", "9"), ("/b", "not_modified", None), ("/c", "gone", None), ("/d", "ok", "4")],
        [("/a", "ok", "9"), ("/b", "error", None), ("/d", "ok", "4")],
    ]
    want = [{"added": 3}, {"updated": 1, "unchanged": 1, "gone": 1, "added": 1}, {"unchanged": 2, "failed": 1}]
    for i, (run, counts) in enumerate(zip(runs, want)):
        fetches = spark.createDataFrame(run, schema)
        changes = crawl.classify(fetches, state)
        assert {r.change: r["count"] for r in changes.groupBy("change").count().collect()} == counts
        gone = crawl.removals(state, fetches, True, False)
        assert {r.url for r in gone.collect()} == ({"/c"} if i == 1 else set())
        state = spark.createDataFrame(crawl.next_state(state, changes, gone, f"t{i}").collect(), state.schema)
    assert {(r.url, r.first_seen, r.last_changed) for r in state.collect()} == {("/a", "t0", "t1"), ("/b", "t0", "t0"), ("/d", "t1", "t1")}


def test_robots(spark):
    lines = spark.createDataFrame([("x.org", 1, "User-agent: *"), ("x.org", 2, "Disallow: /private"), ("x.org", 3, "Allow: /private/open"), ("x.org", 4, "User-agent: other"), ("x.org", 5, "Disallow: /")], "host string, n int, line string")
    pages = spark.createDataFrame([("https://x.org/a",), ("https://x.org/private/b",), ("https://x.org/private/open/c",), ("https://y.org/",)], "url string")
    got = {r.url: r.allowed for r in crawl.allowed(pages, crawl.robots_rules(lines)).collect()}
    assert got == {"https://x.org/a": True, "https://x.org/private/b": False, "https://x.org/private/open/c": True, "https://y.org/": True}


def test_validation(spark):
    docs = spark.createDataFrame([("1", "https://x.org/a", "t", "", "", "website", "text"), ("2", "https://www.x.org/a/", None, "", "", "website", "text")], "document_id string, url string, title string, author string, date string, source string, text string")
    chunks = spark.createDataFrame([("c", "1", "t", "text", "h", "x"), ("d", "9", "t", "text", "h", "x")], "chunk_id string, document_id string, title string, text string, meta_header string, chunk_hash string")
    report = validate.validate(docs, chunks)
    n = {r.check: r.n for r in report.collect()}
    assert (n["duplicate_urls"], n["duplicate_texts"], n["orphan_chunks"], n["missing_title"], n["duplicate_chunks"]) == (1, 1, 1, 1, 1)
    assert not validate.passed(report).first().ok


def test_cache_and_embedding(spark):
    rows = spark.createDataFrame([("h1", "one two"), ("h2", "three"), ("h2", "three"), ("h3", "")], "chunk_hash string, text string")
    cache = rows.limit(0).select("chunk_hash").withColumn("embedding", F.lit(None).cast("array<float>"))
    got, full = dense.embed_with_cache(rows, cache, lambda c: dense.hashed_embedding(c, 16))
    assert got.count() == 4 and full.count() == 3
    again, _ = dense.embed_with_cache(rows, full, lambda c: F.raise_error(F.lit("embedded twice")).cast("array<float>"))
    assert again.count() == 4
    v = {r.chunk_hash: r.embedding for r in full.collect()}
    assert sum(x * x for x in v["h1"]) == pytest.approx(1) and v["h1"] == pytest.approx(dense.embed_query("One, TWO", 16)) and not any(v["h3"])


def test_commands():
    c = answer.parse_command('detailed public channel ~news "What is it?"')
    assert (c.destination, c.targets, c.mode, c.public, c.question) == ("channel", ("news",), "detailed", True, "What is it?")
    assert answer.parse_command("what is public policy").question == "what is public policy"


def test_index_stats(spark):
    rows = spark.createDataFrame([("a", "", 1), ("a", "x", 1), ("b", "x", 2)], "source string, category string, document_id int")
    assert {(r.source, r.category, r.chunks, r.documents) for r in analytics.index_stats(rows).collect()} == {("a", None, 2, 1), ("b", None, 1, 1), (None, "uncategorized", 1, 1), (None, "x", 2, 2), (None, None, 3, 2)}


def test_answers_of_all_documents_and_whole_texts(spark, tmp_path):
    from docspark.plans import catalog

    # the shared words stand behind the first 12 words and the first 300 characters
    early, late = " ".join(f"x{i}" for i in range(200)), " ".join(f"y{i}" for i in range(200))
    shared = " ".join(f"s{i}" for i in range(150))
    texts = {0: f"{early} {shared} {shared} {late}", 1: "short", 3: f"{early} {late}", 6: f"{early} {late}", 7: "", 12: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {n: {r.doc_id: r for r in catalog.queries()[n](spark, str(tmp_path)).collect()} for n in ("citation_parse", "verify_citations", "cited_sources")}
    assert all(set(rows) == set(texts) for rows in got.values())
    assert {i: (r.cited, r.valid) for i, r in got["citation_parse"].items()} == {0: ("", ""), 1: ("1,2,9", "1,2"), 3: ("3,2,9", "3,2"), 6: ("", ""), 7: ("2,9", "2"), 12: ("", "")}
    assert {i: r.shown for i, r in got["cited_sources"].items()} == {0: "a", 1: "a,b", 3: "c,b", 6: "a", 7: "b", 12: "a"}
    assert {i: (r.grounded, r.kept, r.dropped) for i, r in got["verify_citations"].items()} == {0: (True, 1, 2), 1: (True, 2, 1), 3: (True, 2, 1), 6: (False, 0, 3), 7: (True, 1, 2), 12: (False, 0, 3)}


def test_merge_and_overlap_of_whole_texts(spark, tmp_path):
    from docspark.plans import catalog

    same = "w " * 100  # two texts that part behind 150 characters, their copy, one longer than the cap, and one that none reaches
    texts = {0: same + "one", 2: same + "two", 4: same + "one", 8: "v " * 3000, 9: "late", 16: None, 17: " \n"}
    spark.createDataFrame([(i, "en", t) for i, t in texts.items()], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.queries()
    got = {r.document: (r.position, r.text) for r in found["doc_text_merge"](spark, str(tmp_path)).collect()}
    want = {0: (0, f"{same}one\n\n{same}two"), 1: (8, ("v " * 3000)[:4000]), 2: (16, "")}
    assert got == {k: (p, hashlib.md5(t.encode()).hexdigest()) for k, (p, t) in want.items()}

    head, tail = [f"a{i}" for i in range(100, 400)], [f"b{i}" for i in range(100, 325)] + [f"a{i}" for i in range(100, 175)]
    spark.createDataFrame([(1, f"{' '.join(head)} {' '.join(tail)}"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/o/documents.parquet")
    assert {r.doc_id: r.overlap for r in found["grounding_overlap"](spark, f"{tmp_path}/o").collect()} == {1: 0.25, 2: 0.0, 3: 0.0}
