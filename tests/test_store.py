"""The store through its life: late rows, failed checks, caches, packages, runs and crawls."""

import json

import pytest
from pyspark.sql import functions as F

from docspark.kb import Store
from docspark.operators import chunking, crawl, grounding, merge, records, shown
from docspark.operators.answer import CONTRACT, KnowledgeBase
from docspark.settings import Settings
from docspark.sources import jsonl, runs
from docspark.sources.versions import Versions, retained
from docspark.streaming import state

SETTINGS = Settings(embedding_dim=32)
DOC = "document_id string, title string, url string, source string, text string, updated_at string"


def about(topic):
    return f"Everything here is about {topic}. " * 12


def doc(i, topic, at="2024-01-01", url=None, source="website"):
    return (str(i), f"On {topic}", url or f"https://x.org/a/{i}", source, about(topic), at)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), DOC)


def test_late_rows_never_win(spark):
    old = spark.createDataFrame([(1, 10, "new"), (2, 5, "old"), (3, 7, "same"), (4, None, "undated")], "k long, at long, v string")
    delta = spark.createDataFrame([(1, 3, "late"), (2, 6, "newer"), (2, 5, "older"), (3, 7, "again"), (4, 1, "dated"), (5, None, "first")], "k long, at long, v string")
    got = {r.k: r.v for r in merge.upsert(old, delta, "k", "at").collect()}
    assert got == {1: "new", 2: "newer", 3: "again", 4: "dated", 5: "first"}


def test_state_over_many_batches(spark, tmp_path):
    """Each file is a batch; late rows change nothing, a batch that comes again neither, and other tables stay."""
    versions = Versions(spark, f"file://{tmp_path}/kb")
    versions.publish({"other": spark.range(3)})
    handle = state.upsert_into(versions, "last", "k", "at")
    batches = [[(1, 10, "a"), (2, 1, "b")], [(1, 3, "late"), (3, 1, "c")], [(2, 2, "d"), (2, 1, "late")]]
    for rows in [*batches, batches[1]]:
        handle(spark.createDataFrame(rows, "k long, at long, v string"), 0)
    assert {r.k: r.v for r in versions.table("last").collect()} == {1: "a", 2: "d", 3: "c"}
    assert versions.table("other").count() == 3 and versions.manifest()["tables"] == ["last", "other"]


def test_a_stream_of_files(spark, tmp_path):
    rows = [[(1, 10, "a")], [(1, 3, "late"), (2, 4, "b")], [(2, 9, "c")]]
    for i, r in enumerate(rows):
        spark.createDataFrame(r, "k long, at long, v string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    versions = Versions(spark, f"file://{tmp_path}/kb")
    stream = state.file_stream(spark, f"file://{tmp_path}/in", "k long, at long, v string", files=1)
    state.drain(stream, state.upsert_into(versions, "last", "k", "at"), f"file://{tmp_path}/cp").awaitTermination()
    assert len(versions.list()) == 3  # a batch for each file
    assert {r.k: r.v for r in versions.table("last").collect()} == {1: "a", 2: "c"}


def test_versions_keep_tables_and_prune(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/v")
    first = v.publish({"a": spark.range(1), "b": spark.range(5)})["version"]
    for i in range(2, 9):
        v.publish({"a": spark.range(i)})
    assert len(v.list()) == 5 and v.table("a").count() == 8 and v.table("b").count() == 5
    assert v.manifest()["counts"] == {"a": 8, "b": 5} and first not in v.list()
    now = v.manifest()
    assert v.publish({"a": spark.range(8).repartition(3)})["index_hash"] == now["index_hash"] != v.manifest(v.list()[-1])["index_hash"]
    v.rollback(now["version"])
    v.rollback()
    assert v.table("a").count() == 7 and v.table("b").count() == 5
    assert retained(["3", "1", "2"], "1", 1) == (["3", "1"], ["2"])


def test_a_version_is_checked_before_it_is_current(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/kb", SETTINGS)
    out = store.update(frame(spark, doc(1, "rivers"), (None, *doc(2, "lakes")[1:])))
    assert out["reason"] == "validation failed" and out["checks"][0]["n"] == 1
    assert store.versions.current() is None and store.versions.list() == [] and not store.status()["ready"]


def test_documents_of_one_address_collapse_in_the_merge(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/kb", SETTINGS)
    long = doc(2, "lakes", url="https://www.x.org/a/")
    out = store.update(frame(spark, doc(1, "sea", url="https://x.org/a"), (*long[:4], long[4] * 2, long[5]), doc(3, "trade")))
    assert out["published"] and (out["added"], out["url_duplicates_collapsed"], out["total"]) == (3, 1, 2)
    held = lambda name: {r.document_id for r in store.versions.table(name).collect()}
    assert held("documents") == held("chunks") == held("pieces") == {"2", "3"}
    # a richer one takes the place of a document that was there, a poorer one doesn't come in
    rich = doc(4, "seas", at="2024-03-01", url="https://x.org/a#top")
    out = store.update(frame(spark, (*rich[:4], rich[4] * 3, rich[5]), doc(5, "x", at="2024-03-01", url="http://x.org/a/3")))
    assert out["url_duplicates_collapsed"] >= 1 and "4" in held("documents") and "2" not in held("documents") and held("chunks") == held("documents")
    assert [r.document_id for r in store.open().retrieve("lakes", 3).collect() if r.lexical_verified] == []
    assert "merged" not in store.versions.manifest()["tables"]
    # late rows count as nothing
    out = store.update(frame(spark, (*rich[:4], "late", "2023-01-01")))
    assert not out["published"] and out["reason"] == "no changes" and out["updated"] == 0
    assert store.dedupe(dry_run=True) == {"published": False, "reason": "dry run", "removed": 0}


def test_segments_equal_an_index_built_anew(spark, tmp_path, monkeypatch):
    from docspark.operators import lexical, segments

    monkeypatch.setattr(segments, "RANGE_DOCS", 4)
    versions = Versions(spark, f"file://{tmp_path}/kb")
    live: dict = {}
    words = ["alpha", "beta", "gamma", "delta", "eta", "iota", "kappa"]
    text = lambda i, v: " ".join(words[(i * (k + v) + k) % (4 + i % 4)] for k in range(3 + (i * 7 + v) % 20)) if i % 9 else None

    def step(changed, removed, v):
        rows = [(i, text(i, v)) for i in changed]
        live.update(rows)
        for i in removed:
            live.pop(i, None)
        out = segments.update(versions, spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(i,) for i in removed], "id long"))
        index = segments.Segments(versions)
        anew = lexical.LexicalIndex.build(spark.createDataFrame(list(live.items()), "id long, text string"), "id", "text")
        for q in ("alpha beta", "Kappa kappa iota", "none", "gamma eta delta beta"):
            assert [tuple(r) for r in index.search(q, 6).collect()] == [tuple(r) for r in anew.search(q, 6).collect()], (v, q)
        stats, n = index.table("stats").agg(F.sum("n"), F.sum("words")).first(), sum(len((t or "").split()) for t in live.values())
        assert tuple(stats) == (len(live), n)
        return out

    step(range(60), [], 1)
    step(range(50, 80), [3, 4, 200], 2)
    step([1, 2, 3], [79, 78], 3)  # 3 comes back
    out = step([], list(range(10, 30)), 4)
    assert out["segments"] == 1 and out["merged"] == 4
    assert step([5, 6, 90], [1], 5)["merged"] == 0
    merged = [step([100 + k, 30 + k], [31 + k], 6 + k) for k in range(5)]
    assert max(m["merged"] for m in merged) >= segments.MERGE and merged[-1]["segments"] < 8
    among = spark.createDataFrame([(i,) for i in range(30, 60)], "id long")
    got = segments.Segments(versions).search("alpha beta", 4, among).collect()
    assert len(got) == 4 and {r.id for r in got} <= set(range(30, 60))


def test_few_blocks_are_read(spark, tmp_path):
    from docspark.operators import lexical, segments

    rows = [(i, "common often " * (1 + i % 3) + ("rare " * 4 if i % 97 == 0 else "") + "filler " * (i % 11)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, text string")
    versions = Versions(spark, f"file://{tmp_path}/kb")
    segments.update(versions, df)
    got = segments.Segments(versions).ask("common often rare", 10)
    assert [tuple(r) for r in got.hits.collect()] == [tuple(r) for r in lexical.LexicalIndex.build(df, "id", "text").search("common often rare", 10).collect()]
    assert 0 < got.read < got.blocks / 2


def test_an_update_tokenizes_only_its_own_chunks(spark, tmp_path, monkeypatch):
    from docspark.operators import segments

    store = Store(spark, f"file://{tmp_path}/kb", SETTINGS)
    store.update(frame(spark, *[doc(i, f"topic{i}") for i in range(12)]))
    seen = []
    real = segments.Segments.add
    monkeypatch.setattr(segments.Segments, "add", lambda self, staged, rows, removed, *a: (seen.append((rows.count(), removed.count())), real(self, staged, rows, removed, *a))[1])
    store.update(frame(spark, doc(3, "volcanoes", at="2024-02-01")), spark.createDataFrame([("4",)], "document_id string"))
    new = store.versions.table("chunks").where("document_id = '3'").count()
    assert seen[0][0] == new and seen[0][1] >= 1
    assert store.open().retrieve("volcanoes", 1).first().document_id == "3"
    assert store.open().index.search("topic4", 5).count() == 0


def test_only_changes_are_chunked_and_embedded(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/kb", SETTINGS)
    assert store.update(frame(spark, doc(1, "rivers"), doc(2, "trade")))["published"]
    seen = []
    real = chunking.chunk_documents
    monkeypatch.setattr(chunking, "chunk_documents", lambda d, *a: (seen.extend(r.document_id for r in d.select("document_id").collect()), real(d, *a))[1])
    marked = store.versions.table("vectors").withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    store.versions.publish({"vectors": marked})
    late = doc(1, "a late text", at="2023-01-01")
    out = store.update(frame(spark, doc(2, "customs", at="2024-02-01"), doc(3, "space", at="2024-02-01"), late))
    assert out["published"] and sorted(seen) == ["2", "3"]
    texts = {r.document_id: r.text for r in store.versions.table("chunks").collect()}
    assert set(texts) == {"1", "2", "3"} and "rivers" in texts["1"] and "customs" in texts["2"]
    norms = {r.id[0]: sum(x * x for x in r.embedding) for r in store.versions.table("vectors").collect()}
    assert norms["1"] == pytest.approx(4, 1e-3) and norms["2"] == pytest.approx(1, 1e-3) and norms["3"] == pytest.approx(1, 1e-3)
    assert store.update(frame(spark, doc(2, "customs", at="2024-02-01")), spark.createDataFrame([("1",), ("2",), ("3",)], "document_id string"))["reason"].startswith("the delta")
    assert store.open().version == store.versions.current()


def test_the_contract_of_an_answer(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/kb", SETTINGS)
    store.update(frame(spark, doc(1, "rivers"), doc(2, "trade", source="commit_kb")))
    kb = store.open()
    r = kb.answer("trade", conversation_id="c7", interface="chat").first()
    assert list(r.asDict()) == [f.split(" ")[0] for f in CONTRACT.replace("\n", " ").replace("sources array<struct<title: string, url: string, source_type: string, source_name: string, author: string, date: string, source: string, snippet: string>>", "sources x").split(", ")]
    assert r.grounded and r.conversation_id == "c7" and r.interface == "chat" and r.kb_version == kb.version and r.model == "extractive"
    assert r.latency_ms >= r.retrieval_ms >= 0 and r.sources[0].source == "commit_kb" and r.sources[0].url == "https://x.org/a/2"
    refused = kb.answer("???").first()
    assert not refused.grounded and refused.sources == [] and refused.kb_version == kb.version
    seen = []
    talk = KnowledgeBase(kb.chunks, kb.index, kb.vectors, 32, generator=lambda q, blocks, n: (seen.extend(blocks), "It is said [Source 1].")[1], settings=SETTINGS)
    assert talk.answer("trade").first().grounded
    assert seen[0].startswith("[Source 1] On trade | category: — | source: ") and "\nEverything here" in seen[0]


def test_filters_hold_before_the_lexical_list_is_cut(spark):
    rows = [(i, str(i), "rivers " * (5 if i < 60 else 1) + f"word{i} " * 40, "big" if i < 60 else "small") for i in range(62)]
    chunks = spark.createDataFrame(rows, "id long, document_id string, text string, source string")
    kb = KnowledgeBase.build(chunks, dim=16)
    got = kb.retrieve("rivers", 5, F.col("source") == "small").select("id", "lexical_score").collect()
    assert {r.id for r in got} == {60, 61} and all(r.lexical_score > 0 for r in got)


def test_hits_without_ids_are_one_document_only_by_title_and_source(spark):
    rows = spark.createDataFrame([("7", "T", "s"), (None, "T [PDF]", "s"), (" ", "t", "S"), (None, "U", "s")], "i string, t string, s string")
    got = [r.k for r in rows.select(grounding.document_key(F.col("i"), F.col("t"), F.col("s")).alias("k")).collect()]
    assert got == ["id:7", "t:t|s", "t:t|s", "t:u|s"]


def test_renumbered(spark):
    one = lambda text, order: spark.createDataFrame([(text, order)], "a string, o array<int>").select(grounding.renumbered(F.col("a"), F.col("o")).alias("r")).first().r
    assert one("a [Source 3] b [ source 1 ], c [Source 9] .", [3, 1]) == "a [Source 1] b [Source 2], c."
    assert one("[Source 2] x  y", []) == "x y" and one("no marker", [1]) == "no marker" and one("", [1]) == "" and one(None, [1]) is None
    assert one("too large [Source 99999999999999]!", [1]) == "too large !"


@pytest.mark.parametrize(
    ("units", "want"),
    [
        (["aaaa", "bbbb", "cccc"], ["aaaa bbbb", "bbbb cccc"]),  # the last sentence comes again
        (["aaaa", "bbbbbbbbbb"], ["aaaa", "aaaa bbbbbbbbbb"]),  # the limit is soft behind a tail
        (["aa bb cc dd ee"], ["aa bb cc", "dd ee"]),  # a long sentence is cut between words
        (["ab", "cd"], ["ab cd"]),
        (["ab"], []),  # below the least
        (["aaaa", "aa bb cc dd"], ["aaaa", "aa bb cc", "aaaa dd"]),  # what is left stands behind the tail
        ([], []),
    ],
)
def test_packing_of_sentences(units, want):
    assert chunking.pack(units, size=10, overlap=5, least=4) == want


def test_packed_chunks_cover_the_sentences():
    import random

    rng = random.Random(1)
    for _ in range(200):
        units = ["".join(rng.choices("abc ", k=rng.randrange(1, 30))).strip() or "a" for _ in range(rng.randrange(1, 12))]
        units = [" ".join(u.split()) for u in units]
        got = chunking.pack(units, size=25, overlap=8, least=0)
        assert all(len(c) <= 25 + 8 + 1 or " " not in c for c in got)
        words = " ".join(got).split()
        assert set(" ".join(units).split()) <= set(words)


def test_generated_ids_follow_the_order(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(700)], "n long, text string").repartition(5)
    got = {r.text: r.document_id for r in jsonl.normalize(rows, prefix="d", order="n").collect()}
    assert got == {f"text {i}": f"d_{i + 1:04d}" for i in range(700)}
    by_text = jsonl.normalize(rows.select("text"), prefix="d").collect()
    assert sorted(r.document_id for r in by_text) == [f"d_{i + 1:04d}" for i in range(700)]
    assert [r.content_hash for r in sorted(by_text, key=lambda r: r.document_id)] == sorted(r.content_hash for r in by_text)
    named = spark.createDataFrame([("b", "x"), ("a", "y"), (None, "z")], "n string, text string")
    assert {r.text: r.document_id for r in jsonl.normalize(named, prefix="d", order="n").collect()} == {"z": "d_0001", "y": "d_0002", "x": "d_0003"}


def test_local_files_give_what_changed(spark, tmp_path):
    path = tmp_path / "book.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in ({"document_id": "a", "text": "one"}, {"url": "https://x.org/b", "text": "two"}, {"text": "three", "source": "other"})))
    files = [(f"file://{path}", "staff_handbook", "Staff Handbook"), (f"file://{tmp_path}/none.jsonl", "local", "Local")]
    none = spark.createDataFrame([], "document_id string, content_hash string")
    first = records.local_documents(spark, files, none)
    assert {(r.text, r.source, r.source_name) for r in first.collect()} == {("one", "staff_handbook", "Staff Handbook"), ("two", "staff_handbook", "Staff Handbook"), ("three", "other", "Staff Handbook")}
    known = first.where("text <> 'two'").select("document_id", "content_hash")
    assert [r.text for r in records.local_documents(spark, files, known).collect()] == ["two"]


def test_lock_runs_and_packages(spark, tmp_path):
    root = f"file://{tmp_path}/kb"
    with runs.Lock(spark, root) as held:
        assert held and not runs.Lock(spark, root).acquire()
        assert runs.Lock(spark, root, stale=-1).acquire()
    with runs.Lock(spark, root) as again:
        assert again
    runs.record(spark, root, started_at="2024-01-01", status="ok", added=1, by_source={"website": "1"})
    runs.record(spark, root, started_at="2024-01-02", status="failed", message="no")
    assert [r.status for r in runs.history(spark, root).collect()] == ["failed", "ok"]
    with pytest.raises(ValueError, match="unknown"):
        runs.record(spark, root, nothing=1)
    a, b = Versions(spark, f"file://{tmp_path}/a"), Versions(spark, f"file://{tmp_path}/b")
    with pytest.raises(ValueError, match="no version"):
        runs.package(a, f"file://{tmp_path}/p")
    a.publish({"t": spark.range(3)})
    runs.package(a, f"file://{tmp_path}/p")
    assert runs.refresh(b, f"file://{tmp_path}/p") and b.table("t").count() == 3 and not runs.refresh(b, f"file://{tmp_path}/p")
    a.publish({"t": spark.range(4)})
    m = runs.package(a, f"file://{tmp_path}/p")
    broken = {**m, "counts": {"t": 9}}
    Versions(spark, f"file://{tmp_path}/p")._write(json.dumps(broken), "manifests", m["version"])
    with pytest.raises(ValueError, match="has 4 rows"):
        runs.install(b, f"file://{tmp_path}/p")
    assert b.table("t").count() == 3


def page(title, body, *links):
    return f"<html><body><article><h1>{title}</h1><p>{body * 30}</p>{''.join(f'<a href={u!r}>x</a>' for u in links)}</article></body></html>"


def test_a_crawl_from_seeds_to_state(spark):
    log = "url string, status string, html string"
    state = spark.createDataFrame([], "url string, content_hash string, first_seen string, last_seen string, last_changed string")
    seeds = spark.createDataFrame([("https://x.org/",)], "url string")
    first = spark.createDataFrame([
        ("https://x.org/", "ok", page("Home", "home words ", "/a/one", "https://x.org/a/two#top", "https://y.org/c", "/b.jpg", "/secret/x")),
        ("https://x.org/a/one", "ok", page("One", "first words ", "/a/three")), ("https://www.x.org/a/two/", "ok", page("Two", "second words ")),
        ("https://x.org/a/three", "ok", page("Three", "third words ")), ("https://x.org/a/lost", "ok", page("Lost", "no link leads here ")), ("https://x.org/secret/x", "ok", page("Secret", "hidden words ")),
    ], log)
    lines = spark.createDataFrame([("x.org", 0, "User-agent: *"), ("x.org", 1, "Disallow: /secret/")], "host string, n int, line string")
    rules = crawl.robots_rules(lines)
    one = crawl.run(first, state, seeds, ["x.org"], "2024-01-01", robots=rules)
    assert {r.title for r in one.documents.collect()} == {"One", "Two", "Three"}
    assert {r.change: r.n for r in one.counts.collect()} == {"added": 3, "skipped": 1, "failed": 1}
    known = spark.createDataFrame(one.state.collect(), one.state.schema)
    second = spark.createDataFrame([
        ("https://x.org/", "ok", page("Home", "home words ", "/a/one", "/a/two", "/a/new")), ("https://x.org/a/one", "ok", page("One", "other words ")),
        ("https://x.org/a/two", "not_modified", None), ("https://x.org/a/three", "gone", None), ("https://x.org/a/new", "ok", page("New", "new words ")),
    ], log)
    two = crawl.run(second, known, seeds, ["x.org"], "2024-02-01", robots=rules)
    assert {r.title for r in two.documents.collect()} == {"One", "New"}
    assert {r.url for r in two.removed.collect()} == {"https://x.org/a/three"}
    assert {r.url: (r.first_seen, r.last_changed) for r in two.state.collect()} == {"https://x.org/a/one": ("2024-01-01", "2024-02-01"), "https://x.org/a/two": ("2024-01-01", "2024-01-01"), "https://x.org/a/new": ("2024-02-01", "2024-02-01")}


def test_shown_answers(spark):
    text = "It is so [Source 2].\n\n**Key Points**\n- one [1]\n2) two\n\n## Sources\n- b"
    s = spark.createDataFrame([(text,)], "a string").select(shown.sections(F.col("a")).alias("s"), shown.visible(F.col("a"), 1).alias("v")).first()
    assert s.s.answer == "It is so [Source 2]." and s.s.sources == "- b" and s.v == "It is so [Source 2].\n• one [1]"
    assert spark.range(1).select(shown.sections(F.lit(None).cast("string")).alias("s")).first().s.answer == ""


def test_any_value_as_clean_text(spark):
    rows = spark.createDataFrame([("cafÃ©", ["a", "Itâ€™s"], {"k": "v"}, 3, None)], "a string, b array<string>, c map<string,string>, d int, e string")
    got = rows.select(*[records.clean_value(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields]).first()
    assert tuple(got) == ("café", "a It’s", "v", "3", "")


def test_append_dedupe_and_raw_pages(spark, tmp_path):
    from docspark.sources import html

    store = Store(spark, f"file://{tmp_path}/kb", SETTINGS)
    store.update(frame(spark, doc(1, "rivers"), doc(2, "trade")))
    chunks = store.versions.table("chunks")
    more = chunks.limit(1).unionByName(chunks.limit(1).withColumns({"chunk_id": F.lit("9_c0"), "document_id": F.lit("9"), "chunk_hash": F.lit("new"), "text": F.lit(about("moons"))}))
    assert store.append(more)["added"] == 1 and not store.append(more)["published"]
    assert store.open().retrieve("moons", 1).first().document_id == "9" and store.versions.table("documents").count() == 2

    store = Store(spark, f"file://{tmp_path}/other", SETTINGS)
    store.update(frame(spark, doc(1, "rivers"), doc(2, "trade")))
    docs = store.versions.table("documents")
    twin = docs.where("document_id = '1'").withColumns({"document_id": F.lit("3"), "url": F.lit("https://www.x.org/a/1/"), "text": F.concat(F.lit(about("rivers")), F.lit("more"))})
    store.versions.publish({"documents": docs.unionByName(twin)})
    out = store.dedupe()
    assert out["published"], out
    assert out["removed"] == 1 and {r.document_id for r in store.versions.table("documents").collect()} == {"2", "3"}

    raw = spark.createDataFrame([("https://x.org/a", "<p>x")], "url string, html string")
    for r in ("1", "2"):
        html.keep_raw(raw, f"file://{tmp_path}/raw", r)
    assert spark.read.parquet(f"file://{tmp_path}/raw").groupBy("url", "html").count().first()["count"] == 2


def test_runs_of_the_command_line(spark, tmp_path, capsys, monkeypatch):
    from docspark import cli

    monkeypatch.setenv("DOCSPARK_EMBEDDING_DIM", "32")
    path = tmp_path / "a.jsonl"
    path.write_text(json.dumps({"document_id": "1", "title": "T", "url": "https://x.org/1", "text": about("rivers")}))
    root = f"file://{tmp_path}/kb"
    run = lambda *args: (cli.main([root, *args], spark), json.loads(capsys.readouterr().out.strip().splitlines()[-1]))
    assert run("update", f"file://{path}")[0] == 0 and run("update", f"file://{path}")[0] == 0
    assert sorted(r["status"] for r in run("runs")[1]) == ["published", "published"]
    version = run("package", f"file://{tmp_path}/p")[1]["version"]
    other = f"file://{tmp_path}/other"
    assert cli.main([other, "refresh", f"file://{tmp_path}/p"], spark) == 0 and json.loads(capsys.readouterr().out)["installed"]
    assert Store(spark, other).versions.current() == version
