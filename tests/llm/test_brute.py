"""The contract queries that SQL can't express, against plain definitions over whole tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from brute import brute_components, brute_removed, greedy

import corpus_pipeline
from docspark.llm import decontaminate, language, neardup, quality, queries, scratch, wordpiece
from docspark.llm.words import shingle_sets

MIDDLE = "/root/testdata/sf0.01"


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def test_packing_query(spark, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.public_vocabulary()["json_path"])
    want = {d: np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in texts_of(spark, sf_dir).items()}
    rows = queries.op2_curve_packing(spark, sf_dir).collect()
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == ends[r.doc_id] and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
        ends[r.doc_id] += r.length
    assert ends == {d: len(ids) for d, ids in want.items()}
    filled = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and sum(n < 2048 for n in filled.values()) <= 1


def test_count_query(spark, sf_dir):
    import public_tokenizers

    pieces = set(wordpiece.pieces_of(public_tokenizers.path("piece_bpe_32k.model")))
    known = {}
    for r in queries.op3_token_counts(spark, sf_dir).collect():
        words = texts_of_cache(spark, sf_dir)[r.doc_id].split()
        for w in words:
            if w not in known:
                known[w] = greedy(wordpiece.MARK + w, pieces)
        assert (r.n_words, r.n_tokens) == (len(words), sum(known[w] for w in words))


_kept = {}


def texts_of_cache(spark, sf_dir):
    if sf_dir not in _kept:
        _kept[sf_dir] = texts_of(spark, sf_dir)
    return _kept[sf_dir]


def jaccard(a, b):
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_fingerprint_query(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    ids = sorted(texts)
    after = dict(zip(ids, [*ids[1:], ids[0]]))
    rows = queries.op6_weighted_fingerprints(spark, sf_dir).collect()
    by_text, errors = defaultdict(set), []
    for r in rows:
        t, following = texts[r.doc_id], texts[after[r.doc_id]]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        by_text[t].add(r.fingerprint)
        by_text[edited].add(r.edited_fingerprint)
        if t.split() and edited.split():
            errors.append(r.near_edited - jaccard(t, edited))
        if t.split() and following.split():
            errors.append(r.near_next - jaccard(t, following))
    assert len(rows) == len(ids) and all(len(v) == 1 for v in by_text.values())
    # 32 samples: a standard error of 0.09 at most, and no bias
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.09


def test_language_query(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op7_language_id(spark, MIDDLE).collect() if r.held_out and lang[r.doc_id]]
    assert len(rows) > 200 and np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) >= 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def auc(scores, labels):
    rank = np.argsort(np.argsort(scores)) + 1.0
    good = np.array(labels) == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_quality_query(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.op10_quality_classifier(spark, folder).collect() if r.held_out and labels.get(r.doc_id) in (0, 1)]
    y = [labels[r.doc_id] for r in rows]
    assert len(rows) > 500 and auc([r.score for r in rows], y) >= 0.98
    assert np.mean([r.predicted == q for r, q in zip(rows, y)]) >= 0.95


def test_bands_and_sequential_test_lose_no_link(spark):
    """Every pair at the threshold or above shares a band and survives each look, over all pairs of the middle table."""
    import pyarrow as pa

    sets = {neardup.node_of(s): s for t in texts_of(spark, MIDDLE).values() for s in shingle_sets(pa.array([t]), 2) if len(s)}
    nodes = list(sets.values())
    low = np.array([neardup.minima(s).astype("<u2") for s in nodes])
    owner = np.repeat(np.arange(len(nodes)), [len(s) for s in nodes])
    flat = np.concatenate(nodes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]]))
    shared = Counter()
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if b - a > 1:
            own = owner[a:b].tolist()
            for i, x in enumerate(own):
                for y in own[:i]:
                    shared[min(x, y), max(x, y)] += 1
    links = [(x, y) for (x, y), n in shared.items() if 100 * n >= 80 * (len(nodes[x]) + len(nodes[y]) - n)]
    assert len(links) > 20
    for x, y in links:
        assert neardup.first_band(low[[x]], low[[y]])[0] < neardup.BANDS
        for k in range(neardup.BATCH, neardup.HASHES + 1, neardup.BATCH):
            assert (low[x, :k] == low[y, :k]).sum() >= neardup.least_matches(k, 0.8)


def test_pipeline_stages_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    made = [docs]
    for _, stage in corpus_pipeline.STAGES[:4]:
        made.append(scratch.written(stage(spark, made[-1], sf_dir), "test"))
    raw, good, single, cut, clean = (rows(x) for x in made)
    # stage 1 against its labels: clean text stays, junk goes, and equal texts share their fate
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = {q: [d in good for d in raw if labels.get(d) == q] for q in (0, 1)}
    assert np.mean(judged[1]) >= 0.97 and (not judged[0] or np.mean(judged[0]) <= 0.35)
    assert all(good[d] == raw[d] for d in good)
    fate = defaultdict(set)
    for d, t in raw.items():
        fate[t].add(d in good)
    assert all(len(x) == 1 for x in fate.values())
    ids = sorted(good)
    least = brute_components([good[i] for i in ids], 5, 80)
    assert set(single) == {ids[i] for i, c in enumerate(least) if i == c} and all(single[i] == good[i] for i in single)
    ids = sorted(single)
    kept = brute_removed([single[i] for i in ids])
    assert cut == {i: k.decode("utf-8", "ignore") for i, k in zip(ids, kept)}
    # stage 4 by plain windows of words
    items = [brute_words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 13]) for w in items if w for i in range(max(1, len(w) - 12))}
    widths = {len(w) for w in windows}
    for d, t in cut.items():
        w, hit = brute_words(t), set()
        for n in widths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        assert (d in clean) == (not hit or 20 * len(hit) < len(w)), d
    assert all(clean[d] == cut[d] for d in clean)
    # stage 5: every id of every text once, in order, in sequences without gaps
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.public_vocabulary()["json_path"])
    pieces = corpus_pipeline.packed(spark, made[4], sf_dir).collect()
    ends, filled = defaultdict(int), defaultdict(int)
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        ids = [*tok.encode(clean[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert r.start == ends[r.doc_id] and r.doc_tokens == len(ids)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start : r.start + r.length]
        ends[r.doc_id] += r.length
    assert set(ends) == set(clean) and all(ends[r.doc_id] == r.doc_tokens for r in pieces)
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and sum(n < 2048 for n in filled.values()) <= 1


def brute_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_two_results_at_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    first = corpus_pipeline.packed(spark, docs, sf_dir)
    second = corpus_pipeline.packed(spark, docs, sf_dir).where("length > 1")
    third = corpus_pipeline.one_of_each(spark, docs, sf_dir).select("doc_id")
    corpus_pipeline.no_repeats(spark, docs, sf_dir).count()
    assert first.count() >= second.count() > 0 and third.count() > 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_clashing_columns(spark, sf_dir, odd, stage):
    from pyspark.sql import functions as F

    docs = odd.withColumn("n_chars", F.length("text").cast("long"))
    got = corpus_pipeline.STAGES[stage][1](spark, docs, sf_dir)
    if stage < 4:
        assert got.columns == docs.columns
        assert {c for c in ("node", "kept", "found", "n_words", "score") for r in got.collect() if r[c] != "clash"} == set()
    else:
        assert got.count() >= odd.count()


def test_language_model_ties(spark):
    model = language.Model.of([("a", np.array([1], np.uint32)), ("b", np.array([1], np.uint32))])
    docs = spark.createDataFrame([("x",), ("zzzz zzzz",), ("12",), (None,)], "text string")
    got = language.add_language(docs, model, into=("l", "s")).collect()
    assert [(r.l, r.s) for r in got] == [("a", 0.0), ("a", 0.0), (language.UNKNOWN, 0.0), (language.UNKNOWN, 0.0)]
