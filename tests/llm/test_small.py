"""Operators on small tables: defined results for every odd case, and brute force where there is no SQL."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute import brute_components, brute_removed, greedy, shingles

from docspark.llm import chat, decontaminate, fingerprints, graph, language, neardup, packing, quality, scratch, sharding, suffix, wordpiece, words
from docspark.llm.queries import public_vocabulary

# ---- chat ---------------------------------------------------------------------------------

TEXT = st.text(alphabet="ab\\<>[]/|sINTYi_mstarend\n é", max_size=40) | st.sampled_from([*chat.CONTROL, "<\\s>", "<\\\\|im_end|>\n", "[\\INST]"])


def test_template_round_trip(spark):
    random.seed(1)
    made = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
    def gather(turns):
        made.append(turns)

    gather()
    rows = spark.createDataFrame([(i, [(r, t) for r, t in m]) for i, m in enumerate(made)], f"i int, turns {chat.TURNS}")
    out = rows.select("i", "turns", chat.render(F.col("turns")).alias("o")).select("i", "turns", chat.parse(F.col("o.formatted")).alias("back"), chat.masked_text(F.col("o.formatted"), F.col("o.mask")).alias("loss"), "o.formatted")
    for r in out.collect():
        assert r.back == r.turns
        assert r.loss == "".join(t.text for t in r.turns if t.role == "assistant")
        for piece in r.formatted.split("<|im_start|>")[1:]:
            assert not any(c in piece.split("\n", 1)[1].removesuffix("<|im_end|>\n") for c in chat.CONTROL)


def test_a_wrong_mask_is_noticed(spark):
    turns = spark.createDataFrame([([("user", "one two"), ("assistant", "three\nfour </s>")],)], chat.TURNS.join(["turns ", ""]))
    out = turns.select(chat.render(F.col("turns")).alias("o")).select("o.formatted", "o.mask")
    assert out.select(chat.masked_text(F.col("formatted"), F.col("mask")).alias("t")).first().t == "three\nfour </s>"
    for change in (lambda m: m.withField("before", m["before"] + 1), lambda m: m.withField("text", m["text"] - 1), lambda m: m.withField("before", m["before"] + 1).withField("after", m["after"] - 1)):
        wrong = out.withColumn("mask", F.transform("mask", change))
        with pytest.raises(Exception, match="mask does not fit"):
            wrong.select(chat.masked_text(F.col("formatted"), F.col("mask"))).collect()


def test_layouts(spark):
    import json

    records = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        "from_value": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "instruction_output": {"instruction": "q", "output": "a"},
        "prompt_completion": {"prompt": "q", "completion": "a"},
        "question_answer": {"question": "q", "answer": "a"},
        "prompt_response": {"response": "a", "prompt": "q"},
    }
    rows = [(k, json.dumps(v)) for k, v in records.items()] + [("with_input", json.dumps({"instruction": "q", "input": "i", "output": "a"})), ("unknown", '{"x": [1, {"y": null}]}'), ("broken", "{"), ("null", None)]
    rows += [("dialog", json.dumps({"system": "s", "dialog": [{"user": "q", "assistant": "a"}]}))]
    df = spark.createDataFrame(rows, "name string, record string")
    got = {r.name: r for r in df.select("name", chat.record_turns("record").alias("t"), chat.json_fingerprint(F.col("record")).alias("f")).collect()}
    for k in records:
        assert [(t.role, t.text) for t in got[k].t] == [("user", "q"), ("assistant", "a")]
        assert got[k].f == next(x for x in chat.LAYOUTS if x.name == k).fingerprint
    assert [(t.role, t.text) for t in got["with_input"].t] == [("user", "q\n\ni"), ("assistant", "a")]
    assert [(t.role, t.text) for t in got["dialog"].t] == [("system", "s"), ("user", "q"), ("assistant", "a")]
    assert got["unknown"].t is None and got["broken"].t is None and got["null"].t is None


def test_turn_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (None, 0, None, "x"), (2, None, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.gather_turns(df, "conv_id", "turn").collect()}
    assert got == {1: [("user", ""), ("assistant", "a"), ("assistant", "b")], None: [(None, "x")], 2: [("user", "y")]}
    back = spark.createDataFrame([([(None, None)],)], f"turns {chat.TURNS}").select(chat.render(F.col("turns")).alias("o")).select(chat.parse(F.col("o.formatted")).alias("b")).first().b
    assert [(t.role, t.text) for t in back] == [("", "")]


# ---- sharding -----------------------------------------------------------------------------


def jump(key, n):
    b, j = -1, 0
    key &= 2**64 - 1
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 24, 1000])
def test_jump_hash_is_the_published_one(spark, n):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *[random.Random(n * 100 + i).randrange(-(2**63), 2**63) for i in range(50)]]
    got = sharding.place(spark.createDataFrame([(k,) for k in keys], "k long"), "k", n).collect()
    assert all(r.shard == jump(r.k, n) and r.grown_shard == jump(r.k, n + 1) for r in got)
    assert all(r.grown_shard in (r.shard, n) for r in got)


def test_shards_of_odd_rows(odd, none):
    got = sharding.shard_documents(odd, 5).collect()
    assert len(got) == odd.count()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 4} == {(8, 0)}
    assert sharding.shard_documents(none, 5).count() == 0


@pytest.mark.parametrize("bounds", [4096, 4])
def test_slots_over_blocks_and_a_hot_key(spark, monkeypatch, bounds):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 20)
    monkeypatch.setattr(sharding, "MOST_BOUNDS", bounds)
    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    got = sharding.shard_documents(df, 4).orderBy("shard", "slot").collect()
    for s in range(4):
        own = [r for r in got if r.shard == s]
        assert [r.slot for r in own] == list(range(len(own)))
        assert [r.doc_id for r in own] == sorted(r.doc_id for r in own)


# ---- packing ------------------------------------------------------------------------------


def test_packing_round_trip(odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_vocabulary()["json_path"])
    got = packing.pack(odd, 64, **public_vocabulary()).collect()
    by_place = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in by_place:
        assert r.sequence_id * 64 + r.offset == at and r.offset + r.length <= 64
        at += r.length
    docs = Counter()
    for r in got:
        docs[r.doc_id] += r.length
    want = Counter()
    for d, t in [(r.doc_id, r.text) for r in odd.collect()]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want[d] += len(ids)
        if d == 8:
            pieces = sorted((r for r in got if r.doc_id == 8), key=lambda r: r.start)
            assert np.frombuffer(b"".join(bytes(p.ids) for p in pieces), "<u4").tolist() == ids
    assert docs == want and packing.pack(none, 64, **public_vocabulary()).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text(alphabet=" \t\n\r\x0b\x0c\x1c\x85\xa0 '’ab1é²¾!…", max_size=30))
def test_both_tokenizer_libraries_agree(text):
    vocabulary = public_vocabulary()
    enc = packing.encoder(**vocabulary)
    assert enc.ids(text).tolist() == enc.slow.encode(text, add_special_tokens=False).ids


def test_hilbert_neighbours():
    cells = {packing.hilbert_key([x, y, z], 3): (x, y, z) for x in range(8) for y in range(8) for z in range(8)}
    assert sorted(cells) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(cells[i], cells[i + 1])) == 1 for i in range(511))


# ---- token counts -------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcé", min_size=1, max_size=6), min_size=1, max_size=12), st.lists(st.text(alphabet="abcéx漢", max_size=15), max_size=6))
def test_automaton_is_greedy_longest_match(pieces, texts):
    # a letter that is no piece, not even of a longer one, counts as its bytes
    machine = wordpiece.Automaton(pieces)
    want = [greedy(t, set(pieces)) for t in texts]
    assert machine.count(texts).tolist() == want
    assert [machine.count_one(np.array([ord(c) for c in t], np.int64)) for t in texts] == want
    long = ["".join(pieces) * 60, "abé漢" * 80]  # words above the length that advances together
    assert machine.count(long).tolist() == [greedy(t, set(pieces)) for t in long]


def test_counts_of_odd_rows(odd, none):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in wordpiece.add_counts(odd, path).where("doc_id is not null").collect()}
    assert got[3] == got[4] == got[7] == (0, 0) and got[5][0] == 60_000 and got[6][0] == 1
    assert wordpiece.add_counts(none, path).count() == 0


# ---- words and near duplicates -------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbB é\t\n\x0b\x1c\xa0", max_size=30), max_size=8), st.integers(1, 4))
def test_sets_have_the_sizes_of_word_shingles(texts, width):
    got = words.shingle_sets(pa.array(texts, pa.string()), width)
    assert [len(s) for s in got] == [len(shingles(t, width)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(np.intersect1d(got[i], got[j])) == len(shingles(a, width) & shingles(b, width))


def test_words_across_chunks(monkeypatch):
    texts = ["x" * 50 + " yy zz", None, "", "aa bb " * 20, "q"]
    whole = [s.tolist() for s in words.shingle_sets(pa.array(texts), 1)]
    monkeypatch.setattr(words, "CHUNK", 7)
    assert [s.tolist() for s in words.shingle_sets(pa.array(texts), 1)] == whole


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100, 200: 200}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_by_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    texts = []
    for i in range(160):  # one dense group: each a few edits away from the base, so that many pairs are near the threshold
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(60)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    for i in range(60):
        w = [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30))]
        texts += [" ".join(w), " ".join(w[:-1] + ["end"]), " ".join(w).upper()]
    rng.shuffle(texts)
    monkeypatch.setattr(neardup, "TILE", 2500)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for width, percent in ((2, 80), (5, 80), (1, 90)):
        got = {r.id: r for r in neardup.near_duplicates(docs, width=width, percent=percent).collect()}
        want = brute_components(texts, width, percent)
        assert [got[i].component_id for i in range(len(texts))] == want
        assert [got[i].n_shingles for i in range(len(texts))] == [len(shingles(t, width)) for t in texts]
        assert all(got[i].kept == (i == want[i]) for i in range(len(texts)))


def test_near_duplicates_of_odd_rows(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.id: r for r in got}
    assert by[1].component_id == by[2].component_id == 1 and by[3].component_id == 3 and by[3].n_shingles == 0 and by[4].kept and by[7].n_shingles == 0
    assert by[None].component_id is None and by[None].kept
    assert neardup.near_duplicates(none).count() == 0


def test_bayes_bounds():
    least = [neardup.least_matches(n, 0.8) for n in (32, 64, 96, 128)]
    assert least == sorted(least) and least[-1] < 0.8 * 128
    assert neardup.least_matches(128, 0.8, 1e-2) > least[-1]


# ---- fingerprints ---------------------------------------------------------------------------


def test_collisions_estimate_generalised_jaccard(spark):
    rng = random.Random(3)
    pairs, want = [], []
    for i in range(150):  # each pair has words of its own, so that errors are independent
        common = [f"c{i}.{rng.randrange(60)}" for _ in range(rng.randrange(5, 60))]
        a, b = (common + [f"{x}{i}.{rng.randrange(40)}" for _ in range(rng.randrange(5, 60))] for x in "ab")
        p, q = Counter(a), Counter(b)
        want.append(sum((p & q).values()) / sum((p | q).values()))
        pairs.append((len(pairs), " ".join(a), " ".join(b)))
    rows = spark.createDataFrame(pairs, "i int, a string, b string").repartition(3)
    got = {r.i: r.near for r in fingerprints.fingerprint_pairs(rows, ["i"], "a", "b").select("i", fingerprints.likeness(F.col("a"), F.col("b")).alias("near")).collect()}
    error = np.array([got[i] - w for i, w in enumerate(want)])
    assert abs(error.mean()) < 0.025 and error.std() < 0.11


def test_terms(spark):
    row = spark.createDataFrame([("a b a", "b b c"), ("", ""), ("x", "")], "p string, q string")
    got = row.select(fingerprints.terms(fingerprints.words(F.col("p")), fingerprints.words(F.col("q"))).alias("t")).collect()
    assert sorted((t.a, t.b) for t in got[0].t) == [(0, 1), (1, 2), (2, 0)] and got[1].t == [] and [(t.a, t.b) for t in got[2].t] == [(1, 0)]


def test_fingerprints_of_odd_rows(odd, none):
    got = fingerprints.edited_fingerprints(odd).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode())))
    want = []
    for i, (d, t) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)
    same = {r.fingerprint for r in got if r.doc_id in (1, 2)}
    assert len(same) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_neighbours_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 3)
    df = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.edited_fingerprints(df).collect()}
    text = [f"text number {i}" for i in range(20)]
    for i, t in enumerate(text):
        half = len(t) // 2
        assert got[i] == hashlib.sha256((t[: len(t) - half] + text[(i + 1) % 20][:half]).encode()).hexdigest()


# ---- language -------------------------------------------------------------------------------


def test_language(spark, odd, none):
    rng = random.Random(1)
    syllables = {"en": "the th ing er on and", "de": "sch ung ein ich der pf", "fr": "eau oi les que é tion"}
    rows = []
    for i in range(240):
        lang = list(syllables)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(syllables[lang].split(), k=rng.randrange(1, 4))) for _ in range(40)), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = language.held_out(F.col("doc_id"))
    model = language.fit(df.where(~held))
    got = language.add_language(df.where(held), model).collect()
    assert len(got) > 30 and all(r.lang == r.lang_pred and 0 < r.score <= 1 for r in got)
    strange = {r.doc_id: (r.lang_pred, r["score"]) for r in language.add_language(odd.drop("score"), model).collect()}
    assert strange[3] == strange[4] == strange[7] == ("und", 0.0) and strange[1][0] != "und"
    blank = language.fit(none)
    assert blank.languages == () and language.add_language(odd.drop("score"), blank).where("lang_pred <> 'und'").count() == 0


def test_ngrams_of_windows(monkeypatch):
    texts = pa.array(["Hello, World and more", None, "", "ab", "éa bc de", "x" * 100])

    def everything():
        out = [Counter() for _ in texts]
        for data, starts, owners in language.windows(texts):
            code, first = language.grams(data, starts)
            for k, o in enumerate(owners.tolist()):
                out[o].update(code[first[k] : first[k + 1]].tolist())
        return out

    whole = everything()
    assert sum(whole[5].values()) == 97 and not whole[3] and not whole[1]
    monkeypatch.setattr(language, "WINDOW", 9)
    assert everything() == whole


# ---- decontamination --------------------------------------------------------------------------


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aA z'Z\u212a\u0130\u03a3\u03c3\u03c2\u0391É漢-_9\x00\x7f", max_size=25), min_size=1, max_size=5))
def test_words_keep_their_places_in_lower_case(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(decontaminate.words(F.col("t")).alias("w"), decontaminate.alike(F.col("t")).alias("a"), decontaminate.n_words(F.col("t")).alias("n"), F.transform(decontaminate.words(F.col("t")), decontaminate._low).alias("l")).collect():
        assert len(r.w) == len(r.a) == r.n and r.a == r.l


def test_contamination(spark, odd, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    items = spark.createDataFrame([(1, item, "c"), (2, "Short item", "c"), (3, "", "c"), (4, None, "c"), (1, item, "c")], "item_id long, text string, n_words string")
    rows = [
        (1, "say " + item.upper() + " end"), (2, " ".join(item.split()[:12])), (3, "x " * 400 + "short, item"), (4, "short ITEM short item"), (5, None), (6, ""), (7, " ".join(item.split()[1:14])), (8, "alpha " * 50 + item.replace("mu", "mü")),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1]["items"], got[1].contaminated) == (17, 15, ["1"], True)
    assert got[2].n_hit == 0 and (got[3].n_hit, got[3].contaminated) == (2, False) and (got[4].n_hit, got[4].contaminated) == (4, True)
    assert got[5].n_words == got[6].n_words == 0 and not got[5].contaminated and got[7].n_hit == 13 and got[8].n_hit == 0
    strange = decontaminate.contamination(odd.drop("n_words"), items)
    assert strange.count() == odd.count() and set(odd.columns) <= set(strange.columns)
    assert decontaminate.contamination(none.drop("n_words"), items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0


# ---- repeated strings ---------------------------------------------------------------------------


def test_repeats_by_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda k: " ".join("".join(rng.choices("abcdefghé", k=rng.randrange(2, 9))) for _ in range(k))
    passage, line = word(120), word(20)
    texts = [word(rng.randrange(1, 120)) for _ in range(30)]
    texts += [word(40) + passage[rng.randrange(60) : 200 + rng.randrange(300)] + word(30) for _ in range(25)]
    texts += [word(5) + line + word(40) for _ in range(10)] + [passage, passage, "a" * 450, "ab" * 300, "x" * 199, "x" * 200, "", None]
    texts += [texts[3] + " and " + texts[3], texts[40][:150] + "Z" + texts[40][151:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for most, room in ((20_000, 8 << 20), (2, 8 << 20), (20_000, 24)):
        monkeypatch.setattr(suffix, "MOST_STRINGS", most)
        monkeypatch.setattr(suffix, "MOST_BROADCAST", room)
        got = {r.doc_id: bytes(r["kept"]) for r in suffix.remove_repeats(docs).collect()}
        assert [got[i] for i in range(len(texts))] == brute_removed(texts)


def test_repeats_of_odd_rows(odd, none):
    got = suffix.remove_repeats(odd, as_text=True)
    assert got.columns == [c for c in odd.columns if c not in ("spans", "kept")] + ["spans", "kept"] and {r.found for r in got.collect()} == {"clash"}
    named = suffix.remove_repeats(odd, into=("gone", "rest")).first()
    assert named.kept == named.spans == "clash" and isinstance(named.rest, bytes | bytearray)
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == odd.count() and by[5].kept == "" and by[3].kept == by[4].kept == "" and by[8].kept == by[8].text
    assert suffix.remove_repeats(none).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=14), min_size=1, max_size=9), st.integers(1, 6), st.integers(1, 4))
def test_merged_transforms_find_what_sorting_finds(texts, steps, shards):
    strings = [np.array([ord(c) - 96 for c in t], np.int64) for t in texts]
    got = suffix.repeated(strings, steps, shards)
    n = Counter(t[i : i + steps] for t in texts for i in range(len(t) - steps + 1))
    assert [g.tolist() for g in got] == [[i for i in range(len(t) - steps + 1) if n[t[i : i + steps]] > 1] for t in texts]


def test_merge_gives_the_whole_interleave_and_prefix_lengths():
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab", k=rng.randrange(1, 12))) for _ in range(12)]
    strings = [np.array([ord(c) - 96 for c in t], np.int64) for t in texts]
    dealt = [list(range(i, 12, 3)) for i in range(3)]
    both = [suffix.transform([strings[i] for i in d]) for d in dealt]
    source, common = suffix.merge([t for t, _ in both], [len(d) for d in dealt], 20)
    order = {i: k for k, i in enumerate(x for d in dealt for x in d)}
    suffixes = sorted(((texts[i][p:], s, order[i]) for s, d in enumerate(dealt) for i in d for p in range(len(texts[i]) + 1)), key=lambda x: (x[0] + "\0", x[2]))
    assert source.tolist() == [s for _, s, _ in suffixes]
    pairs = list(zip([x[0] for x in suffixes], [x[0] for x in suffixes][1:]))
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert common[1:].tolist() == [shared(a, b) for a, b in pairs]


# ---- quality --------------------------------------------------------------------------------------


def test_quality(spark, odd, none):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("aeiounrst", k=rng.randrange(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 90))]
        bad = i % 3 == 0
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w)))
        labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5000, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, marks)
    got = quality.add_score(docs, model).where(quality.held_out(F.col("doc_id"))).collect()
    assert len(got) > 100 and all((r.score >= 0.3) == (r.doc_id % 3 > 0) for r in got) and all(0 <= r.score <= 1 for r in got)
    strange = quality.add_score(odd, model, into="q").collect()
    assert len(strange) == odd.count() and all(0 <= r.q <= 1 for r in strange)
    assert quality.add_score(none, model, into="q").count() == 0
    few = quality.fit(docs, marks.where("quality = 1").limit(3))
    assert few.good is None and {r.q for r in quality.add_score(docs.limit(5), few, into="q").collect()} == {few.prior}


def test_prior_is_that_of_all_labels(spark, monkeypatch):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1200):
        bad = i % 6 == 0
        w = ["".join(rng.choices("aeiounrst", k=rng.randrange(2, 8))) for _ in range(40)]
        rows.append((i, " ".join(x.upper() + "!!" if bad and rng.random() < 0.1 else x for x in w)))
        labels.append((i, 0 if bad else 1))
    rows += [(7, "a second text"), (9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (9000, 0), (9001, 0), (None, 0)], "doc_id long, quality int")
    learnt = [i for i, *_ in rows if i < 9000 and zlib.crc32(str(i).encode()) % 5]
    want = (sum(i % 6 > 0 for i in learnt), sum(i % 6 == 0 for i in learnt))
    assert quality.label_counts(docs, marks) == want
    whole = quality.fit(docs, marks)
    monkeypatch.setattr(quality, "DICTIONARY_ROWS", 40)
    monkeypatch.setattr(quality, "CALIBRATION_ROWS", 60)
    capped = quality.fit(docs, marks)
    assert whole.prior == capped.prior == want[0] / sum(want)
    # the sample holds both labels alike, so without the labels' own share the mean score is near a half
    mean = quality.add_score(docs, capped).agg(F.avg("score")).first()[0]
    assert abs(mean - capped.prior) < 0.1


# ---- layouts of tables, and further fields -------------------------------------------------


def test_further_fields_keep_the_layout(spark):
    import json

    records = {
        "messages": {"id": 7, "messages": [{"role": "user", "content": "q", "name": "n"}, {"content": "a", "role": "assistant"}], "meta": {"k": [1]}},
        "pair": {"prompt": "q", "response": "a", "source": "web", "score": 0.5},
        "most_paths": {"instruction": "q", "input": "", "output": "a", "id": None},
        "nulls": {"prompt": "q", "completion": None, "id": 1},
    }
    rows = [(k, json.dumps(v)) for k, v in records.items()]
    rows += [("nested", '{"prompt": {"x": 1}, "response": "a", "id": 1}'), ("less", '{"prompt": "q", "id": 1}'), ("empty", '{"messages": [], "id": 1}'), ("parts", '{"messages": [{"role": "user", "content": ["p"]}]}'), ("list", '[{"prompt": "q", "response": "a"}]')]
    got = {r.name: r.t for r in spark.createDataFrame(rows, "name string, record string").select("name", chat.record_turns("record").alias("t")).collect()}
    for k in ("messages", "pair", "most_paths"):
        assert [(t.role, t.text) for t in got[k]] == [("user", "q"), ("assistant", "a")], k
    assert [(t.role, t.text) for t in got["nulls"]] == [("user", "q"), ("assistant", None)]
    assert all(got[k] is None for k in ("nested", "less", "parts", "list")) and got["empty"] == []


def test_tables_of_other_layouts(spark):
    want = {1: [("user", "q"), ("assistant", "a")]}
    tables = {
        "turn_rows": spark.createDataFrame([(1, 1, "assistant", "a", 0.1), (1, 0, "user", "q", 0.2)], "conv_id long, turn int, role string, text string, score double"),
        "from_value_rows": spark.createDataFrame([(1, 1, "gpt", "a"), (1, 0, "human", "q")], "conv_id long, turn int, `from` string, value string"),
        "from_value": spark.createDataFrame([(1, [("human", "q", 1), ("gpt", "a", 2)])], "conv_id long, conversations array<struct<`from`: string, value: string, n: int>>"),
        "prompt_response": spark.createDataFrame([(1, "q", "a", "web")], "conv_id long, prompt string, response string, source string"),
        "json_records": spark.createDataFrame([(1, '{"prompt": "q", "response": "a", "id": 3}')], "conv_id long, record string"),
    }
    for name, df in tables.items():
        assert chat.table_layout(df.schema).name == name
        assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.conversations(df).collect()} == want, name
    with pytest.raises(ValueError, match="no layout"):
        chat.conversations(spark.createDataFrame([(1, "x")], "conv_id long, body string"))


def test_more_languages_than_bits_of_a_word():
    rng = random.Random(4)
    letters = [rng.sample("abcdefghijklmnopqrstuvwxyz", 8) for _ in range(130)]
    said = [" ".join("".join(rng.choices(x, k=6)) for _ in range(300)) for x in letters]

    def codes(text):
        return np.unique(np.concatenate([language.grams(data, starts)[0] for data, starts, _ in language.windows(pa.array([text]))]))

    model = language.Model.of([(f"l{i:03}", codes(x)) for i, x in enumerate(said)])
    best, score = model.predict(pa.array(said))
    assert best.tolist() == list(range(130)) and (score > 0).all()
    few = language.Model.of([(f"l{i:03}", codes(x)) for i, x in enumerate(said[:64])])
    assert few.predict(pa.array(said[:64]))[0].tolist() == list(range(64))


# ---- rows that the layouts and joins met badly ---------------------------------------------


def test_empty_lists_and_missing_fields_of_messages(spark):
    texts = ['{"messages": []}', '{"messages": [{"role": "user"}]}', '{"messages": [{"content": "x"}, {"role": "assistant", "content": null}]}', '{"conversations": []}', '{"messages": [{"x": 1}]}', '{"messages": 3}', "no json", None, '{"system": "s", "dialog": []}', '{"prompt": "p", "response": "r", "messages": []}']
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "record string").select(chat.record_turns("record").alias("t")).collect()]
    plain = [None if t is None else [tuple(x) for x in t] for t in got]
    assert plain == [[], [("user", None)], [(None, "x"), ("assistant", None)], [], None, None, None, None, [("system", "s")], [("user", "p"), ("assistant", "r")]]


def test_names_of_other_case(spark):
    df = spark.createDataFrame([(1, 0, "Human", "a"), (1, 1, "GPT", "b")], "Conv_Id long, TURN long, `From` string, VALUE string")
    assert chat.table_layout(df.schema).name == "from_value_rows"
    assert [tuple(t) for t in chat.conversations(df).first().turns] == [("user", "a"), ("assistant", "b")]


def test_items_without_an_id(spark):
    said = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, said), (2, "none of it")], "doc_id long, text string")
    items = spark.createDataFrame([(None, said), (7, said), (None, "other words"), (None, None)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (13, ["7", None], True), 2: (0, [], False)}


def test_columns_of_a_sharded_table(spark):
    df = spark.createDataFrame([(i, "x", "y", "z", "u") for i in range(50)], "k long, __jump string, __block string, shard string, slot string")
    got = sharding.place(df, "k", 5)
    assert got.columns == ["k", "__jump", "__block", "shard", "slot", "grown_shard"] and {r["__jump"] for r in got.collect()} == {"x"}
    out = sharding.number_slots(scratch.written(got.withColumn("tie", F.lit(0)), "t"), "shard", "k", "tie")
    assert {r["__block"] for r in out.collect()} == {"y"}
    slots = sorted((r.shard, r.slot) for r in out.collect())
    assert all(b == 0 or (a, b - 1) in slots for a, b in slots)
