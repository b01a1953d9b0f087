"""Hashes of words: no two words may share one by construction."""

import numpy as np
import pyarrow as pa
import pytest

from brute import brute_components

from docspark.llm import neardup, words


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096, 1 << 15])
def test_words_that_cancel_in_any_polynomial(n):
    one = thue_morse(n)
    other = one.translate(str.maketrans("ab", "ba"))
    h, _ = words.word_hashes(pa.array([f"{one} {other} {one[:-1]} {other[:-1]} x{one} {one}"]))
    assert len(set(h.tolist())) == 5 and h[0] == h[5]


def test_such_words_are_not_linked(spark):
    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    texts = [one, other, one.upper(), f"{one} {other}", f"{other} {one}", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component_id for r in neardup.near_duplicates(df, width=2, percent=80).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 2, 80)


def test_hashes_follow_the_bytes_alone(monkeypatch):
    rng = np.random.default_rng(2)
    pool = ["".join(rng.choice(list("abAé漢"), rng.integers(1, 40))) for _ in range(300)] + ["q" * n for n in (7, 8, 9, 255, 256, 257, 1000)]
    picked = [pool[i] for i in rng.integers(0, len(pool), 2000)]
    for chunk in (64, 1 << 20):
        monkeypatch.setattr(words, "CHUNK", chunk)
        h, first = words.word_hashes(pa.array([" \t".join(picked[:1000]), None, "\n".join(picked[1000:])]))
        assert first.tolist() == [0, 1000, 1000, 2000]
        folded = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in picked]
        names = {}
        assert all(names.setdefault(w, x) == x for w, x in zip(folded, h.tolist())) and len(set(names.values())) == len(names)
