"""Ranked search, vector codes and the grid join against plain definitions, and on odd rows."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import codes, gridjoin, oracles, queries, ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name, sql, tables", [("op11_ranked_search", oracles.OP11, ("documents", "benchmark")), ("op12_vector_codes", oracles.OP12, ("embeddings",)), ("op13_embedding_neardup", oracles.OP13, ("embeddings",))])
def test_sql(spark, sf_dir, name, sql, tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.queries()[name](spark, sf_dir)
    want = c.execute(sql)
    names = [d[0] for d in want.description]
    assert rows(got.select(*names)) == sorted(want.fetchall())


# ---- ranked search


def brute_rank(docs, items, k):
    own = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    n_docs, n_words = len(own), sum(len(t) for _, t in own)
    df = {}
    for _, t in own:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, t in own:
            m = 100 - 90 + (90 * len(t) * n_docs) // n_words
            s = 0
            for x in set(TERM.findall((text or "").translate(LOWER))) & set(t):
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * t.count(x)) // (1000 * t.count(x) + 8 * m))
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(str(item), rank + 1, str(f[3]), -f[0]) for rank, f in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_ranking_on_odd_rows(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "One, TWO three ñandú"), (1, "lorem LOREM é 漢字"), (None, "text id INST"), (4, None), (5, " ;! ")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(0) for c in ("item", "query", "score", "id")})
    for k in (1, 3, 10):
        got = ranking.top_documents(odd, asked, k)
        assert sorted((str(r["item"]), r["rank"], str(r["id"]), r["score"]) for r in got.collect()) == brute_rank(docs, items, k)
    assert ranking.top_documents(none, asked).count() == 0
    assert ranking.top_documents(odd, asked.limit(0)).columns == ["item", "rank", "id", "score"]
    assert ranking.top_documents(odd, asked.limit(0)).count() == 0


def test_ranking_in_blocks_and_slices(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(0, 40)))) for i in rng.permutation(300)]
    items = [(i, " ".join(rng.choice(words, 12))) for i in range(25)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 300)
    monkeypatch.setattr(ranking, "ENTRIES", 50)
    got = ranking.top_documents(a, b, 7)
    assert sorted((str(r["item"]), r["rank"], str(r["id"]), r["score"]) for r in got.collect()) == brute_rank(docs, items, 7)


def test_terms_in_chunks(monkeypatch):
    text = "Ab cD " * 50 + "x" * 90 + " é9;z"
    want = [t.encode() for t in TERM.findall(text.translate(LOWER))]
    for size in (5, 7, 64, 1000):
        monkeypatch.setattr(ranking, "CHUNK", size)
        assert [t for part in ranking.terms(text) for t in part] == want


def test_radix_order():
    keys = np.random.default_rng(0).integers(0, 1 << 40, 5000)
    keys[100:200] = keys[0]
    assert (ranking.radix_order(keys, 40) == np.argsort(keys, kind="stable")).all()


# ---- vector codes


def brute_codes(vectors, entries=256, rounds=4):
    """Plain Lloyd rounds in Python's and numpy's integers."""
    q = np.array([[math.floor(1024 * x) for x in v] for _, v, _ in vectors], np.int64)
    order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0], vectors[i][1]))[:entries]
    size = q.shape[1] // 4
    books = [q[order, p * size : (p + 1) * size].copy() for p in range(4)]

    def assign(p):
        d = ((q[:, None, p * size : (p + 1) * size] - books[p][None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for p in range(4):
            code, _ = assign(p)
            for k in range(len(books[p])):
                if (code == k).any():
                    own = q[code == k, p * size : (p + 1) * size]
                    books[p][k] = own.sum(0) // len(own)
    found = [assign(p) for p in range(4)]
    code = ["".join(f"{found[p][0][i]:02x}" for p in range(4)) for i in range(len(q))]
    error = sum(f[1] for f in found)
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
    label = {}
    for (_, _, k), e in zip(vectors, error):
        label[k] = label.get(k, 0) + int(e)
    return sorted((v[0], c, int(e), label[v[2]], digest) for v, c, e in zip(vectors, code, error))


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("n, d, spread", [(700, 8, 40), (40, 4, 3), (600, 16, 900)])
def test_codes_with_ties(spark, n, d, spread):
    rng = np.random.default_rng(n)
    # few distinct values, so that many distances are equal
    data = [(i, [float(x) / 1024 for x in rng.integers(-spread, spread, d)], [None, 1, 2][i % 3]) for i in range(n)]
    got = codes.compress(spark.createDataFrame(data, VECTORS).repartition(3))
    assert rows(got.select("id", "code", "error", "label_error", "codebooks_sha256")) == brute_codes(data)


def test_bounds_never_lose_the_nearest():
    rng = np.random.default_rng(5)
    x = rng.integers(-30, 30, (500, 4)).astype(float)
    books = codes.Books(x[:64][None])
    code, own, low = codes.first_assignment(x, books.entries[0], books.groups[0])
    looked = []
    for _ in range(6):
        sums = np.zeros((1, 64, 5), np.int64)
        codes._sums(sums, 0, x, code)
        books.update(sums)
        low = np.hstack([low])
        looked.append((codes._down(low - np.array([books.moved[0][g].max() for g in books.groups[0]])) <= np.sqrt(((x - books.entries[0][code]) ** 2).sum(1))[:, None]).mean())
        code, own, low = codes.next_assignment(x, code, low.copy(), books.entries[0], books.moved[0], books.groups[0])
        d = codes.distances(x, books.entries[0])
        assert (code == d.argmin(1)).all() and (own == d.min(1)).all()
        for g, members in enumerate(books.groups[0]):
            rest = np.where(members == code[:, None], np.inf, d[:, members]).min(1)
            assert (low[:, g] <= np.sqrt(rest)).all()
    assert looked[-1] < looked[0] and looked[-1] < 0.7  # bounds spare most groups once entries settle


def test_codes_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(3, [0.5, -0.25, 0.125, 0.75], 1), (1, [0.1, 0.2, 0.3, 0.4], None), (1, [0.1, 0.2, 0.3, 0.4], None), (2, [0.0, 0.0, 0.0, 0.0], 7)]
    bad = [(4, None, 1), (5, [], 1), (6, [nan, 0.0, 0.0, 0.0], 1), (7, [0.0, inf, 0.0, 0.0], 1), (8, [None, 1.0, 1.0, 1.0], 1), (9, [1.0] * 8, 1)]
    f32 = [(i, [float(np.float32(x)) for x in v], k) for i, v, k in good]
    df = spark.createDataFrame(good + bad, VECTORS).withColumns({c: F.lit("clash") for c in ("id", "code", "q", "error", "v", "sums", "of")})
    assert rows(codes.compress(df).select("id", "code", "error", "label_error", "codebooks_sha256")) == brute_codes(f32)
    for empty in (df.limit(0), df.where("vec_id in (4, 5, 6)")):
        assert codes.compress(empty).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], VECTORS))
    with pytest.raises(Exception, match="components must be below"):
        codes.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4e9], 1)], VECTORS)).collect()


# ---- grid join


def brute_links(vectors, threshold):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in vectors]
    x = np.array([v if k else [0.0] * 6 for (_, v), k in zip(vectors, ok)], float)
    scale = np.abs(x).max(1, keepdims=True)
    x = np.divide(x, scale, out=np.zeros_like(x), where=scale > 0)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    parent = list(range(len(vectors)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(near)):
        parent[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i in range(len(vectors)):
        members.setdefault(find(i), []).append(vectors[i][0])
    least = {r: min((i is None, i or 0, i) for i in ids)[2] for r, ids in members.items()}
    return sorted((str(vectors[i][0]), int(near[i].sum()), str(least[find(i)]), least[find(i)] == vectors[i][0]) for i in range(len(vectors)))


def strs(df):
    return sorted((str(r["id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in df.collect())


@pytest.mark.parametrize("kind", ["float", "double"])
def test_links_of_groups_in_many_tiles(spark, monkeypatch, kind):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 6))
    x = np.vstack([rng.normal(size=(900, 6)), centres[rng.integers(0, 40, 500)] + 0.05 * rng.normal(size=(500, 6)), centres[:1] + 0.01 * rng.normal(size=(400, 6))])
    x[-150:] = x[-1]  # many equal vectors
    x = x[rng.permutation(len(x))].astype(np.float32 if kind == "float" else float)
    data = [(int(i), [float(v) for v in row]) for i, row in zip(rng.permutation(len(x)) // 1, x)]
    monkeypatch.setattr(gridjoin, "SMALL_TILE", 24 * 60 if kind == "float" else 48 * 60)
    monkeypatch.setattr(gridjoin, "LEAF", 25)
    monkeypatch.setattr(gridjoin, "LINKS", 500)
    df = spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>")
    assert strs(gridjoin.near_vectors(df, 0.9)) == brute_links(data, 0.9)


def test_distant_tiles_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(gridjoin, "SMALL_TILE", 4 * 3 * 50)
    monkeypatch.setattr(gridjoin, "LEAF", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3)).astype(np.float32)
    nodes = spark.createDataFrame([(i, 1, [float(v) for v in r]) for i, r in enumerate(x)], "node long, weight long, v array<float>")
    eps = math.sqrt(2 - 2 * 0.98)
    cut = gridjoin.tiles(nodes, gridjoin.principal(nodes, 3), eps, 4, 3000 * 12)
    n, near = cut.count(), gridjoin.near_tiles(cut.select("tile", "at", "lo", "hi"), eps)
    boxes = cut.select("tile", "lo", "hi").collect()
    want = {(min(a.tile, b.tile), max(a.tile, b.tile)) for a in boxes for b in boxes if gridjoin.apart(*map(np.array, (a.lo, a.hi, b.lo, b.hi))) <= eps * eps * (1 + 1e-9)}
    assert n > 16 and {tuple(r) for r in near.collect()} == want and len(want) < n * (n + 1) / 4


def test_grid_join_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(5, [1.0, 0, 0, 0, 0, 0]), (4, [2.0, 0.1, 0, 0, 0, 0]), (4, [2.0, 0.1, 0, 0, 0, 0]), (None, [0, 0, 0, 0, 0, 3e38]), (None, [0, 0, 0, 0, 0, 3e38]), (9, [0, 0, 0, 0, 0, 1e-40]),
            (1, None), (1, None), (2, []), (3, [0.0] * 6), (6, [nan, 1, 1, 1, 1, 1]), (7, [inf, 1, 1, 1, 1, 1]), (8, [None, 1.0, 1, 1, 1, 1]), (10, [-1.0, 0, 0, 0, 0, 0])]
    data = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in data]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("id", "node", "v", "n", "h1", "weight", "least", "component")})
    want = brute_links(data, 0.9)
    assert strs(gridjoin.near_vectors(df, 0.9)) == want
    # another length is linked with nothing
    assert ("11", 0, "11", True) in strs(gridjoin.near_vectors(df.unionByName(df.where("vec_id = 5").selectExpr("11L as vec_id", "array(1d) as embedding", *df.columns[2:]))))
    assert gridjoin.near_vectors(df.limit(0)).count() == 0
    assert strs(gridjoin.near_vectors(df.where("vec_id in (1, 2)"))) == [("1", 0, "1", True), ("1", 0, "1", True), ("2", 0, "2", True)]
    assert all(r["n_links"] >= 0 for r in gridjoin.near_vectors(df, 1.0).collect())
