"""Benchmark passages in documents: a prefix-filtered join on shingles, SQL functions only.

An item's windows are its runs of ``span`` words (a shorter item is one window). A window
occurs in a document only if all of its shingles (SHINGLE words, or the whole window if that
is shorter) do, so the necessary prefix of a window is one shingle: its rarest, with shingles
ordered by their count over all documents. These are joined with the documents' shingles; the
places of both give the diagonal on which item and document would agree, the lengths of both
say which windows fit there, and a candidate counts only where the words of a whole window
are equal.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm import scratch

SHINGLE = 3
#: Bytes of a table that is broadcast at most; a larger one is joined by a shuffle.
MOST_BROADCAST = 16 << 20
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words before A-Z are lowered.
_RAW_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """A-Z in lower case, then the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, _BREAK), "")


def n_words(text: Column) -> Column:
    """How many words there are; case doesn't move a word's ends."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), _RAW_BREAK), "")).cast("long")


def _low(text: Column) -> Column:
    """All letters in lower case, whatever stands beside them: of the two small sigmas, which hang on that, always the same."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def alike(text: Column) -> Column:
    """Words with all letters in lower case, at the same places as ``words``.

    Texts of equal ``words`` have equal ones here too, and this is far cheaper than lowering A-Z
    alone; so they find candidates, which are then confirmed on ``words``.
    """
    return F.array_remove(F.split(_low(F.coalesce(text, F.lit(""))), _BREAK), "")


def shingles(own: Column, width: int) -> Column:
    """Hashes of the runs of ``width`` words, by place; none in a text of fewer words."""
    hashed = F.transform(own, lambda w, i: F.xxhash64(w, *[F.get(own, i + k) for k in range(1, width)]))
    return F.slice(hashed, 1, F.greatest(F.size(own) - (width - 1), F.lit(0)))


def _side(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= MOST_BROADCAST else df


def _key(text: Column) -> Column:
    # documents of one text have one result, whatever their ids
    return F.unhex(F.substring(F.sha2(F.coalesce(F.encode(text, "utf-8"), F.lit(b"")), 256), 1, 32))


def occurrences(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, span: int) -> DataFrame:
    """``key, n_hit, items``: for each distinct text with an occurring window, its hit words and the items' ids as strings.

    Items are told apart by a number, so one without an id is found too: it stands as null, last.
    """
    bench = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(item_text)).alias("own")).where(F.size("own") > 0).distinct()
    bench = scratch.written(bench.withColumns({"width": F.least(F.size("own"), F.lit(SHINGLE), F.lit(span)), "no": F.monotonically_increasing_id()}), "benchmark")
    sums = bench.agg(F.sum(F.octet_length(F.array_join("own", " ")) + 16 * F.size("own")).alias("bytes"), F.sum(F.size("own")).alias("words"), F.sort_array(F.collect_set("width")).alias("widths")).first()
    n, widths = sums.words or 0, sums.widths  # widths: at most SHINGLE numbers
    low = F.transform("own", _low)
    bench = bench.withColumn("tokens", F.coalesce(*[F.when(F.col("width") == w, shingles(low, w)) for w in widths], F.array().cast("array<bigint>")))
    vocabulary = bench.select(F.explode("tokens").alias("token")).distinct()

    said = docs.select(_key(F.col(text)).alias("key"), alike(F.col(text)).alias("own"))
    # one list for all widths (nearly always the one): the places of the k-th begin behind all words of those before
    every = F.flatten(F.array(*[F.concat(shingles(F.col("own"), w), F.array_repeat(F.lit(None).cast("bigint"), F.least(F.size("own"), F.lit(w - 1)))) for w in widths])) if len(widths) > 1 else shingles(F.col("own"), widths[0]) if widths else F.array().cast("array<bigint>")
    rows = said.select("key", F.size("own").alias("n_words"), F.posexplode(every).alias("at", "token"))
    # of the documents' shingles only the benchmark's are kept: a row for each place
    rows = scratch.written(rows.join(_side(vocabulary, 8 * n), "token").withColumn("at", F.col("at") % F.col("n_words")), "places", "zstd")
    counts = scratch.written(rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "rarity")

    # The rarest shingle of each window; ties by its hash, then by its place. A window with a shingle in no document is nowhere.
    placed = bench.select("no", "own", "width", F.posexplode("tokens").alias("at", "token")).join(counts, "token", "left")
    ordered = placed.groupBy("no", "own", "width").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("by_place"))
    rank = F.transform("by_place", lambda w: F.struct(w["n"].alias("n"), w["token"].alias("token"), w["at"].alias("at")))
    length = F.least(F.size("own"), F.lit(span))
    starts = F.sequence(F.lit(0), F.size("own") - length)
    anchors = ordered.select("no", F.size("own").alias("item_words"), "width", F.explode(F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(rank, i + 1, length - F.col("width") + 1))))).alias("anchor")).where("anchor.n > 0")
    anchors = scratch.written(anchors.select("no", "item_words", "width", "anchor.token", F.col("anchor.at").alias("item_at")), "anchors")

    met = rows.join(_side(anchors, 48 * n), "token").withColumn("diagonal", F.col("at") - F.col("item_at"))
    # A window that holds the anchor and lies inside the document: its first word in the item is in [low, high].
    length = F.least("item_words", F.lit(span))
    low = F.greatest(F.lit(0), F.col("item_at") + F.col("width") - length, -F.col("diagonal"))
    high = F.least("item_at", F.col("item_words") - length, F.col("n_words") - F.col("diagonal") - length)
    found = scratch.written(met.where(low <= high).select("key", "no", "diagonal").distinct(), "candidates")

    # Whole windows, word by word, in the texts that have candidates; of a text only the words beside the item travel.
    m = 64 * found.count()
    keys = found.select("key").distinct()
    texts = docs.select(_key(F.col(text)).alias("key"), F.col(text).alias("text")).join(_side(keys, m), "key", "left_semi").dropDuplicates(["key"])
    texts = texts.select("key", words(F.col("text")).alias("said"))
    pairs = texts.join(_side(found, m), "key").join(_side(bench.select("no", "item", "own"), sums.bytes or 0), "no")
    first = F.greatest(F.lit(0), -F.col("diagonal"))
    beside = F.slice("said", first + F.col("diagonal") + 1, F.size("own"))
    pairs = pairs.select("key", "item", "own", "diagonal", first.alias("first"), beside.alias("beside"))
    size = F.least(F.size("own"), F.lit(span))
    last = F.least(F.size("own") - size, F.col("first") + F.size("beside") - size)
    whole = F.filter(F.sequence(F.col("first"), last), lambda i: F.slice("beside", i - F.col("first") + 1, size) == F.slice("own", i + 1, size))
    hits = pairs.where(F.col("first") <= last).select("key", "item", F.transform(whole, lambda i: F.struct((i + F.col("diagonal")).alias("a"), (i + F.col("diagonal") + size).alias("b"))).alias("spans")).where(F.size("spans") > 0)
    hits = scratch.written(hits, "hits")
    # a text has no more distinct spans of one length than words, and no more items than its result names
    spans = hits.select("key", F.explode("spans").alias("span")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    named = hits.select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list(F.struct("item"))["item"]).alias("items"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    union = F.aggregate("spans", start, lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n")))
    return spans.join(named, "key").select("key", union["n"].alias("n_hit"), "items")


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = 13, into: tuple[str, str, str, str] = ("n_words", "n_hit", "items", "contaminated")) -> DataFrame:
    """``docs`` with ``n_words, n_hit, items, contaminated`` (or the names ``into``).

    A document word inside any occurrence of a window is hit; a document is contaminated if
    it has hit words and they are a twentieth of its words or more. Null and empty texts have
    no words and are clean; items without words have no window; repeated items are one; items
    without an id count as one that is null and stands last in ``items``; an empty benchmark leaves every document clean. Columns of ``docs`` stay, whatever ``items``
    has; only those that have one of the four names already are replaced.
    """
    found = scratch.written(occurrences(docs, items, text, item_id, item_text, span), "contaminated")
    key, hit, ids = (scratch.fresh(docs, c) for c in ("__key", "__hit", "__items"))
    size = found.agg(F.sum(64 + 24 * F.size("items"))).first()[0] or 0
    hits = found.select(F.col("key").alias(key), F.col("n_hit").alias(hit), F.col("items").alias(ids))
    size_of, n_hit, of, flag = into
    out = docs.withColumns({key: _key(F.col(text)), size_of: n_words(F.col(text))})
    out = out.join(_side(hits, size), key, "left").drop(key)
    out = out.withColumns({n_hit: F.coalesce(hit, F.lit(0).cast("long")), of: F.coalesce(ids, F.array().cast("array<string>"))}).drop(hit, ids)
    return out.withColumn(flag, (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(size_of)))
