"""Document fingerprints by consistent weighted sampling (Ioffe, 2010), SQL functions only.

A term is a lower-case word and its weight the number of times it stands in the text. For
sample k, the hash of term and k gives r and c, each gamma distributed with shape 2, and a
uniform b. With t = floor(ln(weight) / r + b), the sample of a text is the term (and its t)
with the least ln c - r (t - b + 1). Two texts agree in a sample with the probability of
their generalised Jaccard similarity: the sum of the lesser weights over that of the greater.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.llm import scratch
from docspark.llm.sharding import with_blocks

#: Samples of a fingerprint: PARTS rows of a term with PART samples each.
PARTS, PART = 4, 8
#: Documents of a block of neighbours (their texts are sorted together): at least and at most.
FEWEST_ROWS, BLOCK_ROWS = 250, 4000
_LOW31 = (1 << 31) - 1


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def terms(first: Column, second: Column) -> Column:
    """``array<struct<h, a, b>>``: each term of two word lists by its hash, with its weight in either.

    Hashes carry the list in their lowest bit; sorted, the runs of equal values give the
    weights, and a term of both lists is two neighbouring runs.
    """
    one, two = F.lit(1).cast("long"), F.lit(-2).cast("long")
    marked = F.concat(F.transform(first, lambda w: F.xxhash64(w).bitwiseAND(two)), F.transform(second, lambda w: F.xxhash64(w).bitwiseOR(one)))

    def ends(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i + 1)))).otherwise(F.array().cast("array<int>"))

    def run(s: Column, e: Column, i: Column, j: Column) -> Column:
        v, n = F.get(s, i), i - F.coalesce(F.get(e, j - 1), F.lit(-1))
        odd = v.bitwiseAND(one) == 1
        # the run of the same term in the other list, if any, is next to this one
        after, before = F.get(e, j + 1), F.get(e, j - 1)
        return F.when(odd, F.when(~F.coalesce(F.get(s, before) == v.bitwiseAND(two), F.lit(False)), F.struct(v.bitwiseAND(two).alias("h"), F.lit(0).alias("a"), n.alias("b")))).otherwise(
            F.struct(v.alias("h"), n.alias("a"), F.when(F.get(s, after) == v.bitwiseOR(one), after - i).otherwise(F.lit(0)).alias("b"))
        )

    return _let(F.sort_array(marked), lambda s: _let(ends(s), lambda e: F.array_compact(F.transform(e, lambda i, j: run(s, e, i, j)))))


def _exponential(bits: Column) -> Column:
    """A standard exponential variate from 32 random bits.

    It is k ln 2 - ln m with k the number of trailing zeros (a halving for each) and m
    uniform in [1/2, 1) from the upper bits; the logarithm is the first terms of its series.
    """
    k = F.bit_count((bits.bitwiseAND(-bits)) - 1)
    m = F.shiftright(bits, 8).cast("double") * (0.5 / (1 << 24)) + (0.5 + 0.25 / (1 << 24))
    z = (m - 1) / (m + 1)
    q = z * z
    return k * math.log(2) - z * 2 * (q * (q * (q * (q * (1 / 9) + 1 / 7) + 1 / 5) + 1 / 3) + 1)


def _samples(h: str, part: str, weights: dict[str, str]) -> list[Column]:
    """For each of PART samples and each weight column (as its logarithm): the least value with its identity below.

    A sample is one long: 31 bits of the value, then 31 bits that name the term and t.
    """
    low32 = F.lit((1 << 32) - 1)
    out = []
    for k in range(PART):
        x = F.xxhash64(F.col(h), F.col(part), F.lit(k))
        y = F.xxhash64(x)
        r = _exponential(x.bitwiseAND(low32)) + _exponential(F.shiftrightunsigned(x, 32)) + 1e-9
        c = F.log(_exponential(y.bitwiseAND(low32)) + _exponential(F.shiftrightunsigned(y, 32)) + 1e-12)
        b = x.bitwiseXOR(y).bitwiseAND(F.lit((1 << 40) - 1)).cast("double") * (1 / (1 << 40))
        for name, log_weight in weights.items():
            t = F.floor(F.col(log_weight) / r + b)
            value = c - r * (t - b + 1)
            # values lie in (-128, 8): c is over -28, and r (t - b + 1) at most ln(weight) + r
            rank = ((F.greatest(F.least(value, F.lit(127.0)), F.lit(-127.9)) + 128) * float(1 << 23)).cast("long")
            named = (F.shiftrightunsigned(y, 1) + t * 1000003).bitwiseAND(F.lit(_LOW31))
            out.append(F.min(F.shiftleft(rank, 31).bitwiseOR(named)).alias(f"{name}{k}"))
    return out


def likeness(x: Column, y: Column) -> Column:
    """The share of samples in which two fingerprints agree."""
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda same: same)) / F.lit(float(PARTS * PART))


def as_text(samples: Column) -> Column:
    """Eight hexadecimal digits for each sample."""
    return F.lower(F.array_join(F.transform(samples, lambda v: F.lpad(F.hex(v), 8, "0")), ""))


def fingerprint_pairs(rows: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """``keys, a, b``: the samples of two text columns. A text without words has only zeros.

    Terms never leave the task that reads their text: only PARTS rows of samples do.
    """
    both = rows.select(*keys, F.explode_outer(terms(words(F.col(first)), words(F.col(second)))).alias("t"))
    flat = both.select(*keys, "t.h", F.when(F.col("t.a") > 0, F.log(F.col("t.a").cast("double"))).alias("la"), F.when(F.col("t.b") > 0, F.log(F.col("t.b").cast("double"))).alias("lb"))
    parts = flat.select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    got = parts.groupBy(*keys, "part").agg(*_samples("h", "part", {"a": "la", "b": "lb"}))
    side = lambda n: F.array(*[F.coalesce(F.col(f"{n}{k}").bitwiseAND(F.lit(_LOW31)), F.lit(0).cast("long")) for k in range(PART)])
    whole = got.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("part", side("a").alias("a"), side("b").alias("b")))).alias("p"))
    return whole.select(*keys, F.flatten(F.col("p.a")).alias("a"), F.flatten(F.col("p.b")).alias("b"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness of neighbours.

    The edited text has its last floor(n / 2) code points replaced by the first as many of
    the next text (all, if it has fewer) in ascending order of ``key``; after the last comes
    the first. Null texts are empty; rows of one key stand in the order of their texts'
    checksums; null keys come first. A text without words has a fingerprint of zeros. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.crc32(F.encode("text", "utf-8")))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    n_rows = rows.count()
    size = max(1, min(BLOCK_ROWS, max(FEWEST_ROWS, n_rows // (8 * cores))))
    rows = with_blocks(rows, "id", "tie", size, "block")
    # The first text of each block stands behind the block before as the last one's neighbour.
    least = F.struct(F.coalesce("id", F.lit(-(1 << 63)).cast("long")).alias("i"), "tie")
    heads = scratch.written(rows.groupBy("block").agg(F.min_by("text", least).alias("text")), "heads")
    turn = W.orderBy("block")  # over the numbers of the blocks alone
    following = heads.select("block", F.coalesce(F.lead("block").over(turn), F.first("block").over(turn.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("after"))
    following = scratch.written(following, "blocks")
    ahead = following.join(heads.select(F.col("block").alias("after"), "text"), "after")
    whole = rows.select("block", "id", "tie", "text", F.lit(False).alias("last")).unionByName(ahead.select("block", "text", F.lit(True).alias("last")), allowMissingColumns=True)
    # neighbouring blocks go together, so that tasks get equal shares; they are as many as the blocks fill
    tasks = max(1, min(n_rows // size + 1, max(4 * cores, n_rows // BLOCK_ROWS)))
    order = W.partitionBy("block").orderBy("last", F.asc_nulls_first("id"), "tie")
    placed = whole.repartitionByRange(tasks, "block").select("block", "id", "text", "last", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next")).where(~F.col("last"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    made = placed.select("block", "rn", "id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    keys = ["block", "rn", "id", "n_chars", "edited_sha256"]
    got = fingerprint_pairs(made.withColumn("edited_sha256", F.sha2("edited", 256)), keys, "text", "edited")
    got = scratch.written(got, "fingerprints")

    first = got.where("rn = 1").select(F.col("block").alias("after"), F.col("a").alias("ahead"))
    after = following.join(first, "after").select("block", "ahead")
    near = got.withColumn("next", F.lead("a").over(W.partitionBy("block").orderBy("rn"))).join(after, "block", "left").withColumn("next", F.coalesce("next", "ahead"))
    return near.select(F.col("id").alias(key), "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("next")).alias("near_next"))
