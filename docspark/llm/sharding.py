"""Sharding by jump consistent hashing (Lamping & Veach, 2014), DataFrame functions only.

A key's shard follows from the key and the number of shards alone: no ring table is
kept, and when a shard is appended only the rows that move into it change place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.llm import scratch

# Fixed value: the multiplier of the published 64-bit generator.
MULTIPLIER = 2862933555777941757
#: Jumps that are followed for more shards than this; the expected number is ln(shards).
MOST_JUMPS = 160
#: Rows of one slot block, and the bounds of blocks that stand in one expression; more are a second level of bounds.
BLOCK_ROWS, MOST_BOUNDS = 500_000, 4096
#: Bytes of a table of blocks that is broadcast at most; a larger one is joined by a shuffle.
MOST_BROADCAST = 32 << 20


def jump_state(key: Column, shards: int) -> Column:
    """``struct(hi, lo, b, j)`` after the jumps of ``key`` (bigint) below ``shards``.

    ``b`` is the shard; ``j`` is the first jump at or beyond ``shards``. The generator
    works modulo 2**64; as ANSI arithmetic refuses to wrap, it is kept in two 32-bit halves.
    """
    low32, low16 = F.lit(0xFFFFFFFF), F.lit(0xFFFF)
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
    m1, m0 = m_lo >> 16, m_lo & 0xFFFF

    def step(s: Column, _: Column) -> Column:
        lo, hi = s["lo"], s["hi"]
        p1 = lo * m1
        low = lo * m0 + F.shiftleft(p1.bitwiseAND(low16), 16) + 1
        high = F.shiftright(low, 32) + F.shiftright(p1, 16) + lo * m_hi
        high = (high + hi * m0 + F.shiftleft((hi * m1).bitwiseAND(low16), 16)).bitwiseAND(low32)
        jumped = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double")))
        moved = F.struct(high.alias("hi"), low.bitwiseAND(low32).alias("lo"), s["j"].alias("b"), jumped.cast("long").alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(low32).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    steps = min(shards, MOST_JUMPS)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def place(df: DataFrame, key: str, shards: int, into: str = "shard", grown: str | None = "grown_shard") -> DataFrame:
    """Add the shard of column ``key``, and its shard when one more is appended.

    Integer keys are the generator's seed as they are; other types are hashed with
    xxhash64 first. A null key counts as 0 (as key 0 does), so null rows share one shard.
    Columns that have the names ``into`` or ``grown`` already are replaced; others stay.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    whole = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    seed = F.coalesce(F.col(f"`{key}`").cast("long") if whole else F.xxhash64(F.col(f"`{key}`")), F.lit(0).cast("long"))
    jump = scratch.fresh(df, "__jump")
    df = df.withColumn(jump, jump_state(seed, shards))
    done = F.when(F.col(f"{jump}.j") < shards, F.raise_error(F.lit("jump limit reached")).cast("long")).otherwise(F.col(f"{jump}.b"))
    df = df.withColumn(into, done.cast("int"))
    if grown:
        # With one more shard the key moves only if its next jump lands exactly there.
        df = df.withColumn(grown, F.when(F.col(f"{jump}.j") == shards, F.lit(shards)).otherwise(F.col(into)).cast("int"))
    return df.drop(jump)


def with_blocks(df: DataFrame, key: str, tie: str, rows: int, into: str) -> DataFrame:
    """Add a block number that follows the order of ``key`` (bigint, nulls first), about ``rows`` rows each however many rows there are.

    Bounds are quantiles of the key. The first MOST_BOUNDS stand in the plan; where more
    blocks are needed, each of theirs has quantiles of its own in a table. A key so frequent
    that it is several quantiles has blocks of its own, by ranges of ``tie``, an unsigned
    32-bit value; only rows equal in both stay together.
    """
    key_of = F.coalesce(F.col(key), F.lit(-(1 << 63)).cast("long"))
    blocks = max(1, df.count() // rows + 1)
    outer = min(MOST_BOUNDS, blocks)
    bounds: list[int] = []
    if outer > 1:
        cuts = [i / outer for i in range(1, outer)]
        bounds = df.select(F.percentile_approx(key_of, cuts, 100 * outer)).first()[0] or []
    hot = sorted({b for a, b in zip(bounds, bounds[1:]) if a == b})
    bounds = sorted(set(bounds))

    # binary search by halving: the expression grows with the bounds, its depth with their logarithm
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo).cast("long")
        mid = (lo + hi) // 2
        return F.when(key_of <= bounds[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    df = df.withColumn(into, search(0, len(bounds)))
    inner = -(-blocks // outer)
    if inner > 1:
        quantiles = F.percentile_approx(key_of, [i / inner for i in range(1, inner)], 100 * inner)
        levels = df.groupBy(into).agg(quantiles.alias("__cuts"))  # inner numbers for each outer block
        levels = F.broadcast(levels) if 8 * inner * (len(bounds) + 1) <= MOST_BROADCAST else levels
        df = df.join(levels, into).withColumn(into, F.col(into) * inner + F.size(F.filter("__cuts", lambda c: c < key_of))).drop("__cuts")
    if hot:
        bits = min(32, (blocks - 1).bit_length())  # a hot key may hold nearly all rows
        part = F.shiftright(F.col(tie), 32 - bits) + 1
        df = df.withColumn(into, F.col(into) * ((1 << bits) + 1) + F.when(key_of.isin(hot), part).otherwise(0))
    return df


def number_slots(df: DataFrame, shard: str, key: str, tie: str, into: str = "slot") -> DataFrame:
    """Number the rows of each shard without gaps from 0, in the order of ``key``, ``tie``.

    No task gets a whole shard: rows fall into blocks by ranges of the key, each block is
    numbered alone, and the counts of the blocks, a row for each shard and block, give its
    first number. ``df`` is read several times and should be a written table. A column that
    has the name ``into`` already is replaced; others stay.
    """
    block, own, first = (scratch.fresh(df, c) for c in ("__block", "__own", "__before"))
    df = with_blocks(df, key, tie, BLOCK_ROWS, block)
    counts = scratch.written(df.groupBy(shard, block).agg(F.count(F.lit(1)).alias("n")), "counts")
    before = counts.select(shard, block, (F.sum("n").over(W.partitionBy(shard).orderBy(block)) - F.col("n")).alias(first))
    number = F.row_number().over(W.partitionBy(shard, block).orderBy(key, tie)) - 1
    before = F.broadcast(before) if 24 * counts.count() <= MOST_BROADCAST else before
    return df.withColumn(own, number.cast("long")).join(before, [shard, block]).withColumn(into, F.col(own) + F.col(first)).drop(own, first, block)


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards, sizes and slots of ``docs``.

    Null text has size 8 and the checksum of no bytes. Repeated ids get one shard and
    different slots; an empty table gives an empty result; other columns are ignored.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    light = docs.select(F.col(key), size.alias("size"), F.crc32(F.coalesce(F.encode(F.col(text), "utf-8"), F.lit(b""))).alias("text_crc32"))
    placed = scratch.written(place(light, key, shards), "shards")
    return number_slots(placed, "shard", key, "text_crc32")
