"""Removal of repeated strings of WIDTH bytes, by merging Burrows-Wheeler transforms.

A window is a string of WIDTH bytes at some place. All windows that are equal have the same
minimizer (the k-gram of least hash, the leftmost of equals) at the same place inside them,
so equal windows meet in the group of their minimizer:

1. Texts that stand several times go whole; each is read once from here on, with its weight.
2. Every text is cut into runs of windows with one minimizer of COARSE bytes. A run whose
   minimizer stands once is done: no window of it repeats. A run that stands several times is
   done too: each of its windows repeats. Counts are combined before the shuffle.
3. Of the minimizers that have a run which stands once (where one text goes on as another does
   not), each distinct run is cut again by minimizers of FINE bytes. All windows of such a
   piece contain the whole minimizer, so it becomes one symbol: ``left bytes, core, right
   bytes``, and a window is exactly WIDTH - FINE + 1 symbols long.
4. In each task the strings are dealt into shards. Each shard's suffixes are sorted and its
   transform taken; the transforms are merged by refining their interleave, one symbol of
   common prefix a step. A step keeps the blocks of equal prefixes, so after WIDTH - FINE + 1
   steps a block of several suffixes is a repeated window. No merged suffix is sorted again.

The number of windows in step 4 is that of places where repeats begin or end; the texts'
other bytes never get there. Runs are told apart by 64 bits of their minimizer and 64 of
their bytes, pieces likewise; texts by 128 bits of SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm import scratch
from docspark.llm.words import buffer, mix, powers

WIDTH, COARSE, FINE = 200, 100, 180
#: Bytes hashed at a time (positions take 20 bits).
CHUNK = 1 << 19
#: Symbols of one task's strings, and the strings of one core that a task gets at most.
TASK_SYMBOLS, MOST_STRINGS = 250_000, 20_000
SHARDS = 4
#: Bytes of a table that is broadcast at most; a larger one is joined by a shuffle.
MOST_BROADCAST = 8 << 20


def runs(data: np.ndarray, starts: np.ndarray, size: int, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer of ``size`` bytes in texts laid end to end.

    Gives for each run: its text, the place of its first window in the text, the number of
    windows, the minimizer's hash, the run's hash, and the minimizer's place in the text.
    """
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    windows = len(data) - width + 1
    if windows < 1:
        return none
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    n, w = len(data) - size + 1, width - size + 1
    h = mix((sums[size:] - sums[:-size]) * down[:n])
    low = np.uint64((1 << 20) - 1)
    order = np.full(n + w + (-n % w), ~np.uint64(0))
    order[:n] = (h & ~low) | np.arange(n, dtype=np.uint64)
    blocks = order.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(back[:windows], ahead[w - 1 : w - 1 + windows]) & low).astype(np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:windows]
    whole = np.arange(windows) + width <= starts[1:][text]
    new = np.empty(windows, bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], windows)
    keep = whole[first]
    first, last = first[keep], last[keep]
    body = mix((sums[last - 1 + width] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    text, at = text[first], at[first]
    return text, first - starts[text], last - first, h[at], body, at - starts[text]


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of some texts, where each begins, which text each is, and the place in it: every window is in exactly one chunk."""
    data, starts = buffer(texts)
    at = 0
    while at < len(starts) - 1:
        end = min(max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK, "right")) - 1), len(starts) - 1)
        lo, hi = int(starts[at]), int(starts[end])
        if hi - lo <= CHUNK:
            yield data[lo:hi], starts[at : end + 1] - lo, np.arange(at, end), np.zeros(end - at, np.int64)
        else:
            for i in range(lo, hi, CHUNK):
                part = data[i : min(i + CHUNK + WIDTH - 1, hi)]
                yield part, np.array([0, len(part)]), np.array([at]), np.array([i - lo])
        at = end


# ---- Burrows-Wheeler transforms over integer symbols -----------------------------------


def transform(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The transform of one shard and its suffix array (places in the strings laid end to end).

    Each string ends in 0, and equal suffixes stand in the order of their strings, so the
    order is total. Suffixes are sorted by doubling the compared length.
    """
    lengths = np.array([len(s) + 1 for s in strings])
    ends = np.cumsum(lengths)
    text = np.zeros(int(ends[-1]), np.int64)
    starts = ends - lengths
    for s, a in zip(strings, starts.tolist(), strict=True):
        text[a : a + len(s)] = s
    n = len(text)
    # a terminator is its own symbol: the terminator of string i is i, the others follow
    rank = text + len(strings) - 1
    rank[ends - 1] = np.arange(len(strings))
    reach, width = 1, int(lengths.max())
    while True:
        order = np.argsort(rank, kind="stable")
        ordered = rank[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if reach >= width or fresh[order[-1]] == n - 1:
            break
        beyond = np.zeros(n, np.int64)
        beyond[: n - reach] = fresh[reach:]
        rank, reach = fresh * (n + 1) + beyond, reach * 2
    before = order - 1
    whole = np.zeros(n, bool)
    whole[starts] = True
    symbols = np.where(whole[order], 0, text[before])
    return symbols, order


def merge(transforms: list[np.ndarray], strings: list[int], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of several transforms, and the length of each suffix's common prefix with the one before.

    Refines which shard the i-th suffix of all comes from: a step moves every suffix by one
    symbol to the left, stably by that symbol (Holt & McMillan, 2014), and with it the blocks
    of suffixes that agree so far. Lengths are exact below ``steps``; where the common prefix
    is longer they are ``steps``. ``strings`` are the shards' numbers of strings.
    """
    total, ends = sum(map(len, transforms)), sum(strings)
    kind = np.uint16 if max((int(t.max()) for t in transforms if len(t)), default=0) < 1 << 16 else np.int64
    own = [t.astype(kind) for t in transforms]
    source = np.repeat(np.arange(len(own), dtype=np.uint8), [len(t) for t in own])
    block = np.zeros(total, np.int64)
    common = np.full(total, -1, np.int64)
    fixed = np.repeat(np.arange(len(own), dtype=np.uint8), strings)
    for step in range(steps):
        symbols = np.empty(total, kind)
        for i, t in enumerate(own):
            symbols[source == i] = t
        order = np.argsort(symbols, kind="stable")  # radix on 16 bits
        source, ids, symbols = source[order], block[order], symbols[order]
        new = np.empty(total, bool)
        new[0] = True
        new[1:] = (symbols[1:] != symbols[:-1]) | (ids[1:] != ids[:-1])
        # the first suffixes are the terminators, in the order of their strings, all different
        source[:ends], new[:ends] = fixed, True
        if ends < total:
            new[ends] = True
        block = np.cumsum(new)
        common[new & (common < 0)] = step
    common[common < 0] = steps
    return source, common


def repeated(strings: list[np.ndarray], steps: int, shards: int = SHARDS) -> list[np.ndarray]:
    """For each string, the places where a substring of ``steps`` symbols starts that also starts at another place."""
    dealt = [list(range(i, len(strings), shards)) for i in range(min(shards, len(strings)))]
    both = [transform([strings[i] for i in d]) for d in dealt]
    source, common = merge([t for t, _ in both], [len(d) for d in dealt], steps)
    again = common >= steps
    again[:-1] |= again[1:]  # the suffix before has the same prefix
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(strings)
    for i, d in enumerate(dealt):
        places = np.sort(both[i][1][again[source == i]])
        starts = np.concatenate([[0], np.cumsum([len(strings[k]) + 1 for k in d])])
        cut = np.searchsorted(places, starts)
        for k, a, b, s in zip(d, cut[:-1], cut[1:], starts, strict=False):
            out[k] = places[a:b] - s
    return out


# ---- the operator ----------------------------------------------------------------------

_RUN = "minimizer long, run long, key binary, twice boolean, start int, windows int"
_PIECE = "key binary, at int, total long, core long, piece long, windows int, `left` binary, `right` binary"


def _coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each text (columns: key, text, whether it stands for several)."""
    for batch in batches:
        for data, starts, owner, skip in chunks(batch.column(1)):
            text, start, n, minimizer, run, _ = runs(data, starts, COARSE)
            of = pa.array(owner[text])
            yield pa.RecordBatch.from_arrays(
                [pa.array(minimizer.view(np.int64)), pa.array(run.view(np.int64)), batch.column(0).take(of), batch.column(2).take(of), pa.array((start + skip[text]).astype(np.int32)), pa.array(n.astype(np.int32))],
                ["minimizer", "run", "key", "twice", "start", "windows"],
            )


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the wanted runs of each text (columns: key, text, array of (total, start, windows))."""
    for whole in batches:
        for row in range(0, whole.num_rows, 200):
            batch = whole.slice(row, 200)
            data, starts = buffer(batch.column(1))
            column = batch.column(2)
            rows = column.flatten()
            lists = pc.list_value_length(column).to_numpy()
            text = np.repeat(np.arange(batch.num_rows), lists)
            total, start, n = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            begin = start.astype(np.int64) + starts[:-1][text]
            length = n.astype(np.int64) + WIDTH - 1
            ends = np.cumsum(length)
            at = 0
            while at < len(total):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
                own = np.concatenate([data[b : b + k] for b, k in zip(begin[at:end], length[at:end], strict=True)])
                bounds = np.concatenate([[0], np.cumsum(length[at:end])])
                of, first, m, core, piece, place = runs(own, bounds, FINE)
                raw, flat = own.tobytes(), bounds[of]
                left = [raw[a:b] for a, b in zip(flat + first, flat + place, strict=True)]
                right = [raw[a:b] for a, b in zip(flat + place + FINE, flat + first + m + WIDTH - 1, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(text[at:end][of])), pa.array((start[at:end][of] + first).astype(np.int32)), pa.array(total[at:end][of]), pa.array(core.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(m.astype(np.int32)), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                    ["key", "at", "total", "core", "piece", "windows", "left", "right"],
                )
                at = end


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """The repeated windows of a task's pieces, as bits of a long by place."""
    group = group.sort_values(["core", "piece"])
    core = group["core"].to_numpy()
    symbol = 257 + np.cumsum(np.concatenate([[0], core[1:] != core[:-1]]))
    strings = []
    for a, c, b in zip(group["left"], symbol.tolist(), group["right"], strict=True):
        s = np.empty(len(a) + 1 + len(b), np.int64)
        s[: len(a)] = np.frombuffer(a, np.uint8)
        s[len(a) + 1 :] = np.frombuffer(b, np.uint8)
        s += 1
        s[len(a)] = c
        strings.append(s)
    found = repeated(strings, WIDTH - FINE + 1)
    bits = [int(np.bitwise_or.reduce(np.int64(1) << p[p < n])) if len(p) else 0 for p, n in zip(found, group["windows"], strict=True)]
    out = pd.DataFrame({"core": core, "piece": group["piece"].to_numpy(), "bits": np.array(bits, np.int64)})
    return out[out["bits"] != 0]


def _key(text: str) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(F.encode(F.col(f"`{text}`"), "utf-8"), F.lit(b"")), 256), 1, 32))


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= MOST_BROADCAST else df


def copied(texts: DataFrame) -> DataFrame:
    """``key`` of the texts that are read once for all their copies: as many as may be broadcast, the most frequent first.

    Copies beyond that bound stay rows of their own, which gives the same result.
    """
    counts = scratch.written(texts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    levels = {r.level: r.keys for r in counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count(F.lit(1)).alias("keys")).collect()}
    least, room = 64, MOST_BROADCAST // 24
    while least > 1 and (room := room - levels.get(least - 1, 0)) >= 0:
        least -= 1
    return counts.where(F.col("n") >= F.lit(float(2**least))).select("key")


def covered(docs: DataFrame, text: str) -> DataFrame:
    """``key, found``: for each distinct text with repeats, its repeated windows.

    An entry of ``found`` (``start, windows, bits``) is a run of windows: all of them where
    ``bits`` is null, else those whose bit is set. No windows stand for the whole text.
    """
    texts = docs.select(_key(text).alias("key"), F.col(f"`{text}`").alias("text")).where(F.octet_length("text") >= WIDTH)
    many = copied(texts.select("key"))
    single = texts.join(F.broadcast(many), "key", "left_anti").withColumn("twice", F.lit(False))
    once = single.unionByName(texts.join(F.broadcast(many), "key", "left_semi").dropDuplicates(["key"]).withColumn("twice", F.lit(True)))
    weight = F.sum(F.when(F.col("twice"), 2).otherwise(1))

    seen = scratch.written(once.select("key", "text", "twice").mapInArrow(_coarse, _RUN), "runs", "zstd")
    groups = scratch.written(seen.groupBy("minimizer").agg(weight.alias("n")).where("n > 1").select("minimizer"), "minimizers")
    scratch.tidy(docs.sparkSession)  # shuffles that are over
    again = scratch.written(seen.join(groups, "minimizer", "left_semi"), "repeats", "zstd")
    scratch.tidy(docs.sparkSession, seen, groups)

    one = F.min(F.struct("twice", "key", "start", "windows"))
    totals = scratch.written(again.groupBy("minimizer", "run").agg(weight.alias("total"), one.alias("one")), "totals", "zstd")
    alone = totals.where("total = 1").select("minimizer").distinct()
    wanted = totals.join(alone, "minimizer", "left_semi").groupBy(F.col("one.key").alias("key"))
    wanted = scratch.written(wanted.agg(F.collect_list(F.struct("total", F.col("one.start").alias("start"), F.col("one.windows").alias("windows"))).alias("wanted")), "wanted")
    size = wanted.agg(F.sum(64 + 40 * F.size("wanted"))).first()[0] or 0
    # a text that several rows hold gives its pieces once
    pieces = once.join(_small(wanted, size), "key").select("key", "text", "wanted").mapInArrow(_fine, _PIECE)
    pieces = scratch.written(pieces.dropDuplicates(["key", "at"]), "pieces")
    scratch.tidy(docs.sparkSession)

    each = pieces.groupBy("core", "piece").agg(F.sum("total").alias("total"), F.first("windows").alias("windows"), F.first("left").alias("left"), F.first("right").alias("right"))
    each = scratch.written(each, "strings")
    full = each.where("total > 1").select("core", "piece", F.lit((1 << 62) - 1).cast("long").alias("bits"))
    cores = each.groupBy("core").agg(F.count(F.lit(1)).alias("strings"), F.min("total").alias("least")).where("strings > 1 and least = 1").select("core", "strings")
    open_rows = scratch.written(each.join(cores, "core"), "open")
    symbols = open_rows.agg(F.sum(F.octet_length("left") + F.octet_length("right") + 2)).first()[0] or 0
    tasks = max(1, symbols // TASK_SYMBOLS + 1)
    small = open_rows.where(F.col("strings") <= MOST_STRINGS).withColumn("task", F.pmod(F.xxhash64("core"), F.lit(tasks)))
    merged = small.groupBy("task").applyInPandas(_compare, "core long, piece long, bits long")
    # A core with more strings than a task should get: its windows are rows, counted before the shuffle.
    rest = open_rows.where(F.col("strings") > MOST_STRINGS).withColumn("place", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)))
    reach = F.lit(WIDTH - FINE) - (F.octet_length("left") - F.col("place"))
    rest = rest.withColumn("ahead", F.expr("substring(`left`, place + 1)")).withColumn("behind", F.substring(F.col("right"), F.lit(1), reach))
    same = rest.groupBy("core", "ahead", "behind").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = rest.join(same, ["core", "ahead", "behind"]).groupBy("core", "piece").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"))
    bits = full.unionByName(merged).unionByName(counted).groupBy("core", "piece").agg(F.bit_or("bits").alias("bits"))
    # only of runs that stand once: those that stand several times repeat whole
    some = pieces.where("total = 1").join(bits, ["core", "piece"]).select("key", F.col("at").alias("start"), "windows", "bits")

    whole = again.where("not twice").join(totals.where("total > 1").select("minimizer", "run"), ["minimizer", "run"], "left_semi")
    # written before texts are grouped, so that the join's hot keys can be split
    whole = scratch.written(whole.select("key", "start", "windows"), "whole", "zstd")
    both = whole.withColumn("bits", F.lit(None).cast("long")).unionByName(some)
    found = both.groupBy("key").agg(F.collect_set(F.struct("start", "windows", "bits")).alias("found"))
    of_copies = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("windows"), F.lit(None).cast("long").alias("bits")))
    out = scratch.written(found.unionByName(many.select("key", of_copies.alias("found"))), "covered", "zstd")
    scratch.tidy(docs.sparkSession, again, totals, wanted, pieces, each, open_rows, whole)
    return out


def _covers(found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The repeated strings of a batch's texts as arrays: the text, the first byte and the byte behind the last."""
    text_of = np.repeat(np.arange(len(found)), pc.fill_null(pc.list_value_length(found), 0).to_numpy())
    run = found.flatten()
    start, n = (run.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    bits, whole = pc.fill_null(run.field(2), 0).to_numpy(zero_copy_only=False), run.field(2).is_null().to_numpy(zero_copy_only=False)
    text, first = [text_of[whole]], [start[whole]]
    last = [np.where(n[whole] > 0, start[whole] + n[whole] + WIDTH - 1, np.iinfo(np.int64).max)]
    for i in range(WIDTH - FINE + 1):
        k = np.flatnonzero(~whole & (i < n) & (bits >> i & 1 == 1))
        text.append(text_of[k])
        first.append(start[k] + i)
        last.append(first[-1] + WIDTH)
    return np.concatenate(text), np.concatenate(first), np.concatenate(last)


def _spans(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The removed runs of a text of n bytes as rows (start, length)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(last, n), -1)
    inside = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    return np.stack([turn[::2], turn[1::2] - turn[::2]], 1)


def remove_repeats(docs: DataFrame, text: str = "text", as_text: bool = False, into: tuple[str, str] = ("spans", "kept")) -> DataFrame:
    """``docs`` with ``spans`` (removed runs: start and length in bytes) and ``kept`` (the other bytes).

    With ``as_text`` what is kept is a string: the rest of a character that a span cuts goes too.

    A byte goes if it is covered by a string of WIDTH bytes that also starts anywhere else,
    in the same text or another; matches never cross texts and are judged on the input. Null
    counts as empty; empty texts and texts below WIDTH bytes keep all; repeated rows are
    texts of their own, so both lose all of a text of WIDTH bytes or more. Other columns stay
    as they are, but for those that have one of the two names ``into``: these are replaced.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                owner, first, last = _covers(batch.column(2))
                order = np.argsort(owner, kind="stable")
                owner, first, last = owner[order], first[order], last[order]
                bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                spans, kept = [], []
                for i, t in enumerate(batch.column(1).cast(pa.binary())):
                    raw = t.as_py() or b""
                    a, b = bounds[i], bounds[i + 1]
                    own = _spans(len(raw), first[a:b], last[a:b]) if b > a else np.empty((0, 2), np.int64)
                    done, parts = 0, []
                    for s, n in own.tolist():
                        parts.append(raw[done:s])
                        done = s + n
                    parts.append(raw[done:])
                    spans.append([{"start": s, "length": n} for s, n in own.tolist()])
                    kept.append("".join(p.decode("utf-8", "ignore") for p in parts) if as_text else b"".join(parts))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), pa.array(kept, pa.string() if as_text else pa.binary())], ["row", "text", "spans", "kept"])

    found = covered(docs, text)
    # the user's columns travel in one struct, so that none can clash with ours
    row = F.struct(F.lit(0).alias(""), *[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row")
    keyed = docs.select(row, F.col(f"`{text}`").alias("text"), _key(text).alias("key")).join(found, "key", "left").select("row", "text", "found")
    made = T._parse_datatype_string(f"spans array<struct<start: bigint, length: bigint>>, kept {'string' if as_text else 'binary'}")
    out = keyed.mapInArrow(cut, T.StructType([keyed.schema["row"], keyed.schema["text"], *made.fields]))
    mine = [F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c not in into]
    return out.select(*mine, F.col("spans").alias(into[0]), F.col("kept").alias(into[1]))
