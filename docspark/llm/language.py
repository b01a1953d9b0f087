"""Language identification by bit-sliced Bloom filters of byte n-grams.

One filter holds all languages: a slot keeps one bit a language, so that the masks at an
n-gram's slots, and-ed, give every language that contains it. A text's language is the one
with the largest count of contained n-grams, after the part that false positives explain
is taken off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm import scratch
from docspark.llm.words import buffer

NGRAM = 4
SLOTS = 1 << 20
#: Bytes, and n-grams, that are worked on at a time.
WINDOW, GATHERED = 1 << 19, 4_000_000
HASHES = 3
#: An n-gram is in a language's filter if at least this share of the language's n-grams are it. So each filter holds at most 1 / MIN_SHARE of them.
MIN_SHARE = 1 / 40_000
WORD_BITS = 64
UNKNOWN = "und"

# Bytes of n-grams: ASCII letters in lower case and all other non-ASCII bytes stay, the rest are spaces.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def windows(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The folded bytes of some texts at a time, where each begins, and which text each is.

    Texts are put in lower case; null is empty. A text longer than WINDOW comes in pieces
    that overlap by NGRAM - 1 bytes, so that each of its n-grams is in exactly one.
    """
    data, starts = buffer(pc.utf8_lower(texts))
    at = 0
    while at < len(starts) - 1:
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + WINDOW, "right")) - 1)
        end = min(end, len(starts) - 1)
        lo, hi = int(starts[at]), int(starts[end])
        if hi - lo <= WINDOW:
            yield _FOLD[data[lo:hi]], starts[at : end + 1] - lo, np.arange(at, end)
        else:
            for i in range(lo, hi, WINDOW):
                part = _FOLD[data[i : min(i + WINDOW + NGRAM - 1, hi)]]
                yield part, np.array([0, len(part)]), np.array([at])
        at = end


def grams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (as uint32) of the texts in a window, and the first of each. Runs of spaces count as one."""
    n = len(data)
    if n < NGRAM:
        return np.empty(0, np.uint32), np.zeros(len(starts), np.int64)
    code = np.zeros(n, np.uint32)
    for k in range(NGRAM):
        code <<= np.uint32(8)
        code[: n - k] |= data[k:]
    keep = np.ones(n, bool)
    space = data == 32
    double = space[:-1] & space[1:]
    for k in range(NGRAM - 1):  # no n-gram with two spaces side by side
        keep[: n - 1 - k] &= ~double[k:]
    for k in range(1, NGRAM):  # nor one that crosses the end of its text
        at = starts[1:] - k
        keep[at[at >= starts[:-1]]] = False
    seen = np.concatenate([[0], np.cumsum(keep)])
    return code[keep], seen[starts]


def slots(code: np.ndarray) -> list[np.ndarray]:
    """The HASHES slots of each n-gram, by double hashing of one 64-bit mix."""
    h = code.astype(np.uint64)
    h = (h ^ (h >> np.uint64(16))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass(frozen=True)
class Model:
    """``masks`` has one row of slots for every WORD_BITS languages."""

    languages: tuple[str, ...]
    masks: np.ndarray
    false_rate: np.ndarray

    @staticmethod
    def of(found: list[tuple[str, np.ndarray]]) -> Model:
        """``found``: each language with its n-grams."""
        kind = next((t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(found) <= bits), np.uint64)
        masks = np.zeros((max(1, -(-len(found) // WORD_BITS)), SLOTS), kind)
        for i, (_, codes) in enumerate(found):
            for s in slots(codes):
                masks[i // WORD_BITS][s] |= kind(1 << i % WORD_BITS)
        fill = np.array([((masks[i // WORD_BITS] >> kind(i % WORD_BITS)) & kind(1)).mean() for i in range(len(found))])
        return Model(tuple(x for x, _ in found), masks, fill**HASHES)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language (-1: no letter, or no language learnt) and score of each text."""
        n, some = len(texts), np.array(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False), dtype=bool)
        if not self.languages:
            return np.full(n, -1), np.zeros(n)
        total, count = np.zeros(n, np.int64), np.zeros((len(self.languages), n), np.int64)
        for data, starts, owners in windows(texts):
            code, first = grams(data, starts)
            places = slots(code)
            np.add.at(total, owners, np.diff(first))
            for k, mask in enumerate(self.masks):
                hit = mask[places[0]]
                for s in places[1:]:
                    hit &= mask[s]
                for i in range(k * WORD_BITS, min((k + 1) * WORD_BITS, len(self.languages))):
                    sums = np.concatenate([[0], np.cumsum((hit >> hit.dtype.type(i % WORD_BITS)) & hit.dtype.type(1), dtype=np.int64)])
                    np.add.at(count[i], owners, sums[first[1:]] - sums[first[:-1]])
        false = self.false_rate[:, None]
        share = np.maximum(count - total * false, 0) / (1 - false) / np.maximum(total, 1)
        best = share.argmax(0)
        top = share[best, np.arange(n)]
        score = np.clip(top / np.maximum(share.sum(0), 1e-12), 0, 1)
        return np.where(some, best, -1), np.where(some, score, 0.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Learn from every row with a language and a text.

    N-grams are counted over all rows: within each task first, then by one small shuffle.
    The driver gets at most 1 / MIN_SHARE n-grams of each language.
    """

    def counted(names: list[str], gathered: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for name, codes in zip(names, gathered, strict=True):
            if codes:
                values, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = batch.column(1).dictionary_encode()
            names, of = each.dictionary.to_pylist(), np.array(each.indices)
            gathered: list[list[np.ndarray]] = [[] for _ in names]
            held = 0
            for data, starts, owners in windows(batch.column(0)):
                code, first = grams(data, starts)
                row = np.repeat(of[owners], np.diff(first))
                for i in range(len(names)):
                    gathered[i].append(code[row == i])
                held += len(code)
                if held > GATHERED:
                    yield from counted(names, gathered)
                    gathered, held = [[] for _ in names], 0
            yield from counted(names, gathered)

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = scratch.written(counts, "language-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # one row a language
    kept = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= F.col("total") * MIN_SHARE).select("lang", "gram").toPandas()
    return Model.of([(name, np.sort(x["gram"].to_numpy()).astype(np.uint32)) for name, x in sorted(kept.groupby("lang"))])


def add_language(docs: DataFrame, model: Model, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Keep the columns of ``docs`` and add ``lang_pred`` and ``score`` (or the names ``into``); every row stays, repeated ones too.

    A null text, or one without a letter, is UNKNOWN with score 0. Of languages that share
    the greatest count the first by name is given; so is it, with score 0, to a text with
    letters none of whose n-grams is known, or that is too short for one. A column that has
    one of the two names already is replaced. An empty table stays empty.
    """
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        best, score = model.predict(texts)
        names = pa.array([*model.languages, UNKNOWN], pa.string())
        return pa.StructArray.from_arrays([names.take(pa.array(np.where(best < 0, len(model.languages), best))), pa.array(score)], ["lang_pred", "score"])

    both = scratch.fresh(docs, "__lang")
    return docs.withColumn(both, predict(F.col(text))).withColumns({into[0]: F.col(both)["lang_pred"], into[1]: F.col(both)["score"]}).drop(both)
