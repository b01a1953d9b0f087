"""Quality score from zstandard dictionaries of good and bad text.

Two dictionaries are trained, one on text labelled good and one on text labelled bad. A
text is cut into blocks of BLOCK bytes (all of them, so that a long text cannot teach the
compressor more than the dictionary knows) and compressed with both. The difference of the
two sizes over their sum, the smaller size a byte and the logarithm of the length go
through a logistic calibration fitted on labelled rows that built no dictionary.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from docspark.llm import scratch

BLOCK = 512
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: The fit reads at most so many rows a label for the dictionary and for the calibration, each with its whole text.
DICTIONARY_ROWS, CALIBRATION_ROWS = 2000, 3000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """``weights`` are of ``features``; where ``good`` is None the score is ``prior``."""

    good: bytes | None
    bad: bytes | None
    weights: tuple[float, ...]
    prior: float

    def compressors(self) -> list[Any]:
        """One compressor for each dictionary; a Python worker keeps those of the last model between tasks."""
        import zstandard as z

        name = hashlib.sha256((self.good or b"") + b"|" + (self.bad or b"")).digest()
        kept = sys.__dict__.setdefault("_docspark_compressors", {})
        if name in kept:
            return kept[name]

        def one(raw: bytes) -> Any:
            d = z.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            return z.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)

        kept.clear()
        kept[name] = [one(self.good), one(self.bad)] if self.good and self.bad else []
        return kept[name]

    def score(self, texts: list[str | None], compressors: list[Any]) -> np.ndarray:
        if not compressors:
            return np.full(len(texts), self.prior)
        x = np.array([features((t or "").encode("utf-8", "replace"), *compressors) for t in texts]).reshape(-1, 6)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))


def features(data: bytes, good: Any, bad: Any) -> list[float]:
    g = b = 0
    for i in range(0, max(len(data), 1), BLOCK):
        block = data[i : i + BLOCK]
        g += len(good.compress(block))
        b += len(bad.compress(block))
    n = len(data) + 20
    gap, rate = (b - g) / (b + g), min(g, b) / n
    return [1.0, gap, rate, rate * rate, np.log(n), gap * np.log(n)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        bend = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(bend, slope)
    return w


def dictionary(texts: list[str]) -> bytes | None:
    """A dictionary from all blocks of some texts; None where there is too little."""
    import zstandard as z

    blocks = [raw[i : i + BLOCK] for raw in (t.encode("utf-8", "replace") for t in texts) for i in range(0, len(raw), BLOCK)]
    if len(blocks) < 8:
        return None
    try:
        return z.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except z.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(blocks)[-DICTIONARY_BYTES:]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def usable_labels(labels: DataFrame) -> DataFrame:
    """Labelled ids to learn from: with a label, and not held out."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "quality")


def label_counts(docs: DataFrame, labels: DataFrame) -> tuple[int, int]:
    """How many good and bad labels with a text there are in all; ids are counted first, so repeated ids don't multiply rows."""
    marks = usable_labels(labels).groupBy("doc_id").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    texts = docs.where(F.col("text").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    r = marks.join(texts, "doc_id").agg(F.sum(F.col("good") * F.col("n")).alias("good"), F.sum(F.col("bad") * F.col("n")).alias("bad")).first()
    return (r.good or 0, r.bad or 0) if r else (0, 0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows that aren't held out.

    The sample is, for each label, the first DICTIONARY_ROWS + CALIBRATION_ROWS rows by a
    hash of doc_id, with their whole texts: the same rows for any partitioning. About two
    fifths of each label (DICTIONARY_ROWS at most) meet in the one task that trains the
    dictionaries. The others are compressed where they are, and the driver calibrates on
    their features alone, six numbers a row.

    Rows with a null id, label or text aren't learnt from. The labels' own share, in the
    intercept and as the score where there is too little labelled text of either kind (0.5 if
    there is none), is counted over all of them and not over the sample.
    """
    bound = DICTIONARY_ROWS + CALIBRATION_ROWS
    usable, (n_good, n_bad) = usable_labels(labels), label_counts(docs, labels)
    prior = n_good / (n_good + n_bad) if n_good + n_bad else 0.5
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = usable.where("quality = 1").orderBy(*by_hash).limit(bound).unionByName(usable.where("quality = 0").orderBy(*by_hash).limit(bound))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())  # at most 2 * bound ids
    place = F.row_number().over(W.partitionBy("quality").orderBy(*by_hash, "text"))
    sample = scratch.written(rows.select("quality", "text", place.alias("place")).where(F.col("place") <= bound), "sample")
    sizes = {r.quality: r.n for r in sample.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {q: min(DICTIONARY_ROWS, sizes.get(q, 0) * 2 // 5) for q in (0, 1)}
    trains = F.col("place") <= F.when(F.col("quality") == 1, share[1]).otherwise(share[0])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, list[str]] = {0: [], 1: []}
        for batch in batches:
            for q, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts[q].append(t)
        yield pa.RecordBatch.from_arrays([pa.array([dictionary(texts[1])], pa.binary()), pa.array([dictionary(texts[0])], pa.binary())], ["good", "bad"])

    made = sample.where(trains).repartition(1).sortWithinPartitions("quality", "place").select("quality", "text").mapInArrow(learn, "good binary, bad binary").first()
    plain = Model(bytes(made.good) if made and made.good else None, bytes(made.bad) if made and made.bad else None, (), prior)
    if not plain.good or not plain.bad:
        return Model(None, None, (), prior)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = plain.compressors()
        for batch in batches:
            x = [features(t.encode("utf-8", "replace"), *pair) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], ["quality", "place", "x"])

    # at most 2 * CALIBRATION_ROWS rows of six numbers
    rest = sorted((r.quality, r.place, r.x) for r in sample.where(~trains).select("quality", "text", "place").mapInArrow(measure, "quality int, place int, x array<double>").collect())
    y = np.array([float(q) for q, *_ in rest])
    if not (0 < y.sum() < len(y)):
        return Model(None, None, (), prior)
    w = logistic(np.array([x for *_, x in rest]), y)
    # The calibration rows hold as many of each label as the bound lets in; put the labels' own share back.
    w[0] += np.log(max(n_good, 1) / max(n_bad, 1)) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(plain.good, plain.bad, tuple(map(float, w)), prior)


def add_score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Add the score of every whole text; null counts as empty, and both get a score.

    Repeated rows are scored alike, an empty table stays empty, and a column that has the
    name ``into`` already is replaced; all other columns stay.
    """

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pair = model.compressors()
        for texts in batches:
            yield pd.Series(model.score([t if isinstance(t, str) else None for t in texts], pair))

    return docs.withColumn(into, score(F.col(text)))
