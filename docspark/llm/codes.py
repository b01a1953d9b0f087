"""Compression of vectors to one code a part, with codebooks fitted by Yinyang Lloyd rounds in integers.

A component x becomes floor(1024 x); a vector is cut into PARTS equal parts, each with a
codebook of its own. A round assigns each part to its nearest entry and replaces each entry
by the floor of its parts' mean. The entries of a codebook are clustered into groups once.
Each part keeps one lower bound for each group: no other entry of the group is nearer. When
entries move, a bound sinks by the furthest way that an entry of its group went, and only
groups whose bound no longer exceeds the (exact) distance to the own entry are scanned.
Bounds are rounded down, and whatever a bound lets through is compared by integer distances,
lower indexes first, so that ties and results are those of plain rounds.

A round is one pass over a written table of vectors, codes and bounds. Its tasks add one row
each with the sums of their parts, from which the next codebooks follow; codebooks have a
fixed size and are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm import scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a group, on average.
GROUP = 16
#: Vectors that are compared with all entries at a time.
ROWS = 2048
#: Integer components below this in size have exact distances in doubles, up to 2,048 components a part.
MOST = 1 << 20
#: Bytes of sums by label that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 8 << 20

_STATE = "id long, code binary, q binary, bounds binary, error long, sums binary"


def usable(vector: Column) -> Column:
    """Whether a vector has components and all are finite numbers."""
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(vector, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))


def usual_length(rows: DataFrame, vector: str) -> int | None:
    """The most frequent length of the vectors, the greater of equally frequent ones."""
    top = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else None


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows held in doubles."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def grouped(book: np.ndarray) -> list[np.ndarray]:
    """The entries of one codebook in groups of near ones (a few rounds of k-means from evenly spaced entries)."""
    n = max(1, len(book) // GROUP)
    centres = book[:: max(1, len(book) // n)][:n].astype(float)
    for _ in range(6):
        of = distances(book.astype(float), centres).argmin(1)
        centres = np.array([book[of == g].mean(0) if (of == g).any() else centres[g] for g in range(n)])
    return [np.flatnonzero(of == g) for g in range(n) if (of == g).any()]


def _down(x: np.ndarray) -> np.ndarray:
    """Bounds as 32-bit floats, rounded down."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def first_assignment(x: np.ndarray, book: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``code, distance, bounds`` of parts by looking at all entries."""
    d = distances(x, book)
    code = d.argmin(1)
    rows = np.arange(len(x))
    own = d[rows, code].copy()
    d[rows, code] = np.inf
    return code, own, _down(np.sqrt(np.stack([d[:, g].min(1) for g in groups], 1)))


def next_assignment(x: np.ndarray, code: np.ndarray, bounds: np.ndarray, book: np.ndarray, moved: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same after entries have moved by the distances ``moved``, looking only into groups whose bound fails."""
    bounds = _down(bounds - np.array([moved[g].max() for g in groups]))
    own = ((x - book[code]) ** 2).sum(1)
    look = bounds <= np.sqrt(own)[:, None]
    best, best_code = own.copy(), code.copy()
    scanned = []
    for g, members in enumerate(groups):
        rows = np.flatnonzero(look[:, g])
        if not len(rows):
            continue
        d = distances(x[rows], book[members])
        at = d.argmin(1)
        near, name = d[np.arange(len(rows)), at].copy(), members[at]
        d[np.arange(len(rows)), at] = np.inf
        scanned.append((g, rows, near, name, d.min(1)))
        better = (near < best[rows]) | ((near == best[rows]) & (name < best_code[rows]))
        best[rows[better]], best_code[rows[better]] = near[better], name[better]
    # an entry that is no longer one's own counts in its group's bound
    group_of = np.empty(len(book), np.int64)
    for g, members in enumerate(groups):
        group_of[members] = g
    left = np.flatnonzero(best_code != code)
    at = (left, group_of[code[left]])
    bounds[at] = np.minimum(bounds[at], _down(np.sqrt(own[left])))
    for g, rows, near, name, second in scanned:
        bounds[rows, g] = _down(np.sqrt(np.where(name == best_code[rows], second, near)))
    return best_code, best, bounds


class Books:
    """The codebooks of all parts, how far their entries moved last, and the groups of the entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.float64)
        self.groups = [grouped(b) for b in self.entries]
        self.most = max(len(g) for g in self.groups)
        self.moved: np.ndarray | None = None

    def update(self, sums: np.ndarray) -> None:
        """New entries from the sums of parts (counts last); an entry without parts stays."""
        new = self.entries.copy()
        count = sums[:, :, -1]
        used = count > 0
        new[used] = sums[:, :, :-1][used] // count[used][:, None]
        self.moved = np.sqrt(((new - self.entries) ** 2).sum(2))
        self.entries = new

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.astype(np.int64).ravel().tolist())).encode()).hexdigest()


def _integers(vectors: pa.Array) -> np.ndarray:
    return np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).reshape(len(vectors), -1)


def _sums(sums: np.ndarray, part: int, x: np.ndarray, code: np.ndarray) -> None:
    order = np.argsort(code, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], code[order][1:] != code[order][:-1]]))
    name = code[order][at]
    sums[part, name, :-1] += np.add.reduceat(x[order], at, axis=0).astype(np.int64)
    sums[part, name, -1] += np.diff(np.append(at, len(order)))


def _round(state: DataFrame, books: Books, label: T.DataType) -> DataFrame:
    """The vectors of ``state`` with their codes, bounds and errors under ``books``, and a row of sums for each task."""
    names = ["id", "label", "code", "q", "bounds", "error", "sums"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, groups, moved = books.entries, books.groups, books.moved
        size = entries.shape[2]
        sums = np.zeros((PARTS, entries.shape[1], size + 1), np.int64)
        kind = None
        for batch in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            n, kind = batch.num_rows, batch.column(1).type
            x = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<i4").reshape(n, PARTS, size).astype(np.float64)
            codes, bounds, error = np.empty((n, PARTS), np.uint8), np.zeros((n, PARTS, books.most), np.float32), np.zeros(n)
            if moved is not None:
                old = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, PARTS)
                known = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float32).reshape(n, PARTS, books.most)
            for p in range(PARTS):
                part = np.ascontiguousarray(x[:, p])
                if moved is None:
                    code, own, low = first_assignment(part, entries[p], groups[p])
                else:
                    code, own, low = next_assignment(part, old[:, p].astype(np.int64), known[:, p, : len(groups[p])].copy(), entries[p], moved[p], groups[p])
                codes[:, p], bounds[:, p, : len(groups[p])], error = code, low, error + own
                _sums(sums, p, part, code)
            cells = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cells(codes), batch.column(3), cells(bounds), pa.array(error.astype(np.int64)), pa.nulls(n, pa.binary())], names)
        if kind is not None:
            none = pa.nulls(1, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, kind), none, none, none, pa.nulls(1, pa.int64()), pa.array([sums.tobytes()], pa.binary())], names)

    return state.where("q is not null").mapInArrow(step, _schema(label))


def _schema(label: T.DataType) -> T.StructType:
    rest = T.StructType.fromDDL(_STATE).fields
    return T.StructType([rest[0], T.StructField("label", label), *rest[1:]])


def _total(state: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sums of all tasks. Each number's sums meet in the shuffle, so no task gets those of all tasks."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | int = 0
        for batch in batches:
            for one in batch.column(0):
                total = total + np.frombuffer(one.as_py(), np.int64)
        if isinstance(total, np.ndarray):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    rows = state.where("sums is not null").select("sums").mapInArrow(numbers, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(shape, np.int64)
    out.ravel()[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``id, label, code, error, label_error, codebooks_sha256`` of every usable vector.

    Vectors that are null or empty, or hold nulls or numbers that aren't finite, are dropped;
    so are vectors of another length than the most frequent one (of equally frequent lengths
    the greatest). Codebooks start from the 256 least ids (fewer, if there are fewer vectors;
    equal ids in the order of their vectors, null ids last). Repeated rows count as often as
    they stand. Other columns are ignored; without usable vectors the result is empty. A
    length that PARTS doesn't divide, and components of 1,024 or more in size, for which
    distances in doubles would not be exact, raise ValueError.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).where(usable(F.col("v")))
    kind = rows.schema["label"].dataType
    length = usual_length(rows, "v") or PARTS
    if length % PARTS:
        raise ValueError(f"vectors of {length} components can't be cut into {PARTS} equal parts")
    rows = rows.where(F.size("v") == length)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x = batch.num_rows, _integers(batch.column(2))
            if n and np.abs(x).max() >= MOST:
                raise ValueError(f"components must be below {MOST // SCALE} in size")
            none = pa.nulls(n, pa.binary())
            q = pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), none, q, none, pa.nulls(n, pa.int64()), none], ["id", "label", "code", "q", "bounds", "error", "sums"])

    state = scratch.written(rows.mapInArrow(whole, _schema(kind)), "vectors")
    least = rows.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(ENTRIES).collect()
    start = np.floor(np.array([r["v"] for r in least], np.float64).reshape(len(least), length) * SCALE)
    if not len(least):
        return state.select("id", "label", F.lit("").alias("code"), "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = Books(start.reshape(len(least), PARTS, -1).transpose(1, 0, 2))
    shape = (PARTS, len(least), length // PARTS + 1)
    for k in range(ROUNDS + 1):
        after = scratch.written(_round(state, books, kind), "codes")
        scratch.release(state)
        state = after
        if k < ROUNDS:
            books.update(_total(state, shape))
    found = state.where("q is not null").select("id", "label", F.lower(F.hex("code")).alias("code"), "error")
    by_label = scratch.written(found.groupBy("label").agg(F.sum("error").alias("label_error")), "errors")
    held = by_label.agg(F.sum(F.octet_length(F.col("label").cast("string")) + 64)).first()[0] or 0
    sums = by_label.withColumnRenamed("label", "of")
    out = found.join(F.broadcast(sums) if held <= MOST_BROADCAST else sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("id", "label", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
