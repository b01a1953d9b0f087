"""Full-text search by regular expressions over an index of trigrams.

The index holds, for each trigram of ASCII characters and each range of documents, the keys
of the documents that have it. A pattern is translated into a condition on trigrams that
every matching text fulfils; documents that fulfil it are candidates, and the pattern itself
decides. A pattern that says nothing on trigrams, or whose syntax isn't known to mean the
same to the translation and to the matcher, is matched against all documents.

Case is ignored, as the explorer does. The few characters beyond ASCII that match an ASCII
letter without regard to case are folded to it in the index.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as parser
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.sources.shared import bound_batches

#: Strings that one part of a pattern is expanded to at most, and members of a character set.
MOST_STRINGS, MOST_MEMBERS = 16, 4
#: Documents of a range of the index, about.
RANGE_DOCS = 4096

# Characters that match an ASCII letter when case is ignored: the long s, the Kelvin sign, the dotted and the dotless i.
_FOLDED = str.maketrans({"ſ": "s", "K": "k", "İ": "i", "ı": "i"})
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Escapes that mean the same to Python's parser and to Java's matcher, as far as trigrams are concerned.
_KNOWN_ESCAPES = set("dDwWsSbBtnrf")


def code(gram: str) -> int:
    a, b, c = gram.encode("ascii")
    return a << 16 | b << 8 | c


def grams_of(text: str | None) -> np.ndarray:
    """The distinct trigrams of a text, in order, as numbers; only those of three ASCII characters."""
    raw = np.frombuffer((text or "").translate(_FOLDED).encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    if len(raw) < 3:
        return np.empty(0, np.int32)
    plain = raw < 128
    whole = plain[:-2] & plain[1:-1] & plain[2:]
    x = raw.astype(np.int32)
    return np.unique((x[:-2] << 16 | x[1:-1] << 8 | x[2:])[whole])


# ---- patterns to conditions. A condition is True (says nothing), a number, or ("and" | "or", [conditions])


def _both(kind: str, parts: list[Any]) -> Any:
    if kind == "and":
        parts = [p for p in parts if p is not True]
        return True if not parts else parts[0] if len(parts) == 1 else (kind, parts)
    return True if not parts or any(p is True for p in parts) else parts[0] if len(parts) == 1 else (kind, parts)


def _literal(s: str) -> Any:
    """What a text that holds ``s`` must have; characters beyond ASCII part it."""
    runs = re.findall("[\x00-\x7f]{3,}", s)
    return _both("and", [code(r[i : i + 3]) for r in runs for i in range(len(r) - 2)])


def _any_of(strings: set[str]) -> Any:
    return _both("or", [_literal(s) for s in sorted(strings)])


def _fold(c: int) -> str:
    """A character as the index has it; one beyond ASCII becomes a break."""
    s = chr(c).translate(_FOLDED).lower() if c < 128 or chr(c).translate(_FOLDED) != chr(c) else "�"
    return s


class _Run:
    """A sequence of parts: strings that the current stretch may be, and conditions so far."""

    def __init__(self) -> None:
        self.strings, self.conditions = {""}, []

    def exact(self, more: set[str]) -> None:
        if len(self.strings) * len(more) > MOST_STRINGS or max(map(len, self.strings)) > 200:
            self.flush()
        if len(more) > MOST_STRINGS:
            self.conditions.append(_any_of(more))
            return
        self.strings = {a + b for a in self.strings for b in more}

    def flush(self) -> None:
        self.conditions.append(_any_of(self.strings))
        self.strings = {""}

    def condition(self) -> Any:
        self.flush()
        return _both("and", self.conditions)


def _walk(tree: Any) -> tuple[set[str] | None, Any]:
    """``strings, condition`` of a parsed pattern: all that it matches if these are few, else None, and what a match needs."""
    run, exact = _Run(), True
    for op, value in tree:
        if op is C.LITERAL:
            run.exact({_fold(value)})
        elif op is C.IN and (members := _members(value)):
            run.exact(members)
        elif op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
            continue  # of no width: what stands on both sides still meets
        elif op in (C.SUBPATTERN, C.ATOMIC_GROUP):
            strings, need = _walk(value[-1] if op is C.SUBPATTERN else value)
            if strings is None:
                run.flush()
                run.conditions.append(need)
                exact = False
            else:
                run.exact(strings)
        elif op is C.BRANCH:
            parts = [_walk(p) for p in value[1]]
            if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
                run.exact(set().union(*[s for s, _ in parts]))
            else:
                run.flush()
                run.conditions.append(_both("or", [n if s is None else _any_of(s) for s, n in parts]))
                exact = False
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, inner = value
            strings, need = _walk(inner)
            if strings is not None and least == most and least <= 4:
                for _ in range(least):
                    run.exact(strings)
            elif strings is not None and (least, most) == (0, 1):
                run.exact(strings | {""})
            else:
                if strings is not None and least:
                    run.exact(strings)
                run.flush()
                if least:
                    run.conditions.append(need if strings is None else True)
                    if strings is not None:  # the last time stands before what follows
                        run.exact(strings)
                exact = False
        else:  # any character, a large set, a reference
            run.flush()
            exact = False
    if exact and not run.conditions:
        return run.strings, _any_of(run.strings)
    return None, run.condition()


def _members(items: list[Any]) -> set[str] | None:
    """The members of a small character set."""
    out: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(_fold(value))
        elif op is C.RANGE and value[1] - value[0] < 2 * MOST_MEMBERS:
            out |= {_fold(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if 0 < len(out) <= MOST_MEMBERS else None


def _plain(pattern: str) -> bool:
    """Whether a pattern uses only syntax that the translation and the matcher read alike."""
    inside = False
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern) or pattern[i + 1].isalnum() and pattern[i + 1] not in _KNOWN_ESCAPES:
                return False
            i += 1
        elif inside:
            if c == "[" or pattern.startswith("&&", i):
                return False
            if c == "]":
                inside = False
        elif c == "[":
            inside = True
            i += pattern.startswith("^", i + 1)
            if pattern.startswith("]", i + 1):
                return False
        elif pattern.startswith("(?", i) and not re.match(r"\(\?(?::|=|!|<=|<!|>)", pattern[i:]):
            return False
        i += 1
    return True


def condition(pattern: str) -> Any:
    """What of trigrams every text has that ``pattern`` matches; True if nothing follows from it."""
    if not _plain(pattern):
        return True
    try:
        return _walk(parser.parse(pattern, re.IGNORECASE))[1]
    except (re.error, RecursionError, OverflowError):
        return True


def needed(cond: Any) -> set[int]:
    return set() if cond is True else {cond} if isinstance(cond, int) else set().union(*[needed(c) for c in cond[1]])


def holds(cond: Any, grams: Column) -> Column:
    """A condition over a column with the trigrams that a document has of the needed ones."""
    if isinstance(cond, int):
        return F.array_contains(grams, cond)
    parts = [holds(c, grams) for c in cond[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if cond[0] == "and" else out | p
    return out


# ---- index and search


def build(docs: DataFrame, key: str, *texts: str) -> DataFrame:
    """``gram, range, ids``: an index of the trigrams of some text columns, each for itself, laid out by trigram and range.

    Null texts have none. Keys are distinct.
    """

    bound_batches(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.concatenate([grams_of(t) for t in row])) for row in zip(*[batch.column(i).to_pylist() for i in range(1, batch.num_columns)], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["id", "grams"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("grams", T.ArrayType(T.IntegerType()))])
    ranges = max(1, docs.count() // RANGE_DOCS)
    rows = docs.select(F.col(key).alias("id"), *texts).mapInArrow(read, schema)
    flat = rows.select("id", F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int").alias("range"), F.explode("grams").alias("gram"))
    made = flat.groupBy("gram", "range").agg(F.collect_list("id").alias("ids"))  # a range's documents at most
    return made.repartitionByRange("gram", "range").sortWithinPartitions("gram", "range")


def candidates(index: DataFrame, pattern: str) -> DataFrame | None:
    """``id`` of the documents that may match; None if all may."""
    cond = condition(pattern)
    if cond is True:
        return None
    rows = index.where(F.col("gram").isin(sorted(needed(cond)))).select(F.explode("ids").alias("id"), "gram")
    return rows.groupBy("id").agg(F.collect_set("gram").alias("grams")).where(holds(cond, F.col("grams"))).select("id")


def matches(pattern: str, *texts: str) -> Column:
    """Whether one of the text columns has a match, case apart; null texts have none."""
    out = F.lit(False)
    for t in texts:
        out = out | F.coalesce(F.col(t).rlike(f"(?iu){pattern}"), F.lit(False))
    return out


def search(docs: DataFrame, index: DataFrame, pattern: str, key: str, *texts: str) -> DataFrame:
    """The rows of ``docs`` that match ``pattern``; only the texts of candidates are read against it."""
    some = candidates(index, pattern)
    rows = docs if some is None else docs.join(some, docs[key] == some["id"], "left_semi")
    return rows.where(matches(pattern, *texts))
