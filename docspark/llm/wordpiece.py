"""Word-piece counts by a linear longest-match automaton (Song et al., 2021).

Greedy word-piece tokenisation takes the longest piece of the vocabulary at each place. The
automaton is a trie of the pieces with failure links: where no edge goes on, the link leads
to the state of what is left after the longest pieces have been taken, and the number of
pieces taken is stored with the state. So a word's count comes from one pass over its
characters, adding stored numbers; no piece is ever built.

A word is a maximal run of characters other than white space, after the word mark; pieces
and word are Unicode text. A character that is in no piece counts as one piece for each of
its UTF-8 bytes, as tokenizers with byte fallback do.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm import scratch

MARK = "▁"
#: Characters of distinct words that advance together, and words above which a word goes alone.
TOGETHER, LONG = 1 << 20, 200


class Automaton:
    """The trie as sorted edges, with failure links and popped counts as arrays."""

    def __init__(self, pieces: list[str]):
        letters = sorted({c for p in pieces for c in p})
        vocabulary = set(pieces)
        self.letters = np.array([ord(c) for c in letters], np.int64)
        missing = [c for c in letters if c not in vocabulary]
        # A letter that is no piece itself falls back to its bytes, as a piece of that many tokens.
        edges: list[dict[int, int]] = [{}]
        ends, depth = [0], [0]
        for p in sorted(vocabulary | set(missing)):
            at = 0
            for c in p:
                code = int(np.searchsorted(self.letters, ord(c)))
                if code not in edges[at]:
                    edges[at][code] = len(edges)
                    edges.append({})
                    ends.append(0)
                    depth.append(depth[at] + 1)
                at = edges[at][code]
            ends[at] = len(p.encode()) if p in missing else 1
        n = len(edges)
        link, popped = np.zeros(n, np.int64), np.zeros(n, np.int64)
        queue = [0]
        for at in queue:
            for code, to in edges[at].items():
                queue.append(to)
                if ends[to]:
                    link[to], popped[to] = 0, ends[to]
                    continue
                z, count = int(link[at]), int(popped[at])
                # every single letter is a state with ends, so an edge is found at the root at the latest
                while code not in edges[z]:
                    count += int(popped[z])
                    z = int(link[z])
                link[to], popped[to] = edges[z][code], count
        self.link, self.popped, self.base = link, popped, len(letters)
        keys = np.array([s * self.base + c for s, e in enumerate(edges) for c in e], np.int64)
        into = np.array([t for e in edges for t in e.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.into, self.edges = keys[order], into[order], edges

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Letters by number; -1 for characters in no piece."""
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[at] == points, at, -1)

    def count_one(self, points: np.ndarray) -> int:
        """The pieces of one word, a character at a time."""
        codes, state, total = self.codes(points).tolist(), 0, 0
        for code, p in zip(codes, points.tolist(), strict=True):
            if code < 0:
                total, state = total + self._flush(state) + _width(p), 0
                continue
            while code not in self.edges[state]:
                total += int(self.popped[state])
                state = int(self.link[state])
            state = self.edges[state][code]
        return total + self._flush(state)

    def _flush(self, state: int) -> int:
        total = 0
        while state:
            total += int(self.popped[state])
            state = int(self.link[state])
        return total

    def count(self, words: list[str]) -> np.ndarray:
        """The pieces of each word; short words advance side by side, character by character."""
        out = np.zeros(len(words), np.int64)
        points = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) for w in words]
        lengths = np.array([len(p) for p in points], np.int64)
        for i in np.flatnonzero(lengths > LONG).tolist():
            out[i] = self.count_one(points[i])
        short = np.flatnonzero((lengths > 0) & (lengths <= LONG))
        short = short[np.argsort(-lengths[short], kind="stable")]
        at = 0
        while at < len(short):
            own = short[at : at + max(1, TOGETHER // int(lengths[short[at]]))]
            at += len(own)
            out[own] = self._side_by_side([points[i] for i in own.tolist()], lengths[own])
        return out

    def _side_by_side(self, points: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        """``points``: longest first, so the words that still go on are always the first ones."""
        grid = np.zeros((len(points), int(lengths[0])), np.int64)
        grid[np.arange(grid.shape[1]) < lengths[:, None]] = np.concatenate(points)
        state, total = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        for k in range(grid.shape[1]):
            going = int(np.searchsorted(-lengths, -k, "left"))  # lengths above k
            p = grid[:going, k]
            code = self.codes(p)
            unknown = np.flatnonzero(code < 0)
            if len(unknown):
                self._pop(state, total, unknown)
                total[unknown] += _widths(p[unknown])
            left = np.flatnonzero(code >= 0)
            while len(left):
                key = state[left] * self.base + code[left]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                goes = self.keys[at] == key
                state[left[goes]] = self.into[at[goes]]
                left = left[~goes]
                total[left] += self.popped[state[left]]
                state[left] = self.link[state[left]]
        self._pop(state, total, np.arange(len(points)))
        return total

    def _pop(self, state: np.ndarray, total: np.ndarray, at: np.ndarray) -> None:
        at = at[state[at] > 0]
        while len(at):
            total[at] += self.popped[state[at]]
            state[at] = self.link[state[at]]
            at = at[state[at] > 0]


def _width(point: int) -> int:
    return 1 if point < 0x80 else 2 if point < 0x800 else 3 if point < 0x10000 else 4


def _widths(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)


def pieces_of(model_path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def automaton(model_path: str) -> Automaton:
    """One automaton a Python worker, kept between tasks; its size is that of the vocabulary."""
    kept: dict[str, Any] = sys.__dict__.setdefault("_docspark_automata", {})
    if model_path not in kept:
        kept[model_path] = Automaton(pieces_of(model_path))
    return kept[model_path]


def count_texts(texts: pa.Array, machine: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Words and pieces of each text; each distinct word of the batch is counted once."""
    split = pc.utf8_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
    flat = split.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    index = flat.indices.to_numpy(zero_copy_only=False)
    each = np.where([w == "" for w in names], 0, 1) if names else np.zeros(0, np.int64)
    pieces = machine.count([MARK + w if w else "" for w in names]) if names else each
    first = split.offsets.to_numpy()
    first = first - first[0]
    words = np.concatenate([[0], np.cumsum(each[index])])
    total = np.concatenate([[0], np.cumsum(pieces[index])])
    return words[first[1:]] - words[first[:-1]], total[first[1:]] - total[first[:-1]]


def add_counts(docs: DataFrame, model_path: str, text: str = "text", into: tuple[str, str] = ("n_words", "n_tokens")) -> DataFrame:
    """Keep the columns of ``docs`` and add ``n_words`` and ``n_tokens`` (or the names ``into``).

    Null, empty and blank texts have none of either. Nothing is shuffled: every row is
    counted where it is read, repeated rows each for itself, and a text of any length is
    counted whole. A column that has one of the two names already is replaced; an empty
    table stays empty.
    """
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("struct<n_words: bigint, n_tokens: bigint>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = automaton(model_path)
        for texts in batches:
            words, tokens = count_texts(texts, machine)
            yield pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["n_words", "n_tokens"])

    both = scratch.fresh(docs, "__count")
    return docs.withColumn(both, count(F.col(text))).withColumns({into[0]: F.col(both)["n_words"], into[1]: F.col(both)["n_tokens"]}).drop(both)
