"""Words, shingles and sets of whole texts as 64-bit hashes, vectorised over Arrow buffers."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at a time; a chunk ends between words, so a longer word makes a longer chunk.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C55
#: Steps of the chain in which a word's hash is made, eight bytes each.
CHAIN = 32
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, kept between tasks up to two chunks."""
    kept = sys.__dict__.setdefault("_docspark_powers", {})
    size = 2 * CHUNK if n <= 2 * CHUNK else n
    if size not in kept:
        with np.errstate(over="ignore"):
            both = []
            for b in (BASE, pow(BASE, -1, 1 << 64)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                both.append(np.cumprod(p, dtype=np.uint64))
        if size > 2 * CHUNK:
            return both[0], both[1]
        kept[size] = (both[0], both[1])
    return kept[size]


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another, and where each begins; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def slices(texts: pa.Array, most: int = 2 * CHUNK) -> Iterator[pa.Array]:
    """The texts of a batch a few at a time: as many as have ``most`` bytes together, or one that has more."""
    if not len(texts):
        return
    _, starts = buffer(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + most, "right")) - 1)
        yield texts.slice(at, end - at)
        at = end


def _spans(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the spans ``data[first:last]``: eight bytes at a time are mixed into a chain, so there is no sum that equal parts could cancel in.

    Beyond CHAIN times eight bytes the rest enters as a sum of values that are mixed with their place.
    """
    acc = mix((last - first).astype(np.uint64) + np.uint64(BASE))
    lanes = -(-(last - first) // 8)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.arange(8)

    def values(at: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = padded[at[:, None] + eight].view("<u8").ravel()
        short = np.minimum(end - at, 8).astype(np.uint64)
        return mix(raw & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * short)))

    for j in range(min(CHAIN, int(lanes.max(initial=0)))):
        own = np.flatnonzero(lanes > j)
        acc[own] = mix(acc[own] * np.uint64(BASE) + values(first[own] + 8 * j, last[own]))
    long = np.flatnonzero(lanes > CHAIN)
    if len(long):
        many = lanes[long] - CHAIN
        place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        v = mix(values(np.repeat(first[long], many) + 8 * (CHAIN + place), np.repeat(last[long], many)) + mix(place.astype(np.uint64)))
        acc[long] = mix(acc[long] * np.uint64(BASE) + np.add.reduceat(v, np.cumsum(many) - many))
    return acc


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, A-Z in lower case, and the first of each text."""
    data, starts = buffer(texts)
    edge = np.zeros(len(data) + 1, bool)  # a text begins here
    edge[starts] = True
    hashes, places = [], []
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data):
            stop = edge[end : min(end + CHUNK, len(data))] | _SPACE[data[end : end + CHUNK]]
            hit = int(stop.argmax())
            end += hit if stop[hit] else len(stop)
            if stop[hit]:
                break
        part = data[at:end]
        inside = ~_SPACE[part]
        before = np.empty(len(part), bool)
        before[0] = False
        before[1:] = inside[:-1]
        before &= ~edge[at:end]
        after = np.empty(len(part), bool)
        after[-1] = False
        after[:-1] = inside[1:]
        after &= ~edge[at + 1 : end + 1]
        first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        hashes.append(_spans(_FOLD[part], first, last))
        places.append(first + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    place = np.concatenate(places)
    return np.concatenate(hashes), np.searchsorted(place, starts)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of ``width`` words of each text.

    A text with fewer words, but some, has its whole sequence as its one shingle; one
    without words has none.
    """
    h, first = word_hashes(texts)
    many = np.uint64(0xD6E8FEB86659FD93)

    def chain(rows: list[np.ndarray]) -> np.ndarray:
        acc = np.full(len(rows[0]), len(rows), np.uint64)
        for r in rows:
            acc = mix(acc * many + r)
        return acc

    full = chain([h[k : len(h) - width + 1 + k] for k in range(width)]) if len(h) >= width else np.empty(0, np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(full[a : b - width + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(chain([h[i : i + 1] for i in range(a, b)]))
        else:
            out.append(h[:0])
    return out
