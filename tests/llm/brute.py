"""Plain definitions that the operators are held against."""

from collections import Counter

import numpy as np


def greedy(word, pieces):
    n = i = 0
    longest = max(map(len, pieces))
    while i < len(word):
        k = next((k for k in range(min(longest, len(word) - i), 0, -1) if word[i : i + k] in pieces), 0)
        n += 1 if k else len(word[i].encode())
        i += k or 1
    return n


def shingles(text, width):
    w = [bytes(x) for x in (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(texts, width, percent):
    sets = [shingles(t, width) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def brute_removed(texts, width=200):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if n[b[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append(bytes(x for x, g in zip(b, gone) if not g))
    return out
