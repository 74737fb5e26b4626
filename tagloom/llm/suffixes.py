"""Suffix arrays of numbered words, sorted by numpy prefix doubling, and the n-grams that their LCP intervals count."""

from __future__ import annotations

import numpy as np


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """The starts of all suffixes in order of their first ``depth`` words or more.

    Ranks by the first h words become ranks by the first 2h: each suffix's rank and that of
    the suffix h words on are one number, sorted. What is beyond the end sorts first.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[1], np.diff(words[order]) != 0])) if n else []
    h = 1
    while h < depth and n and rank[order[-1]] < n:
        key = rank * (n + 1)
        key[: n - h] += rank[h:]
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.concatenate([[1], np.diff(key[order]) != 0]))
        h *= 2
    return order


def lcp(words: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many of their first ``depth`` words each suffix shares with the one before it in order."""
    n, out = len(words), np.zeros(len(words), np.int64)
    same = np.ones(max(n - 1, 0), bool)
    for d in range(depth):
        a, b = order[:-1] + d, order[1:] + d
        inside = (a < n) & (b < n)
        same &= inside
        same[same] = words[a[same]] == words[b[same]]
        out[1:] += same
    return out


def intervals(words: np.ndarray, order: np.ndarray, shared: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A start and the count of every distinct run of k words without a break: the intervals whose suffixes share k words.

    Words are numbered from 1, 0 is a break.
    """
    first = np.flatnonzero(shared < k)
    count = np.diff(np.append(first, len(order)))
    start = order[first]
    whole = start + k <= len(words)
    start, count = start[whole], count[whole]
    for d in range(k):
        kept = words[start + d] > 0
        start, count = start[kept], count[kept]
    return start, count


def found(words: np.ndarray, grams: list[np.ndarray]) -> np.ndarray:
    """Whether one of the n-grams, given as one column of words a place, starts at each place of words."""
    k, top = len(grams), int(max(words.max(initial=0), *(g.max(initial=0) for g in grams))) + 1
    at = np.arange(max(len(words) - k + 1, 0))
    code, own = words[at], grams[0]
    for d in range(1, k):
        known, own = np.unique(own * top + grams[d], return_inverse=True)
        key = code * top + words[at + d]
        place = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
        hit = known[place] == key if len(known) else np.zeros(len(key), bool)
        at, code = at[hit], place[hit]
    if k == 1:
        at = at[np.isin(code, own)]
    out = np.zeros(len(words), bool)
    out[at] = True
    return out
