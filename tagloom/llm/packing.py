"""Sequence packing: non-negative least squares over shallow length combinations.

Documents are tokenised once and packed in the same pass, so no token is shuffled.
Each partition works through blocks of about ``block_tokens`` tokens:

1. Whole windows of a long document become sequences of their own.
2. The remainders' length histogram h is met by combinations of two or three lengths
   that add up to the window. Repeat counts x >= 0 minimise |A x - h|^2 (accelerated
   projected gradient, A: combinations by length).
3. Counts are rounded up, largest first, as far as the histogram still has the pieces.
4. Residuals are packed greedily: the longest that fits, and where nothing fits the
   shortest is cut. What does not fill a window is carried to the next block.

At the end of a partition the carried rest is cut into sequences of power-of-two size,
so no sequence needs padding. A partition's work depends on nothing outside it: a lost
executor costs only its own partitions, and memory is bounded by one block.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import ship, whole_ids
from .tokens import Encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def combinations(lengths: np.ndarray, window: int, shortest: int = 48) -> np.ndarray:
    """Rows of three lengths (0: none) that fill the window, from the lengths that occur.

    All pairs; triples whose smallest part is one of ``shortest`` lengths spread evenly
    over those up to a third of the window.
    """
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    a = lengths[lengths <= window // 2]
    a = a[there[window - a]]
    rows = [np.stack([a, window - a, np.zeros_like(a)], 1)]
    small = lengths[lengths <= window // 3]
    if len(small) > shortest:
        small = small[np.linspace(0, len(small) - 1, shortest).astype(int)]
    for s in small:
        b = lengths[(lengths >= s) & (lengths <= (window - s) // 2)]
        b = b[there[window - s - b]]
        rows.append(np.stack([np.full_like(b, s), b, window - s - b], 1))
    return np.concatenate(rows)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = 80) -> np.ndarray:
    """x >= 0 that minimises |A x - h|^2 by accelerated projected gradient."""
    n, size = len(combos), len(histogram)
    if not n:
        return np.zeros(0)
    part = (combos > 0).astype(float)
    flat, weight = combos.ravel(), part.ravel()

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, weight * np.repeat(x, 3), size)

    def back(r: np.ndarray) -> np.ndarray:
        return (r[combos] * part).sum(1)

    v = np.ones(n)
    for _ in range(8):  # the largest eigenvalue of A'A, by the power method
        v = back(forward(v))
        top = np.linalg.norm(v)
        v /= top
    step = 1 / (1.05 * top)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y) - histogram))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


class Packer:
    """Packs pieces (document, start, length) of one partition; ``out`` gets finished sequences."""

    def __init__(self, window: int):
        self.window, self.carried, self.out = window, [], []

    def block(self, docs: list[tuple[int, int]]) -> None:
        """docs: (key, tokens) of the documents of a block; a document has one token at least."""
        w, by_length = self.window, {}
        for key, n in docs:
            full = n // w * w
            self.out.extend([(key, s, w)] for s in range(0, full, w))
            if n > full:
                by_length.setdefault(n - full, []).append((key, full, n - full))
        histogram = np.zeros(w + 1)
        for length, pieces in by_length.items():
            histogram[length] = len(pieces)
        combos = combinations(np.array(sorted(by_length), dtype=np.int64), w) if by_length else np.zeros((0, 3), np.int64)
        x = repeat_counts(combos, histogram)
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 0.02:
                break
            parts = [int(v) for v in combos[i] if v]
            for _ in range(int(np.ceil(x[i]))):
                taken = []
                for v in parts:
                    if not by_length[v]:
                        break
                    taken.append(by_length[v].pop())
                if len(taken) < len(parts):
                    for p in taken:
                        by_length[p[2]].append(p)
                    break
                self.out.append(taken)
        self.greedy([p for pieces in by_length.values() for p in pieces])

    def greedy(self, pieces: list[tuple[int, int, int]]) -> None:
        """Fill windows from the carried rest and the pieces; an unfilled window is carried."""
        pool = sorted(pieces, key=lambda p: p[2])
        opened, space = self.carried, self.window - sum(p[2] for p in self.carried)
        while pool:
            at = bisect_right(pool, space, key=lambda p: p[2])
            if at:
                piece = pool.pop(at - 1)
            else:
                key, start, length = pool.pop(0)
                piece = (key, start, space)
                insort(pool, (key, start + space, length - space), key=lambda p: p[2])
            opened.append(piece)
            space -= piece[2]
            if not space:
                self.out.append(opened)
                opened, space = [], self.window
        self.carried = opened

    def close(self) -> None:
        """Cut the carried rest into sequences of power-of-two size, the largest first."""
        rest = sum(p[2] for p in self.carried)
        pieces = self.carried[::-1]
        for bit in range(rest.bit_length() - 1, -1, -1):
            space, sequence = rest & (1 << bit), []
            while space:
                key, start, length = pieces.pop()
                if length > space:
                    pieces.append((key, start + space, length - space))
                    length = space
                sequence.append((key, start, length))
                space -= length
            if sequence:
                self.out.append(sequence)
        self.carried = []


def packed(docs: Iterable[tuple[object, np.ndarray]], window: int, block_tokens: int, first: int) -> Iterator[pd.DataFrame]:
    """docs: (doc_id, uint32 ids); sequences are numbered from ``first``."""
    packer, held, batch, n, key, number = Packer(window), {}, [], 0, 0, first

    def emit() -> Iterator[pd.DataFrame]:
        nonlocal number
        rows = []
        for sequence in packer.out:
            offset = 0
            for k, start, length in sequence:
                doc_id, ids = held[k]
                rows.append((doc_id, start, length, len(ids), number, offset, ids[start : start + length].tobytes()))
                offset += length
            number += 1
        packer.out = []
        keep = {k for k, _, _ in packer.carried}
        for k in [k for k in held if k not in keep]:
            del held[k]
        if rows:
            frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            frame["doc_id"] = pd.array([r[0] for r in rows], "Int64")
            for at in range(0, len(frame), 512):
                yield frame.iloc[at : at + 512]

    for doc_id, ids in docs:
        held[key] = (doc_id, ids)
        batch.append((key, len(ids)))
        key += 1
        n += len(ids) + 16  # an empty document has its costs too
        if n >= block_tokens:
            packer.block(batch)
            batch, n = [], 0
            yield from emit()
    packer.block(batch)
    packer.close()
    yield from emit()


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, block_tokens: int = 1 << 19) -> DataFrame:
    """Pack documents into sequences of at most ``window`` tokens without padding.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names. A null
    text is empty: the document is its end token alone. Null and repeated doc_ids are packed
    like others, row by row; an empty table gives no rows. Each piece comes with its ids as
    little-endian unsigned 32-bit values. ``vocabulary`` is the tokenizer file's path on the
    workers. Rows of one sequence share sequence_id; their offsets join without gaps.
    """
    ship(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.of(vocabulary)

        def documents() -> Iterator[tuple[object, np.ndarray]]:
            for frame in frames:
                texts = [t if isinstance(t, str) else "" for t in frame["text"]]
                for doc_id, none, ids in zip(frame["doc_id"], frame["none"], encoder.encode(texts, end_id)):
                    yield (None if none else int(doc_id)), ids

        yield from packed(documents(), window, block_tokens, TaskContext.get().partitionId() << 40)

    return whole_ids(docs).mapInPandas(run, SCHEMA)
