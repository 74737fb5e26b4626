"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking.

A table hashes a vector by ``hashes`` Gaussian projections, each shifted and cut into cells
of one width; a bucket is a combination of cells, held by a hash of them in a sorted array.
Rows are hashed into shards of about 16,384, and each shard is an index of ``tables`` such
tables over all of its rows.

A query looks up the bucket of its own cells and perturbed ones, in which some cells are
replaced by the next one up or down. The order of perturbations is drawn up once, from a heap
by the expected squared distances to the cells' borders, sorted from the nearest; a query
sorts its own borders and so gets its buckets in estimated order of success, without a look at
the rows. A neighbour at distance R moves a projection by a normal deviate of spread R, so
each bucket's chance is a product of normal masses; a query stops when the chances of a
table's buckets add up to ``mass``, or after ``probes`` of them. With ``tables`` tables the
expected recall is about 1 - (1 - mass) ** tables, whatever the number of rows; the number
of rows met falls with how far apart they lie for R. The union of what the tables give is
reranked by exact distance. No bucket has a limit; R, the width's unit, is fitted on a
bounded sample.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship
from .vectors import TURN, best, met, once_each, own_places, packed, unpack, valid

#: Queries whose buckets are looked up at a time.
STEP = 64


@dataclass(frozen=True)
class Settings:
    """reach: the distance R at which neighbours are expected; width: of a cell, in R."""

    reach: float
    tables: int = 12
    hashes: int = 10
    width: float = 1.7
    mass: float = 0.3
    probes: int = 400
    seed: int = 7


def reach_of(sample: np.ndarray, k: int, rows: int) -> float:
    """About the distance to the kth neighbour among ``rows`` rows: to that of the same share of a sample of them, the first at least."""
    if len(sample) < 2:
        return 1.0
    square = (sample**2).sum(1)
    d = square[:, None] + square - 2 * sample @ sample.T
    np.fill_diagonal(d, np.inf)
    at = min(max(round(k * len(sample) / max(rows, 1)), 1), len(sample) - 1) - 1
    return float(np.sqrt(np.maximum(np.partition(d, at, axis=1)[:, at], 0)).mean()) or 1.0


def normal(x: np.ndarray) -> np.ndarray:
    """The standard normal distribution function, by a rational form good to 1e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x) / math.sqrt(2))
    y = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-x * x / 2)
    return 0.5 * (1 + np.sign(x) * y)


def perturbations(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of borders to cross, by their places among a query's 2 * hashes borders sorted from the nearest; in order of expected cost.

    The places i and 2 * hashes - 1 - i are the two borders of one cell in expectation, and no
    set has both.
    """
    m, j = hashes, np.arange(1, 2 * hashes + 1)
    back = 2 * m + 1 - j
    cost = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - back / (m + 1) + back * (back + 1) / (4 * (m + 1) * (m + 2)))
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, own = heapq.heappop(heap)
        if not any(2 * m - 1 - i in own for i in own):
            out.append(own)
        last = own[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*own[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*own, last + 1)))
    return out


class Table:
    """One hash table over the rows x."""

    def __init__(self, x: np.ndarray, s: Settings, rng: np.random.Generator):
        self.s, self.a = s, rng.normal(size=(x.shape[1], s.hashes)) / (s.reach * s.width)
        self.b = rng.uniform(0, 1, s.hashes)
        self.odd = rng.integers(0, 1 << 62, s.hashes) * 2 + 1
        code = self.code(np.floor(x @ self.a + self.b))
        self.buckets, self.of = np.unique(code, return_inverse=True)

    def code(self, cells: np.ndarray) -> np.ndarray:
        return (cells.astype(np.int64) * self.odd).sum(1)

    def visited(self, q: np.ndarray, order: list[tuple[int, ...]]) -> np.ndarray:
        """Which buckets each query visits, as booleans."""
        m, at = self.s.hashes, q @ self.a + self.b
        cells = np.floor(at)
        low = at - cells
        border = np.concatenate([low, 1 - low], 1)  # to the next cell down, and up
        near = np.argsort(border, axis=1, kind="stable")
        spread = 1 / self.s.width  # of a neighbour's projection, in cells
        down, up = normal(-low / spread), 1 - normal((1 - low) / spread)
        stay = np.log(np.maximum(1 - down - up, 1e-12))
        beyond = [normal((-1 - low) / spread), 1 - normal((2 - low) / spread)]  # past the next cell
        cross = [np.log(np.maximum(p - far, 1e-12)) - stay for p, far in zip((down, up), beyond)]
        gain = np.take_along_axis(np.concatenate(cross, 1), near, 1)
        move = np.concatenate([-self.odd, self.odd])[near]
        chance = np.stack([gain[:, list(o)].sum(1) for o in order], 1) + stay.sum(1, keepdims=True)
        code = np.stack([move[:, list(o)].sum(1) for o in order], 1) + self.code(cells)[:, None]
        # the two borders of a cell may come together where a query differs from what is expected
        cell = near % m
        twice = np.stack([sum((cell[:, i] == cell[:, j] for a, i in enumerate(o) for j in o[:a]), np.zeros(len(q), bool)) > 0 for o in order], 1)
        mass = np.where(twice, 0, np.exp(chance))
        go = ~twice & (np.cumsum(mass, 1) - mass < self.s.mass)
        place = np.minimum(np.searchsorted(self.buckets, code), len(self.buckets) - 1)
        go &= self.buckets[place] == code
        out = np.zeros((len(q), len(self.buckets)), bool)
        row, probe = np.nonzero(go)
        out[row, place[row, probe]] = True
        return out


def candidates(q: np.ndarray, x: np.ndarray, s: Settings) -> np.ndarray:
    """Which rows each query meets in the buckets it visits, as booleans."""
    rng, order = np.random.default_rng(s.seed), perturbations(s.hashes, s.probes)
    tables = [Table(x, s, rng) for _ in range(s.tables)]
    out = np.zeros((len(q), len(x)), bool)
    for at in range(0, len(q), STEP):
        part = slice(at, at + STEP)
        for t in tables:
            out[part] |= t.visited(q[part], order)[:, t.of]
    return out


def search(q: np.ndarray, own: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """ids and distances of the nearest k candidates of each query; ties to the smaller id. A query that meets no k rows in its buckets meets all."""
    out = []
    for row, seen in enumerate(candidates(q, x, s)):
        if own[row] >= 0:
            seen[own[row]] = False
        if seen.sum() < k:
            seen[:] = True
            if own[row] >= 0:
                seen[own[row]] = False
        i = np.flatnonzero(seen)
        d = np.sqrt(((x[i] - q[row]) ** 2).sum(1))
        if len(d) > k:
            few = d <= np.partition(d, k - 1)[k - 1]
            i, d = i[few], d[few]
        first = np.lexsort((x_ids[i], d))[:k]
        out.append((x_ids[i[first]], d[first]))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int, per_shard: int = 16_384, per_block: int = 512, sample_rows: int = 2048, **settings) -> DataFrame:
    """query_id, rank, vec_id, score: about the k nearest rows to each query by Euclidean distance.

    Both tables have vec_id and embedding. Every row is indexed; at most ``sample_rows`` of
    them, those with the smallest hashes, fit the distance scale. Distances are exact, in
    double. A query's own row is no candidate; other rows with its vec_id are, and are queries
    of their own (rows equal in both are searched once, and answered and candidates as often as
    they occur). Ties go to the smaller vec_id. A query that met fewer than k rows
    in a shard's buckets meets all rows of the shard, so only a table with fewer rows gives
    fewer. Vectors that are null, empty, zero or hold null or non-finite components take no
    part, nor do rows without vec_id. Vectors of other lengths only meet their like. Empty
    tables give no rows.
    """
    ship(vectors.sparkSession)
    rows, asked = cut(valid(vectors, k, zeros=False)), cut(once_each(valid(queries, k, zeros=False)))
    n, m = rows.count(), asked.count()
    taken = rows.filter("copy = 0").orderBy(F.xxhash64(F.lit(3), "vec_id", "v")).limit(sample_rows).collect()
    size = len(taken[0]["v"]) if taken else 1
    s = Settings(reach_of(np.array([r["v"] for r in taken if len(r["v"]) == size]).reshape(-1, size), k, n), **settings)
    shards, blocks = packed(rows, per_shard, n, 1), cut(packed(asked, per_block, m, 2))
    parts, turns = max(1, -(-n // per_shard)), max(1, -(-m // (per_block * TURN)))

    def run(shard, block) -> pd.DataFrame:
        (x_ids, copies, x), (q_ids, times, q) = unpack(shard), unpack(block)
        found = search(q, own_places(q_ids, q, x_ids, copies, x), x, x_ids, k, s)
        sizes, key = [len(i) for i, _ in found], (int(block.q_block) << 32) + np.arange(len(q_ids))
        return pd.DataFrame({"query_id": np.repeat(q_ids, sizes), "q_key": np.repeat(key, sizes), "times": np.repeat(times, sizes), "vec_id": np.concatenate([i for i, _ in found]), "score": np.concatenate([d for _, d in found])})

    return best(met(shards, blocks, parts, turns, run, "query_id long, q_key long, times int, vec_id long, score double"), k, F.asc("score"))
