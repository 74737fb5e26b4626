"""Exact top-k by inner product: ball-tree branch and bound in each shard.

Rows are hashed into shards of about 16,384, queries into blocks of about 1,024. A shard's
ball tree halves its rows at the median of their widest direction; a node has a centre c
and a radius r, and no row below it can score more than q.c + |q| r with a query q. A block
of queries walks the tree of a shard: nodes in falling order of that bound, and none whose
bound is below the query's kth score so far.

The kth score is shared: a first job lets each block search one shard, and the kth scores
found there come with the block as its floor when it meets all the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ship
from .vectors import TURN, best, merged, met, once_each, own_places, packed, unpack, valid

NONE = -np.iinfo(np.int64).max  # can be negated


class BallTree:
    """Nodes by level; rows are reordered so that each node's are together."""

    def __init__(self, x: np.ndarray, leaf: int = 128):
        self.order, self.levels = np.arange(len(x)), []
        bounds = [(0, len(x))]
        while True:
            centre = np.stack([x[self.order[a:b]].mean(0) for a, b in bounds])
            radius = np.array([np.sqrt(((x[self.order[a:b]] - c) ** 2).sum(1).max()) for (a, b), c in zip(bounds, centre)])
            self.levels.append((bounds, centre, radius))
            if max(b - a for a, b in bounds) <= leaf:
                break
            halves = []
            for a, b in bounds:
                own = x[self.order[a:b]]
                widest = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))] - own.mean(0)
                self.order[a:b] = self.order[a:b][np.argsort(own @ widest, kind="stable")]
                halves += [(a, (a + b) // 2), ((a + b) // 2, b)]
            bounds = halves


def search(q: np.ndarray, own: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, floor: np.ndarray, leaf: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids and scores of each query, ids -1 where there are fewer or none reaches the floor; own: the row that is the query itself, or -1.

    Vectors hold whole numbers. Products are exact in float64 below 2**53, and beyond that are
    taken in integers.
    """
    tree = BallTree(x, leaf)
    place = np.empty(len(x) + 1, np.int64)
    place[tree.order], place[-1] = np.arange(len(x)), -1
    x, x_ids, own = x[tree.order], x_ids[tree.order], place[own]
    small = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2**52
    if not small:
        q_exact, x_exact = q.astype(np.int64), x.astype(np.int64)
    length = np.sqrt((q * q).sum(1))
    may, bound = np.ones((len(q), 1), bool), None
    for bounds, centre, radius in tree.levels:  # down to the leaves: a child only below a node that may matter
        if bound is not None:
            may = np.repeat(may, 2, 1)
        bound = q @ centre.T + length[:, None] * radius
        bound += 1e-9 * np.abs(bound) + 1e-3
        may &= bound >= floor[:, None]
    leaves = tree.levels[-1][0]
    bound[~may] = -np.inf
    turn = np.argsort(-bound, axis=1, kind="stable")
    ids, scores = np.full((len(q), k), -1), np.full((len(q), k), NONE)
    kth = floor.astype(float)
    open_ = np.arange(len(q))
    for step in range(len(leaves)):
        at = turn[open_, step]
        go = bound[open_, at] >= kth[open_]
        open_, at = open_[go], at[go]  # bounds fall, so a query that stops here is done
        open_ = open_[bound[open_, at] > -np.inf]
        if not len(open_):
            break
        at = turn[open_, step]
        for node in np.unique(at):
            rows, (a, b) = open_[at == node], leaves[node]
            s = (q[rows] @ x[a:b].T).astype(np.int64) if small else q_exact[rows] @ x_exact[a:b].T
            s = np.where(np.arange(a, b) == own[rows, None], NONE, s)
            better = s.max(1) >= scores[rows, -1]
            rows, s = rows[better], s[better]
            near = np.broadcast_to(x_ids[a:b], s.shape)
            ids[rows], scores[rows] = merged(ids[rows], scores[rows], near, s)
        kth[open_] = np.maximum(kth[open_], np.where(scores[open_, -1] == NONE, -np.inf, scores[open_, -1].astype(float)))
    ids[scores == NONE] = -1
    return ids, scores


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: float = 256.0, per_shard: int = 16_384, per_block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of greatest inner product for each query.

    Both tables have vec_id and embedding; components become floor(scale * component) as
    double, and scores are exact. A query's own row is no candidate; other rows with its
    vec_id are, and are queries of their own (rows equal in both are searched once, and answered
    and candidates as often as they occur). Ties go to the smaller vec_id; with fewer candidates
    all are returned. Vectors that are null, empty or hold null or non-finite
    components take no part, nor do rows without vec_id. Vectors of other lengths only meet
    their like. Empty tables give no rows.
    """
    ship(vectors.sparkSession)
    whole = lambda df: valid(df, k, lambda x: F.floor(x * scale).cast("double"))
    rows, asked = cut(whole(vectors)), cut(once_each(whole(queries)))
    n, m = rows.count(), asked.count()
    shards, blocks = cut(packed(rows, per_shard, n, 1)), cut(packed(asked, per_block, m, 2))
    parts, turns = max(1, -(-n // per_shard)), max(1, -(-m // (per_block * TURN)))

    def found(blocks: DataFrame, which: Column) -> DataFrame:
        def run(shard, block) -> pd.DataFrame:
            (x_ids, copies, x), (q_ids, times, q) = unpack(shard), unpack(block)
            floor = np.frombuffer(block.floor, "<f8") if hasattr(block, "floor") else np.full(len(q), -np.inf)
            ids, scores = search(q, own_places(q_ids, q, x_ids, copies, x), x, x_ids, k, floor)
            keep = (scores != NONE).ravel()
            key = (int(block.q_block) << 32) + np.arange(len(q_ids))
            return pd.DataFrame({"query_id": np.repeat(q_ids, k)[keep], "q_key": np.repeat(key, k)[keep], "times": np.repeat(times, k)[keep], "vec_id": ids.ravel()[keep], "score": scores.ravel()[keep], "q_block": block.q_block, "dim": block.dim})

        return met(shards, blocks, parts, turns, run, "query_id long, q_key long, times int, vec_id long, score long, q_block int, dim int", which)

    columns = blocks.columns

    def floors(block: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame(columns=[*columns, "floor"])
        row = next(block.itertuples())
        lowest = first.groupby("q_key")["score"].agg(["size", "min"])
        key = (int(row.block) << 32) + np.arange(len(row.ids) // 8)
        kth = lowest[lowest["size"] >= k]["min"].reindex(key).fillna(-np.inf).to_numpy("<f8")
        return block[columns].assign(floor=[kth.tobytes()])

    home = F.pmod(F.col("q_block"), F.lit(parts)) == F.col("block")
    first = cut(found(blocks, home))
    # at most k rows a query of the block meet in a group
    tops = first.select(F.col("q_block").alias("block"), "dim", "q_key", "score")
    floored = blocks.groupBy("block", "dim").cogroup(tops.groupBy("block", "dim")).applyInPandas(floors, "block int, dim int, ids binary, copies binary, data binary, floor binary")
    others = found(cut(floored), ~home)
    return best(first.union(others).select("query_id", "q_key", "times", "vec_id", "score"), k, F.desc("score"))
