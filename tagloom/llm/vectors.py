"""Embedding rows as packed blocks: what both vector searches share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of queries that meet a shard at a time.
TURN = 16


def valid(vectors: DataFrame, k: int, change: Callable[[Column], Column] | None = None, zeros: bool = True) -> DataFrame:
    """vec_id, v (array<double>), copy, times of vectors without null or non-finite components.

    Null vec_ids and empty vectors go, and with ``zeros`` False all-zero vectors. ``change`` is
    applied to each component. Rows that repeat both are counted before they are shuffled, and
    numbered by copy from 0 to ``k``: more of them cannot matter to k results. times is how
    many there are.
    """
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(v) > 0)
    if not zeros:
        sound &= F.exists(v, lambda x: x != 0)
    rows = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(sound)
    if change:
        rows = rows.select("vec_id", F.transform("v", change).alias("v"))
    counted = rows.groupBy("vec_id", "v").agg(F.count("*").alias("n"))
    return counted.select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.least(F.col("n") - 1, F.lit(k)).cast("int"))).alias("copy"), F.col("n").cast("int").alias("times"))


def once_each(queries: DataFrame) -> DataFrame:
    """Each distinct query once, with its times in place of its copy."""
    return queries.filter("copy = 0").select("vec_id", "v", F.col("times").alias("copy"))


def packed(rows: DataFrame, per_block: int, count: int, seed: int) -> DataFrame:
    """block, dim, ids, copies, data: rows (vec_id, v, copy) hashed into blocks of about ``per_block``, vectors as float64 bytes.

    A block is a bounded number of rows whatever the input; vectors of other lengths go to blocks of their own.
    """
    blocks = max(1, -(-count // per_block))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["vec_id", "copy"], kind="stable")
        v = np.stack(frame["v"].to_numpy()).astype("<f8")
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "dim": [v.shape[1]], "ids": [frame["vec_id"].to_numpy("<i8").tobytes()], "copies": [frame["copy"].to_numpy("<i4").tobytes()], "data": [v.tobytes()]})

    placed = rows.select(F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), F.size("v").alias("dim"), "vec_id", "v", "copy")
    return placed.groupBy("block", "dim").applyInPandas(run, "block int, dim int, ids binary, copies binary, data binary")


def unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, copies, vectors of a block."""
    ids = np.frombuffer(row.ids, "<i8")
    return ids, np.frombuffer(row.copies, "<i4"), np.frombuffer(row.data, "<f8").reshape(len(ids), -1)


def own_places(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, copies: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which row each query itself is, -1 if it is not among them: the first of those with its id and vector."""
    first = np.flatnonzero(copies == 0)
    first = first[np.argsort(x_ids[first], kind="stable")]
    low, high = (np.searchsorted(x_ids[first], q_ids, side) for side in ("left", "right"))
    out = np.full(len(q_ids), -1)
    for r in np.flatnonzero(high > low):
        same = [i for i in first[low[r] : high[r]] if (x[i] == q[r]).all()]
        out[r] = same[0] if same else -1
    return out


def met(shards: DataFrame, blocks: DataFrame, parts: int, turns: int, search: Callable, schema: str, which: Column | None = None) -> DataFrame:
    """search(shard, block) over every shard and block of queries of its dimension, or ``which`` of the pairs (columns block, q_block).

    A stated query set against all rows, in blocks: a task has one shard and at most some
    ``TURN`` blocks at a time, whatever the number of either.
    """
    left = shards.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    right = blocks.withColumnRenamed("block", "q_block").withColumn("turn", F.pmod(F.xxhash64("q_block"), F.lit(turns)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    if which is not None:
        right = right.filter(which)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = [search(s, b) for s in shard.itertuples() for b in asked.itertuples()]
        return pd.concat(found, ignore_index=True)[names] if found else pd.DataFrame(columns=names)

    keys = ["block", "dim", "turn"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def best(found: DataFrame, k: int, order: Column) -> DataFrame:
    """query_id, rank, vec_id, score: the first k of each query (q_key), ties to the smaller vec_id, as many times as its row occurs."""
    w = Window.partitionBy("q_key").orderBy(order, "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), "times"))).drop("col")


def merged(ids: np.ndarray, scores: np.ndarray, new_ids: np.ndarray, new_scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the k best (greatest score, then smallest id) of two sets of candidates a row; k as in the first."""
    k = ids.shape[1]
    all_ids, all_scores = np.concatenate([ids, new_ids], 1), np.concatenate([scores, new_scores], 1)
    order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
    return np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_scores, order, 1)
