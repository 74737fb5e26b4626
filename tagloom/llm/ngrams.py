"""Byte n-grams: counts over texts, interpolated modified Kneser-Ney smoothing, scores of texts.

A text's symbols are the bytes of its words joined by single blanks, then an end symbol; all
256 byte values are symbols. Counts, continuation counts and the smoothing's joins are
sharded by n-gram. No n-gram that was counted is dropped. ``model`` brings them all to the
driver, for small texts; ``resolved`` has no size that it must stay under: what blocks of texts
ask for and what the model holds meet in shards by the two symbols before the last. All longer
contexts and suffixes of an n-gram have these too, so a shard needs nothing of the others,
and shorter n-grams are at most 65,536 pairs and 256 symbols, which all shards get.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, ship
from .lm import distinct, grown, shrunk, spread

#: A byte that no word holds: the end symbol, and what stands before a text.
END = 10
#: Symbols scored at a time.
CHUNK = 1 << 19
#: Symbols whose n-grams are counted at a time.
PART = 1_000_000
#: Longest context whose n-grams all shards get, and a multiplier that spreads pairs of symbols over shards.
SHORT, SPREAD = 1, 2654435761


def symbols(text: str, fold: bool = True) -> np.ndarray:
    """The bytes of the words joined by blanks, and the end; ``fold`` makes A-Z lower case."""
    data = text.encode("utf-8", "surrogatepass")
    return np.frombuffer(b" ".join((data.lower() if fold else data).split()) + b"\n", np.uint8)


def joined(texts: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row, order - 1 end symbols before each; where each text's own symbols begin."""
    pad = np.full(order - 1, END, np.uint8)
    sizes = np.array([len(t) + order - 1 for t in texts])
    return np.concatenate([x for t in texts for x in (pad, t)]), np.cumsum(sizes) - sizes + order - 1


def keys(flat: np.ndarray, a: int, b: int, order: int) -> np.ndarray:
    """The n-grams that end at places a to b, as integers with the last byte lowest; a is order - 1 or more."""
    key = np.zeros(b - a, np.int64)
    for k in range(order):
        key |= flat[a - k : b - k].astype(np.int64) << 8 * k
    return key


def grams(texts: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams that end at each symbol, and their counts."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat, starts = joined(texts, order)
    real = np.ones(len(flat), bool)
    real[(starts[:, None] - np.arange(1, order)).ravel()] = False
    return np.unique(keys(flat, order - 1, len(flat), order)[real[order - 1 :]], return_counts=True)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of n-grams that stand in several parts."""
    keys_, n = (np.concatenate(x) for x in zip(*parts))
    order, begins, each = distinct(keys_)
    return each, np.add.reduceat(n[order], begins) if len(n) else n


def counted(docs: DataFrame, order: int, fold: bool = True) -> DataFrame:
    """gram, n over all texts of docs (column text; null: empty), summed up in tasks first."""
    ship(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def out() -> pd.DataFrame:
            g, n = grams(held, order)
            return pd.DataFrame({"gram": g, "n": n})

        for frame in frames:
            for t in frame["text"]:
                held.append(symbols(t if isinstance(t, str) else "", fold))
                size += len(held[-1])
                if size > PART:
                    yield out()
                    held, size = [], 0
        yield out()

    return docs.select("text").mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """By length of the context: sorted n-grams with their log10 probabilities, sorted contexts with the log10 weight of what they leave to the next shorter one."""

    order: int
    fold: bool
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    fails: list[np.ndarray]

    @classmethod
    def of(cls, order: int, fold: bool, kinds: np.ndarray, known: np.ndarray, values: np.ndarray) -> "Model":
        """From rows of n-grams (kind 2 k for contexts of k symbols) and contexts (2 k + 1)."""
        by = np.lexsort((known, kinds))
        ends = np.searchsorted(kinds[by], np.arange(2 * order + 1))
        parts = [(known[by[a:b]], values[by[a:b]]) for a, b in zip(ends, ends[1:])]
        return cls(order, fold, *([x[i] for x in parts[kind::2]] for kind in (0, 1) for i in (0, 1)))

    def resolve(self, wanted: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each n-gram."""
        out, open_ = np.zeros(len(wanted)), np.arange(len(wanted))
        for k in range(self.order - 1, -1, -1):
            g = wanted[open_] & ((1 << 8 * (k + 1)) - 1)
            at, hit = place(self.grams[k], g)
            out[open_[hit]] += self.logs[k][at[hit]]
            open_, g = open_[~hit], g[~hit] >> 8
            at, known = place(self.contexts[k], g)
            out[open_[known]] += self.fails[k][at[known]]
        out[open_] -= np.log10(256)
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and number of symbols of each text; a chunk's distinct n-grams are looked up once."""
        if not texts:
            return np.zeros(0), np.zeros(0, np.int64)
        flat, starts = joined([symbols(t, self.fold) for t in texts], self.order)
        ends = np.r_[starts[1:] - (self.order - 1), len(flat)]
        total = np.zeros(len(texts))
        for a in range(self.order - 1, len(flat), CHUNK):
            b = min(a + CHUNK, len(flat))
            order, begins, each = distinct(keys(flat, a, b, self.order))
            sums = np.r_[0, np.cumsum(spread(order, begins, self.resolve(each)))]
            total += sums[np.clip(ends, a, b) - a] - sums[np.clip(starts, a, b) - a]
        return total, ends - starts


def place(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of wanted would be in the sorted array known, and whether it is there."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def smoothed(counts: DataFrame, order: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """By length of the context from 0: gram, p and context, fail, from counts (gram, n).

    The highest order has counts as they are, each lower one the number of distinct symbols
    before it. Discounts come from the numbers of n-grams seen once to four times. Context
    totals are joined to n-grams, and so are the chances of the next lower order.
    """
    levels = [counts.select("gram", F.col("n").alias("c"))]
    for k in range(order - 2, -1, -1):
        levels.append(saved(levels[-1].groupBy(F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram")).agg(F.count("*").alias("c"))))
    lower = None
    for k, level in enumerate(levels[::-1]):
        seen = dict(level.filter("c <= 4").groupBy("c").count().collect())
        n1, n2, n3, n4 = (seen.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        d = [min(max(i - (i + 1) * y * b / a, 0.1), i - 0.1) if a else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        taken = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        level = level.select("gram", F.shiftright("gram", 8).alias("context"), "c", taken.alias("d"))
        contexts = level.groupBy("context").agg(F.sum("c").alias("tot"), F.sum("d").alias("taken")).select("context", "tot", (F.col("taken") / F.col("tot")).alias("fail"))
        own = level.join(contexts, "context").withColumn("low", F.col("gram").bitwiseAND((1 << 8 * k) - 1))
        own = own.withColumn("q", F.lit(1 / 256)) if lower is None else own.join(lower.toDF("low", "q"), "low")
        lower = saved(own.select("gram", ((F.col("c") - F.col("d")) / F.col("tot") + F.col("fail") * F.col("q")).alias("p")))
        yield lower, contexts.select("context", "fail")


def model(counts: DataFrame, order: int, fold: bool = True) -> Model:
    """Interpolated modified Kneser-Ney from counts (gram, n): every n-gram counted, brought to the driver once."""
    out = Model(order, fold, [], [], [], [])
    for arcs, contexts in smoothed(counts, order):
        for df, value, names, values in ((arcs, "p", out.grams, out.logs), (contexts, "fail", out.contexts, out.fails)):
            key = df.columns[0]
            held = df.select(key, F.log10(value).cast("float").alias(value)).toArrow()
            own = held.column(key).to_numpy()
            by = np.argsort(own)
            names.append(own[by])
            values.append(held.column(value).to_numpy()[by])
    return out


def shard_of(pair: np.ndarray | F.Column, shards: int) -> np.ndarray | F.Column:
    """The shard of the two symbols before the last, a number up to 65,535."""
    return (pair * SPREAD % (1 << 32) / (1 << 16)).cast("long") % shards if isinstance(pair, F.Column) else pair * SPREAD % (1 << 32) // (1 << 16) % shards


def packed(block: int, each: np.ndarray, shards: int, n: np.ndarray | None = None) -> pd.DataFrame:
    """A block's sorted distinct n-grams, and their counts, a row a shard."""
    order, ends = by_shard(each, shards)
    some = np.flatnonzero(np.diff(ends))
    parts = [order[ends[s] : ends[s + 1]] for s in some]
    out = {"shard": some, "block": block, "keys": [shrunk(np.diff(each[x], prepend=0)) for x in parts]}
    return pd.DataFrame(out if n is None else out | {"n": [shrunk(n[x]) for x in parts]})


def by_shard(each: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts n-grams by shard, and where in it each shard ends."""
    own = shard_of(each >> 8 & 0xFFFF, shards)
    order = np.argsort(own, kind="stable")
    return order, np.searchsorted(own[order], np.arange(shards + 1))


def unpacked(keys: pd.Series) -> list[np.ndarray]:
    return [np.cumsum(grown(k).astype(np.int64)) for k in keys]


def learned(texts: Iterable[str], order: int, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a block's texts, and their counts."""
    held, size, parts = [], 0, []
    for t in texts:
        held.append(symbols(t, fold))
        size += len(held[-1])
        if size > PART:
            parts.append(grams(held, order))
            held, size = [], 0
    return summed([*parts, grams(held, order)])


def totals(packs: DataFrame) -> DataFrame:
    """gram, n from what blocks sent to the shards (``packed`` with counts)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("gram", "n"), summed([(k, grown(n).astype(np.int64)) for k, n in zip(unpacked(frame["keys"]), frame["n"])]))))

    return packs.groupBy("shard").applyInPandas(run, "gram long, n long")


@dataclass
class Asked:
    """What a block of texts asks for: sorted distinct n-grams, and how its places go back to them."""

    starts: np.ndarray
    ends: np.ndarray
    size: int
    chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    each: np.ndarray
    order: int

    @classmethod
    def of(cls, texts: Iterable[str], order: int, fold: bool) -> "Asked":
        flat, starts = joined([symbols(t, fold) for t in texts], order)
        ends, chunks = np.r_[starts[1:] - (order - 1), len(flat)], []
        for a in range(order - 1, len(flat), CHUNK):
            by, begins, each = distinct(keys(flat, a, min(a + CHUNK, len(flat)), order))
            chunks.append((by.astype(np.int32), begins.astype(np.int32), each))
        return cls(starts, ends, len(flat), chunks, np.unique(np.concatenate([c[2] for c in chunks])), order)

    def totals(self, values: np.ndarray) -> np.ndarray:
        """Sums over each text of values of the distinct n-grams."""
        out = np.zeros(len(self.starts))
        for a, (by, begins, each) in zip(range(self.order - 1, self.size, CHUNK), self.chunks):
            sums = np.r_[0, np.cumsum(spread(by, begins, values[np.searchsorted(self.each, each)]))]
            b = a + len(by)
            out += sums[np.clip(self.ends, a, b) - a] - sums[np.clip(self.starts, a, b) - a]
        return out


def resolved(asked: DataFrame, counts: DataFrame, order: int, shards: int) -> DataFrame:
    """block, shard, values: log10 probabilities (single precision, packed) of what blocks ask for (``packed``), in that order, from counts (gram, n)."""
    short, held = [], None
    for k, (arcs, contexts) in enumerate(smoothed(counts, order)):
        for kind, df, key, value in ((2 * k, arcs, "gram", "p"), (2 * k + 1, contexts, "context", "fail")):
            pair = (F.shiftright(key, 8) if key == "gram" else F.col(key)).bitwiseAND(0xFFFF)
            rows = df.select(shard_of(pair, shards).alias("shard"), F.lit(kind).alias("kind"), F.col(key).alias("known"), F.log10(value).cast("float").alias("value"))
            if k <= SHORT:
                short.append(rows.drop("shard").toPandas())  # at most 65,536 pairs of symbols
            else:
                held = rows if held is None else held.union(rows)
    few = pd.concat(short)
    if held is None:
        held = asked.sparkSession.createDataFrame([], "shard long, kind int, known long, value float")

    def answer(frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({"block": [], "shard": [], "values": []})
        rows = pd.concat([few, known[few.columns]])
        own = Model.of(order, False, *(rows[c].to_numpy() for c in ("kind", "known", "value")))
        wanted = unpacked(frame["keys"])
        by, begins, each = distinct(np.concatenate(wanted))
        parts = np.split(spread(by, begins, own.resolve(each).astype(np.float32)), np.cumsum([len(w) for w in wanted])[:-1])
        return pd.DataFrame({"block": frame["block"], "shard": frame["shard"], "values": [shrunk(p.view(np.uint32)) for p in parts]})

    return asked.groupBy("shard").cogroup(held.groupBy("shard")).applyInPandas(answer, "block long, shard long, values binary")
