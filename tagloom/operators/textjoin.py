"""Pairs of similar texts within blocks: a prefix-filtered join of character n-gram TF-IDF vectors.

Weights are a block's own: count times ln((1 + n) / (1 + df)) + 1 over n rows, unit length. No
task holds a block. Texts are cut into grams once, in shards of bounded size that number their
grams; document frequencies are summed up by (block, gram) and come back to the shards. Each
vector's grams are put in one order, rarest first; what a text may share with another at the
threshold or more must include one of its first grams, up to where the rest is shorter than the
threshold. Only these prefixes are joined. What pairs share there bounds their cosine; the
pairs that can still reach the threshold are compared whole, in tiles of connected candidates,
so each vector travels once a tile and not once a pair.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.lineage import saved, ship

#: Bits of a gram's number in its shard, and of a shard's in its task; (text, gram) entries of a shard; vectors of a tile's side.
GRAM_BITS, SHARD_BITS = 23, 15
ENTRIES, TILE = 4_000_000, 256
#: Cosines are sums of rounded products, and what prefixes carry is single precision; bounds allow for that.
SLACK = 2e-6
SHARDS = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("local", pa.int32()), ("gram", pa.string()), ("df", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("places", pa.binary()), ("counts", pa.binary())])
SHARDS_SQL = "shard long, block long, local int, gram string, df long, rep long, n long, places binary, counts binary"
PREFIX = {"rep": pa.int64(), "gram": pa.int64(), "w": pa.float32(), "cum": pa.float32(), "rest": pa.float32()}
VECTORS = {"rep": pa.int64(), "grams": pa.binary(), "ws": pa.binary()}
SQL = {pa.int64(): "long", pa.float32(): "float", pa.float64(): "double", pa.binary(): "binary"}


def sql_of(columns: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{c} {SQL[t]}" for c, t in columns.items())


def squeezed(numbers: np.ndarray) -> bytes:
    """Whole numbers by their steps, compressed."""
    return zlib.compress(np.diff(numbers, prepend=numbers.dtype.type(0)).tobytes(), 1)


def unsqueezed(data: pa.BinaryScalar) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data.as_buffer()), np.int32))


class Shard:
    """Texts under way: characters numbered as they appear, grams as numbers of ``bits`` a character, in numpy throughout."""

    def __init__(self, low: int, high: int):
        self.low, self.high, self.bits = low, high, 63 // high
        self.number, self.chars = np.zeros(0x110000, np.int64), [np.zeros(1, np.uint32)]
        self.known, self.texts, self.size = 1, [], 0

    def room(self) -> bool:
        """Whether characters can still be numbered whatever comes in a text of half as many."""
        return self.known < 1 << self.bits - 1

    def add(self, block: int, n: int, rep: int, m: int, text: str) -> None:
        points = np.frombuffer(text.replace("\0", "\ufffd").encode("utf-32-le", "surrogatepass"), np.uint32)
        new = np.unique(points[self.number[points] == 0])
        self.number[new] = np.arange(self.known, self.known + len(new))
        self.chars.append(new)
        self.known += len(new)
        own = self.number[points]
        codes = []
        for k in range(self.low, min(self.high, len(own)) + 1):
            code = np.zeros(len(own) - k + 1, np.int64)
            for j in range(self.high):
                code = code << self.bits | (own[j : j + len(code)] if j < k else 0)
            codes.append(code)
        grams, counts = np.unique(np.concatenate(codes), return_counts=True)
        self.texts.append((block, n, rep, m, grams, counts.astype(np.int32)))
        self.size += len(grams)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The distinct grams with the rows of the block that have them, then the texts."""
        size = [len(t[4]) for t in self.texts]
        codes, block = np.concatenate([t[4] for t in self.texts]), np.repeat([t[0] for t in self.texts], size)
        order = np.lexsort((codes, block))
        first = np.flatnonzero(np.append(True, (np.diff(codes[order]) != 0) | (np.diff(block[order]) != 0)))
        local = np.empty(len(codes), np.int32)
        local[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(codes)))).astype(np.int32)
        df = np.add.reduceat(np.repeat([t[3] for t in self.texts], size)[order], first)
        codes, block, char = codes[order[first]], block[order[first]], np.concatenate(self.chars)
        for at in range(0, len(first), 50_000):
            part = codes[at : at + 50_000]
            points = np.stack([char[part >> self.bits * (self.high - 1 - j) & (1 << self.bits) - 1] for j in range(self.high)], axis=1)
            names = np.ascontiguousarray(points.astype("<u4")).view(f"<U{self.high}")[:, 0].tolist()
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(block[at : at + n]), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(names, pa.string()), pa.array(df[at : at + n]), *[pa.nulls(n, f.type) for f in list(SHARDS)[5:]]], schema=SHARDS)
        ends = np.cumsum(size)
        for at in range(0, len(self.texts), 500):
            part = self.texts[at : at + 500]
            n, places = len(part), [squeezed(local[e - len(t[4]) : e]) for t, e in zip(part, ends[at : at + 500])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array([t[0] for t in part], pa.int64()), pa.array([int(local[e - 1]) for e in ends[at : at + 500]], pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array([t[2] for t in part], pa.int64()), pa.array([t[1] for t in part], pa.int64()), pa.array(places, pa.binary()), pa.array([squeezed(t[5]) for t in part], pa.binary())], schema=SHARDS)


def sharded(batches: Iterator[pa.RecordBatch], low: int, high: int, most: int) -> Iterator[pa.RecordBatch]:
    """Shards of texts: batches have block, n (rows of the block), rep, m (rows that share the text) and text."""
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    turn, own = count(), Shard(low, high)
    for batch in batches:
        for block, n, rep, m, text in zip(*[c.to_pylist() for c in batch.columns]):
            own.add(block, n, rep, m, text)
            if own.size >= most or not own.room():
                yield from own.rows(task << SHARD_BITS | next(turn))
                own = Shard(low, high)
    if own.texts:
        yield from own.rows(task << SHARD_BITS | next(turn))


def weights(texts: pa.Table, shared: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """rep, gram ids (-1 for a gram that no other text has), document frequencies and weights of a shard's texts; shared has local, id, df."""
    if not texts.num_rows:
        return
    local, ids, dfs = (shared[c].to_numpy() for c in ("local", "id", "df")) if shared.num_rows else [np.zeros(0, np.int64)] * 3
    size = int(max(texts["most"].to_numpy().max(), local.max(initial=0))) + 1
    gram, df = np.full(size, -1, np.int64), np.ones(size, np.int64)
    gram[local], df[local] = ids, dfs
    for rep, n, at, tf in zip(texts["rep"].to_pylist(), texts["n"].to_pylist(), texts["places"], texts["counts"]):
        places = unsqueezed(at)
        w = unsqueezed(tf) * (np.log((1 + n) / (1 + df[places])) + 1)
        yield rep, gram[places], df[places], w / np.sqrt(w @ w)


def prefixes(threshold: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The rarest grams of each text, up to where the rest is shorter than the threshold: gram, w, cum (the length squared so far), rest (of what follows)."""

    def run(texts: pa.Table, shared: pa.Table) -> pa.Table:
        out = {c: [np.zeros(0, t.to_pandas_dtype())] for c, t in PREFIX.items()}
        for rep, gram, df, w in weights(texts, shared):
            order = np.lexsort((gram, df))
            cum = np.cumsum(w[order] ** 2)
            end = min(int(np.searchsorted(cum, 1 - (threshold - SLACK) ** 2, side="right")) + 1, len(w))
            kept = np.flatnonzero(gram[order[:end]] >= 0)
            for c, values in (("rep", np.full(len(kept), rep)), ("gram", gram[order[kept]]), ("w", w[order[kept]]), ("cum", cum[kept]), ("rest", np.full(len(kept), np.sqrt(max(0.0, 1 - cum[end - 1]))))):
                out[c].append(values)
        return pa.table({c: pa.array(np.concatenate(v), PREFIX[c], safe=False) for c, v in out.items()})

    return run


def vectors(texts: pa.Table, shared: pa.Table) -> pa.Table:
    """Whole vectors, without the grams that no other text has."""
    out: dict[str, list] = {c: [] for c in VECTORS}
    for rep, gram, _, w in weights(texts, shared):
        some = np.flatnonzero(gram >= 0)
        some = some[np.argsort(gram[some])]
        for c, value in (("rep", rep), ("grams", gram[some].tobytes()), ("ws", w[some].tobytes())):
            out[c].append(value)
    return pa.table({c: pa.array(v, VECTORS[c]) for c, v in out.items()})


def compared(threshold: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """a, b, similarity of a tile's candidates at the threshold or more, from its vectors."""

    def run(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        out = []
        if pairs.num_rows and vectors.num_rows:
            known = {r: (np.frombuffer(g.as_buffer(), np.int64), np.frombuffer(w.as_buffer(), np.float64)) for r, g, w in zip(vectors["rep"].to_pylist(), vectors["grams"], vectors["ws"])}
            for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
                (ga, wa), (gb, wb) = known[a], known[b]
                _, x, y = np.intersect1d(ga, gb, assume_unique=True, return_indices=True)
                dot = float(wa[x] @ wb[y])
                if dot >= threshold:
                    out.append((a, b, dot))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64()), "similarity": pa.array([x[2] for x in out], pa.float64())})

    return run


def similar_pairs(texts: DataFrame, threshold: float, low: int = 2, high: int = 4, entries: int = ENTRIES) -> DataFrame:
    """a, b, similarity of all pairs of texts of a block with a cosine of ``threshold`` (above 0) or more.

    texts has block and rep (whole numbers, rep unique), n (rows of the block, those without a
    row here too), m (rows that have this text) and text, in lower case, not null. Texts without a
    gram are similar to none.
    """
    ship(texts.sparkSession)
    own = texts.filter(F.length("text") >= low).select("block", "n", "rep", "m", "text")
    stored = saved(own.mapInArrow(lambda batches: sharded(batches, low, high, entries), SHARDS_SQL))
    code = F.shiftleft("shard", GRAM_BITS).bitwiseOR(F.col("local").cast("long"))
    same = Window.partitionBy("block", "gram")
    known = stored.filter("gram is not null").select("shard", "local", F.sum("df").over(same).alias("df"), F.min(code).over(same).alias("id")).filter("df > 1")
    known = saved(known)
    by_text = stored.filter("rep is not null").select("shard", "rep", "n", "places", "counts", F.col("local").alias("most"))
    prefix = saved(by_text.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(prefixes(threshold), sql_of(PREFIX)))
    left, right = (prefix.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "w", "cum", "rest")]) for s in "ab")
    met = left.join(right, "gram").filter("rep_a < rep_b").groupBy(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    bounds = met.agg(F.sum(F.col("w_a") * F.col("w_b")).alias("dot"), F.max("cum_a").alias("cum_a"), F.max("cum_b").alias("cum_b"), F.first("rest_a").alias("rest_a"), F.first("rest_b").alias("rest_b"))
    beyond = lambda c: F.sqrt(F.greatest(F.lit(0.0), 1 - F.col(c)))
    can = F.col("dot") + F.greatest(F.col("rest_a") * beyond("cum_b"), F.col("rest_b") * beyond("cum_a")) >= threshold - SLACK
    candidates = saved(bounds.filter(can).select("a", "b"))
    roots = components(candidates)
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    sized = roots.join(roots.groupBy("root").agg(F.count("*").alias("size")), "root").select("node", "root", tiles.alias("tiles"), F.pmod(F.xxhash64("node"), tiles.cast("long")).cast("int").alias("tile"))
    placed = saved(sized)
    end = lambda c: placed.select(F.col("node").alias(c), F.col("tile").alias(f"tile_{c}"), "root")
    pairs = candidates.join(end("a"), "a").join(end("b").drop("root"), "b").select("root", F.least("tile_a", "tile_b").alias("i"), F.greatest("tile_a", "tile_b").alias("j"), "a", "b")
    wanted = by_text.join(placed.select(F.col("node").alias("rep")), "rep", "left_semi").select(by_text.columns)
    found = wanted.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(vectors, sql_of(VECTORS)).withColumnRenamed("rep", "node").join(placed, "node")
    held = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(F.col("root").alias("of"), F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), F.col("node").alias("rep"), "grams", "ws")
    return pairs.groupBy("root", "i", "j").cogroup(held.groupBy("of", "x", "y")).applyInArrow(compared(threshold), "a long, b long, similarity double")
