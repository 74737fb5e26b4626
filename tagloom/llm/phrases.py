"""Phrase collocation mining: n-gram counts from word-id suffix arrays, merged by key, and cohesion scores.

Texts are cut into words once and stored as blocks of local word numbers, each with the words
behind the numbers. A block's suffix array (see suffixes) counts its distinct n-grams of k
words, and the counts of all blocks are merged by key. Only what can still reach the least
count is counted: words first, then pairs of frequent words, then triples of frequent pairs,
and so on; each block gets back which of its own n-grams are frequent, so no vocabulary or
list of n-grams goes to one task, the driver or a broadcast. Keys are word ids that stand for
exactly one word of a language, so counts are exact.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import suffixes
from .common import saved, ship

#: Upper-case ASCII to lower case, ends of pieces to a line end, tabs to blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256))
#: Bits of a word's number in its block, and of a block's number in its task.
WORD_BITS, BLOCK_BITS = 23, 15
#: Bytes that are cut into words at a time.
SLICE = 1 << 22
GAP = re.compile(rb"[ \n]")
BLOCKS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("local", pa.int32()), ("word", pa.binary()), ("n", pa.int64()), ("tokens", pa.binary()), ("context", pa.int32())])


class Block:
    """Words of a block under way: numbers from 1 in order of first appearance a language, 0 between pieces."""

    def __init__(self):
        self.numbers = count(1)
        self.words: dict[str, dict[bytes, int]] = {}
        self.parts, self.size, self.context = [], 0, 0

    def add(self, lang: str, data: bytes) -> np.ndarray:
        known = self.words.get(lang)
        if known is None:
            known = self.words[lang] = defaultdict(self.numbers.__next__, {b"\n": 0, b"": -1})
        cut = data.replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(known.__getitem__, cut), np.int32, len(cut))
        ids = ids[ids >= 0]
        self.parts.append(ids)
        self.size += len(ids)
        return ids

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The block's words with their counts, then its tokens."""
        tokens = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        n = np.bincount(tokens[self.context :], minlength=1)
        n = np.append(n, np.zeros(max(0, next(self.numbers) - len(n)), n.dtype))
        for lang, known in self.words.items():
            words = [w for w, i in known.items() if i > 0]
            own = np.fromiter((known[w] for w in words), np.int32, len(words))
            for at in range(0, len(words), 50_000):
                part = own[at : at + 50_000]
                size = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, shard)), pa.array([lang] * size, pa.string()), pa.array(part), pa.array(words[at : at + 50_000], pa.binary()), pa.array(n[part], pa.int64()), pa.nulls(size, pa.binary()), pa.nulls(size, pa.int32())], schema=BLOCKS)
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([tokens.astype(np.int32).tobytes()], pa.binary()), pa.array([self.context], pa.int32())], schema=BLOCKS)


def numbered(batches: Iterator[pa.RecordBatch], most: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Blocks of lang and text (bytes) of some ``most`` words.

    Where a block ends inside a piece, the next begins with its last words, ``longest`` less
    one at most, as context: they are there for n-grams across the cut and count nothing.
    """
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    block, turn = Block(), count()
    for batch in batches:
        by: dict[str, list[bytes]] = defaultdict(list)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                by[lang].append(text)
        for lang, texts in by.items():
            data, at = (b"\n".join(texts) + b"\n").translate(FOLD), 0
            while at < len(data):
                gap = GAP.search(data, at + SLICE)
                end = gap.start() if gap else len(data)
                ids = block.add(lang, data[at:end])
                at = end
                if block.size >= most:
                    full = block
                    yield from full.rows(task << BLOCK_BITS | next(turn))
                    block, tail = Block(), ids[len(ids) - longest + 1 :] if longest > 1 else ids[:0]
                    tail = tail[len(tail) - (tail[::-1] > 0).argmin() if (tail == 0).any() else 0 :]
                    if len(tail):
                        names = {i: w for w, i in full.words[lang].items()}
                        block.context = len(block.add(lang, b" ".join(names[i] for i in tail.tolist())))
    if block.size > block.context:
        yield from block.rows(task << BLOCK_BITS | next(turn))


def grams_of(tokens: pa.Table, marks: pa.Table, frequent: pa.Table | None, k: int) -> pa.Table:
    """shard, w1 ... wk, n: a block's n-grams of k frequent words, for k > 2 those of which both shorter ones are frequent.

    tokens is the block's one row, marks its frequent words, frequent its frequent n-grams of k - 1 words.
    """
    names = ["shard", *[f"w{i + 1}" for i in range(k)], "n"]
    empty = pa.table({c: pa.array([], pa.int64()) for c in names})
    if not tokens.num_rows or not marks.num_rows or frequent is not None and not frequent.num_rows:
        return empty
    local, ids = marks["local"].to_numpy(), marks["id"].to_numpy()
    order = np.argsort(ids)
    local, ids = local[order], ids[order]
    raw = np.frombuffer(tokens["tokens"][0].as_buffer(), np.int32)
    number = np.zeros(max(int(raw.max(initial=0)), int(local.max())) + 1, np.int64)
    number[local] = np.arange(1, len(ids) + 1)
    words = number[raw]
    twice = [words[i : i + k] for i in range(tokens["context"][0].as_py() - k + 1)]
    twice = [w for w in twice if w.all()]
    if frequent is not None:
        hit = suffixes.found(words, [np.searchsorted(ids, frequent[f"w{i + 1}"].to_numpy()) + 1 for i in range(k - 1)])
        start = np.flatnonzero(hit[:-1] & hit[1:])
        kept = np.zeros(len(words), bool)
        for d in range(k):
            kept[start + d] = True
        words = np.where(kept, words, 0)
        words = words[kept | np.append(True, kept[:-1])]
    order = suffixes.suffix_array(words, k)
    start, n = suffixes.intervals(words, order, suffixes.lcp(words, order, k), k)
    columns = [ids[words[start + d] - 1] for d in range(k)]
    if twice:
        columns = [np.append(c, ids[[w[d] - 1 for w in twice]]) for d, c in enumerate(columns)]
        n = np.append(n, np.full(len(twice), -1))
    shard = np.full(len(n), tokens["shard"][0].as_py(), np.int64)
    return pa.table(dict(zip(names, [shard, *columns, n.astype(np.int64)])))


def next_level(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """grams_of for a block and, in one table, its frequent words and its frequent n-grams of k - 1 words."""

    def run(tokens: pa.Table, both: pa.Table) -> pa.Table:
        if not both.num_rows:  # a side without rows comes without columns
            return grams_of(tokens, both, None, k)
        is_word = both["local"].is_valid()
        return grams_of(tokens, both.filter(is_word), both.filter(pc.invert(is_word)), k)

    return run


def frequent_words(words: DataFrame, least: int) -> DataFrame:
    """shard, local, id, f, lang, word of words met ``least`` times; id is the number of one of the word's places."""
    same = Window.partitionBy("lang", "word")
    code = F.shiftleft("shard", WORD_BITS).bitwiseOR(F.col("local").cast("long"))
    all_ = words.withColumns({"f": F.sum("n").over(same), "id": F.min(code).over(same)})
    return all_.filter(F.col("f") >= least).select("shard", "local", "id", "f", "lang", "word", (code == F.col("id")).alias("first"))


def frequent_grams(counted: DataFrame, keys: list[str], least: int) -> DataFrame:
    """shard, keys and f of n-grams met ``least`` times; first tells one row of each."""
    same = Window.partitionBy(*keys)
    all_ = counted.withColumns({"f": F.sum("n").over(same), "_one": F.min("shard").over(same)})
    return all_.filter(F.col("f") >= least).select("shard", *keys, "f", (F.col("shard") == F.col("_one")).alias("first"))


def frequencies(docs: DataFrame, least: int, longest: int, block: int = 2_000_000) -> tuple[DataFrame, list[DataFrame]]:
    """n of each lang, and for k = 1 ... longest the frequent n-grams: w1 ... wk, f; for k = 1 also lang and word."""
    ship(docs.sparkSession)
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    stored = saved(own.mapInArrow(lambda batches: numbered(batches, block, longest), "shard long, lang string, local int, word binary, n long, tokens binary, context int"))
    words = stored.filter("word is not null").select("shard", "lang", "local", "word", "n")
    blocks = stored.filter("tokens is not null").select("shard", "tokens", "context")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    marks = saved(frequent_words(words, least))
    out = [marks.filter("first").select(F.col("id").alias("w1"), "f", "lang", "word")]
    light = marks.select("shard", "local", "id")
    before = None
    for k in range(2, longest + 1):
        keys = [f"w{i + 1}" for i in range(k)]
        schema = "shard long, " + ", ".join(f"{c} long" for c in keys) + ", n long"
        if before is None:
            counted = blocks.groupBy("shard").cogroup(light.groupBy("shard")).applyInArrow(lambda left, right: grams_of(left, right, None, 2), schema)
        else:
            both = light.select("shard", "local", "id", *[F.lit(None).cast("long").alias(c) for c in keys[:-1]])
            both = both.union(before.select("shard", F.lit(None).cast("int"), F.lit(None).cast("long"), *keys[:-1]))
            counted = blocks.groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(next_level(k), schema)
        if k < longest:
            before = saved(frequent_grams(counted, keys, least))
            out.append(before.filter("first").select(*keys, "f"))
        else:
            out.append(saved(counted.groupBy(*keys).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)))
    return sizes, out


def cohesion(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)), in whole numbers of 38 digits."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", wide(F.lit(1_000_000)) * a * a, wide(l) * r)


def scored(grams: list[DataFrame], k: int) -> DataFrame:
    """w1 ... wk, a, score, l, r of the candidates of k words: their lowest-scoring cut, the first of equals."""
    keys = [f"w{i + 1}" for i in range(k)]
    out = grams[k - 1].select(*keys, F.col("f").alias("a"))
    for cut in range(1, k):
        first = grams[cut - 1].select(*keys[:cut], F.col("f").alias(f"l{cut}"))
        rest = grams[k - cut - 1].select(*[F.col(f"w{i + 1}").alias(keys[cut + i]) for i in range(k - cut)], F.col("f").alias(f"r{cut}"))
        out = out.join(first, keys[:cut]).join(rest, keys[cut:])
    cuts = [F.struct(cohesion(F.col("a"), F.col(f"l{c}"), F.col(f"r{c}")).alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in range(1, k)]
    return out.select(*keys, "a", (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("low")).select(*keys, "a", "low.score", "low.l", "low.r")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, longest: int = 3, covered: int = 50, block: int = 2_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``longest`` words.

    docs needs text and lang. A-Z are lower-cased; pieces end at . , ; : ! ? and line ends,
    words at blanks and tabs; a null text is empty, a null lang is ``und``. n counts the
    language's words, a the phrase's occurrences within pieces, overlaps included; phrases with
    ``least`` or more are candidates. l and r count the two parts of the cut whose
    floor(1000000 * a * a / (l * r)) is lowest. A candidate goes if one with a word more, in
    which it lies, has ``covered`` hundredths of its occurrences or more; any longer one in
    which it lies has no more than that. Order: score, then a, falling, then the phrase's
    bytes. Repeated rows count each time; an empty table, and one without phrases, gives no
    rows; doc_ids and other columns are ignored. Whole texts count, however long.
    """
    sizes, grams = frequencies(docs, least, longest, block)
    words = grams[0]
    found = None
    for k in range(2, longest + 1):
        keys = [f"w{i + 1}" for i in range(k)]
        own = scored(grams, k)
        if k < longest:
            longer = grams[k]
            inside = [longer.select(*[F.col(f"w{i + 1 + d}").alias(f"w{i + 1}") for i in range(k)], "f") for d in (0, 1)]
            most = inside[0].union(inside[1]).groupBy(*keys).agg(F.max("f").alias("longer"))
            own = own.join(most, keys, "left").filter(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
        for i, c in enumerate(keys):
            own = own.join(words.select(F.col("w1").alias(c), F.col("word").alias(f"word{i}"), *([F.col("lang")] if not i else [])), c)
        own = own.select("lang", F.concat_ws(" ", *[F.col(f"word{i}").cast("string") for i in range(k)]).alias("phrase"), "a", "l", "r", "score")
        found = own if found is None else found.union(own)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", F.col("score").cast("long"))
