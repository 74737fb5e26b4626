"""Near-duplicates by exact Jaccard similarity of five-word shingles, retrieved by the SimHash index and MinHash bands.

The Gray-order index of SimHash fingerprints (see simhash) finds most copies: each text meets
one that it links to at 3 or fewer bits. But a pair of similarity 0.8 differs in some ten of 64
bits, far beyond what an index by parts can search, so bands of minima retrieve the rest: a
text's signature is 40 bands of 5. Two texts of similarity J share a band with chance J^5, so at
J = 0.8 they share 13 of 40 in the mean, and none with chance 1e-7, above it far less. What is
retrieved is a link only if the shingles, compared themselves, are similar enough; sets whose
sizes alone rule that out are not compared. First each
text meets its neighbours in the index and, of each of its buckets, the text that shares most
buckets, as a group's common origin does; what that connects is one group. The texts of buckets that
hold several groups then meet by their shingles, rarest first: of two sets that are similar enough the
smaller has a shared one among its first ninth, the larger among its first fifth. Variants that share bands
but not enough shingles have rarer ones of their own there, so they are no rows, however many they are. This
finds every link between those texts. Candidates are joined, not gathered: no bucket is one task's, and none is capped.
Texts are named by numbers in these joins, and only those that a step compares are shuffled: the rest stay where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.sieve import sieved
from . import simhash
from .common import cut, discarded, saved, ship

SHINGLE, BANDS, ROWS = 5, 40, 5
RNG = np.random.default_rng(29)
ODD = (RNG.integers(0, 1 << 31, (BANDS * ROWS, 1)).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
ADD = RNG.integers(0, 1 << 32, (BANDS * ROWS, 1)).astype(np.uint32)


def shingles(text: str | None, size: int = SHINGLE) -> set[bytes]:
    """Runs of ``size`` words, A-Z in lower case; a shorter text is one run, a wordless one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    k = min(size, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def jaccard(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def bands(own: set[bytes]) -> np.ndarray:
    """A 64-bit key of each band; shingles that are the same have the same keys."""
    from xxhash import xxh32_intdigest, xxh64_intdigest

    h = np.fromiter((xxh32_intdigest(s, 0) for s in own), np.uint32, len(own))
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 4096):
        x = h[None, at : at + 4096] * ODD + ADD
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        low = np.minimum(low, x.min(1))
    return np.array([xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def text_key(text: str | Column = "text") -> Column:
    """What rows of the same text share; null is empty."""
    return F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b of different roots that may be similar enough, each once: no other pair is. sets has key, root and shingles (distinct hashes).

    In one order of all shingles, those of one root first and then rarest first, the first that two
    sets share is at place i of the smaller set (n) and place j of the larger one (m); all they share
    comes no earlier, so what they must share, similarity / (1 + similarity) * (n + m) or more, is
    n - i and m - j at most.
    """
    rows = sets.select("key", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    common = rows.groupBy("shingle").agg(F.count("*").alias("df"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("shingle", "df")
    held = rows.join(common, "shingle")
    own = Window.partitionBy("key")
    # those that no set of another root has come before
    placed = held.withColumn("at", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "shingle")) - 1)
    least = lambda c, of: F.col("n") - F.col("at") >= c * F.col(of) - 1e-6
    first = saved(placed.filter(least(similarity, "n")).select("key", "root", "n", "at", "shingle"))
    short = first.filter(least(2 * similarity / (1 + similarity), "n")).toDF("a", "x", "n", "i", "shingle")
    long = first.toDF("b", "y", "m", "j", "shingle")
    must = similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-6
    smaller = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))
    met = short.join(long, "shingle").filter((F.col("x") != F.col("y")) & smaller & (F.col("n") - F.col("i") >= must) & (F.col("m") - F.col("j") >= must))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """key (of a text, as in ``text_key``), root: distinct texts that links of ``similarity`` or more connect share a root."""
    spark = ship(docs.sparkSession)
    texts = docs.select(text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))

    def signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = np.array([simhash.fingerprint(t, SHINGLE) for t in frame["text"]], np.uint64).view(np.int64)
            each = [(len(own), bands(own)) for own in map(shingles, frame["text"])]  # one text's shingles at a time
            yield pd.DataFrame({"key": frame["key"], "fp": fps, "size": [n for n, _ in each], "bands": [b for _, b in each]})

    own: list[str] = []
    prints = texts.mapInPandas(signed, "key string, fp long, size long, bands array<long>").groupBy("key").agg(*[F.first(c).alias(c) for c in ("fp", "size", "bands")])
    prints = saved(prints.withColumn("id", F.monotonically_increasing_id()), own)
    names = saved(prints.select("id", "key", "fp", "size"))
    rows = prints.select("id", "size", F.explode("bands").alias("band"))
    full = rows.groupBy("band").agg(F.count("*").alias("count")).filter("count > 1")
    rows = saved(rows.join(full, "band"))
    discarded(spark, own)
    fps = cut(names.groupBy("fp").agg(F.min(F.struct("id", "size")).alias("least")))
    same = names.join(fps, "fp").select(F.col("least.id").alias("a"), F.col("id").alias("b"), F.col("least.size").alias("m"), F.col("size").alias("n")).filter("a <> b")
    near = cut(simhash.links(fps.select("fp")).toDF("x", "y"))
    near = near.join(fps.toDF("x", "s"), "x").join(fps.toDF("y", "t"), "y").select(F.least("s.id", "t.id").alias("a"), F.greatest("s.id", "t.id").alias("b"), F.col("s.size").alias("m"), F.col("t.size").alias("n"))
    # a text that shares most buckets is the likeliest that others were changed from
    shared = rows.groupBy("id").agg(F.sum("count").alias("shared"))
    middle = rows.join(shared, "id").groupBy("band").agg(F.max(F.struct("shared", "id", "size")).alias("middle"))

    def with_text(wanted: DataFrame) -> DataFrame:
        """wanted (texts' ids among its columns) with key and text."""
        wanted = saved(wanted.join(names.select("id", "key"), "id"))
        # copies are one before the shuffle
        return sieved(texts, F.col("key"), wanted)[0].groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key")

    def checked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            near = np.array([jaccard(shingles(s), shingles(t)) >= similarity for s, t in zip(frame["s"], frame["t"])], bool)
            yield frame.loc[near, ["a", "b"]]

    # sets of which one is too much smaller cannot be similar enough, whatever they share
    may_be = F.least("m", "n") >= similarity * F.greatest("m", "n")

    def links(pairs: DataFrame) -> DataFrame:
        """Those of distinct pairs (a, b) that are similar enough."""
        own: list[str] = []
        pairs = saved(pairs, own)
        held = saved(with_text(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()).select("id", "text"), own)
        both = pairs.join(held.select(F.col("id").alias("a"), F.col("text").alias("s")), "a").join(held.select(F.col("id").alias("b"), F.col("text").alias("t")), "b")
        out = cut(both.mapInPandas(checked, "a long, b long"))
        discarded(spark, own)
        return out

    star = rows.join(middle, "band").select(F.col("middle.id").alias("a"), F.col("id").alias("b"), F.col("middle.size").alias("m"), F.col("size").alias("n")).filter("a <> b")
    found = links(star.union(same).union(near).filter(may_be).select("a", "b").distinct())
    first = components(found)
    rooted = rows.select("band", "id").join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band")
    apart = rooted.join(mixed, "band").select("id", "root").distinct()

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        for frame in frames:
            each = [np.unique(np.array([xxh64_intdigest(s) for s in shingles(t)], np.uint64)).view(np.int64) for t in frame["text"]]
            yield pd.DataFrame({"key": frame["id"], "root": frame["root"], "shingles": each})

    sets = saved(with_text(apart).select("id", "root", "text").mapInPandas(hashed, "key long, root long, shingles array<long>"), own := [])
    reached = components(found.union(links(prefix_pairs(sets, similarity))))
    discarded(spark, own)
    return names.select("id", "key").join(reached.withColumnRenamed("node", "id"), "id", "left").select("key", F.coalesce("root", "id").alias("root"))
