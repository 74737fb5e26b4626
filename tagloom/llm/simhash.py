"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

Two fingerprints that differ in at most ``bits`` = 3 bits agree in one of four parts. Top
nodes of the index are therefore the (part, value) pairs: each fingerprint enters four of
them, and no link can lie outside. A top node with over ``largest`` fingerprints is split
the same way on the bits that it leaves open, again and again; as fingerprints are distinct
and the open bits shrink by a quarter each time, every node ends small, so no group is
ever gathered whole and nothing is capped.

Within a top node fingerprints come sorted by Gray rank, where neighbours share most bits.
Runs of them form leaves, runs of leaves form upper nodes; a node keeps the bit pattern all
below it share, less what its parent has. A search adds up differences from the top down
and leaves a whole group as soon as they exceed ``bits``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, whole_ids
from ..plans.components import components

ALL = (1 << 64) - 1
#: Entries of the index that a task searches at once, in the mean.
LOT = 100_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text; null and wordless texts have zero."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    h = np.array([xxh64_intdigest(whole[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    ship(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = np.array([fingerprint(t if isinstance(t, str) else "", shingle) for t in frame["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64").mask(frame["none"]), "fp": fps.view(np.int64)})

    return whole_ids(docs).mapInPandas(run, "doc_id long, fp long")


def part_masks(levels: int) -> list[list[int]]:
    """By level, the masks of fixed bits: mask i of a level has masks 4 i to 4 i + 3 of the next."""
    out = [[0]]
    for _ in range(levels):
        masks = []
        for mask in out[-1]:
            free = [b for b in range(64) if not mask >> b & 1]
            cuts = [len(free) * j // 4 for j in range(5)]
            masks += [mask | sum(1 << b for b in free[a:b_]) for a, b_ in zip(cuts, cuts[1:])]
        out.append(masks)
    return out


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def gray_rank(column: str) -> F.Column:
    """The place of a fingerprint in Gray order: an exclusive or over all higher bits."""
    out = F.col(column)
    for k in (1, 2, 4, 8, 16, 32):
        out = out.bitwiseXOR(F.shiftrightunsigned(out, k))
    return out


def gray_ranks(fps: np.ndarray) -> np.ndarray:
    """gray_rank of an array."""
    for k in (1, 2, 4, 8, 16, 32):
        fps = fps ^ fps >> np.uint64(k)
    return fps


def index_pairs(fps: np.ndarray, bits: int, leaf: int = 16, fan: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i < j) of all links among fingerprints that come in Gray order."""
    levels = []  # from the leaves up: start of each node's items, shared mask, pattern
    starts = np.arange(0, len(fps), leaf)
    while True:
        ends = np.append(starts[1:], len(fps))
        span = np.repeat(fps[starts], ends - starts) ^ fps
        differ = np.bitwise_or.reduceat(span, starts)
        levels.append((starts, ~differ, fps[starts]))
        if len(starts) == 1:
            break
        starts = starts[::fan]
    query, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
    far = np.zeros(len(fps), np.uint8)
    above = np.zeros(1, np.uint64)
    for k in range(len(levels) - 1, -1, -1):
        _, shared, pattern = levels[k]
        if k < len(levels) - 1:
            above = levels[k + 1][1][np.arange(len(shared)) // fan]
            first = node * fan
            n = np.minimum(first + fan, len(shared)) - first
            query, far = np.repeat(query, n), np.repeat(far, n)
            node = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        far = far + np.bitwise_count((fps[query] ^ pattern[node]) & (shared & ~above)[node])
        keep = far <= bits
        query, node, far = query[keep], node[keep], far[keep]
    first = node * leaf
    n = np.minimum(first + leaf, len(fps)) - first
    query = np.repeat(query, n)
    item = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    keep = query < item
    query, item = query[keep], item[keep]
    keep = np.bitwise_count(fps[query] ^ fps[item]) <= bits
    return query[keep], item[keep]


def forest(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (item, smallest item of its component) instead of all links."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[label])
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        if (new == label).all():
            return np.flatnonzero(label != np.arange(size)), label[label != np.arange(size)]
        label = new


def search(fps: np.ndarray, group: np.ndarray, bits: int, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of whole groups: group is sorted, fps within a group come in Gray order."""
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.append(begin, len(fps)))
    left, right = [], []
    few = np.repeat(size <= small, size)
    for d in range(1, small):  # a single leaf
        i = np.flatnonzero(few[:-d] & (group[d:] == group[:-d]))
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= bits]
        if len(i):
            left.append(i)
            right.append(i + d)
    for at, n in zip(begin[size > small], size[size > small]):
        x, y = index_pairs(fps[at : at + n], bits)
        x, y = forest(x, y, n)
        left.append(x + at)
        right.append(y + at)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def links(fps: DataFrame, bits: int = 3, largest: int = 2048) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) within ``bits`` bits, directly or over others."""
    if not 0 <= bits <= 3:
        raise ValueError("four parts find links of at most 3 bits")
    ship(fps.sparkSession)

    def edges(whole: pd.DataFrame) -> pd.DataFrame:
        part, key, fp = (whole[c].to_numpy() for c in ("part", "key", "fp"))
        order = np.lexsort((gray_ranks(fp.view(np.uint64)), key, part))
        part, key, fp = part[order], key[order], fp[order]
        group = np.cumsum(np.r_[0, (part[1:] != part[:-1]) | (key[1:] != key[:-1])])
        x, y = search(fp.view(np.uint64), group, bits)
        known, code = np.unique(np.concatenate([fp[x], fp[y]]), return_inverse=True)
        x, y = forest(code[: len(x)], code[len(x) :], len(known))
        return pd.DataFrame({"a": known[x], "b": known[y]})

    rows = fps.select(F.lit(0).alias("part"), "fp")
    found = []
    masks = part_masks(6)
    for level in range(1, 7):
        own = F.array(*[F.lit(signed(m)) for m in masks[level]])
        rows = rows.select(F.explode(F.sequence(F.col("part") * 4, F.col("part") * 4 + 3)).alias("part"), "fp")
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.element_at(own, F.col("part") + 1)))
        counts = cut(rows.groupBy("part", "key").count().filter("count > 1"))
        rows = rows.join(counts, ["part", "key"])
        # in the last level 12 bits at most are open, so a node is small whatever it holds
        fit = rows if level == 6 else rows.filter(F.col("count") <= largest)
        # whole nodes by grouping: adaptive execution may drop a repartition by the keys of the join before it, and then change that join
        lots = int(counts.agg(F.sum("count")).first()[0] or 0) // LOT + 1
        fit = fit.select(F.pmod(F.xxhash64("part", "key"), F.lit(lots)).alias("lot"), "part", "key", "fp")
        found.append(cut(fit.groupBy("lot").applyInPandas(edges, "a long, b long")))
        if level == 6 or counts.filter(F.col("count") > largest).isEmpty():
            break
        rows = cut(rows.filter(F.col("count") > largest).select("part", "fp"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3, largest: int = 2048) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    Fingerprints link at ``bits`` or fewer differing bits; component_id is the smallest doc_id
    that links reach. A null text is empty, and texts without words have fingerprint zero, which
    links like any other. Copies share a fingerprint and cost one entry in the index, however
    many they are. Repeated rows stay; null doc_ids stay and are never a component's id unless
    it has no other. An empty table gives no rows; other columns are ignored.
    """
    prints = cut(fingerprints(docs, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    reached = components(links(distinct, bits, largest))
    rooted = distinct.join(reached.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    rooted = cut(rooted)
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = cut(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
