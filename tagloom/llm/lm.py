"""Language-model scoring of whole texts by a weighted backoff automaton.

Tokens are words and one end. The states are the root, every word and every pair of words
that is counted at least twice; an arc reads a token that was counted after its state, and
what was not goes down the state's failure arc to the next shorter one. Counts are smoothed
by a hierarchy of Dirichlet priors: after a state h counted n(h) times a token has chance
(n(h w) + m P(w | shorter h)) / (n(h) + m), so the failure arc weighs m / (n(h) + m) and a
state's chances add up to one. At the root, counts of 1, 2 and more are discounted and what
that leaves is the chance of a token never seen. No word, pair or triple is dropped for
being rare, at any size.

Texts are tokenised once, in blocks of about ``block_tokens`` tokens, and stored as numbers
in a table bucketed by block, so they are never shuffled. Words, pairs and triples have hash
keys of twice the bits of the number of tokens, so that less than one pair of keys in a
corpus is expected to be the same by accident. A block sends its distinct keys with their counts, sorted and written as
differences, to shards that hold a range of keys each; a shard adds up and answers with the
totals alone, in the order of the keys, which the block knows. So no n-gram travels back, a
frequent one is a number a block, and nothing that grows with the input is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, dropped, saved, ship

END = b"\n"
#: Multipliers and shifts of a well-known 64-bit finaliser, and the odd number that joins keys.
U = np.uint64
FIRST, SECOND, JOIN = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
#: Orders are told apart by the high part of a shard's number.
ORDER = 1 << 40
#: Places walked at a time.
SEGMENT = 1 << 18
PACK, UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def tokens(text: str) -> list[bytes]:
    """Words with A-Z in lower case, then one end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and more, from how many things were counted one to four times."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    return tuple(min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) if a else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * FIRST
    x = (x ^ (x >> U(27))) * SECOND
    return x ^ (x >> U(31))


def shrunk(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed; the first byte is how many planes there are."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + PACK.compress(np.ascontiguousarray(planes.T).tobytes())


def grown(data: bytes) -> np.ndarray:
    planes = np.frombuffer(UNPACK.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


class Numbers(dict):
    """Words' numbers in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


@dataclass(frozen=True)
class Root:
    """The weights of the state without context; a count of zero is the unseen token's."""

    total: int
    distinct: int
    taken: tuple[float, float, float]
    left: float

    @classmethod
    def of(cls, total: int, distinct: int, seen: list[int]) -> "Root":
        """seen: how many words were counted one to four times."""
        d, (n1, n2) = discounts(*seen), seen[:2]
        return cls(total, distinct, d, (d[0] * n1 + d[1] * n2 + d[2] * (distinct - n1 - n2)) / total if total else 1.0)

    def prob(self, c: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.taken])[np.minimum(c, 3)]
        return np.where(c > 0, (c - d) / max(self.total, 1), self.left)


@dataclass
class Block:
    """Texts in a row as words' numbers, an end before each; words: the numbers' hashes."""

    x: np.ndarray
    starts: np.ndarray
    words: np.ndarray
    learned: np.ndarray

    @classmethod
    def read(cls, row) -> "Block":
        sizes = grown(row.sizes).astype(np.int64)
        return cls(grown(row.x).astype(np.uint32), np.cumsum(np.r_[0, sizes]), grown(row.words), grown(row.held) == 0)

    def keys(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of pairs, then of triples: at which places a token ends one, and the keys there."""
        ends = np.ones(len(self.x) + 1, bool)
        h = self.words[self.x]
        key = h.copy()
        for before in range(2):
            ends[self.starts[:-1] + before] = False
            key[1:] = mixed(key[:-1] * JOIN + h[1:] + U(before))
            yield ends[:-1], key[ends[:-1]]

    def learning(self) -> np.ndarray:
        """Which places are of texts that are learned from."""
        return np.repeat(self.learned, np.diff(self.starts))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts keys, where in it each distinct key begins, and the sorted distinct keys."""
    order = np.argsort(keys)
    own = keys[order]
    begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
    return order, begins, own[begins]


def spread(order: np.ndarray, begins: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of the distinct keys at the places of all keys."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, np.diff(np.r_[begins, len(order)]))
    return out


@dataclass(frozen=True)
class Shards:
    """2 ** power ranges of keys of ``bits`` bits."""

    order: int
    bits: int
    power: int

    def cut(self, keys: np.ndarray) -> np.ndarray:
        return keys >> U(64 - self.bits)

    def asked(self, block: int, keys: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        """A block's sorted distinct keys and their counts, a row a shard."""
        width = self.bits - self.power
        own = (keys >> U(width)).astype(np.int64)
        ends = np.searchsorted(own, np.arange((1 << self.power) + 1))
        rows = []
        for s in np.unique(own):
            a, b = ends[s], ends[s + 1]
            low = keys[a:b] - (U(int(s)) << U(width))
            rows.append((self.order * ORDER + int(s), block, shrunk(np.diff(low, prepend=U(0))), shrunk(n[a:b])))
        return pd.DataFrame(rows, columns=["shard", "block", "keys", "n"])


ASKED = "shard long, block long, keys binary, n binary"
ANSWERED = "block long, shard long, totals binary, seen array<long>"


def answered(frame: pd.DataFrame) -> pd.DataFrame:
    """A shard's totals for each block, in the order of the block's keys; seen: distinct keys counted, and counted one to four times."""
    frame = frame.sort_values("block")
    keys = [np.cumsum(grown(k), dtype=np.uint64) for k in frame["keys"]]
    order, begins, each = distinct(np.concatenate(keys))
    n = np.concatenate([grown(c) for c in frame["n"]]).astype(np.int64)[order]
    total = np.add.reduceat(n, begins) if len(n) else n
    seen = [[int((total > 0).sum()), *np.bincount(np.minimum(total, 5), minlength=6)[1:5].tolist()], *[None] * (len(keys) - 1)]
    parts = np.split(spread(order, begins, total), np.cumsum([len(k) for k in keys])[:-1])
    return pd.DataFrame({"block": frame["block"].to_numpy(), "shard": frame["shard"].to_numpy(), "totals": [shrunk(p) for p in parts], "seen": seen})


def totals(asked: DataFrame) -> DataFrame:
    return asked.groupBy("shard").applyInPandas(answered, ANSWERED)


def walked(c: np.ndarray, before: np.ndarray, n2: np.ndarray, before2: np.ndarray, n3: np.ndarray, root: Root, prior: tuple[float, float], least: int = 2) -> np.ndarray:
    """log10 probability at places, from counts: c of the token, n2 and n3 of the pair and triple that end there (-1: none), before and before2 of the word and pair that end one place earlier.

    The state before a token is the longest of pair, word and root that is a state, and a
    state's shorter one is the state that the same place has one order lower; so all places
    are walked at once, down the failure arcs as far as each needs to go.
    """
    low, arcs = root.prob(c), []
    for held, n, m in ((np.where(n2 >= 0, before, 0), n2, prior[0]), (np.where(n3 >= 0, before2, 0), n3, prior[1])):
        is_state = held >= least
        low = np.where(is_state, (np.maximum(n, 0) + m * low) / (held + m), low)
        arcs.append((is_state, n > 0, low, m / (held + m)))
    out, open_ = np.zeros(len(c)), n2 >= 0
    for is_state, has_arc, chance, fails in arcs[::-1]:
        hit = open_ & is_state & has_arc
        out[hit] += np.log10(chance[hit])
        open_ &= ~hit
        down = open_ & is_state
        out[down] += np.log10(fails[down])
    out[open_] += np.log10(root.prob(c[open_]))
    return out


def blocked(docs: DataFrame, block_tokens: int, bits: int) -> DataFrame:
    """docs (doc_id, none, text, held_out) tokenised, a row a block of texts in the order they are read; words have keys of ``bits`` bits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, turn, held = TaskContext.get().partitionId(), 0, []
        numbers, size = Numbers(), 0

        def out() -> pd.DataFrame:
            ends, sizes = numbers[END], [len(t) + 1 for *_, t in held]
            x = np.concatenate([y for *_, t in held for y in ([ends], t)])
            learned = np.concatenate([t for *_, h, t in held if not h] or [np.zeros(0, np.uint32)])
            words = np.fromiter((xxhash.xxh64_intdigest(w) >> 64 - bits for w in numbers), np.uint64, len(numbers))
            arrays = {"ids": np.array([d for d, *_ in held], np.int64).view(np.uint64), "none": np.array([k for _, k, *_ in held]), "held": np.array([h for _, _, h, _ in held])}
            arrays |= {"sizes": np.array(sizes), "x": x, "words": words, "counts": np.bincount(learned, minlength=len(numbers))}
            return pd.DataFrame({"block": [part << 32 | turn], "learned": [len(learned)], **{k: [shrunk(v)] for k, v in arrays.items()}})

        for frame in frames:
            for d, none, h, t in zip(frame["doc_id"], frame["none"], frame["held_out"], frame["text"]):
                own = tokens(t)
                held.append((d, none, h, np.fromiter(map(numbers.__getitem__, own), np.uint32, len(own))))
                size += len(own)
                if size >= block_tokens:
                    yield out()
                    turn, held, size, numbers = turn + 1, [], 0, Numbers()
        if held:
            yield out()

    return docs.mapInPandas(run, "block long, learned long, ids binary, none binary, held binary, sizes binary, x binary, words binary, counts binary")



def scored(blocks: DataFrame, by_order: list[Shards], prior: tuple[float, float]) -> DataFrame:
    """The result for tokenised blocks, stored."""
    learned = blocks.agg(F.sum("learned")).first()[0] or 0

    def words_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                words, n = grown(row.words), grown(row.counts)
                order = np.argsort(words)
                yield by_order[0].asked(row.block, words[order], n[order])

    def grams_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                block = Block.read(row)
                learning = block.learning()
                for shards, (at, keys) in zip(by_order[1:], block.keys()):
                    order, begins, each = distinct(shards.cut(keys))
                    n = learning[at][order].astype(np.int32)
                    yield shards.asked(row.block, each, np.add.reduceat(n, begins) if len(n) else n)

    words = saved(totals(blocks.select("block", "words", "counts").mapInPandas(words_of, ASKED)))
    found = words.select(*[F.coalesce(F.sum(F.col("seen")[k]), F.lit(0)) for k in range(5)]).first()
    root = Root.of(learned, found[0], list(found[1:]))
    grams = totals(blocks.select("block", "held", "sizes", "x", "words").mapInPandas(grams_of, ASKED))

    def walk(frame: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        row = next(frame.itertuples())
        block = Block.read(row)
        counts = counts.sort_values("shard")
        kind = counts["shard"].to_numpy() // ORDER
        told = lambda k: np.concatenate([np.zeros(0, np.uint64), *map(grown, counts["totals"][kind == k])]).astype(np.int64)
        c = np.empty(len(block.words), np.int64)
        c[np.argsort(block.words)] = told(0)
        by_place = []
        for k, (at, keys) in enumerate(block.keys(), 1):
            order, begins, _ = distinct(by_order[k].cut(keys))
            by_place.append(np.full(len(block.x), -1))
            by_place[-1][at] = spread(order, begins, told(k))
        n2, n3 = by_place
        token, value, base, known = n2 >= 0, *(np.zeros(len(block.x)) for _ in range(2)), np.zeros(len(block.x), bool)
        for a in range(0, len(block.x), SEGMENT):
            b = min(a + SEGMENT, len(block.x))
            own, last = c[block.x[a:b]], slice(max(a - 1, 0), b - 1)
            before, before2 = (np.r_[np.zeros(int(a == 0), np.int64), v] for v in (c[block.x[last]], np.maximum(n2[last], 0)))
            value[a:b] = walked(own, before, n2[a:b], before2, n3[a:b], root, prior)
            base[a:b] = np.log10((own + 0.1) / (root.total + 0.1 * (root.distinct + 1)))
            known[a:b] = own > 0
        add = lambda v: np.add.reduceat(np.where(token, v, 0), block.starts[:-1])
        ids = pd.array(grown(row.ids).view(np.int64), dtype="Int64")
        ids[grown(row.none) == 1] = pd.NA
        out = {"doc_id": ids, "held_out": ~block.learned, "n_tokens": np.diff(block.starts) - 1, "n_known": add(known), "train_tokens": root.total}
        return pd.DataFrame({**out, "base_score": add(base), "score": add(value)})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answers = words.select("block", "shard", "totals").union(grams.select("block", "shard", "totals"))
    given = blocks.select("block", "ids", "none", "held", "sizes", "x", "words")
    return saved(given.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(walk, schema))


def score(docs: DataFrame, held_out: Column, prior: tuple[float, float] = (2000.0, 50.0), block_tokens: int = 3 << 19, shard_keys: int = 1 << 21) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    base_score is the baseline of token frequencies, 0.1 added to each. Rows where
    ``held_out`` holds are scored but not learned from; where it is null they are learned from.
    A null text is empty and has its end token. Null and repeated doc_ids are rows like others,
    and so are repeated rows; an empty table gives no rows; other columns are ignored. Without
    training rows every token is the unseen one, whose probability is one. ``prior`` has the
    weights m of the shorter state after a word and after a pair. Blocks and shards hold about
    ``block_tokens`` and ``shard_keys``, or more: where a block's part for a shard would be
    under a thousand keys both grow, with the square root of the corpus.
    """
    spark = ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.col("doc_id").cast("long")
    placed = docs.select(F.coalesce(own, F.lit(0)).alias("doc_id"), own.isNull().alias("none"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text.alias("text"))
    around = (placed.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 1) // 5  # tokens, about
    least = int(32 * math.sqrt(around))
    bits = min(64, max(40, 2 * around.bit_length()))
    per_block = max(block_tokens, least)
    power = max(2, math.ceil(math.log2(max(1, around / max(shard_keys, least)))))
    blocks, name = bucketed(blocked(placed, per_block, bits), "block", max(1, around // per_block))
    try:
        return scored(blocks, [Shards(0, bits, max(0, power - 2)), Shards(1, bits, power), Shards(2, bits, power)], prior)
    finally:
        dropped(name)
