"""Token counts under a unigram model by dynamic programming over a shared trie.

A text's pre-tokens are its blank-separated words, each after a word mark. The distinct
ones of a batch are inserted in a trie; in depth-first order each trie node gets its forward
score once, the best sum of piece scores over all ways to cut the prefix, with the number of
pieces of that way and the pieces that are still open there, so words share the work of their
common prefixes. A word's last node holds its count, and a document's count is the sum over
its words.

The pieces are those of the vocabulary file, which ranks them but gives no chances. These are
fitted on the corpus: a piece's chance is how often the vocabulary's own merges use it in all
words of all documents, one added. Words are counted once in the cluster, so each distinct one
is cut once; what comes back is a number a piece. Scores are logarithms held as whole numbers,
so sums are exact. A character that no piece covers costs as much as the rarest piece and 10
nats, and counts a token for each of its bytes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, whole_ids

MARK = "▁"
UNIT = 1 << 20
#: Distinct words that a task counts before it sends them on.
HELD = 100_000
#: Longer words are not kept for later batches.
LONG = 64


def processor(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


class Vocabulary:
    """Pieces with whole-number scores, and the counts of the words met so far."""

    known: dict[tuple, "Vocabulary"] = {}

    def __init__(self, scores: dict[str, int], entries: int = 500_000):
        self.scores, self.entries, self.counts, self.root = scores, entries, {}, {}
        for piece, score in scores.items():
            node = self.root
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = score
        self.missing = min(scores.values(), default=0) - 10 * UNIT

    @classmethod
    def of(cls, path: str, used: list[int]) -> "Vocabulary":
        """One vocabulary a worker process, file and fit; used: how often each piece id was used."""
        key = (path, hash(tuple(used)))
        if key not in cls.known:
            model = processor(path)
            ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
            total = math.log(sum(used[i] + 1 for i in ids))
            cls.known.clear()
            cls.known[key] = cls({model.id_to_piece(i): round((math.log(used[i] + 1) - total) * UNIT) for i in ids})
        return cls.known[key]

    def learn(self, words: set[str]) -> dict[str, int]:
        """Counts for words: their trie, depth first, is their sorted order."""
        root, missing, out = self.root, self.missing, {}
        best, used, open_, last = [0], [0], [[(0, root)]], ""
        for word in sorted(words):
            marked = MARK + word
            shared = 0
            for a, b in zip(marked, last):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], used[shared + 1 :], open_[shared + 1 :]
            for end in range(shared + 1, len(marked) + 1):
                char = marked[end - 1]
                top, n = best[-1] + missing, used[-1] + len(char.encode("utf-8", "surrogatepass"))
                alive = []
                for start, node in open_[-1]:
                    node = node.get(char)
                    if node is not None:
                        alive.append((start, node))
                        s = node.get("")
                        if s is not None:
                            s += best[start]
                            if s > top or s == top and used[start] + 1 < n:
                                top, n = s, used[start] + 1
                alive.append((end, root))
                best.append(top)
                used.append(n)
                open_.append(alive)
            last = marked
            out[word] = used[-1]
        return out

    def count(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Words and tokens of each text."""
        if len(self.counts) > self.entries:
            self.counts.clear()
        own = [t.split() for t in texts]
        known = self.counts
        new = self.learn({w for ws in own for w in ws if w not in known})
        known.update(new)
        found = [len(ws) for ws in own], [sum(map(known.__getitem__, ws)) for ws in own]
        for w in [w for w in new if len(w) > LONG]:
            del known[w]
        return found


def fitted(docs: DataFrame, vocabulary: str) -> list[int]:
    """How often the vocabulary's merges use each piece in all words of docs (column text)."""
    ship(docs.sparkSession)
    size = processor(vocabulary).get_piece_size()

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for frame in frames:
            for t in frame["text"]:
                if isinstance(t, str):
                    n.update(t.split())
                if len(n) > HELD:
                    yield pd.DataFrame({"word": list(n), "n": list(n.values())})
                    n.clear()
        yield pd.DataFrame({"word": list(n), "n": list(n.values())}).astype({"word": str, "n": np.int64})

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, total = processor(vocabulary), np.zeros(size, np.int64)
        for frame in frames:
            for at in range(0, len(frame), 10_000):
                part = frame.iloc[at : at + 10_000]
                cut = model.encode(part["word"].tolist(), num_threads=1)
                lengths = [len(c) for c in cut]
                ids = np.fromiter((i for c in cut for i in c), np.int64, sum(lengths))
                total += np.bincount(ids, np.repeat(part["n"].to_numpy(), lengths), size).astype(np.int64)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"piece": used, "n": total[used]})

    counted = docs.select("text").mapInPandas(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    out = [0] * size
    for r in counted.mapInPandas(pieces, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():  # a row a piece at most
        out[r["piece"]] = r["n"]
    return out


def token_counts(docs: DataFrame, vocabulary: str, block: int = 4096) -> DataFrame:
    """doc_id, n_words, n_tokens of every document.

    ``vocabulary`` is the file's path on the workers. A null text, and one without words,
    has no tokens. Null and repeated doc_ids are rows like others; an empty table gives no
    rows; other columns are ignored. Whole texts count, however long.
    """
    own = whole_ids(docs)
    used = fitted(own, vocabulary)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Vocabulary.of(vocabulary, used)
        for frame in frames:
            for at in range(0, len(frame), block):
                part = frame.iloc[at : at + block]
                words, tokens = pieces.count([t if isinstance(t, str) else "" for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").mask(part["none"]).array, "n_words": words, "n_tokens": tokens})

    return own.mapInPandas(run, "doc_id long, n_words long, n_tokens long")
