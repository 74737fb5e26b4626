"""Token counts against a plain search over all cuts, chances against the file's own merges."""

from collections import Counter

import public_tokenizers
import pytest

from tagloom.llm import counts
from tagloom.llm.counts import MARK, Vocabulary, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain(word, v):
    """(score, tokens) of the best cut, fewest tokens among equals; exponential."""
    best = None
    for i in range(1, len(word) + 1):
        piece = word[:i]
        options = [(v.scores[piece], 1)] if piece in v.scores else []
        if i == 1:
            options.append((v.missing, len(piece.encode())))
        for s, n in options:
            rest = plain(word[i:], v) if word[i:] else (0, 0)
            found = (s + rest[0], n + rest[1])
            if best is None or (found[0], -found[1]) > (best[0], -best[1]):
                best = found
    return best


def test_shared_prefixes_equal_plain_search():
    v = Vocabulary({MARK: -3, MARK + "a": -4, "a": -2, "ab": -4, "b": -2, "ba": -3, "bab": -9, "abab": -8})
    words = {"a", "ab", "aba", "abab", "ababab", "b", "bab", "c", "éa", "abc", "ca", "aab"}
    assert v.learn(words) == {w: plain(MARK + w, v)[1] for w in words}


TEXTS = {1: "the of internationalization", 2: None, 3: "", 4: " \n\t", 5: "日本語 \U0001f600", 6: "the " * 3000, None: "a", 9007199254740993: "x" * 500 + " the"}


def rows():
    return [(k, t, "x") for k, t in TEXTS.items()] + [(1, TEXTS[1], "y")]


def test_chances_are_the_merges_counts(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, n_tokens string")
    model, want = counts.processor(PATH), Counter()
    for _, t, _ in rows():
        for w in (t or "").split():
            want.update(model.encode(w))
    assert {i: n for i, n in enumerate(counts.fitted(docs, PATH)) if n} == want
    monkeypatch.setattr(counts, "HELD", 1)
    assert {i: n for i, n in enumerate(counts.fitted(docs, PATH)) if n} == want


@pytest.mark.parametrize("block", [2, 4096])
def test_file(spark, block):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, n_tokens string")
    v = Vocabulary.of(PATH, counts.fitted(docs, PATH))
    long = v.learn({w for t in TEXTS.values() for w in (t or "").split() if len(w) >= 12})
    n = lambda w: long[w] if w in long else plain(MARK + w, v)[1]
    want = sorted((str(k), len((t or "").split()), sum(n(w) for w in (t or "").split())) for k, t, _ in rows())
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_tokens"]) for r in token_counts(docs, PATH, block).collect())
    assert got == want
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
