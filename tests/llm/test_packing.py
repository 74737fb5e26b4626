"""Packing: exact round trip, exact ids, no padding."""

import numpy as np
import public_tokenizers
import pytest

from tagloom.llm import packing
from tagloom.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_the_tokenizers():
    e = Encoder.of(PATH)
    texts = ["", " \t\n\r ", "The cat's don't'll '''s 12ab3 a_b", "ä ̈b \x1c\x1d\x85\xa0 x <|endoftext|> İΣς ΑΣ ü² ×÷ ß ẞ ŉ ǅ", "日本語 ½ x" * 40, "".join(map(chr, range(33, 0x250))), "aB" * 4000]
    want = [x.ids + [1] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(texts, 1)] == want


@pytest.mark.parametrize("block", [1, 3000, 1 << 21])
def test_round_trip(spark, block):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(["cat", "internationalization", "the", "xqzw"], rng.integers(0, 900))), "s") for i in range(120)]
    rows += [(500, None, "s"), (501, "", "s"), (None, "one two", "s"), (502, "word " * 9000, "s"), rows[3]]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3), PATH, block_tokens=block).collect()
    by_sequence, by_doc = {}, {}
    for r in pieces:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert len(r["ids"]) == 4 * r["length"]
    for parts in by_sequence.values():
        parts.sort()
        size = sum(n for _, n in parts)
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist()
        assert size <= 2048 and size & (size - 1) == 0
    want = {}
    for (d, t, _), ids in zip(rows, Encoder.of(PATH).encode([t or "" for _, t, _ in rows], 1)):
        want.setdefault(d, []).append(ids.astype("<u4").tobytes())
    assert set(by_doc) == set(want)
    for d, own in by_doc.items():
        own.sort(key=lambda r: r["start"])
        if len(want[d]) == 1:
            assert b"".join(r["ids"] for r in own) == want[d][0] and own[0]["doc_tokens"] * 4 == len(want[d][0])
        else:
            assert sum(r["length"] for r in own) * 4 == sum(map(len, want[d]))


def test_least_squares_uses_the_histogram():
    h = np.zeros(101)
    h[[30, 70, 50, 20]] = [40, 40, 20, 0]
    combos = packing.combinations(np.array([30, 50, 70]), 100)
    x = packing.repeat_counts(combos, h, rounds=500)
    got = {tuple(c): v for c, v in zip(combos.tolist(), x)}
    assert got[30, 70, 0] == pytest.approx(40, abs=0.5) and got[50, 50, 0] == pytest.approx(10, abs=0.5)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
