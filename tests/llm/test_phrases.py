"""Phrase mining: suffix arrays and whole results against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from tagloom.llm import phrases, suffixes

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for n, top in ((0, 3), (1, 3), (40, 3), (300, 5), (300, 200)):
        words = rng.integers(0, top, n)
        order = suffixes.suffix_array(words, 4)
        assert [tuple(words[i : i + 4]) for i in order] == sorted(tuple(words[i : i + 4]) for i in range(n))
        shared = suffixes.lcp(words, order, 4)
        for at in range(1, n):
            a, b = words[order[at - 1] :][:4], words[order[at] :][:4]
            assert shared[at] == next((d for d in range(min(len(a), len(b))) if a[d] != b[d]), min(len(a), len(b)))
        for k in (1, 2, 3, 4):
            start, count = suffixes.intervals(words, order, shared, k)
            want = Counter(tuple(words[i : i + k]) for i in range(n - k + 1) if words[i : i + k].all())
            assert {tuple(words[s : s + k]): c for s, c in zip(start, count)} == want
            some = sorted(want)[::3]
            if some:
                hit = suffixes.found(words, [np.array([g[d] for g in some]) for d in range(k)])
                assert hit.tolist() == [i + k <= n and tuple(words[i : i + k]) in some for i in range(n)]


def brute(rows, least, top, longest, covered=50):
    n, f, out = Counter(), defaultdict(Counter), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").encode().translate(LOW).decode()):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        candidates, gone, found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}, set(), []
        for p, a in candidates.items():
            gone |= {p[i : i + k] for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= covered * c[p[i : i + k]]}
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((score, a, " ".join(p), c[p[:k]], c[p[k:]]))
        found.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, x, y, n[lang], s) for i, (s, a, p, x, y) in enumerate(found[:top])]
    return sorted(out)


def test_phrases(spark, monkeypatch):
    rng = random.Random(11)
    words = ["The", "a", "Éa", "b c", "x'", "ZZ", "q", "ÿ", "\x00", "r　"]
    text = lambda n: "".join(rng.choice(words[: rng.randint(2, 10)]) + rng.choice([" ", "  ", "\t", " ", " ", ", ", ".", "\n", "\x0b", "; "]) for _ in range(n))
    rows = [(text(rng.randint(1, 60)), rng.choice(["en", "en", "de", None, "und", ""])) for _ in range(150)] + [(None, "en"), ("", None), ("...", "de"), (" ".join(["the"] * 5000), "en")]
    rows += rows[:5]
    df = spark.createDataFrame([(None, *r, 1, 2) for r in rows], "doc_id long, text string, lang string, n int, shard int").repartition(3)
    monkeypatch.setattr(phrases, "SLICE", 50)
    for longest, block in ((2, 40), (3, 100_000), (4, 300)):
        got = phrases.collocations(df, least=3, top=60, longest=longest, block=block)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, 60, longest)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert phrases.collocations(df.limit(0)).count() == 0 and phrases.collocations(df.filter("text is null")).count() == 0


def test_blocks_cut_pieces_without_losing_or_doubling_words(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 8)
    import pyarrow as pa

    text = b"aa bb cc dd ee ff gg. hh aa bb cc"
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
    rows = [r for b in phrases.numbered(iter([batch]), 2, 3) for r in b.to_pylist()]
    n = Counter()
    for r in rows:
        if r["word"] is not None:
            n[r["word"]] += r["n"]
    assert n == Counter(re.findall(rb"[a-z]+", text)) and len({r["shard"] for r in rows}) > 2
    assert any(r["context"] for r in rows if r["tokens"] is not None)


def test_exact_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(3 * 10**9, 3 * 10**9 + 1, 3 * 10**9 + 7), (10**13, 10**13, 10**14 + 1)], "a long, l long, r long")
    got = [r[0] for r in df.select(phrases.cohesion(*(df[c] for c in "alr"))).collect()]
    assert got == [1000000 * a * a // (x * y) for a, x, y in ((3 * 10**9, 3 * 10**9 + 1, 3 * 10**9 + 7), (10**13, 10**13, 10**14 + 1))]
