"""Smoothed chances against a plain modified Kneser-Ney, sums to one, and junk told from trusted text."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import ngrams, quality


class Plain:
    """Modified Kneser-Ney by dictionaries, one symbol at a time."""

    def __init__(self, texts, order):
        self.order, counts = order, Counter()
        for t in texts:
            x = [10] * (order - 1) + ngrams.symbols(t or "").tolist()
            counts.update(tuple(x[i - order + 1 : i + 1]) for i in range(order - 1, len(x)))
        self.levels = {order: dict(counts)}
        for n in range(order - 1, 0, -1):
            self.levels[n] = Counter(g[1:] for g in self.levels[n + 1])
        self.d, self.total, self.taken = {}, {}, {}
        for n, level in self.levels.items():
            seen = Counter(level.values())
            y = seen[1] / (seen[1] + 2 * seen[2]) if seen[1] + seen[2] else 0.5
            self.d[n] = [min(max(i - (i + 1) * y * seen[i + 1] / seen[i], 0.1), i - 0.1) if seen[i] else 0.5 * i for i in (1, 2, 3)]
            self.total[n], self.taken[n] = defaultdict(float), defaultdict(float)
            for g, c in level.items():
                self.total[n][g[:-1]] += c
                self.taken[n][g[:-1]] += self.d[n][min(c, 3) - 1]

    def prob(self, h, x):
        n = len(h) + 1
        low = self.prob(h[1:], x) if h else 1 / 256
        if h not in self.total[n]:
            return low
        c = self.levels[n].get((*h, x), 0)
        return ((c - self.d[n][min(c, 3) - 1]) if c else 0) / self.total[n][h] + self.taken[n][h] / self.total[n][h] * low

    def score(self, text):
        x = [10] * (self.order - 1) + ngrams.symbols(text).tolist()
        return sum(np.log10(self.prob(tuple(x[i - self.order + 1 : i]), x[i])) for i in range(self.order - 1, len(x)))


TEXTS = ["the cat sat", "The cat  ran", "", None, "a b c d e f", "кот сидел на окне", "кошка и кот", "猫は窓に座った。"] * 3 + ["one more cat"]


@pytest.mark.parametrize("order", [2, 4, 6])
def test_chances_equal_plain_smoothing(spark, order):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    m, plain = ngrams.model(ngrams.counted(docs, order), order), Plain(TEXTS, order)
    asked = ["the cat", "", "zz é", "кот на", "окно猫", "never \x00 seen", "the cat sat " * 50]
    score, size = m.score(asked)
    assert size.tolist() == [len(ngrams.symbols(t)) for t in asked]
    assert score == pytest.approx([plain.score(t) for t in asked], rel=1e-5)
    for h in ("", "the ", "qqqqq", "ко"):
        x = np.r_[np.full(order - 1, 10), ngrams.symbols(h)[:-1]].astype(int)[-(order - 1) :]
        base = sum(int(b) << 8 * (k + 1) for k, b in enumerate(x[::-1]))
        assert (10.0 ** m.resolve(base + np.arange(256))).sum() == pytest.approx(1, abs=1e-5)


def test_chunks_do_not_matter(spark, monkeypatch):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab cdé"), n)) for n in (5000, 3, 512, 513, 1, 700)]
    m = ngrams.model(ngrams.counted(spark.createDataFrame([(t,) for t in texts], "text string"), 4), 4)
    whole, _ = m.score(texts)
    monkeypatch.setattr(ngrams, "CHUNK", 7)
    parts, _ = m.score(texts)
    assert np.allclose(whole, parts)


def test_counts(spark):
    got = ngrams.counted(spark.createDataFrame([(t,) for t in TEXTS], "text string"), 3)
    want = Counter()
    for t in TEXTS:
        x = [10, 10, *ngrams.symbols(t or "").tolist()]
        want.update(x[i - 2] << 16 | x[i - 1] << 8 | x[i] for i in range(2, len(x)))
    assert {r["gram"]: r["n"] for r in got.collect()} == want


def test_classifier(spark):
    rng = np.random.default_rng(1)
    parts = ["ka", "to", "mi", "ne", "ru", "so"]
    clean = lambda n: " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(n))
    rows = [(i, clean(int(rng.integers(40, 200))), "xx", "a") for i in range(300)]
    rows += [(1000 + i, " ".join("".join(rng.choice(list("QZXJ#%&"), 6)) for _ in range(60)), "xx", "b") for i in range(30)]
    rows += [(2000, None, "xx", "c"), (2001, "", None, "c"), (None, clean(80), None, "c"), (2002, clean(30_000), "xx", "c")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, perplexity string, _lang long, _limit long, _quality long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(1000, 0, 0), (None, 1, 0), (5, None, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    judged, name = quality.classify(docs, labels)
    assert judged.columns == [*docs.columns, name]
    got = judged.select("doc_id", "perplexity", "_lang", "_quality", f"{name}.keep").collect()
    assert len(got) == len(rows) and {(r["perplexity"], r["_lang"], r["_quality"]) for r in got} == {(k, 1, 3) for k in "abc"}
    kept = [r["doc_id"] for r in got if r["keep"]]
    assert not [i for i in kept if i is not None and 1000 <= i < 2000]
    assert sum(i is not None and i < 300 for i in kept) >= 294 and 2002 in kept
    assert quality.classify(docs.limit(0), labels)[0].count() == 0
    none, name = quality.classify(docs, labels.limit(0))
    assert none.filter(f"{name}.keep").count() == len(rows)


@pytest.mark.parametrize("order", [2, 4])
def test_all_trusted_text_is_learned(spark, monkeypatch, order):
    """Whatever their number, every distinct trusted text counts once, and blocks and shards do not matter."""
    monkeypatch.setattr(quality, "LEAST", 300)
    monkeypatch.setattr(quality, "MOST", 300)
    rows = [(i, t and t.lower(), "xx") for i, t in enumerate(TEXTS)] + [(None, "кот", "xx"), (70, "zz é " * 200, None), (71, "the cat sat", "xx"), (71, "the cat sat", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(71, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    good = {t or "" for i, t, _ in rows if i is not None and (i < 20 or i == 71) and i != 3}
    plain = Plain(sorted(good), order)
    judged, name = quality.classify(docs, labels, order)
    got = {(r["doc_id"], r["text"] or ""): r[name] for r in judged.collect()}
    assert len(got) == len(rows) - 1 and judged.count() == len(rows)
    for (_, t), own in got.items():
        assert own["symbols"] == len(ngrams.symbols(t, False))
        assert np.log10(own["perplexity"]) * own["symbols"] == pytest.approx(-plain.score(t), rel=1e-4)


def test_no_sample_of_trusted_text(spark):
    """A model of more trusted documents than the former limit of 20,000 knows what only the last of them holds."""
    docs = spark.range(24_100).selectExpr("id AS doc_id", "md5(cast(id AS string)) AS text", "'xx' AS lang")
    labels = docs.filter("doc_id < 24000").selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    judged, name = quality.classify(docs, labels, 6)
    known, new = (judged.filter(c).agg(F.max(f"{name}.perplexity"), F.min(f"{name}.perplexity")).first() for c in ("doc_id < 24000", "doc_id >= 24000"))
    assert known[0] < new[1], (known, new)


def test_texts_are_not_stored_again(spark):
    """Of a caller's columns alone, what is stored with the perplexities has no texts; the verdicts are the same."""
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    judged, name = quality.classify(docs, labels, 4, keep=["doc_id", "lang"])
    held = {c for f in judged.inputFiles() for c in spark.read.parquet(f).columns}
    assert judged.columns == ["doc_id", "lang", name] and held == {"doc_id", "lang", name}
    whole, _ = quality.classify(docs, labels, 4)
    assert whole.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0
    assert sorted(map(str, judged.select("doc_id", name).collect())) == sorted(map(str, whole.select("doc_id", name).collect()))
