"""Language-model scores against a plain model by dictionaries, the baseline against SQL's counts."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import lm, queries


class Plain:
    """The model over whole dictionaries, one token at a time."""

    def __init__(self, rows, prior=(2000.0, 50.0), least=2):
        self.n, self.prior, self.least = [Counter(), Counter(), Counter()], prior, least
        for _, text, held in rows:
            w = lm.tokens(text or "")
            if not held:
                self.n[0].update((x,) for x in w)
                w = [lm.END, *w]
                self.n[1].update(zip(w, w[1:]))
                self.n[2].update(zip(w, w[1:], w[2:]))
        seen = Counter(self.n[0].values())
        self.total = sum(self.n[0].values())
        d = lm.discounts(*(seen[i] for i in (1, 2, 3, 4)))
        self.taken = lambda c: d[min(c, 3) - 1]
        self.left = sum(self.taken(c) for c in self.n[0].values()) / self.total if self.total else 1.0

    def prob(self, h, w):
        if not h:
            c = self.n[0][(w,)]
            return (c - self.taken(c)) / self.total if c else self.left
        low, size = self.prob(h[1:], w), self.n[len(h) - 1][h]
        if size < self.least:
            return low
        m = self.prior[len(h) - 1]
        return (self.n[len(h)][(*h, w)] + m * low) / (size + m)

    def score(self, text):
        w = [lm.END, *lm.tokens(text or "")]
        return sum(np.log10(self.prob(tuple(w[max(0, i - 2) : i]), w[i])) for i in range(1, len(w)))


def corpus():
    rng = np.random.default_rng(4)
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(common, 2000)), False) for i in range(100)]
    for i in range(0, 300, 3):
        rows += [(1000 + 3 * i + k, f"{rare[i]} {rare[i + 1]} {rare[i + 2]} Zebra{i}", k == 2) for k in range(3)]
    rows += [(None, None, False), (None, "", True), (7, "never seen words", True), (7, "c1 c2 r0 r1", True), (7, "c1 c2 r0 r1", True), (8, "ÀB a b\tC\x0bd " * 5, None), (9007199254740993, "x", False)]
    return rows


def key(d, held, n, s):
    return (-1 if d is None else d, bool(held), n, round(s, 5))


@pytest.mark.parametrize("size", [1 << 21, 10_000])
def test_scores_equal_the_plain_model(spark, size):
    """Rare pairs in 200,000 tokens, with nulls, empties, repeats and clashing columns; one block or many."""
    rows, plain = corpus(), Plain(corpus())
    docs = spark.createDataFrame([(*r, 0.0, "b") for r in rows], "doc_id long, text string, held boolean, score double, block string")
    want = sorted(key(d, held, len(lm.tokens(t or "")), plain.score(t)) for d, t, held in rows)
    got = sorted(key(r["doc_id"], r["held_out"], r["n_tokens"], r["score"]) for r in lm.score(docs.repartition(3), F.col("held"), block_tokens=size, shard_keys=size).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-4)


def test_chances_add_up_to_one():
    rows = [(i, t, False) for i, t in enumerate(["a b c a b", "a b", "c a b d", "a b c"] * 3)] + [(99, "e", False)]
    plain = Plain(rows, prior=(3.0, 2.0))
    for h in [(), (lm.END,), (b"a",), (b"a", b"b"), (b"d", b"d"), (lm.END, b"a")]:
        assert sum(plain.prob(h, w[0]) for w in plain.n[0]) + plain.prob(h, b"unseen") == pytest.approx(1)


def test_edges(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, held boolean")
    assert lm.score(docs.limit(0), F.col("held")).count() == 0
    assert all(r["score"] == pytest.approx(0) and r["n_known"] == 0 for r in lm.score(docs.limit(3), F.lit(True)).collect())


def test_written_numbers():
    for values in ([], [0], [2**64 - 1, 0, 5], list(range(1000))):
        values = np.array(values, np.uint64)
        assert (lm.grown(lm.shrunk(values)) == values).all()


def test_baseline_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op6_lm_scoring(spark, sf).collect()}
    db = duckdb.connect()
    rows = db.sql(f"""with t as (select doc_id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') || [chr(10)]) w from read_parquet('{sf}/documents.parquet')) select doc_id, w, count(*) from t group by 1, 2""").fetchall()
    import zlib

    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    n, known, base = Counter(), Counter(), Counter()
    for d, w, k in rows:
        if not held(d):
            n[w] += k
    total = sum(n.values())
    for d, w, k in rows:
        known[d] += k * (n[w] > 0)
        base[d] += k * np.log10((n[w] + 0.1) / (total + 0.1 * (len(n) + 1)))
    assert {d: (r["n_known"], r["train_tokens"], r["held_out"]) for d, r in got.items()} == {d: (known[d], total, held(d)) for d in base}
    assert all(r["base_score"] == pytest.approx(base[d], rel=1e-9) for d, r in got.items())
    assert sum(r["score"] - r["base_score"] for r in got.values() if r["held_out"]) > 0
