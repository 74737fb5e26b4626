"""SimHash components against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tagloom.llm import simhash
from tagloom.plans.components import components
from tagloom.plans.lineage import cut

SCHEMA = "doc_id long, text string, fp string, component_id string, part int"


def plain_fingerprint(text):
    words = []
    for w in (text or "").encode().split():
        words.append(bytes(c + 32 if 65 <= c <= 90 else c for c in w))
    if not words:
        return 0
    k = min(3, len(words))
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows):
    """rows: (doc_id, fp); the smallest doc_id that each row reaches."""
    n, label = len(rows), list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 3:
                label[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return [low.get(root(i)) for i in range(n)]


def texts():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(60):
        t = " ".join(rng.choice(words, rng.integers(1, 400)))
        out.append(t)
        for _ in range(int(rng.integers(0, 4))):
            w = t.split(" ")
            w[rng.integers(len(w))] = "changed"
            out.append(" ".join(w))
    out += ["", None, " \t\n", "One", "one", "ONE two", "É é", "a" * 5000, out[0], out[0]]
    return out


def test_components_equal_brute_force(spark):
    rows = [(i if i % 17 else None, t, "x", "y", 3) for i, t in enumerate(texts())]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = plain_components([(r[0], plain_fingerprint(r[1])) for r in rows])
    key = lambda x: (x[0] is None, x[0] or 0, *map(str, x[1:]))
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], f"{plain_fingerprint(r[1]):016x}", c) for r, c in zip(rows, want)), key=key)


def test_split_groups_lose_no_link(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    fps = {base}
    while len(fps) < 400:  # a ball: each from an earlier one by up to 4 bits
        f = int(rng.choice(list(fps)))
        for b in rng.integers(0, 63, rng.integers(1, 5)):
            f ^= 1 << int(b)
        fps.add(f)
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 200)}
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), largest=20)
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    want = plain_components([(f, f) for f in fps])
    assert [got.get(f, f) for f in fps] == want


def test_index_finds_all_pairs():
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 1 << 12, 900).astype(np.uint64) << np.uint64(7))
    gray = fps.copy()
    for k in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(k)
    fps = fps[np.argsort(gray)]
    for n in (1, 2, 15, 16, 17, 130, len(fps)):
        x, y = simhash.index_pairs(fps[:n], 3)
        want = {(i, j) for j in range(n) for i in range(j) if bin(int(fps[i]) ^ int(fps[j])).count("1") <= 3}
        assert set(zip(x.tolist(), y.tolist())) == want and len(x) == len(want)


def test_gray_rank(spark):
    codes = [i ^ i >> 1 for i in range(64)]
    got = spark.createDataFrame([(c,) for c in codes], "fp long").select(simhash.gray_rank("fp").alias("r")).collect()
    assert [r["r"] for r in got] == list(range(64))


def test_empty_and_bits(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long"), bits=4)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(50, 80)] + [(7, 7), (None, 3), (1, 50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in [1, *range(50, 80)]}
    assert components(spark.createDataFrame([], "a long, b long").filter(F.lit(True))).count() == 0


def test_top_nodes_stay_whole(spark):
    """Pairs whose ends lie in different partitions, in tables whose join with the counts is broadcast only at run time, are found."""
    rng = np.random.default_rng(3)
    one = np.unique(rng.integers(0, 1 << 62, 20_000))
    two = one ^ 1 << rng.integers(0, 62, len(one)) ^ 1 << rng.integers(0, 62, len(one))
    rows = cut(spark.createDataFrame([(int(f),) for f in rng.permutation(np.concatenate([one, two]))], "fp long").repartition(8))
    got = {r["node"]: r["root"] for r in components(simhash.links(rows)).collect()}
    assert all(got.get(a, a) == got.get(b, b) for a, b in zip(one.tolist(), two.tolist()))
