"""Near-duplicates of five-word shingles against the exact similarity of all pairs."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tagloom.llm import similar
from tagloom.plans.sieve import sieved

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(2000)]
    out = ["", "two words", "Two  words", "three other words"]
    for _ in range(30):
        own = list(rng.choice(words, 120))
        out.append(" ".join(own))
        for changed in (1, 2, 3, 5):  # similarities on both sides of 0.8
            own = list(own)
            for at in rng.choice(120, changed, replace=False):
                own[at] = "other"
            out.append(" ".join(own))
    return out


def plain(all_texts):
    """The smallest position that links at 0.8 reach."""
    sets = [similar.shingles(t) for t in all_texts]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if similar.jaccard(sets[i], sets[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_groups_of_exact_similarity(spark):
    own = texts()
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(own)]
    label = plain(own)
    assert len(set(label)) < len(own) - 30
    got = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(label))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_rows_are_decided_on_by_text(spark):
    """Null and shared doc_ids do not make different texts one document."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(30)) for k in "abcd")
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (None, d), (3, c + " more"), (5, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = corpus_pipeline.one_of_each(spark, docs, "").collect()
    want = [(None, a), (None, b), (3, c + " more"), (5, d)]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted((i or 0, t) for i, t in want)


def test_prefix_pairs_hold_all_links_and_few_others(spark):
    """Sets that share most of an origin, but not enough with each other, are no pairs; every link across roots is."""
    rng = np.random.default_rng(4)
    sets, fresh = [], iter(range(10_000, 1_000_000))
    for k in range(60):  # of 200, each has its own places changed: similarities around 0.6
        own = np.arange(200)
        own[rng.choice(200, 50, replace=False)] = [next(fresh) for _ in range(50)]
        sets.append(own)
    for k in range(40):  # on both sides of 0.8, of different sizes
        own = np.arange(1000 + 100 * (k // 8), 1100 + 100 * (k // 8))
        at = rng.choice(100, rng.integers(1, 12), replace=False)
        own[at] = [next(fresh) for _ in at]
        sets.append(np.unique(own)[: int(rng.integers(80, 100))])
    keys = [f"k{i:03}" for i in range(len(sets))]
    root = lambda i: keys[i - i % 2] if i % 3 else keys[i]
    rows = spark.createDataFrame([(keys[i], root(i), [int(x) for x in s]) for i, s in enumerate(sets)], "key string, root string, shingles array<long>")
    got = {(r["a"], r["b"]) for r in similar.prefix_pairs(rows, 0.8).collect()}
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if root(i) != root(j)]
    want = {(keys[i], keys[j]) for i, j in pairs if similar.jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8}
    assert want and want <= got
    assert not any(a < "k060" for a, _ in got) and len(got) < 5 * len(want)


def shuffled(spark):
    """Bytes of all shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_without_copies_are_not_shuffled(spark):
    """Only texts that are compared, and rows of groups of several, go through a shuffle."""
    rng = np.random.default_rng(6)
    own = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 2000)) for _ in range(200)]
    own += [own[0], own[1] + " more"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(own)], SCHEMA)
    before = shuffled(spark)
    got = corpus_pipeline.one_of_each(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(200)) and all(r["text"] == own[r["doc_id"]] for r in got)
    assert 0 < shuffled(spark) - before < 0.5 * sum(map(len, own))


def test_sieve_loses_no_wanted_row(spark):
    rows = spark.range(100_000).selectExpr("cast(id as string) as k", "id as _part", "id as _bits")
    wanted = rows.filter("_part % 20 = 3 or _part < 64").selectExpr("k as key")
    may, others = (x.collect() for x in sieved(rows, F.col("k"), wanted))
    keys = {r["key"] for r in wanted.collect()}
    assert keys <= {r["k"] for r in may} and len(may) < len(keys) + 100_000 / 12
    assert sorted(int(r["k"]) for r in may + others) == list(range(100_000)) and all(int(r["k"]) == r["_bits"] for r in may + others)
    none, all_ = sieved(rows, F.col("k"), wanted.limit(0))
    assert none.count() == 0 and all_.count() == 100_000
