"""Rates meet their targets, and agree with a solver in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import mixing


def plain_rates(n, p, wanted, rounds=20_000):
    """Projected gradient in numpy, small steps, the metric of each row's tokens."""
    r = np.ones(len(n))
    step = 1 / np.linalg.eigvalsh((p * n[:, None]).T @ p)[-1]
    for _ in range(rounds):
        r = np.maximum(0, r - step * p @ ((r * n) @ p - wanted))
    return r


@pytest.mark.parametrize("share", [[0.5, 0.3, 0.2], [0.98, 0.01, 0.01]])
def test_rates(spark, share):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.2, 0.2, 0.2], 300)
    n = rng.integers(1, 500, 300)
    light = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "tokens long, _p0 double, _p1 double, _p2 double")
    wanted = [float(n.sum() * s) for s in share]
    rows = mixing.rates(light, 3, wanted).collect()
    got, n, p = np.array([r["rate"] for r in rows]), np.array([r["tokens"] for r in rows]), np.array([[r["_p0"], r["_p1"], r["_p2"]] for r in rows])
    assert (got >= 0).all()
    slow = plain_rates(n, p, np.array(wanted))
    gap = lambda r: np.abs((r * n) @ p - wanted).max()
    assert gap(got) <= gap(slow) + 1e-3 * n.sum()


def test_mix(spark):
    rng = np.random.default_rng(2)
    text = lambda kind, k: " ".join(rng.choice([f"{kind}{i}" for i in range(20)] + ["the", "of"], k))
    rows = [(i, text("a" if i % 4 else "b", int(rng.integers(5, 90))), "v", 1.0) for i in range(400)]
    rows += [(1000, None, "v", 1.0), (1001, "", "v", 1.0), (None, text("a", 9), None, 1.0), (1002, text("b", 5000), "v", 1.0), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domains string, rate double")
    labelled = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(0, 400, 2)] + [(1, None), (None, "a"), (3, "a"), (3, "b")], "doc_id long, domain string")
    got = mixing.mix(docs, labelled, {"a": 0.5, "b": 0.5}).collect()
    assert len(got) == len(rows)
    total = {"a": 0.0, "b": 0.0}
    for r in got:
        for d in r["domains"]:
            total[d["domain"]] += r["rate"] * r["tokens"] * d["chance"]
        assert r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)
    assert total["a"] == pytest.approx(total["b"], rel=1e-3)
    told = {r["doc_id"]: {d["domain"]: d["chance"] for d in r["domains"]} for r in got}
    right = sum((told[i]["a"] > 0.5) == bool(i % 4) for i in range(1, 400, 2))
    assert right >= 195
    assert mixing.mix(docs.limit(0), labelled, {"a": 1.0}).count() == 0


def test_lowest_rates(spark):
    rng = np.random.default_rng(9)
    p = rng.dirichlet([0.3, 0.1, 0.1], 200)
    n = rng.integers(1, 300, 200)
    light = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "tokens long, _p0 double, _p1 double, _p2 double")
    held = (p * n[:, None]).sum(0)
    wanted = [float(1.1 * held[0]), float(0.3 * held[1]), float(0.3 * held[2])]
    rows = mixing.rates(light, 3, wanted, least=F.when(F.col("_p0") >= 0.5, 1.0).otherwise(0.0)).collect()
    assert all(r["rate"] >= (1 if r["_p0"] >= 0.5 else 0) for r in rows)
    got = [sum(r["rate"] * r["tokens"] * r[f"_p{k}"] for r in rows) for k in range(3)]
    assert np.linalg.norm(np.array(got) - wanted) < 0.5 * np.linalg.norm(held - wanted)


def test_labels_and_their_lack(spark):
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 5} the", "x") for i in range(60)] + [(None, "a1 the", "y")], "doc_id long, text string, _also string")
    labelled = spark.createDataFrame([(i, "odd" if i % 2 else "even") for i in range(40)], "doc_id long, domain string")
    light, domains = mixing.prepared(docs, labelled)
    assert domains == ["even", "odd"] and light.count() == 61
    assert all(r[f"_p{r['doc_id'] % 2}"] == 1.0 for r in light.collect() if r["doc_id"] is not None and r["doc_id"] < 40)
    none = mixing.mix(docs, labelled.limit(0), {"odd": 1.0}).collect()
    assert len(none) == 61 and all(r["rate"] == 1.0 and r["copies"] == 1 for r in none)
