"""Rolling windows: the skip list against a sorted list, windows against brute force."""

import bisect
import random

from pyspark.sql import functions as F

from tagloom.llm import rolling


def test_skip_list():
    rng = random.Random(1)
    ranks, plain = rolling.Ranks(), []
    for _ in range(6000):
        if plain and rng.random() < 0.48:
            value = rng.choice(plain)
            weight = rng.randint(1, plain.count(value))
            ranks.remove(value, weight)
            for _ in range(weight):
                plain.remove(value)
        else:
            value, weight = rng.choice([rng.randint(0, 200), rng.randint(0, 10**12)]), rng.randint(1, 3)
            ranks.add(value, weight)
            for _ in range(weight):
                bisect.insort(plain, value)
        assert ranks.total == len(plain)
        if plain:
            rank = rng.randint(1, len(plain))
            assert ranks.at(rank) == plain[rank - 1]
    node, spans = ranks.head, 0
    while node is not None:
        spans, node = spans + node[3][0], node[2][0]
    assert spans == len(plain)


def brute(rows, widths):
    out = []
    for i, key, time, _, _ in rows:
        for w in widths:
            own = [r for r in rows if r[1] == key and time is not None and r[2] is not None and time - w <= r[2] < time]
            values = sorted(r[3] for r in own if r[3] is not None)
            at = lambda a, b: values[-(-a * len(values) // b) - 1] if values else None  # noqa: B023, E731
            out.append((i, w, time, len(own), sum(values), len({r[4] for r in own if r[4] is not None}), at(1, 2), at(99, 100)))
    return sorted(out, key=str)


def test_windows(spark):
    rng = random.Random(7)
    keys = ["a"] * 6 + ["b", None]
    rows = [(i, rng.choice(keys), rng.choice([None, *range(-900, 4000, 60)] if i % 9 else [0]), rng.choice([None, 0, 5, 5, rng.randint(0, 1000)]), rng.choice([None, "x", "y", "z"])) for i in range(400)]
    rows += rows[:20] + [(None, "a", 60, 3, "x"), (1000, "b", 10**12, 1, "x"), (1001, "b", 10**12 + 1, 1, "x")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "id long, source string, t long, v long, l string, window string, key int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = rolling.features(df, "source", "t", "v", "l", [120, 1000], [(1, 2), (99, 100)], ["id"])
        got = sorted(((r["id"], r["window"], r["_time"], r["n"], r["sum"], r["labels"], r["q0"], r["q1"]) for r in found.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows, [120, 1000])
    assert rolling.features(df.limit(0), "source", "t", "v", "l", [120], [(1, 2)], ["id"]).count() == 0
    kept = rolling.features(df.filter("id = 50"), "source", "t", "v", "l", [120], [(1, 2)], ["key", "window", "l"])
    assert kept.columns == ["key", "window", "l", "_time", "window", "n", "sum", "labels", "q0"] and kept.count() == 1


def test_one_time_holds_a_third_of_all_rows(spark):
    df = spark.range(3000).select(F.lit("s").alias("k"), F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("t"), F.lit(7).alias("v"))
    r = rolling.features(df, "k", "t", "v", "cast(null as string)", [2000], [(1, 2)], ["t"]).groupBy("t").agg(F.max("n").alias("n"), F.count("*").alias("rows")).collect()
    times = [0] * 1000 + list(range(1000, 3000))
    want = {t: (bisect.bisect_left(times, t) - bisect.bisect_left(times, t - 2000), times.count(t)) for t in set(times)}
    assert {x["t"]: (x["n"], x["rows"]) for x in r} == want
