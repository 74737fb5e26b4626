"""Slots, the versioned map and the placement of documents."""

import zlib
from collections import Counter

from tagloom.llm import sharding


def test_placement(spark, tmp_path):
    rows = [(i, None if i % 9 == 0 else "ä" * (i % 50) + "x", f"v{i}", "s") for i in range(400)] + [(None, "", "v", "s")] * 2 + [(3, "xyz", "v", "s")] * 3 + [(1000, "long " * 2000, "v", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, virtual_slot string, shard string")
    got = sharding.shard(docs, 5, slots=64).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    for s in range(5):
        own = sorted(r["position"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    assert len({(r["virtual_slot"], r["shard"]) for r in got}) == len({r["virtual_slot"] for r in got})
    assert sharding.shard(docs.limit(0), 5).count() == 0


def test_sizes_near_equal():
    size_of = {s: 100 + s % 37 for s in range(2000)}
    loads = sharding.first_map(size_of, 24, 2048).loads(size_of)
    assert max(loads) - min(loads) <= 137


def test_map_versions(spark, tmp_path):
    size_of = {s: 100 + s % 37 for s in range(2000)}
    one = sharding.first_map(size_of, 8, 2048)
    two = sharding.rebalanced(one, size_of, 9)
    moved = [s for s in range(2048) if one.shard_of[s] != two.shard_of[s]]
    assert two.version == 2 and {two.shard_of[s] for s in moved} == {8}
    loads = two.loads(size_of)
    assert max(loads) < 1.03 * sum(loads) / 9
    three = sharding.rebalanced(two, size_of, 7)
    assert set(three.shard_of) <= set(range(7)) and all(a == b for a, b in zip(two.shard_of, three.shard_of) if a < 7 and size_of.get(a))
    path = str(tmp_path / "map")
    for m in (one, two, three):
        sharding.store_map(spark, m, path)
    assert sharding.load_map(spark, path) == three and sharding.load_map(spark, path, 1) == one


def test_hot_keys_are_dealt_out(spark):
    """2,000 rows without an id, all the same, and 500 that share one: shards stay within a hundredth."""
    rows = [(None, "same text")] * 2000 + [(7, "shared " * (i % 9)) for i in range(500)] + [(i, "x" * (i % 40)) for i in range(10_000, 22_000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    load, count = Counter(), Counter()
    for r in got:
        load[r["shard"]] += r["size"]
        count[r["shard"]] += 1
    mean = sum(load.values()) / 24
    assert len(got) == len(rows) and max(load.values()) < 1.01 * mean and min(load.values()) > 0.99 * mean
    assert {s: sorted(r["position"] for r in got if r["shard"] == s) for s in count} == {s: list(range(n)) for s, n in count.items()}
    assert {r["map_version"] for r in got} == {2}


def test_an_edited_map_is_kept(spark, tmp_path):
    """A second run edits the stored map: few slots move, and the older versions stay."""
    docs = spark.createDataFrame([(i, "x" * (i % 90)) for i in range(20_000)], "doc_id long, text string")
    path = str(tmp_path / "map")
    sharding.store_map(spark, sharding.even_map(8), path)
    one = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, 8, path=path).collect()}
    two = {r["doc_id"]: (r["shard"], r["map_version"]) for r in sharding.shard(docs, 9, path=path).collect()}
    assert {v for _, v in two.values()} == {3}
    moved = [d for d in one if one[d] != two[d][0]]
    assert len(moved) < 0.15 * len(one)
    assert [sharding.load_map(spark, path, v).shards for v in (1, 2, 3)] == [8, 8, 9]
