"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's key is hashed into one of ``slots`` virtual slots, a number that never changes.
Bytes and rows are aggregated by slot (partial sums before the shuffle, one row a slot on
the driver), and a map gives each slot its shard. Rebalancing edits the map: only slots
move, and every edit is a new version that is stored beside the older ones.

A slot that holds more than a hundredth of a shard, as of a key that many records share or
lack, is dealt out: its records go to slots by a hash of key, text and place, so no key is
too large for the shards to be equal.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_right, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_dir

SLOTS = 1 << 14
#: Of a shard's mean size: slots above it are dealt out.
HOT = 0.01


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot] under a version."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def loads(self, size_of: dict[int, int]) -> list[int]:
        out = [0] * self.shards
        for slot, size in size_of.items():
            out[self.shard_of[slot]] += size
        return out


def even_map(shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 1 before anything is known of the records: slots in turn."""
    return SlotMap(1, shards, tuple(s % shards for s in range(slots)))


def first_map(size_of: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 1: slots by falling size, each to the shard with the fewest bytes, then slots."""
    heap = [(0, 0, s) for s in range(shards)]
    shard_of = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-size_of.get(s, 0), s)):
        load, held, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + size_of.get(slot, 0), held + 1, shard))
    return SlotMap(1, shards, tuple(shard_of))


def rebalanced(old: SlotMap, size_of: dict[int, int], shards: int | None = None, slack: float = 0.01) -> SlotMap:
    """The next version, for other sizes or another number of shards.

    Slots leave shards that are gone or hold over (1 + slack) of the mean, and then go from
    the fullest shard to the emptiest as long as that brings them together; all others stay.
    """
    shards = shards or old.shards
    shard_of, mean = list(old.shard_of), sum(size_of.values()) / shards
    load, held = [0] * shards, [[] for _ in range(shards)]
    homeless = []
    for slot, shard in enumerate(shard_of):
        if shard < shards:
            held[shard].append(slot)
            load[shard] += size_of.get(slot, 0)
        else:
            homeless.append(slot)
    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda s: (-size_of.get(s, 0), s)):
            size = size_of.get(slot, 0)
            if load[shard] > mean * (1 + slack) and size and load[shard] - size >= mean * (1 - slack):
                load[shard] -= size
                homeless.append(slot)
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(homeless, key=lambda s: (-size_of.get(s, 0), s)):
        at, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (at + size_of.get(slot, 0), shard))
    levelled(shard_of, size_of, shards, mean * slack)
    return SlotMap(old.version + 1, shards, tuple(shard_of))


def levelled(shard_of: list[int], size_of: dict[int, int], shards: int, spread: float) -> None:
    """Move single slots from the fullest shard to the emptiest, each nearest to half their difference, until they are within ``spread``."""
    held = [[] for _ in range(shards)]
    for slot, size in size_of.items():
        if size:
            insort(held[shard_of[slot]], (size, slot))
    load = [sum(size for size, _ in h) for h in held]
    for _ in range(64 * shards):
        full, empty = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[full] - load[empty]
        at = bisect_right(held[full], (gap / 2, len(shard_of)))
        near = [x for x in held[full][max(at - 1, 0) : at + 1] if x[0] < gap]
        if gap <= spread or not near:
            break
        size, slot = min(near, key=lambda x: abs(x[0] - gap / 2))
        held[full].remove((size, slot))
        insort(held[empty], (size, slot))
        shard_of[slot] = empty
        load[full] -= size
        load[empty] += size


def map_table(spark: SparkSession, slot_map: SlotMap) -> DataFrame:
    """version, shards, slot, shard: at most as many rows as there are slots."""
    rows = [(slot_map.version, slot_map.shards, slot, shard) for slot, shard in enumerate(slot_map.shard_of)]
    return spark.createDataFrame(rows, "version int, shards int, slot int, shard int")


def store_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Add a version to the stored map; older versions stay."""
    map_table(spark, slot_map).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the newest if none is named."""
    stored = spark.read.parquet(path)
    version = version or stored.agg(F.max("version")).first()[0]
    rows = stored.filter(F.col("version") == version).orderBy("slot").collect()
    return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def slotted(records: DataFrame, key: str, slots: int = SLOTS) -> DataFrame:
    """With virtual_slot, the hash of the key; records of a key stay together."""
    return records.withColumn("virtual_slot", F.pmod(F.xxhash64(key), F.lit(slots)).cast("int"))


def slot_sizes(records: DataFrame, size: str) -> dict[int, tuple[int, int]]:
    """Bytes and rows by virtual slot; the driver gets a row a slot."""
    rows = records.groupBy("virtual_slot").agg(F.sum(size).alias("b"), F.count("*").alias("n")).collect()
    return {r["virtual_slot"]: (r["b"], r["n"]) for r in rows}


def shard(docs: DataFrame, shards: int, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, position, map_version of every document.

    size: UTF-8 bytes of the text (null: none) plus 8. Documents are hashed by doc_id, so
    equal texts spread like others; ids that many rows share, or lack, are dealt out where
    they make a slot hot. Positions count from 0 within a shard without gaps. Repeated rows are
    rows like others; an empty table gives no rows; other columns are ignored. The map is
    stored under ``path``, a new folder of the shared one if None: where there is none yet,
    version 1 is the even map; the newest is edited for the sizes found, stored as the next
    version, loaded, and documents are placed by it.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    light = cut(slotted(light, "doc_id", slots))
    found = slot_sizes(light, "size")
    most = HOT * sum(b for b, _ in found.values()) / shards
    hot = [s for s, (b, n) in found.items() if b > most and n > 1]  # at most shards / HOT
    if hot:
        dealt = F.pmod(F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()), F.lit(slots)).cast("int")
        light = cut(light.withColumn("virtual_slot", F.when(F.col("virtual_slot").isin(hot), dealt).otherwise(F.col("virtual_slot"))))
        found = slot_sizes(light, "size")
    known = path is not None
    path = path or f"{shared_dir(spark)}/slots-{uuid.uuid4().hex}"
    if not known:
        store_map(spark, even_map(shards, slots), path)
    store_map(spark, rebalanced(load_map(spark, path), {s: b for s, (b, _) in found.items()}, shards), path)
    slot_map = load_map(spark, path)
    base, at = [], [0] * slot_map.shards
    for slot, to in enumerate(slot_map.shard_of):
        base.append((slot, to, at[to]))
        at[to] += found.get(slot, (0, 0))[1]
    where = spark.createDataFrame(base, "virtual_slot int, shard int, base long")
    row = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return (
        light.withColumn("row", row)
        .join(F.broadcast(where), "virtual_slot")  # as many rows as slots, a fixed number
        .select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("base") + F.col("row") - 1).alias("position"), F.lit(slot_map.version).alias("map_version"))
    )
