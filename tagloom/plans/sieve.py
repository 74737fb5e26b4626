"""Rows that a join on a key can concern, told from all others before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bits of one row of the map, as bitmap_construct_agg has them; rows of it at most (32 MB)
WIDTH, MOST = 32_768, 8_192


def sieved(rows: DataFrame, key: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose key may be in wanted's column key, and the others, none of whose is. No row has a null key.

    A broadcast map has 16 bits for each wanted key, so one in 16 of the other rows is among the
    first, at most; more where the map is at its largest. An exact join has to follow on those.
    """
    size = WIDTH * min(MOST, max(1, -(-16 * wanted.count() // WIDTH)))
    taken, names = {c.lower() for c in rows.columns}, []
    for name in ("_place", "_part", "_bits"):
        while name in taken:
            name += "_"
        names.append(name)
    place, part, bits = names
    placed = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    held = wanted.select(placed("key").alias(place)).groupBy(F.floor(F.col(place) / WIDTH).alias(part)).agg(F.bitmap_construct_agg(F.col(place) % WIDTH).alias(bits))
    own = rows.withColumn(place, placed(key)).withColumn(part, F.floor(F.col(place) / WIDTH)).join(F.broadcast(held), part, "left")
    at = F.col(place) % WIDTH
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return own.filter(may).select(rows.columns), own.filter(~may).select(rows.columns)
