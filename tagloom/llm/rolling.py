"""Rolling window features: counts, sums and order statistics of what happened shortly before.

Every event has a key and a time in whole seconds; its window of W seconds holds the events
of its key with time - W <= their time < time. All events of a key and time share a window,
so windows are found once a (key, time), and values that repeat there are one entry with a
count. A key's time is cut into chunks as long as the longest window; a chunk's task gets the
entries of the chunk and of the one before it. However many events a key has, a task holds the
distinct (time, value, label) of two chunks and no more.

Inside a chunk entries come in order of time. Each window is a sliding multiset in an
indexable skip list: every link knows how much weight it spans, so the value of a rank is found
by walking spans. When a new time begins, entries older than the window leave, the ranks are
read, and then the time's own entries go in.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Links of the tallest node; with a quarter of the nodes a level higher, enough for 4 ** 16 values.
LEVELS = 16


class Ranks:
    """A multiset of integers with the value of a rank: an indexable skip list.

    A node is [value, weight, next nodes, spans]; span i is the weight of the nodes behind
    this one up to and with next node i, or to the end. Heights follow from the values' own
    bits, so the same values always make the same list.
    """

    def __init__(self):
        self.head, self.total, self.top = [None, 0, [None], [0]], 0, 1

    @staticmethod
    def height(value: int) -> int:
        bits = ((value ^ value >> 31) * 0x9E3779B97F4A7C15 >> 16) & 0xFFFFFFFF
        high = 1
        while high < LEVELS and not bits & 3:
            bits >>= 2
            high += 1
        return high

    def path(self, value: int) -> tuple[list, list]:
        """The last node before value on each level, and the weight up to and with it."""
        node, before, at, seen = self.head, 0, [None] * self.top, [0] * self.top
        for level in range(self.top - 1, -1, -1):
            after = node[2][level]
            while after is not None and after[0] < value:
                before += node[3][level]
                node, after = after, after[2][level]
            at[level], seen[level] = node, before
        return at, seen

    def add(self, value: int, weight: int) -> None:
        at, seen = self.path(value)
        node = at[0][2][0]
        if node is not None and node[0] == value:
            node[1] += weight
            high = 0
        else:
            high = self.height(value)
            while self.top < high:
                self.head[2].append(None)
                self.head[3].append(self.total)
                self.top += 1
                at.append(self.head)
                seen.append(0)
            node = [value, weight, [None] * high, [0] * high]
        for level in range(high):
            last = at[level]
            node[2][level] = last[2][level]
            node[3][level] = seen[level] + last[3][level] - seen[0]
            last[2][level] = node
            last[3][level] = seen[0] - seen[level] + weight
        for level in range(high, self.top):
            at[level][3][level] += weight
        self.total += weight

    def remove(self, value: int, weight: int) -> None:
        """Take weight off a value that is there."""
        at, _ = self.path(value)
        node = at[0][2][0]
        node[1] -= weight
        for level in range(self.top):
            at[level][3][level] -= weight
        if not node[1]:
            for level in range(len(node[2])):
                at[level][2][level] = node[2][level]
                at[level][3][level] += node[3][level]
        self.total -= weight

    def at(self, rank: int) -> int:
        """The value of a rank from 1 to total."""
        node = self.head
        for level in range(self.top - 1, -1, -1):
            while node[2][level] is not None and node[3][level] < rank:
                rank -= node[3][level]
                node = node[2][level]
        return node[2][0][0]


class Window:
    """The entries of the last ``width`` seconds."""

    def __init__(self, width: int):
        self.width, self.ranks, self.labels, self.entries, self.n, self.sum = width, Ranks(), {}, deque(), 0, 0

    def add(self, time: int, value: int, label: object, n: int) -> None:
        self.entries.append((time, value, label, n))
        self.n += n
        if value >= 0:
            self.ranks.add(value, n)
            self.sum += value * n
        if label is not None:
            self.labels[label] = self.labels.get(label, 0) + n

    def expire(self, time: int) -> None:
        """Let go of entries before time - width."""
        first = time - self.width
        while self.entries and self.entries[0][0] < first:
            _, value, label, n = self.entries.popleft()
            self.n -= n
            if value >= 0:
                self.ranks.remove(value, n)
                self.sum -= value * n
            if label is not None:
                left = self.labels[label] - n
                if left:
                    self.labels[label] = left
                else:
                    del self.labels[label]

    def read(self, quantiles: list[tuple[int, int]]) -> list:
        m = self.ranks.total
        return [self.n, self.sum, len(self.labels), *[self.ranks.at(-(-a * m // b)) if m else None for a, b in quantiles]]


def slid(frames: Iterator[pd.DataFrame], widths: list[int], quantiles: list[tuple[int, int]], names: list[str]) -> Iterator[pd.DataFrame]:
    """A row a key and time of each chunk: frames come sorted by key, chunk and time, and a chunk may span frames."""
    key, windows, last = (), [], None
    for frame in frames:
        out: list[list] = []
        for source, chunk, own, time, value, label, n in zip(*[frame[c].tolist() for c in ("key", "chunk", "own", "time", "value", "label", "n")]):
            if (source, chunk) != key:
                key, windows, last = (source, chunk), [Window(w) for w in widths], None
            if own and time != last:
                last = time
                row = [source, time]
                for w in windows:
                    w.expire(time)
                    row += w.read(quantiles)
                out.append(row)
            for w in windows:
                if own or time >= chunk * max(widths) - w.width:
                    w.add(time, value, label, n)
        found = pd.DataFrame(out, columns=["key", "time", *names])
        yield found.astype({c: "Int64" for c in names} | {"time": "int64"})


def windows_of(events: DataFrame, widths: list[int], quantiles: list[tuple[int, int]]) -> DataFrame:
    """key, time and windows, an array in the order of widths: structs of window, n, sum, labels and q0, q1, ...

    events has key (string), time (long), value (long, not negative) and label (string). A
    row a key and time; rows without a time are in no window and have none.
    """
    ship(events.sparkSession)
    chunk = max(widths)
    at = F.expr(f"(time - pmod(time, {chunk}L)) div {chunk}")
    entries = events.filter("time is not null").groupBy("key", "time", F.coalesce("value", F.lit(-1)).alias("value"), "label").agg(F.count("*").alias("n"))
    twice = entries.withColumn("chunk", at).withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("chunk", F.when(F.col("own"), F.col("chunk")).otherwise(F.col("chunk") + 1))
    parts = ["n", "sum", "labels", *[f"q{i}" for i in range(len(quantiles))]]
    names = [f"{p}_{i}" for i in range(len(widths)) for p in parts]
    ordered = twice.select("key", "chunk", "own", "time", "value", "label", "n").repartition("key", "chunk").sortWithinPartitions("key", "chunk", "time")
    found = ordered.mapInPandas(lambda frames: slid(frames, widths, quantiles, names), "key string, time long, " + ", ".join(f"{c} long" for c in names))
    each = [F.struct(F.lit(w).cast("long").alias("window"), *[F.col(f"{p}_{i}").alias(p) for p in parts]) for i, w in enumerate(widths)]
    return found.select("key", "time", F.array(*each).alias("windows"))


def features(rows: DataFrame, key: str, time: str, value: str, label: str, widths: list[int], quantiles: list[tuple[int, int]], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of rows beside _time, window, n, sum, labels and q0, q1, ...: a row for each row and width.

    ``key``, ``time``, ``value`` and ``label`` are SQL expressions over rows: a string (null is
    one key), whole seconds, a whole number of 0 or more, a string. n counts the window's rows,
    sum adds up their values (0 if there are none), labels counts their distinct labels. The
    quantile (a, b) is number ceil(a * m / b) of the window's m values in order, repeats kept;
    null if there are none. A row without a time is in no window and has empty windows; null
    values and labels count as rows alone. Repeated rows are rows like others. Rows of one key
    and time may be many: they are summed up before the shuffle, and the join that brings the
    windows back may be split. An empty table gives no rows; other columns are ignored.
    """
    as_long = lambda e: F.expr(e).cast("long")
    own = rows.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.expr(key).cast("string").alias("key"), as_long(time).alias("time"))
    events = rows.select(F.expr(key).cast("string").alias("key"), as_long(time).alias("time"), as_long(value).alias("value"), F.expr(label).cast("string").alias("label"))
    found = windows_of(events, widths, quantiles)
    right = found.withColumnsRenamed({"key": "_key", "time": "_time"})
    joined = own.join(right.hint("merge"), F.col("key").eqNullSafe(F.col("_key")) & (F.col("time") == F.col("_time")), "left")
    none = F.array(*[F.struct(F.lit(w).cast("long").alias("window"), *[F.lit(0).cast("long").alias(p) for p in ("n", "sum", "labels")], *[F.lit(None).cast("long").alias(f"q{i}") for i in range(len(quantiles))]) for w in widths])
    spread = joined.select(*[F.col(f"_k{i}") for i in range(len(keep))], "time", F.coalesce("windows", none).alias("windows"))
    return spread.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("time").alias("_time"), F.inline("windows"))
