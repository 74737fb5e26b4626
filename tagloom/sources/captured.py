"""The life of captured postings: loaded or empty, enriched where new or changed, merged by key into versions."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_html_text
from ..operators import tags
from ..operators.upsert import row_key
from .artifacts import Artifacts
from .files import as_text, read_csv, write_csv

#: The columns of a captured posting.
COLUMNS = ["captured_at", "page_url", "title", "company", "city", "salary_raw", "salary", "experience", "degree", "address", "detail", "detail_url", "data_source"]
STATUSES = ("created", "updated", "unchanged")


def whole(df: DataFrame) -> DataFrame:
    """df as texts, the captured columns that lack added blank."""
    out = as_text(df)
    return out.withColumns({c: F.lit("") for c in COLUMNS if c not in out.columns})


def last_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last in order (of equals the one with the greatest values); summed up before the shuffle, so a key may have any number of rows."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_last")).select(key, "_last.*").select(df.columns)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A file of captures as texts with all captured columns, one row a posting, the file's last; empty if there is no file."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS))
    rows = whole(read_csv(spark, path)).withColumn("_turn", F.monotonically_increasing_id())
    return last_each(rows.withColumn("_key", row_key(rows)), "_key", "_turn").drop("_key", "_turn")


def write(df: DataFrame, path: str) -> None:
    """Write captures beside the file and swap: a reader finds the old table or the new one."""
    spark = df.sparkSession
    make = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    final, new, old = make(path), make(f"{path}.new"), make(f"{path}.old")
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    write_csv(df, f"{path}.new")
    fs.delete(old, True)
    if fs.exists(final):
        fs.rename(final, old)
    fs.rename(new, final)
    fs.delete(old, True)


def enricher(dictionary: dict, detail: str = "detail", text: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """Cleaned detail, then dictionary tags, then rule columns."""

    def run(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn(detail, clean_html_text(F.coalesce(detail, F.lit("")), keep_lines=True))
        rows = tags.apply_dictionary(rows, dictionary, F.col(detail) if text is None else text)
        rows = rows.withColumns({c: F.array().cast("array<string>") for c in tags.TYPES.values() if c not in rows.columns})
        return tags.apply_rules(rows, detail)

    return run


class Refreshed(NamedTuple):
    """The snapshot, its version, and n of each status: created, updated and unchanged captures, and kept ones that were not captured again."""

    table: DataFrame
    version: int
    counts: dict[str, int]


def fingerprint(columns: list[str]) -> Column:
    """A hash of a row's values, null apart from blank."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"c{i}") for i, c in enumerate(columns)])), 256)


def refresh(store: Artifacts, kind: str, captures: DataFrame, key: str, order: str, enrich: Callable[[DataFrame], DataFrame]) -> Refreshed:
    """Bring captures into the newest version of a snapshot.

    Of each key the last capture counts. It is compared with the snapshot by a fingerprint of
    all its values but ``order``; only new and changed ones are enriched, all others stay as
    they are. A version is written only if something changed. Rows without a key are left out.
    """
    raw = [c for c in captures.columns if c not in (key, order)]
    own = last_each(captures.filter(F.col(key).isNotNull()), key, order).withColumn("_print", fingerprint(raw))
    base = store.load(kind)
    known = base.select(F.col(key).alias("_known"), F.col("_print").alias("_was")) if base is not None else store.spark.createDataFrame([], "_known string, _was string")
    met = own.join(known, own[key] == known["_known"], "full").withColumn("_status", F.when(F.col(key).isNull(), "kept").when(F.col("_known").isNull(), "created").when(F.col("_print") != F.col("_was"), "updated").otherwise("unchanged"))
    counts = {s: 0 for s in (*STATUSES, "kept")} | {r["_status"]: r["count"] for r in met.groupBy("_status").count().collect()}
    if base is not None and not counts["created"] and not counts["updated"]:
        return Refreshed(base, store.records(kind)[0]["version"], counts)
    changed = met.filter(F.col("_status").isin("created", "updated"))
    new = enrich(changed.select(*captures.columns, "_print"))
    out = new if base is None else base.join(changed.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
    version = store.save(kind, out)["version"]
    return Refreshed(store.load(kind, version), version, counts)


def stage_counts(raw: DataFrame, processed: DataFrame, filtered: DataFrame) -> DataFrame:
    """stage, n: raw, processed, filtered and deduplicated rows."""
    from ..operators.dedup import deduped

    parts = [df.agg(F.count("*").alias("n")).select(F.lit(s).alias("stage"), "n") for s, df in (("raw", raw), ("processed", processed), ("filtered", filtered), ("deduped", deduped(filtered)))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])
