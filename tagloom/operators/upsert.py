"""Keyed tables of captured postings: row keys, merges, imports, deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_html_text, safe


def row_key(df: DataFrame, detail_url: str = "detail_url", page_url: str = "page_url", others: tuple[str, ...] = ("title", "company", "city", "detail")) -> Column:
    """url: and the detail or page address, else hash: and the md5 of the other fields; columns that lack are blank."""
    have = lambda c: safe(c) if c in df.columns else F.lit("")
    url = F.coalesce(F.nullif(have(detail_url), F.lit("")), F.nullif(have(page_url), F.lit("")))
    clean = [clean_html_text(F.col(c), keep_lines=True) if c in df.columns else F.lit("") for c in others]
    return F.coalesce(F.concat(F.lit("url:"), url), F.concat(F.lit("hash:"), F.md5(F.concat_ws("|", *clean))))


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key, the last in order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_turn", F.row_number().over(w)).filter("_turn = 1").drop("_turn")


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(F.asc(order))
    return df.withColumn("_turn", F.row_number().over(w)).filter("_turn = 1").drop("_turn")


def replaced(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """base without the keys of new, and new; columns are united."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def merge(base: DataFrame, new: DataFrame, mode: str, key: str, order: str) -> DataFrame:
    """merge_update: new rows win; append_new: only new keys come in; overwrite: new rows alone. One row a key, the last."""
    new = last_of(new, [key], order)
    if mode == "overwrite":
        return new
    base = last_of(base, [key], order)
    if mode == "merge_update":
        return replaced(base, new, [key])
    if mode == "append_new":
        return base.unionByName(new.join(base.select(key), key, "left_anti"), allowMissingColumns=True)
    raise ValueError(f"unknown mode {mode}")


def import_summary(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing, imported, final, updated, duplicates of a merge, in one aggregation over keys."""
    rows = base.select(key, F.lit(1).alias("b"), F.lit(0).alias("n")).union(new.select(key, F.lit(0), F.lit(1)))
    keys = rows.groupBy(key).agg(F.max("b").alias("b"), F.sum("n").alias("n"))
    return keys.agg(F.sum("b").cast("long").alias("existing"), F.sum("n").cast("long").alias("imported"), F.count("*").alias("final"), F.count_if(F.expr("b = 1 and n > 0")).alias("updated"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).cast("long").alias("duplicates"))


def status(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new with status: updated where the key is known, else created."""
    known = base.select(key).distinct().withColumn("_known", F.lit(True))
    return new.join(known, key, "left").withColumn("status", F.when(F.col("_known"), "updated").otherwise("created")).drop("_known")


def deleted(base: DataFrame, key: str, value: str) -> DataFrame:
    """base without a key's rows; rows without a key stay."""
    return base.filter(~F.col(key).eqNullSafe(F.lit(value)))
