"""Readers and writers of posting tables, dictionaries and documents."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8", "gbk", "gb18030")
EXTENSIONS = (".csv", ".xlsx", ".xls", ".json")


def read_csv(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """A CSV of quoted, maybe many-lined cells, all as strings, in the first encoding that reads it without damage.

    Chinese encodings need the session's setting for all of Java's character sets, which is switched on.
    """
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    for encoding in encodings:
        df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding=encoding)
        df = df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})
        if any("�" in c for c in df.columns):
            continue
        broken = F.lit(False)
        for c in df.columns:
            broken = broken | F.coalesce(F.contains(F.col(c), F.lit("�")), F.lit(False))
        if df.filter(broken).isEmpty():
            return df
    raise ValueError(f"{path} is in none of {', '.join(encodings)}")


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """One sheet, through pandas on the driver; needs a library for the format."""
    frame = pd.read_excel(path, sheet_name=sheet, dtype=str)
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"`{c}` string" for c in frame.columns))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """By the named kind, else the path's extension."""
    ext = f".{kind.lstrip('.')}" if kind else Path(path).suffix.lower()
    if ext not in EXTENSIONS:
        raise ValueError(f"{ext or path} is none of {', '.join(EXTENSIONS)}")
    return {".csv": read_csv, ".json": read_json}.get(ext, read_excel)(spark, path, **options)


def as_text(df: DataFrame) -> DataFrame:
    """All columns as strings, null as ""."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """One header a file, lists as text, the table replaced."""
    flat = df.select(*[(F.array_join(c, "，") if t.startswith("array<string") else F.col(c)).alias(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def checkpoint_table(df: DataFrame, root: str, name: str, stamp: str) -> str:
    """A named Parquet table under a time stamp; returns its path."""
    path = f"{root}/{name}/{stamp}"
    df.write.parquet(path)
    return path


def load_words(path: str) -> set[str]:
    """One word a line, lower case; none if the file lacks."""
    file = Path(path)
    return {w.strip().lower() for w in file.read_text(encoding="utf-8").splitlines() if w.strip()} if file.exists() else set()


def load_dictionary(path: str) -> dict:
    """A JSON object; an empty one if the file lacks or is broken."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}
