"""What the operators of this package share: query input, and the library's lineage helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import bucketed, cut, discarded, dropped, saved, shared_dir, ship

__all__ = ["bucketed", "cut", "discarded", "dropped", "free", "saved", "shared_dir", "ship", "table", "whole_ids"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table by the path that Spark's readers open."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_ids(docs: DataFrame) -> DataFrame:
    """doc_id (0 for null), none (whether it is null), text: a column with nulls would reach pandas as floats, which lose large ids."""
    own = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(own, F.lit(0)).alias("doc_id"), own.isNull().alias("none"), F.col("text").cast("string").alias("text"))
