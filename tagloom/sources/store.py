"""Tables kept between runs: processed results by signature, checkpoints, the knowledge base."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.kb import document_id
from ..operators.stats import signature
from ..operators.upsert import replaced


def processing_key(version: str, jobs: DataFrame, options: dict) -> str:
    """md5 of a version, the table's order-insensitive signature and the options."""
    own = list(signature(jobs, jobs.columns).first())
    return hashlib.md5(json.dumps([version, *own, sorted(jobs.columns), options], sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table; None if it cannot be read."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def processed(spark: SparkSession, root: str, key: str, make, rebuild: bool = False) -> DataFrame:
    """The result stored under the key, or made, stored and read back."""
    path = f"{root}/{key}"
    found = None if rebuild else load(spark, path)
    if found is None:
        make().write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path)
    return found


def forget(spark: SparkSession, root: str, key: str) -> bool:
    """Delete a stored result; whether there was one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{key}")
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def ingest(index: DataFrame, documents: DataFrame, kind: str = "doc_type", name: str = "title", text: str = "text", captured: str = "created_at") -> DataFrame:
    """The document index with new documents in place of those with the same id, newest first."""
    new = documents.withColumn("doc_id", document_id(kind, name, text)).dropDuplicates(["doc_id"])
    return replaced(index, new, ["doc_id"]).orderBy(F.desc(captured), "doc_id")
