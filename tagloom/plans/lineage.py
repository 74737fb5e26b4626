"""How jobs reach workers and survive lost ones: the import path, and lineage cut by reliable checkpoints."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    On a cluster whose machines do not hold the repository at the same path, submit it with
    ``--py-files``; the path added here is then ignored.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a folder of our own only where that is unset."""
    sc = spark.sparkContext
    set_to = sc.getConf().get("spark.checkpoint.dir", None)
    if set_to:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(set_to)
        return set_to
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tagloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(f"file://{own}")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores: small rows lie in few files, however much work each of them is."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def saved(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read back: column-pruned, compressed, of known size.

    ``paths`` gets the folder, for discarded(). A checkpoint keeps the size that its plan was
    estimated at, which joins multiply; in a loop of joins that number doubles its digits every
    round until the driver has no room for it, so loops go through here.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tagloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that saved() wrote and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def bucketed(df: DataFrame, key: str, buckets: int) -> tuple[DataFrame, str]:
    """df stored in the warehouse, bucketed by key, and the table's name: grouping by the key needs no shuffle of it."""
    spark, name = df.sparkSession, f"tagloom_{uuid.uuid4().hex}"
    df.write.bucketBy(min(buckets, 100_000), key).saveAsTable(name)
    return spark.table(name), name


def dropped(name: str, spark: SparkSession | None = None) -> None:
    """Remove a table that bucketed() stored."""
    (spark or SparkSession.active()).sql(f"DROP TABLE IF EXISTS {name}")
