"""A live feed of captures: keyed upserts by micro-batch, and repeats dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upsert import last_of, replaced


def upsert_batches(stream: DataFrame, target: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces its keys' rows in the target, a folder of numbered snapshots.

    A batch reads the newest snapshot before it and writes its own number, so a batch that is
    run again after a failure writes the same snapshot again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = last_of(batch, [key], order)
        base = snapshot(spark, target, number - 1)
        out = new if base is None else replaced(base, new, [key])
        out.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, target: str, most: int | None = None) -> DataFrame | None:
    """The newest snapshot, not after batch ``most``; None if there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    numbers = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(folder) if f.getPath().getName().startswith("batch=")]
    numbers = [n for n in numbers if most is None or n <= most]
    return spark.read.parquet(f"{target}/batch={max(numbers)}") if numbers else None


def without_repeats(stream: DataFrame, time: str, key: str, delay: str = "10 minutes") -> DataFrame:
    """Each key once within the delay, the scalable form of a debounce."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def per_window(stream: DataFrame, time: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Captures by window, late ones within the delay included."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width)).agg(F.count("*").alias("n"))
