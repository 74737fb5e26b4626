"""Versioned tables with a manifest: checkpoints, caches, stores of chunks and vectors, snapshots of captures.

A version is a folder of Parquet that no one changes, and one small manifest file that names
it. The file appears by a rename that fails if the version is taken, so readers see a version
whole or not at all, and of two writers each gets its own number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import signature
from .store import load as read_table

MANIFEST = "kind string, version long, signature string, saved_at string, folder string, rows long, note string"


class Artifacts:
    """The versions under one root folder, which any file system that Spark knows may hold."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, rest: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rest}")

    def _delete(self, rest: str) -> bool:
        path = self._path(rest)
        return bool(path.getFileSystem(self.conf).delete(path, True))

    def records(self, kind: str) -> list[dict]:
        """A kind's manifest, newest first."""
        folder = self._path(f"_manifest/{kind}")
        if not folder.getFileSystem(self.conf).exists(folder):
            return []
        found = self.spark.read.schema(MANIFEST).json(folder.toString()).filter("version is not null").orderBy(F.desc("version")).collect()  # a row a version
        return [r.asDict() for r in found]

    def list(self, kind: str) -> DataFrame:
        """kind, version, signature, saved_at, folder, rows, note of all versions, newest first."""
        return self.spark.createDataFrame([tuple(r.values()) for r in self.records(kind)], MANIFEST)

    def save(self, kind: str, df: DataFrame, signature: str = "", note: str = "") -> dict:
        """Store df as the kind's next version; returns its record."""
        folder = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        rows = self.spark.read.parquet(f"{self.root}/{folder}").count()
        version = max((r["version"] for r in self.records(kind)), default=0) + 1
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        while True:
            record = {"kind": kind, "version": version, "signature": signature, "saved_at": datetime.now(timezone.utc).isoformat(), "folder": folder, "rows": rows, "note": note}
            held, final = self._path(f"_manifest/.{uuid.uuid4().hex}"), self._path(f"_manifest/{kind}/{version:010d}.json")
            fs = final.getFileSystem(self.conf)
            fs.mkdirs(final.getParent())
            out = fs.create(held)
            out.write(bytearray(json.dumps(record, ensure_ascii=False).encode()))
            out.close()
            try:
                context.rename(held, final, none)
                return record
            except Exception:  # the version is taken: try the next
                fs.delete(held, False)
                if not fs.exists(final):
                    raise
                version += 1

    def load(self, kind: str, version: int | None = None, signature: str | None = None) -> DataFrame | None:
        """The newest version, or that of a number; None if there is none or its signature is not the one wanted."""
        for r in self.records(kind):
            if version in (None, r["version"]):
                return read_table(self.spark, f"{self.root}/{r['folder']}") if signature in (None, r["signature"]) else None
        return None

    def remembered(self, kind: str, signature: str, make: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
        """The newest version if its signature fits, else what ``make`` makes, stored."""
        found = None if rebuild else self.load(kind, signature=signature)
        if found is None:
            self.save(kind, make(), signature)
            found = self.load(kind, signature=signature)
        return found

    def keep(self, kind: str, newest: int) -> int:
        """Delete all but the newest versions, manifest files first; how many went."""
        old = self.records(kind)[newest:]
        for r in old:
            self._delete(f"_manifest/{kind}/{r['version']:010d}.json")
        for r in old:
            self._delete(r["folder"])
        return len(old)


def file_signature(spark: SparkSession, path: str) -> str:
    """A hash of the names, sizes and times of the files under a path, without reading them; blank if there is none."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return ""
        raise
    return files.select(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("path", "length", "modificationTime")))), 256)).first()[0] if not files.isEmpty() else ""


def table_signature(df: DataFrame) -> str:
    """A hash of a table's rows, whatever their order, and columns."""
    return json.dumps([sorted(df.columns), *[str(x) for x in signature(df, df.columns).first()]])


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often, in any order; columns go by name."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def reused(raw: DataFrame, kept_raw: DataFrame | None, kept: DataFrame | None, make: Callable[[], DataFrame]) -> DataFrame:
    """What was made of the same rows before, else what ``make`` makes."""
    return kept if kept is not None and kept_raw is not None and same_rows(raw, kept_raw) else make()
