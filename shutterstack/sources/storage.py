"""Keyed tables as versioned Parquet folders: every commit writes a new version and then moves a pointer."""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from shutterstack.errors import StorageError
from shutterstack.operators.catalog import upsert


#: Versions of a table that are kept, the current one included.
KEPT = 4


class Table:
    """One table in ``folder`` (on a file system all executors share). Readers see the version the pointer names, so a
    writer that dies leaves the table as it was; there is one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str):
        self.spark, self.folder, self.schema, self.key = spark, folder, schema, key

    def _store(self):
        """The file system of a folder with a scheme (an object store, HDFS), and the folder's path on it; None for a local folder."""
        if "://" not in self.folder:
            return None, None
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> str | None:
        """The current version; None if nothing was ever written, which is no error."""
        store, root = self._store()
        if store is None:
            try:
                with open(os.path.join(self.folder, "CURRENT")) as file:
                    return file.read().strip()
            except FileNotFoundError:
                return None
        pointer = self.spark._jvm.org.apache.hadoop.fs.Path(root, "CURRENT")
        if not store.exists(pointer):
            return None
        stream = store.open(pointer)
        try:
            return bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()

    def _point(self, version: str) -> None:
        """Move the pointer: by an atomic rename, or, in a store, by an object that is put whole."""
        store, root = self._store()
        if store is None:
            staged = os.path.join(self.folder, f"CURRENT.{version}")
            with open(staged, "w") as file:
                file.write(version)
            os.replace(staged, os.path.join(self.folder, "CURRENT"))
            return
        stream = store.create(self.spark._jvm.org.apache.hadoop.fs.Path(root, "CURRENT"), True)
        stream.write(bytearray(version.encode()))
        stream.close()

    def _forget(self) -> None:
        """Remove all versions but the newest ``KEPT``; what still reads an older one has to begin again."""
        store, root = self._store()
        if store is None:
            old = sorted((e.stat().st_mtime_ns, e.path) for e in os.scandir(self.folder) if e.name.startswith("v-"))
            for _, path in old[:-KEPT]:
                shutil.rmtree(path, ignore_errors=True)
            return
        old = sorted((e.getModificationTime(), e.getPath().toString()) for e in store.listStatus(root) if e.getPath().getName().startswith("v-"))
        for _, path in old[:-KEPT]:
            store.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def read(self) -> DataFrame:
        """The current rows; none if the table is missing. Optional columns a version lacks are null, and a missing required one is an error."""
        version = self.version()
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        stored = self.spark.read.parquet(os.path.join(self.folder, version))
        missing = [f.name for f in self.schema if not f.nullable and f.name not in stored.columns and f.name != "tombstone"]
        if missing:
            raise StorageError(f"{self.folder} lacks {', '.join(missing)}")
        return self.spark.read.schema(self.schema).parquet(os.path.join(self.folder, version))

    def overwrite(self, rows: DataFrame) -> str:
        """Write ``rows`` as the new version, move the pointer to it, and remove versions that are no longer needed."""
        version = f"v-{uuid.uuid4().hex}"
        rows.select(*(f.name for f in self.schema)).write.parquet(os.path.join(self.folder, version))
        self._point(version)
        self._forget()
        return version

    def upsert(self, delta: DataFrame) -> str | None:
        """Merge by key: rows with a known key are replaced, others added. An empty delta writes nothing. The delta is computed once."""
        delta = delta.select(*(f.name for f in self.schema)).persist()
        try:
            return self.version() if delta.isEmpty() else self.overwrite(upsert(self.read(), delta, self.key))
        finally:
            delta.unpersist()

    def count(self) -> int:
        return self.read().count()
