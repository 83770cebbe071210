"""Tables that change together: a batch writes all of them, and one manifest makes them visible at once.

Below one folder lie data folders, each written once and never changed, and manifests v1, v2, ... Each
manifest names the data folder of every table and the last batch of every writer. A version counts once
its manifest has its name; it is written under another name and renamed, which a file system does whole or not at
all (a store without such a rename needs a lock around `commit`). A driver or executor lost in between
leaves data that no manifest names, and the version before it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Tables = dict[str, DataFrame]


class Conflict(Exception):
    """Another writer has made this version; read again and retry."""


class Versions:
    """The versions of a set of tables below `folder`, on any store that Spark writes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._text = jvm.org.apache.commons.io.IOUtils
        self.fs = self._path(self.folder).getFileSystem(self._conf)

    def number(self) -> int:
        """The newest version; 0 before the first."""
        at = self._path(f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.number() if version is None else version
        if not version:
            return {"tables": {}, "batches": {}}
        stream = self.fs.open(self._path(f"{self.folder}/manifests/v{version}"))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def table(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table as of a version, the newest by default; None if that has none of the name."""
        held = self.manifest(version)["tables"].get(name)
        return held and self.spark.read.schema(held["schema"]).parquet(f"{self.folder}/{held['path']}")

    def commit(self, change: Callable[[Tables], Tables], writer: str, batch: int) -> bool:
        """Apply `change` (tables by name, to the new ones) as one version; False if this writer's batch, or a later one, is in already.

        Tables that `change` leaves out stay as they are. Whoever raises in between, or meets another writer (Conflict), has changed nothing.
        """
        version = self.number()
        held = self.manifest(version)
        if held["batches"].get(writer, -1) >= batch:
            return False
        folder = f"data/{uuid.uuid4().hex}"
        before = {name: self.table(name, version) for name in held["tables"]}
        tables = dict(held["tables"])
        for name, df in change(before).items():
            df.write.parquet(f"{self.folder}/{folder}/{name}")
            tables[name] = {"path": f"{folder}/{name}", "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)}
        text = json.dumps({"tables": tables, "batches": held["batches"] | {writer: batch}})
        ready = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(ready, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        final = self._path(f"{self.folder}/manifests/v{version + 1}")
        if self.fs.exists(final) or not self.fs.rename(ready, final):
            self.fs.delete(ready, False)
            raise Conflict(f"version {version + 1} is there already")
        return True

    def sink(self, change: Callable[[Tables, DataFrame], Tables], writer: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: every micro-batch becomes a version, once, however often it is run again."""

        def write(rows: DataFrame, number: int) -> None:
            self.commit(lambda tables: change(tables, rows), writer, number)

        return write
