"""Versioned snapshots of all relations in Parquet.

A build writes every table of a new version into a folder of its own and then one small pointer file that is named by
the version; readers pin the highest version that has a whole pointer, so that no table is read half written and a
build that ends at any point leaves the version before. Pointers are never replaced. Stores of older schemas are
brought up to date by MIGRATIONS, one step a schema, when they are read; versions made by a newer schema are refused.
Works on any store that Hadoop's file systems reach.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

#: By the schema that a version has: what brings a table to the next one. Columns that are only new are null without a step.
MIGRATIONS: dict[int, dict[str, Callable[[DataFrame], DataFrame]]] = {}
#: How tables lie in their folders: by type, so that traversals and look-ups read theirs alone, or sorted by term.
BY_TYPE, BY_TERM = ("nodes", "edges"), ("postings",)


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _text(self, place) -> str:
        stream = self.system.open(place)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _pointers(self) -> dict[int, int]:
        """Schema by version, of pointers that are whole."""
        folder, out = self.path(self.folder), {}
        for status in self.system.listStatus(folder) if self.system.exists(folder) else []:
            if found := re.fullmatch(r"CURRENT-(\d+)", status.getPath().getName()):
                said = re.fullmatch(rf"{found[1]} (\d+) end", self._text(status.getPath()))
                if said:
                    out[int(found[1])] = int(said[1])
        return out

    def current(self) -> int | None:
        found = self._pointers()
        if not found:
            return None
        version = max(found)
        if found[version] > schemas.SCHEMA_VERSION:
            raise ValueError(f"the snapshot has schema {found[version]}; this build reads up to {schemas.SCHEMA_VERSION}")
        return version

    def write(self, tables: dict[str, DataFrame]) -> int:
        """All tables as the next version; those that aren't given are taken from the current one."""
        now = self.current()
        version = (now or 0) + 1
        for name, schema in schemas.TABLES.items():
            rows = tables.get(name)
            if rows is None:
                rows = self.spark.createDataFrame([], schema) if now is None else self.read(name, now)
            place = f"{self.folder}/v={version}/{name}"
            if name in BY_TYPE:
                rows.hint("rebalance", "type").write.mode("overwrite").partitionBy("type").parquet(place)
            elif name in BY_TERM:
                rows.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(place)
            else:
                rows.write.mode("overwrite").parquet(place)
        stream = self.system.create(self.path(f"{self.folder}/CURRENT-{version}"), False)
        stream.write(bytearray(f"{version} {schemas.SCHEMA_VERSION} end".encode()))
        stream.close()
        return version

    def read(self, name: str, version: int | None = None) -> DataFrame:
        version = self.current() if version is None else version
        if version is None:
            return self.spark.createDataFrame([], schemas.TABLES[name])
        folder = re.sub(r"([\[\]{}*?\\])", r"\\\1", f"{self.folder}/v={version}/{name}")  # the reader takes paths as patterns
        made = self._pointers().get(version, schemas.SCHEMA_VERSION)
        if made == schemas.SCHEMA_VERSION:
            return self.spark.read.schema(schemas.TABLES[name]).parquet(folder).select(*[x.split(" ")[0] for x in schemas.TABLES[name].split(", ")] if name in BY_TYPE else "*")
        if not self.system.exists(self.path(f"{self.folder}/v={version}/{name}")):  # a table that came later
            return self.spark.createDataFrame([], schemas.TABLES[name])
        rows = self.spark.read.parquet(folder)
        for step in range(made, schemas.SCHEMA_VERSION):
            rows = MIGRATIONS.get(step, {}).get(name, lambda x: x)(rows)
        want = self.spark.createDataFrame([], schemas.TABLES[name]).schema
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])
