"""Scanning a source tree, local or in a store that both Spark and pyarrow reach: first names, sizes and times, then contents."""

from __future__ import annotations

import fnmatch
import hashlib
import itertools
import json
import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import IgnoreRules, language
from ..lineage import stored

SNIFF = 8192
# What is never read, and what is left out unless a rule takes it back.
MANDATORY = [".git/", ".stratagraph/", ".env", ".env.*", "*.env", "*.env.*"]
DEFAULTS = ["node_modules/", "vendor/", "dist/", "build/", "coverage/", ".cache/", ".next/", ".nuxt/", "venv/", ".venv/", "__pycache__/", "target/", ".DS_Store", "*.lock"]
OWN_IGNORE = ".stratagraphignore"


LISTED = ("path", "size", "mtime", "mtime_ns", "ctime_ns", "language")
#: Entries after which a task hands the folders that are left to other tasks.
STEP = 20_000


def _system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and the path in it; local paths may hold any characters."""
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").strip("/")
    system, top = pyarrow.fs.FileSystem.from_uri(uri)
    return system, top.rstrip("/")


class _Walk:
    """Folders below a root, top down, on an executor: what ignore rules leave out whole isn't entered."""

    def __init__(self, root: str, exclude: tuple[str, ...], include: tuple[str, ...], max_bytes: int, step: int):
        self.system, self.top = _system(root)
        self.exclude, self.include, self.max_bytes, self.step = list(exclude), include, max_bytes, step
        self.made: dict[str, IgnoreRules] = {}

    def rules(self, layers: str) -> IgnoreRules:
        if layers not in self.made:
            self.made[layers] = IgnoreRules(MANDATORY, [("", DEFAULTS), *json.loads(layers), ("", self.exclude)])
        return self.made[layers]

    def layers(self, folder: str, names: set[str], layers: str) -> str:
        """The layers with the folder's own ignore files; the tool's own after git's."""
        own = []
        for name in (".gitignore", OWN_IGNORE):
            if name in names:
                try:
                    with self.system.open_input_stream(f"{self.top}/{folder}{name}") as file:
                        own.append((folder.rstrip("/"), file.read().decode("utf-8", "replace").splitlines()))
                except OSError:
                    continue
        return json.dumps(json.loads(layers) + own) if own else layers

    def run(self, folder: str, layers: str) -> Iterator[tuple[str, str | None, int | None, int | None]]:
        """(path, None, size, mtime_ns) of files; (folder, layers, None, None) of folders that are left to others."""
        queue, seen = [(folder, layers)], 0
        while queue:
            folder, layers = queue.pop()
            if seen >= self.step:
                yield folder, layers, None, None
                continue
            try:
                found = self.system.get_file_info(pyarrow.fs.FileSelector(f"{self.top}/{folder}".rstrip("/"), recursive=False))
            except OSError:  # gone meanwhile, or not to be entered
                continue
            seen += len(found)
            layers = self.layers(folder, {x.base_name for x in found}, layers)
            rules = self.rules(layers)
            for x in found:
                path = folder + x.base_name
                if x.type == pyarrow.fs.FileType.Directory:
                    linked = self.system.type_name == "local" and os.path.islink(x.path)
                    if not linked and not rules.prunes(path + "/"):
                        queue.append((path + "/", layers))
                elif x.type == pyarrow.fs.FileType.File and (x.size or 0) <= self.max_bytes and not rules.ignored(path) and (not self.include or any(fnmatch.fnmatch(path, y) for y in self.include)):
                    yield path, None, x.size, x.mtime_ns


def listing(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), include: tuple[str, ...] = (), max_bytes: int = 2_000_000, step: int = STEP) -> DataFrame:
    """path, size, mtime, mtime_ns, ctime_ns, language of the tree's files that no rule leaves out. No file is opened but ignore files.

    Executors walk the folders themselves, as Spark's reader passes over names that begin with a dot or an underscore. A
    task that has seen ``step`` entries gives its other folders back, which the next round deals out, so that rounds are
    few and large trees are shared. Ignore files count from their own folder; of their rules the last that matches wins,
    mandatory ones always. Times are those of modification; stores have no change time apart from it.
    """
    base = _base(spark, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(base, exclude, include, max_bytes, step)
        for batch in batches:
            for folder, layers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = walk.run(folder, layers)
                while some := list(itertools.islice(rows, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "layers", "size", "mtime_ns"])

    folders, pieces = spark.createDataFrame([("", "[]")], "path string, layers string"), []
    while True:
        out = stored(folders.mapInArrow(run, "path string, layers string, size bigint, mtime_ns bigint"))
        pieces.append(out.filter("layers is null"))
        left = out.filter("layers is not null").select("path", "layers")
        if left.isEmpty():
            break
        folders = left.repartition(spark.sparkContext.defaultParallelism)
    rows = reduce(DataFrame.unionByName, pieces)
    return rows.select("path", "size", (F.col("mtime_ns") / 1e9).alias("mtime"), "mtime_ns", F.col("mtime_ns").alias("ctime_ns"), language(F.col("path")).alias("language"))


def contents(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """The listed rows with content, hash and binary; executors open just these files.

    A file with a NUL in its first bytes is binary and has no content here. A file that can't be read has neither content
    nor hash.
    """
    base = _base(spark, root)
    names = listed.columns
    at = names.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _system(base)
        for batch in batches:
            for i in range(0, batch.num_rows, 16):  # files may be as long as the size limit
                some, out = batch.slice(i, 16), []
                for path in some.column(at).to_pylist():
                    try:
                        with system.open_input_stream(f"{top}/{path}", compression=None) as file:
                            data = file.read()
                    except OSError:
                        out.append((None, None, False))
                        continue
                    binary = b"\0" in data[:SNIFF]
                    out.append((None if binary else data.decode("utf-8", "replace"), hashlib.sha256(data).hexdigest(), binary))
                extra = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*some.columns, *extra], names=[*names, "content", "hash", "binary"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema)
    return listed.mapInArrow(run, f"{head}, content string, hash string, binary boolean")


def unchanged(listed: DataFrame, files: DataFrame) -> DataFrame:
    """path, status of listed files whose size and times are those of the registry; they needn't be opened."""
    known = files.filter("status in ('active', 'binary')").select("path", "size", "mtime_ns", "ctime_ns", "status")
    return listed.join(known, ["path", "size", "mtime_ns", "ctime_ns"]).select("path", "status")


def scan(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), include: tuple[str, ...] = (), max_bytes: int = 2_000_000) -> DataFrame:
    """listing() with the content and hash of text files."""
    found = contents(spark, root, listing(spark, root, exclude, include, max_bytes))
    return found.filter("not binary and hash is not null").select("path", "content", "hash", *[c for c in LISTED if c != "path"])


def _base(spark: SparkSession, root: str) -> str:
    """The root as the reader names it in the path column."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString().rstrip("/") + "/"
