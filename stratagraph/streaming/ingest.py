"""Structured Streaming over a folder of files: each micro-batch is parsed and merged into the snapshots.

Merging replaces all facts of a batch's paths, so that a batch that runs twice changes nothing (exactly-once
effects on top of at-least-once batches).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions import text
from ..operators import ingest
from ..operators.parse import parse_files, relations
from ..sources.snapshot import Snapshots

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def merge_batch(store: Snapshots, files: DataFrame) -> int:
    """Parses files(path, content) and writes a snapshot in which they replace what their paths had; its version."""
    files = files.dropDuplicates(["path"]).cache()
    now, null = F.current_timestamp(), F.lit(None).cast("string")
    parsed = parse_files(files).cache()
    found = relations(parsed)
    stamp = {"hash": null, "commit_hash": null, "created_at": now, "updated_at": now, "last_seen_at": now, "inference_reason": null}
    out = {}
    for name in ("nodes", "edges"):
        columns = [c.split(" ")[0] for c in schemas.TABLES[name].split(", ")]
        rows = found[name].withColumns({k: v for k, v in stamp.items() if k in columns}).select(*columns)
        out[name] = ingest.upsert(ingest.without_paths(store.read(name), files), rows)
    out["texts"] = ingest.without_paths(store.read("texts"), files).unionByName(found["texts"])
    for name, rows in zip(("postings", "lengths"), text.indexed(found["texts"]), strict=True):
        held = ingest.without_paths(store.read(name), files)
        out[name] = held.unionByName(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in held.schema]))
    version = store.write(out)
    parsed.unpersist()
    files.unpersist()
    return version


def stream(spark: SparkSession, folder: str, store: Snapshots, checkpoint: str, once: bool = True, max_files: int = 1000) -> StreamingQuery:
    """Starts the stream; with once it ends when all present files are merged."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(folder)
    rows = files.filter(~F.contains(F.substring("content", 1, 8192), F.lit(b"\0"))).select("path", F.col("content").cast("string").alias("content"))
    writer = rows.writeStream.foreachBatch(lambda batch, _: merge_batch(store, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
