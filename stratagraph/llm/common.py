"""What the operators of this subpackage share: tables, shared folders and Arrow batches."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut, fresh_dir, shared_dir  # noqa: F401

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTE_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Rows of an Arrow batch and bytes after which it ends. Documents may be long, so that batches stay small.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def tidy(run: Callable) -> Callable:
    """The function, after which a worker gives free memory back; workers stay for further tasks and stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


def in_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow in small batches, for DataFrame.transform(): documents may be long.

    Sets the session's limits of Arrow batches, which Spark reads when the plan runs.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(tidy(run), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_batch(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """mapInArrow with a function from a batch to columns (in the order of the schema)."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    names = [f.name for f in fields]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], type=arrow.field(n).type) for n in names], names=names)

    return in_arrow(df, run, schema)


def crc_mod(column: str, divisor: int):
    """crc32 of the column's decimal text, modulo the divisor; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
