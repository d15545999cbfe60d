"""Dropping lines that many documents share, by probing sharded perfect-hash arrays.

Lines are hashed to 128 bits: 64 for shard and slot, 64 as the fingerprint. Document counts are summed
by hash with partial sums. The distinct hashes go to shards by their first bits; each shard's minimal perfect hash
indexes two plain arrays, fingerprints and counts. Documents never meet other lines in a join: each batch hashes its
lines again and probes the arrays; a line whose slot has another fingerprint isn't indexed, and the probed count decides
over all others. ``index_min`` says in how many documents a hash must be found to be indexed: with 1 the index holds
all lines; 2, the default, leaves out those of one document, most of them, which no threshold above 1 can drop.

The arrays of several shards go to the executors as one broadcast of at most ``budget`` bytes. If there are more
shards, rows are numbered and stored once; each round probes the next shards and stores only the numbers of rows and
their dropped lines, which are joined to the rows at the end. Memory is thus bounded whatever the number of lines,
and texts are written once whatever the number of rounds.

A key is the line without white space at its ends and with A-Z in lower case; keys shorter than
``min_chars`` code points are never dropped. A null or empty text is one empty line (of which nothing is dropped at
``min_chars`` 1). A document's repeated line counts once; repeated rows count as so many documents. Other lines stay in
order. Very long texts are split whole; a batch of Arrow ends after a few megabytes. Columns named n_lines and n_dropped
are replaced, others, whatever their names, are kept. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_LOWER, SPACE, cut, in_arrow
from .mphf import PerfectHash

#: Hashes in a shard, about; bytes of shards in one broadcast.
SHARD_KEYS = 200_000
BUDGET = 64 << 20


def line_hashes(lines: list[bytes], min_chars: int) -> np.ndarray:
    """(n, 2) uint64; both 0 for keys that are too short."""
    digest, blank = xxhash.xxh3_128_digest, SPACE.encode()
    keys = [line.strip(blank).translate(BYTE_LOWER) for line in lines]
    if min_chars > 1:
        keys = [k if len(k.decode()) >= min_chars else b"" for k in keys]
    raw = b"".join([digest(k) if k or not min_chars else bytes(16) for k in keys])
    return np.frombuffer(raw, ">u8").reshape(-1, 2).astype(np.uint64)


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def line_counts(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """h, f (the hash's halves), n: documents that hold the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, int] = {}
            for value in batch.column(0).to_pylist():
                hashed = line_hashes(_lines(value), min_chars)
                for x in set(map(bytes, hashed)):
                    held[x] = held.get(x, 0) + 1
            held.pop(bytes(16), None)
            both = np.frombuffer(b"".join(held), np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(list(held.values()), pa.int64())], names=["h", "f", "n"])

    counted = docs.select(F.col(text).cast("string")).transform(in_arrow, run, "h bigint, f bigint, n bigint")
    return counted.groupBy("h", "f").agg(F.sum("n").alias("n"))


def build_shards(counts: DataFrame, shards: int) -> DataFrame:
    """shard, n, data: a perfect hash with fingerprints and counts by slot. Hashes spread evenly over shards."""

    def build(key, pdf):
        import pandas as pd

        prints = pdf["f"].to_numpy(np.int64).view(np.uint64)
        hashed = pdf["h"].to_numpy(np.int64).view(np.uint64)
        number = np.minimum(pdf["n"].to_numpy(), 2**32 - 1).astype(np.uint64)
        order = np.lexsort((prints, hashed))  # of equal first halves, all but one are kept beside the arrays
        hashed, prints, number = hashed[order], prints[order], number[order]
        again = np.concatenate([[False], hashed[1:] == hashed[:-1]])
        beside = np.stack([hashed[again], prints[again], number[again]])
        hashed, prints, number = hashed[~again], prints[~again], number[~again].astype(np.uint32)
        made = PerfectHash.build(hashed)
        slots = made.slots(hashed)
        by_slot, counts_by_slot = np.zeros(made.n, np.uint64), np.zeros(made.n, np.uint32)
        by_slot[slots], counts_by_slot[slots] = prints, number
        index = made.to_bytes()
        data = len(index).to_bytes(8, "little") + index + by_slot.tobytes() + counts_by_slot.tobytes() + beside.tobytes()
        return pd.DataFrame({"shard": [key[0]], "n": [len(pdf)], "data": [data]})

    placed = counts.withColumn("shard", F.pmod(F.shiftrightunsigned("h", 40), F.lit(shards)).cast("int"))
    return placed.groupBy("shard").applyInPandas(build, "shard int, n bigint, data binary")


class LineIndex:
    """Some shards' arrays in memory."""

    def __init__(self, parts: dict[int, bytes], shards: int):
        self.shards, self.parts = shards, {}
        for shard, data in parts.items():
            size = int.from_bytes(data[:8], "little")
            made = PerfectHash.from_bytes(data[8 : 8 + size])
            at = 8 + size + 12 * made.n
            beside = np.frombuffer(data, np.uint64, offset=at).reshape(3, -1) if at < len(data) else np.zeros((3, 0), np.uint64)
            self.parts[shard] = (made, np.frombuffer(data, np.uint64, made.n, 8 + size), np.frombuffer(data, np.uint32, made.n, 8 + size + 8 * made.n), beside)

    def counts(self, hashed: np.ndarray) -> np.ndarray:
        """The documents that hold each line; 0 where these shards don't index it."""
        out = np.zeros(len(hashed), np.int64)
        shard = ((hashed[:, 0] >> np.uint64(40)) % np.uint64(self.shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            if part := self.parts.get(int(shard[order[a]])):
                made, prints, number, beside = part
                mine = order[a:b]
                slots = made.slots(hashed[mine, 0])
                known = slots >= 0
                known[known] = prints[slots[known]] == hashed[mine[known], 1]
                out[mine[known]] = number[slots[known]]
                for h, f, n in beside.T:
                    out[mine[(hashed[mine, 0] == h) & (hashed[mine, 1] == f)]] = n
        return out


def probed(texts: list[str | None], index: LineIndex, min_docs: int, min_chars: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Each text's lines, and which of them these shards say to be common."""
    split = [_lines(t) for t in texts]
    hashed = line_hashes([x for lines in split for x in lines], min_chars)
    common, place = (index.counts(hashed) >= min_docs) & hashed.any(axis=1), 0
    for lines in split:
        yield lines, common[place : place + len(lines)]
        place += len(lines)


def _without(batch: pa.RecordBatch, names: list[str], at: int, found: Iterator[tuple[list[bytes], np.ndarray]]) -> pa.RecordBatch:
    """The batch's first columns with texts without the lines marked, and the numbers of lines and of dropped ones."""
    kept, sizes, gone = [], [], []
    for whole, (lines, mine) in zip(batch.column(at).to_pylist(), found, strict=True):
        dropped = int(mine.sum())
        kept.append(b"\n".join([x for x, y in zip(lines, mine.tolist(), strict=True) if not y]).decode() if dropped else whole or "")
        sizes.append(len(lines))
        gone.append(dropped)
    columns = [batch.column(i) for i in range(len(names))]
    columns[at] = pa.array(kept, pa.string())
    return pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "n_lines", "n_dropped"])


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", index_min: int = 2, shard_keys: int = SHARD_KEYS, budget: int = BUDGET) -> DataFrame:
    """The rows with their text without common lines, and n_lines, n_dropped, which replace columns of these names."""
    docs = docs.drop("n_lines", "n_dropped")
    spark = docs.sparkSession
    counts = cut(line_counts(docs, text, min_chars).filter(F.col("n") >= min(min_docs, index_min)))
    total = counts.count()
    shards = max(1, -(-total // shard_keys))
    index = cut(build_shards(counts, shards)) if total else None
    rounds: list[list[int]] = [[]]
    used = 0
    for shard, size in sorted(index.select("shard", F.length("data")).toLocalIterator()) if index is not None else []:
        if used + size > budget and rounds[-1]:
            rounds.append([])
            used = 0
        rounds[-1].append(shard)
        used += size
    names, kinds = docs.columns, {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", n_lines bigint, n_dropped bigint"
    at = names.index(text)

    def shared(wanted: list[int]):
        return spark.sparkContext.broadcast({r["shard"]: bytes(r["data"]) for r in index.filter(F.col("shard").isin(wanted)).toLocalIterator()} if wanted else {})

    if len(rounds) == 1:
        parts = shared(rounds[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = LineIndex(parts.value, shards)
            for batch in batches:
                yield _without(batch, names, at, probed(batch.column(at).to_pylist(), known, min_docs, min_chars))

        return docs.transform(in_arrow, run, schema)

    whole = cut(docs.withColumn("__line_row", F.monotonically_increasing_id()))  # as written once, numbers stay
    found = [cut(_common_lines(whole.select("__line_row", text), shared(wanted), shards, min_docs, min_chars)) for wanted in rounds]
    gone = reduce(DataFrame.unionByName, found).groupBy("__line_row").agg(F.flatten(F.collect_list("lines")).alias("__line_gone"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [_lines(t) for t in batch.column(at).to_pylist()]
            marked = [np.zeros(len(lines), bool) for lines in split]
            for mine, places in zip(marked, batch.column(len(names)).to_pylist(), strict=True):
                mine[places or []] = True
            yield _without(batch, names, at, zip(split, marked, strict=True))

    return whole.join(gone, "__line_row", "left").select(*names, "__line_gone").transform(in_arrow, strip, schema)


def _common_lines(rows: DataFrame, parts, shards: int, min_docs: int, min_chars: int) -> DataFrame:
    """__line_row, lines: the places of lines that these shards say to be common, of rows that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = LineIndex(parts.value, shards)
        for batch in batches:
            ids, places = [], []
            for row, (_, mine) in zip(batch.column(0).to_pylist(), probed(batch.column(1).to_pylist(), known, min_docs, min_chars), strict=True):
                if mine.any():
                    ids.append(row)
                    places.append(np.flatnonzero(mine).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.list_(pa.int32()))], names=["__line_row", "lines"])

    return rows.transform(in_arrow, run, "__line_row bigint, lines array<int>")
