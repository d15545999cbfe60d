"""Near-duplicates by min-max hashing, with links confirmed on full shingle sets.

A document's set holds the distinct shingles of ``words`` words (white space of the C locale, A-Z in
lower case) of the whole text; a shorter text is one shingle, a text without words is an empty set,
which links with nothing. Each permutation of the shingles' hashes gives two values, the smallest and the
largest; PERMUTATIONS of them make BANDS bands of ROWS values from different permutations. Two sets of
similarity 0.8 miss all bands with a probability of 5e-8.

1. Documents with equal sets are one class with a number of its own (partial sums before the shuffle); its smallest
   id, with the set, represents it.
2. In each bucket of a band every class is compared with the bucket's smallest: a star, not all pairs.
   Full sets confirm, by native array_intersect; links give components by alternating star contraction.
3. Buckets that still hold several components are compared block by block: a task has two blocks of a
   bucket, counts the shared elements of the full sets of all its pairs of different components at once, as a product
   of matrices, and emits only links that join something. No pair is dropped by an estimate, bucket size is bounded by
   no cap, and nothing is done for a group that the stars have joined already.
4. A component is named by the smallest id of its classes.

Rows with a null id are never linked and have a null component. Repeated rows share a class; rows of one id with
different texts are in different classes, each with its own links (two of them may be in different components, of
which both can be named by that id). Null and empty texts have n_shingles 0 and their own id as component. Very long
texts are one set like others, hashed in pieces. Ids are whole numbers (other types raise an error when they can't
be cast). Other columns, whatever their names, don't matter. Empty tables give no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_LOWER, cut, in_arrow, mix64

PERMUTATIONS, BANDS, ROWS = 64, 32, 4
#: Classes in a block of a bucket; shared elements that are counted at once.
BLOCK, COLUMNS = 512, 4096
#: Ids up to which a list of ids is broadcast (about 32 MB in a task); beyond, it is a shuffled join.
BROADCAST_IDS = 500_000
_RANDOM = np.random.default_rng(20240101)
_XOR = _RANDOM.integers(0, 2**32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)
_FACTOR = _RANDOM.integers(0, 2**32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_STEPS = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    found = (text or "").encode().translate(BYTE_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(hashed))
    total = np.full(len(hashed) - width + 1, width, np.uint64)
    for i in range(width):
        total += hashed[i : len(hashed) - width + 1 + i] * _STEPS[i]
    return np.unique(mix64(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest values, then the largest, under each permutation."""
    low, least, most = hashes.astype(np.uint32), None, None
    for at in range(0, len(low), 4096):
        values = (low[at : at + 4096, None] ^ _XOR) * _FACTOR
        a, b = values.min(0), values.max(0)
        least, most = (a, b) if least is None else (np.minimum(least, a), np.maximum(most, b))
    return np.concatenate([least, most])


def bands(sign: np.ndarray) -> np.ndarray:
    """A hash for each band; its last 5 bits are the band's number."""
    values = sign.reshape(BANDS, ROWS).astype(np.uint64)
    mixed = mix64(values[:, 0] << np.uint64(32) | values[:, 1]) * np.uint64(0x9E3779B97F4A7C15) ^ (values[:, 2] << np.uint64(32) | values[:, 3])
    return mix64(mixed) & ~np.uint64(BANDS - 1) | np.arange(BANDS, dtype=np.uint64)


def signed(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """id, n_shingles, h1, h2 (a hash of the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hashed, found = [], [], []
            for value in batch.column(1):
                own = shingles(value.as_py(), words)
                n.append(len(own))
                hashed.append(xxhash.xxh3_128_digest(own.tobytes()))
                found.append(bands(signature(own)).view(np.int64) if len(own) else np.zeros(0, np.int64))
            halves = np.frombuffer(b"".join(hashed), np.int64).reshape(-1, 2)
            offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "h1", "h2", "bands"])

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string"))
    return rows.transform(in_arrow, run, "id bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>")


def set_hash(hashes: np.ndarray) -> tuple[int, int]:
    """h1, h2 of a set."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64).tolist())


def shingle_sets(docs: DataFrame, classes: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """id, shingles of the classes (id, rep, h1, h2), from the documents that represent them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = [], []
            for number, h1, h2, value in zip(*(batch.column(i) for i in range(4)), strict=True):
                found = shingles(value.as_py(), words)
                if set_hash(found) == (h1.as_py(), h2.as_py()):  # else another text of the same id
                    ids.append(number.as_py())
                    own.append(found.view(np.int64))
            offsets = np.cumsum([0, *map(len, own)], dtype=np.int32)
            flat = np.concatenate(own) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "shingles"])

    rows = docs.select(F.col(key).cast("bigint").alias("rep"), F.col(text).cast("string").alias("text"))
    wanted = F.broadcast(classes) if classes.count() <= BROADCAST_IDS else classes
    rows = rows.join(wanted, "rep").select("id", "h1", "h2", "text")
    return rows.transform(in_arrow, run, "id bigint, shingles array<bigint>").dropDuplicates(["id"])


def similar(shared, left, right, percent: int):
    """100 * intersection >= percent * union, in whole numbers; for columns and for Python numbers."""
    return 100 * shared >= percent * (left + right - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose full sets are similar. The set of b is shuffled once; that of a is only streamed."""
    one, two = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(two, "b").join(one, "a")
    both = both.filter(F.least(F.size("sa"), F.size("sb")) * 100 >= percent * F.greatest(F.size("sa"), F.size("sb")))
    return both.withColumn("shared", F.size(F.array_intersect("sa", "sb"))).filter(similar(F.col("shared"), F.size("sa"), F.size("sb"), percent)).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component of every node of the links a, b: the smallest node reachable.

    Alternating star contraction: each node's larger neighbours, then its smaller ones, are linked with
    the smallest neighbour, until all links are stars; the number of rounds is logarithmic.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        larger = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        larger = larger.filter("u <> v").distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        after = cut(smaller.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        changed = not after.exceptAll(edges).isEmpty() or after.count() != edges.count()
        edges = after
        if not changed:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _find(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def shared_counts(sets: list[np.ndarray], some: int) -> np.ndarray:
    """Sizes of the intersections of the first ``some`` sets with all other sets (a set with itself isn't counted).

    Elements that several sets hold are columns of a matrix of zeros and ones, of which COLUMNS at a time are multiplied.
    """
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = (np.cumsum(times > 1) - 1)[place]
    held = times[place] > 1
    order = np.argsort(column[held], kind="stable")
    rows, column = rows[held][order], column[held][order]
    out = np.zeros((some, len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        ones = np.zeros((len(sets), COLUMNS), np.float32)
        ones[rows[a:b], column[a:b] - start] = 1
        out += ones[:some] @ ones.T
    return out.astype(np.int64)


def _joins(group: list[tuple], same: bool, percent: int) -> Iterator[tuple[int, int]]:
    """Links between different components in two blocks: rows are (block, id, component, set)."""
    count: dict[int, int] = {}
    for _, _, label, _ in group:
        count[label] = count.get(label, 0) + 1
    if len(count) < 2:
        return
    most = max(count, key=lambda k: (count[k], -k))
    group.sort(key=lambda row: row[2] == most)  # rows of the largest component last: they need no partner among themselves
    some = len(group) - count[most]
    block, labels, sizes = np.array([r[0] for r in group]), np.array([r[2] for r in group]), np.array([len(r[3]) for r in group])
    shared = shared_counts([r[3] for r in group], some)
    near = similar(shared, sizes[:some, None], sizes[None, :], percent) & (labels[:some, None] != labels[None, :])
    near &= np.arange(len(group))[None, :] > np.arange(some)[:, None]
    if not same:
        near &= block[:some, None] != block[None, :]
    parent: dict[int, int] = {}
    for i, j in np.argwhere(near).tolist():
        a, b = _find(parent, int(labels[i])), _find(parent, int(labels[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            yield int(labels[i]), int(labels[j])


def joined_blocks(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """a, b: further links, between components. members: bucket, id of buckets with several classes."""
    spark = members.sparkSession
    rows = members.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    stats = rows.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("s0"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("s1"))
    open_ = stats.filter("c0 <> c1").withColumn("band", F.col("bucket").bitwiseAND(BANDS - 1))
    # of buckets with the same members, the one of the first band has all their pairs
    open_ = open_.groupBy("n", "s0", "s1").agg(F.min_by("bucket", "band").alias("bucket"))
    rows = cut(rows.join(open_.select("bucket", F.ceil(F.col("n") / block).alias("blocks")), "bucket"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"), "block", "id", "component")
    rows = rows.join(sets, "id")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = rows.repartition(parts, "bucket", "b0", "b1").sortWithinPartitions("bucket", "b0", "b1")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            lists = batch.column(6)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for i, row in enumerate(zip(*cols, strict=True)):
                yield row, values[offsets[i] : offsets[i + 1]].view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for (_, b0, b1), group in itertools.groupby(stream(batches), key=lambda x: x[0][:3]):
            found.update(_joins([(row[3], row[4], row[5], own) for row, own in group], b0 == b1, percent))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return rows.select("bucket", "b0", "b1", "block", "id", "component", "shingles").transform(in_arrow, run, "a bigint, b bigint")


def grouped(docs: DataFrame, words: int, percent: int, key: str, text: str, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows: id, n_shingles, h1, h2; named: h1, h2, component_id, first).

    component_id is the smallest id of the class's component; first is true for the one class that holds it (of several
    classes of this id in the component, that with the smallest hash).
    """
    rows = cut(signed(docs, words, key, text))
    classes = rows.filter("n_shingles > 0 and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("id"), "*"))  # as written once, numbers stay
    rows = rows.drop("bands")
    banded = classes.select("id", F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub <> last").select("bucket", "hub")
    members = cut(banded.join(hubs, "bucket").distinct())
    pairs = cut(members.filter("hub <> id").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    wanted = cut(classes.select("id", "rep", "h1", "h2").join(members.select("id").distinct(), "id", "left_semi"))
    sets = cut(shingle_sets(docs, wanted, words, key, text))
    links = confirmed(pairs, sets, percent)
    labels = cut(components(links))
    more = cut(joined_blocks(members.select("bucket", "id"), labels, sets, percent, block))
    over = components(more).select(F.col("node").alias("component"), F.col("component").alias("final"))
    # components are numbered by their smallest class, so that joining numbers joins components
    over = cut(over)
    lone = over.join(labels.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("final").alias("component"))
    labels = labels.join(F.broadcast(over) if over.count() <= BROADCAST_IDS else over, "component", "left").select("node", F.coalesce("final", "component").alias("component")).unionByName(lone)
    # the smallest of a component's classes names it; classes that are linked with nothing name themselves
    own = F.struct("rep", "h1", "h2")
    linked = cut(labels.withColumnRenamed("node", "id").join(classes.select("id", "rep", "h1", "h2"), "id"))
    least = linked.groupBy("component").agg(F.min(own).alias("least"))
    linked = linked.join(least, "component").select("id", F.col("least.rep").alias("component_id"), (own == F.col("least")).alias("first"))
    named = classes.select("id", "h1", "h2", "rep").join(linked, "id", "left")
    named = named.select("h1", "h2", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("first", F.lit(True)).alias("first"))
    return rows, named


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """key, n_shingles, component_id, kept (component_id is the row's id): one row for each row of docs."""
    rows, named = grouped(docs, words, percent, key, text, block)
    out = rows.join(named.drop("first"), ["h1", "h2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), own))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """docs without all but one row of each group of near-duplicates: a row of the class that holds the smallest id.

    Of several such rows (one id repeated with the same set) the one with the smallest text stays, then the one with the
    smallest other columns as JSON. Rows with a null key or without words are near nothing and all stay. Whole texts
    aren't shuffled but for ids that come with several rows of which some stay.
    """
    rows, named = grouped(docs, words, percent, key, text, block)
    found = rows.join(named, ["h1", "h2"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("id").isNull()
    stays = alone | (F.col("first") & (F.col("id") == F.col("component_id")))
    found = found.select("id", "h1", "h2", alone.alias("alone"), F.coalesce(stays, F.lit(False)).alias("stays")).filter("id is not null")
    by_id = cut(found.groupBy("id").agg(F.count("*").alias("n"), F.count_if("stays").alias("k"), F.count_if("alone").alias("e")))
    # ids of which no row stays go; ids of which all rows stay as they are need no second look; the others are odd
    odd = cut(by_id.filter("k > 0 and n > 1 and e < n").select("id"))
    docs = docs.withColumn("__near_id", F.col(key).cast("bigint"))
    out = docs.join(_small(by_id.filter("k = 0 or (n > 1 and e < n)").select(F.col("id").alias("__near_id"))), "__near_id", "left_anti").drop("__near_id")
    if odd.isEmpty():
        return out.select(*[F.col(f"`{c}`") for c in out.columns])
    mine = docs.join(_small(odd.withColumnRenamed("id", "__near_id")), "__near_id", "left_semi")
    names = [c for c in docs.columns if c != "__near_id"]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(None if t.as_py() is None else str(t.as_py()), words) for t in batch.column(at)]
            halves = np.array([set_hash(x) for x in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) for x in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=[*names, "__near_id", "__near_n", "__near_h1", "__near_h2"])

    head = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    mine = mine.select(*names, "__near_id").transform(in_arrow, run, f"{head}, __near_id bigint, __near_n bigint, __near_h1 bigint, __near_h2 bigint")
    best = found.filter("stays and not alone").select(F.col("id").alias("__near_id"), F.col("h1").alias("__near_h1"), F.col("h2").alias("__near_h2")).distinct()
    empty = mine.filter("__near_n = 0").select(*names)
    whole = F.struct(*names)
    one = mine.filter("__near_n > 0").join(best, ["__near_id", "__near_h1", "__near_h2"], "left_semi")
    one = one.groupBy("__near_id", "__near_h1", "__near_h2").agg(F.min_by(whole, F.struct(F.col(text).cast("string"), F.to_json(whole))).alias("__near_row")).select("__near_row.*")
    return out.select(*names).unionByName(empty).unionByName(one.select(*names))


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
