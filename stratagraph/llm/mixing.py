"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words. Sources in code point order (null last) weigh 1, 2, 3, and so
on in turn, and share all words by weight; a source's target stops at ``most`` times its size, and what is
above is shared again by weight until no target is above. Each document of a source then expects
target / size copies. Documents are sorted by source, size and a hash; the prefix sum of expected copies
within the source, plus one random offset a source, crosses some whole numbers at each document, which is emitted
once for each. The offset is drawn once, from a hash of the source's name and the seed.

Neighbours in this order have like sizes, so that what one takes too much the next takes less; but a few very long
documents at the end would miss the target by up to one of them. So long documents, those of more than 1 / LONG of
the target (and 1 / MANY of the source, which bounds their number), expect a whole number of copies each: from the
longest down, the number nearest to its share and to what those before have left over or taken too much. The
others' share is what remains of the target. The prefix sum then misses it by about the longest of the others.

Sources stay a DataFrame: their numbers come from a range partitioning like the documents' ranks, and the level up to
which targets are filled from a few sums over them. Ranks come from local row numbers and a prefix sum over partition
counts; a hot source spans many partitions. The sorted rows are cut by a checkpoint, so that ranks stay as they
were when executors are lost.

Null texts have size 0 and are taken like others (with no words); a source of no words has target 0 and its rows are
taken once. Very long texts are counted whole. Repeated rows have ranks of their own; which of them is taken more
often doesn't matter, as they are equal, and ties in size are broken by the hash of key and text. Columns of the names
size, source_size, target and copies are replaced. Empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3.0
#: A long document has more than 1 / LONG of its source's target, and more than 1 / MANY of its source.
LONG, MANY = 200, 2000
#: Rows up to which a table of sources (or of their parts) is broadcast; beyond, it is a shuffled join.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts none."""
    flat = F.btrim(F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(flat == "", 0).otherwise(F.size(F.filter(F.split(flat, " "), lambda w: w != ""))).cast("bigint")


def numbered(rows: DataFrame, order: list[Column], by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows sorted and cut, with __mix_part and __mix_at; parts: by, __mix_part, __mix_first, __mix_before, __mix_rows).

    A row's rank within its group is __mix_before + __mix_at - __mix_first; __mix_rows are those of the group. Groups
    may span partitions, and no window goes over more rows than there are partitions.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = cut(rows.withColumn("__mix_at", F.monotonically_increasing_id()))
    # partition and row within it are the halves of the id
    rows = rows.withColumn("__mix_part", F.shiftrightunsigned("__mix_at", 33))
    spans = rows.groupBy(*by, "__mix_part").agg(F.min("__mix_at").alias("__mix_first"), F.count("*").alias("__mix_rows"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__mix_rows").over(group.orderBy("__mix_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows, spans.withColumn("__mix_before", before).withColumn("__mix_rows", F.sum("__mix_rows").over(group))


def few(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if frame.count() <= BROADCAST_SOURCES else frame


def source_table(rows: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """__mix_source, source_size, target: one row a source, from partial sums."""
    sizes = rows.groupBy("__mix_source").agg(F.sum("size").alias("source_size")).withColumn("__mix_all", F.lit(0))
    found, parts = numbered(sizes, [F.col("__mix_source").asc_nulls_last()], ["__mix_all"])
    found = found.join(few(parts.drop("__mix_all")), "__mix_part")
    place = F.col("__mix_before") + F.col("__mix_at") - F.col("__mix_first")
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    found = cut(found.select("__mix_source", "source_size", weight.alias("__mix_weight")))
    level, full = F.lit(0.0), -1
    while True:
        above = level * F.col("__mix_weight") > most * F.col("source_size")
        sums = found.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("source_size"))).alias("capped"), F.sum(F.when(~above, F.col("__mix_weight"))).alias("weight"), F.count_if(above).alias("full")).first()
        if sums["full"] == full or not sums["weight"]:
            break
        full, level = sums["full"], F.lit((sums["all"] - most * (sums["capped"] or 0)) / sums["weight"])
    return found.select("__mix_source", "source_size", F.least(most * F.col("source_size"), level * F.col("__mix_weight")).alias("target"))


def long_copies(sizes: Column, rate: Column, most: int) -> Column:
    """struct<left, copies>: whole numbers of copies for sizes in falling order, and the words left over (below 0: too many)."""

    def take(state: Column, size: Column) -> Column:
        want = state["left"] + rate * size
        n = F.greatest(F.lit(0), F.least(F.lit(most), F.round(want / size).cast("int")))
        return F.struct((want - n * size).alias("left"), F.concat(state["copies"], F.array(n)).alias("copies"))

    return F.aggregate(sizes, F.struct(F.lit(0.0).alias("left"), F.array().cast("array<int>").alias("copies")), take)


def mix(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, key: str = "doc_id", text: str = "text", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all, unless given), size, source_size, target, copies."""
    own = {"size", "source_size", "target", "copies"}
    carry = [c for c in (carry or docs.columns) if c not in own]
    rows = docs.select(*carry, word_count(F.col(text)).alias("size"), F.col(source).cast("string").alias("__mix_source"), F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("__mix_turn"))
    if text not in carry:  # narrow rows: words are counted once and not again for sums, bounds and the sort
        rows = cut(rows)
    aims = cut(source_table(rows.select("__mix_source", "size"), weights, most))
    order = [F.col("__mix_source").asc_nulls_last(), F.col("size"), F.col("__mix_turn")]
    rows, spans = numbered(rows, order, ["__mix_source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    facts = few(aims.withColumnRenamed("__mix_source", "__mix_name"))
    is_long = (F.col("size") * LONG > F.col("target")) & (F.col("size") * MANY > F.col("source_size"))
    longs = rows.select("__mix_source", "size").join(facts, F.col("__mix_source").eqNullSafe(F.col("__mix_name"))).filter(is_long)
    longs = longs.groupBy("__mix_source").agg(F.sort_array(F.collect_list("size"), asc=False).alias("sizes"), F.sum("size").alias("__mix_long"))
    longs = longs.withColumnRenamed("__mix_source", "__mix_name2")
    aims = aims.join(few(longs), F.col("__mix_source").eqNullSafe(F.col("__mix_name2")), "left")
    aims = aims.withColumn("__mix_taken", long_copies(F.coalesce("sizes", F.array().cast("array<bigint>")), rate, math.ceil(most)))
    others = F.col("source_size") - F.coalesce("__mix_long", F.lit(0))
    remains = rate * others + F.col("__mix_taken.left")
    share = F.when(others > 0, F.greatest(F.lit(0.0), F.least(F.lit(most), remains / others))).otherwise(rate)
    first = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("__mix_source", F.lit("\0null"))), F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))
    aims = cut(aims.select(F.col("__mix_source").alias("__mix_name"), "source_size", "target", share.alias("__mix_rate"), first.alias("__mix_draw"), F.col("__mix_taken.copies").alias("__mix_whole")))
    spans = spans.join(few(aims), F.col("__mix_source").eqNullSafe(F.col("__mix_name"))).drop("__mix_name")
    spans = cut(spans.withColumnsRenamed({"__mix_source": "__mix_name", "__mix_part": "__mix_place"}))
    rows = rows.join(few(spans), (F.col("__mix_part") == F.col("__mix_place")) & F.col("__mix_source").eqNullSafe(F.col("__mix_name")))
    rank = F.col("__mix_before") + F.col("__mix_at") - F.col("__mix_first")
    behind = (F.col("__mix_rows") - 1 - rank).cast("int")
    before, after = (F.floor(F.col("__mix_draw") + n.cast("double") * F.col("__mix_rate")) for n in (rank, rank + 1))
    copies = F.when(behind < F.size("__mix_whole"), F.get("__mix_whole", behind)).otherwise(F.least(after - before, F.lit(math.ceil(most))))
    return rows.withColumn("copies", copies.cast("bigint")).select(*carry, "size", "source_size", "target", "copies")


def emitted(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as many times as it has copies."""
    return mixed.filter("copies > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(*columns)
