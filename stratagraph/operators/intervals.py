"""Line intervals: hunks, merging, overlap with symbols, the innermost section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import stored

#: Lines are whole numbers of 32 bits, as in the schema; a section without an end goes on to the last.
LAST_LINE, SIZES = 2**31 - 1, 33

#: Lines of a bucket in the bucketed overlap join.
BUCKET = 128


def hunk_ranges(patches: DataFrame, patch: str = "patch") -> DataFrame:
    """Adds side ('old' or 'new'), start, end for each hunk header of a unified patch; empty sides fall away."""
    pattern = F.lit(r"(?m)^@@ -(\d+(?:,\d+)?) \+(\d+(?:,\d+)?) @@")
    heads = F.arrays_zip(F.regexp_extract_all(patch, pattern, 1).alias("old"), F.regexp_extract_all(patch, pattern, 2).alias("new"))
    rows = patches.withColumn("_h", F.explode(heads)).withColumn("_s", F.explode(F.array(F.struct(F.lit("old").alias("side"), F.col("_h.old").alias("span")), F.struct(F.lit("new").alias("side"), F.col("_h.new").alias("span")))))
    start = F.split(F.col("_s.span"), ",")[0].cast("int")
    count = F.coalesce(F.get(F.split(F.col("_s.span"), ","), F.lit(1)).cast("int"), F.lit(1))
    return rows.select(*patches.columns, F.col("_s.side").alias("side"), start.alias("start"), (start + count - 1).alias("end")).filter("end >= start")


def merge_ranges(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping and adjoining intervals of a key as one (a new one begins where start > 1 + all earlier ends)."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    rows = rows.withColumn("_before", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.when(F.col("_before").isNull() | (F.col(start) > F.col("_before") + 1), 1).otherwise(0)
    rows = rows.withColumn("_island", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def overlapping(ranges: DataFrame, spans: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Spans (start_line, end_line) that overlap any range (start, end) of their key; each once.

    Both sides are spread over buckets of lines, so that a key with many spans joins by bucket and not all with all.
    """
    def buckets(a: Column, b: Column) -> Column:
        return F.explode(F.sequence(F.floor(a / BUCKET), F.floor(b / BUCKET)))

    last = F.coalesce("end_line", "start_line")
    left = spans.filter(F.col("start_line").isNotNull()).withColumn("_b", buckets(F.col("start_line"), F.greatest(last, F.col("start_line"))))
    right = ranges.select(F.col(key).alias("_k"), "start", "end", buckets(F.col("start"), F.col("end")).alias("_b2"))
    hit = (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_b2")) & (F.col("start_line") <= F.col("end")) & (last >= F.col("start"))
    return left.join(right, hit, "left_semi").select(*columns).distinct()


def changed_symbols(ranges: DataFrame, changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols of changed files (path) that a changed range touches; all symbols of files without ranges."""
    columns = ["id", "path", "name", "type", "start_line", "end_line"]
    whole = changed.select("path").distinct().join(ranges.select("path").distinct(), "path", "left_anti")
    return overlapping(ranges, symbols, "path", columns).unionByName(symbols.join(whole, "path", "left_semi").select(*columns)).distinct()


def innermost(points: DataFrame, sections: DataFrame, key: str, line: str, fallback: Column) -> DataFrame:
    """Adds section: of the sections (key, section_id, start_line, end_line) that hold the line, the one that starts last.

    The fallback stands where none holds it or the line is null. Sections are parted into aligned pieces of 2**k lines, of
    which each keeps its best section; a line asks one piece of each size. So joins are by equality, with a row a line and
    size at most, and not of all sections with all lines of a key. What lines get is stored: points are joined with that.
    """
    def piece(level: str, place: str, ok: str) -> str:
        return f"if({ok}, named_struct('k', {level}, 'i', {place}), null)"

    # of the lines [a, b) the pieces of 2**k lines are those from a's to b's multiple; an odd one at either end is no half of a larger piece
    low, high = "-shiftright(-_a, k)", "shiftright(_b, k)"
    both = f"array({piece('k', low, f'{low} < {high} and {low} & 1 = 1')}, {piece('k', f'{high} - 1', f'{low} < {high} and {high} & 1 = 1')})"
    spans = sections.filter("start_line is not null and (end_line is null or end_line >= start_line)")
    spans = spans.groupBy(key, F.col("start_line").cast("bigint").alias("_a"), (F.coalesce(F.col("end_line").cast("bigint"), F.lit(LAST_LINE)) + 1).alias("_b")).agg(F.max("section_id").alias("section_id"))
    pieces = spans.withColumn("_p", F.explode(F.expr(f"filter(flatten(transform(sequence(0, {SIZES - 1}), k -> {both})), p -> p is not null)")))
    pieces = pieces.groupBy(key, F.col("_p.k").alias("_k"), F.col("_p.i").alias("_i")).agg(F.max(F.struct(F.col("_a"), "section_id")).alias("_s"))
    lines = points.select(key, F.col(line).cast("bigint").alias("_line")).distinct()
    asked = lines.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(SIZES - 1)))).withColumn("_i", F.expr("shiftright(_line, _k)"))
    best = asked.join(pieces, [key, "_k", "_i"]).groupBy(key, "_line").agg(F.max("_s")["section_id"].alias("section"))
    best = stored(best.select(F.col(key).alias("_key"), "_line", "section"))
    placed = points.join(best, (F.col(key) == F.col("_key")) & (F.col(line) == F.col("_line")), "left").drop("_key", "_line")
    return placed.withColumn("section", F.coalesce("section", fallback))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, columns: list[str]) -> DataFrame:
    """Each left row with the columns of the latest right row of the key whose ``at`` isn't later.

    Both sides are put together and sorted once by key and time; the last right row so far is carried along. No
    interval join. Equal times count; of right rows with equal times the greatest columns win.
    """
    value = F.struct(*[F.col(c).alias(c) for c in columns])
    kind = right.select(*columns).schema.simpleString()
    l = left.select(*by, F.col(at).alias("_at"), F.struct(*left.columns).alias("_row"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_value"))  # noqa: E741
    r = right.select(*by, F.col(at).alias("_at"), F.lit(None).cast(left.schema.simpleString()).alias("_row"), F.lit(0).alias("_side"), value.cast(kind).alias("_value"))
    order = Window.partitionBy(*by).orderBy("_at", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_last", F.last("_value", ignorenulls=True).over(order)).filter("_side = 1")
    return both.select("_row.*", *[F.col(f"_last.{c}").alias(c) for c in columns])
