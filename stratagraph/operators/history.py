"""Change history: co-change mining, churn, ownership, rename continuity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

MAX_FILES = 50
MIN_SUPPORT = 2
SHAS_KEPT = 20
CONFIDENCE = 0.55


def commit_sizes(commit_files: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """sha, k, co_change_excluded ('oversized' where k is above max_files, else null)."""
    sizes = commit_files.groupBy("sha").agg(F.countDistinct("path").alias("k"))
    return sizes.withColumn("co_change_excluded", F.when(F.col("k") > max_files, "oversized"))


def co_change_pairs(commit_files: DataFrame, files: DataFrame, max_files: int = MAX_FILES, min_support: int = MIN_SUPPORT) -> DataFrame:
    """p1 < p2, support, weighted, score, confidence.

    Every unordered pair of a commit of k files weighs 1 / (k - 1); the score divides by the smaller file's commits,
    one-file commits included. A commit has at most max_files files, so that pairs grow with commits, not squared.
    The pair join is on the commit, whose rows are bounded; the shuffle by pair has partial sums.
    """
    base = commit_files.select("sha", "path").distinct()
    # sizes by partial sums: a commit of any number of files is counted without meeting in one task, and then is gone
    sizes = base.groupBy("sha").agg(F.count("*").alias("k")).filter(F.col("k") <= max_files)
    sized = base.join(sizes, "sha")
    per_path = sized.groupBy("path").agg(F.count("*").alias("n"))
    many = sized.filter("k >= 2")
    pairs = many.alias("a").join(many.alias("b"), (F.col("a.sha") == F.col("b.sha")) & (F.col("a.path") < F.col("b.path")))
    pairs = pairs.groupBy(F.col("a.path").alias("p1"), F.col("b.path").alias("p2")).agg(F.count("*").alias("support"), F.sum(1 / (F.col("a.k") - 1)).alias("weighted"))
    pairs = pairs.filter(F.col("support") >= min_support)
    active = files.filter("status = 'active'").select("path").join(per_path, "path")
    pairs = pairs.join(active.select(F.col("path").alias("p1"), F.col("n").alias("n1")), "p1").join(active.select(F.col("path").alias("p2"), F.col("n").alias("n2")), "p2")
    # sums of fractions differ in the last bits with their order
    score = F.least(F.lit(1.0), F.round("weighted", 9) / F.least("n1", "n2"))
    return pairs.select("p1", "p2", "support", F.round("weighted", 4).alias("weighted"), F.round(F.round(score, 9), 4).alias("score"), F.round(F.round(CONFIDENCE * score, 9), 3).alias("confidence"))


def supporting_commits(commit_files: DataFrame, commits: DataFrame, pairs: DataFrame, keep: int = SHAS_KEPT, max_files: int = MAX_FILES) -> DataFrame:
    """p1, p2, sha, place: the newest commits (by log order) of the given pairs, at most ``keep`` a pair."""
    ok = commit_sizes(commit_files, max_files).filter("co_change_excluded is null").select("sha")
    base = commit_files.select("sha", "path").distinct().join(ok, "sha", "left_semi")
    one = pairs.select("p1", "p2").join(base.withColumnRenamed("path", "p1"), "p1")
    both = one.join(base.withColumnRenamed("path", "p2"), ["p2", "sha"])
    ranked = both.join(commits.select("sha", "seq"), "sha").withColumn("place", F.row_number().over(Window.partitionBy("p1", "p2").orderBy(F.desc("seq"))))
    return ranked.filter(F.col("place") <= keep).select("p1", "p2", "sha", "place")


def partners(pairs: DataFrame, path: str, limit: int = 20) -> DataFrame:
    """The files changed with one file, the most confident first."""
    own = pairs.filter((F.col("p1") == path) | (F.col("p2") == path))
    own = own.select(F.when(F.col("p1") == path, F.col("p2")).otherwise(F.col("p1")).alias("partner"), "support", "score", "confidence")
    return own.orderBy(F.desc("confidence"), F.desc("support"), "partner").limit(limit)


def historical_co_change(pairs: DataFrame, paths: DataFrame, limit: int = 20, only_external: bool = False) -> DataFrame:
    """Pairs that touch any of paths (column path); with only_external exactly one side does. The limit comes last."""
    marks = paths.select("path").distinct()
    flagged = pairs.join(marks.select(F.col("path").alias("p1"), F.lit(True).alias("in1")), "p1", "left").join(marks.select(F.col("path").alias("p2"), F.lit(True).alias("in2")), "p2", "left")
    flagged = flagged.withColumns({"in1": F.coalesce("in1", F.lit(False)), "in2": F.coalesce("in2", F.lit(False))})
    hit = flagged.filter((F.col("in1") != F.col("in2")) if only_external else (F.col("in1") | F.col("in2")))
    hit = hit.select(F.when(F.col("in1"), F.col("p1")).otherwise(F.col("p2")).alias("co_changed_with"), F.when(F.col("in1"), F.col("p2")).otherwise(F.col("p1")).alias("partner"), (F.col("in1") & F.col("in2")).alias("partner_changed"), "support", "score", "confidence")
    return hit.orderBy(F.desc("confidence"), "co_changed_with", "partner").limit(limit)


def churn_hotspots(commits: DataFrame, commit_files: DataFrame, files: DataFrame, limit: int = 20) -> DataFrame:
    """Active files by commits, then changed lines, then path."""
    rows = commit_files.join(files.filter("status = 'active'").select("path"), "path", "left_semi").join(commits.select("sha", "author_email", "committed_at"), "sha")
    out = rows.groupBy("path").agg(F.count("*").alias("commits"), F.sum(F.coalesce("additions", F.lit(0))).alias("additions"), F.sum(F.coalesce("deletions", F.lit(0))).alias("deletions"), F.countDistinct("author_email").alias("authors"), F.max("committed_at").alias("last_changed"))
    return out.orderBy(F.desc("commits"), F.desc(F.col("additions") + F.col("deletions")), "path").limit(limit)


def ownership(commits: DataFrame, commit_files: DataFrame, path: str | None = None, limit: int = 10) -> DataFrame:
    """Authors by commits; the share is of all distinct matching commits, not of the rows shown."""
    rows = commit_files if path is None else commit_files.filter(F.col("path") == path)
    rows = rows.join(commits.select("sha", "author_name", "author_email", "committed_at"), "sha")
    total = rows.agg(F.countDistinct("sha").alias("total"))
    out = rows.groupBy("author_name", "author_email").agg(F.countDistinct("sha").alias("commits"), F.sum(F.coalesce("additions", F.lit(0))).alias("additions"), F.sum(F.coalesce("deletions", F.lit(0))).alias("deletions"), F.min("committed_at").alias("first_commit"), F.max("committed_at").alias("last_commit"))
    out = out.orderBy(F.desc("commits"), "author_email").limit(limit)
    # one row joins the few that the limit has left
    share = F.round(F.col("commits") / F.greatest("total", F.lit(1)), 4)
    return out.crossJoin(F.broadcast(total)).withColumn("share", share).drop("total").orderBy(F.desc("commits"), "author_email")


def rename_targets(renames: DataFrame, rounds: int = 20) -> DataFrame:
    """old, current: chains of renames followed to their end by pointer jumping; cycles end where they began.

    renames: old, new, one row each old path (the newest). Doubling makes rounds logarithmic in chain length.
    """
    now = renames.groupBy("old").agg(F.max("new").alias("current")).filter("old <> current")
    for _ in range(rounds):
        step = now.select(F.col("old").alias("current"), F.col("current").alias("further"))
        after = now.join(step, "current", "left").select("old", F.coalesce(F.when(F.col("further") != F.col("old"), F.col("further")), F.col("current")).alias("current"))
        after = cut(after)
        if after.exceptAll(now).isEmpty():
            return after
        now = after
    return now
