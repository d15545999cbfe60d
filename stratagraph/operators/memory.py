"""Session memory: reading, anchors and their verification, references in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What parts words outside backticks; what a word of a path, and of a file's name, looks like.
_BETWEEN = r"""[\s,;()\[\]{}<>"'`]+"""
_STEP = r"[\p{L}\p{N}_.@+-]+"
_PATH, _FILE = rf"^{_STEP}(/{_STEP})+$", rf"^{_STEP}\.[A-Za-z0-9]{{1,12}}$"


def read(entries: DataFrame, topic: str | None = None, limit: int | None = 10, columns: tuple[str, ...] = ("summary",)) -> DataFrame:
    """The newest sessions, of those that hold the topic in any of the columns, whatever the case."""
    rows = entries
    if topic:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(topic.lower()), F.lit(False))
        rows = rows.filter(hit)
    rows = rows.orderBy(F.desc("created_at"), *[c for c in ("entry_id", "summary") if c in entries.columns])
    return rows if limit is None else rows.limit(limit)


def _quoted(parts: Column, part: Column, i: Column) -> Column:
    """Whether a part of a text that was split at backticks stands between two of them, on one line."""
    return (i % 2 == 1) & (i < F.size(parts) - 1) & ~F.contains(part, F.lit("\n"))


def _words(text: Column) -> Column:
    """Words outside backticks, without the marks that end sentences."""
    parts = F.split(text, "`")
    outside = F.array_join(F.transform(parts, lambda p, i: F.when(_quoted(parts, p, i), F.lit("")).otherwise(p)), " ")
    return F.filter(F.transform(F.split(outside, _BETWEEN), lambda w: F.regexp_replace(w, r"[.:!?]+$", "")), lambda w: w != "")


def _is_reference(word: Column) -> Column:
    return word.rlike(_PATH) | word.rlike(_FILE)


def references(text: Column) -> Column:
    """Distinct explicit references: parts in backticks, and words that look like paths or file names."""
    parts = F.split(text, "`")
    quoted = F.filter(F.transform(F.filter(parts, lambda p, i: _quoted(parts, p, i)), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.concat(quoted, F.filter(_words(text), _is_reference)))


def code_tokens(text: Column) -> Column:
    """Code-shaped names in the other words: dotted, underscored or with an inner capital."""
    plain = F.array_join(F.filter(_words(text), lambda w: ~_is_reference(w)), " ")
    names = F.transform(F.split(plain, "[^A-Za-z0-9_.]+"), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    return F.array_distinct(F.filter(names, lambda w: w.rlike("^[A-Za-z_]") & ~F.contains(w, F.lit("..")) & w.rlike("[._]|[a-z0-9][A-Z]")))


def verify_anchors(anchors: DataFrame, nodes: DataFrame, commit_files: DataFrame | None = None) -> DataFrame:
    """Adds found_id, provenance and verdict to anchors (id, type, name, path, start_line, end_line expected).

    By stable id; else by a rename: the one current path that a commit changed under the expected path, and the one
    node of the same type and name there. verified, drifted (path or lines differ) or invalidated.
    """
    facts = nodes.select(F.col("id").alias("found_id"), F.col("path").alias("f_path"), F.col("start_line").alias("f_start"), F.col("end_line").alias("f_end"))
    rows = anchors.join(facts, anchors["id"] == facts["found_id"], "left").withColumn("provenance", F.when(F.col("found_id").isNotNull(), "stable-node-id"))
    if commit_files is not None:
        moved = commit_files.filter(F.col("original_path").isNotNull() & (F.col("original_path") != F.col("path"))).select(F.col("original_path").alias("path"), F.col("path").alias("now")).distinct()
        # only names that some anchor asks for, so that candidates stay few
        wanted = rows.filter("found_id is null").select("path", "type", "name").distinct().join(moved, "path")
        there = nodes.select(F.col("id").alias("r_id"), "type", "name", F.col("path").alias("now"), F.col("start_line").alias("r_start"), F.col("end_line").alias("r_end"))
        found = wanted.join(there, ["type", "name", "now"]).groupBy("path", "type", "name").agg(F.countDistinct("r_id").alias("n"), F.min(F.struct("r_id", "now", "r_start", "r_end")).alias("r")).filter("n = 1")
        rows = rows.join(found, ["path", "type", "name"], "left")
        by_name = F.col("found_id").isNull() & F.col("r").isNotNull()
        values = {"found_id": "r_id", "f_path": "now", "f_start": "r_start", "f_end": "r_end"}
        rows = rows.withColumn("provenance", F.when(by_name, "git-rename").otherwise(F.col("provenance")))
        rows = rows.select(*[F.coalesce(F.col(c), F.col(f"r.{values[c]}")).alias(c) if c in values else F.col(c) for c in rows.columns if c not in ("n", "r")])
    same = F.col("f_path").eqNullSafe(F.col("path")) & F.col("f_start").eqNullSafe(F.col("start_line")) & F.col("f_end").eqNullSafe(F.col("end_line"))
    verdict = F.when(F.col("found_id").isNull(), "invalidated").when(same, "verified").otherwise("drifted")
    return rows.select(*anchors.columns, "found_id", F.coalesce("provenance", F.lit("unresolved")).alias("provenance"), verdict.alias("verdict"))


def entry_verdicts(entries: DataFrame, verified: DataFrame, key: str = "entry_id") -> DataFrame:
    """Each entry's worst verdict, 'unanchored' without anchors."""
    rank = F.when(F.col("verdict") == "invalidated", 2).when(F.col("verdict") == "drifted", 1).otherwise(0)
    worst = verified.groupBy(key).agg(F.max(rank).alias("worst"))
    named = F.when(F.col("worst") == 2, "invalidated").when(F.col("worst") == 1, "drifted").when(F.col("worst") == 0, "verified").otherwise("unanchored")
    return entries.select(key).join(worst, key, "left").select(key, named.alias("verdict"))


def verdict_histogram(verdicts: DataFrame) -> DataFrame:
    """All four verdicts with their counts, also where none."""
    every = verdicts.sparkSession.createDataFrame([(v,) for v in ("verified", "drifted", "invalidated", "unanchored")], "verdict string")
    return every.join(verdicts.groupBy("verdict").agg(F.count("*").alias("entries")), "verdict", "left").select("verdict", F.coalesce("entries", F.lit(0)).cast("bigint").alias("entries"))


def session_markdown(entry: dict) -> str:
    """A session as Markdown, to be appended to a log."""
    parts = [f"## Session {entry['created_at']}", f"### Summary\n{entry.get('summary', '')}"]
    for key in ("decisions", "assumptions", "open_questions", "changed_files", "next_steps"):
        values = entry.get(key) or ["None recorded."]
        parts.append("\n".join([f"### {key.replace('_', ' ').title()}", *(f"- {v}" for v in values)]))
    return "\n\n".join(parts) + "\n"
