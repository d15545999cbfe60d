"""Project overview, promoted facts, purpose paragraphs, fact quality and snapshot drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ids import edge_fact, identity, node_fact
from .traverse import degrees

# Folders that don't stand for a tree.
UNREPRESENTATIVE = ("examples", "example", "fixtures", "fixture", "samples", "sample")
DOCUMENTATION = ("docs", "doc")


def counts_by_type(rows: DataFrame, column: str = "type") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("count"))


def language_histogram(files: DataFrame) -> DataFrame:
    return files.filter("status = 'active'").groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("files"))


def listing(nodes: DataFrame, types: tuple[str, ...], limit: int = 50) -> DataFrame:
    return nodes.filter(F.col("type").isin(*types)).orderBy("path", F.col("start_line").asc_nulls_first(), "name", "id").limit(limit).select("type", "name", "path", "start_line")


def overview(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    return {
        "languages": language_histogram(files), "nodes_by_type": counts_by_type(nodes), "edges_by_type": counts_by_type(edges),
        "entrypoints": listing(nodes, ("Route", "CLICommand")), "config": listing(nodes, ("ConfigFile", "ConfigKey", "EnvVar")),
        "workflows": listing(nodes, ("GitHubWorkflow", "GitHubJob", "GitHubStep")), "services": listing(nodes, ("DockerService", "KubernetesResource")),
    }


def report(root: str, parts: dict[str, DataFrame]) -> str:
    """The overview as Markdown."""
    lines = ["# Graph report", "", f"Generated from `{root}`."]
    for title, rows in parts.items():
        lines += ["", f"## {title.replace('_', ' ').title()}", ""]
        found = rows.orderBy(*rows.columns).collect()
        lines += ["- " + ", ".join(f"{k}: {v}" for k, v in r.asDict().items()) for r in found] or ["- None detected"]
    return "\n".join(lines) + "\n"


def promoted(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...], limit: int, by_degree: bool = False, by_type: bool = False, withhold: tuple[str, ...] = UNREPRESENTATIVE) -> DataFrame:
    """The facts to show first: with a location, outside test files and withheld folders; by type order or degree, then short paths.

    Degrees are summed once for all nodes; nothing is looked up by node.
    """
    location = F.coalesce(F.nullif("path", F.lit("")), F.get_json_object("metadata", "$.observation.path"))
    line = F.coalesce("start_line", F.when(F.coalesce("path", F.lit("")) == "", F.get_json_object("metadata", "$.observation.line").cast("int")))
    rows = nodes.filter(F.col("type").isin(*types)).withColumns({"location": location, "line": line}).filter("location is not null")
    tests = nodes.filter("type = 'TestFile'").select(F.col("path").alias("location")).distinct()
    # a withheld folder on the way, or a location that is no more than the folder's name
    parts = F.split("location", "/")
    folders = F.when(F.size(parts) > 1, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    rows = rows.join(tests, "location", "left_anti").filter(~F.arrays_overlap(folders, F.array(*map(F.lit, withhold))))
    order = []
    if by_type:
        order.append(F.coalesce(*[F.when(F.col("type") == t, i) for i, t in enumerate(types)]))
    if by_degree:
        rows = rows.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        order.append(F.desc("degree"))
    order += [F.length("location"), F.col("location"), F.col("start_line").asc_nulls_last(), F.col("name"), F.col("id")]
    shown = [F.coalesce("qualified_name", "name").alias("text"), "type", "location", "line"] + (["degree"] if by_degree else [])
    return rows.orderBy(*order).limit(limit).select(*shown)


def purpose(texts: DataFrame, limit: int = 3) -> DataFrame:
    """path, paragraph: of each text the first block that states something (has . ! or ?) and isn't a list, heading or fence."""
    blocks = F.split(F.coalesce("content", F.lit("")), r"\n\s*\n")
    plain = F.filter(F.transform(blocks, lambda b: F.trim(F.regexp_replace(b, r"\s+", " "))), lambda b: b.rlike(r"[.!?]") & ~b.rlike(r"^([-*+]\s|\d+[.)]\s|#|```)"))
    rows = texts.withColumn("paragraph", F.get(plain, F.lit(0))).filter("paragraph is not null")
    return rows.orderBy(F.length("path"), "path").limit(limit).select("path", "paragraph")


def fact_keys(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """fact: stable texts of nodes and edges. All are shuffled for their distinct; bridge.facts() makes those of the tables from keys."""
    own = nodes.select("id", identity(*[F.col(x) for x in ("type", "name", "qualified_name", "path")]).alias("identity"))
    of_edges = edges.join(own.select(F.col("id").alias("source_node_id"), F.col("identity").alias("s")), "source_node_id").join(own.select(F.col("id").alias("target_node_id"), F.col("identity").alias("t")), "target_node_id")
    return own.select(node_fact(F.col("identity")).alias("fact")).unionByName(of_edges.select(edge_fact(F.col("type"), F.col("s"), F.col("t"), F.col("path")).alias("fact"))).distinct()


def accuracy(actual: DataFrame, expected: DataFrame, forbidden: DataFrame, key: str = "fact") -> DataFrame:
    """One row: expected, forbidden, true_positives, false_negatives, false_positives, precision, recall, passed."""
    facts = actual.select(key).distinct()
    want, never = expected.select(key).distinct(), forbidden.select(key).distinct()
    a = want.join(facts.withColumn("_in", F.lit(1)), key, "left").agg(F.count("*").alias("expected"), F.count("_in").alias("true_positives"))
    b = never.join(facts.withColumn("_in", F.lit(1)), key, "left").agg(F.count("*").alias("forbidden"), F.count("_in").alias("false_positives"))
    out = a.crossJoin(b)  # one row each
    t, n, p = F.col("true_positives"), F.col("expected"), F.col("false_positives")
    return out.select("expected", "forbidden", "true_positives", (n - t).alias("false_negatives"), "false_positives", F.round(F.when(t + p > 0, t / (t + p)).otherwise(1.0), 6).alias("precision"), F.round(F.when(n > 0, t / n).otherwise(1.0), 6).alias("recall"), ((n == t) & (p == 0)).alias("passed"))


def accuracy_by_entry(actual: DataFrame, expected: DataFrame, forbidden: DataFrame, entry: str = "entry", key: str = "fact") -> DataFrame:
    """accuracy() for each corpus entry (a column of all three): one pass over the labelled facts."""
    facts = actual.select(entry, key).distinct().withColumn("_in", F.lit(1))
    marks = expected.select(entry, key, F.lit(True).alias("want")).unionByName(forbidden.select(entry, key, F.lit(False).alias("want"))).distinct()
    t, n, p = F.col("true_positives"), F.col("expected"), F.col("false_positives")
    out = marks.join(facts, [entry, key], "left").groupBy(entry).agg(F.count_if("want").alias("expected"), F.count_if(~F.col("want")).alias("forbidden"), F.count_if(F.col("want") & F.col("_in").isNotNull()).alias("true_positives"), F.count_if(~F.col("want") & F.col("_in").isNotNull()).alias("false_positives"))
    return out.select("*", (n - t).alias("false_negatives"), F.round(F.when(t + p > 0, t / (t + p)).otherwise(1.0), 6).alias("precision"), F.round(F.when(n > 0, t / n).otherwise(1.0), 6).alias("recall"), ((n == t) & (p == 0)).alias("passed"))


def structural_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.filter("type <> 'CO_CHANGED_WITH'").agg(F.count("*").alias("edges")))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences of two rows of counts."""
    names = before.columns
    both = before.crossJoin(after.select(*[F.col(c).alias(f"n_{c}") for c in names]))
    return both.select(*[(F.col(f"n_{c}") - F.col(c)).alias(f"{c}_drift") for c in names], (F.lit(True) if not names else sum((F.abs(F.col(f"n_{c}") - F.col(c)) for c in names), F.lit(0)) > 0).alias("drifted"))
