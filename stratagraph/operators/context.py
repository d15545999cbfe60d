"""What a change touches: stale documents and impacts of all changed nodes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import joined
from .intervals import innermost
from .parse import parse_files, relations
from .traverse import impact, merged_impact


def stale_docs(nodes: DataFrame, edges: DataFrame, changed: DataFrame, changed_docs: DataFrame) -> DataFrame:
    """doc_path, line, target: mentions of changed nodes (id) in documents that aren't changed themselves (path)."""
    hit = edges.filter("type = 'MENTIONS'").join(changed.select(F.col("id").alias("target_node_id")), "target_node_id", "left_semi")
    rows = hit.join(nodes.select(F.col("id").alias("source_node_id"), F.col("path").alias("doc_path")), "source_node_id")
    rows = rows.join(changed_docs.select(F.col("path").alias("doc_path")), "doc_path", "left_anti")
    return rows.select("doc_path", F.col("start_line").alias("line"), F.col("target_node_id").alias("target")).distinct()


def historical_path_docs(references: DataFrame, old_paths: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_path, line, path, section: documents that still refer to paths that were renamed or deleted.

    references: doc_id, doc_path, value, line. A reference counts as it stands or relative to its document.
    """
    gone = old_paths.select("path").distinct()
    rows = references.withColumn("path", F.explode(F.array_distinct(F.filter(F.array(F.col("value"), joined(F.col("doc_path"), F.col("value"))), lambda x: x.isNotNull()))))
    rows = rows.join(gone, "path", "left_semi").select("doc_id", "doc_path", "path", "line").distinct()
    return innermost(rows, sections, "doc_path", "line", F.col("doc_id")).select("doc_path", "line", "path", "section")


def aggregate_impacts(changed: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """Impacts of all changed nodes (root, id), followed together and merged by node."""
    return merged_impact(impact(changed, edges, depth))


def deleted_nodes(old_files: DataFrame) -> DataFrame:
    """Nodes that deleted files had: old_files(path, content) as they were, parsed again."""
    return relations(parse_files(old_files))["nodes"]
