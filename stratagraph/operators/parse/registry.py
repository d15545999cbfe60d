"""Which parsers take which files, and the pass over a DataFrame of files."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import config, generic, light, markdown, python_code, routes
from .model import Parsed

_DOTENV = re.compile(r"(^|/)\.env(\.[\w-]+)?$|\.env$")
_DOCKER = re.compile(r"(^|/)(dockerfile(\.[^/]*)?|[^/]*\.dockerfile)$", re.I)

#: name, test of the path, parser; in the order in which they run.
PARSERS: list[tuple[str, Callable[[str], bool], Callable[[str, str], Parsed]]] = [
    ("generic", lambda p: True, generic.parse),
    ("markdown", lambda p: p.lower().endswith((".md", ".markdown")), markdown.parse),
    ("dotenv", lambda p: bool(_DOTENV.search(p)), config.parse_dotenv),
    ("json", lambda p: p.lower().endswith(".json"), config.parse_json),
    ("toml", lambda p: p.lower().endswith(".toml"), config.parse_toml),
    ("go.mod", lambda p: posixpath.basename(p) == "go.mod", config.parse_go_mod),
    ("yaml", lambda p: p.lower().endswith((".yaml", ".yml")), config.parse_yaml),
    ("dockerfile", lambda p: bool(_DOCKER.search(p)), config.parse_dockerfile),
    ("python", lambda p: p.lower().endswith(".py"), python_code.parse),
    ("light", lambda p: posixpath.splitext(p)[1].lower() in light.LANGUAGES, light.parse),
    ("routes", lambda p: p.lower().endswith((".py", ".js", ".ts", ".mjs", ".cjs", ".jsx", ".tsx")), routes.parse_routes),
    ("cli", lambda p: p.lower().endswith(".py"), routes.parse_cli),
]
ROW = "path string, kind string, payload string"
NODE = "id string, type string, name string, qualified_name string, path string, start_line int, end_line int, language string, metadata string, confidence double, extractor string"
EDGE = "id string, type string, source_node_id string, target_node_id string, path string, start_line int, end_line int, metadata string, confidence double, extractor string, is_inferred boolean"
TEXT = "path string, name string, content string, node_id string"


def parse_one(path: str, content: str) -> Iterator[tuple[str, str]]:
    """(kind, JSON) of all that the file's parsers give."""
    for name, takes, parse in PARSERS:
        if not takes(path):
            continue
        try:
            found = parse(path, content)
        except Exception as error:  # a parser's failure is a warning about the file, and never shows its content
            yield "warning", json.dumps(f"{path}: {name} failed: {type(error).__name__}")
            continue
        for kind, rows in (("node", found.nodes), ("edge", found.edges), ("text", found.texts), ("warning", found.warnings)):
            for row in rows:
                yield kind, json.dumps(row)


def parse_files(files: DataFrame) -> DataFrame:
    """files(path, content) -> path, kind ('node', 'edge', 'text', 'warning'), payload as JSON. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, str, str]] = []
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                path = path.as_py() or ""
                rows += [(path, kind, payload) for kind, payload in parse_one(path, content.as_py() or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["path", "kind", "payload"])

    return files.select("path", F.col("content").cast("string")).mapInArrow(run, ROW)


def relations(parsed: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges, texts, warnings of parse_files(); of several rows with one id the last by path wins."""
    def typed(kind: str, schema: str) -> DataFrame:
        return parsed.filter(F.col("kind") == kind).select(F.col("path").alias("_path"), F.from_json("payload", schema).alias("r")).select("_path", "r.*")

    def unique(rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c != "_path"]
        return rows.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("_path", "metadata")).alias("r")).select("r.*")

    warnings = parsed.filter("kind = 'warning'").select("path", F.col("payload").alias("warning"))
    return {"nodes": unique(typed("node", NODE)), "edges": unique(typed("edge", EDGE)), "texts": typed("text", TEXT).drop("_path"), "warnings": warnings}


def base_name(path: str) -> str:
    return posixpath.basename(path)
