"""Lookups of symbols, files, references, configuration and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CALLABLE_TYPES, CODE_TARGET_TYPES, SYMBOL_TYPES


def find_symbol(nodes: DataFrame, name: str, exact: bool = False, limit: int = 20, types: tuple[str, ...] = SYMBOL_TYPES) -> DataFrame:
    """Symbols whose name or qualified name is (or contains) the name, whatever the case; wildcards are plain text."""
    name = name.strip().lower()
    low, qualified = F.lower("name"), F.lower(F.coalesce("qualified_name", F.lit("")))
    hit = (low == name) | (qualified == name)
    if not exact:
        hit = hit | low.contains(name) | qualified.contains(name)
    rank = F.coalesce(*[F.when(F.col("type") == t, i) for i, t in enumerate(types)])
    rows = nodes.filter(F.col("type").isin(*types) & hit & F.lit(bool(name)))
    order = [F.when((low == name) | (qualified == name), 0).otherwise(1), rank, F.col("name"), F.col("path"), F.col("start_line").asc_nulls_first(), F.col("id")]
    return rows.orderBy(*order).limit(limit).select("id", "name", "qualified_name", "type", "path", "start_line", "end_line", "language")


def normalized_path(path: Column, root: str = "") -> Column:
    """Forward slashes, without a root prefix, leading ./ and trailing /."""
    out = F.replace(path, F.lit("\\"), F.lit("/"))
    if root:
        out = F.when(out.startswith(root.rstrip("/") + "/"), F.substring(out, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(out)
    return F.rtrim(F.regexp_replace(out, r"^(\./)+", ""), F.lit("/"))


def resolve_paths(wanted: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """wanted(value) -> value, path, how ('exact', 'suffix', 'ambiguous' or 'unresolved').

    A suffix resolves only if exactly one active file ends with it. Suffixes are joined by equality: each file offers all its
    trailing segment runs (as many as its path is deep), so that no comparison of all with all is needed.
    """
    active = files.filter("status = 'active'").select("path")
    asked = wanted.select("value", normalized_path(F.col("value"), root).alias("clean")).distinct()
    exact = asked.join(active.withColumn("clean", F.col("path")), "clean", "left")
    depth = F.size(F.split("path", "/"))
    segments = F.split("path", "/")
    tails = active.withColumn("tail", F.explode(F.transform(F.sequence(F.lit(1), depth), lambda i: F.lower(F.array_join(F.slice(segments, depth - i + 1, i), "/")))))
    by_tail = tails.join(asked.select(F.lower("clean").alias("tail")).distinct(), "tail", "left_semi").groupBy("tail").agg(F.count("*").alias("n"), F.min("path").alias("only"))
    out = exact.withColumn("tail", F.lower("clean")).join(by_tail, "tail", "left")
    how = F.when(F.col("path").isNotNull(), "exact").when(F.col("n") == 1, "suffix").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return out.select("value", F.coalesce("path", F.when(F.col("n") == 1, F.col("only"))).alias("path"), how.alias("how"))


def resolve_references(wanted: DataFrame, nodes: DataFrame, files: DataFrame, types: tuple[str, ...] = CODE_TARGET_TYPES) -> DataFrame:
    """wanted(value) -> value, status, provenance, candidates, node_id: the file first, then a unique symbol by name or qualified name."""
    by_path = resolve_paths(wanted, files)
    own = nodes.filter(F.col("type").isin(*types))
    keys = own.select("id", F.explode(F.array_distinct(F.array(F.col("name"), F.coalesce("qualified_name", F.col("name"))))).alias("value"))
    asked = wanted.select("value").distinct()
    found = keys.join(asked, "value").groupBy("value").agg(F.countDistinct("id").alias("candidates"), F.min("id").alias("one"))
    file_nodes = nodes.filter("type = 'File'").select(F.col("path").alias("file_path"), F.col("id").alias("file_id"))
    out = by_path.join(found, "value", "left").join(file_nodes, F.col("path") == F.col("file_path"), "left")
    is_file = F.col("path").isNotNull()
    status = F.when(is_file | (F.col("candidates") == 1), "resolved").when((F.col("candidates") > 1) | (F.col("how") == "ambiguous"), "ambiguous").otherwise("unresolved")
    provenance = F.when(is_file, F.concat(F.lit("file-"), F.col("how"))).when(F.col("candidates") == 1, "unique-symbol").when(F.col("candidates") > 1, "several-symbols").otherwise("none")
    return out.select("value", status.alias("status"), provenance.alias("provenance"), F.coalesce("candidates", F.lit(0)).alias("candidates"), F.when(is_file, F.col("file_id")).when(F.col("candidates") == 1, F.col("one")).alias("node_id"))


def trace_config(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """role (definition or usage), relation, name, type, path, start_line of a configuration name.

    Keys match by name, by qualified name or by its last part; keys that an edge names already aren't repeated.
    """
    name = name.strip().lower()
    env = nodes.filter((F.col("type") == "EnvVar") & (F.lower("name") == name)).orderBy("id").limit(1).select(F.col("id").alias("target_node_id"))
    wired = edges.filter(F.col("type").isin("SETS_ENV", "READS_ENV")).join(env, "target_node_id", "left_semi").select("source_node_id", F.col("type").alias("relation"))
    wired = wired.join(nodes.withColumnRenamed("id", "source_node_id"), "source_node_id").select(F.when(F.col("relation") == "SETS_ENV", "definition").otherwise("usage").alias("role"), "relation", "name", "type", "path", "start_line")
    qualified = F.lower(F.coalesce("qualified_name", F.lit("")))
    keys = nodes.filter((F.col("type") == "ConfigKey") & ((F.lower("name") == name) | (qualified == name) | qualified.like(f"%.{name}")))
    keys = keys.select(F.lit("definition").alias("role"), F.lit("DECLARES_CONFIG").alias("relation"), "name", "type", "path", "start_line")
    known = wired.filter("role = 'definition'").select("name", "path", "start_line")
    same = [keys[c].eqNullSafe(known[c]) for c in ("name", "path", "start_line")]
    return wired.unionByName(keys.join(known, same, "left_anti"))


def neighbours(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...], filters: Column | None = None) -> DataFrame:
    """Edges of some types with both ends' columns, prefixed s_ and t_."""
    ends = [nodes.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "type", "name", "qualified_name", "path", "start_line")]) for p in "st"]
    rows = edges.filter(F.col("type").isin(*kinds)).select(*[F.col(c).alias(f"e_{c}") for c in ("id", "type", "path", "start_line", "confidence", "metadata")], F.col("source_node_id").alias("s_id"), F.col("target_node_id").alias("t_id"))
    rows = rows.join(ends[0], "s_id").join(ends[1], "t_id")
    return rows if filters is None else rows.filter(filters)


def calls_out(nodes: DataFrame, edges: DataFrame, path: str, kind: str = "CALLS", limit: int = 15) -> DataFrame:
    """What a file's code calls (or instantiates)."""
    rows = neighbours(nodes, edges.filter(F.col("path") == path), (kind,))
    return rows.orderBy(F.col("e_start_line").asc_nulls_first(), "s_name", "t_name", "e_id").limit(limit).select(F.col("s_name").alias("caller"), F.col("t_name").alias("callee"), F.col("t_path").alias("callee_path"), F.col("e_start_line").alias("line"), F.col("e_confidence").alias("confidence"))


def called_by(nodes: DataFrame, edges: DataFrame, path: str, kind: str = "CALLS", limit: int = 15) -> DataFrame:
    """Who calls (or instantiates) a file's code from other files."""
    targets = CALLABLE_TYPES if kind == "CALLS" else ("Class",)
    wanted = nodes.filter((F.col("path") == path) & F.col("type").isin(*targets)).select(F.col("id").alias("target_node_id"))
    rows = neighbours(nodes, edges.filter(F.col("path") != path).join(wanted, "target_node_id", "left_semi"), (kind,))
    return rows.orderBy("s_path", F.col("e_start_line").asc_nulls_first(), "s_name", "t_name", "e_id").limit(limit).select(F.col("s_name").alias("caller"), F.col("s_path").alias("caller_path"), F.col("t_name").alias("callee"), F.col("e_start_line").alias("line"), F.col("e_confidence").alias("confidence"))


def imports_of(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Modules that a file's module imports: the first by line for each qualified name."""
    rows = neighbours(nodes, edges, ("IMPORTS",), (F.col("s_path") == path) & (F.col("s_type") == "Module"))
    return rows.groupBy(F.col("t_qualified_name").alias("qualified_name")).agg(F.min(F.struct("e_start_line", F.col("t_name").alias("name"), F.col("t_path").alias("path"))).alias("m")).select("qualified_name", "m.name", "m.path")


def imported_by(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    rows = neighbours(nodes, edges, ("IMPORTS",), (F.col("t_path") == path) & (F.col("t_type") == "Module"))
    return rows.select(F.col("s_path").alias("path"), F.col("s_name").alias("name")).distinct()


def env_reads(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    rows = neighbours(nodes, edges.filter(F.col("path") == path), ("READS_ENV",))
    return rows.select(F.col("t_name").alias("name"), F.col("e_start_line").alias("line")).distinct()


def symbol_parents(nodes: DataFrame, edges: DataFrame, path: str | None = None) -> DataFrame:
    """Symbols with the parent that the last structural edge (by line, then id) names; all files, or one."""
    own = nodes.filter(F.col("type").isin(*SYMBOL_TYPES))
    own = own if path is None else own.filter(F.col("path") == path)
    parent = edges.filter(F.col("type").isin("DEFINES", "CONTAINS")).groupBy(F.col("target_node_id").alias("id")).agg(F.max(F.struct(F.coalesce("start_line", F.lit(-1)), "id", "source_node_id"))["source_node_id"].alias("parent_id"))
    return own.join(parent, "id", "left").select("id", "name", "type", "path", "start_line", "parent_id")


def symbol_tree(nodes: DataFrame, edges: DataFrame, path: str) -> list[dict]:
    """The nested symbols of one file, assembled on the driver (a file's symbols are few)."""
    rows = [r.asDict() for r in symbol_parents(nodes, edges, path).orderBy("start_line", "id").collect()]
    by_id = {r["id"]: r | {"children": []} for r in rows}
    top = []
    for r in by_id.values():
        (by_id[r["parent_id"]]["children"] if r["parent_id"] in by_id else top).append(r)
    return top


def related_tests(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Test files that import the file's module, or whose stem (without test affixes) holds the file's stem or lies in it."""
    imports = neighbours(nodes, edges, ("IMPORTS",), (F.col("t_path") == path) & (F.col("t_type") == "Module") & (F.col("s_type") == "Module"))
    tests = nodes.filter("type = 'TestFile'").select("path", "name")
    by_import = tests.join(imports.select(F.col("s_path").alias("path")).distinct(), "path", "left_semi").select("path", F.lit("imports this module").alias("via"), F.lit(0).alias("rank"))
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
    core = F.regexp_replace(F.regexp_replace(F.lower("name"), r"\.[^.]*$", ""), r"^test_", "")
    core = F.regexp_replace(F.regexp_replace(core, r"_test$", ""), r"\.(test|spec)$", "")
    by_name = tests.withColumn("core", core).filter((F.col("core") != "") & (F.col("path") != path) & (F.lit(stem).contains(F.col("core")) | F.col("core").contains(stem))).select("path", F.lit("name match").alias("via"), F.lit(1).alias("rank"))
    both = by_import.unionByName(by_name)
    return both.groupBy("path").agg(F.min_by("via", "rank").alias("via"))


def doc_mentions(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    rows = neighbours(nodes, edges, ("MENTIONS",), F.col("t_path") == path)
    return rows.select(F.col("s_path").alias("path"), F.col("s_name").alias("name"), F.col("s_type").alias("type")).distinct()


def docs_for_code(nodes: DataFrame, edges: DataFrame, target: Column, limit: int = 50) -> DataFrame:
    """Documents that mention the target (a condition on t_ columns), the most confident first."""
    rows = neighbours(nodes, edges, ("MENTIONS",), target)
    order = [F.desc("e_confidence"), F.col("s_path"), F.col("e_start_line").asc_nulls_first(), F.col("t_type"), F.col("t_name"), F.col("e_id")]
    return rows.orderBy(*order).limit(limit).select(F.col("s_path").alias("doc_path"), F.col("s_name").alias("doc_name"), F.col("e_start_line").alias("line"), F.col("t_name").alias("target"), F.col("e_confidence").alias("confidence"), F.get_json_object("e_metadata", "$.raw_value").alias("raw_value"))


def code_for_docs(nodes: DataFrame, edges: DataFrame, doc_path: str, heading: str | None = None, limit: int = 50) -> DataFrame:
    source = F.col("s_path") == doc_path
    if heading is not None:
        source = source & (F.col("s_type") == "MarkdownSection") & (F.lower("s_name") == heading.lower())
    rows = neighbours(nodes, edges, ("MENTIONS",), source)
    order = [F.desc("e_confidence"), F.col("t_path"), F.col("t_start_line").asc_nulls_first(), F.col("t_name"), F.col("e_id")]
    return rows.orderBy(*order).limit(limit).select(F.col("t_name").alias("target"), F.col("t_type").alias("target_type"), F.col("t_path").alias("target_path"), F.col("e_start_line").alias("line"), F.col("e_confidence").alias("confidence"))


def first_per(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_place = 1").drop("_place")


def explain_file(nodes: DataFrame, edges: DataFrame, path: str, call_limit: int = 15) -> dict[str, DataFrame | list[dict]]:
    """All that is known of one file, by part."""
    counts = nodes.filter(F.col("path") == path).groupBy("type").count().orderBy(F.desc("count"), "type")
    return {
        "symbols": symbol_tree(nodes, edges, path), "imports": imports_of(nodes, edges, path), "imported_by": imported_by(nodes, edges, path),
        "calls": calls_out(nodes, edges, path, limit=call_limit), "called_by": called_by(nodes, edges, path, limit=call_limit),
        "instantiates": calls_out(nodes, edges, path, "INSTANTIATES", call_limit), "instantiated_by": called_by(nodes, edges, path, "INSTANTIATES", call_limit),
        "env_reads": env_reads(nodes, edges, path), "related_tests": related_tests(nodes, edges, path), "mentioned_in": doc_mentions(nodes, edges, path), "node_counts": counts,
    }
