"""The whole engine over one source tree: builds, queries and memory, with JSON-like answers."""

from __future__ import annotations

import hashlib
import json
import time
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .config import Config
from .functions import text
from .ids import edge_id, edge_key, node_id, node_key
from .lineage import stored
from .operators import budget, context, history, ingest, lookup, memory, overview, resolve, traverse
from .operators.parse import parse_files, relations
from .sources import git
from .sources.scan import contents, listing, unchanged
from .sources.snapshot import Snapshots

#: Warnings that come back from a build; all are in the table of runs.
WARNINGS = 1000
MEMORY_PATH = ".stratagraph/agent_memory.md"
# The parts of a session and the nodes they become.
KINDS = {"decisions": "Decision", "assumptions": "Assumption", "open_questions": "OpenQuestion", "next_steps": "Task"}


class StaleError(RuntimeError):
    """Facts are out of date and may not be repaired."""

    def __init__(self, result: dict):
        super().__init__(result.get("reason", "stale"))
        self.result = result


def fingerprint() -> str:
    """Changes with the parsers, so that their facts are made anew."""
    folder = Path(__file__).parent / "operators" / "parse"
    digest = hashlib.sha256()
    for path in sorted(folder.glob("*.py")):
        digest.update(path.name.encode() + b"\0" + path.read_bytes())
    return digest.hexdigest()[:16]


def _rows(frame: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in frame.collect()]


def _most(frame: DataFrame, limit: int) -> tuple[list[dict], int]:
    """The ordered rows that a budget can hold at most, and how many there are beyond."""
    some = _rows(frame.limit(budget.room(limit) + 1))
    if len(some) <= budget.room(limit):
        return some, 0
    return some[:-1], frame.count() - len(some) + 1


class Engine:
    def __init__(self, spark: SparkSession, root: str, store: str | None = None, auto_index: bool = True):
        self.spark, self.root, self.auto_index = spark, str(Path(root).resolve()), auto_index
        self.config = Config.load(self.root)
        self.store = Snapshots(spark, store or f"{self.root}/.stratagraph/store")

    # builds

    def _listing(self) -> DataFrame:
        return listing(self.spark, self.root, self.config.exclude_patterns, self.config.include_patterns, self.config.max_file_size_bytes)

    def _meta(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.store.read("meta").collect()}

    def index(self, incremental: bool = True) -> dict:
        """Scans, diffs, parses what changed, resolves across files and writes the next snapshot."""
        began, meta = time.time(), self._meta()
        if meta.get("root", self.root) != self.root:
            raise ValueError(f"the store belongs to {meta['root']}")
        listed = stored(self._listing())
        files = self.store.read("files")
        incremental = incremental and meta.get("extractor") == fingerprint()
        # files whose size and times are known stay closed
        same = unchanged(listed, files) if incremental else self.spark.createDataFrame([], "path string, status string")
        opened = stored(contents(self.spark, self.root, listed.join(same.select("path"), "path", "left_anti")))
        binaries = opened.filter("binary").drop("content", "binary")
        held = listed.join(same.filter("status = 'active'").select("path"), "path", "left_semi").withColumns({"content": F.lit(None).cast("string"), "hash": F.lit(None).cast("string")})
        found = opened.filter("not binary").drop("binary").unionByName(held)
        diff = ingest.classify(found, files, incremental).cache()
        counts = {r["change_kind"]: r["count"] for r in diff.groupBy("change_kind").count().collect()}
        lost = files.filter("status = 'binary'").join(listed.select("path"), "path", "left_anti")
        if incremental and not (set(counts) - {"unchanged", "unreadable"}) and diff.filter("stat_changed").isEmpty() and binaries.isEmpty() and lost.isEmpty():
            out = self._history_if_moved(meta)
            return {"files_scanned": sum(counts.values()), "files_changed": 0, "files_deleted": 0, "history": out, "warnings": []}
        stale = diff.filter(F.col("change_kind").isin("changed", "deleted"))
        parsed = parse_files(found.join(diff.filter(F.col("change_kind").isin("added", "changed")).select("path"), "path", "left_semi")).cache()
        new, now = relations(parsed), F.current_timestamp()
        stamped = {n: new[n].withColumns({"hash": F.lit(None).cast("string"), "commit_hash": F.lit(None).cast("string"), "created_at": now, "updated_at": now, "last_seen_at": now}) for n in ("nodes", "edges")}
        stamped["edges"] = stamped["edges"].withColumn("inference_reason", F.lit(None).cast("string"))
        names = {n: [x.split(" ")[0] for x in schemas.TABLES[n].split(", ")] for n in ("nodes", "edges")}
        nodes = ingest.upsert(ingest.without_paths(self.store.read("nodes"), stale), stamped["nodes"].select(*names["nodes"]))
        edges = ingest.upsert(ingest.without_paths(self.store.read("edges"), stale), stamped["edges"].select(*names["edges"]))
        redone = diff.filter("change_kind in ('added', 'changed', 'deleted')")
        texts = ingest.without_paths(self.store.read("texts"), redone).unionByName(new["texts"])
        tokens = self._token_tables(new["texts"], redone)
        registry = ingest.registry_after(files, diff, found, now, binaries, listed)
        owned = ("resolver",)
        edges = edges.filter(~F.coalesce(F.col("extractor").isin(*owned), F.lit(False)))
        # stored, so that what follows are short plans over tables of known sizes
        nodes, edges, registry = stored(nodes), stored(edges), stored(registry)
        edges = edges.unionByName(stored(self._resolved(nodes, registry, edges)).select(*names["edges"]))
        nodes = nodes.join(ingest.stale_directories(nodes, registry).select("id"), "id", "left_anti").select(*names["nodes"])
        edges = stored(ingest.connected_edges(edges, nodes))
        nodes = stored(nodes.join(ingest.orphan_env_vars(nodes, edges).select("id"), "id", "left_anti").select(*names["nodes"]))
        warnings = new["warnings"].agg(F.array_sort(F.collect_list("warning")).alias("warnings"))
        run = self.store.read("runs").agg(F.coalesce(F.max("id"), F.lit(0)).alias("i")).first()["i"] + 1
        changed = counts.get("added", 0) + counts.get("changed", 0)
        made_now = [now.select("id").join(self.store.read(n).select("id"), "id", "left_anti").count() for n, now in (("nodes", nodes), ("edges", edges))]
        head = self.spark.createDataFrame([(run, datetime.fromtimestamp(began, UTC), datetime.now(UTC), sum(counts.values()), changed, *made_now)], schemas.RUNS.rpartition(",")[0])
        log = head.crossJoin(F.broadcast(warnings))  # one row each
        meta |= {"root": self.root, "extractor": fingerprint()}
        self.store.write({"nodes": nodes, "edges": edges, "texts": texts, **tokens, "files": registry, "runs": self.store.read("runs").unionByName(log), "meta": self.spark.createDataFrame(sorted(meta.items()), schemas.META)})
        for frame in (diff, parsed):
            frame.unpersist()
        out = self._history_if_moved(self._meta())
        return {"files_scanned": sum(counts.values()), "files_changed": changed, "files_deleted": counts.get("deleted", 0), "warnings": [r["w"] for r in self.table("runs").filter(F.col("id") == run).select(F.explode("warnings").alias("w")).limit(WARNINGS).collect()], "history": out, "seconds": round(time.time() - began, 3)}

    def _token_tables(self, texts: DataFrame, redone: DataFrame | None = None) -> dict[str, DataFrame]:
        """postings and lengths with those of further texts, without those of paths that are done anew."""
        fresh = dict(zip(("postings", "lengths"), text.indexed(texts), strict=True))
        if redone is not None and self.store.current() is not None and not self._indexed():  # a store from before there was an index
            held = ingest.without_paths(self.store.read("texts"), redone)
            old = dict(zip(fresh, text.indexed(held), strict=True))
        else:
            old = {n: self.store.read(n) if redone is None else ingest.without_paths(self.store.read(n), redone) for n in fresh}
        return {n: old[n].unionByName(fresh[n].select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in old[n].schema])) for n in fresh}

    def _indexed(self) -> bool:
        return not self.store.read("lengths").isEmpty() or self.store.read("texts").isEmpty()

    def _resolved(self, nodes: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
        """Edges across files: calls by import and by name, mentions, routes and tables."""
        names = [x.split(" ")[0] for x in schemas.EDGES.split(", ")]
        module = "struct<pending:array<struct<caller_id:string,name:string,line:int,function_id:string,class_id:string>>,imports:map<string,struct<kind:string,module:string,symbol:string,paths:array<string>>>,default_export:string,package:string,package_imports:array<struct<kind:string,spec:string,line:int>>,orm_operations:array<struct<source_id:string,model:string,mode:string,line:int,pattern:string>>>"
        modules = stored(nodes.filter("type = 'Module'").select("path", "id", "name", "language", F.from_json("metadata", module).alias("m")))
        pending = modules.select("path", F.explode("m.pending").alias("p")).select("path", "p.*")
        named = pending.filter("name is not null").select("caller_id", "path", "name", "line")
        packages, bindings = map(stored, self._imported(modules, nodes, files))
        by_binding = resolve.binding_calls(named, bindings, nodes)
        # a name that an import binds is that import's, whether it is known here or not
        bound = modules.filter("language in ('javascript', 'typescript')").select("path", F.explode(F.map_keys("m.imports")).alias("name")).unionByName(bindings.select("path", F.col("local").alias("name")))
        by_name = resolve.name_match_calls(named.join(bound.distinct(), ["path", "name"], "left_anti"), nodes).drop("id")
        by_import = resolve.import_calls(pending.filter("function_id is not null").select("caller_id", "path", "line", "function_id", "class_id"), nodes)
        documents = nodes.filter("type = 'MarkdownDocument'").select(F.col("id").alias("doc_id"), F.col("path").alias("doc_path"), F.from_json("metadata", "struct<references:array<struct<kind:string,value:string,line:int>>>").alias("m"))
        from .functions.paths import joined

        references = documents.select("doc_id", "doc_path", F.explode("m.references").alias("r")).select("doc_id", "doc_path", "r.*")
        relative = references.withColumn("value", F.when(F.col("kind") == "link", joined(F.col("doc_path"), F.regexp_replace("value", "[#?].*$", ""))).otherwise(F.col("value"))).filter("value is not null and value <> ''")
        sections = nodes.filter("type = 'MarkdownSection'").select(F.col("path").alias("doc_path"), F.col("id").alias("section_id"), "start_line", "end_line")
        mentioned = resolve.mentions(relative, files, nodes, sections).join(nodes.select(F.col("id").alias("source_node_id"), "path"), "source_node_id")
        mentioned = mentioned.select("source_node_id", "target_node_id", F.lit("MENTIONS").alias("type"), "path", F.col("line").alias("start_line"), "confidence", "is_inferred", F.to_json(F.struct(F.col("value").alias("raw_value"))).alias("metadata"))
        routes = nodes.filter("type = 'Route'").select(F.col("id").alias("route_id"), "path", F.get_json_object("metadata", "$.handler").alias("handler"), "start_line").filter("handler is not null")
        handled = resolve.route_handlers(routes.drop("start_line"), nodes, bindings).join(routes.select("route_id", "path", "start_line"), "route_id")
        handled = handled.select(F.col("route_id").alias("source_node_id"), "target_node_id", F.lit("HANDLES_ROUTE").alias("type"), "path", "start_line", F.lit(0.9).alias("confidence"), F.lit(False).alias("is_inferred"))
        operations = modules.select("path", F.explode("m.orm_operations").alias("o")).select("path", "o.*")
        tables = self._table_edges(operations, bindings, nodes)
        out = by_name.unionByName(by_import).unionByName(by_binding).unionByName(packages).unionByName(handled).withColumn("metadata", F.lit("{}")).unionByName(mentioned).unionByName(tables)
        out = stored(out)
        out = out.unionByName(self._callback_calls(out.unionByName(edges.select(*out.columns)), nodes))
        out = out.withColumn("id", edge_id(F.col("type"), F.col("source_node_id"), F.col("target_node_id"), F.col("path"), F.col("start_line")))
        now = F.current_timestamp()
        fill = {"end_line": F.lit(None).cast("int"), "extractor": F.lit("resolver"), "commit_hash": F.lit(None).cast("string"), "inference_reason": F.when(F.col("type").isin("READS_TABLE", "WRITES_TABLE"), "sqlalchemy-convention").when(F.col("is_inferred"), "unique name"), "created_at": now, "updated_at": now, "last_seen_at": now}
        return out.withColumns(fill).select(*names).dropDuplicates(["id"])

    def _imported(self, modules: DataFrame, nodes: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """IMPORTS edges of packages, and path, local, target_path, symbol of names that imports bind to files there are."""
        go = nodes.filter("path = 'go.mod' and type = 'ConfigFile'").select(F.get_json_object("metadata", "$.go_module").alias("g")).first()
        asked = modules.select("path", F.explode("m.package_imports").alias("x")).select("path", "x.kind", "x.spec", "x.line")
        found = resolve.package_targets(asked, modules.select("path", "id", "name", "language", "m.package"), go["g"] if go else None)
        edges = found.join(modules.select("path", F.col("id").alias("source_node_id")), "path")
        edges = edges.select("source_node_id", F.col("target_id").alias("target_node_id"), F.lit("IMPORTS").alias("type"), "path", F.col("line").alias("start_line"), F.lit(1.0).alias("confidence"), F.lit(False).alias("is_inferred"))
        dotted = F.replace("b.module", F.lit("."), F.lit("/"))
        own = modules.select("path", F.explode("m.imports").alias("local", "b")).filter("b.kind = 'symbol'")
        own = own.select("path", "local", F.explode(F.coalesce("b.paths", F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py"))))).alias("target_path"), F.col("b.symbol").alias("symbol"))
        exports = modules.select(F.col("path").alias("target_path"), F.col("m.default_export").alias("default_export"))
        own = own.join(files.filter("status = 'active'").select(F.col("path").alias("target_path")), "target_path", "left_semi").join(exports, "target_path", "left")
        own = own.withColumn("symbol", F.when(F.col("symbol") == "default", F.coalesce("default_export", "symbol")).otherwise(F.col("symbol")))
        classes = found.filter("kind = 'class'").join(modules.select(F.col("path").alias("target_path"), F.col("name").alias("symbol")), "target_path")
        return edges.distinct(), own.select("path", "local", "target_path", "symbol").unionByName(classes.select("path", F.col("symbol").alias("local"), "target_path", "symbol")).distinct()

    def _table_edges(self, operations: DataFrame, bindings: DataFrame, nodes: DataFrame) -> DataFrame:
        """READS_TABLE and WRITES_TABLE of operations whose model is one class, of the file or imported, with one table."""
        classes = nodes.filter("type = 'Class'").groupBy("path", "name").agg(F.count("*").alias("n"), F.min("id").alias("class_id")).filter("n = 1").drop("n")
        far = bindings.join(classes.select(F.col("path").alias("target_path"), F.col("name").alias("symbol"), F.col("class_id").alias("far_id")), ["target_path", "symbol"])
        far = far.groupBy("path", F.col("local").alias("model")).agg(F.countDistinct("far_id").alias("n"), F.min("far_id").alias("far_id")).filter("n = 1").drop("n")
        asked = operations.join(classes.withColumnRenamed("name", "model"), ["path", "model"], "left").join(far, ["path", "model"], "left")
        asked = asked.select("source_id", "path", "mode", "line", F.coalesce("class_id", "far_id").alias("model")).filter("model is not null")
        models = nodes.filter("type = 'Table'").select(F.get_json_object("metadata", "$.model_id").alias("name"), F.col("id").alias("table_id")).filter("name is not null")
        made = resolve.table_edges(asked.withColumnRenamed("source_id", "source_node_id"), models)
        return made.select("source_node_id", "target_node_id", "type", "path", "start_line", F.lit(0.85).alias("confidence"), F.lit(True).alias("is_inferred"), F.lit('{"framework":"sqlalchemy"}').alias("metadata"))

    def _callback_calls(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        """The module's calls within an inline route callback as calls of the callback."""
        calls = edges.filter("type = 'CALLS'").join(nodes.filter("type = 'Module'").select(F.col("id").alias("source_node_id")), "source_node_id", "left_semi")
        calls = calls.withColumn("id", edge_id(F.col("type"), F.col("source_node_id"), F.col("target_node_id"), F.col("path"), F.col("start_line")))
        spans = nodes.filter(F.get_json_object("metadata", "$.synthetic_identity").isNotNull()).select(F.col("id").alias("route_id"), "path", "start_line", "end_line")
        taken = resolve.inline_handlers(spans, calls.select("id", "path", "start_line").distinct())
        return calls.join(taken, "id").withColumn("source_node_id", F.col("route_id")).select(*edges.columns)

    def refresh_history(self) -> dict:
        """current, extracted, stale (may not be repaired), unavailable (no history) or error."""
        try:
            return self._history_if_moved(self._meta(), self.auto_index)
        except Exception as error:  # an answer degrades, it doesn't crash
            return {"status": "error", "error": f"{type(error).__name__}: {error}"}

    def history_provenance(self) -> dict:
        meta = self._meta()
        return {"extracted_head": meta.get("history_head"), "window": self.config.history_window, "max_files": self.config.history_max_files, "commit_count": self.table("commits").count()}

    def _gated(self, kind: str, build) -> dict:
        """A report with the state of facts and history; without rows where either may not be served."""
        try:
            fresh = self.require_fresh()
        except StaleError as error:
            return {"kind": kind, "status": error.result.get("status", "blocked"), "freshness": error.result, "message": f"Facts are out of date: {error}."}
        state = self.refresh_history()
        if state["status"] not in ("current", "extracted"):
            return {"kind": kind, "status": f"history_{state['status']}", "freshness": fresh, "history": state, "message": state.get("message") or state.get("reason") or state.get("error")}
        items = build()
        text = "\n".join([f"{kind} ({len(items)})", *("- " + ", ".join(f"{k} {v}" for k, v in x.items()) for x in items)])
        return {"kind": kind, "status": "ok", "freshness": fresh, "history": state | self.history_provenance(), "items": items, "text": text}

    def co_change_report(self, path: str, limit: int = 20) -> dict:
        wanted = self.spark.createDataFrame([(path,)], "value string")

        def build() -> list[dict]:
            found = lookup.resolve_paths(wanted, self.table("files"), self.root).first()
            return self.co_change(found["path"], limit) if found["path"] else []

        return self._gated("co_change", build) | {"target": path}

    def churn_report(self, limit: int = 20) -> dict:
        return self._gated("churn", lambda: self.churn(limit))

    def ownership_report(self, path: str | None = None, limit: int = 10) -> dict:
        return self._gated("ownership", lambda: self.ownership(path, limit)) | {"target": path}

    def _history_if_moved(self, meta: dict, mend: bool = True) -> dict:
        """Mines the history anew where head or settings differ, if it may; says in what state it is."""
        why = git.status(self.root)
        if why != "ok":
            return {"status": "unavailable", "reason": why}
        head = git._git(self.root, "rev-parse", "HEAD").decode().strip()
        params = json.dumps([self.config.history_window, self.config.history_max_files, history.SHAS_KEPT])
        if (meta.get("history_head"), meta.get("history_params")) == (head, params):
            return {"status": "current", "head": head}
        if not mend:
            return {"status": "stale", "head": head, "extracted_head": meta.get("history_head"), "message": "The history is out of date and may not be repaired; build the index."}
        commits, files, head = git.history(self.spark, self.root, self.config.history_window)
        excluded = history.commit_sizes(files, self.config.history_max_files).select("sha", F.col("co_change_excluded").alias("x"))
        commits = commits.join(excluded, "sha", "left").withColumn("co_change_excluded", F.col("x")).drop("x")
        pairs = history.co_change_pairs(files, self.store.read("files"), self.config.history_max_files)
        own = self.store.read("nodes").filter("type = 'File'").select("path", "id")
        made = pairs.join(own.select(F.col("path").alias("p1"), F.col("id").alias("source_node_id")), "p1").join(own.select(F.col("path").alias("p2"), F.col("id").alias("target_node_id")), "p2")
        # the log counts from the newest commit
        newest = commits.withColumn("seq", -F.col("seq"))
        shas = history.supporting_commits(files, newest, pairs, max_files=self.config.history_max_files)
        shas = shas.groupBy("p1", "p2").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "sha"))), lambda x: x["sha"]).alias("supporting_commits"))
        made = made.join(shas, ["p1", "p2"], "left").withColumn("supporting_commits_truncated", F.col("support") > history.SHAS_KEPT)
        names, now = [x.split(" ")[0] for x in schemas.EDGES.split(", ")], F.current_timestamp()
        null = F.lit(None).cast("string")
        made = made.select("source_node_id", "target_node_id", F.lit("CO_CHANGED_WITH").alias("type"), F.lit("").alias("path"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.to_json(F.struct("support", F.col("weighted").alias("weighted_support"), "score", F.array("p1", "p2").alias("paths"), "supporting_commits", "supporting_commits_truncated")).alias("metadata"), "confidence", F.lit("git_history").alias("extractor"), null.alias("commit_hash"), F.lit(True).alias("is_inferred"), F.lit("git history").alias("inference_reason"), now.alias("created_at"), now.alias("updated_at"), now.alias("last_seen_at"))
        made = made.withColumn("id", edge_id(F.col("type"), F.col("source_node_id"), F.col("target_node_id"), F.col("path"), F.col("start_line")))
        edges = self.store.read("edges").filter("type <> 'CO_CHANGED_WITH'").unionByName(made.select(*names))
        meta = meta | {"history_head": head, "history_params": params}
        self.store.write({"commits": commits.select(*[x.split(" ")[0] for x in schemas.COMMITS.split(", ")]), "commit_files": files, "edges": edges, "meta": self.spark.createDataFrame(sorted(meta.items()), schemas.META)})
        return {"status": "extracted", "head": head}

    def freshness(self) -> dict:
        changed = self._meta().get("extractor") != fingerprint()
        return ingest.freshness(self._listing().select("path", "size", "mtime"), self.store.read("files"), changed).first().asDict()

    def require_fresh(self) -> dict:
        """Builds if little changed; raises StaleError where facts must not be served."""
        before = self.freshness()
        said = ingest.gate(before, self.auto_index) | {"before": before}
        if said["status"] == "blocked":
            raise StaleError(said)
        if said["status"] == "repair":
            said |= {"build": self.index(), "after": self.freshness()}
            if said["after"]["is_stale"]:
                raise StaleError(said | {"reason": "still_stale"})
            said |= {"status": "reindexed", "can_query": True}
        return said

    # queries

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def _graph(self) -> tuple[DataFrame, DataFrame]:
        return self.table("nodes"), self.table("edges")

    def status(self) -> dict:
        n, e = self._graph()
        last = self.table("runs").orderBy(F.desc("id")).limit(1).collect()
        return {"files": self.table("files").filter("status = 'active'").count(), "nodes": {r["type"]: r["count"] for r in overview.counts_by_type(n).collect()}, "edges": {r["type"]: r["count"] for r in overview.counts_by_type(e).collect()}, "last_run": last[0].asDict() if last else None}

    def search(self, query: str, limit: int = 10, types: list[str] | None = None) -> list[dict]:
        texts, nodes = self.table("texts"), self.table("nodes")
        index = (self.table("postings"), self.table("lengths")) if self._indexed() else None
        found = _rows(text.search_types(texts, nodes, query, types, limit, index) if types else text.search(texts, nodes, query, limit, index=index))
        if not found:
            return found
        wanted = self.spark.createDataFrame([(x["path"], x["name"]) for x in found], "path string, name string").distinct()
        bodies = {(r["path"], r["name"]): r["content"] for r in texts.join(F.broadcast(wanted), ["path", "name"]).groupBy("path", "name").agg(F.min("content").alias("content")).collect()}  # of the answer's rows alone
        terms = [t for phrase in text.phrases(query) for t in phrase]
        return [x | {"snippet": text.snippet(bodies.get((x["path"], x["name"])) or "", terms)} for x in found]

    def find_symbol(self, name: str, exact: bool = False, limit: int = 20) -> list[dict]:
        return _rows(lookup.find_symbol(self.table("nodes"), name, exact, limit))

    def overview(self) -> dict:
        n, e = self._graph()
        return {k: _rows(v) for k, v in overview.overview(n, e, self.table("files")).items()}

    def report(self) -> str:
        n, e = self._graph()
        return overview.report(self.root, overview.overview(n, e, self.table("files")))

    def explain_file(self, path: str) -> dict:
        n, e = self._graph()
        return {k: v if isinstance(v, list) else _rows(v) for k, v in lookup.explain_file(n, e, path).items()}

    def trace_config(self, name: str) -> list[dict]:
        return _rows(lookup.trace_config(*self._graph(), name))

    def trace_symbol(self, symbol: str, depth: int = 1, direction: str = "both", limit: int = 10_000) -> dict:
        nodes, edges = traverse.trace_symbol(*self._graph(), symbol, depth, direction)
        order = ("path", "start_line", "id")
        nodes, more_nodes = _most(nodes.orderBy(*order), limit)
        edges, more_edges = _most(edges.select("id", "type", "source_node_id", "target_node_id", "path", "start_line", "confidence").orderBy(*order), limit)
        return budget.fit({"start": symbol, "nodes": nodes, "edges": edges}, limit, left={"nodes": more_nodes, "edges": more_edges})

    def _targets(self, target: str) -> DataFrame | None:
        """Start nodes of a path, or of exactly one symbol."""
        nodes = self.table("nodes")
        wanted = self.spark.createDataFrame([(target,)], "value string")
        path = lookup.resolve_paths(wanted, self.table("files"), self.root).first()
        if path["path"]:
            return nodes.filter(F.col("path") == path["path"])
        one = lookup.resolve_references(wanted, nodes, self.table("files")).first()
        return nodes.filter(F.col("id") == one["node_id"]) if one["status"] == "resolved" else None

    def trace_data_flow(self, start: str, depth: int = 2, direction: str = "both", limit: int = 10_000) -> dict | None:
        nodes, edges = self._graph()
        starts = nodes.filter(F.col("type").isin("Route", "Endpoint", "Event", "Queue") & (F.lower("name") == start.strip().lower())).orderBy("type", "id").limit(1)
        if starts.isEmpty():
            starts = self._targets(start)
            if starts is None:
                return None
        reached = traverse.data_flow(starts.select("id"), edges, depth, direction)
        found, more = _most(nodes.join(reached, "id").select("id", "type", "name", "path", "start_line", "cost").orderBy("cost", "path", "start_line", "id"), limit)
        # edges of runtime types and structure between reached nodes, with the cost of the end they start from
        ends = stored(reached)
        inner = edges.filter(F.col("type").isin(*schemas.FLOW_EDGES)).join(ends.select(F.col("id").alias("source_node_id"), "cost"), "source_node_id").join(ends.select(F.col("id").alias("target_node_id")), "target_node_id", "left_semi")
        links, more_links = _most(inner.select("id", "type", "source_node_id", "target_node_id", "path", "start_line", "confidence", "cost").orderBy("cost", "path", "start_line", "id"), limit)
        return budget.fit({"start": start, "nodes": found, "edges": links}, limit, left={"nodes": more, "edges": more_links})

    def impact(self, target: str, depth: int = 3, limit: int = 10_000, change_type: str = "modify") -> dict | None:
        """What depends on a target. change_type: modify, rename or delete, of which the latter two concern documents that name it too."""
        if change_type not in ("modify", "rename", "delete"):
            raise ValueError("change_type must be 'modify', 'rename' or 'delete'")
        starts = self._targets(target)
        if starts is None:
            return None
        nodes, edges = self._graph()
        found = traverse.impact(starts.select(F.lit(target).alias("root"), "id"), edges, depth).join(nodes.select("id", "type", "name", "path", "start_line"), "id")
        items, more = _most(found.drop("root").orderBy(F.desc("confidence"), "path", "start_line", "id"), limit)
        paths = starts.filter("path <> ''").select("path").distinct()
        out = {f"{b}_confidence": [x for x in items if x["bucket"] == b] for b in ("high", "medium", "low")}
        out["recommended_tests"] = [x for x in items if x["type"] in ("TestFile", "TestCase") or "/test" in x["path"]]
        out["docs_likely_needing_updates"] = [x for x in items if x["type"] in ("MarkdownDocument", "MarkdownSection", "ADR")]
        out["historical_evidence"] = _rows(history.historical_co_change(self._pairs(), paths))
        out["unknowns"] = ["Documents that name the target in words alone aren't linked and need a search."] if change_type != "modify" else []
        return budget.fit({"target": target, "change_type": change_type} | out, limit, left={"low_confidence": more})

    def _pairs(self) -> DataFrame:
        return history.co_change_pairs(self.table("commit_files"), self.table("files"), self.config.history_max_files)

    def co_change(self, path: str, limit: int = 20) -> list[dict]:
        return _rows(history.partners(self._pairs(), path, limit))

    def churn(self, limit: int = 20) -> list[dict]:
        return _rows(history.churn_hotspots(self.table("commits"), self.table("commit_files"), self.table("files"), limit))

    def ownership(self, path: str | None = None, limit: int = 10) -> list[dict]:
        return _rows(history.ownership(self.table("commits"), self.table("commit_files"), path, limit))

    def docs_for_code(self, target: str, limit: int = 50) -> list[dict]:
        starts = self._targets(target)
        if starts is None:
            return []
        nodes, edges = self._graph()
        ids = [r["id"] for r in starts.select("id").collect()]
        return _rows(lookup.docs_for_code(nodes, edges, F.col("t_id").isin(*ids), limit))

    def code_for_docs(self, path: str, heading: str | None = None, limit: int = 50) -> list[dict]:
        return _rows(lookup.code_for_docs(*self._graph(), path, heading, limit))

    def change_context(self, base: str | None = None, limit: int = 15_000) -> dict:
        """What a change touches: its nodes, what depends on them, documents that may be out of date, and history."""
        nodes, edges = self._graph()
        changed, ranges = git.changes(self.spark, self.root, base)
        from .operators.intervals import changed_symbols

        symbols = nodes.filter(F.col("type").isin(*schemas.SYMBOL_TYPES))
        touched = changed_symbols(ranges.filter("side = 'new'"), changed, symbols)
        # what deleted files had, as the snapshot may no longer hold it; edges onto it may still stand
        deleted = [r["path"] for r in changed.filter("status = 'D'").collect()]
        lost = context.deleted_nodes(git.old_files(self.spark, self.root, base, deleted)).join(self.spark.createDataFrame([(p,) for p in deleted], "path string"), "path", "left_semi")
        kept = lost.filter(F.col("type").isin(*schemas.SYMBOL_TYPES)).select(*touched.columns).join(touched.select("id"), "id", "left_anti")
        touched = touched.unionByName(kept.select(*touched.columns))
        starts = touched.select(F.col("id").alias("root"), "id").unionByName(nodes.unionByName(lost, allowMissingColumns=True).filter("type in ('File', 'Module')").join(changed, "path", "left_semi").select(F.col("id").alias("root"), "id")).distinct()
        impacts = context.aggregate_impacts(starts, edges).join(nodes.select("id", "type", "name", "path"), "id")
        paths = changed.select(F.explode(F.array_compact(F.array("path", "old_path"))).alias("path")).distinct()
        docs = context.stale_docs(nodes, edges, starts.select("id"), paths)
        old_paths = changed.filter("status in ('D', 'R')").select(F.coalesce("old_path", "path").alias("path"))
        documents = nodes.filter("type = 'MarkdownDocument'").join(paths, "path", "left_anti").select(F.col("id").alias("doc_id"), F.col("path").alias("doc_path"), F.explode(F.from_json("metadata", "struct<references:array<struct<kind:string,value:string,line:int>>>")["references"]).alias("r"))
        references = documents.select("doc_id", "doc_path", F.regexp_replace("r.value", "[#?].*$", "").alias("value"), "r.line").filter("value <> ''").distinct()
        sections = nodes.filter("type = 'MarkdownSection'").select(F.col("path").alias("doc_path"), F.col("id").alias("section_id"), "start_line", "end_line")
        historical = context.historical_path_docs(references, old_paths, sections).select("doc_path", "line", node_id(F.lit("File"), F.col("path"), F.col("path"), F.col("path")).alias("target"), F.col("path").alias("old_path"))
        docs = docs.join(historical, ["doc_path", "line", "target"], "left_anti").withColumn("old_path", F.lit(None).cast("string")).unionByName(historical)
        external = history.historical_co_change(self._pairs(), changed.select("path"), only_external=True)
        spans = ranges.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("side", "start", "end"))).alias("line_ranges"))
        shown = changed.join(spans, "path", "left").join(nodes.unionByName(lost, allowMissingColumns=True).filter("type = 'File'").groupBy("path").agg(F.min("id").alias("file_node")), "path", "left")
        records = _rows(shown.orderBy("path"))
        own: dict[str, list[dict]] = {}
        for x in _rows(touched.orderBy("path", "start_line", "id")):
            own.setdefault(x["path"], []).append(x)
        for x in records:
            x |= {"line_ranges": x["line_ranges"] or [], "symbols": own.get(x["path"], [])}
            x["mapping_status"] = "mapped" if x["file_node"] or x["symbols"] else "unmapped"
        out = {"changes": records, "docs_likely_needing_updates": _rows(docs.orderBy("doc_path", "line", "target")), "historical_evidence": _rows(external)}
        items, more = _most(impacts.orderBy(F.desc("confidence"), "path", "id"), limit)
        out["recommended_tests"] = [x for x in items if x["type"] in ("TestFile", "TestCase") or "/test" in x["path"] or x["path"].startswith("test")]
        # once the snapshot has let a deleted file go, it has no edges onto it
        out["unknowns"] = [f"Impacts of the deleted {p} are known only as far as the snapshot still holds edges onto it." for p in sorted(deleted)]
        out |= {f"{b}_confidence": [x for x in items if x["bucket"] == b] for b in ("high", "medium", "low")} | {"impacts_not_shown": more}
        return budget.ladder(out, limit)

    # memory

    def write_memory(self, summary: str, **lists: list[str]) -> dict:
        """Adds a session: a note with its decisions, assumptions, questions and tasks, anchored on what it refers to."""
        if unknown := set(lists) - {*KINDS, "changed_files"}:
            raise ValueError(f"unknown lists: {', '.join(sorted(unknown))}")
        entry = {"created_at": datetime.now(UTC).isoformat(timespec="microseconds"), "summary": summary.strip()}
        entry |= {k: [str(x).strip() for x in lists.get(k, []) if str(x).strip()] for k in (*KINDS, "changed_files")}
        parts = [("summary", 0, entry["summary"])] + [(k, i, x) for k in (*KINDS, "changed_files") for i, x in enumerate(entry[k])]
        frame = self.spark.createDataFrame(parts, "field string, position int, content string")
        refs = frame.select("field", "position", F.explode(F.array_union(memory.references(F.col("content")), memory.code_tokens(F.col("content")))).alias("value"))
        nodes = self.table("nodes")
        found = lookup.resolve_references(refs.select("value"), nodes, self.table("files")).filter("status = 'resolved'").select("value", "provenance", "node_id")
        expected = F.struct("id", "type", "name", "qualified_name", "path", "start_line", "end_line")
        anchors = refs.join(found, "value").join(nodes, F.col("node_id") == F.col("id")).select(F.struct("field", "position", F.col("value").alias("reference"), F.col("provenance").alias("resolution_provenance"), expected.alias("expected")).alias("a")).distinct()
        row = [(None, entry["summary"], *(entry[k] for k in ("decisions", "assumptions", "open_questions", "changed_files", "next_steps")), [r["a"] for r in anchors.collect()])]
        fresh = self.spark.createDataFrame(row, schemas.MEMORY).withColumn("created_at", F.to_timestamp(F.lit(entry["created_at"])))
        held = [a.asDict(recursive=True) for a in row[0][-1]]
        self.store.write({"memory": self.table("memory").unionByName(fresh), **self._session(entry, held, nodes)})
        log = Path(self.root) / MEMORY_PATH
        log.parent.mkdir(parents=True, exist_ok=True)
        with log.open("a", encoding="utf-8") as out:
            out.write(("\n" if log.exists() and log.stat().st_size else "# Agent memory\n\n") + memory.session_markdown(entry))
        return entry | {"anchors": held, "note": node_key("AgentNote", summary, f"session:{entry['created_at']}", MEMORY_PATH)}

    def _session(self, entry: dict, anchors: list[dict], nodes: DataFrame) -> dict[str, DataFrame]:
        """nodes, edges and texts with a session's note, its parts and what it may have an impact on, where that exists."""
        when, title = entry["created_at"], f"Agent session {entry['created_at']}"
        note = node_key("AgentNote", title, f"session:{when}", MEMORY_PATH)
        made = [(note, "AgentNote", title, f"session:{when}", json.dumps(entry | {"anchors": anchors}, sort_keys=True))]
        links, texts = [], [(MEMORY_PATH, title, entry["summary"], note)]
        for field, kind in KINDS.items():
            for i, said in enumerate(entry[field]):
                own = node_key(kind, said, f"{when}:{field}:{i + 1}", MEMORY_PATH)
                about = {"created_at": when, "memory_kind": field, "anchors": [a for a in anchors if (a["field"], a["position"]) == (field, i)]}
                made.append((own, kind, said, f"{when}:{field}:{i + 1}", json.dumps(about, sort_keys=True)))
                links.append((edge_key("CONTAINS", note, own, MEMORY_PATH), note, own, "CONTAINS", json.dumps({"memory_kind": field})))
                texts.append((MEMORY_PATH, said, said, own))
        for path in dict.fromkeys(entry["changed_files"]):
            target = node_key("File", path, path, path)
            links.append((edge_key("MAY_IMPACT", note, target, MEMORY_PATH), note, target, "MAY_IMPACT", json.dumps({"changed_file": path})))
        now = F.current_timestamp()
        fill = {"path": F.lit(MEMORY_PATH), "confidence": F.lit(1.0), "extractor": F.lit("agent_memory"), "created_at": now, "updated_at": now, "last_seen_at": now}
        fresh_nodes = self.spark.createDataFrame(made, "id string, type string, name string, qualified_name string, metadata string").withColumns(fill)
        fresh_edges = self.spark.createDataFrame(links, "id string, source_node_id string, target_node_id string, type string, metadata string").withColumns(fill | {"is_inferred": F.lit(False)})
        said = self.spark.createDataFrame(texts, schemas.TEXTS)
        all_nodes = nodes.unionByName(fresh_nodes, allowMissingColumns=True)
        fresh_edges = fresh_edges.join(all_nodes.select(F.col("id").alias("target_node_id")), "target_node_id", "left_semi")
        return {"nodes": all_nodes, "edges": self.table("edges").unionByName(fresh_edges, allowMissingColumns=True), "texts": self.table("texts").unionByName(said), **(self._token_tables(said) if self._indexed() else {})}

    def _verified(self, entries: DataFrame) -> DataFrame:
        anchors = entries.select("entry_id", F.explode("anchors").alias("a")).select("entry_id", "a.expected.*")
        return memory.verify_anchors(anchors, self.table("nodes"), self.table("commit_files"))

    def _entries(self) -> DataFrame:
        return self.table("memory").withColumn("entry_id", F.sha1(F.concat_ws("\0", F.col("created_at").cast("string"), "summary").cast("binary")))

    def read_memory(self, topic: str | None = None, limit: int = 10) -> list[dict]:
        entries = memory.read(self._entries(), topic, limit, ("summary", "decisions", "assumptions", "open_questions", "next_steps"))
        verdicts = memory.entry_verdicts(entries, self._verified(entries))
        return _rows(entries.join(verdicts, "entry_id").orderBy(F.desc("created_at"), "summary"))

    def verify_memory(self, limit: int = 1000) -> dict[str, int]:
        entries = memory.read(self._entries(), None, limit)
        found = memory.verdict_histogram(memory.entry_verdicts(entries, self._verified(entries)))
        return {r["verdict"]: r["entries"] for r in found.collect()}

    def brief(self, limit: int = 2000) -> dict:
        """A short orientation: memory that needs attention, purpose, subsystems, entry points, configuration, memory."""
        nodes, edges = self._graph()

        def facts(frame: DataFrame) -> list[str]:
            return [f"{r['type']}: {r['text']} ({r['location']}{':' + str(r['line']) if r['line'] else ''})" for r in frame.collect()]

        apart = overview.UNREPRESENTATIVE + overview.DOCUMENTATION
        remembered = self.read_memory(limit=5)
        bad = [f"{e['verdict']}: {e['summary']}" for e in remembered if e["verdict"] in ("invalidated", "drifted")]
        good = [e for e in remembered if e["verdict"] not in ("invalidated", "drifted")]
        readme = self.table("texts").filter(F.lower("path").rlike(r"(^|/)readme(\.[a-z]+)?$"))
        sections = [
            ("Memory requiring attention", bad),
            ("Purpose", [f"{r['paragraph']} ({r['path']})" for r in overview.purpose(readme).collect()]),
            ("Subsystems", facts(overview.promoted(nodes, edges, ("Directory", "Module"), 12, by_degree=True, withhold=apart))),
            ("Entrypoints", facts(overview.promoted(nodes, edges, ("Route", "CLICommand"), 12, by_type=True))),
            ("Configuration", facts(overview.promoted(nodes, edges, ("EnvVar", "ConfigFile", "ConfigKey"), 12, by_type=True, withhold=apart))),
            ("Active assumptions", [x for e in good for x in e["assumptions"] or []]),
            ("Open questions", [x for e in good for x in e["open_questions"] or []]),
            ("Recent memory", [e["summary"] for e in good if e["summary"]]),
        ]
        return budget.select_facts(sections, limit)
