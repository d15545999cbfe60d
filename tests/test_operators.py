"""Operators on hand-made relations with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from stratagraph import ids
from stratagraph.config import Config
from stratagraph.functions import paths, text
from stratagraph.operators import budget, history, ingest, intervals, lookup, memory, overview, resolve, traverse
from stratagraph.operators.parse.registry import parse_one
from stratagraph.sources import git

EDGE = "id string, source_node_id string, target_node_id string, type string, path string, start_line int, confidence double, metadata string"


def edges(spark, *rows):
    return spark.createDataFrame([(f"e{i}", s, t, kind, "p", i, c, "{}") for i, (s, kind, t, c) in enumerate(rows)], EDGE)


def node(i, kind="Function", path="p", name=None, start=1, end=9):
    return (i, kind, name or i, f"q.{name or i}", path, start, end, "py", "{}")


NODE = "id string, type string, name string, qualified_name string, path string, start_line int, end_line int, language string, metadata string"


def test_identities(spark):
    row = spark.range(1).select(ids.node_id(F.lit("File"), F.lit("n"), F.lit(""), F.lit("p")).alias("n"), ids.edge_id(F.lit("CALLS"), F.lit("a"), F.lit("b"), F.lit(None).cast("string"), F.lit(None).cast("int")).alias("e")).first()
    assert row["n"] == ids.node_key("File", "n", "", "p") and row["e"] == ids.edge_key("CALLS", "a", "b")


def test_co_change_known_answer(spark):
    files = [(c, p) for c, ps in (("c1", "abcd"), ("c2", "ab"), ("c3", "ab"), ("c4", "cd")) for p in ps]
    frame = spark.createDataFrame(files, "sha string, path string")
    active = spark.createDataFrame([(p, "active") for p in "abcd"], "path string, status string")
    got = {(r.p1, r.p2): r for r in history.co_change_pairs(frame, active).collect()}
    assert set(got) == {("a", "b"), ("c", "d")}
    assert (got["a", "b"].support, got["a", "b"].weighted, got["a", "b"].score) == (3, 2.3333, 0.7778)
    assert (got["c", "d"].support, got["c", "d"].score) == (2, 0.6667)
    assert got["a", "b"].confidence <= 0.55 * 7 / 9 + 1e-3
    small = {(r.p1, r.p2): r for r in history.co_change_pairs(frame, active, max_files=3).collect()}
    assert set(small) == {("a", "b")} and (small["a", "b"].support, small["a", "b"].score) == (2, 1.0)
    sizes = {r.sha: r.co_change_excluded for r in history.commit_sizes(frame, 3).collect()}
    assert sizes == {"c1": "oversized", "c2": None, "c3": None, "c4": None}
    gone = active.withColumn("status", F.when(F.col("path") == "a", "deleted").otherwise("active"))
    assert history.co_change_pairs(frame, gone).count() == 1


def test_renames_follow_chains_and_end_in_cycles(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "old string, new string")
    got = {r.old: r.current for r in history.rename_targets(rows).collect()}
    assert {k: got[k] for k in "abc"} == {"a": "d", "b": "d", "c": "d"} and set(got) == {"a", "b", "c", "x", "y"}


def test_numstat_renames_and_binaries():
    data = b"\x01s2\x1f200\x1fAnn\x1fa@x\x1f\0\n3\t1\t\0old.py\0new.py\0-\t-\tpic.png\0\x01s1\x1f100\x1fBob\x1fb@x\x1f\0\n5\t0\told.py\0"
    commits, files = git.parse_numstat(data)
    assert [(c[0], c[1], c[5], c[6], c[7]) for c in commits] == [("s2", 0, 2, 3, 1), ("s1", 1, 1, 5, 0)]
    assert files == [("s2", "new.py", "old.py", 3, 1), ("s2", "pic.png", None, None, None), ("s1", "old.py", None, 5, 0)]
    assert git.continued(files)[2] == ("s1", "new.py", "old.py", 5, 0)
    assert git.parse_name_status(b"M\0a\0R090\0b\0c\0D\0d\0") == [("M", "a", None), ("R", "c", "b"), ("D", "d", None)]
    assert git.hunks("@@ -1,0 +2,3 @@\n@@ -9 +12 @@") == [("new", 2, 4), ("old", 9, 9), ("new", 12, 12)]


def test_impact_decay_evidence_and_no_self(spark):
    graph = edges(spark, ("b", "CALLS", "a", 0.9), ("b", "IMPORTS", "a", 0.95), ("c", "CALLS", "b", 1.0), ("a", "CALLS", "c", 1.0), ("d", "CONTAINS", "a", 1.0), ("e", "CALLS", "c", 0.5))
    starts = spark.createDataFrame([("r", "a")], "root string, id string")
    got = {r.id: r for r in traverse.impact(starts, graph, 3).collect()}
    assert set(got) == {"b", "c", "e"}
    assert (got["b"].via, got["b"].confidence, got["b"].bucket) == ("IMPORTS", 0.95, "high")
    assert (got["c"].level, got["c"].confidence) == (1, 0.85) and got["e"].bucket == "low"
    assert {r.id for r in traverse.impact(starts, graph, 1).collect()} == {"b"}


def test_trace_depths_and_directions(spark):
    graph = edges(spark, ("a", "CALLS", "b", 1.0), ("b", "CALLS", "c", 1.0), ("c", "CO_CHANGED_WITH", "z", 1.0))
    nodes = spark.createDataFrame([node(x) for x in "abcz"], NODE)
    names = lambda *a: {r.name for r in traverse.trace_symbol(nodes, graph, *a)[0].collect()}
    assert names("b", 0, "both") == {"b"} and names("B", 1, "out") == {"b", "c"} and names("b", 1, "in") == {"a", "b"} and names("a", 99, "both") == {"a", "b", "c"}
    assert traverse.trace_symbol(nodes, graph, "b", 0)[1].count() == 0
    with pytest.raises(ValueError):
        traverse.trace_symbol(nodes, graph, "b", 1, "up")


def test_data_flow_costs_nothing_on_structure(spark):
    graph = edges(spark, ("m", "DEFINES", "f", 1.0), ("m", "IMPORTS", "n", 1.0), ("n", "DEFINES", "g", 1.0), ("g", "CALLS", "h", 1.0))
    starts = spark.createDataFrame([("f",)], "id string")
    got = {r.id: r.cost for r in traverse.data_flow(starts, graph, 1, "out").collect()}
    assert got == {"f": 0, "m": 0, "n": 1, "g": 1}


def test_degree_counts_self_loops_once(spark):
    graph = edges(spark, ("a", "CALLS", "a", 1.0), ("a", "CALLS", "b", 1.0), ("a", "DEFINES", "b", 1.0))
    assert {r.id: r.degree for r in traverse.degrees(graph).collect()} == {"a": 2, "b": 1}


def test_search_type_filter_boosts_and_wildcards(spark):
    nodes = spark.createDataFrame([node(f"f{i}", name=f"decoy{i}") for i in range(60)] + [node("file", "File", "needle.txt", "needle.txt")], NODE)
    texts = spark.createDataFrame([("p", f"decoy{i}", "needle needle needle", f"f{i}") for i in range(60)] + [("needle.txt", "needle.txt", "needle", "file")], "path string, name string, content string, node_id string")
    got = text.search(texts, nodes, "needle", 10, "File").collect()
    assert [r.name for r in got] == ["needle.txt"] and got[0].reasons == "full-text match, name contains query, path match"
    assert text.search(texts, nodes, "%").count() == 0 and text.search(texts, nodes, "d_coy").count() == 0 and text.search(texts, nodes, " ").count() == 0
    assert text.search(texts, nodes, "decoy1", 3).first().score > 100


def test_bm25_folds_accents_and_phrases_stay_in_columns(spark):
    texts = spark.createDataFrame([("a", "n", "Café user_service here"), ("b", "user", "service only"), ("c", "n", "none")], "path string, name string, content string").withColumn("doc_key", F.col("path"))
    keys = lambda q: {r.doc_key for r in text.bm25(texts, q).collect()}
    assert keys("cafe") == {"a"} and keys("user_service") == {"a"} and keys("user service") == {"a", "b"} and keys("...") == set()
    assert text.snippet("one two three four five", ["three"], 3) == "one two [three]…"


def test_lookup_escapes_and_uniqueness(spark):
    nodes = spark.createDataFrame([node("1", name="user_service"), node("2", name="userXservice"), node("3", path="q", name="twice"), node("4", path="r", name="twice")], NODE)
    assert [r.name for r in lookup.find_symbol(nodes, "user_service").collect()] == ["user_service"]
    assert lookup.find_symbol(nodes, "%").count() == 0 and lookup.find_symbol(nodes, " ").count() == 0
    files = spark.createDataFrame([("src/a.py", "active"), ("lib/a.py", "active"), ("src/b.py", "active"), ("src/c.py", "deleted")], "path string, status string")
    wanted = spark.createDataFrame([("a.py",), ("./src/a.py",), ("B.PY",), ("c.py",), ("src\\b.py/",)], "value string")
    assert {r.value: r.how for r in lookup.resolve_paths(wanted, files).collect()} == {"a.py": "ambiguous", "./src/a.py": "exact", "B.PY": "suffix", "c.py": "unresolved", "src\\b.py/": "exact"}
    refs = spark.createDataFrame([("twice",), ("user_service",), ("nope",)], "value string")
    assert {r.value: r.status for r in lookup.resolve_references(refs, nodes, files).collect()} == {"twice": "ambiguous", "user_service": "resolved", "nope": "unresolved"}


def test_names_resolve_only_outside_their_file(spark):
    nodes = spark.createDataFrame([node("h", path="a.py", name="helper"), node("g", path="b.py", name="helper"), node("k", "Class", "c.py", "K"), node("d1", path="a.py", name="dup"), node("d2", path="b.py", name="dup")], NODE)
    pending = spark.createDataFrame([("x", "a.py", "helper", 1), ("y", "z.py", "helper", 1), ("x", "a.py", "K", 2), ("x", "a.py", "none", 3)], "caller_id string, path string, name string, line int")
    got = {(r.source_node_id, r.type, r.target_node_id) for r in resolve.name_match_calls(pending, nodes).collect()}
    assert got == {("x", "CALLS", "g"), ("x", "INSTANTIATES", "k")}


def test_intervals(spark):
    rows = spark.createDataFrame([("f", 1, 3), ("f", 4, 5), ("f", 7, 9), ("f", 2, 2), ("g", 1, 1)], "path string, start int, end int")
    assert sorted(map(tuple, intervals.merge_ranges(rows, ["path"]).collect())) == [("f", 1, 5), ("f", 7, 9), ("g", 1, 1)]
    symbols = spark.createDataFrame([("s1", "f", "a", "Function", 1, 300), ("s2", "f", "b", "Function", 6, 6), ("s3", "g", "c", "Function", 5, None), ("s4", "h", "d", "Function", 1, 2)], "id string, path string, name string, type string, start_line int, end_line int")
    changed = spark.createDataFrame([("f",), ("g",), ("h",)], "path string")
    assert {r.id for r in intervals.changed_symbols(rows, changed, symbols).collect()} == {"s1", "s4"}
    left = spark.createDataFrame([("k", 5), ("k", 1), ("j", 3)], "k string, t int")
    right = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b"), ("k", 9, "c")], "k string, t int, v string")
    assert sorted((r.k, r.t, r.v) for r in intervals.as_of(left, right, ["k"], "t", ["v"]).collect() if r.v) == [("k", 5, "b")]


def test_diff_kinds(spark):
    scan = spark.createDataFrame([("same", 1, 1, 1, "h"), ("moved", 1, 2, 2, "h"), ("new", 1, 1, 1, "n"), ("edit", 2, 2, 2, "x"), ("bad", 3, 3, 3, None)], "path string, size bigint, mtime_ns bigint, ctime_ns bigint, hash string")
    files = spark.createDataFrame([(p, s, 1, 1, "h", "active") for p, s in (("same", 1), ("moved", 1), ("edit", 1), ("gone", 1), ("bad", 1))], "path string, size bigint, mtime_ns bigint, ctime_ns bigint, hash string, status string")
    got = {r.path: (r.change_kind, r.stat_changed) for r in ingest.classify(scan, files).collect()}
    assert got == {"same": ("unchanged", False), "moved": ("unchanged", True), "new": ("added", False), "edit": ("changed", False), "gone": ("deleted", False), "bad": ("unreadable", False)}
    full = {r.path: r.change_kind for r in ingest.classify(scan, files, incremental=False).collect()}
    assert full["same"] == "changed" and full["gone"] == "deleted"
    assert ingest.gate({"is_stale": True, "out_of_date": 1, "changed_bytes": 5}, max_files=1, max_bytes=5)["status"] == "repair"
    assert ingest.gate({"is_stale": True, "out_of_date": 1, "changed_bytes": 6}, max_files=1, max_bytes=5)["reason"] == "threshold_exceeded"


def test_memory_references_and_verdicts(spark):
    row = spark.createDataFrame([("see `a b` and src/x.py, or conf.json; call do_it and plain",)], "t string").select(memory.references(F.col("t")).alias("r"), memory.code_tokens(F.col("t")).alias("c")).first()
    assert set(row.r) == {"a b", "src/x.py", "conf.json"} and row.c == ["do_it"]
    empty = spark.createDataFrame([], "entry_id string, verdict string")
    entries = spark.createDataFrame([("1",)], "entry_id string")
    assert {r.verdict: r.entries for r in memory.verdict_histogram(memory.entry_verdicts(entries, empty)).collect()} == {"verified": 0, "drifted": 0, "invalidated": 0, "unanchored": 1}


def test_budgets():
    result = budget.fit({"edges": list(range(400)), "nodes": list(range(300)), "x": {"low_confidence": ["a" * 50] * 40}}, 300)
    assert result["token_estimate"] <= 300 and result["x"]["low_confidence"] == [] and len(result["nodes"]) > 0
    assert result["truncation"]["dropped"]["low_confidence"] == 40 and result["truncation"]["within_budget"]
    assert not budget.fit({"x": "y" * 900}, 64)["truncation"]["within_budget"]
    chosen = budget.select_facts([("A", ["a" * 400, "short"]), ("B", ["also short"])], 64)
    assert chosen["sections"] == [("A", ["short"]), ("B", ["also short"])] and chosen["dropped"] == {"A": 1} and chosen["within_budget"]
    with pytest.raises(ValueError):
        budget.select_facts([], 10)


def test_promotion_and_purpose(spark):
    nodes = spark.createDataFrame([node("m1", "Module", "deep/down/core.py"), node("m2", "Module", "a.py"), node("m3", "Module", "tests/t.py"), node("t", "TestFile", "tests/t.py"), node("x", "Module", "examples/e.py")], NODE)
    graph = edges(spark, *[("m2", "IMPORTS", "m1", 1.0)], *[("x", "IMPORTS", "m1", 1.0)] * 5)
    assert [r.location for r in overview.promoted(nodes, graph, ("Module",), 9, by_degree=True).collect()] == ["deep/down/core.py", "a.py"]
    texts = spark.createDataFrame([("README.md", "# T\n\nImplemented:\n\n- a. b\n\nIt does\nthings. Yes.\n")], "path string, content string")
    assert overview.purpose(texts).first().paragraph == "It does things. Yes."


def test_paths_and_ignore_rules(spark):
    frame = spark.createDataFrame([("docs/a/x.md", "../b.py"), ("x.md", "../up"), ("x.md", "/src/./y")], "p string, r string")
    assert [r.j for r in frame.select(paths.joined(F.col("p"), F.col("r")).alias("j")).collect()] == ["docs/b.py", None, "src/y"]
    rules = paths.IgnoreRules([".git/", "*.env"], [("", ["build/", "*.log", "!keep.log", "/only.txt", "a/**/z"]), ("sub", ["!*.log", "local"])])
    hit = {p for p in ("build/x", "src/build/x", "a.log", "keep.log", "sub/b.log", "only.txt", "x/only.txt", "a/b/c/z", "sub/local", "local", ".git/x", "s.env") if rules.ignored(p)}
    assert hit == {"build/x", "src/build/x", "a.log", "only.txt", "a/b/c/z", "sub/local", ".git/x", "s.env"}


def test_config_is_strict(tmp_path):
    folder = tmp_path / ".stratagraph"
    folder.mkdir()
    (folder / "config.json").write_text('{"history_window": 9}')
    assert Config.load(tmp_path).history_window == 9
    for bad in ('{"no": 1}', '{"history_window": 0}', "[]"):
        (folder / "config.json").write_text(bad)
        with pytest.raises(ValueError):
            Config.load(tmp_path)


def found(path, content, kind):
    return [json.loads(p) for k, p in parse_one(path, content) if k == kind]


def test_markdown_sections():
    content = "# Title\nintro\n## Setup\n### Details\nx\n## Tasks\n- [ ] TODO one\n## Setup\n```\n# no\n```\n"
    spans = {n["qualified_name"]: (n["start_line"], n["end_line"]) for n in found("d.md", content, "node") if n["type"] == "MarkdownSection"}
    assert spans == {"d.md#Title": (1, 11), "d.md#Title/Setup": (3, 5), "d.md#Title/Setup/Details": (4, 5), "d.md#Title/Tasks": (6, 7), "d.md#Title/Setup@2": (8, 11)}
    assert [n["name"] for n in found("d.md", content, "node") if n["type"] == "Task"] == ["TODO one"]


def test_config_parsers_never_keep_values():
    secret = "hunter2"
    for path, content in {".env": f"A={secret}\nbad line\n", "a.json": f'{{"k": {{"p": "{secret}"}}}}', "a.toml": f'[t]\np = "{secret}"\n', "a.yaml": f"p: {secret}\n", "Dockerfile": f"FROM x:1 AS b\nENV P={secret}\nEXPOSE 80 99999\n"}.items():
        rows = list(parse_one(path, content))
        assert secret not in json.dumps(rows), path
        assert any(json.loads(p).get("type") == "ConfigKey" for k, p in rows if k == "node"), path
    assert [json.loads(w) for w in (p for k, p in parse_one("x.json", "{") if k == "warning")]
    ports = [json.loads(n["metadata"]).get("ports") for n in found("Dockerfile", "EXPOSE 80 99999\n", "node") if n["name"] == "EXPOSE"]
    assert ports == [["80"]]


def test_python_calls_and_cli():
    source = "import click\n\n@click.group()\ndef cli(): pass\n\n@cli.command('go-now')\ndef go():\n    helper()\n\n@cli.command()\ndef do_it(): go()\n\ndef helper(): missing()\n"
    edges_ = [(e["type"], e["confidence"], e["is_inferred"]) for e in found("m.py", source, "edge") if e["type"] == "CALLS"]
    assert edges_ == [("CALLS", 0.9, False)] * 2
    assert {n["name"] for n in found("m.py", source, "node") if n["type"] == "CLICommand"} == {"go-now", "do-it"}
    module = next(n for n in found("m.py", source, "node") if n["type"] == "Module")
    assert [p["name"] for p in json.loads(module["metadata"])["pending"] if "name" in p] == ["missing"]
    assert found("bad.py", "def (", "warning")


def test_accuracy(spark):
    fact = lambda *x: spark.createDataFrame([(v,) for v in x], "fact string")
    row = overview.accuracy(fact("a", "b", "z"), fact("a", "b", "c"), fact("z", "y")).first()
    assert (row.true_positives, row.false_negatives, row.false_positives, row.passed) == (2, 1, 1, False)
    assert row.precision == row.recall == round(2 / 3, 6)
