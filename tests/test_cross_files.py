"""Imports of JavaScript, Go and Java over files, budgets in steps, gated reports and searches with snippets."""

import copy
import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from stratagraph.engine import Engine
from stratagraph.functions import text
from stratagraph.operators import budget, memory
from stratagraph.operators.parse import config

FILES = {
    "go.mod": "// about\nmodule ex.org/shop // the module\n\ngo 1.22\n",
    "cmd/main.go": 'package main\n\nimport (\n\t"fmt"\n\tp "ex.org/shop/price"\n)\n\nfunc main() {\n\tp.Of()\n}\n',
    "price/a.go": "package price\n\nfunc Of() {\n}\n",
    "price/b.go": "package price\n\nfunc Other() {\n}\n",
    "price/a_test.go": "package price\n\nfunc TestOf() {\n}\n",
    "src/main/java/org/shop/App.java": "package org.shop;\nimport org.shop.model.Price;\nimport static org.shop.util.Text.trim;\nimport org.shop.model.*;\nimport java.util.List;\n\npublic class App {\n  public void run() {\n    new Price();\n  }\n}\n",
    "src/main/java/org/shop/model/Price.java": "package org.shop.model;\npublic class Price {\n}\n",
    "src/main/java/org/shop/model/Tax.java": "package org.shop.model;\npublic class Tax {\n}\n",
    "src/main/java/org/shop/util/Text.java": "package org.shop.util;\npublic class Text {\n}\n",
    "web/routes.js": "import { list as show, Item } from './handlers';\nimport start from './start';\nimport { lodash } from 'lodash';\napp.get('/items', show);\nfunction boot() {\n  start();\n  new Item();\n  lodash();\n}\n",
    "web/handlers.js": "export function list() {\n}\nexport class Item {\n}\n",
    "web/start.ts": "export default function begin() {\n}\n",
    "other/lodash.js": "function lodash() {\n}\n",
    "pkg/__init__.py": "def handler():\n    return 1\n",
    "api.py": "from pkg import handler\n\napp.add_url_rule('/h', view_func=handler)\n",
    "README.md": "# Shop\n\nPrices of many things are kept here. A needle is in the haystack.\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, content in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    made = Engine(spark, str(root), str(tmp_path_factory.mktemp("store") / "s"))
    made.first = made.index()
    return made


def ends(engine, kind):
    n = engine.table("nodes").select("id", "name", "path")
    s, t = (n.select(F.col("id").alias(f"{x}_id"), F.col("name").alias(f"{x}_name"), F.col("path").alias(f"{x}_path")) for x in "st")
    rows = engine.table("edges").filter(F.col("type") == kind).join(s, F.col("source_node_id") == F.col("s_id")).join(t, F.col("target_node_id") == F.col("t_id"))
    return {(r.s_path, r.s_name, r.t_path, r.t_name) for r in rows.collect()}


def test_packages_are_imported(engine):
    java = "src/main/java/org/shop/"
    got = {(a, b) for a, _, b, _ in ends(engine, "IMPORTS")}
    assert {("cmd/main.go", "price/a.go"), ("cmd/main.go", "price/b.go")} <= got and ("cmd/main.go", "price/a_test.go") not in got
    assert {(f"{java}App.java", f"{java}{x}.java") for x in ("model/Price", "model/Tax", "util/Text")} <= got
    assert ("web/routes.js", "web/handlers.js") in got and ("web/routes.js", "web/start.ts") in got


def test_bound_names_are_called(engine):
    calls, made = ends(engine, "CALLS"), ends(engine, "INSTANTIATES")
    assert ("web/routes.js", "boot", "web/start.ts", "begin") in calls
    assert ("web/routes.js", "boot", "web/handlers.js", "Item") in made
    assert ("src/main/java/org/shop/App.java", "run", "src/main/java/org/shop/model/Price.java", "Price") in made
    # a name that is imported from elsewhere isn't the tree's own
    assert not [x for x in calls if x[3] == "lodash"]
    assert ("web/routes.js", "GET /items", "web/handlers.js", "list") in ends(engine, "HANDLES_ROUTE")


def test_runs_are_recorded(engine):
    (run,) = engine.table("runs").collect()
    assert run.started_at <= run.finished_at and run.files_scanned == len(FILES) and run.nodes_created == engine.table("nodes").count() and run.edges_created == engine.table("edges").count()


def test_searches_have_snippets_and_reports_are_gated(engine, monkeypatch):
    (hit,) = [x for x in engine.search("needle") if x["path"] == "README.md" and "full-text" in x["reasons"]][:1]
    assert "[needle]" in hit["snippet"]
    said = engine.churn_report()
    assert said["status"] == "history_unavailable" and "items" not in said
    git = lambda *a: subprocess.run(["git", "-C", engine.root, "-c", "user.name=A", "-c", "user.email=a@example.org", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "."), git("commit", "-qm", "one")
    engine.auto_index = False
    assert engine.refresh_history()["status"] == "stale" and engine.ownership_report()["status"] == "history_stale"
    engine.auto_index = True
    done = engine.co_change_report("price/a.go")
    assert done["status"] == "ok" and done["history"]["status"] == "extracted" and done["history"]["commit_count"] == 1 and done["text"].startswith("co_change")
    assert engine.refresh_history()["status"] == "current"
    monkeypatch.setattr("stratagraph.sources.git._git", lambda *a: 1 / 0)
    assert engine.refresh_history()["status"] == "error"


def test_ladder_keeps_what_matters_most():
    rng = random.Random(3)
    changes = [{"path": f"p{i}", "symbols": [{"name": "s" * rng.randint(1, 30)} for _ in range(3)], "file_node": "f" * 10, "line_ranges": [{"start": i}]} for i in range(30)]
    whole = {"changes": changes, "historical_evidence": [{"h": i} for i in range(20)], "docs_likely_needing_updates": [{"d": i} for i in range(20)], "low_confidence": [{"l": i} for i in range(20)], "high_confidence": [{"g": i} for i in range(20)]}
    last = None
    for limit in (5000, 900, 700, 500, 400, 200, 100):
        got = budget.ladder(copy.deepcopy(whole), limit)
        assert got["token_estimate"] == -(-len(json.dumps(got | {"token_estimate": 0})) // 4) or got["truncation"]["within_budget"] == (got["token_estimate"] <= limit)
        order = [x for x in budget.LADDER if x in got["truncation"]["dropped"]]
        # all steps before the last one that was taken are exhausted
        for label in order[:-1]:
            parent, _, field = label.partition(".")
            assert not got[parent] if not field else not any(x[field] for x in got[parent])
        assert last is None or len(got["changes"]) <= last
        last = len(got["changes"])
    assert budget.ladder(copy.deepcopy(whole), 5000)["truncation"]["applied"] is False


def test_bm25_splits_a_text_once(spark):
    texts = spark.createDataFrame([("a", "n", "one two three one two"), ("b", "one two", "x"), ("c", "m", "two one")], "path string, name string, content string").withColumn("node_id", F.lit(None).cast("string"))
    rows = text.keyed(texts).withColumn("row_key", F.struct(*text.ROW))
    facts = text.phrase_facts(rows, text.phrases("one-two three"), "row_key").filter("f0 > 0 and f1 > 0")
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 3  # one a column, none in a filter
    scanned = {(r.row_key.path, round(r.score, 9)) for r in text.bm25(rows, "one-two", "row_key").collect()}
    assert {p for p, _ in scanned} == {"a", "b"}
    stored = {(r.path, round(r.score, 9)) for r in text.stored_bm25(*text.indexed(texts), "one-two").collect()}
    assert stored == scanned
    assert text.stored_bm25(*text.indexed(texts), "two two").count() == 3 and text.stored_bm25(*text.indexed(texts), "?").count() == 0


def test_references_and_json_keys(spark):
    said = [("see `a b`, `c\nd` and src/x.py: or (conf.json). call do_it, m.sub and someThing; plain words end.",), ("`open only x.y",), (None,)]
    got = [(r.r, r.c) for r in spark.createDataFrame(said, "t string").select(memory.references(F.col("t")).alias("r"), memory.code_tokens(F.col("t")).alias("c")).collect()]
    assert set(got[0][0]) >= {"a b", "src/x.py", "conf.json"} and set(got[0][1]) >= {"do_it", "someThing"} and "plain" not in got[0][1]
    assert got[1][0] == ["x.y"] and got[2] == (None, None)
    keys = list(config._json_keys('{"a\\"b": {"c" :\n1, "d": "e: f"},\n"g": ["h", "i:"]}'))
    assert keys == [('a"b', 1), ("c", 1), ("d", 2), ("g", 3)]
