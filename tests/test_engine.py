"""Builds and queries over a small tree with a history."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from stratagraph.engine import Engine, StaleError
from stratagraph.sources.snapshot import Snapshots
from stratagraph.streaming.ingest import stream

FILES = {
    "README.md": "# Shop\n\n- list\n\nA small shop. It sells things.\n\n## Usage\n\nSee [the service](src/service.py) and `price_of`.\n- TODO: write more\n",
    "src/service.py": "import os\nfrom src.prices import price_of\n\nURL = 1\n\n@app.route('/buy', methods=['POST'])\ndef buy():\n    token = os.getenv('SHOP_TOKEN')\n    return price_of(token)\n\ndef later():\n    return unique_helper()\n",
    "src/prices.py": "class Price:\n    pass\n\ndef price_of(x):\n    return Price()\n",
    "src/tools.py": "def unique_helper():\n    return 1\n",
    "tests/test_service.py": "from src.service import buy\n\ndef test_buy():\n    buy()\n",
    "conf/app.yaml": "shop:\n  token: ${SHOP_TOKEN}\n",
    "build/skip.py": "x = 1\n",
    ".env": "SECRET=1\n",
    "bin.dat": "a\0b",
}


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=A", "-c", "user.email=a@example.org", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, content in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    git(root, "init", "-q")
    for i in range(3):
        for name in ("src/service.py", "src/prices.py"):
            (root / name).write_text(FILES[name] + f"# {i}\n")
        git(root, "add", "src", "README.md", "tests", "conf")
        git(root, "commit", "-qm", str(i))
    return root


@pytest.fixture(scope="module")
def engine(spark, tree, tmp_path_factory):
    made = Engine(spark, str(tree), str(tmp_path_factory.mktemp("store") / "s"))
    made.first = made.index()
    return made


def test_first_build(engine):
    assert engine.first["files_changed"] == 6 and engine.first["warnings"] == [] and engine.first["history"]["status"] == "extracted"
    paths = {r["path"] for r in engine.table("files").filter("status = 'active'").collect()}
    assert paths == {"README.md", "src/service.py", "src/prices.py", "src/tools.py", "tests/test_service.py", "conf/app.yaml"}
    assert not engine.table("texts").filter(F.col("path") == "conf/app.yaml").count()


def edge_names(engine, kind):
    n = engine.table("nodes")
    s, t = n.select(F.col("id").alias("source_node_id"), F.col("name").alias("s")), n.select(F.col("id").alias("target_node_id"), F.col("name").alias("t"))
    return {(r["s"], r["t"]) for r in engine.table("edges").filter(F.col("type") == kind).join(s, "source_node_id").join(t, "target_node_id").collect()}


def test_edges_across_files(engine):
    assert {("buy", "price_of"), ("later", "unique_helper"), ("test_buy", "buy")} <= edge_names(engine, "CALLS")
    assert ("price_of", "Price") in edge_names(engine, "INSTANTIATES")
    assert ("POST /buy", "buy") in edge_names(engine, "HANDLES_ROUTE")
    assert {("Usage", "service.py"), ("Usage", "price_of")} <= edge_names(engine, "MENTIONS")
    assert ("buy", "SHOP_TOKEN") in edge_names(engine, "READS_ENV") and ("app.yaml", "SHOP_TOKEN") in edge_names(engine, "SETS_ENV")
    assert edge_names(engine, "CO_CHANGED_WITH") == {("prices.py", "service.py")}


def test_queries(engine):
    assert engine.search("price_of")[0]["name"] == "price_of"
    assert [x["name"] for x in engine.find_symbol("BUY", exact=True)] == ["buy"]
    assert {x["role"] for x in engine.trace_config("shop_token")} == {"definition", "usage"}
    found = engine.impact("src/prices.py")
    names = {x["name"] for b in ("high", "medium", "low") for x in found[f"{b}_confidence"]}
    assert {"buy", "test_buy", "POST /buy"} <= names and found["historical_evidence"][0]["partner"] == "src/service.py"
    assert any(x["path"] == "README.md" for x in found["docs_likely_needing_updates"])
    assert engine.impact("nothing.py") is None
    assert engine.explain_file("src/service.py")["related_tests"][0]["path"] == "tests/test_service.py"
    assert {x["name"] for x in engine.trace_symbol("buy", 1, "out")["nodes"]} >= {"buy", "price_of", "SHOP_TOKEN"}
    assert engine.trace_data_flow("POST /buy", 2, "out")["nodes"][0]["cost"] == 0
    assert engine.docs_for_code("price_of")[0]["doc_path"] == "README.md"
    assert engine.code_for_docs("README.md", "usage")
    assert engine.co_change("src/prices.py")[0]["support"] == 3
    assert engine.churn()[0]["commits"] == 3 and engine.ownership()[0]["share"] == 1.0
    assert "A small shop" in engine.brief()["text"] and engine.brief(64)["dropped"]
    assert "Nodes By Type" in engine.report() and engine.status()["files"] == 6


def test_changes_stale_gate_and_memory(engine, tree):
    assert engine.require_fresh()["status"] == "current"
    said = engine.write_memory("We keep `src/service.py` simple", decisions=["price_of stays pure"])
    assert {a["reference"] for a in said["anchors"]} >= {"src/service.py", "price_of"}
    assert engine.verify_memory()["verified"] == 1
    path = tree / "src/tools.py"
    path.write_text("def other():\n    return 2\n")
    os.utime(path, (2_000_000_000, 2_000_000_000))
    context = engine.change_context()
    assert [x["path"] for x in context["changes"] if x["status"] == "A"]
    engine.auto_index = False
    with pytest.raises(StaleError):
        engine.require_fresh()
    engine.auto_index = True
    assert engine.require_fresh()["status"] == "reindexed"
    assert ("later", "unique_helper") not in edge_names(engine, "CALLS")
    os.remove(path)
    (tree / "src/prices.py").write_text("\n\n\n\n\ndef price_of(x):\n    return 1\n")
    os.utime(tree / "src/prices.py", (2_000_000_100, 2_000_000_100))
    done = engine.index()
    assert (done["files_changed"], done["files_deleted"]) == (1, 1)
    assert {r["path"] for r in engine.table("files").filter("status = 'deleted'").collect()} == {"src/tools.py"}
    assert engine.verify_memory()["drifted"] == 1 and engine.read_memory("pure")[0]["verdict"] == "drifted"
    assert engine.index()["files_changed"] == 0


def test_snapshots_refuse_newer_schemas(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    assert store.current() is None and store.write({}) == 1 and store.write({}) == 2 and store.current() == 2
    (tmp_path / "s" / "CURRENT-3").write_text("3 99 end")
    with pytest.raises(ValueError):
        store.current()


def test_stream_of_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.py").write_text("def f():\n    pass\n")
    store = Snapshots(spark, str(tmp_path / "s"))
    for _ in range(2):
        query = stream(spark, str(folder), store, str(tmp_path / "c"))
        query.awaitTermination()
        (folder / "b.md").write_text("# T\n")
    assert {r["type"] for r in store.read("nodes").collect()} >= {"Function", "MarkdownSection"}
