"""Tables, callbacks, deleted files and memory in the graph of a built tree."""

import subprocess

import pytest
from pyspark.sql import functions as F

from stratagraph.engine import Engine

FILES = {
    "app/models.py": "class User(Base):\n    __tablename__ = 'users'\n\ndef all_users():\n    return User.query.all()\n",
    "app/api.py": "from app.models import User\n\ndef one(session):\n    return session.get(User, 1)\n\ndef add(session):\n    session.add(User())\n",
    "web/app.js": "function find() {\n  return 1;\n}\n\napp.get('/items', async (req, res) => {\n  const x = 1;\n  find();\n});\nfind();\n",
    "docs/guide.md": "# Guide\n\n## Old\n\nSee [gone](../lib/gone.py) and `lib/before.py`.\n",
    "lib/gone.py": "def lost():\n    return 1\n",
    "lib/before.py": "def moved():\n    a = 1\n    b = 2\n    return a + b\n",
    "lib/user.py": "from lib.gone import lost\n\ndef needs():\n    return lost()\n",
}


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=A", "-c", "user.email=a@example.org", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("whole")
    for name, content in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    git(root, "init", "-q")
    git(root, "add", ".")
    git(root, "commit", "-qm", "0")
    return root


@pytest.fixture(scope="module")
def engine(spark, tree, tmp_path_factory):
    made = Engine(spark, str(tree), str(tmp_path_factory.mktemp("store") / "s"))
    assert made.index()["warnings"] == []
    return made


def ends(engine, kind):
    n = engine.table("nodes")
    s, t = n.select(F.col("id").alias("source_node_id"), F.col("name").alias("s")), n.select(F.col("id").alias("target_node_id"), F.col("name").alias("t"))
    return {(r["s"], r["t"]) for r in engine.table("edges").filter(F.col("type") == kind).join(s, "source_node_id").join(t, "target_node_id").collect()}


def test_tables_of_models(engine):
    assert ends(engine, "DEPENDS_ON") == {("User", "users")}
    assert ends(engine, "READS_TABLE") == {("all_users", "users"), ("one", "users")}
    assert ends(engine, "WRITES_TABLE") == {("add", "users")}


def test_inline_callbacks_have_their_calls(engine):
    own = [(r["start_line"], r["end_line"]) for r in engine.table("nodes").filter("name = 'GET /items callback'").collect()]
    assert own == [(5, 8)]
    assert ("GET /items", "GET /items callback") in ends(engine, "HANDLES_ROUTE")
    assert ("GET /items callback", "find") in ends(engine, "CALLS")


def test_memory_is_in_the_graph(engine):
    said = engine.write_memory("Kept `lib/user.py`", decisions=["needs stays"], changed_files=["lib/user.py", "no/file.py"])
    nodes = {r["id"]: r["type"] for r in engine.table("nodes").filter("extractor = 'agent_memory'").collect()}
    assert sorted(nodes.values()) == ["AgentNote", "Decision"] and nodes[said["note"]] == "AgentNote"
    assert {t for _, t in ends(engine, "MAY_IMPACT")} == {"user.py"}
    assert "needs stays" in {t for s, t in ends(engine, "CONTAINS") if s.startswith("Agent session")}


def test_changes_know_deleted_and_renamed_files(engine, tree):
    git(tree, "rm", "-q", "lib/gone.py")
    git(tree, "mv", "lib/before.py", "lib/after.py")
    engine.index()
    found = engine.change_context()
    assert ("lib/gone.py", "lost") in {(x["path"], x["name"]) for c in found["changes"] for x in c["symbols"]}
    old = {(x["doc_path"], x["line"], x["old_path"]) for x in found["docs_likely_needing_updates"]}
    assert {("docs/guide.md", 5, "lib/gone.py"), ("docs/guide.md", 5, "lib/before.py")} <= old
    assert len(found["unknowns"]) == 1 and ends(engine, "MAY_IMPACT")


def test_pairs_have_their_newest_commits(spark, tmp_path):
    import json

    git(tmp_path, "init", "-q")
    shas = []
    for i in range(22):
        for name in ("a.py", "b.py"):
            (tmp_path / name).write_text(f"x = {i}\n")
        git(tmp_path, "add", "a.py", "b.py")
        git(tmp_path, "commit", "-qm", str(i))
        shas.insert(0, subprocess.run(["git", "-C", str(tmp_path), "rev-parse", "HEAD"], check=True, capture_output=True, text=True).stdout.strip())
    made = Engine(spark, str(tmp_path), str(tmp_path / ".stratagraph/store"))
    made.index()
    (about,) = [json.loads(r["metadata"]) for r in made.table("edges").filter("type = 'CO_CHANGED_WITH'").collect()]
    assert about["supporting_commits"] == shas[:20] and about["supporting_commits_truncated"] and about["support"] == 22
