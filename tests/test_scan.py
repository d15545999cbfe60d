"""Scans open no file that is left out or known, and keep binary files known."""

import os

import pytest
from pyspark.sql import functions as F

from stratagraph.engine import Engine
from stratagraph.sources import scan


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "a tree [1]"
    for path, text in {"src/a.py": "x = 1\n", "src/b.py": "y = 2\n", "logs/x.log": "no\n", ".gitignore": "logs/\n", "src/.gitignore": "c.py\n", "src/c.py": "z\n", "src/__init__.py": "", ".github/w.yml": "on: push\n", ".git/config": "g", "node_modules/m.js": "m", "pkg/node_modules/n.js": "n", ".env": "S=1", "big.txt": "b" * 400}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "pic.bin").write_bytes(b"a\0b")
    return root


def test_listing_opens_nothing_and_prunes(spark, tree):
    opened = []
    walk = scan._Walk(f"file://{tree}", (), (), 10**6, 10**6)
    real = walk.system

    class System:
        type_name = "local"

        def get_file_info(self, what):
            opened.append(what.base_dir.removeprefix(walk.top))
            return real.get_file_info(what)

        def open_input_stream(self, path):
            opened.append(path.removeprefix(walk.top))
            return real.open_input_stream(path)

    walk.system = System()
    want = {"src/a.py", "src/b.py", "src/__init__.py", ".github/w.yml", ".gitignore", "src/.gitignore", "pic.bin", "big.txt"}
    assert {p for p, *_ in walk.run("", "[]")} == want
    assert set(opened) == {"", "/src", "/pkg", "/.github", "/.gitignore", "/src/.gitignore"}
    assert {r.path for r in scan.listing(spark, str(tree)).collect()} == want
    assert {r.path for r in scan.listing(spark, str(tree), step=1).collect()} == want
    assert {r.path for r in scan.listing(spark, str(tree), max_bytes=300).collect()} == want - {"big.txt"}
    found = {r.path: (r.content, r.binary, r.hash is None) for r in scan.contents(spark, str(tree), scan.listing(spark, str(tree), include=("src/*", "pic.bin", "gone"))).collect()}
    assert found["src/a.py"] == ("x = 1\n", False, False) and found["pic.bin"] == (None, True, False)
    lost = spark.createDataFrame([("no/such", 1)], "path string, size bigint")
    assert scan.contents(spark, str(tree), lost).first()["hash"] is None


def test_builds_open_only_what_changed(spark, tree, monkeypatch):
    engine = Engine(spark, str(tree))
    engine.index()
    files = {r.path: r.status for r in engine.table("files").collect()}
    assert files["pic.bin"] == "binary" and files["src/a.py"] == "active" and "logs/x.log" not in files
    assert not engine.freshness()["is_stale"]
    asked = []
    real = scan.contents
    monkeypatch.setattr("stratagraph.engine.contents", lambda s, r, listed: asked.append({x.path for x in listed.collect()}) or real(s, r, listed))
    (tree / "src" / "b.py").write_text("y = 3333\n")
    os.utime(tree / "src" / "b.py", (2_000_000_000, 2_000_000_000))
    assert engine.freshness()["changed"] == 1
    out = engine.index()
    assert asked == [{"src/b.py"}] and out["files_changed"] == 1
    (tree / "pic.bin").unlink()
    assert engine.freshness()["deleted"] == 1
    engine.index()
    assert "pic.bin" not in {r.path for r in engine.table("files").collect()} and not engine.freshness()["is_stale"]
    assert {r.path for r in engine.table("nodes").filter(F.col("type") == "Module").collect()} == {"src/a.py", "src/b.py", "src/__init__.py"}
