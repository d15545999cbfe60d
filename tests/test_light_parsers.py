"""Definitions, calls, imports and environment reads of languages that are read by patterns."""

import json

import pytest

from stratagraph.operators.parse.registry import parse_one

SOURCES = {
    "a/x.js": "import {b} from './b';\nconst c = require('../c');\n// function no() {}\nfunction outer() {\n  inner('function fake() {');\n  return new Thing(process.env.KEY);\n}\nconst inner = (x) => {\n  far();\n};\nclass Thing {\n  run() { this.stop(); }\n  stop() { outer(); }\n}\n",
    "a/y.ts": "export async function load(id: string): Promise<void> { helper(id); }\nfunction helper(x: string) {}\n",
    "s.php": "<?php\nrequire 'lib/u.php';\nclass A {\n  function go() { $this->stop(); helper(); new A(); }\n  function stop() {}\n}\nfunction helper() { return getenv('P'); }\n",
    "s.sh": "#!/bin/bash\nX=1\n# greet\ngreet() {\n  echo hi\n}\nmain() {\n  greet\n}\nmain\n",
    "m.go": "package m\nimport \"fmt\"\ntype T struct {}\nfunc (t *T) Run() { helper() }\nfunc helper() {}\n",
    "M.java": "import a.B;\npublic class M {\n  private int run(int x) {\n    stop();\n    return new M();\n  }\n  void stop() { }\n}\n",
    "r.rb": "require_relative 'lib/u'\nmodule Z\n  class R\n    def go\n      if x\n        stop()\n      end\n    end\n    def stop\n      R.new\n    end\n  end\nend\n",
}


def facts(path):
    rows = list(parse_one(path, SOURCES[path]))
    assert not [p for k, p in rows if k == "warning"], rows
    nodes = {n["id"]: n for k, p in rows if k == "node" for n in [json.loads(p)]}
    named = {(n["type"], n["name"]) for n in nodes.values()}
    edges = {(e["type"], nodes[e["source_node_id"]]["name"], nodes[e["target_node_id"]]["name"]) for k, p in rows if k == "edge" for e in [json.loads(p)] if e["source_node_id"] in nodes and e["target_node_id"] in nodes}
    module = next(json.loads(n["metadata"]) for n in nodes.values() if n["type"] == "Module")
    return named, edges, {p["name"] for p in module["pending"]}


@pytest.mark.parametrize(
    ("path", "nodes", "edges", "pending"),
    [
        ("a/x.js", {("Function", "outer"), ("Function", "inner"), ("Class", "Thing"), ("Method", "run"), ("Method", "stop")}, {("CALLS", "outer", "inner"), ("INSTANTIATES", "outer", "Thing"), ("CALLS", "run", "stop"), ("CALLS", "stop", "outer"), ("READS_ENV", "outer", "KEY")}, {"far"}),
        ("a/y.ts", {("Function", "load"), ("Function", "helper")}, {("CALLS", "load", "helper")}, set()),
        ("s.php", {("Class", "A"), ("Method", "go"), ("Function", "helper")}, {("CALLS", "go", "stop"), ("CALLS", "go", "helper"), ("INSTANTIATES", "go", "A"), ("READS_ENV", "helper", "P")}, set()),
        ("s.sh", {("Function", "greet"), ("Function", "main"), ("Variable", "X")}, {("CALLS", "main", "greet")}, set()),
        ("m.go", {("Class", "T"), ("Method", "Run"), ("Function", "helper")}, {("CALLS", "Run", "helper"), ("CONTAINS", "T", "Run")}, set()),
        ("M.java", {("Class", "M"), ("Method", "run"), ("Method", "stop")}, {("CALLS", "run", "stop"), ("INSTANTIATES", "run", "M")}, set()),
        ("r.rb", {("Class", "R"), ("Method", "go"), ("Method", "stop")}, {("CALLS", "go", "stop"), ("INSTANTIATES", "stop", "R")}, set()),
    ],
)
def test_language(path, nodes, edges, pending):
    found, links, waiting = facts(path)
    assert nodes <= found, nodes - found
    assert edges <= links, edges - links
    assert waiting == pending and not any(n in ("no", "fake") for _, n in found)
