"""What grew with more than the rows, or was cut, on large tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from stratagraph.operators import ingest, intervals, resolve, traverse
from stratagraph.plans import build, graph, registry
from stratagraph.schemas import IMPACT_EDGES
from stratagraph.sources import bridge

SF = "/root/testdata/sf0.001"
EDGES = "id string, source_node_id string, target_node_id string, type string"


def test_every_start_has_its_edges(spark):
    nodes = spark.createDataFrame([(f"n{i}", "f", f"m.f{i}", f"p{i}", i) for i in range(30)], "id string, name string, qualified_name string, path string, start_line int")
    edges = spark.createDataFrame([(f"e{i}", f"n{i}", f"t{i}", "CALLS") for i in range(30)] + [("h", "n1", "n2", "CO_CHANGED_WITH"), ("b", "t1", "n3", "CALLS")], EDGES)
    ids = lambda *a, **b: sorted(r["id"] for r in traverse.trace_edges(nodes, edges, "f", *a, **b).collect())
    assert ids(1, "both", limit=None) == sorted(["b", *(f"e{i}" for i in range(30))])
    assert ids(1, "out", limit=None) == sorted(f"e{i}" for i in range(30)) and ids(1, "in", limit=None) == ["b"]
    assert len(ids(1, "out")) == traverse.START_LIMIT and ids(0, limit=None) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_a_trace_of_one_step_stores_no_edges(spark, monkeypatch):
    monkeypatch.setattr(graph, "stored", lambda *_: pytest.fail("all edges were written"))
    assert graph.trace_symbol_edges(spark, SF).count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_joins_of_the_bridge_move_keys(spark):
    """No hash and no path is in a shuffle of the edges of order lines."""
    plan = bridge.edges(spark, SF).filter("type = 'INSTANTIATES'")._jdf.queryExecution().executedPlan().toString()
    joins = plan[plan.index("Join") :]  # below the first join
    assert "sha1(" not in joins and "sha1(" in plan


def test_innermost_against_brute_force(spark):
    rng = random.Random(5)
    spans = [(rng.choice("ab"), f"s{i}", a := rng.randint(-40, 300), None if i % 9 == 0 else a + rng.randint(-1, 90)) for i in range(120)] + [("a", "none", None, 9), ("b", "far", 2**31 - 2, None)]
    points = [(f"c{i}", rng.choice("abc"), rng.randint(-60, 420)) for i in range(300)] + [("c0", "a", None), ("end", "b", 2**31 - 1), ("twice", "a", 7), ("twice", "a", 7)]

    def best(key, line):
        hold = [(s[2], s[1]) for s in spans if line is not None and s[0] == key and s[2] is not None and s[2] <= line and (s[3] is None or line <= s[3])]
        return max(hold)[1] if hold else "-"

    got = intervals.innermost(spark.createDataFrame(points, "id string, path string, line int"), spark.createDataFrame(spans, "path string, section_id string, start_line int, end_line int"), "path", "line", F.lit("-"))
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in spark.createDataFrame([(*p, best(*p[1:])) for p in points], got.schema).collect())


def test_files_of_packages_are_not_shuffled_again(spark):
    modules = spark.createDataFrame([(f"g/c{i}.go", f"i{i}", "go", None, f"c{i}") for i in range(9)] * 2, "path string, id string, language string, package string, name string")
    imports = spark.createDataFrame([("a.go", "go", "ex.org/m/g", 3), ("g/c1.go", "go", "ex.org/m/g", 4)] * 2, "path string, kind string, spec string, line int")
    got = resolve.package_targets(imports, modules, "ex.org/m")
    assert sorted((r["path"], r["target_path"]) for r in got.collect()) == [("a.go", f"g/c{i}.go") for i in range(9)] + [("g/c1.go", f"g/c{i}.go") for i in range(9) if i != 1]
    assert not got._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")


def test_orphans_are_whole_rows_of_any_key(spark):
    """Keys that are no hashes, missing ends, unknown types; a row that is there twice stays twice, as in the SQL."""
    nodes = spark.createDataFrame([("a",), ("f" * 40,), ("F" * 40,)], "id string")
    rows = [("1", "a", "f" * 40, "CALLS"), ("2", "a", "0" * 40, "CALLS"), ("2", "a", "0" * 40, "CALLS"), ("3", "x", "y", "OTHER"), ("4", None, "a", "CALLS"), ("5", "F" * 40, "a", None), ("6", "b", "a", None)]
    assert sorted(r["id"] for r in ingest.orphan_edges(spark.createDataFrame(rows, EDGES), nodes).collect()) == ["2", "2", "3", "4", "6"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_impact_stores_only_its_types(spark, monkeypatch):
    kept, own = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda rows, *by: kept.append(own(rows, *by)) or kept[0])
    graph.impact_buckets(spark, SF)
    assert {r["type"] for r in kept[0].select("type").distinct().collect()} <= set(IMPACT_EDGES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_facts_of_edges_are_made_above_shuffles(spark):
    plan = build.fact_keys(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and "sha1(" not in plan
    assert not [x for x in plan.splitlines() if "Aggregate [fact" in x and "edge" in x]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("marked", [False, True])
def test_facts_of_odd_tables(spark, tmp_path, marked):
    """Rows that are there twice, keys with two names, names with two keys, missing names and keys; names with the marks that part facts."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    odd = {
        "region": ["SELECT * FROM t WHERE r_regionkey=1", "SELECT * REPLACE (NULL AS r_name) FROM t WHERE r_regionkey=2"],
        "nation": ["SELECT * FROM t WHERE n_nationkey<3", "SELECT * REPLACE ('twice' AS n_name) FROM t WHERE n_nationkey<3", "SELECT * REPLACE (n_nationkey+100 AS n_nationkey) FROM t", "SELECT * REPLACE (NULL AS n_name) FROM t WHERE n_nationkey=4"],
        "customer": ["SELECT * FROM t WHERE c_custkey%3=0", "SELECT * REPLACE (c_nationkey+100 AS c_nationkey) FROM t WHERE c_custkey%4=0", "SELECT * REPLACE (NULL AS c_name) FROM t WHERE c_custkey%5=0"],
        "orders": ["SELECT * FROM t WHERE o_orderkey%3=0", "SELECT * REPLACE (o_custkey+1 AS o_custkey) FROM t WHERE o_orderkey%4=0", "SELECT * REPLACE (NULL AS o_orderkey) FROM t WHERE o_orderkey<9"],
        "part": ["SELECT * FROM t WHERE p_partkey%3=0", "SELECT * REPLACE (NULL AS p_brand) FROM t WHERE p_partkey%4=0", "SELECT * REPLACE ('BRAND_1' AS p_brand) FROM t WHERE p_partkey%5=0", "SELECT * REPLACE (NULL AS p_partkey) FROM t WHERE p_partkey<9"],
        "supplier": ["SELECT * FROM t", "SELECT * REPLACE (s_suppkey+1 AS s_suppkey) FROM t", "SELECT * REPLACE (NULL AS s_name) FROM t WHERE s_suppkey<3", "SELECT * REPLACE ('' AS s_name) FROM t WHERE s_suppkey<5"],
        "lineitem": ["SELECT * FROM t WHERE l_orderkey%2=0", "SELECT * REPLACE (NULL AS l_partkey) FROM t WHERE l_orderkey<9", "SELECT * REPLACE (NULL AS l_suppkey) FROM t WHERE l_orderkey<9"],
        "documents": ["SELECT * FROM t WHERE doc_id%3=0", "SELECT * REPLACE (NULL AS source) FROM t WHERE doc_id<9", "SELECT * REPLACE (-doc_id AS doc_id) FROM t WHERE doc_id<9"],
        "events": ["SELECT * REPLACE (NULL AS event_type) FROM t WHERE event_id<9", "SELECT * REPLACE (NULL AS props) FROM t WHERE event_id<9"],
    }
    if marked:
        odd["region"] += ["SELECT * REPLACE ('a/b' AS r_name) FROM t WHERE r_regionkey=0", "SELECT * REPLACE ('a' AS r_name) FROM t WHERE r_regionkey=0"]
        odd["nation"] += ["SELECT * REPLACE ('c' AS n_name) FROM t WHERE n_regionkey=0", "SELECT * REPLACE ('b/c' AS n_name) FROM t WHERE n_regionkey=0"]
        odd["part"] += ["SELECT * REPLACE ('x|y@z' AS p_brand) FROM t WHERE p_partkey%6=0"]
        odd["supplier"] += ["SELECT * REPLACE ('@|lib/' AS s_name) FROM t WHERE s_suppkey<5"]
    for name, more in odd.items():
        con.execute(f"CREATE OR REPLACE VIEW t AS SELECT * FROM '{SF}/{name}.parquet'")
        con.execute(f"COPY ({' UNION ALL '.join(['SELECT * FROM t', *more])}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = [r[0] for r in con.execute(registry.ORACLES["fact_keys"]).fetchall()]
    got = [r["fact"] for r in build.fact_keys(spark, str(tmp_path)).collect()]
    assert not set(got) ^ set(want) and len(got) == len(want)
