"""Every registered query outside the pipeline subpackage against its SQL, on the smallest tables."""

import math
import os

import pytest

from stratagraph.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NULL"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    names = sorted(found.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in found.collect())
    result = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    want = sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in result.fetchall())
    assert got == want


def test_everything_imports_without_the_subpackage(tmp_path):
    """The entry works where the pipeline's folder and module are gone, and where only their remains are left."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top / "stratagraph", tmp_path / "stratagraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    (tmp_path / "stratagraph" / "llm" / "__pycache__").mkdir(parents=True)
    said = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.splitlines()
    assert out[0].split() == sorted(registry.QUERIES) and out[1].split() == sorted(registry.ORACLES)


@pytest.mark.parametrize("name", ["co_change_pairs", "impact_buckets", "degree_rank"])
def test_plans_have_no_nested_loops(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
