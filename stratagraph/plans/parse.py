"""Parser queries with their SQL: source files are written from the orders table, one a customer, and parsed on executors.

A file has one definition a line for each order of its customer, so that SQL knows names and lines from the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import budget, context, resolve
from ..operators.parse import parse_files, relations
from ..sources import bridge

QUERIES, ORACLES = {}, {}
PREFIX = "WITH " + bridge.SQL

#: By query: file name's ending, lines before, a line (with the order's key for @), lines after, types, and whether lines read a variable.
SOURCES = {
    "parse_python": (".py", "import os\n", "def f_@(): return os.getenv('V_@')", "", ("Function",), True),
    "parse_javascript": (".js", "", "function f_@() { return process.env.V_@; }", "", ("Function",), True),
    "parse_typescript": (".ts", "", "function f_@(): string { return process.env.V_@; }", "", ("Function",), True),
    "parse_php": (".php", "<?php\n", "function f_@() { return getenv('V_@'); }", "", ("Function",), True),
    "parse_bash": (".sh", "#!/bin/bash\n", "f_@() { echo done; }", "", ("Function",), False),
    "parse_go": (".go", "package main\n", "func f_@() { }", "", ("Function",), False),
    "parse_java": (".java", "package p.q;\nclass Main {\n", '  static String f_@() { return System.getenv("V_@"); }', "\n}", ("Method",), True),
    "parse_ruby": (".rb", "", "def f_@; ENV['V_@']; end", "", ("Function",), True),
    "parse_json": (".json", "{\n", '"f_@": 1,', '\n"last": 2}', ("ConfigKey",), False),
    "parse_toml": (".toml", "", "f_@ = 1", "", ("ConfigKey",), False),
    "parse_yaml": (".yaml", "", "f_@: 1", "", ("ConfigKey",), False),
    "parse_dotenv": (".env", "", "V_@=1", "", ("ConfigKey",), True),
    "parse_dockerfile": (".dockerfile", "FROM base\n", "RUN f_@", "", ("ConfigKey",), False),
    "parse_markdown": (".md", "", "# f_@", "", ("MarkdownSection",), False),
}


def _files(spark, sf_dir, ending: str, head: str, line: str, tail: str) -> DataFrame:
    orders = bridge.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    first, *rest = line.split("@")

    def written(key):
        return F.concat(F.lit(first), *[x for part in rest for x in (key.cast("string"), F.lit(part))])

    return orders.select(F.concat(F.lit("gen/c"), "o_custkey", F.lit(ending)).alias("path"), F.concat(F.lit(head), F.array_join(F.transform("keys", written), "\n"), F.lit(tail)).alias("content"))


def _facts(nodes: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """path, type, name, line: definitions, and variables where they are read or set."""
    seen = F.from_json("metadata", "struct<observation:struct<path:string,line:int>>")["observation"]
    variable = F.col("type") == "EnvVar"
    return nodes.filter(F.col("type").isin(*types, "EnvVar")).select(F.when(variable, seen["path"]).otherwise(F.col("path")).alias("path"), "type", "name", F.when(variable, seen["line"]).otherwise(F.col("start_line")).alias("line"))


def _parsing(name: str) -> None:
    ending, head, line, tail, types, env = SOURCES[name]

    def query(spark, sf_dir):
        return _facts(relations(parse_files(_files(spark, sf_dir, ending, head, line, tail)))["nodes"], types)

    at = f"(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + {head.count(chr(10))})::INT AS line"
    path = f"'gen/c'||o_custkey||'{ending}' AS path"
    own = "'RUN'" if name == "parse_dockerfile" else "'V_'||o_orderkey" if name == "parse_dotenv" else "'f_'||o_orderkey"
    sql = f" SELECT {path}, '{types[0]}' AS type, {own} AS name, {at} FROM orders"
    if env:
        sql += f" UNION ALL SELECT {path}, 'EnvVar', 'V_'||o_orderkey, {at} FROM orders"
    if name == "parse_json":
        sql += f" UNION ALL SELECT 'gen/c'||o_custkey||'{ending}', 'ConfigKey', 'last', (count(*) + 2)::INT FROM orders GROUP BY o_custkey"
    if name == "parse_dockerfile":
        sql += f" UNION ALL SELECT DISTINCT 'gen/c'||o_custkey||'{ending}', 'ConfigKey', 'FROM', 1 FROM orders"
    query.__name__ = name
    query.__doc__ = f"Definitions in files like {line!r}."
    QUERIES[name], ORACLES[name] = query, PREFIX + sql


for _name in SOURCES:
    _parsing(_name)


def query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = f"{PREFIX}{sql}"
        return function

    return add


def _packages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Modules: Java files by customer in a package of their nation, Go files in a folder of it. Imports: each of the next customer's."""
    c = bridge.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    java = c.select(F.concat(F.lit("src/n"), "c_nationkey", F.lit("/C"), "c_custkey", F.lit(".java")).alias("path"), F.concat(F.lit("C"), "c_custkey").alias("name"), F.lit("java").alias("language"), F.concat(F.lit("n"), "c_nationkey").alias("package"), "c_custkey", "c_nationkey")
    go = c.select(F.concat(F.lit("g"), "c_nationkey", F.lit("/c"), "c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.lit("_test.go")).otherwise(F.lit(".go"))).alias("path"), F.concat(F.lit("c"), "c_custkey").alias("name"), F.lit("go").alias("language"), F.lit(None).cast("string").alias("package"), "c_custkey", "c_nationkey")
    modules = java.unionByName(go).withColumn("id", F.sha1(F.col("path").cast("binary")))
    far = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_custkey").alias("next"), F.col("c_nationkey").alias("there"))
    asked = modules.filter("language = 'java'").join(far, "c_custkey").select("path", F.when(F.col("c_custkey") % 2 == 0, "class").otherwise("static").alias("kind"), F.concat(F.lit("n"), "there", F.lit(".C"), "next", F.when(F.col("c_custkey") % 2 == 0, F.lit("")).otherwise(F.lit(".make"))).alias("spec"), F.lit(3).alias("line"))
    # Go files of the tenth of customers import a package, of which there are many files
    packages = modules.filter("language = 'go' and c_custkey % 10 = 0").select("path", F.lit("go").alias("kind"), F.concat(F.lit("ex.org/m/g"), F.pmod(F.col("c_nationkey") + 1, F.lit(25))).alias("spec"), F.lit(4).alias("line"))
    return modules, asked.unionByName(packages)


@query(""", c AS (SELECT c_custkey, c_nationkey FROM customer),
g AS (SELECT 'g'||c_nationkey||'/c'||c_custkey||CASE WHEN c_custkey%7=0 THEN '_test.go' ELSE '.go' END AS path, * FROM c)
SELECT 'src/n'||a.c_nationkey||'/C'||a.c_custkey||'.java' AS path, CASE WHEN a.c_custkey%2=0 THEN 'class' ELSE 'static' END AS kind, 3 AS line, 'src/n'||b.c_nationkey||'/C'||b.c_custkey||'.java' AS target_path FROM c a JOIN c b ON b.c_custkey=a.c_custkey+1
UNION ALL SELECT a.path, 'go', 4, b.path FROM g a JOIN g b ON b.c_nationkey=(a.c_nationkey+1)%25 AND b.path NOT LIKE '%\\_test.go' ESCAPE '\\' WHERE a.c_custkey%10=0""".replace("\\\\", "\\"))
def package_imports(spark, sf_dir):
    modules, asked = _packages(spark, sf_dir)
    return resolve.package_targets(asked, modules, "ex.org/m").select("path", "kind", "line", "target_path")


@query(""" SELECT f.f_id AS source_node_id, p_id AS target_node_id, 'INSTANTIATES' AS type, f.c_path AS path, f_line AS start_line FROM fn f JOIN cl ON p_partkey=f.o_orderkey%200+1""")
def binding_calls(spark, sf_dir):
    """Functions call local names that their files' imports bind to classes."""
    f = bridge.functions(spark, sf_dir).withColumn("part", F.col("o_orderkey") % 200 + 1)
    pending = f.select(F.col("f_id").alias("caller_id"), F.col("c_path").alias("path"), F.concat(F.lit("L"), "part").alias("name"), F.col("f_line").alias("line"))
    p = bridge.classes(spark, sf_dir)
    bindings = f.select("c_path", "part").distinct().join(p, F.col("part") == F.col("p_partkey")).select(F.col("c_path").alias("path"), F.concat(F.lit("L"), "part").alias("local"), F.concat("p_path", F.lit("#"), "part").alias("target_path"), F.col("p_name").alias("symbol"))
    nodes = p.select(F.col("p_id").alias("id"), F.lit("Class").alias("type"), F.concat("p_path", F.lit("#"), "p_partkey").alias("path"), F.col("p_name").alias("name"))
    return resolve.binding_calls(pending, bindings, nodes).select("source_node_id", "target_node_id", "type", "path", "start_line")


@query(""", r AS (SELECT c_custkey, 'src/'||r||'/'||n||'/c'||c_custkey||'.py' AS now FROM customer JOIN pl ON c_nationkey=n_nationkey WHERE c_custkey%3=0),
d AS (SELECT d_path, doc_id%1000+1 AS k, (doc_id%40+1)::INT AS line, d_id FROM df)
SELECT d_path AS doc_path, line, 'old/'||now AS path, CASE WHEN line<=20 THEN 's'||d_id ELSE d_id END AS section FROM d JOIN r ON k=c_custkey""")
def old_path_docs(spark, sf_dir):
    """Documents refer to customers' files by a path they had before; every third was renamed. A section holds the first 20 lines."""
    c = bridge.customers(spark, sf_dir).select("c_custkey", F.concat(F.lit("old/"), "c_path").alias("value"))
    d = bridge.doc_files(spark, sf_dir)
    references = d.select(F.col("d_id").alias("doc_id"), F.col("d_path").alias("doc_path"), (F.col("doc_id") % 1000 + 1).alias("c_custkey"), (F.col("doc_id") % 40 + 1).cast("int").alias("line")).join(c, "c_custkey").select("doc_id", "doc_path", "value", "line")
    sections = d.select(F.col("d_path").alias("doc_path"), F.concat(F.lit("s"), "d_id").alias("section_id"), F.lit(1).alias("start_line"), F.lit(20).alias("end_line"))
    return context.historical_path_docs(references, c.filter("c_custkey % 3 = 0").select(F.col("value").alias("path")), sections)


@query(""", s AS (SELECT conv_id, turn, turn%4 AS step, sum(length(coalesce(text,''))) OVER (PARTITION BY conv_id ORDER BY turn%4 DESC, turn ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM conversations) SELECT conv_id, turn, step::INT AS step, used FROM s WHERE used<=4*150""")
def budget_ladder_rungs(spark, sf_dir):
    rows = bridge.table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 4).cast("int").alias("step"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"))
    return budget.rungs(rows, ["conv_id"], [F.col("turn")], "step", "size", 150).drop("size")


@query(""" SELECT 'note'||o_orderkey AS source_node_id, f_id AS target_node_id FROM fn WHERE o_orderkey%2=0""")
def may_impact_existing(spark, sf_dir):
    """Notes link what changed where it exists: every second order's function does."""
    from ..operators.ingest import connected_edges

    f = bridge.functions(spark, sf_dir)
    edges = f.select(F.concat(F.lit("note"), "o_orderkey").alias("source_node_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("f_id")).otherwise(F.concat("f_id", F.lit("x"))).alias("target_node_id"))
    return connected_edges(edges, f.select(F.col("f_id").alias("id")).unionByName(edges.select(F.col("source_node_id").alias("id"))))
