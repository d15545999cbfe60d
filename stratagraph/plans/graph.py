"""Identity, histogram, lookup and traversal queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup, overview, traverse
from ..lineage import stored
from ..schemas import IMPACT_EDGES
from ..sources import bridge

QUERIES, ORACLES = {}, {}
PREFIX = "WITH RECURSIVE " + bridge.SQL
SYMBOLS = "('Function','Method','Class','Variable','Module','TestCase')"


def query(sql: str | None, plain: bool = False):
    """Registers a function (spark, sf_dir) with its SQL over the bridge's relations."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql if plain else f"{PREFIX}\n{sql}"
        return function

    return add


def _graph(spark, sf_dir):
    return bridge.nodes(spark, sf_dir), bridge.edges(spark, sf_dir)


_ENDS_ONLY = ("type", "source_node_id", "target_node_id")
_EVIDENCE = (*_ENDS_ONLY, "path", "start_line", "confidence")


def _stored(spark, sf_dir, columns, types=None):
    """Edges that traversals read at each level: joined and hashed once, with the columns and types that are read."""
    rows = bridge.edges(spark, sf_dir).select(*columns)
    rows = rows if types is None else rows.filter(F.col("type").isin(*types))
    return rows if bridge.built(spark, sf_dir, "edges") is not None else stored(rows, "type")


@query("SELECT id, type, name, path FROM nodes")
def node_ids(spark, sf_dir):
    return bridge.nodes(spark, sf_dir).select("id", "type", "name", "path")


@query("SELECT id, type, source_node_id, target_node_id FROM edges")
def edge_ids(spark, sf_dir):
    return bridge.edges(spark, sf_dir).select("id", "type", "source_node_id", "target_node_id")


@query('SELECT type, count(*)::BIGINT AS "count" FROM nodes GROUP BY type')
def node_counts_by_type(spark, sf_dir):
    return overview.counts_by_type(bridge.nodes(spark, sf_dir))


@query('SELECT type, count(*)::BIGINT AS "count" FROM edges GROUP BY type')
def edge_counts_by_type(spark, sf_dir):
    return overview.counts_by_type(bridge.edges(spark, sf_dir))


@query("SELECT coalesce(language,'unknown') AS language, count(*)::BIGINT AS files FROM files WHERE status='active' GROUP BY 1")
def language_histogram(spark, sf_dir):
    return overview.language_histogram(bridge.files(spark, sf_dir))


@query("SELECT count(*)::BIGINT AS files FROM files WHERE status='active'")
def file_count(spark, sf_dir):
    return bridge.files(spark, sf_dir).filter("status = 'active'").agg(F.count("*").alias("files"))


@query("SELECT type, name, path, start_line FROM nodes WHERE type IN ('ConfigFile','ConfigKey','EnvVar') ORDER BY path, start_line NULLS FIRST, name, id LIMIT 50")
def overview_config(spark, sf_dir):
    return overview.listing(bridge.nodes(spark, sf_dir), ("ConfigFile", "ConfigKey", "EnvVar"))


_RANK = "CASE type WHEN 'Function' THEN 0 WHEN 'Method' THEN 1 WHEN 'Class' THEN 2 WHEN 'Variable' THEN 3 WHEN 'Module' THEN 4 ELSE 5 END"
_FIND = "SELECT id, name, qualified_name, type, path, start_line, end_line, language FROM nodes WHERE type IN " + SYMBOLS


@query(f"{_FIND} AND (lower(name)='order_7' OR lower(qualified_name)='order_7') ORDER BY {_RANK}, name, path, start_line NULLS FIRST, id LIMIT 20")
def find_symbol_exact(spark, sf_dir):
    return lookup.find_symbol(bridge.nodes(spark, sf_dir), "Order_7", exact=True)


@query(f"{_FIND} AND (contains(lower(name),'_9') OR contains(lower(qualified_name),'_9')) ORDER BY CASE WHEN lower(name)='_9' OR lower(qualified_name)='_9' THEN 0 ELSE 1 END, {_RANK}, name, path, start_line NULLS FIRST, id LIMIT 20")
def find_symbol_substring(spark, sf_dir):
    return lookup.find_symbol(bridge.nodes(spark, sf_dir), "_9")


def _files(spark, sf_dir):
    return bridge.customers(spark, sf_dir).select(F.col("c_path").alias("path"), F.lit("active").alias("status"))


def _asked(spark, sf_dir):
    """Full paths, bare names, upper-case tails, unknown and ambiguous ones, by customer."""
    c = bridge.customers(spark, sf_dir)
    kind = F.col("c_custkey") % 5
    tail = F.element_at(F.split("c_path", "/"), -1)
    value = F.when(kind == 0, F.concat(F.lit("./"), "c_path")).when(kind == 1, tail).when(kind == 2, F.upper(F.substring_index("c_path", "/", -2))).when(kind == 3, F.concat(F.lit("no/"), tail)).otherwise(F.concat(F.replace("c_path", F.lit("/"), F.lit("\\")), F.lit("/")))
    return c.select(value.alias("value"))


_ASKED = r"""asked AS (SELECT DISTINCT CASE c_custkey%5 WHEN 0 THEN './'||c_path WHEN 1 THEN regexp_extract(c_path,'[^/]+$') WHEN 2 THEN upper(regexp_extract(c_path,'[^/]+/[^/]+$')) WHEN 3 THEN 'no/'||regexp_extract(c_path,'[^/]+$') ELSE replace(c_path,'/','\')||'/' END AS value FROM cu),
cleaned AS (SELECT value, rtrim(regexp_replace(replace(value,'\','/'),'^(\./)+',''),'/') AS clean FROM asked)"""


@query(f""", {_ASKED},
m AS (SELECT value, clean, f.c_path AS exact, (SELECT count(*) FROM cu t WHERE lower(t.c_path)=lower(clean) OR lower(t.c_path) LIKE '%/'||lower(clean)) AS n,
  (SELECT min(c_path) FROM cu t WHERE lower(t.c_path)=lower(clean) OR lower(t.c_path) LIKE '%/'||lower(clean)) AS only_path FROM cleaned LEFT JOIN cu f ON f.c_path=clean)
SELECT value, coalesce(exact, CASE WHEN n=1 THEN only_path END) AS path, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN n=1 THEN 'suffix' WHEN n>1 THEN 'ambiguous' ELSE 'unresolved' END AS how FROM m""")
def resolve_path_suffix(spark, sf_dir):
    return lookup.resolve_paths(_asked(spark, sf_dir), _files(spark, sf_dir))


@query(f""", w AS (SELECT DISTINCT p_name AS value FROM part UNION SELECT f_name FROM fn UNION SELECT p_qname FROM cl),
k AS (SELECT DISTINCT id, value FROM (SELECT id, name AS value FROM nodes WHERE type IN {SYMBOLS} UNION ALL SELECT id, qualified_name FROM nodes WHERE type IN {SYMBOLS})),
g AS (SELECT value, count(DISTINCT id) AS n, min(id) AS one FROM k JOIN w USING (value) GROUP BY value)
SELECT value, CASE WHEN n=1 THEN 'resolved' WHEN n>1 THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN n=1 THEN 'unique-symbol' WHEN n>1 THEN 'several-symbols' ELSE 'none' END AS provenance,
  coalesce(n,0)::BIGINT AS candidates, CASE WHEN n=1 THEN one END AS node_id FROM w LEFT JOIN g USING (value)""")
def resolve_reference_unique(spark, sf_dir):
    wanted = bridge.classes(spark, sf_dir).select(F.explode(F.array("p_name", "p_qname")).alias("value")).unionByName(bridge.functions(spark, sf_dir).select(F.col("f_name").alias("value")))
    return lookup.resolve_references(wanted, bridge.nodes(spark, sf_dir), _files(spark, sf_dir))


_ENDS = "edges e JOIN nodes s ON s.id=e.source_node_id JOIN nodes t ON t.id=e.target_node_id"


@query(f""", v AS (SELECT id FROM nodes WHERE type='EnvVar' AND lower(name)='supplier#000000003' ORDER BY id LIMIT 1),
w AS (SELECT CASE e.type WHEN 'SETS_ENV' THEN 'definition' ELSE 'usage' END AS role, e.type AS relation, s.name, s.type, s.path, s.start_line FROM edges e JOIN v ON e.target_node_id=v.id JOIN nodes s ON s.id=e.source_node_id WHERE e.type IN ('SETS_ENV','READS_ENV'))
SELECT * FROM w UNION ALL SELECT 'definition','DECLARES_CONFIG',name,type,path,start_line FROM nodes k WHERE type='ConfigKey' AND (lower(name)='supplier#000000003' OR lower(qualified_name)='supplier#000000003' OR lower(qualified_name) LIKE '%.supplier#000000003')
  AND NOT EXISTS (SELECT 1 FROM w WHERE role='definition' AND w.name=k.name AND w.path=k.path AND w.start_line IS NOT DISTINCT FROM k.start_line)""")
def trace_config_env(spark, sf_dir):
    return lookup.trace_config(*_graph(spark, sf_dir), "Supplier#000000003")


@query("""SELECT 'definition' AS role, 'DECLARES_CONFIG' AS relation, name, type, path, start_line FROM nodes WHERE type='ConfigKey' AND (lower(name)='3' OR lower(qualified_name)='3' OR lower(qualified_name) LIKE '%.3')""")
def trace_config_key(spark, sf_dir):
    return lookup.trace_config(*_graph(spark, sf_dir), "3")


#: A file that calls and is called: the one of the fifth order.
_PATH = "(SELECT c_path FROM fn WHERE o_orderkey=5)"


def _path(spark, sf_dir):
    """One row by key, as a user would give the path."""
    return bridge.functions(spark, sf_dir).filter("o_orderkey = 5").select("c_path").first()["c_path"]


@query(f"SELECT s.name AS caller, t.name AS callee, t.path AS callee_path, e.start_line AS line, e.confidence FROM {_ENDS} WHERE e.type='CALLS' AND e.path={_PATH} ORDER BY e.start_line NULLS FIRST, s.name, t.name, e.id LIMIT 15")
def calls_out(spark, sf_dir):
    return lookup.calls_out(*_graph(spark, sf_dir), _path(spark, sf_dir))


@query(f"SELECT s.name AS caller, s.path AS caller_path, t.name AS callee, e.start_line AS line, e.confidence FROM {_ENDS} WHERE e.type='CALLS' AND t.path={_PATH} AND e.path<>{_PATH} AND t.type IN ('Function','Method','TestCase') ORDER BY s.path, e.start_line NULLS FIRST, s.name, t.name, e.id LIMIT 15")
def called_by(spark, sf_dir):
    return lookup.called_by(*_graph(spark, sf_dir), _path(spark, sf_dir))


@query(f"SELECT s.name AS caller, t.name AS callee, t.path AS callee_path, e.start_line AS line, e.confidence FROM {_ENDS} WHERE e.type='INSTANTIATES' AND e.path={_PATH} ORDER BY e.start_line NULLS FIRST, s.name, t.name, e.id LIMIT 15")
def instantiates_out(spark, sf_dir):
    return lookup.calls_out(*_graph(spark, sf_dir), _path(spark, sf_dir), "INSTANTIATES")


@query(f"SELECT s.name AS caller, s.path AS caller_path, t.name AS callee, e.start_line AS line, e.confidence FROM {_ENDS} WHERE e.type='INSTANTIATES' AND t.path='lib/brand_13.py' AND e.path<>'lib/brand_13.py' AND t.type='Class' ORDER BY s.path, e.start_line NULLS FIRST, s.name, t.name, e.id LIMIT 15")
def instantiated_by(spark, sf_dir):
    return lookup.called_by(*_graph(spark, sf_dir), "lib/brand_13.py", "INSTANTIATES")


@query(f"""SELECT qualified_name, m.name AS name, m.path AS path FROM (SELECT t.qualified_name, min(struct_pack(line := e.start_line, name := t.name, path := t.path)) AS m FROM {_ENDS} WHERE e.type='IMPORTS' AND s.path={_PATH} AND s.type='Module' GROUP BY t.qualified_name)""")
def imports_of(spark, sf_dir):
    return lookup.imports_of(*_graph(spark, sf_dir), _path(spark, sf_dir))


@query(f"SELECT DISTINCT s.path, s.name FROM {_ENDS} WHERE e.type='IMPORTS' AND t.path={_PATH} AND t.type='Module'")
def imported_by(spark, sf_dir):
    return lookup.imported_by(*_graph(spark, sf_dir), _path(spark, sf_dir))


@query(f"SELECT DISTINCT t.name, e.start_line AS line FROM {_ENDS} WHERE e.type='READS_ENV' AND e.path='lib/brand_13.py'")
def env_reads(spark, sf_dir):
    return lookup.env_reads(*_graph(spark, sf_dir), "lib/brand_13.py")


@query(f"""SELECT id, name, type, path, start_line, (SELECT source_node_id FROM edges e WHERE e.target_node_id=n.id AND e.type IN ('DEFINES','CONTAINS') ORDER BY coalesce(start_line,-1) DESC, e.id DESC LIMIT 1) AS parent_id FROM nodes n WHERE type IN {SYMBOLS}""")
def symbol_tree_parent(spark, sf_dir):
    return lookup.symbol_parents(*_graph(spark, sf_dir))


@query(f""", i AS (SELECT DISTINCT tf.path FROM {_ENDS} JOIN nodes tf ON tf.type='TestFile' AND tf.path=s.path WHERE e.type='IMPORTS' AND s.type='Module' AND t.type='Module' AND t.path={_PATH}),
c AS (SELECT path, regexp_replace(regexp_replace(lower(name),'\\.[^.]*$',''),'^test_','') AS core FROM nodes WHERE type='TestFile'),
p AS (SELECT regexp_replace(regexp_extract({_PATH},'[^/]+$'),'\\.[^.]*$','') AS stem)
SELECT path, 'imports this module' AS via FROM i UNION ALL SELECT DISTINCT c.path, 'name match' FROM c, p WHERE c.path<>{_PATH} AND (contains(stem,core) OR contains(core,stem)) AND c.path NOT IN (SELECT path FROM i)""")
def related_tests(spark, sf_dir):
    return lookup.related_tests(*_graph(spark, sf_dir), _path(spark, sf_dir))


@query(f"SELECT DISTINCT s.path, s.name, s.type FROM {_ENDS} WHERE e.type='MENTIONS' AND t.path='lib/brand_13.py'")
def doc_mentions(spark, sf_dir):
    return lookup.doc_mentions(*_graph(spark, sf_dir), "lib/brand_13.py")


@query("""SELECT type, count(*)::BIGINT AS "count" FROM nodes WHERE path='lib/brand_13.py' GROUP BY type""")
def file_node_counts(spark, sf_dir):
    return lookup.explain_file(*_graph(spark, sf_dir), "lib/brand_13.py")["node_counts"]


@query(f"SELECT s.path AS doc_path, s.name AS doc_name, e.start_line AS line, t.name AS target, e.confidence, json_extract_string(e.metadata,'$.raw_value') AS raw_value FROM {_ENDS} WHERE e.type='MENTIONS' AND t.path='lib/brand_13.py' ORDER BY e.confidence DESC, s.path, e.start_line NULLS FIRST, t.type, t.name, e.id LIMIT 50")
def docs_for_code(spark, sf_dir):
    return lookup.docs_for_code(*_graph(spark, sf_dir), F.col("t_path") == "lib/brand_13.py")


@query(f"SELECT t.name AS target, t.type AS target_type, t.path AS target_path, e.start_line AS line, e.confidence FROM {_ENDS} WHERE e.type='MENTIONS' AND s.path=(SELECT d_path FROM df WHERE doc_id=7) ORDER BY e.confidence DESC, t.path, t.start_line NULLS FIRST, t.name, e.id LIMIT 50")
def code_for_docs(spark, sf_dir):
    path = bridge.doc_files(spark, sf_dir).filter("doc_id = 7").select("d_path").first()["d_path"]
    return lookup.code_for_docs(*_graph(spark, sf_dir), path)


_REACH = """, start AS (SELECT id FROM nodes WHERE lower(name)='order_7' OR lower(qualified_name)='order_7' OR path='order_7' ORDER BY path, start_line NULLS FIRST, id LIMIT 20),
adj AS ({adj}),
r(id, level) AS (SELECT id, 0 FROM start UNION SELECT adj.dst, r.level+1 FROM r JOIN adj ON adj.src=r.id WHERE r.level<{depth})
SELECT n.id, n.type, n.name, n.path, min(r.level)::INT AS level FROM r JOIN nodes n ON n.id=r.id GROUP BY 1,2,3,4"""
_OUT = "SELECT DISTINCT source_node_id AS src, target_node_id AS dst FROM edges WHERE type<>'CO_CHANGED_WITH'"
_IN = "SELECT DISTINCT target_node_id AS src, source_node_id AS dst FROM edges WHERE type<>'CO_CHANGED_WITH'"


def _trace(spark, sf_dir, depth, direction):
    return traverse.trace_nodes(bridge.nodes(spark, sf_dir), _stored(spark, sf_dir, _ENDS_ONLY), "order_7", depth, direction).select("id", "type", "name", "path", "level")


@query(_REACH.format(adj=_OUT, depth=2))
def trace_symbol_out(spark, sf_dir):
    return _trace(spark, sf_dir, 2, "out")


@query(_REACH.format(adj=_IN, depth=2))
def trace_symbol_in(spark, sf_dir):
    return _trace(spark, sf_dir, 2, "in")


@query(_REACH.format(adj=f"{_OUT} UNION {_IN}", depth=1))
def trace_symbol_both(spark, sf_dir):
    return _trace(spark, sf_dir, 1, "both")


@query(""", start AS (SELECT id FROM nodes WHERE lower(name)='order_7')
SELECT id, type, source_node_id, target_node_id FROM edges WHERE type<>'CO_CHANGED_WITH' AND (source_node_id IN (SELECT id FROM start) OR target_node_id IN (SELECT id FROM start))""")
def trace_symbol_edges(spark, sf_dir):
    """Every node of the name is a start. Edges are read once, so that they needn't be stored."""
    edges = bridge.edges(spark, sf_dir).select("id", *_ENDS_ONLY)
    return traverse.trace_edges(bridge.nodes(spark, sf_dir), edges, "order_7", 1, "both", limit=None)


_T12 = "('IMPORTS','CALLS','INSTANTIATES','MENTIONS','TESTS','COVERS','READS_ENV','USES_CONFIG','DEPENDS_ON','HANDLES_ROUTE','READS_TABLE','WRITES_TABLE')"


def _impact_sql(starts: str, depth: int, tail: str) -> str:
    """Level by level, as a recursive query can't keep what was seen by root: levels are least path lengths."""
    return f""", st AS ({starts}),
back AS (SELECT target_node_id AS src, source_node_id AS dst, type, path, coalesce(start_line,-1) AS line, confidence FROM edges WHERE type IN {_T12}),
r(root, id, level) AS (SELECT root, id, 0 FROM st UNION SELECT r.root, b.dst, r.level+1 FROM r JOIN back b ON b.src=r.id WHERE r.level<{depth}),
lv AS (SELECT root, id, min(level) AS level FROM r GROUP BY root, id),
ev AS (SELECT b.root, b.id, b.level-1 AS level, min(struct_pack(c := -e.confidence, t := e.type, p := e.path, l := e.line)) AS m FROM lv b JOIN back e ON e.dst=b.id JOIN lv a ON a.root=b.root AND a.id=e.src AND a.level=b.level-1 WHERE b.level>0 GROUP BY 1,2,3),
found AS (SELECT root, id, level::INT AS level, m.t AS via, m.p AS evidence_path, CASE WHEN m.l>=0 THEN m.l END AS evidence_line, round(-m.c*pow(0.85,level),3) AS confidence FROM ev),
hit AS (SELECT *, CASE WHEN confidence>=0.85 THEN 'high' WHEN confidence>=0.6 THEN 'medium' ELSE 'low' END AS bucket FROM found)
{tail}"""


@query(_impact_sql("SELECT 'x' AS root, s_id AS id FROM ev0 WHERE s_suppkey=2", 3, "SELECT id, level, via, evidence_path, evidence_line, confidence, bucket FROM hit").replace("ev0", "(SELECT s_suppkey, sha1('EnvVar'||chr(0)||s_name||chr(0)) AS s_id FROM supplier)").replace("ev AS (SELECT b.root", "evi AS (SELECT b.root").replace("FROM ev)", "FROM evi)"))
def impact_depth3(spark, sf_dir):
    starts = bridge.env_vars(spark, sf_dir).filter("s_suppkey = 2").select(F.lit("x").alias("root"), F.col("s_id").alias("id"))
    return traverse.impact(starts, _stored(spark, sf_dir, _EVIDENCE), 3).drop("root")


def _part_starts(spark, sf_dir):
    """Every class is a root."""
    return bridge.classes(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("root"), F.col("p_id").alias("id"))


_PARTS = "SELECT p_partkey::VARCHAR AS root, p_id AS id FROM cl"


def _renamed(sql: str) -> str:
    return sql.replace("ev AS (SELECT b.root", "evi AS (SELECT b.root").replace("FROM ev)", "FROM evi)")


@query(_renamed(_impact_sql(_PARTS, 2, "SELECT root, bucket, count(*)::BIGINT AS nodes, count(DISTINCT via)::BIGINT AS kinds FROM hit GROUP BY root, bucket")))
def impact_buckets(spark, sf_dir):
    found = traverse.impact(_part_starts(spark, sf_dir), _stored(spark, sf_dir, _EVIDENCE, IMPACT_EDGES), 2)
    return found.groupBy("root", "bucket").agg(F.count("*").alias("nodes"), F.countDistinct("via").alias("kinds"))


@query(_renamed(_impact_sql(_PARTS, 2, """, byn AS (SELECT id, max(confidence) AS confidence, count(DISTINCT (via, evidence_path, evidence_line))::BIGINT AS evidence, count(DISTINCT root)::BIGINT AS roots FROM hit GROUP BY id)
SELECT *, CASE WHEN confidence>=0.85 THEN 'high' WHEN confidence>=0.6 THEN 'medium' ELSE 'low' END AS bucket FROM byn""")))
def multi_source_impact(spark, sf_dir):
    return traverse.merged_impact(traverse.impact(_part_starts(spark, sf_dir), _stored(spark, sf_dir, _EVIDENCE, IMPACT_EDGES), 2))


@query(""", st AS (SELECT f_id AS id FROM fn WHERE o_orderkey=5),
paid AS (SELECT DISTINCT source_node_id AS src, target_node_id AS dst FROM edges WHERE type IN ('HANDLES_ROUTE','EXPOSES_ENDPOINT','CALLS','INSTANTIATES','IMPORTS','READS','WRITES','READS_ENV','USES_CONFIG','PUBLISHES_EVENT','CONSUMES_EVENT','READS_TABLE','WRITES_TABLE','DEPENDS_ON')),
free AS (SELECT source_node_id AS src, target_node_id AS dst FROM edges WHERE type IN ('DEFINES','CONTAINS') UNION SELECT target_node_id, source_node_id FROM edges WHERE type IN ('DEFINES','CONTAINS')),
adj AS (SELECT src, dst, 1 AS c FROM paid UNION ALL SELECT src, dst, 0 FROM free),
r(id, cost) AS (SELECT id, 0 FROM st UNION SELECT a.dst, r.cost+a.c FROM r JOIN adj a ON a.src=r.id WHERE r.cost+a.c<=2)
SELECT id, min(cost)::INT AS cost FROM r GROUP BY id""")
def data_flow_01bfs(spark, sf_dir):
    starts = bridge.functions(spark, sf_dir).filter("o_orderkey = 5").select(F.col("f_id").alias("id"))
    return traverse.data_flow(starts, _stored(spark, sf_dir, _ENDS_ONLY), 2, "out")


@query(""", d AS (SELECT id, count(*) AS degree FROM (SELECT source_node_id AS id FROM edges WHERE type NOT IN ('DEFINES','CONTAINS') UNION ALL SELECT target_node_id FROM edges WHERE type NOT IN ('DEFINES','CONTAINS') AND source_node_id<>target_node_id) GROUP BY id)
SELECT qualified_name AS text, type, path AS location, start_line AS line, coalesce(degree,0)::BIGINT AS degree FROM nodes n LEFT JOIN d USING (id) WHERE type IN ('Directory','Module') AND NOT EXISTS (SELECT 1 FROM nodes t WHERE t.type='TestFile' AND t.path=n.path)
ORDER BY coalesce(degree,0) DESC, length(path), path, start_line NULLS LAST, name, id LIMIT 12""")
def degree_rank(spark, sf_dir):
    return overview.promoted(*_graph(spark, sf_dir), ("Directory", "Module"), 12, by_degree=True, withhold=overview.UNREPRESENTATIVE + overview.DOCUMENTATION)


@query("""SELECT coalesce(qualified_name,name) AS text, type, coalesce(nullif(path,''),json_extract_string(metadata,'$.observation.path')) AS location, CASE WHEN path='' THEN json_extract_string(metadata,'$.observation.line')::INT ELSE start_line END AS line
FROM nodes WHERE type IN ('EnvVar','ConfigFile','ConfigKey') ORDER BY CASE type WHEN 'EnvVar' THEN 0 WHEN 'ConfigFile' THEN 1 ELSE 2 END, length(coalesce(nullif(path,''),json_extract_string(metadata,'$.observation.path'))), coalesce(nullif(path,''),json_extract_string(metadata,'$.observation.path')), start_line NULLS LAST, name, id LIMIT 12""")
def config_rank(spark, sf_dir):
    return overview.promoted(*_graph(spark, sf_dir), ("EnvVar", "ConfigFile", "ConfigKey"), 12, by_type=True, withhold=overview.UNREPRESENTATIVE + overview.DOCUMENTATION)
