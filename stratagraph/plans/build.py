"""Build, resolution, interval, memory, parsing and quality queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budget, ingest, intervals, memory, overview, resolve
from ..sources import bridge

QUERIES, ORACLES = {}, {}
PREFIX = "WITH " + bridge.SQL


def query(sql: str | None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = f"{PREFIX}{sql}"
        return function

    return add


# resolution


def _pending(spark, sf_dir):
    """Calls by bare name: each order calls the name of a part and of another order."""
    f = bridge.functions(spark, sf_dir)
    names = F.array(F.concat(F.lit("order_"), (F.col("o_orderkey") * 3) % 997), F.concat(F.lit("order_"), F.col("o_orderkey") % 1500))
    rows = f.select(F.col("f_id").alias("caller_id"), F.col("c_path").alias("path"), F.explode(names).alias("name"), F.col("f_line").alias("line"))
    p = bridge.classes(spark, sf_dir)
    return rows.unionByName(p.select(F.col("p_id").alias("caller_id"), F.col("p_path").alias("path"), F.col("p_name").alias("name"), F.col("p_size").alias("line")))


_PEND = """, pend AS (SELECT f_id AS caller_id, c_path AS path, unnest(['order_'||(o_orderkey*3%997), 'order_'||(o_orderkey%1500)]) AS name, f_line AS line FROM fn UNION ALL SELECT p_id, p_path, p_name, p_size FROM cl)"""


@query(f"""{_PEND}, fo AS (SELECT name, path, min(id) AS id, count(*) AS n FROM nodes WHERE type IN ('Function','Method') GROUP BY name, path),
co AS (SELECT name, path, min(id) AS id, count(*) AS n FROM nodes WHERE type='Class' GROUP BY name, path),
ask AS (SELECT DISTINCT name, path FROM pend),
fr AS (SELECT a.name, a.path, sum(n) AS n, min(id) AS id FROM ask a JOIN fo ON fo.name=a.name AND fo.path<>a.path GROUP BY 1,2),
cr AS (SELECT a.name, a.path, sum(n) AS n, min(id) AS id FROM ask a JOIN co ON co.name=a.name AND co.path<>a.path GROUP BY 1,2)
SELECT DISTINCT caller_id AS source_node_id, CASE WHEN fr.n=1 THEN fr.id ELSE cr.id END AS target_node_id, CASE WHEN fr.n=1 THEN 'CALLS' ELSE 'INSTANTIATES' END AS type, p.path, line AS start_line, 0.7::DOUBLE AS confidence, true AS is_inferred
FROM pend p LEFT JOIN fr ON fr.name=p.name AND fr.path=p.path LEFT JOIN cr ON cr.name=p.name AND cr.path=p.path WHERE fr.n=1 OR cr.n=1""")
def name_match_calls(spark, sf_dir):
    return resolve.name_match_calls(_pending(spark, sf_dir), bridge.nodes(spark, sf_dir)).drop("id")


@query(""", pend AS (SELECT f_id AS caller_id, c_path AS path, f_line AS line, CASE WHEN o_orderkey%3=0 THEN lead_id ELSE sha1('none'||o_orderkey) END AS function_id, p_id AS class_id FROM (SELECT a.*, b.f_id AS lead_id, cl.p_id FROM fn a LEFT JOIN fn b ON b.o_orderkey=a.o_orderkey+1 LEFT JOIN cl ON p_partkey=a.o_orderkey%300))
SELECT DISTINCT caller_id AS source_node_id, CASE WHEN f.id IS NOT NULL THEN function_id ELSE class_id END AS target_node_id, CASE WHEN f.id IS NOT NULL THEN 'CALLS' ELSE 'INSTANTIATES' END AS type, p.path, p.line AS start_line, 0.9::DOUBLE AS confidence, false AS is_inferred
FROM pend p LEFT JOIN (SELECT id FROM nodes WHERE type IN ('Function','Method')) f ON f.id=function_id LEFT JOIN (SELECT id FROM nodes WHERE type='Class') c ON c.id=class_id WHERE f.id IS NOT NULL OR c.id IS NOT NULL""")
def import_calls_precedence(spark, sf_dir):
    f, p = bridge.functions(spark, sf_dir), bridge.classes(spark, sf_dir)
    after = f.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("f_id").alias("lead_id"))
    rows = f.join(after, "o_orderkey", "left").join(p.select((F.col("p_partkey")).alias("pk"), "p_id"), F.col("o_orderkey") % 300 == F.col("pk"), "left")
    guess = F.when(F.col("o_orderkey") % 3 == 0, F.col("lead_id")).otherwise(F.sha1(F.concat(F.lit("none"), F.col("o_orderkey").cast("string")).cast("binary")))
    pending = rows.select(F.col("f_id").alias("caller_id"), F.col("c_path").alias("path"), F.col("f_line").alias("line"), guess.alias("function_id"), F.col("p_id").alias("class_id"))
    return resolve.import_calls(pending, bridge.nodes(spark, sf_dir))


def _sections(spark, sf_dir):
    """Three nested sections a document: whole, first half, one line in it."""
    d = bridge.doc_files(spark, sf_dir)
    spans = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("start_line"), F.lit(b).alias("end_line")) for n, a, b in (("a", 2, 60), ("b", 2 + 8, 30), ("c", 20, 20))])
    return d.select(F.col("d_path").alias("doc_path"), F.explode(spans).alias("s")).select("doc_path", F.concat("doc_path", F.lit("#"), "s.n").alias("section_id"), "s.start_line", "s.end_line")


def _references(spark, sf_dir):
    """By document: a file, a class by qualified name, a function by bare name and one that is unknown."""
    d = bridge.doc_files(spark, sf_dir)
    c = bridge.customers(spark, sf_dir).select("c_custkey", "c_path")
    p = bridge.classes(spark, sf_dir).select("p_partkey", "p_qname")
    rows = d.join(c, F.col("c_custkey") == F.col("doc_id") % 150 + 1, "left").join(p, F.col("p_partkey") == F.col("doc_id") % 200, "left")
    refs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value"), (F.col("doc_id") * m % 64).cast("int").alias("line")) for k, v, m in (("link", F.col("c_path"), 1), ("inline_code", F.col("p_qname"), 3), ("inline_code", F.concat(F.lit("order_"), F.col("doc_id") % 997), 5), ("inline_code", F.lit("nowhere"), 7))])
    return rows.select(F.col("d_id").alias("doc_id"), F.col("d_path").alias("doc_path"), F.explode(refs).alias("r")).select("doc_id", "doc_path", "r.*").filter("value is not null")


_REFS = """, sect AS (SELECT d_path AS doc_path, d_path||'#'||n AS section_id, a AS start_line, b AS end_line FROM df, (VALUES ('a',2,60),('b',10,30),('c',20,20)) v(n,a,b)),
refs AS (SELECT d_id AS doc_id, d_path AS doc_path, kind, value, line FROM (SELECT d.*, unnest([{'kind':'link','value':c_path,'line':doc_id*1%64},{'kind':'inline_code','value':p_qname,'line':doc_id*3%64},{'kind':'inline_code','value':'order_'||(doc_id%997),'line':doc_id*5%64},{'kind':'inline_code','value':'nowhere','line':doc_id*7%64}], recursive := true)
  FROM df d LEFT JOIN cu ON c_custkey=doc_id%150+1 LEFT JOIN cl ON p_partkey=doc_id%200) WHERE value IS NOT NULL)"""


@query(_REFS + """, fi AS (SELECT path AS value, id FROM nodes WHERE type='File'), sy AS (SELECT * FROM nodes WHERE type IN ('Class','Function','Method')),
q AS (SELECT qualified_name AS value, min(id) AS id FROM sy GROUP BY 1 HAVING count(DISTINCT id)=1), b AS (SELECT name AS value, min(id) AS id FROM sy GROUP BY 1 HAVING count(DISTINCT id)=1),
h AS (SELECT DISTINCT r.doc_id, doc_path, r.value, line, coalesce(fi.id,q.id,b.id) AS target_node_id, CASE WHEN fi.id IS NOT NULL THEN CASE WHEN kind='link' THEN 1.0 ELSE 0.95 END WHEN q.id IS NOT NULL THEN 0.9 ELSE 0.75 END::DOUBLE AS confidence, fi.id IS NULL AND q.id IS NULL AS is_inferred
  FROM refs r LEFT JOIN fi USING (value) LEFT JOIN q USING (value) LEFT JOIN b USING (value) WHERE coalesce(fi.id,q.id,b.id) IS NOT NULL)
SELECT coalesce((SELECT section_id FROM sect s WHERE s.doc_path=h.doc_path AND h.line BETWEEN s.start_line AND s.end_line ORDER BY s.start_line DESC, section_id DESC LIMIT 1), doc_id) AS source_node_id, target_node_id, confidence, is_inferred, value, line::INT AS line FROM h""")
def mention_resolution(spark, sf_dir):
    files = bridge.customers(spark, sf_dir).select(F.col("c_path").alias("path"), F.lit("active").alias("status"))
    return resolve.mentions(_references(spark, sf_dir), files, bridge.nodes(spark, sf_dir), _sections(spark, sf_dir))


@query(_REFS + """ SELECT DISTINCT doc_path, value, line::INT AS line, coalesce((SELECT section_id FROM sect s WHERE s.doc_path=refs.doc_path AND refs.line BETWEEN s.start_line AND s.end_line ORDER BY s.start_line DESC, section_id DESC LIMIT 1), doc_path) AS section FROM refs""")
def innermost_section_asof(spark, sf_dir):
    points = _references(spark, sf_dir).select("doc_path", "value", "line").distinct()
    return intervals.innermost(points, _sections(spark, sf_dir), "doc_path", "line", F.col("doc_path"))


@query(""", ro AS (SELECT p_id AS route_id, p_path AS path, p_size AS start_line, p_size+5 AS end_line FROM cl), ca AS (SELECT id AS call_id, path, start_line AS line FROM edges WHERE type='READS_ENV')
SELECT call_id AS id, (SELECT route_id FROM ro WHERE ro.path=ca.path AND ca.line BETWEEN ro.start_line AND ro.end_line ORDER BY ro.start_line DESC, route_id DESC LIMIT 1) AS route_id FROM ca""")
def inline_span_calls(spark, sf_dir):
    routes = bridge.classes(spark, sf_dir).select(F.col("p_id").alias("route_id"), F.col("p_path").alias("path"), F.col("p_size").alias("start_line"), (F.col("p_size") + 5).alias("end_line"))
    return resolve.inline_handlers(routes, bridge.edges(spark, sf_dir).filter("type = 'READS_ENV'").select("id", "path", "start_line"))


@query(""" SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN n>1 THEN l_returnflag||'@'||n ELSE l_returnflag END AS l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)""")
def occurrence_numbering(spark, sf_dir):
    rows = bridge.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return resolve.numbered(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_returnflag").drop("l_suppkey")


@query(""", ro AS (SELECT p_id AS route_id, p_path AS path, 'order_'||(p_partkey%50) AS handler FROM cl), fl AS (SELECT path, name, min(id) AS id FROM nodes WHERE type IN ('Function','Method') GROUP BY 1,2 HAVING count(DISTINCT id)=1),
im AS (SELECT DISTINCT cl.p_path AS path, 'order_'||(o_orderkey%50) AS local, fn.c_path AS target_path, fn.f_name AS symbol FROM fn JOIN cl ON p_partkey=o_orderkey%2000),
bo AS (SELECT path, local, min(target_path) AS tp, min(symbol) AS sy FROM im GROUP BY 1,2 HAVING count(*)=1)
SELECT route_id, coalesce(l.id, f.id) AS target_node_id FROM ro LEFT JOIN fl l ON l.path=ro.path AND l.name=handler LEFT JOIN bo ON bo.path=ro.path AND bo.local=handler LEFT JOIN fl f ON f.path=bo.tp AND f.name=bo.sy WHERE coalesce(l.id,f.id) IS NOT NULL""")
def route_handlers(spark, sf_dir):
    c, f = bridge.classes(spark, sf_dir), bridge.functions(spark, sf_dir)
    routes = c.select(F.col("p_id").alias("route_id"), F.col("p_path").alias("path"), F.concat(F.lit("order_"), F.col("p_partkey") % 50).alias("handler"))
    imports = f.join(c, F.col("o_orderkey") % 2000 == F.col("p_partkey")).select(F.col("p_path").alias("path"), F.concat(F.lit("order_"), F.col("o_orderkey") % 50).alias("local"), F.col("c_path").alias("target_path"), F.col("f_name").alias("symbol")).distinct()
    return resolve.route_handlers(routes, bridge.nodes(spark, sf_dir), imports)


@query(""", md AS (SELECT p_id AS class_id, p_name AS name, sha1(p_name||(p_partkey%2)) AS table_id FROM cl), op AS (SELECT f_id, c_path, p_name AS model, CASE WHEN o_orderkey%2=0 THEN 'write' ELSE 'read' END AS mode, f_line FROM fn JOIN cl ON p_partkey=o_orderkey%400)
SELECT DISTINCT f_id AS source_node_id, t.table_id AS target_node_id, CASE WHEN mode='write' THEN 'WRITES_TABLE' ELSE 'READS_TABLE' END AS type, c_path AS path, f_line AS start_line FROM op JOIN (SELECT name, min(table_id) AS table_id FROM md GROUP BY name HAVING count(DISTINCT table_id)=1) t ON t.name=op.model""")
def table_edges(spark, sf_dir):
    c, f = bridge.classes(spark, sf_dir), bridge.functions(spark, sf_dir)
    models = c.select(F.col("p_id").alias("class_id"), F.col("p_name").alias("name"), F.sha1(F.concat("p_name", (F.col("p_partkey") % 2).cast("string")).cast("binary")).alias("table_id"))
    operations = f.join(c, F.col("o_orderkey") % 400 == F.col("p_partkey")).select(F.col("f_id").alias("source_node_id"), F.col("c_path").alias("path"), F.col("p_name").alias("model"), F.when(F.col("o_orderkey") % 2 == 0, "write").otherwise("read").alias("mode"), F.col("f_line").alias("line"))
    return resolve.table_edges(operations, models)


# builds: orders before and after some changes


def _registry(spark, sf_dir):
    o = bridge.table(spark, sf_dir, "orders").filter("o_orderkey % 89 <> 1")
    return o.select(F.col("o_orderkey").cast("string").alias("path"), F.sha2(F.col("o_totalprice").cast("decimal(18,2)").cast("string").cast("binary"), 256).alias("hash"), (F.col("o_orderkey") % 1000).alias("size"), F.lit(1.0).alias("mtime"), F.lit(5).cast("bigint").alias("mtime_ns"), F.lit(5).cast("bigint").alias("ctime_ns"), F.col("o_orderstatus").alias("language"), F.lit(None).cast("timestamp").alias("last_indexed_at"), F.when(F.col("o_orderkey") % 83 == 2, "deleted").otherwise("active").alias("status"))


def _scan(spark, sf_dir):
    o = bridge.table(spark, sf_dir, "orders").filter("o_orderkey % 97 <> 3")
    price = F.col("o_totalprice").cast("decimal(18,2)") + F.when(F.col("o_orderkey") % 71 == 0, 1).otherwise(0)
    moved = F.when((F.col("o_orderkey") % 71 == 0) | (F.col("o_orderkey") % 53 == 0), 6).otherwise(5).cast("bigint")
    return o.select(F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("o_orderkey") % 101 != 0, F.sha2(price.cast("decimal(18,2)").cast("string").cast("binary"), 256)).alias("hash"), (F.col("o_orderkey") % 1000).alias("size"), (moved - 4).cast("double").alias("mtime"), moved.alias("mtime_ns"), moved.alias("ctime_ns"), F.col("o_orderstatus").alias("language"))


_BUILD = """, reg AS (SELECT o_orderkey::VARCHAR AS path, sha256(o_totalprice::DECIMAL(18,2)::VARCHAR) AS hash, o_orderkey%1000 AS size, 1.0 AS mtime, 5 AS ns, CASE WHEN o_orderkey%83=2 THEN 'deleted' ELSE 'active' END AS status FROM orders WHERE o_orderkey%89<>1),
scan AS (SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey%101<>0 THEN sha256((o_totalprice::DECIMAL(18,2)+CASE WHEN o_orderkey%71=0 THEN 1 ELSE 0 END)::DECIMAL(18,2)::VARCHAR) END AS hash, o_orderkey%1000 AS size, CASE WHEN o_orderkey%71=0 OR o_orderkey%53=0 THEN 6 ELSE 5 END AS ns, CASE WHEN o_orderkey%71=0 OR o_orderkey%53=0 THEN 2.0 ELSE 1.0 END AS mtime FROM orders WHERE o_orderkey%97<>3),
bo AS (SELECT coalesce(s.path,r.path) AS path, s.path IS NOT NULL AS here, r.path IS NOT NULL AS before, s.hash, r.hash AS rh, coalesce(s.size=r.size AND s.ns=r.ns,false) AS stat, s.size, r.size AS rs, s.mtime, r.mtime AS rm FROM scan s FULL JOIN (SELECT * FROM reg WHERE status='active') r ON s.path=r.path)"""


@query(_BUILD + """, k AS (SELECT *, CASE WHEN NOT here THEN 'deleted' WHEN before AND stat THEN 'unchanged' WHEN hash IS NULL THEN 'unreadable' WHEN NOT before THEN 'added' WHEN hash<>rh THEN 'changed' ELSE 'unchanged' END AS change_kind FROM bo)
SELECT path, change_kind, change_kind='unchanged' AND NOT stat AS stat_changed FROM k""")
def scan_diff_classify(spark, sf_dir):
    return ingest.classify(_scan(spark, sf_dir), _registry(spark, sf_dir))


@query(_BUILD + """ SELECT count(*) FILTER (NOT before)::BIGINT AS added, count(*) FILTER (here AND before AND (size<>rs OR mtime<>rm))::BIGINT AS changed, count(*) FILTER (NOT here)::BIGINT AS deleted,
coalesce(sum(CASE WHEN NOT before OR (here AND (size<>rs OR mtime<>rm)) THEN size WHEN NOT here THEN rs END),0)::BIGINT AS changed_bytes, (count(*) FILTER (NOT before)+count(*) FILTER (here AND before AND (size<>rs OR mtime<>rm))+count(*) FILTER (NOT here))::BIGINT AS out_of_date, true AS is_stale FROM bo""")
def freshness_summary(spark, sf_dir):
    return ingest.freshness(_scan(spark, sf_dir), _registry(spark, sf_dir))


@query(""" SELECT sha256(content) AS hash, count(*)::BIGINT AS copies, min(path) AS first_path FROM texts GROUP BY 1 HAVING count(*)>1""")
def content_hash_dups(spark, sf_dir):
    rows = bridge.texts(spark, sf_dir).groupBy(F.sha2(F.col("content").cast("binary"), 256).alias("hash")).agg(F.count("*").alias("copies"), F.min("path").alias("first_path"))
    return rows.filter("copies > 1")


@query(""", kn AS (SELECT id FROM nodes WHERE NOT (type='Class' AND start_line>40) AND NOT (type='Function' AND start_line<100)) SELECT id, type FROM edges WHERE source_node_id NOT IN (SELECT id FROM kn) OR target_node_id NOT IN (SELECT id FROM kn)""")
def orphan_edges(spark, sf_dir):
    kept = bridge.nodes(spark, sf_dir).filter("not (type = 'Class' and start_line > 40) and not (type = 'Function' and start_line < 100)")
    return ingest.orphan_edges(bridge.edges(spark, sf_dir), kept).select("id", "type")


@query(""" SELECT id, name FROM nodes WHERE type='EnvVar' AND id NOT IN (SELECT target_node_id FROM edges WHERE type='READS_ENV' AND start_line>49)""")
def orphan_env(spark, sf_dir):
    return ingest.orphan_env_vars(bridge.nodes(spark, sf_dir), bridge.edges(spark, sf_dir).filter("start_line > 49")).select("id", "name")


@query(""", old AS (SELECT p_partkey AS id, p_name AS name, p_size AS created_at FROM part WHERE p_partkey%3<>0), neu AS (SELECT p_partkey AS id, upper(p_name) AS name, 1000+p_size AS created_at FROM part WHERE p_partkey%2=0)
SELECT coalesce(n.id,o.id) AS id, coalesce(n.name,o.name) AS name, coalesce(o.created_at,n.created_at)::INT AS created_at FROM old o FULL JOIN neu n ON o.id=n.id""")
def upsert_merge(spark, sf_dir):
    p = bridge.table(spark, sf_dir, "part")
    old = p.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("created_at"))
    new = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("name"), (F.col("p_size") + 1000).alias("created_at"))
    return ingest.upsert(old, new)


@query(""" SELECT id, path FROM nodes WHERE type='Directory' AND NOT EXISTS (SELECT 1 FROM cu WHERE c_custkey%7=0 AND starts_with(c_path, nodes.path||'/'))""")
def ancestor_dirs_cleanup(spark, sf_dir):
    files = bridge.customers(spark, sf_dir).filter("c_custkey % 7 = 0").select(F.col("c_path").alias("path"), F.lit("active").alias("status"))
    return ingest.stale_directories(bridge.nodes(spark, sf_dir), files).select("id", "path")


@query(""", p AS (SELECT string_split(c_path,'/') AS s FROM cu) SELECT DISTINCT array_to_string(s[1:i],'/') AS parent, array_to_string(s[1:i+1],'/') AS child FROM (SELECT s, unnest(range(1,len(s))) AS i FROM p)""")
def directory_chain(spark, sf_dir):
    return ingest.directory_chain(bridge.customers(spark, sf_dir).select(F.col("c_path").alias("path")))


# intervals


def _ranges(spark, sf_dir):
    rows = bridge.table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_partkey").alias("path"), (F.col("l_orderkey") % 1000).cast("int").alias("start"), (F.col("l_orderkey") % 1000 + F.col("l_quantity").cast("int")).cast("int").alias("end"))


@query(""", r AS (SELECT l_partkey AS path, (l_orderkey%1000)::INT AS s, (l_orderkey%1000+l_quantity::INT)::INT AS e FROM lineitem),
b AS (SELECT *, max(e) OVER (PARTITION BY path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r), g AS (SELECT *, sum(CASE WHEN m IS NULL OR s>m+1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM b)
SELECT path, min(s) AS start, max(e) AS "end" FROM g GROUP BY path, i""")
def merge_ranges(spark, sf_dir):
    return intervals.merge_ranges(_ranges(spark, sf_dir), ["path"])


_CHANGED = ", ch AS (SELECT c_path AS path FROM cu WHERE c_custkey%4=1), rg AS (SELECT c_path AS path, f_line+3 AS s, f_line+8 AS e FROM fn JOIN cu USING (c_path) WHERE c_custkey%4=1 AND c_custkey%8<>5 AND o_orderkey%3=0)"


@query(_CHANGED + f""" SELECT DISTINCT n.id, n.path, n.name, n.type, n.start_line, n.end_line FROM nodes n JOIN rg ON rg.path=n.path AND n.start_line<=rg.e AND coalesce(n.end_line,n.start_line)>=rg.s WHERE type IN ('Function','Module')
UNION SELECT id, path, name, type, start_line, end_line FROM nodes WHERE type IN ('Function','Module') AND path IN (SELECT path FROM ch) AND path NOT IN (SELECT path FROM rg)""")
def range_overlap_symbols(spark, sf_dir):
    return intervals.changed_symbols(*_changes(spark, sf_dir))


def _changes(spark, sf_dir):
    c = bridge.customers(spark, sf_dir).filter("c_custkey % 4 = 1")
    f = bridge.functions(spark, sf_dir).filter("c_custkey % 4 = 1 and c_custkey % 8 <> 5 and o_orderkey % 3 = 0")
    ranges = f.select(F.col("c_path").alias("path"), (F.col("f_line") + 3).alias("start"), (F.col("f_line") + 8).alias("end"))
    return ranges, c.select(F.col("c_path").alias("path")), bridge.nodes(spark, sf_dir).filter("type in ('Function', 'Module')")


@query(""", ch AS (SELECT p_id FROM cl WHERE p_partkey%9=2), cd AS (SELECT d_path FROM df WHERE doc_id%5=0) SELECT DISTINCT s.path AS doc_path, e.start_line AS line, e.target_node_id AS target FROM edges e JOIN nodes s ON s.id=e.source_node_id WHERE e.type='MENTIONS' AND e.target_node_id IN (SELECT p_id FROM ch) AND s.path NOT IN (SELECT d_path FROM cd)""")
def stale_docs(spark, sf_dir):
    from ..operators.context import stale_docs as operator

    changed = bridge.classes(spark, sf_dir).filter("p_partkey % 9 = 2").select(F.col("p_id").alias("id"))
    docs = bridge.doc_files(spark, sf_dir).filter("doc_id % 5 = 0").select(F.col("d_path").alias("path"))
    return operator(bridge.nodes(spark, sf_dir), bridge.edges(spark, sf_dir), changed, docs)


@query(""" SELECT event_id, user_id, ts, value, (SELECT o_orderkey FROM orders o WHERE o.o_custkey=e.user_id AND o.o_orderdate<=e.ts ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS o_orderkey FROM events e""")
def order_as_of_event(spark, sf_dir):
    left = bridge.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    right = bridge.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), "o_orderkey")
    return intervals.as_of(left, right, ["user_id"], "ts", ["o_orderkey"])


@query(r""", pa AS (SELECT o_orderkey, '@@ -'||o_orderkey||',3 +'||(o_orderkey+1)||' @@ x'||chr(10)||'-a'||chr(10)||'@@ -'||(o_orderkey+50)||' +'||(o_orderkey+70)||',0 @@' AS patch FROM orders)
SELECT o_orderkey, 'old' AS side, o_orderkey::INT AS start, (o_orderkey+2)::INT AS "end" FROM pa UNION ALL SELECT o_orderkey, 'new', (o_orderkey+1)::INT, (o_orderkey+1)::INT FROM pa UNION ALL SELECT o_orderkey, 'old', (o_orderkey+50)::INT, (o_orderkey+50)::INT FROM pa""")
def hunk_ranges(spark, sf_dir):
    key = F.col("o_orderkey")
    patch = F.concat(F.lit("@@ -"), key, F.lit(",3 +"), key + 1, F.lit(" @@ x\n-a\n@@ -"), key + 50, F.lit(" +"), key + 70, F.lit(",0 @@"))
    return intervals.hunk_ranges(bridge.table(spark, sf_dir, "orders").select("o_orderkey", patch.alias("patch"))).drop("patch")


# memory: conversations are sessions, turns are entries


def _entries(spark, sf_dir):
    c = bridge.table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws("/", "conv_id", "turn").alias("entry_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("created_at"), F.coalesce("text", F.lit("")).alias("summary"))


@query(""" SELECT conv_id||'/'||turn AS entry_id, conv_id*1000+turn AS created_at, coalesce(text,'') AS summary FROM conversations ORDER BY created_at DESC, entry_id, summary LIMIT 10""")
def memory_latest(spark, sf_dir):
    return memory.read(_entries(spark, sf_dir))


@query(""" SELECT conv_id||'/'||turn AS entry_id, conv_id*1000+turn AS created_at, coalesce(text,'') AS summary FROM conversations WHERE contains(lower(coalesce(text,'')),'the of') ORDER BY created_at DESC, entry_id, summary LIMIT 10""")
def memory_topic(spark, sf_dir):
    return memory.read(_entries(spark, sf_dir), topic="The of")


def _anchors(spark, sf_dir):
    """Entries anchored on all functions: some as they are, some with other lines, some whose file was renamed, some gone."""
    n = bridge.functions(spark, sf_dir)
    k = F.col("o_orderkey") % 5
    old_path = F.concat(F.lit("old/"), F.col("c_path"))
    return n.select((F.col("o_orderkey") % 40).alias("entry_id"), F.when(k < 3, F.col("f_id")).otherwise(F.sha1(F.concat("f_id", F.lit("x")).cast("binary"))).alias("id"), F.lit("Function").alias("type"), F.col("f_name").alias("name"), F.when(k < 3, F.col("c_path")).otherwise(old_path).alias("path"), (F.col("f_line") + F.when(k == 1, 1).otherwise(0)).cast("int").alias("start_line"), (F.col("f_line") + (F.col("o_orderkey") % 25) + F.when(k == 1, 1).otherwise(0)).cast("int").alias("end_line"))


def _renames(spark, sf_dir):
    c = bridge.customers(spark, sf_dir).filter("c_custkey % 3 <> 0")
    return c.select(F.col("c_path").alias("path"), F.concat(F.lit("old/"), "c_path").alias("original_path"))


_ANCHOR = """, an AS (SELECT o_orderkey%40 AS entry_id, CASE WHEN o_orderkey%5<3 THEN f_id ELSE sha1(f_id||'x') END AS id, f_name AS name, CASE WHEN o_orderkey%5<3 THEN c_path ELSE 'old/'||c_path END AS path, (f_line+CASE WHEN o_orderkey%5=1 THEN 1 ELSE 0 END)::INT AS start_line, (f_line+o_orderkey%25+CASE WHEN o_orderkey%5=1 THEN 1 ELSE 0 END)::INT AS end_line FROM fn),
rn AS (SELECT 'old/'||c_path AS old, c_path AS now FROM cu WHERE c_custkey%3<>0),
un AS (SELECT a.path, a.name, min(n.id) AS rid, min(n.path) AS rp, min(n.start_line) AS rs, min(n.end_line) AS re FROM (SELECT DISTINCT path, name FROM an) a JOIN rn ON rn.old=a.path JOIN nodes n ON n.type='Function' AND n.path=rn.now AND n.name=a.name GROUP BY 1,2 HAVING count(DISTINCT n.id)=1),
vr AS (SELECT a.*, coalesce(n.id, u.rid) AS found_id, CASE WHEN n.id IS NOT NULL THEN 'stable-node-id' WHEN u.rid IS NOT NULL THEN 'git-rename' ELSE 'unresolved' END AS provenance,
 CASE WHEN coalesce(n.id,u.rid) IS NULL THEN 'invalidated' WHEN coalesce(n.path,u.rp)=a.path AND coalesce(n.start_line,u.rs)=a.start_line AND coalesce(n.end_line,u.re)=a.end_line THEN 'verified' ELSE 'drifted' END AS verdict
 FROM an a LEFT JOIN nodes n ON n.id=a.id LEFT JOIN un u ON n.id IS NULL AND u.path=a.path AND u.name=a.name)"""


@query(_ANCHOR + " SELECT entry_id, id, name, path, found_id, provenance, verdict FROM vr")
def anchor_verdicts(spark, sf_dir):
    found = memory.verify_anchors(_anchors(spark, sf_dir), bridge.nodes(spark, sf_dir), _renames(spark, sf_dir))
    return found.select("entry_id", "id", "name", "path", "found_id", "provenance", "verdict")


@query(_ANCHOR + """, wo AS (SELECT entry_id, max(CASE verdict WHEN 'invalidated' THEN 2 WHEN 'drifted' THEN 1 ELSE 0 END) AS w FROM vr GROUP BY 1), en AS (SELECT range AS entry_id FROM range(45)),
ve AS (SELECT CASE w WHEN 2 THEN 'invalidated' WHEN 1 THEN 'drifted' WHEN 0 THEN 'verified' ELSE 'unanchored' END AS verdict FROM en LEFT JOIN wo USING (entry_id))
SELECT v AS verdict, count(ve.verdict)::BIGINT AS entries FROM (VALUES ('verified'),('drifted'),('invalidated'),('unanchored')) x(v) LEFT JOIN ve ON ve.verdict=v GROUP BY v""")
def verdict_histogram(spark, sf_dir):
    found = memory.verify_anchors(_anchors(spark, sf_dir), bridge.nodes(spark, sf_dir), _renames(spark, sf_dir))
    entries = spark.range(45).withColumnRenamed("id", "entry_id")
    return memory.verdict_histogram(memory.entry_verdicts(entries, found))


# budget, quality, parsing


@query(""", s AS (SELECT conv_id, turn, sum(length(coalesce(text,''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM conversations) SELECT conv_id, turn, used FROM s WHERE used+20<=4*200""")
def budget_prefix_trim(spark, sf_dir):
    rows = bridge.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"))
    return budget.prefix(rows, ["conv_id"], ["turn"], "size", 200, 20).drop("size")


@query(""", a AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars>300), e AS (SELECT DISTINCT doc_id FROM labels WHERE quality=1), f AS (SELECT DISTINCT doc_id FROM labels WHERE quality=0),
t AS (SELECT (SELECT count(*) FROM e) AS n, (SELECT count(*) FROM e WHERE doc_id IN (SELECT doc_id FROM a)) AS t, (SELECT count(*) FROM f) AS m, (SELECT count(*) FROM f WHERE doc_id IN (SELECT doc_id FROM a)) AS p)
SELECT n AS expected, m AS forbidden, t AS true_positives, n-t AS false_negatives, p AS false_positives, round(CASE WHEN t+p>0 THEN t/(t+p)::DOUBLE ELSE 1 END,6) AS "precision", round(CASE WHEN n>0 THEN t/n::DOUBLE ELSE 1 END,6) AS recall, n=t AND p=0 AS passed FROM t""")
def precision_recall(spark, sf_dir):
    labels = bridge.table(spark, sf_dir, "labels")
    actual = bridge.table(spark, sf_dir, "documents").filter("n_chars > 300")
    return overview.accuracy(actual, labels.filter("quality = 1"), labels.filter("quality = 0"), "doc_id")


@query(""", m AS (SELECT l.doc_id, d.source, quality FROM labels l JOIN documents d USING (doc_id)), a AS (SELECT source, doc_id FROM documents WHERE n_chars>300)
SELECT source, count(*) FILTER (quality=1)::BIGINT AS expected, count(*) FILTER (quality=0)::BIGINT AS forbidden, count(*) FILTER (quality=1 AND a.doc_id IS NOT NULL)::BIGINT AS true_positives, count(*) FILTER (quality=0 AND a.doc_id IS NOT NULL)::BIGINT AS false_positives,
count(*) FILTER (quality=1 AND a.doc_id IS NULL)::BIGINT AS false_negatives, round(CASE WHEN count(a.doc_id)>0 THEN count(*) FILTER (quality=1 AND a.doc_id IS NOT NULL)/count(a.doc_id)::DOUBLE ELSE 1 END,6) AS "precision",
round(CASE WHEN count(*) FILTER (quality=1)>0 THEN count(*) FILTER (quality=1 AND a.doc_id IS NOT NULL)/(count(*) FILTER (quality=1))::DOUBLE ELSE 1 END,6) AS recall, count(*) FILTER (quality=1 AND a.doc_id IS NULL)=0 AND count(*) FILTER (quality=0 AND a.doc_id IS NOT NULL)=0 AS passed
FROM m LEFT JOIN a USING (source, doc_id) GROUP BY source""")
def accuracy_by_source(spark, sf_dir):
    docs = bridge.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    labels = bridge.table(spark, sf_dir, "labels").join(docs.select("doc_id", "source"), "doc_id")
    return overview.accuracy_by_entry(docs.filter("n_chars > 300"), labels.filter("quality = 1"), labels.filter("quality = 0"), "source", "doc_id")


@query(""", i AS (SELECT id, type||':'||coalesce(nullif(qualified_name,''),name)||'@'||coalesce(path,'') AS k FROM nodes) SELECT DISTINCT 'node|'||k AS fact FROM i UNION SELECT concat_ws('|','edge',e.type,s.k,t.k,e.path) FROM edges e JOIN i s ON s.id=e.source_node_id JOIN i t ON t.id=e.target_node_id""")
def fact_keys(spark, sf_dir):
    if bridge.built(spark, sf_dir, "edges") is not None:
        return overview.fact_keys(bridge.nodes(spark, sf_dir), bridge.edges(spark, sf_dir))
    return bridge.facts(spark, sf_dir)


@query(""", a AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges WHERE type<>'CO_CHANGED_WITH') AS e), b AS (SELECT (SELECT count(*) FROM nodes WHERE type<>'EnvVar') AS n, (SELECT count(*) FROM edges WHERE type<>'READS_ENV') AS e)
SELECT b.n-a.n AS nodes_drift, b.e-a.e AS edges_drift, b.n<>a.n OR b.e<>a.e AS drifted FROM a, b""")
def snapshot_drift(spark, sf_dir):
    n, e = bridge.nodes(spark, sf_dir), bridge.edges(spark, sf_dir)
    return overview.drift(overview.structural_counts(n, e), overview.structural_counts(n.filter("type <> 'EnvVar'"), e.filter("type <> 'READS_ENV'")))


@query(""" SELECT event_id, key AS key_path, CASE WHEN json_type(props,'$.'||key) IN ('UBIGINT','BIGINT') THEN 'integer' ELSE lower(json_type(props,'$.'||key)) END AS value_type FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""")
def json_key_walk(spark, sf_dir):
    rows = bridge.table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key_path", "v"))
    kind = F.when(F.col("v").rlike(r"^-?\d+$"), "integer").when(F.col("v").rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "double").when(F.col("v").isin("true", "false"), "boolean").when(F.col("v").isNull(), "null").otherwise("varchar")
    return rows.select("event_id", "key_path", kind.alias("value_type"))


@query(""", h AS (SELECT page_id, unnest(regexp_extract_all(html,'<a [^>]*href="([^"]*)"',1)) AS href FROM pages) SELECT page_id, href, count(*)::BIGINT AS uses FROM h GROUP BY 1,2""")
def html_link_refs(spark, sf_dir):
    rows = bridge.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), 1)).alias("href"))
    return rows.groupBy("page_id", "href").agg(F.count("*").alias("uses"))
