"""Full-text queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import overview
from ..sources import bridge

QUERIES, ORACLES = {}, {}
PREFIX = "WITH " + bridge.SQL


def query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = f"{PREFIX}{sql}"
        return function

    return add


#: Tokens by column; accents go with strip_accents, which folds more than Latin letters but alike on these tables.
_TOKENS = r""", tx AS (SELECT row_number() OVER (ORDER BY path, name) AS k, * FROM texts),
ts AS (SELECT k, path, name, node_id, regexp_extract_all(strip_accents(lower(path)),'[\p{L}\p{N}]+') AS t1, regexp_extract_all(strip_accents(lower(name)),'[\p{L}\p{N}]+') AS t2, regexp_extract_all(strip_accents(lower(content)),'[\p{L}\p{N}]+') AS t3 FROM tx)"""


def _count(phrase: list[str]) -> str:
    n, want = len(phrase), "[" + ",".join(f"'{p}'" for p in phrase) + "]"
    return "+".join(f"len(list_filter(range(1, greatest(len({c})-{n}+2,1)), lambda i: {c}[i:i+{n - 1}]={want}))" for c in ("t1", "t2", "t3"))


def _bm25(phrases: list[list[str]]) -> str:
    f = ", ".join(f"{_count(p)} AS f{i}" for i, p in enumerate(phrases))
    n = ", ".join(f"count(*) FILTER (f{i}>0) AS n{i}" for i in range(len(phrases)))
    score = "+".join(f"greatest(1e-6, ln((n-n{i}+0.5)/(n{i}+0.5)))*f{i}*2.2/(f{i}+1.2*(0.25+0.75*dl/avgdl))" for i in range(len(phrases)))
    hit = " AND ".join(f"f{i}>0" for i in range(len(phrases)))
    return f"""{_TOKENS}, fr AS (SELECT k, path, name, node_id, len(t1)+len(t2)+len(t3) AS dl, {f} FROM ts), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {n} FROM fr),
sc AS (SELECT path, name, node_id, {score} AS score FROM fr, st WHERE {hit})"""


@query(_TOKENS + " SELECT path, name, (len(t1)+len(t2)+len(t3))::BIGINT AS tokens, len(list_distinct(t3))::BIGINT AS terms FROM ts")
def fts_token_stats(spark, sf_dir):
    rows = bridge.texts(spark, sf_dir)
    own = text.tokens(F.col("content"))
    return rows.select("path", "name", (F.size(text.tokens(F.col("path"))) + F.size(text.tokens(F.col("name"))) + F.size(own)).cast("bigint").alias("tokens"), F.size(F.array_distinct(own)).cast("bigint").alias("terms"))


@query(_TOKENS + """ SELECT term, count(*)::BIGINT AS uses, count(DISTINCT k)::BIGINT AS rows_with FROM (SELECT k, unnest(t1) AS term FROM ts UNION ALL SELECT k, unnest(t2) FROM ts UNION ALL SELECT k, unnest(t3) FROM ts) GROUP BY term""")
def fts_postings(spark, sf_dir):
    rows = bridge.texts(spark, sf_dir).withColumn("doc_key", F.struct("path", "name"))
    return text.postings(rows).groupBy("term").agg(F.count("*").alias("uses"), F.countDistinct("doc_key").alias("rows_with"))


def _ranked(spark, sf_dir, wanted):
    if index := bridge.token_index(spark, sf_dir):
        return text.stored_bm25(*index, wanted).select("path", "name", F.round("score", 6).alias("score"))
    rows = bridge.texts(spark, sf_dir).withColumn("doc_key", F.struct("path", "name"))
    return text.bm25(rows, wanted).select("doc_key.path", "doc_key.name", F.round("score", 6).alias("score"))


@query(_bm25([["elle"]]) + " SELECT path, name, round(score,6) AS score FROM sc")
def bm25_single_term(spark, sf_dir):
    return _ranked(spark, sf_dir, "Elle")


@query(_bm25([["the"], ["license"]]) + " SELECT path, name, round(score,6) AS score FROM sc")
def bm25_and_terms(spark, sf_dir):
    return _ranked(spark, sf_dir, "the LICENSE")


@query(_bm25([["general", "public", "license"]]) + " SELECT path, name, round(score,6) AS score FROM sc")
def bm25_phrase(spark, sf_dir):
    return _ranked(spark, sf_dir, "general_public-license")


def _search(q: str, phrases: list[list[str]], node_type: str | None, limit: int, name: str = "") -> str:
    kind = f" AND type='{node_type}'" if node_type else ""
    join = "JOIN" if node_type else "LEFT JOIN"
    return f""", ty{name} AS (SELECT coalesce(sc.node_id, sc.path||chr(0)||sc.name) AS k, sc.path, sc.name, n.type, score FROM sc {join} nodes n ON n.id=sc.node_id{kind.replace('type', 'n.type')}),
tp{name} AS (SELECT * FROM ty{name} ORDER BY score DESC, k, path, name LIMIT {max(5 * limit, 50)}),
hi{name} AS (SELECT k, max(score) AS score, arg_max(path, score) AS path, arg_max(name, score) AS name, any_value(type) AS type FROM tp{name} GROUP BY k),
nm{name} AS (SELECT id AS k, CASE WHEN lower(name)='{q}' THEN 100.0 ELSE 25.0 END AS boost, name, path, type FROM nodes WHERE contains(lower(name),'{q}'){kind} ORDER BY CASE WHEN lower(name)='{q}' THEN 0 ELSE 1 END, id LIMIT 200),
al{name} AS (SELECT coalesce(h.k,n.k) AS k, coalesce(h.path,n.path) AS path, coalesce(h.name,n.name) AS name, coalesce(h.type,n.type) AS type, h.score AS s, n.boost AS b FROM hi{name} h FULL JOIN nm{name} n ON h.k=n.k),
rs{name} AS (SELECT k, path, name, type, coalesce(s,0)+coalesce(b,0)+CASE WHEN contains(lower(path),'{q}') THEN 10 ELSE 0 END AS total,
  concat_ws(', ', CASE WHEN s IS NOT NULL THEN 'full-text match' END, CASE WHEN b=100 THEN 'exact name match' WHEN b=25 THEN 'name contains query' END, CASE WHEN contains(lower(path),'{q}') THEN 'path match' END) AS reasons FROM al{name}
  ORDER BY total DESC, k LIMIT {limit})"""


@query(_bm25([["doc"], ["1"]]) + _search("doc 1", [], None, 10) + " SELECT path, name, type, round(total,6)::DOUBLE AS score, reasons FROM rs")
def search_hybrid_boosts(spark, sf_dir):
    return text.search(bridge.texts(spark, sf_dir), bridge.nodes(spark, sf_dir), "doc 1", 10, index=bridge.token_index(spark, sf_dir))


@query(_bm25([["src1"]]) + _search("src1", [], "MarkdownDocument", 10, "a") + _search("src1", [], "Module", 10, "b") + """ SELECT path, name, type, round(total,6)::DOUBLE AS score, reasons FROM (SELECT * FROM rsa UNION ALL SELECT * FROM rsb) ORDER BY round(total,6) DESC, path, name, type LIMIT 10""")
def search_by_types(spark, sf_dir):
    return text.search_types(bridge.texts(spark, sf_dir), bridge.nodes(spark, sf_dir), "src1", ["MarkdownDocument", "Module"], 10, bridge.token_index(spark, sf_dir))


@query(r""", b AS (SELECT path, list_filter(list_transform(regexp_split_to_array(content,'\n\s*\n'), lambda x: trim(regexp_replace(x,'\s+',' ','g'))), lambda x: regexp_matches(x,'[.!?]') AND NOT regexp_matches(x,'^([-*+]\s|\d+[.)]\s|#|```)')) AS ps FROM texts)
SELECT path, ps[1] AS paragraph FROM b WHERE len(ps)>0 ORDER BY length(path), path LIMIT 3""")
def purpose_paragraph(spark, sf_dir):
    return overview.purpose(bridge.texts(spark, sf_dir), 3)


@query(_bm25([["general", "public", "license"], ["the"]]) + " SELECT path, name, round(score,6) AS score FROM sc")
def bm25_from_postings(spark, sf_dir):
    """The same ranking from an index of tokens."""
    index = bridge.token_index(spark, sf_dir) or text.indexed(bridge.texts(spark, sf_dir))
    return text.stored_bm25(*index, "general_public-license the").select("path", "name", F.round("score", 6).alias("score"))
