"""Change-history queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history
from ..sources import bridge

QUERIES, ORACLES = {}, {}
PREFIX = "WITH " + bridge.SQL


def query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = f"{PREFIX}{sql}"
        return function

    return add


_PAIRS = """, b AS (SELECT DISTINCT sha, path FROM commit_files), k AS (SELECT sha, count(*) AS k FROM b GROUP BY sha HAVING count(*)<=50), s AS (SELECT b.sha, path, k FROM b JOIN k USING (sha)),
n AS (SELECT path, count(*) AS n FROM s GROUP BY path),
q AS (SELECT x.path AS p1, y.path AS p2, count(*)::BIGINT AS support, sum(1.0::DOUBLE/(x.k-1)) AS w FROM s x JOIN s y ON x.sha=y.sha AND x.path<y.path GROUP BY 1,2 HAVING count(*)>=2),
pairs AS (SELECT p1, p2, support, round(w,4) AS weighted, round(round(least(1.0,round(w,9)/least(a.n,c.n)),9),4) AS score, round(round(0.55*least(1.0,round(w,9)/least(a.n,c.n)),9),3) AS confidence FROM q JOIN n a ON a.path=p1 JOIN n c ON c.path=p2
  WHERE p1 IN (SELECT path FROM files WHERE status='active') AND p2 IN (SELECT path FROM files WHERE status='active'))"""


def _pairs(spark, sf_dir):
    return history.co_change_pairs(bridge.commit_files(spark, sf_dir), bridge.files(spark, sf_dir))


@query(f"{_PAIRS} SELECT * FROM pairs")
def co_change_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


_PARTNERS = "SELECT CASE WHEN p1='{p}' THEN p2 ELSE p1 END AS partner, support, score, confidence FROM pairs WHERE p1='{p}' OR p2='{p}' ORDER BY confidence DESC, support DESC, partner LIMIT 20"


@query(f"{_PAIRS} {_PARTNERS.format(p='10')}")
def co_change_partners(spark, sf_dir):
    return history.partners(_pairs(spark, sf_dir), "10")


_MARKS = ", mk AS (SELECT p_partkey::VARCHAR AS path FROM part WHERE p_partkey%10=3)"
_HIST = """SELECT CASE WHEN p1 IN (SELECT path FROM mk) THEN p1 ELSE p2 END AS co_changed_with, CASE WHEN p1 IN (SELECT path FROM mk) THEN p2 ELSE p1 END AS partner,
(p1 IN (SELECT path FROM mk) AND p2 IN (SELECT path FROM mk)) AS partner_changed, support, score, confidence FROM pairs WHERE {w} ORDER BY confidence DESC, co_changed_with, partner LIMIT 20"""


def _marks(spark, sf_dir):
    return bridge.table(spark, sf_dir, "part").filter("p_partkey % 10 = 3").select(F.col("p_partkey").cast("string").alias("path"))


@query(_PAIRS + _MARKS + _HIST.format(w="(p1 IN (SELECT path FROM mk)) <> (p2 IN (SELECT path FROM mk))"))
def co_change_external_only(spark, sf_dir):
    return history.historical_co_change(_pairs(spark, sf_dir), _marks(spark, sf_dir), only_external=True)


@query(_PAIRS + _MARKS + _HIST.format(w="(p1 IN (SELECT path FROM mk)) OR (p2 IN (SELECT path FROM mk))"))
def historical_impact(spark, sf_dir):
    return history.historical_co_change(_pairs(spark, sf_dir), _marks(spark, sf_dir))


@query(""" SELECT path, count(*)::BIGINT AS commits, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, count(DISTINCT author_email)::BIGINT AS authors, max(committed_at) AS last_changed
FROM commit_files JOIN commits USING (sha) WHERE path IN (SELECT path FROM files WHERE status='active') GROUP BY path ORDER BY commits DESC, sum(additions)+sum(deletions) DESC, path LIMIT 20""")
def churn_hotspots(spark, sf_dir):
    return history.churn_hotspots(bridge.commits(spark, sf_dir), bridge.commit_files(spark, sf_dir), bridge.files(spark, sf_dir))


_OWN = """, m AS (SELECT c.*, f.additions, f.deletions FROM commit_files f JOIN commits c USING (sha){w})
SELECT author_name, author_email, count(DISTINCT sha)::BIGINT AS commits, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, min(committed_at) AS first_commit, max(committed_at) AS last_commit,
round(count(DISTINCT sha)/greatest((SELECT count(DISTINCT sha) FROM m),1)::DOUBLE,4) AS share FROM m GROUP BY 1,2 ORDER BY commits DESC, author_email LIMIT 10"""


@query(_OWN.format(w=""))
def ownership_repo(spark, sf_dir):
    return history.ownership(bridge.commits(spark, sf_dir), bridge.commit_files(spark, sf_dir))


@query(_OWN.format(w=" WHERE f.path='10'"))
def ownership_file(spark, sf_dir):
    return history.ownership(bridge.commits(spark, sf_dir), bridge.commit_files(spark, sf_dir), "10")


@query(" SELECT sha, count(DISTINCT path)::BIGINT AS k, CASE WHEN count(DISTINCT path)>6 THEN 'oversized' END AS co_change_excluded FROM commit_files GROUP BY sha")
def oversized_commits(spark, sf_dir):
    return history.commit_sizes(bridge.commit_files(spark, sf_dir), max_files=6)


@query(f"""{_PAIRS}, z AS (SELECT p1, p2, a.sha, row_number() OVER (PARTITION BY p1, p2 ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM pairs JOIN s a ON a.path=p1 JOIN s c ON c.path=p2 AND c.sha=a.sha JOIN commits m ON m.sha=a.sha)
SELECT p1, p2, sha, place::INT AS place FROM z WHERE place<=20""")
def supporting_commits_topn(spark, sf_dir):
    files = bridge.commit_files(spark, sf_dir)
    return history.supporting_commits(files, bridge.commits(spark, sf_dir), _pairs(spark, sf_dir))
