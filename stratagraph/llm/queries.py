"""The operators bound to the standard tables: QUERIES by name, and ORACLES where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, linededup, media, mixing, neardup, piece, quality_model, quality_rules, stages, tokenbin, warc
from .common import table


def op1_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.pages_round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_language_bitmasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", "held_out", "lang_pred", "score")


def op3_min_max_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op4_piece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece.round_trip_digests(table(spark, sf_dir, "documents")).drop("decoded_equal")


def op5_common_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.drop_common_lines(docs, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.id_files(table(spark, sf_dir, "documents")).drop("repeat")


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), carry=["doc_id"]).drop("posterior")


def op8_kernel_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_samples(media.stored_samples(table(spark, sf_dir, "documents"))).drop("media_type")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_legacy_archives, op2_language_bitmasks, op3_min_max_hash, op4_piece_backtracking, op5_common_lines, op6_id_shards, op7_weak_supervision, op8_kernel_ridge, op9_systematic_mix, op10_signature_sniffing, pipeline)
}

_BASE32 = "||".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {10 * g + 1}, 10))::BIGINT >> {35 - 5 * i}) & 31)::INT, 1)" for g in range(4) for i in range(8))
_TRIM = "E' \\t\\n\\x0b\\x0c\\r'"

ORACLES: dict[str, str] = {
    "op1_legacy_archives": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
     f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (h)""",
    "op3_min_max_hash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
r AS (SELECT doc_id AS node, doc_id AS reach FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT doc_id, n::BIGINT AS n_shingles, min(reach)::BIGINT AS component_id, doc_id = min(reach) AS kept
FROM n JOIN r ON r.node = doc_id GROUP BY doc_id, n""",
    "op5_common_lines": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, {_TRIM}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON c.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
}
