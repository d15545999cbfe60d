"""The stages of the corpus pipeline: a training corpus from the documents table, each written and read again.

language: documents without a language go. lines: lines found in many documents go. near: of each
group of near-duplicates one document stays. mix: documents are taken towards the sources' targets, so that a
row may appear up to three times or not at all. pieces: every row's token ids, decoded again.

All stages but the last return the columns of documents, whatever further columns there are and however they are named.

Rows that aren't plain documents, stage by stage (details in the operators' modules):

* Null and empty texts, and texts without a letter, have no language and go in the first stage. On their own input the
  other stages keep them: as one empty line, as near nothing, with size 0 (a source of none but such rows is taken once)
  and as the end id alone.
* Very long texts are treated whole in each stage. A batch of Arrow ends after a few megabytes or one text.
* Null ids are kept by all stages (near: all of them; mix: each has its own rank); null sources come last in mix.
* Repeated rows: each counts as a document for lines and mix; near keeps one of a repeated id and text, and of one id
  with different texts each that is near no other.
* Ties: languages by name, near-duplicates by id, hash and text, ranks in mix by a hash of id and text.
* Empty tables give empty tables of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, linededup, mixing, neardup, piece
from .common import fresh_dir, table

#: A text's n-grams in its best language, corrected, below which it is in none of the known languages.
MIN_SHARE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows that have a language, and keeps those that are in one of the languages learned."""
    found = langid.identify(docs.withColumnsRenamed({c: f"__stage_{c}" for c in _CLASH if c in docs.columns}))
    found = found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("share") >= MIN_SHARE))
    return found.drop(*_CLASH).withColumnsRenamed({f"__stage_{c}": c for c in _CLASH}).select(*docs.columns)


#: Columns that identification adds; documents' own of these names are put aside.
_CLASH = ("lang_pred", "score", "share", "held_out")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of 10 documents and more; n_chars follows the text."""
    own = {c: f"__stage_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    kept = linededup.drop_common_lines(docs.withColumnsRenamed(own), min_docs=10, min_chars=1)
    kept = kept.drop("n_lines", "n_dropped").withColumnsRenamed({v: k for k, v in own.items()})
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: shingles of five words, similarity of 0.8 and more."""
    return neardup.keep_first(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as the mix takes it."""
    own = {c: f"__stage_{c}" for c in ("size", "source_size", "target", "copies") if c in docs.columns}
    mixed = mixing.mix(docs.withColumnsRenamed(own))
    out = mixing.emitted(mixed, [own.get(c, c) for c in docs.columns])
    return out.withColumnsRenamed({v: k for k, v in own.items()})


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every row's ids and of the text decoded from them."""
    return piece.round_trip_digests(docs)


STAGES = [("language", language), ("lines", lines), ("near", near), ("mix", mix), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    folder = fresh_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
