"""The pipeline's stages, each on its own input, against plain Python."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from stratagraph.llm import mixing
from tests.llm.test_operators import SCHEMA, brute_components, documents


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    frame = spark.createDataFrame(documents(), SCHEMA).withColumn("extra", F.lit("e"))
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        if name == "language":
            assert {r.doc_id for r in out.collect()} == set(before) - {1000, 1001, 1002, 1005, 1003, 1004, 1006}  # no letter, or n-grams of no language that was learned
        if name == "lines":
            assert all("ommon" not in r.text and r.n_chars == len(r.text) for r in out.collect()) and out.count() == docs.count()
        if name == "near":
            groups = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
            assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
        if name == "mix":
            want = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
            assert dict(collections.Counter(r.doc_id for r in out.collect())) == want
        docs = out
    assert docs.filter("not decoded_equal").count() == 0


def test_run_on_tables_and_on_an_empty_one(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near", "mix", "pieces"]
