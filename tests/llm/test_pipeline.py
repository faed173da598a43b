"""The pipeline's stages, each on its own input."""

import hashlib

import corpus_pipeline
import pyarrow as pa
from slidemill import storage
from slidemill.llm import common

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        assert after.count() <= docs.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns, name
        docs = after
    assert 0 < docs.count() < n
    for r in docs.collect():
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()


def test_stages_take_empty_tables_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS score", "'x' AS node", "'y' AS spans", "0 AS __row")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.limit(0), SF).count() == 0
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.count() > 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_hand_texts_over_once_in_small_batches(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('some words ', 500) AS text").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    def stage(spark, docs, sf_dir):
        assert docs.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] < 2 * storage.BATCH
        return docs.mapInArrow(sizes, "n long")

    held = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert max(r["n"] for r in corpus_pipeline.bounded(write=True)(stage)(spark, docs, "").collect()) < 2 * storage.BATCH
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == held
    for _, made in corpus_pipeline.STAGES:
        assert made.__wrapped__ and hasattr(made, "written")
    got = common.map_text(docs.limit(5), lambda d, o: {"n": o[1:] - o[:-1]}, "n long", ["doc_id", "text"])
    handed = got._jdf.queryExecution().analyzed().children().head().output().size()
    assert handed == 2 and {(r["text"], r["n"]) for r in got.collect()} == {("some words " * 500, 5500)}
