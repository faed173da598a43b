"""A corpus pipeline: reject poor documents, keep one of near-duplicates, remove repeated strings, mix to target weights, encode.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again before the next one.  All
but the last return the columns that they were given.  Python workers have batches of 4 MB in all of them (``bounded``).  Documents of null text count as empty ones in every stage.  Empty tables
stay empty, columns of other names go along, and rows that repeat are treated as the stage's operator says.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidemill.llm import bpe, common, minhash, mixing, quality, repeats


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(write: bool) -> Callable[[Stage], Stage]:
    """A stage whose jobs hand texts to Python workers in small batches, whatever the session has; with ``write`` its result is written, so that its last job does too."""

    def of(stage: Stage) -> Stage:
        @wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            with common.small_batches(spark):
                found = stage(spark, docs, sf_dir)
                return common.written(found) if write else found

        run.written = write
        return run

    return of


@bounded(write=True)
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of documents that came in."""
    model = quality.learned(spark, sf_dir, docs)
    kept = [c for c in docs.columns if c != "text"]
    # other columns go along as one, so that none clashes with those of the score
    shown = docs.select(*([F.struct(*(docs[c] for c in kept)).alias("__row")] if kept else []), "text")
    found = quality.score(shown, model, shown.columns).filter("predicted = 1")
    return found.select(*(F.col("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns))


@bounded(write=False)
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id, of rows that share it the one of the smallest text."""
    return minhash.keep_one(docs)


@bounded(write=True)
def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of strings of repeats.PASSAGE bytes, which a passage of fifty-one words hardly ever falls short of; n_chars follows.  Documents of which nothing is left go."""
    left = repeats.without_repeats(docs, width=repeats.PASSAGE, gram=repeats.PASSAGE // 3)
    if "n_chars" in left.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.filter(F.length("text") > 0)


@bounded(write=False)
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn so that tokens by source, language and topic have their target shares, as far as scarce cells go; the share mixing.KEPT of all tokens."""
    return mixing.mix(docs).select(*docs.columns)


@bounded(write=True)
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with their number and hashes."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id", "lang", "source"], ids=True)


STAGES = [("quality classifier", good), ("minhash near-dedup", distinct), ("suffix-array dedup", unrepeated), ("mixing", mixed), ("bpe encoding", encoded)]

#: The classifier, signatures and suffix arrays are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        found = stage(spark, docs, sf_dir)
        docs = found if stage.written else common.written(found)
    return docs
