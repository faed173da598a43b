"""Operator 7, language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams of lower-cased characters are gathered in tasks and summed by Spark; the log-probability
matrix (2**16 buckets by languages, float32) is broadcast and batches are scored with sparse gathers in numpy.

Defined cases: a null text, and one without any letter, has language ``und`` and score 0; languages to learn are the non-null
values of ``lang``; with nothing to learn from, every document is ``und``.  Repeated rows are scored each on its own; ties go
to the language whose name comes first.  A long text is scored whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, extended, fold_of, others

BITS = 16
#: Documents of each language to learn from, at most (about).
SAMPLE = 3000
_ADDED = "lang_pred string, score double"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def grams(text: str) -> np.ndarray:
    """Buckets of the 1-, 2- and 3-grams of a text's characters, lower-cased, with a blank before and after; what is no letter is a blank."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ascii_other = (codes < 128) & ~((codes >= 97) & (codes <= 122))
    codes[ascii_other] = 32
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep]
    shift = np.uint32(32 - BITS)
    with np.errstate(over="ignore"):
        one = codes * _FACTORS[0]
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _FACTORS[1] + codes[1:] * _FACTORS[2]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _FACTORS[1] + codes[2:] * _FACTORS[2]
    return np.concatenate([(x * _FACTORS[2]) >> shift for x in (one, two, three)])


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    matrix: np.ndarray  # buckets x languages, float32, log probabilities
    prior: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, sure = [], []
        for text in texts:
            if not text or not self.languages or not has_letter(text):
                names.append("und")
                sure.append(0.0)
                continue
            total = self.prior.copy()
            found = grams(text)
            for i in range(0, len(found), 1 << 18):  # rows of the matrix for some grams at a time
                total += self.matrix[found[i : i + (1 << 18)]].sum(axis=0, dtype=np.float64)
            best = int(total.argmax())
            names.append(self.languages[best])
            sure.append(float(1 / np.exp(np.minimum(total - total[best], 0)).sum()))
        return names, sure


def train(docs: DataFrame, sample: int = SAMPLE, smoothing: float = 0.05) -> LanguageModel:
    """Learn from columns doc_id, text and lang of docs (rows with null lang or text are left out)."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    index = {x: i for i, x in enumerate(languages)}

    def count(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                k = index.get(lang)
                if k is not None:
                    held.setdefault(k, np.zeros(1 << BITS, np.int64))
                    held[k] += np.bincount(grams(text), minlength=1 << BITS)
        for k, v in held.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(v[at])], ["k", "bucket", "n"])

    few = bounded_sample(known, sample, "lang") if languages else known
    table = few.mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((1 << BITS, len(languages)))
    if languages:
        got = table.toArrow()  # languages x 2**16 rows at most
        counts[got.column("bucket").to_numpy(), got.column("k").to_numpy()] = got.column("n").to_numpy()
    logs = np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * (1 << BITS)))
    total = sum(sizes.values())
    prior = np.array([math.log(sizes[x] / total) for x in languages])
    return LanguageModel(languages, logs.astype(np.float32), prior)


def identify(spark: SparkSession, docs: DataFrame, model: LanguageModel, carry: list[str]) -> DataFrame:
    """Columns ``carry`` of docs with lang_pred and score for column text."""
    carry = others(carry, _ADDED)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names, sure = held.value.scores(batch.column(len(carry)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(names, pa.string()), pa.array(sure, pa.float64())], [*carry, "lang_pred", "score"])

    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(run, extended(docs.select(*carry).schema, _ADDED))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the language of every document, learned from the folds other than 1 of 3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.filter(fold_of(F.col("doc_id"), 3) != 1))
    shown = docs.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return identify(spark, shown, model, ["doc_id", "held_out"])
