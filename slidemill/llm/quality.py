"""Operator 6, quality: a sparse ensemble of rules over text statistics.

Statistics of each text are made by numpy in tasks (``STATISTICS``).  A random forest of shallow trees, grown by Spark on a
bounded sample of labelled documents, is taken apart: every path from a root is a rule, a conjunction of bounds on statistics.
Spark's logistic regression with a pure lasso penalty then weighs the rules, most of them 0, and what is left is compiled into
one Spark column over the columns of statistics.

Defined cases: a null, empty or wordless text has statistics 0 and is scored like any other; without labels of both kinds
every score is 1.  Repeated rows are scored each on its own; statistics are of the whole text, however long.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold_of, labelled, map_text, mix, others, words

#: Labelled documents to learn from, at most (about), of each label.
SAMPLE = 4000
TREES, DEPTH, LASSO = 30, 3, 0.002
#: Score from which a document is good.
ACCEPT = 0.7

_KINDS = {
    "letters": np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)]),
    "capitals": np.isin(np.arange(256), range(65, 91)),
    "digits": np.isin(np.arange(256), range(48, 58)),
    "blanks": np.isin(np.arange(256), [9, 10, 13, 32]),
    "lines": np.arange(256) == 10,
    "marks": np.isin(np.arange(256), list(b".,;:'\"()-?")),
    "symbols": np.isin(np.arange(256), list(b"!#$%&*+/<=>@[\\]^_`{|}~")),
    "beyond": np.arange(256) >= 128,
}
STATISTICS = ["log_bytes", "log_words", *_KINDS, "word_bytes", "same_again", "distinct", "distinct_pairs", "top_word", "symbols_by_word"]


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, count of the most frequent one) of each of n documents."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, d[new], np.diff(np.append(new, len(d))))
    return np.bincount(d[new], minlength=n), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """STATISTICS of each text, as shares of its bytes or words where they are no logarithms."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = {"log_bytes": np.log1p(size)}
    for name, member in _KINDS.items():
        running = np.concatenate([[0], np.cumsum(member[data], dtype=np.int64)])
        out[name] = running[offsets[1:]] - running[offsets[:-1]]
    hashes, at = words(data, offsets)
    count = np.diff(at)
    doc = np.repeat(np.arange(n), count)
    by, more = np.maximum(count, 1), np.maximum(count - 1, 1)
    inner = doc[1:] == doc[:-1]
    with np.errstate(over="ignore"):
        both = mix(hashes[:-1] * np.uint64(0x9FB21C651E98DF25) + hashes[1:])[inner]
    out["log_words"] = np.log1p(count)
    out["same_again"] = np.bincount(doc[1:][inner & (hashes[1:] == hashes[:-1])], minlength=n) / more
    one, top = _distinct(doc, hashes, n) if len(hashes) else (np.zeros(n), np.zeros(n))
    two, _ = _distinct(doc[1:][inner], both, n) if len(both) else (np.zeros(n), None)
    out |= {"distinct": one / by, "top_word": top / by, "distinct_pairs": two / more}
    out["word_bytes"] = (out["letters"] + out["digits"]) / by
    out["symbols_by_word"] = out["symbols"] / by
    return {k: (out[k] / np.maximum(size, 1) if k in _KINDS else out[k]).astype(np.float64) for k in STATISTICS}


def with_statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Columns ``carry`` of docs and STATISTICS of column text, as columns __name."""
    return map_text(docs, lambda d, o: {f"__{k}": v for k, v in statistics(d, o).items()}, ", ".join(f"__{k} double" for k in STATISTICS), carry)


#: A bound on a statistic: its name, whether it is an upper bound (<=) or a lower one (>), and the value.
Bound = tuple[str, bool, float]


def rules_of(tree: str) -> list[tuple[Bound, ...]]:
    """The rules of a tree, as Spark prints it: the bounds on the way to each of its nodes but the root."""
    found, way = [], []
    for line in tree.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\w.]+)\)", line):
            depth = len(m[1])
            way = [x for x in way if x[0] < depth] + [(depth, (STATISTICS[int(m[2])], m[3] == "<=", float(m[4])))]
            tight: dict[tuple[str, bool], float] = {}
            for _, (name, upper, value) in way:
                held = tight.get((name, upper), value)
                tight[name, upper] = min(held, value) if upper else max(held, value)
            found.append(tuple(sorted((k[0], k[1], v) for k, v in tight.items())))
    return found


def holds(rule: tuple[Bound, ...]) -> Column:
    out = F.lit(True)
    for name, upper, value in rule:
        out = out & (F.col(f"__{name}") <= value if upper else F.col(f"__{name}") > value)
    return out


@dataclass
class QualityModel:
    """Weighted rules; ``score()`` is their compiled form."""

    intercept: float = 50.0
    rules: list[tuple[tuple[Bound, ...], float]] = field(default_factory=list)

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(rows: DataFrame) -> QualityModel:
    """Learn from (doc_id, text, y); rows must be bounded, as by ``labelled``."""
    # made where the texts are; only the few rows of the sample then come together, in one order
    sample = cut(cut(with_statistics(rows, ["doc_id", "y"])).repartition(1).sortWithinPartitions("doc_id"))
    kinds = {r[0] for r in sample.select("y").distinct().collect()}
    if kinds != {0, 1}:
        return QualityModel(50.0 if kinds != {0} else -50.0)
    train_rows = VectorAssembler(inputCols=[f"__{k}" for k in STATISTICS], outputCol="x").transform(sample).select("x", F.col("y").cast("double").alias("label"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=5, seed=17).fit(train_rows)
    rules = list(dict.fromkeys(r for t in forest.trees for r in rules_of(t.toDebugString)))
    if not rules:
        return QualityModel()
    held = sample.select(F.col("y").cast("double").alias("label"), *(holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    held = cut(VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(held).select("x", "label"))
    lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=LASSO, maxIter=60).fit(held)
    return QualityModel(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w])


def score(docs: DataFrame, model: QualityModel, carry: list[str]) -> DataFrame:
    """Columns ``carry`` of docs with the score of column text and predicted, 1 from ACCEPT on."""
    carry = others(carry, "score double, predicted int")
    return with_statistics(docs, carry).withColumn("__score", model.score()).select(*carry, F.col("__score").alias("score"), (F.col("__score") >= ACCEPT).cast("int").alias("predicted"))


def learned(spark: SparkSession, sf_dir: str, docs: DataFrame) -> QualityModel:
    """The model of the labels of folds other than 2 of 4."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return train(labelled(spark, docs, labels, "quality", 4, 2, SAMPLE))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the quality of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shown = docs.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return score(shown, learned(spark, sf_dir, docs), ["doc_id", "held_out"])
