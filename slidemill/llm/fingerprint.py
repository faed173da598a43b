"""Operator 5, document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint holds the K smallest distinct 64-bit hashes of a text's shingles (five words), ascending, as base64.  Sketches of
parts merge into that of the whole: the K smallest of their union.  From two sketches follow estimates of resemblance
(shared among the K smallest of the union), of containment and of the number of distinct shingles; with fewer than K shingles
all of these are exact.

Defined cases: a null text is empty; texts without words have the empty fingerprint, and two such resemble each other fully;
a text of 1 to 4 words has one shingle.  Equal texts have equal fingerprints; rows repeated count each on its own, and follow
each other in the order of their texts.  Texts count whole, however long.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended, others, pieces, shingles

K = 128
_TOP = float(1 << 64)


def pack(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def unpack(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def smallest(hashes: np.ndarray, k: int = K) -> np.ndarray:
    if len(hashes) > 16 * k:  # the rest can't be among them, unless hashes repeat
        few = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(few) > k:
            return few[:k]
    return np.unique(hashes)[:k]


def sketches(texts: pa.Array, k: int = K) -> Iterator[np.ndarray]:
    for _, data, offsets in pieces(texts):
        for h in shingles(data, offsets):
            yield smallest(h, k)


def merged(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    return np.unique(np.concatenate(parts))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness of two sketches' texts; 1 if neither has a shingle."""
    both = np.sort(np.concatenate([a, b]))
    if not len(both):
        return 1.0
    again = both[1:] == both[:-1]
    first = np.flatnonzero(np.concatenate([[True], ~again]))
    if len(first) <= k:
        return float(again.sum() / len(first))
    return float(again[: first[k] - 1].sum() / k)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / _TOP)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's distinct shingles that b has too; 1 if a has none."""
    if not len(a):
        return 1.0
    share = resemblance(a, b, k)
    return min(1.0, share * distinct(merged([a, b], k), k) / distinct(a, k))


def fingerprint(docs: DataFrame, carry: list[str], k: int = K) -> DataFrame:
    """Columns ``carry`` of docs with fingerprint and n_distinct (estimated) of column text."""
    added = "fingerprint string, n_distinct double"
    carry = others(carry, added)

    def run(batches):
        for batch in batches:
            got = list(sketches(batch.column(len(carry)), k))
            made = [pa.array([pack(x) for x in got], pa.string()), pa.array([distinct(x, k) for x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *made], [*carry, "fingerprint", "n_distinct"])

    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(run, extended(docs.select(*carry).schema, added))


def merge(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """(key, fingerprint) of wholes from the fingerprints of their parts; null fingerprints are empty.

    Each task first merges what it has of a key, so that of a frequent key one row a task is shuffled; then rows of a key follow
    each other and are merged as they come.
    """
    kind = parts.schema[key].dataType.simpleString()

    def local(batches):
        held: dict = {}
        for batch in batches:
            for x, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = unpack(f or "")
                held[x] = merged([held[x], one], k) if x in held else one
            if len(held) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), batch.column(0).type), pa.array(map(pack, held.values()), pa.string())], [key, "fingerprint"])
                held = {}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), batch.column(0).type), pa.array(map(pack, held.values()), pa.string())], [key, "fingerprint"])

    def final(frames):
        at, now = None, None
        for frame in frames:
            out: list[tuple] = []
            for x, f in zip(frame[key], frame["fingerprint"], strict=True):
                x = None if pd.isna(x) else x
                if now is not None and x == at:
                    now = merged([now, unpack(f)], k)
                    continue
                if now is not None:
                    out.append((at, pack(now)))
                at, now = x, unpack(f)
            yield pd.DataFrame(out, columns=[key, "fingerprint"])
        if now is not None:
            yield pd.DataFrame([(at, pack(now))], columns=[key, "fingerprint"])

    shape = f"`{key}` {kind}, fingerprint string"
    return parts.select(key, "fingerprint").mapInArrow(local, shape).repartition(F.col(key)).sortWithinPartitions(key).mapInPandas(final, shape)


def in_order(docs: DataFrame, key: str) -> DataFrame:
    """Rows (key, text) of docs in runs: by column __run in ascending order of key and text, each partition sorted.

    After the rows of a run comes the first row of the next one with __after true (after the last run: the very first row), so
    that every row meets its successor in its own partition.  Runs are bounded by quantiles of the key, and there are eight for
    each shuffle partition.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key), F.coalesce(F.col(key), F.lit(-(1 << 63))).alias("__key"), F.coalesce("text", F.lit("")).alias("text"))
    n = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx("__key", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    cuts = np.unique(np.array(bounds, np.int64))

    @F.pandas_udf("int")
    def run_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, x.to_numpy(), "right").astype(np.int32))

    rows = rows.withColumn("__run", run_of("__key"))
    first = {r[0]: r[1] for r in rows.groupBy("__run").agg(F.min("__key")).collect()}  # a row for each run
    runs = sorted(first)
    heads = spark.createDataFrame([(runs[i - 1], first[r]) for i, r in enumerate(runs)], "__before int, __key long")
    after = rows.drop("__run").join(F.broadcast(heads), "__key").groupBy("__before").agg(F.min(F.struct("text", key)).alias("x"))
    after = after.select(F.col(f"x.{key}").alias(key), "x.text", F.col("__before").alias("__run"), F.lit(True).alias("__after"))
    every = rows.select(key, "text", "__run", F.lit(False).alias("__after")).unionByName(after)
    return every.repartition(n // 8, "__run").sortWithinPartitions("__run", "__after", F.col(key).asc_nulls_first(), "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: fingerprints of every document and of its edited text: its end replaced by the beginning of the next document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = None  # run, doc_id, text and sketch of the row before
        for batch in batches:
            ids, runs, after = (batch.column(c).to_pylist() for c in ("doc_id", "__run", "__after"))
            texts = batch.column("text").to_pylist()
            own = sketches(batch.column("text"))
            found = []  # (doc_id, text, sketch, edited text, the next sketch)
            for i, r, last, text, sketch in zip(ids, runs, after, texts, own, strict=True):
                if held and held[0] == r:
                    half = len(held[2]) // 2
                    found.append((held[1], held[2], held[3], held[2][: len(held[2]) - half] + text[:half], sketch))
                held = None if last else (r, i, text, sketch)
            edited = pa.array([x[3] for x in found], pa.large_string())
            out: list[list] = [[] for _ in names]
            for (i, text, sketch, other, after_it), new in zip(found, sketches(edited), strict=True):
                for c, v in zip(out, (i, len(text), hashlib.sha256(other.encode()).hexdigest(), pack(sketch), pack(new), resemblance(sketch, new), resemblance(sketch, after_it)), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    shape = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, "doc_id").mapInArrow(run, shape)
