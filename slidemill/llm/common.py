"""What several operators share: checkpoints, bounded label samples, batches of text as bytes, word and shingle hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import checkpoint_dir, cut, small_batches, written  # noqa: F401

#: Bytes of text that numpy handles at a time; a longer document is a piece of its own.
PIECE = 1 << 18


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; a null id has the fold of the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def bounded_sample(df: DataFrame, bound: int, strata: str | None = None, salt: int = 7) -> DataFrame:
    """Rows of df (unique doc_id), about ``bound`` at most (of each stratum), chosen by a hash of doc_id alone.

    The share kept follows from a count over all rows, so that the sample spreads over the whole table.
    """
    unit = F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    if strata is None:
        n = df.count()
        return df if n <= bound else df.filter(unit < bound / n)
    counts = {r[0]: r[1] for r in df.groupBy(strata).count().collect()}
    over = {k: bound / n for k, n in counts.items() if n > bound}
    share = F.lit(1.0)
    for k, v in over.items():
        share = F.when(F.col(strata) == F.lit(k), F.lit(v)).otherwise(share)
    return df.filter(unit < share) if over else df


def labelled(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, bound: int) -> DataFrame:
    """(doc_id, text, y) of the labelled rows to learn from: fold ``held`` left out, ``bound`` rows at most for each label value.

    Repeated labels of one document count as the larger.  The sampled ids are few by construction, so they are broadcast
    and the text is filtered where it is scanned, without a shuffle.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), folds) != held)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    few = bounded_sample(known, bound, "y")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of about PIECE bytes of a string column; nulls are empty."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        chunk = chunk.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(chunk.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(chunk):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
            j = min(j, len(chunk))
            yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


_MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        m = min(done, n - done)
        with np.errstate(over="ignore"):
            out[done : done + m] = out[:m] * np.uint64(step)
        step = step * step & _MASK
        done += m
    return out


class Powers:
    """Powers of an odd base and of its inverse mod 2**64, made once in a process for pieces of usual size; a longer text has its own, which are not kept."""

    up = _powers(BASE, 1)
    down = _powers(INVERSE, 1)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > 2 * PIECE:
            return _powers(BASE, n), _powers(INVERSE, n)
        if len(cls.up) < n:
            cls.up, cls.down = _powers(BASE, 2 * PIECE), _powers(INVERSE, 2 * PIECE)
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Random 64-bit value of each byte, from splitmix64 of the byte.
BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
#: Bytes of words: digits, letters (A-Z as a-z) and what is not ASCII; 0 for the rest.
FOLD = np.zeros(256, np.uint8)
FOLD[48:58] = np.arange(48, 58)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def words(data: np.ndarray, offsets: np.ndarray, stem: int = 0) -> tuple[np.ndarray, ...]:
    """(64-bit hash of each word, number of words up to each offset).  Words are runs of digits, letters and non-ASCII bytes, case of A-Z ignored.

    With ``stem``, a third array has the hash of each word's first ``stem`` bytes.
    """
    n = len(data)
    if not n:
        return (np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))[: 2 + bool(stem)]
    folded = FOLD[data]
    inside = folded > 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = Powers.of(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(np.where(inside, BYTE[folded], np.uint64(0)) * up[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts])
        if stem:
            return hashes, np.searchsorted(starts, offsets), mix((sums[np.minimum(ends, starts + stem)] - sums[starts]) * down[starts])
    return hashes, np.searchsorted(starts, offsets)


#: Words in a shingle.
WIDTH = 5


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each document the 64-bit hashes of its word shingles, in order.

    A document of fewer than ``width`` words, but one at least, has one shingle: all its words.  One without words has none.
    """
    hashes, at = words(data, offsets)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    full = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            full += hashes[j : j + len(full)] * factors[j]
        full = mix(full)
        out = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= width:
                out.append(full[a : b - width + 1])
            elif b > a:
                out.append(mix(np.array([(hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def extended(schema: StructType, added: str) -> StructType:
    """A schema with columns, given as DDL, added at its end."""
    return StructType([*schema.fields, *StructType.fromDDL(added).fields])


def others(carry: list[str], added: str) -> list[str]:
    """Columns to carry along, but for those whose names are among the columns added (DDL): an added column takes the place of its namesake."""
    new = set(StructType.fromDDL(added).names)
    return [c for c in carry if c not in new]


def map_text(df: DataFrame, score: Callable[[np.ndarray, np.ndarray], dict[str, object]], schema: str, carry: list[str]) -> DataFrame:
    """Apply ``score(bytes, offsets) -> column name: values`` to column text of df, batch by batch; columns ``carry`` go along (see ``others``).

    ``schema`` is that of the added columns.  A text that goes along itself is handed over once.
    """
    carry, added = others(carry, schema), StructType.fromDDL(schema).names
    shape = extended(df.select(*carry).schema, schema)
    at = carry.index("text") if "text" in carry else len(carry)

    def run(batches):
        for batch in batches:
            parts: dict[str, list] = {k: [] for k in added}
            for _, data, offsets in pieces(batch.column(at)):
                got = score(data, offsets)
                for k in added:
                    parts[k].append(got[k])
            columns = [batch.column(i) for i in range(len(carry))]
            for k in added:
                whole = parts[k]
                if whole and isinstance(whole[0], np.ndarray):
                    columns.append(pa.array(np.concatenate(whole)))
                else:
                    columns.append(pa.array([x for part in whole for x in part]))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(columns, [*carry, *added])

    return df.select(*carry, *([] if at < len(carry) else ["text"])).mapInArrow(run, shape)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """(intercept, weights) of a logistic regression by Newton's method, with a ridge on the weights in units of each column's spread."""
    scale = x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), x / scale])
    b, penalty = np.zeros(z.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return np.concatenate([b[:1], b[1:] / scale])
