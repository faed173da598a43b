"""Operator 1, approximate nearest neighbours by randomly rotated one-bit codes.

Rows belong to the nearest of a few centroids, fitted on a bounded sample.  What a row r differs from its centroid, its residual, is
turned into at least ``CODE`` coordinates by a random matrix of orthonormal columns (the same one for all) and kept as their signs,
packed into 64-bit words, with two scalars: its length and the cosine between the turned residual and the unit vector of its signs.
A query q is turned likewise and rounded to ``LEVELS`` steps, whose bits are packed into planes.  Counts of the bits that planes and
codes share give <turned q, signs>, which divided by the cosine estimates <q, r> without bias, within
|q| |r| sqrt((1 - cosine^2) / cosine^2) * EPS / sqrt(bits - 1), and what the rounding may add, with high probability.  <q, v> is that
and <q, centroid>.

Rows of a centroid are packed into blocks of bounded size, and every block of queries meets every block of rows in some slot.  A slot
keeps the best ``top`` rows of each query as it goes from block to block.  A block whose centroid and radius put it below the
worst of these is skipped for that query; in others the rows of the best estimates are scored exactly, in double precision on the
original vectors, then those whose upper bound reaches the worst of the best.  Best rows of slots meet by query.  Nothing depends on how
rows are distributed, so that many equal vectors do no harm.

Defined cases: vectors that are null, of another length than most (``dim``), zero, or hold null or non-finite components take
no part.  Ties go to the smaller id.  Where an id is repeated each of its rows is a candidate for other ids, and is searched for
on its own under the same query_id.  An empty table gives no rows.  Only the two named columns are read, whatever others are there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows and queries in a block.
ROWS, QUERIES = 8192, 512
#: Rows of the sample on which centroids are fitted, their number at most (one for each ``ROWS`` rows), and rounds of fitting.
SAMPLE, CENTROIDS, FITS = 8192, 256, 5
#: Bits of a code, or as many as a vector has components if these are more; bits to which a query's coordinates are rounded.
CODE, LEVELS = 768, 3
#: Width of the error bound, in standard deviations of the estimate.
EPS = 3.5
SEED = 20


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random matrix of dim rows, orthonormal ones, and as many columns as a code has bits."""
    bits = max(CODE, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dim)))
    return (q * np.sign(np.diag(r))).T


def encode(residuals: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signs packed into words of 64 bits, a column for each row, lengths, cosines) of the rows of a matrix; a row of zeros has cosine 1."""
    turned = residuals @ turn
    length = np.sqrt((turned * turned).sum(axis=1))
    cosine = np.where(length > 0, np.abs(turned).sum(axis=1) / (np.sqrt(turned.shape[1]) * np.where(length > 0, length, 1)), 1.0)
    return np.ascontiguousarray(np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64).T), length, cosine


def planes(query: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(planes of the bits of a turned query's steps, least coordinate, size of a step)."""
    turned = query @ turn
    low, step = turned.min(), max(float(np.ptp(turned)), 1e-300) / ((1 << LEVELS) - 1)
    steps = np.rint((turned - low) / step).astype(np.uint8)
    return np.stack([np.packbits((steps >> k) & 1, bitorder="little").view(np.uint64) for k in range(LEVELS)]), low, step


def estimates(codes: tuple[np.ndarray, np.ndarray, np.ndarray], ones: np.ndarray, query: np.ndarray, turn: np.ndarray, eps: float = EPS) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products with residuals, error bounds) of one query, from packed bits; ones: bits that are set in each code."""
    packed, length, cosine = codes
    plane, low, step = planes(query, turn)
    bits = turn.shape[1]
    shared = np.zeros(packed.shape[1], np.uint32)
    for k in range(LEVELS):
        shared += np.bitwise_count(packed & plane[k][:, None]).sum(axis=0, dtype=np.uint32) << np.uint32(k)
    # <turned, signs> = 2 * (sum over set bits) - (sum over all)
    every = low * bits + step * sum(float(1 << k) * int(np.bitwise_count(plane[k]).sum()) for k in range(LEVELS))
    product = 2 * (low * ones + step * shared) - every
    scale = length / (cosine * np.sqrt(bits))
    size = np.sqrt(query @ query)
    spread = size * length * np.sqrt(np.maximum(1 - cosine**2, 0)) / cosine / np.sqrt(max(bits - 1, 1))
    rounding = scale * step * np.sqrt(bits / 12.0)
    return product * scale, eps * np.sqrt(spread**2 + rounding**2) + 1e-9 * size * length


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of a and b, summed from the first component to the last."""
    return np.add.reduce(np.ascontiguousarray((a * b).T), axis=0)


def valid(column: Column, dim: int | None = None) -> Column:
    """Whether a vector takes part."""
    v = column.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine & (F.size(v) == dim if dim else F.size(v) > 0), F.lit(False))


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Places of each query's best rows."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < top]


def fitted(sample: np.ndarray, centroids: int = CENTROIDS, rounds: int = FITS) -> np.ndarray:
    """Centroids of a sample, by a few rounds of k-means from rows chosen at random; none of no rows."""
    if not len(sample):
        return sample
    at = np.random.default_rng(SEED).permutation(len(sample))[: max(1, min(centroids, len(sample) // 32))]
    found = sample[np.sort(at)].copy()
    for _ in range(rounds):
        own = nearest(sample, found)
        for k in range(len(found)):
            if (own == k).any():
                found[k] = sample[own == k].mean(axis=0)
    return found


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroid to which each row is nearest."""
    return (rows @ centroids.T - (centroids * centroids).sum(axis=1) / 2).argmax(axis=1)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _assigned(df: DataFrame, dim: int, centroids: np.ndarray) -> DataFrame:
    """(id, v, list) of rows (id, v): list is the nearest centroid's number."""

    def run(batches):
        for batch in batches:
            own = nearest(_vectors(batch.column(1), dim), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32))], ["id", "v", "list"])

    return df.mapInArrow(run, f"id long, v {df.schema['v'].dataType.simpleString()}, list int")


def _packed(df: DataFrame, size: int, dim: int, wide: bool, centroids: np.ndarray | None = None) -> DataFrame:
    """(ids, vectors, list, codes, lengths, cosines) with ``size`` rows at most, of one list, packed into each; queries, packed without centroids, have no codes."""
    kind = np.float64 if wide else np.float32

    def block(ids, vectors, own):
        parts = [ids, vectors.astype(kind)]
        parts += encode(vectors - centroids[own], rotation(dim)) if centroids is not None else (np.zeros(0),) * 3
        data = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts]
        return pa.RecordBatch.from_arrays([*data[:2], pa.array([own], pa.int32()), *data[2:]], ["ids", "vectors", "list", "codes", "lengths", "cosines"])

    def run(batches):
        ids, rows, lists = np.zeros(0, np.int64), np.zeros((0, dim)), np.zeros(0, np.int64)
        for batch in batches:
            ids = np.concatenate([ids, batch.column(0).to_numpy().astype(np.int64)])
            rows = np.concatenate([rows, _vectors(batch.column(1), dim)])
            lists = np.concatenate([lists, batch.column(2).to_numpy().astype(np.int64)])
            while len(ids) and (len(ids) >= size or lists[0] != lists[-1]):
                n = min(size, int(np.searchsorted(lists, lists[0], "right")))
                yield block(ids[:n], rows[:n], int(lists[0]))
                ids, rows, lists = ids[n:], rows[n:], lists[n:]
        if len(ids):
            yield block(ids, rows, int(lists[0]))

    return df.mapInArrow(run, "ids binary, vectors binary, list int, codes binary, lengths binary, cosines binary")


def index(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", dim: int | None = None) -> tuple[DataFrame, int, np.ndarray]:
    """The table of packed blocks of all vectors that take part, written to the shared folder, their number of components, and the centroids."""
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & valid(F.col("v"), dim))
    if dim is None:
        common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        dim = common["n"] if common else 1
        rows = rows.filter(F.size("v") == dim)
    n = rows.count()
    few = rows.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(SAMPLE).toArrow()  # of a size that does not depend on the table's
    centroids = fitted(_vectors(few.column("v").combine_chunks(), dim) if len(few) else np.zeros((0, dim)), min(CENTROIDS, n // ROWS))
    if not len(centroids):
        centroids = np.zeros((1, dim))
    # a list of very many rows is dealt to several tasks, each of which packs whole blocks of it
    placed = _assigned(rows, dim, centroids)
    counts = placed.groupBy("list").agg(F.ceil(F.count("*") / (8 * ROWS)).alias("parts"))
    placed = placed.join(F.broadcast(counts), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))  # counts: a row for each centroid
    ordered = placed.repartition("list", "part").sortWithinPartitions("list").select("id", "v", "list")
    wide = "double" in dict(vectors.dtypes)[vector]
    return cut(_packed(ordered, ROWS, dim, wide, centroids).withColumn("block", F.monotonically_increasing_id())), dim, centroids


class Best:
    """The best rows so far of each query of a block, and how many rows have been seen and scored exactly."""

    def __init__(self, n: int, top: int):
        self.top, self.seen, self.scored = top, 0, 0
        self.query, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.needed = np.full(n, -np.inf)

    def meet(self, queries: np.ndarray, query_ids: np.ndarray, turn: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: tuple, centroid: np.ndarray) -> None:
        """Take what a block of rows has to give."""
        ones = np.bitwise_count(codes[0]).sum(axis=0, dtype=np.uint32).astype(np.float64)
        at_center = queries @ centroid
        size = np.sqrt((queries * queries).sum(axis=1))
        self.seen += len(queries) * len(ids)
        pairs, scores, rows = [self.query], [self.scores], [self.ids]
        for i in np.flatnonzero(at_center + size * codes[1].max() * (1 + 1e-9) >= self.needed):
            guess, error = estimates(codes, ones, queries[i], turn)
            guess += at_center[i]
            guess[ids == query_ids[i]] = -np.inf
            likely = guess.argpartition(-self.top)[-self.top :] if len(guess) > self.top else np.arange(len(guess))
            likely = likely[guess[likely] + error[likely] >= self.needed[i]]
            first = exact(np.broadcast_to(queries[i], (len(likely), len(centroid))), vectors[likely])
            least = max(self.needed[i], first[np.isfinite(guess[likely])].min() if np.isfinite(guess[likely]).sum() == self.top else -np.inf)
            chosen = np.flatnonzero((guess + error >= least) & (guess > -np.inf))
            score = exact(np.broadcast_to(queries[i], (len(chosen), len(centroid))), vectors[chosen])
            self.scored += len(chosen)
            good = score >= least
            pairs.append(np.full(good.sum(), i))
            scores.append(score[good])
            rows.append(ids[chosen[good]])
        self.query, self.scores, self.ids = (np.concatenate(x) for x in (pairs, scores, rows))
        kept = _best(self.query, self.ids, self.scores, self.top)
        self.query, self.scores, self.ids = self.query[kept], self.scores[kept], self.ids[kept]
        full = np.bincount(self.query, minlength=len(queries)) >= self.top
        worst = np.full(len(queries), np.inf)
        np.minimum.at(worst, self.query, self.scores)
        self.needed = np.where(full, worst, -np.inf)


def search(vectors: DataFrame, queries: DataFrame, top: int = 20, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, <id>, score): for each query its ``top`` rows of largest inner product but for those of its own id."""
    spark = vectors.sparkSession
    blocks, dim, centroids = index(vectors, id, vector)
    wide = "double" in dict(vectors.dtypes)[vector]
    kind = np.float64 if wide else np.float32
    asked = queries.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & valid(F.col("v"), dim))
    asked = cut(_packed(asked.withColumn("list", F.lit(0)), QUERIES, dim, wide).select(F.monotonically_increasing_id().alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")))
    # each block of queries goes to every slot, each block of rows to one
    slots = max(1, min(blocks.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed = blocks.withColumn("slot", F.pmod(F.col("block"), F.lit(slots)))
    met = asked.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")))).join(placed.hint("shuffle_hash"), "slot")

    def run(batches):
        turn = rotation(dim)
        at, best, q, q_ids = None, None, None, None

        def found():
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(best.ids), at, np.int64)), pa.array(best.query.astype(np.int32)), pa.array(q_ids[best.query]), pa.array(best.ids), pa.array(best.scores)], ["q_block", "place", "query_id", "found", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["q_block"] != at:  # the blocks of rows of a slot come together, for one block of queries after the other
                    if at is not None:
                        yield found()
                    at, q_ids = r["q_block"], np.frombuffer(r["q_ids"], np.int64)
                    q = np.frombuffer(r["q_vectors"], kind).reshape(-1, dim).astype(np.float64)
                    best = Best(len(q), top)
                ids = np.frombuffer(r["ids"], np.int64)
                v = np.frombuffer(r["vectors"], kind).reshape(-1, dim).astype(np.float64)
                codes = np.frombuffer(r["codes"], np.uint64).reshape(-1, len(ids)), np.frombuffer(r["lengths"]), np.frombuffer(r["cosines"])
                best.meet(q, q_ids, turn, ids, v, codes, centroids[r["list"]])
        if at is not None:
            yield found()

    found = met.mapInArrow(run, "q_block long, place int, query_id long, found long, score double")
    rank = F.row_number().over(Window.partitionBy("q_block", "place").orderBy(F.desc("score"), "found"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", F.col("found").alias(id), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the 20 nearest vectors to each vector whose id is divisible by 20."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(table, table.filter(F.col("vec_id") % 20 == 0))


#: DuckDB's rows for op1.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
