"""Operator 9, near-duplicates: BagMinHash signatures, banding, exact check of the multiset overlap, connected groups.

A text is the multiset of its shingles (five words), a shingle's weight its count.  For every shingle and every dyadic interval
of weights [0,1), [1,2), [2,4), ... a Poisson process, seeded by both, makes points in time with a signature slot and a weight
level each; a text sees the points whose level lies below its weight.  The first point that it sees in a slot is the slot's
value; two texts agree in a slot with the probability of their weighted Jaccard likeness.  Points are made in order of time and
only up to the time at which all slots are filled, so that a long text costs no more than a short one beyond its first points.

Texts of equal multisets become one node.  Nodes that agree in a band meet in its bucket.  There each is checked against one
leader, the node that meets most others in all its buckets, by exact overlap of multisets.  Nodes that stay outside of their
leader's component are then compared, a block at a time, with all that the leader has met, so that no link of a bucket is lost,
whatever its size: nothing is capped, and of a block of pairs only links that join components leave the task.

Defined cases: a null text is empty; a text of 1 to 4 words has one shingle; texts without words are near each other only if they
are equal.  Rows that repeat are in one group.  A null id is allowed; a group's class_id is its smallest id that is not null.
Ties in choosing a leader go to the smaller node.  Texts count whole, however long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix, pieces, shingles

#: Slots in a band, and bands: likeness 0.8 meets in none with probability 6e-6.
IN_BAND, BANDS = 5, 30
SLOTS = IN_BAND * BANDS
#: Likeness from which texts are near-duplicates.
NEAR = 0.8
#: Texts that are compared to a leader in one run.
RUN = 200
#: Nodes in a block.
BLOCK = 256
#: Rows up to which the table of documents to remove is broadcast; a larger one is joined by shuffling.
SMALL = 100_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def bags(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct shingles, counts) of each text."""
    return [np.unique(h, return_counts=True) for h in shingles(data, offsets)]


def node_of(bag: tuple[np.ndarray, np.ndarray], text: np.ndarray) -> int:
    """A 64-bit name of a multiset; of the bytes themselves where there is none."""
    h, n = bag
    with np.errstate(over="ignore"):
        if len(h):
            return int(mix(mix(h) * _A + mix(n.astype(np.uint64)) * _B).sum(dtype=np.uint64).astype(np.int64))
        place = np.arange(1, len(text) + 1, dtype=np.uint64)
        return int(mix(np.array([(mix(text + place * _A)).sum(dtype=np.uint64) + _C], np.uint64))[0].astype(np.int64))


def signatures(found: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """The slots of each multiset, one row for each; a row of zeros for an empty one."""
    n = len(found)
    first = np.full(n * slots, np.inf)
    value = np.zeros(n * slots, np.uint64)
    doc = np.repeat(np.arange(n), [len(h) for h, _ in found])
    if not len(doc):
        return value.reshape(n, slots)
    shingle = np.concatenate([h for h, _ in found])
    weight = np.concatenate([c for _, c in found]).astype(np.float64)
    total = np.bincount(doc, weight, n)
    until = slots * (np.log(slots) + 4) / np.maximum(total, 1)
    # the intervals of weight that each shingle reaches into
    parts, low = [(doc, shingle, weight, np.zeros(len(doc)), np.ones(len(doc)))], 1.0
    while (more := weight > low).any():
        parts.append((doc[more], shingle[more], weight[more], np.full(more.sum(), low), np.full(more.sum(), low)))
        low *= 2
    doc, shingle, weight, base, width = (np.concatenate(x) for x in zip(*parts, strict=True))
    with np.errstate(over="ignore"):
        state = mix(shingle * _A + base.astype(np.uint64) * _B + _C)
        time = np.zeros(len(doc))
        waiting = np.arange(len(doc))  # processes that may have points yet
        while len(waiting):
            # one more point of each process
            s = state[waiting] = mix(state[waiting] + _A)
            t = time[waiting] - np.log(((s >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / width[waiting]
            time[waiting] = t
            early = t <= until[doc[waiting]]
            at, t = waiting[early], t[early]
            point = mix(state[at] ^ _B)
            slot = ((point >> np.uint64(32)) % np.uint64(slots)).astype(np.int64) + doc[at] * slots
            level = base[at] + width[at] * ((point & np.uint64(0xFFFFFFFF)).astype(np.float64) / (1 << 32))
            seen = level < weight[at]
            slot, t, point = slot[seen], t[seen], point[seen]
            np.minimum.at(first, slot, t)
            won = first[slot] == t
            value[slot[won]] = point[won]
            waiting = at
            if not len(waiting):
                # texts with slots still empty go on for twice the time; a process goes on with its last point not yet used
                empty = np.isinf(first.reshape(n, slots)).any(axis=1) & (total > 0)
                if empty.any():
                    return _again(found, value, empty, slots)
    return value.reshape(n, slots)


def _again(found, value: np.ndarray, empty: np.ndarray, slots: int) -> np.ndarray:
    """Fill the rows that are not full, each for as long as it takes."""
    out = value.reshape(len(found), slots)
    for i in np.flatnonzero(empty):
        h, c = found[i]
        out[i] = _full(h, c.astype(np.float64), slots)
    return out


def _full(h: np.ndarray, c: np.ndarray, slots: int) -> np.ndarray:
    """One signature, made without a limit known beforehand."""
    first, value = np.full(slots, np.inf), np.zeros(slots, np.uint64)
    parts, low = [(h, c, np.zeros(len(h)), np.ones(len(h)))], 1.0
    while (more := c > low).any():
        parts.append((h[more], c[more], np.full(more.sum(), low), np.full(more.sum(), low)))
        low *= 2
    h, c, base, width = (np.concatenate(x) for x in zip(*parts, strict=True))
    with np.errstate(over="ignore"):
        state, time, on = mix(h * _A + base.astype(np.uint64) * _B + _C), np.zeros(len(h)), np.arange(len(h))
        while len(on):
            s = state[on] = mix(state[on] + _A)
            time[on] -= np.log(((s >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / width[on]
            on = on[time[on] <= first.max()]
            point = mix(state[on] ^ _B)
            slot = ((point >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)
            seen = base[on] + width[on] * ((point & np.uint64(0xFFFFFFFF)).astype(np.float64) / (1 << 32)) < c[on]
            t, slot, point = time[on][seen], slot[seen], point[seen]
            np.minimum.at(first, slot, t)
            won = first[slot] == t
            value[slot[won]] = point[won]
    return value


def bands(slots: np.ndarray) -> np.ndarray:
    """Hash of each band of each signature; the band's number is part of it."""
    with np.errstate(over="ignore"):
        parts = slots.reshape(len(slots), BANDS, IN_BAND)
        odd = mix(np.arange(1, IN_BAND + 1, dtype=np.uint64)) | np.uint64(1)
        return mix((mix(parts) * odd).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _A)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard likeness of two multisets; 1 if both are empty."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (total - shared)


def signed(docs: DataFrame, id: str) -> DataFrame:
    """(id, th, node, bands) of each row; bands are null without words."""

    def run(batches):
        for batch in batches:
            nodes, many = [], []
            for _, data, offsets in pieces(batch.column(1)):
                found = bags(data, offsets)
                nodes += [node_of(b, data[i:j]) for b, i, j in zip(found, offsets[:-1], offsets[1:], strict=True)]
                keys = bands(signatures(found)).view(np.int64)
                many += [keys[k] if len(h) else None for k, (h, _) in enumerate(found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(many, pa.list_(pa.int64()))], ["id", "th", "node", "bands"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).mapInArrow(run, f"id {kind}, th long, node long, bands array<long>")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id: str, near: float = NEAR) -> DataFrame:
    """(a, b, likeness) of those pairs (a, b) of nodes that are near by exact count; nodes: (node, id of one of its texts).

    A text a goes along with ``RUN`` partners, about, so that a text with very many of them is dealt to many tasks.
    """
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / RUN).alias("runs"))
    asked = pairs.join(runs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("runs")).alias("run"), "b")
    heads = runs.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run"), F.col("a").alias("b"))
    wanted = asked.withColumn("head", F.lit(False)).unionByName(heads.withColumn("head", F.lit(True)))
    met = _with_texts(wanted, "b", nodes, docs, id)
    met = met.repartition("a", "run").sortWithinPartitions("a", "run", F.desc("head"))

    def run(batches):
        head, at = None, None
        for batch in batches:
            a, part, first, b = (batch.column(k).to_pylist() for k in ("a", "run", "head", "b"))
            out: list[list] = [[], [], []]
            for i, data, offsets in pieces(batch.column("text")):
                for k, bag in enumerate(bags(data, offsets), i):
                    if node_of(bag, data[offsets[k - i] : offsets[k - i + 1]]) != b[k]:
                        continue  # another text of the same id
                    if first[k]:
                        head, at = bag, (a[k], part[k])
                    elif at == (a[k], part[k]) and (x := likeness(head, bag)) >= near:
                        for c, v in zip(out, (a[k], b[k], x), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["a", "b", "likeness"])

    return met.mapInArrow(run, "a long, b long, likeness double")


def _with_texts(wanted: DataFrame, node: str, nodes: DataFrame, docs: DataFrame, id: str) -> DataFrame:
    """wanted with the text of the node in a column.  Texts that nobody wants are left out before texts are shuffled, where few are wanted."""
    named = wanted.join(nodes.select(F.col("node").alias(node), F.col("id").alias("__id")), node)
    texts = docs.select(F.col(id).alias("__text_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = cut(named.select(F.col("__id").alias("__wanted")).distinct())
    if ids.limit(SMALL + 1).count() <= SMALL:
        texts = texts.join(F.broadcast(ids), texts["__text_id"].eqNullSafe(ids["__wanted"]), "left_semi")
    return named.join(texts, named["__id"].eqNullSafe(texts["__text_id"])).select(*wanted.columns, "text")


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): label is the smallest node of its component.  Alternates large and small stars.

    A graph of ``SMALL`` edges at most is held in one partition, where nothing is shuffled; a larger one is spread out.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = _state(now)
    held = (lambda x: x.coalesce(1)) if state[0] <= SMALL else (lambda x: x)
    while state[0]:
        edge = held(now)
        both = held(edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u <> v")
        small = cut(held(small).distinct())
        before, state, now = state, _state(small), small
        if before == state:
            break
    return held(now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")))).distinct()


def _state(edges: DataFrame) -> tuple:
    """How many edges there are, and a sum over their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def groups(docs: DataFrame, id: str = "doc_id", near: float = NEAR) -> DataFrame:
    """(id, node, class_id) for each row of docs: near-duplicates have the same class_id, equal multisets the same node."""
    rows = _labelled(docs.select(id, "text"), id, near)
    return rows.select(F.col("id").alias(id), "node", "class_id")


def _labelled(texts: DataFrame, id: str, near: float) -> DataFrame:
    """(id, th, node, label, class_id) for each row of texts; th is a hash of the text, label the smallest node of the group."""
    rows = cut(signed(texts, id))
    nodes = cut(rows.groupBy("node").agg(F.min("id").alias("id"), F.first("bands").alias("bands")))
    buckets = nodes.select("node", F.explode("bands").alias("band"))
    sizes = buckets.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    met = cut(buckets.join(sizes, "band").select("band", "node", "n"))
    known = met.groupBy("node").agg(F.sum("n").alias("known"))
    met = cut(met.join(known, "node").select("band", "node", "known"))
    leaders = met.groupBy("band").agg(F.max(F.struct("known", (-F.col("node")).alias("less"))).alias("x")).select("band", (-F.col("x.less")).alias("leader"))
    led = met.join(leaders, "band")
    pairs = led.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = cut(verified(pairs, nodes, texts, id, near))
    labels = cut(connected(links))
    more = cut(_open_links(led.select("leader", "node"), labels, nodes, texts, id, near))
    if more.limit(1).count():
        # links between components: their labels are joined, and nodes follow their labels
        of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}"))
        between = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))
        last = cut(connected(between).select(F.col("node").alias("label"), F.col("label").alias("last")))
        alone = last.select(F.col("label").alias("node"), "last")
        labels = labels.join(last, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
        labels = labels.unionByName(alone.select("node", F.col("last").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
    whole = nodes.select("node", "id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = whole.groupBy("label").agg(F.min("id").alias("class_id"))
    named = whole.join(least, "label").select("node", "label", "class_id")
    return rows.select("id", "th", "node").join(named, "node").select("id", "th", "node", "label", "class_id")


def keep_one(docs: DataFrame, id: str = "doc_id", near: float = NEAR) -> DataFrame:
    """One row of docs for each group of near-duplicates: that of the smallest id, then of the smallest text hash; of equal rows one."""
    rows = cut(_labelled(docs.select(id, "text"), id, near))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    kept = rows.groupBy("label").agg(F.min(order).alias("x"))
    gone = cut(rows.join(kept, "label").filter(order != F.col("x")).select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct())
    shown = docs.withColumn("__text", F.xxhash64(F.coalesce("text", F.lit(""))))
    small = gone.limit(SMALL + 1).count() <= SMALL
    left = shown.join(F.broadcast(gone) if small else gone, F.col(id).eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__th")), "left_anti")
    twice = rows.groupBy("id", "th").count().filter("count > 1").limit(1).count()
    if twice:
        left = left.dropDuplicates([id, "__text"])
    return left.drop("__text")


def _open_links(led: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, id: str, near: float) -> DataFrame:
    """(a, b): links that join components, between nodes of one leader's buckets that are not in the leader's component and all others there.

    led: (leader, node) as they met.  The nodes of a leader are dealt to blocks of BLOCK; each block of open nodes meets each block
    of all its nodes in one place, where overlaps are counted as products of incidence matrices, and gives one link at most for each
    open node and other component.
    """
    met = led.filter("node <> leader").distinct().join(labels.withColumnRenamed("label", "l"), "node", "left").select("leader", "node", F.coalesce("l", "node").alias("label"))
    met = met.join(labels.select(F.col("node").alias("leader"), F.col("label").alias("of_leader")), "leader", "left")
    met = cut(met.withColumn("open", F.col("label") != F.coalesce("of_leader", "leader")).drop("of_leader"))
    sizes = met.groupBy("leader").agg(F.count("*").alias("n"), F.sum(F.col("open").cast("long")).alias("k"), F.count_distinct("label").alias("labels"))
    sizes = cut(sizes.filter("k > 0 AND n > 1 AND labels > 1").select("leader", F.ceil(F.col("n") / BLOCK).alias("n_blocks"), F.ceil(F.col("k") / BLOCK).alias("k_blocks")))
    met = met.join(sizes, "leader")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    place = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "node"), n)
    left = met.filter("open").select("leader", "node", "label", F.lit(True).alias("open"), place(F.col("k_blocks"), 1).alias("i"), every(F.col("n_blocks")).alias("j"))
    right = met.select("leader", "node", "label", F.lit(False).alias("open"), place(F.col("n_blocks"), 2).alias("j"), every(F.col("k_blocks")).alias("i"))
    dealt = _with_texts(left.unionByName(right), "node", nodes, docs, id).repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")

    def run(batches):
        at, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in ("leader", "i", "j")), strict=True))
            node, label, open_ = (batch.column(k).to_pylist() for k in ("node", "label", "open"))
            for first, data, offsets in pieces(batch.column("text")):
                for k, bag in enumerate(bags(data, offsets), first):
                    if keys[k] != at:
                        if held:
                            yield _links(held, near)
                        at, held = keys[k], []
                    if node_of(bag, data[offsets[k - first] : offsets[k - first + 1]]) == node[k]:
                        held.append((node[k], label[k], open_[k], bag))
        if held:
            yield _links(held, near)

    return dealt.mapInArrow(run, "a long, b long")


def overlaps(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]], width: int = 4096) -> np.ndarray:
    """Sizes of the multiset intersections of each of left with each of right."""

    def units(found):  # the c-th copy of a shingle is an element of its own
        with np.errstate(over="ignore"):
            each = [np.repeat(h, c) for h, c in found]
            copy = [np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) for _, c in found]
            flat = [mix(h + k.astype(np.uint64) * _C) for h, k in zip(each, copy, strict=True)]
        return np.repeat(np.arange(len(found)), [len(x) for x in flat]), np.concatenate(flat) if flat else np.zeros(0, np.uint64)

    (i, a), (j, b) = units(left), units(right)
    shared = np.intersect1d(a, b)
    keep_a, keep_b = np.isin(a, shared), np.isin(b, shared)
    i, a, j, b = i[keep_a], np.searchsorted(shared, a[keep_a]), j[keep_b], np.searchsorted(shared, b[keep_b])
    out = np.zeros((len(left), len(right)), np.float32)
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    for start in range(0, len(shared), width):
        some_a = order_a[np.searchsorted(a, start, sorter=order_a) : np.searchsorted(a, start + width, sorter=order_a)]
        some_b = order_b[np.searchsorted(b, start, sorter=order_b) : np.searchsorted(b, start + width, sorter=order_b)]
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        x[i[some_a], a[some_a] - start] = 1
        y[j[some_b], b[some_b] - start] = 1
        out += x @ y.T
    return np.rint(out).astype(np.int64)


def _links(held: list[tuple], near: float) -> pa.RecordBatch:
    """One link for each open node and other component among nodes (node, label, open, bag) that are near."""
    left, right = [x for x in held if x[2]], [x for x in held if not x[2]]
    a, b = [], []
    if left and right:
        shared = overlaps([x[3] for x in left], [x[3] for x in right])
        size = [np.array([x[3][1].sum() for x in side]) for side in (left, right)]
        total = size[0][:, None] + size[1][None, :] - shared
        for i, j in zip(*np.nonzero((shared >= near * total) & (total > 0)), strict=True):
            if left[i][1] != right[j][1] and (not a or (a[-1], known) != (left[i][0], right[j][1])):
                known = right[j][1]
                a.append(left[i][0])
                b.append(right[j][0])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: for each document the class of its near-duplicates, and its node: documents of equal multisets of shingles share it."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "node", "class_id")
