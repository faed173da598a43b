"""Operator 11, sharding by longest processing time: groups of equal texts stay together and go, by size, to the least loaded shard.

A group's size is that of its rows.  Groups of more than one part in ``ITEMS`` of everything are fewer than ``ITEMS``, whatever the
table: each of them is scheduled by itself.  All others, each below that size, fall into ``ITEMS`` bins by their text's digest, and a
bin is scheduled as one.  So the heap sees 2 * ``ITEMS`` sizes at most, and the shards' loads end less than a bin apart, unless one
group alone is more than a shard's share: it must stay together, and its shard holds it alone.  Sums by digest are made before
the shuffle, and the schedule, of bounded size, is broadcast, so copies of one text never meet in one task.

Slots number a shard's rows from 0 without gaps, in the order of a hash of the id, so that a shard read in order is shuffled.  The
square root of the number of rows tells into how many ranges of that hash a shard is cut; ranges are counted, and rows are numbered
in each: neither ranges nor rows of one are more than that square root, or a group's share of it.

Defined cases: a null text is empty: no bytes, its checksum is 0, and it is in one group with empty texts.  A null id has the hash
of the empty text.  Rows that repeat an id and a text have slots of their own, in any order.  With fewer groups than shards some
shards stay empty.  An empty table stays empty.  Columns of other names aren't looked at; ``carry`` takes them along.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS = 40
#: Bytes that a row takes besides its text.
ROW = 16
#: Groups scheduled by themselves at most, and bins for the others.
ITEMS = 40_000


def measured(docs: DataFrame, carry: Iterable[str] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, digest, bin) of each row, and columns ``carry``."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", *carry, (F.octet_length(text) + ROW).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest"))
    return rows.withColumn("bin", (F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % ITEMS).cast("int"))


def schedule(items: Iterable[tuple[int, str]], shards: int) -> dict[str, int]:
    """The shard of each (size, name): the largest first, ties by name, to the shard of the least load, ties to the lowest number."""
    loads = [(0, s) for s in range(shards)]
    placed = {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = loads[0]
        heapq.heapreplace(loads, (load + size, shard))
        placed[name] = shard
    return placed


def placed(rows: DataFrame, shards: int = SHARDS, sizes: DataFrame | None = None) -> DataFrame:
    """rows (of ``measured``) with column shard; ``sizes`` are the rows whose sizes count, if they are kept apart from rows."""
    spark, sizes = rows.sparkSession, rows if sizes is None else sizes
    total = sizes.agg(F.sum("size")).first()[0] or 0
    groups = cut(sizes.groupBy("digest", "bin").agg(F.sum("size").alias("weight")))
    alone = F.col("weight") > total // ITEMS
    heavy = groups.filter(alone).select("weight", F.col("digest").alias("name"))
    light = groups.filter(~alone).groupBy("bin").agg(F.sum("weight").alias("weight")).select("weight", F.lpad(F.col("bin").cast("string"), 8, "0").alias("name"))
    items = heavy.unionByName(light).toArrow()
    found = schedule(zip(items["weight"].to_pylist(), items["name"].to_pylist(), strict=True), shards)
    tables = {}
    for kind, names in (("digest", [x for x in found if len(x) == 64]), ("bin", [x for x in found if len(x) == 8])):
        key = pa.array(names, pa.string()) if kind == "digest" else pa.array(map(int, names), pa.int32())
        tables[kind] = spark.createDataFrame(pa.table({kind: key, f"__{kind}_shard": pa.array([found[x] for x in names], pa.int32())}))
    out = rows.join(F.broadcast(tables["digest"]), "digest", "left").join(F.broadcast(tables["bin"]), "bin", "left")
    return out.withColumn("shard", F.coalesce("__digest_shard", "__bin_shard")).drop("__digest_shard", "__bin_shard")


def _order(id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def numbered(rows: DataFrame, n: int) -> DataFrame:
    """rows (doc_id, digest, shard and others), n in all, with column slot."""
    cells = max(1, int(n**0.5))
    rows = rows.withColumn("__order", _order(F.col("doc_id"))).withColumn("__cell", F.shiftrightunsigned(F.col("__order") * cells, 32).cast("int"))
    counts = rows.groupBy("shard", "__cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__cell").orderBy("__order", "doc_id", "digest")
    return rows.withColumn("__at", F.row_number().over(inside)).join(starts, ["shard", "__cell"]).withColumn("slot", F.col("__start") + F.col("__at") - 1).drop("__order", "__cell", "__start", "__at")


def sharded(docs: DataFrame, shards: int = SHARDS, carry: Iterable[str] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, digest, shard, slot) of each row, and columns ``carry``.

    What is scheduled is read once and kept as narrow rows; only with ``carry`` are the documents read again.
    """
    carry = list(carry)
    narrow = cut(measured(docs))
    return numbered(placed(measured(docs, carry) if carry else narrow, shards, narrow), narrow.count()).drop("bin")


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """All columns of docs as Parquet, a folder for each shard, rows in files sorted by slot."""
    carry = [c for c in docs.columns if c not in {"doc_id", "size", "text_crc32", "digest", "bin", "shard", "slot"}]
    rows = sharded(docs, shards, carry).drop("size", "text_crc32", "digest")
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: shard and slot of every document, sizes near equal (law ``bytes``)."""
    found = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The heap's choices as a recursion over the sorted sizes; the checksum from its polynomial, byte by byte.
ORACLE = f"""WITH RECURSIVE
d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + {ROW} AS size, sha256(coalesce(text, '')) AS digest FROM documents),
g AS (SELECT digest, sum(size) AS weight, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % {ITEMS} AS bin FROM d GROUP BY digest),
m AS (SELECT *, weight > (SELECT sum(size) FROM d) // {ITEMS} AS alone FROM g),
i AS (SELECT digest AS name, weight FROM m WHERE alone UNION ALL SELECT lpad(CAST(bin AS VARCHAR), 8, '0'), sum(weight) FROM m WHERE NOT alone GROUP BY bin),
o AS (SELECT name, CAST(weight AS BIGINT) AS weight, row_number() OVER (ORDER BY weight DESC, name) AS k FROM i),
r AS (SELECT CAST(0 AS BIGINT) AS k, list_transform(range({SHARDS}), lambda x: CAST(0 AS BIGINT)) AS loads, 0 AS shard
      UNION ALL SELECT o.k, list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + o.weight ELSE x END), list_position(loads, list_min(loads)) - 1
      FROM r JOIN o ON o.k = r.k + 1),
s AS (SELECT o.name, r.shard FROM o JOIN r USING (k)),
p AS (SELECT digest, coalesce(a.shard, b.shard) AS shard FROM m LEFT JOIN s a ON alone AND a.name = digest LEFT JOIN s b ON NOT alone AND b.name = lpad(CAST(bin AS VARCHAR), 8, '0')),
steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS step),
x AS (SELECT digest, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(t), '..'), lambda b: CAST('0x' || b AS BIGINT))),
      lambda c, b: xor(c // 256, step[xor(c % 256, b) + 1])), 4294967295) AS crc FROM (SELECT DISTINCT digest, t FROM d), steps)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT), doc_id NULLS FIRST, digest) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM d JOIN p USING (digest) JOIN x USING (digest)"""
