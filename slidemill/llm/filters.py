"""Operator 13, filter interaction audit by a histogram of failure masks, in DataFrame functions alone.

Five filters look at a text; which of them it fails is a mask of five bits.  All that the 120 orders of the filters can tell follows
from how many documents of a part have each mask: 32 counts a part, summed before they are shuffled.  Orders and steps are
enumerated from these cells.  Whether a text stands under a smaller id comes from a grouping by the text's digest: only the
rows of a digest's smallest id pass, and they are found by a join on digest and id, in which copies of one text don't meet.

Defined cases: a null text is empty; a null part is ''.  A row without an id never fails E, and makes no other row fail.  Rows that
repeat an id count each; of repeated labels of an id the larger count; documents without a label are neither good nor toxic.  An
empty table has no parts and so no rows.  Columns of other names aren't looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Filters in the order of a mask's bits; E is 16.
NAMES = "ABCDE"
#: Least words, least percentage of different ones, and largest percentage of capitals.
WORDS, DIFFERENT, CAPITALS = 200, 50, 3
SPACES, SIGNS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"


def measured(docs: DataFrame, part: Column) -> DataFrame:
    """(doc_id, part, mask, digest) of each row; of the mask the bits of A to D."""
    read = docs.select("doc_id", F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    read = read.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    n = F.size("words")
    fails = [
        n < WORDS,
        F.size(F.array_distinct("words")).cast("long") * 100 < n.cast("long") * DIFFERENT,
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") * 100 > F.length("text").cast("long") * CAPITALS,
        F.col("text").rlike(SIGNS),
    ]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return read.select("doc_id", "part", mask.alias("mask"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


def masks(docs: DataFrame, part: Column) -> DataFrame:
    """(doc_id, part, mask) of each row, all five bits set."""
    rows = cut(measured(docs, part))
    known = rows.filter("doc_id IS NOT NULL")
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("__first", F.lit(True))
    again = F.when(F.col("__first").isNull(), 1 << NAMES.index("E")).otherwise(0)
    met = known.join(firsts, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + again).alias("mask"))
    return met.unionByName(rows.filter("doc_id IS NULL").select("doc_id", "part", "mask"))


def cells(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """(part, mask, n, good, toxic): the histogram."""
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max((F.col(c) == 1).cast("long")).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    rows = masks(docs, part)
    zero = F.lit(0).cast("long")
    met = rows.filter("doc_id IS NOT NULL").join(marks, "doc_id", "left").select("part", "mask", F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))
    met = met.unionByName(rows.filter("doc_id IS NULL").select("part", "mask", zero.alias("good"), zero.alias("toxic")))
    return met.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of the filters before it) of all orders."""
    bit = {x: 1 << k for k, x in enumerate(NAMES)}
    return [("".join(o), k + 1, bit[o[k]], sum(bit[x] for x in o[:k])) for o in permutations(NAMES) for k in range(len(NAMES))]


def enumerated(histogram: DataFrame) -> DataFrame:
    """A row for each part, order and step, from the parts' 32 cells at most."""
    parts = histogram.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    named = "array<struct<filter_order: string, step: int, bit: int, before: int>>"
    steps = F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{k},"bit":{b},"before":{p}}}' for o, k, b, p in orders()) + "]"), named)
    rows = parts.select("part", "cells", F.inline(steps))
    total = lambda value, holds: F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(holds(c["mask"]), value(c)).otherwise(0))
    own = lambda m: m.bitwiseAND(F.col("bit")) != 0
    new = lambda m: own(m) & (m.bitwiseAND(F.col("before")) == 0)
    n, every = (lambda c: c["n"]), len({o for o, *_ in orders()})
    return rows.select(
        "part", "filter_order", "step",
        total(n, lambda m: m.bitwiseAND(F.col("before").bitwiseOR(F.col("bit"))) == 0).alias("kept"),
        total(n, new).alias("removed"),
        total(n, lambda m: own(m) & (m.bitwiseAND(F.col("before")) != 0)).alias("redundant"),
        total(n, lambda m: m == F.col("bit")).alias("unique_fails"),
        total(lambda c: c["good"], new).alias("good_lost"),
        total(lambda c: c["toxic"], new).alias("toxic_lost"),
        # of the orders, a document of k failures is removed by each of them in every k-th
        total(lambda c: c["n"] * (F.lit(every) / F.bit_count(c["mask"])).cast("long"), own).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: Column | None = None) -> DataFrame:
    """What each filter removes at each step of each order, by part (the language, or a column given)."""
    return enumerated(cells(docs, labels, F.col("lang") if part is None else part))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the audit of every document."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_STEPS = ", ".join(f"('{o}', {k}, {b}, {p})" for o, k, b, p in orders())
ORACLE = rf"""WITH
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INTEGER)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INTEGER)), 0) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
e AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(w) < {WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < {DIFFERENT} * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > {CAPITALS} * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d LEFT JOIN l USING (doc_id)),
s(filter_order, step, bit, earlier) AS (VALUES {_STEPS}),
r AS (SELECT e.*, s.*, (mask & bit) <> 0 AS own, (mask & earlier) <> 0 AS gone FROM e, s)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, count(*) FILTER (NOT own AND NOT gone) AS kept, count(*) FILTER (own AND NOT gone) AS removed, count(*) FILTER (own AND gone) AS redundant,
  count(*) FILTER (mask = bit) AS unique_fails, count(*) FILTER (own AND NOT gone AND good = 1) AS good_lost, count(*) FILTER (own AND NOT gone AND toxic = 1) AS toxic_lost,
  CAST(sum(sum(CASE WHEN own AND NOT gone THEN 1 ELSE 0 END)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r GROUP BY part, filter_order, step, bit"""
