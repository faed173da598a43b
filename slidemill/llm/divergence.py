"""Operator 12, source divergence audit by wide term vectors.

Terms are counted by (language, source, term) before anything is shuffled.  Each term that stands in ``LEAST`` documents of its
language becomes one row with an array of counts, one place for each source of the language.  Counts become smoothed shares in
billionths; higher-order functions give, for each term, the contribution of every pair of sources, which are summed in the
tasks before they are shuffled, so that what moves is a row for each pair and task.  A source's own terms are those of larger
share than in the whole language; only the first ``TOP`` of each task are shuffled.

All arithmetic is in whole numbers and exact, up to 2.8e14 terms in a language.

Defined cases: null text, language and source are ''.  A group without terms, or of a language in which no term is kept, is as
far from others as its shares say, 0 where there are none; a language of one source has no pairs.  Rows repeated count each.  An
empty table has no groups and so no rows.  Columns of other names aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: Documents of a language in which a term must stand, ranks of terms that are returned, and what is added to each count.
LEAST, TOP, ADDED = 10, 10, 2
#: Shares are in parts of this product; two factors, so that no product leaves 64 bits.
UNIT = (31_250, 32_000)
#: Groups (language, source) up to which their table is broadcast; larger ones are joined by shuffling.
SMALL = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    """Runs of A-Z, a-z and what is not ASCII; A-Z as a-z."""
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(plain, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"), "")


def counted(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, counts): kept terms, with a map from sources to occurrences."""
    read = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), terms(F.coalesce("text", F.lit(""))).alias("words"))
    read = read.select("lang", "source", "words", F.array_distinct("words").alias("once"))
    # a term's first place in a document stands for the document, the places after those for the occurrences
    rows = read.select("lang", "source", F.size("once").alias("k"), F.posexplode(F.concat("once", "words")).alias("i", "term"))
    sums = rows.groupBy("lang", "source", "term").agg(F.count_if(F.col("i") >= F.col("k")).alias("n"), F.count_if(F.col("i") < F.col("k")).alias("d"))
    wide = sums.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return wide.filter(F.col("d") >= least).select("lang", "term", "counts")


def languages(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, sources, sizes, size): a language's sources in order, what divides each one's counts, and the language's."""
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    held = kept.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    number = kept.groupBy("lang").agg(F.count("*").alias("v"))
    met = groups.join(held, ["lang", "source"], "left").join(number, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    met = met.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", (F.col("n") + ADDED * F.col("v")).alias("size")))).alias("x"), (F.sum("n") + ADDED * F.max("v")).alias("size"))
    return met.select("lang", F.col("x.source").alias("sources"), F.col("x.size").alias("sizes"), "size")


def share(count: Column, size: Column) -> Column:
    """1 + floor(10**9 * (count + ADDED) / size)."""
    first = (count + ADDED) * UNIT[0]
    whole = F.call_function("div", first, size)
    return whole * UNIT[1] + F.call_function("div", (first - whole * size) * UNIT[1], size) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def vectors(kept: DataFrame, about: DataFrame) -> DataFrame:
    """(lang, sources, term, counts, shares, q): a row for each kept term, arrays by the language's sources, and its share in the language."""
    small = about.select(F.explode("sources")).limit(SMALL + 1).count() <= SMALL
    met = kept.withColumnRenamed("counts", "found").join(F.broadcast(about) if small else about, "lang")
    met = met.withColumn("counts", F.transform("sources", lambda s: F.coalesce(F.try_element_at("found", s), F.lit(0).cast("long"))))
    shares = F.zip_with("counts", "sizes", share)
    return met.select("lang", "sources", "term", "counts", shares.alias("shares"), share(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x), F.col("size")).alias("q"))


def pairs(wide: DataFrame, about: DataFrame) -> DataFrame:
    """(lang, source, item, value): each source and each other one of its language."""
    others = lambda n, made: F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.filter(F.sequence(i, n - 1), lambda j: j > i), lambda j: made(i, j))))
    given = wide.select("lang", F.inline(others(F.size("shares"), lambda i, j: F.struct(i.alias("i"), j.alias("j"), apart(F.col("shares")[i], F.col("shares")[j]).alias("value")))))
    none = about.select("lang", F.inline(others(F.size("sources"), lambda i, j: F.struct(i.alias("i"), j.alias("j"), F.lit(0).cast("long").alias("value")))))
    sums = given.unionByName(none).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    named = sums.join(about.select("lang", "sources"), "lang").select("lang", F.col("sources")[F.col("i")].alias("a"), F.col("sources")[F.col("j")].alias("b"), "value")
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return named.select("lang", "value", F.inline(both)).select("lang", "source", "item", "value")


def own_terms(wide: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms that a source has a larger share of than its language."""
    each = wide.select("lang", F.col("term").alias("item"), "q", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n"), F.col("shares").alias("p"))))
    return each.filter("n > 0 AND p > q").select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far sources of a language are apart, and by which terms each stands out."""
    kept = cut(counted(docs, least))
    about = cut(languages(docs, kept))
    wide = vectors(kept, about)
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    far = pairs(wide, about).withColumn("rank", ranked)
    words = own_terms(wide).withColumn("rank", ranked).filter(F.col("rank") <= top)
    shown = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shown(far, "pair").unionByName(shown(words, "term"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the audit of all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SHARE = f"1 + ({UNIT[0] * UNIT[1]}::HUGEINT * (coalesce(n, 0) + {ADDED})) // (size + {ADDED} * v)"
ORACLE = rf"""WITH
d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST}),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
z AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(sum(n), 0) AS size FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source LEFT JOIN v ON v.lang = g.lang GROUP BY ALL),
p AS (SELECT z.lang, z.source, k.term, coalesce(n, 0) AS n, {_SHARE} AS p FROM z JOIN k USING (lang) LEFT JOIN c ON c.lang = z.lang AND c.source = z.source AND c.term = k.term),
l AS (SELECT lang, term, {_SHARE} AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN (SELECT lang, any_value(v) AS v, sum(size) AS size FROM z GROUP BY lang) USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= {TOP}"""
