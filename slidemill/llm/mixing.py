"""Operator 3, mixing sources to target weights by iterative proportional fitting, in DataFrame functions alone.

Documents are summed to cells (source, language, topic) of tokens.  Each round scales the cells' weights so that the sums by
source, then by language, then by topic are the target shares; after ``ROUNDS`` rounds all three hold closely (``residual`` says how
closely).  A document's probability is min(1, c * its cell's weight by token), where c is such that the expected tokens of the
sample are the share ``kept`` of the corpus: scarce cells are taken whole, and what they cannot give is given by the others, so that
one odd document changes nothing elsewhere; ``margins`` tells which shares are then missed.  Documents are drawn by a hash of their
id: the same ones each time.

Target shares follow from the corpus by default: proportional to a power of a category's tokens, below 1, which lifts what is
rare (``POWERS``); or they are given as a DataFrame (category, share) for each margin, shares of categories that are absent
from the corpus being left out and the rest raised in proportion.  The topic of a text is the one of ``TOPICS`` of which
most signs stand in it; another column of topics may be given instead.

Defined cases: null categories are the category ''; a null text is empty; a text has at least one token; documents with a null
id are drawn as the id ''.  Rows repeated are drawn or not together.  An empty table stays empty.  Columns of other names go along,
but for those named __source, __lang, __topic, __tokens and __probability, which are made anew.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

ROUNDS = 6
#: Share of the corpus' tokens that a sample has.
KEPT = 0.5
#: Signs of topics; of topics with equally many signs in a text the first counts, and a text without any is prose.
TOPICS = {
    "legal": ["icense", "opyright", "arranty"],
    "contact": ["http", "www.", "@"],
    "table": [" | ", "\t"],
    "news": [" said ", "government"],
}
#: Powers of a category's tokens to which target shares are proportional.
POWERS = {"source": 0.9, "lang": 0.8, "topic": 0.9}
#: Cells up to which their table is raked in one partition and broadcast; a larger one is spread out and joined by shuffling.
SMALL = 100_000
#: A share missed by more is named in the log.
GAP = 0.001
LOG = logging.getLogger(__name__)


def tokens(text: Column) -> Column:
    """Four bytes to a token, about; one at least."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def topic(text: Column, topics: dict[str, list[str]] | None = None) -> Column:
    """The topic of which most signs stand in a text; never null, and each text is looked through once for a sign."""
    topics = TOPICS if topics is None else topics
    names, n = ["prose", *topics], 1 + len(topics)
    count = lambda signs: sum((F.contains(text, F.lit(x)).cast("int") for x in signs[1:]), F.contains(text, F.lit(signs[0])).cast("int"))
    best = F.greatest(F.lit(n - 1), *(count(signs) * n + (n - 1 - i) for i, signs in enumerate(topics.values(), 1)))
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, names)), F.lit(n) - best % n), F.lit("prose"))


def unit(id: Column) -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def with_margins(docs: DataFrame, topics: Column | None = None) -> DataFrame:
    """docs with columns __source, __lang, __topic and __tokens; ``topics`` is a column of topics to go by instead of the signs."""
    about = topic(F.coalesce("text", F.lit(""))) if topics is None else F.coalesce(topics.cast("string"), F.lit(""))
    return docs.withColumns({"__source": F.coalesce("source", F.lit("")), "__lang": F.coalesce("lang", F.lit("")), "__topic": about, "__tokens": tokens(F.col("text"))})


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Cells (__source, __lang, __topic, tokens) with column w: weights whose margins are the target shares.

    ``SMALL`` cells at most are held in one partition, where nothing is shuffled; more are spread out.
    """
    held = (lambda x: x.coalesce(1)) if cells.limit(SMALL + 1).count() <= SMALL else (lambda x: x)
    cells = held(cells).withColumn("w", F.col("tokens").cast("double"))
    for name, power in POWERS.items():
        d, by = f"__{name}", f"share_{name}"
        sums = cells.groupBy(d).agg(F.sum("tokens").alias("t"))
        if targets and name in targets:
            given = targets[name].select(F.coalesce(F.col("category"), F.lit("")).alias(d), F.col("share").cast("double").alias("raw"))
            sums = sums.join(given, d, "left").select(d, F.coalesce("raw", F.lit(0.0)).alias("raw"))
        else:
            sums = sums.select(d, F.pow(F.col("t").cast("double"), F.lit(power)).alias("raw"))
        total = sums.agg(F.sum("raw")).first()[0]
        cells = cells.join(sums.select(d, (F.col("raw") / F.lit(total or 1.0)).alias(by)), d)
    cells = cut(cells)
    for _ in range(rounds):
        for name in POWERS:
            sums = held(cells).groupBy(f"__{name}").agg(F.sum("w").alias("sum"))
            scaled = F.when(F.col("sum") > 0, F.col("w") * F.col(f"share_{name}") / F.col("sum")).otherwise(0.0)
            cells = cut(held(cells).join(sums, f"__{name}").withColumn("w", scaled).drop("sum"))
    return cells


def scale(cells: DataFrame, kept: float) -> float:
    """The c for which sum(least(tokens, c * w)) is the share ``kept`` of all tokens, or of those in cells of any weight if these are fewer.

    The sum is concave in c and made of straight pieces: tangents from the left reach it in a few aggregations.
    """
    total, reach, weight = cells.agg(F.sum("tokens"), F.sum(F.when(F.col("w") > 0, F.col("tokens"))), F.sum("w")).first()
    if not weight:
        return 0.0
    if kept * total >= reach:
        return float("inf")
    c, full = kept * total / weight, 0
    while True:
        whole = F.col("w") * F.lit(c) >= F.col("tokens")
        held, left = cells.agg(F.sum(F.when(whole, F.col("tokens")).otherwise(0)), F.sum(F.when(whole, 0.0).otherwise(F.col("w")))).first()
        if held == full or not left:
            return c
        c, full = max(c, (kept * total - held) / left), held


def margins(cells: DataFrame) -> DataFrame:
    """(margin, category, wanted, expected): target shares, and those of the expected tokens, of cells with column __probability."""
    found, every = None, cells.agg(F.sum(F.col("tokens") * F.col("__probability"))).first()[0]
    for name in POWERS:
        sums = cells.groupBy(F.col(f"__{name}").alias("category")).agg(F.max(f"share_{name}").alias("wanted"), F.sum(F.col("tokens") * F.col("__probability")).alias("t"))
        sums = sums.select(F.lit(name).alias("margin"), "category", "wanted", F.try_divide(F.col("t"), F.lit(every).cast("double")).alias("expected"))
        found = sums if found is None else found.unionByName(sums)
    return found


def residual(cells: DataFrame) -> float:
    """The largest share by which the raked weights miss a target."""
    gaps = []
    for name in POWERS:
        sums = cells.groupBy(f"__{name}").agg(F.sum("w").alias("w"), F.max(f"share_{name}").alias("share"))
        gaps.append(sums.agg(F.max(F.abs(F.col("w") - F.col("share")))).first()[0] or 0.0)
    return max(gaps)


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, id: str = "doc_id", kept: float = KEPT, topics: Column | None = None) -> DataFrame:
    """The documents drawn, with columns __source, __lang, __topic, __tokens and __probability beside their own; the shares missed most go to the log."""
    shown = with_margins(docs, topics)
    cells = rake(cut(shown.groupBy("__source", "__lang", "__topic").agg(F.sum("__tokens").alias("tokens"))), targets, rounds)
    c = scale(cells, kept)
    chance = F.when(F.col("w") > 0, F.least(F.lit(1.0), F.col("w") / F.col("tokens") * F.lit(c))).otherwise(0.0)
    cells = cut(cells.withColumn("__probability", chance))
    gap = F.abs(F.col("wanted") - F.col("expected"))
    for r in margins(cells).filter(gap > GAP).orderBy(gap.desc(), "margin", "category").limit(20).collect():
        LOG.warning("mixing: %s %r has %.4f of the expected tokens instead of %.4f", r["margin"], r["category"], r["expected"], r["wanted"])
    drawn = cells.select("__source", "__lang", "__topic", "__probability")
    small = cells.limit(SMALL + 1).count() <= SMALL
    met = shown.drop("__probability").join(F.broadcast(drawn) if small else drawn, ["__source", "__lang", "__topic"])
    return met.filter(unit(F.col(id)) < F.col("__probability"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the documents drawn, their cells, tokens and probabilities."""
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"), F.round("__probability", 6).alias("probability"))


def topic_sql() -> str:
    """DuckDB SQL of topic(), of a column t."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    names, n = ["prose", *TOPICS], 1 + len(TOPICS)
    scores = ", ".join(f"({' + '.join(f'CAST(contains(t, {quoted(x)}) AS INTEGER)' for x in signs)}) * {n} + {n - 1 - i}" for i, signs in enumerate(TOPICS.values(), 1))
    return f"list_extract([{', '.join(map(quoted, names))}], {n} - greatest({n - 1}, {scores}) % {n})"


def sampled_sql(documents: str) -> str:
    """DuckDB SQL of (all columns of ``documents``, __source, __lang, __topic, __tokens, p) for the documents drawn.

    With cells in the order in which a growing c fills them, the expected tokens are the least of (tokens of the cells before) +
    c * (weight of the rest) over all places in that order; so c is the largest that any of these asks for.
    """
    steps, last = [], "r0"
    for i in range(ROUNDS):
        for j, name in enumerate(POWERS):
            now = f"r{3 * i + j + 1}"
            steps.append(f"{now} AS (SELECT * REPLACE (w * share_{name} / sum(w) OVER (PARTITION BY __{name}) AS w) FROM {last})")
            last = now
    shares = ", ".join(f"pow(sum(tokens) OVER (PARTITION BY __{n}), {p}) AS raw_{n}, row_number() OVER (PARTITION BY __{n}) AS k_{n}" for n, p in POWERS.items())
    parts = ", ".join(f"raw_{n} / (SELECT sum(raw_{n}) FROM m WHERE k_{n} = 1) AS share_{n}" for n in POWERS)
    return f"""
    e AS (SELECT *, coalesce(source, '') AS __source, coalesce(lang, '') AS __lang, coalesce(text, '') AS t FROM {documents}),
    d AS (SELECT * EXCLUDE (t), {topic_sql()} AS __topic, greatest(1, CAST(ceil(strlen(t) / 4) AS BIGINT)) AS __tokens FROM e),
    c AS (SELECT __source, __lang, __topic, CAST(sum(__tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
    m AS (SELECT *, {shares} FROM c),
    r0 AS (SELECT __source, __lang, __topic, tokens, CAST(tokens AS DOUBLE) AS w, {parts} FROM m),
    {", ".join(steps)},
    o AS (SELECT *, coalesce(sum(tokens) OVER before, 0) AS filled, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest, sum(tokens) OVER () AS every FROM {last}
          WINDOW before AS (ORDER BY tokens / w, __source, __lang, __topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    k AS (SELECT max(({KEPT} * every - filled) / rest) AS c FROM o WHERE rest > 0),
    s AS (SELECT d.*, least(1.0, w / tokens * (SELECT c FROM k)) AS p FROM d JOIN {last} USING (__source, __lang, __topic)),
    drawn AS (SELECT * FROM s WHERE CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS UBIGINT) / 4294967296.0 < p)"""


ORACLE = f"""WITH {sampled_sql("documents")}
SELECT doc_id, __source AS source, __lang AS lang, __topic AS topic, __tokens AS tokens, round(p, 6) AS probability FROM drawn"""
