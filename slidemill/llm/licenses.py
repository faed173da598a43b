"""Operator 4, license scans by diagonal voting, in DataFrame functions alone.

Every rolling hash of K words of every text is joined to the positions of the same hash in the templates (a table of constant
size, broadcast).  A hit votes for its diagonal, the text's position less the template's.  Diagonals with enough votes whose
offsets differ by ``GAP`` words at most, as words inserted or left out make them, are merged into one span; a span is verified
by the share of the template's positions found in it and by its length.  Phrases take part as short templates of which every
position must stand on one diagonal.

Each text also yields one mark, which joins to a row of its own among the templates, so that texts without hits stay in the
result without a second pass.

Defined cases: a null text is empty: no words, no spans.  Rows that repeat an id and a text are each returned.  Overlapping
places of a phrase all count.  Texts are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words hashed together.
K = 2
#: Words by which neighbouring diagonals differ at most.
GAP = 3
#: Votes that a diagonal needs, share of a template's positions that a span needs, and its length in template lengths at most.
VOTES, COVER, STRETCH = 3, 0.6, 1.5


@dataclass(frozen=True)
class Template:
    """A text to look for; every word of a phrase must be there, in order, and nothing between."""

    label: str
    text: str
    phrase: bool = False


#: Phrases that name a license.
PHRASES = [Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True)]
#: Notices by which public licenses are applied.
NOTICES = [
    Template("mit", "released under the mit license"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    Template(
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a "
        "copy of the license at http www apache org licenses license 2 0",
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 3 of the license or at your option any later version",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
    ),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you "
        "can obtain one at http mozilla org mpl 2 0",
    ),
]


def words(text: Column) -> Column:
    """Runs of digits, letters and what is not ASCII, A-Z as a-z."""
    plain = F.coalesce(text, F.lit(""))
    # lower() makes ASCII letters of these two signs and of no other that isn't ASCII
    kept = F.when(plain.rlike("[\u0130\u212a]"), F.translate(plain, "\u0130\u212a", "\ue000\ue000")).otherwise(plain)
    return F.array_remove(F.split(F.lower(kept), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def grams(found: Column) -> Column:
    """Hash of K words from each word on; the last K - 1 have fewer words and match no template."""
    return F.transform(found, lambda x, i: F.xxhash64(x, *(F.get(found, i + j) for j in range(1, K))))


def positions(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """(gram, template, label, phrase, size, at): a row for each position of each template, and the mark."""
    rows = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(t.label).alias("label"), F.lit(t.phrase).alias("phrase"), F.lit(t.text).alias("text")) for i, t in enumerate(templates)))
    table = spark.range(1).select(F.inline(rows)).withColumn("w", words(F.col("text")))
    size = F.size("w") - (K - 1)
    table = table.select("template", "label", "phrase", size.alias("size"), F.posexplode(F.slice(grams(F.col("w")), F.lit(1), size)).alias("at", "gram"))
    mark = spark.range(1).select(_mark().alias("gram"), F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("phrase"), F.lit(1).alias("size"), F.lit(0).alias("at"))
    return table.select("gram", "template", "label", "phrase", "size", "at").unionByName(mark)


def _mark() -> Column:
    return F.xxhash64(F.lit(-1), F.lit("mark"))


def scan(docs: DataFrame, key: str = "doc_id", templates: list[Template] | None = None) -> DataFrame:
    """(key, n_words, spans) for each row of docs; a span is (label, phrase, template, first word, words, share of the template)."""
    table = positions(docs.sparkSession, PHRASES + NOTICES if templates is None else templates)
    # the words are bound once, as w; the mark comes last, so that its position is their number
    read = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.transform(F.array(words(F.col("text"))), lambda w: F.concat(grams(w), F.array(_mark())))[0].alias("grams"))
    rolling = read.select("key", "h", F.posexplode("grams").alias("pos", "gram"))
    hits = rolling.join(F.broadcast(table), "gram")
    # the few hits of a text meet in one place; a text that is repeated with its id gives each hit several times
    text = ["key", "h"]
    about = [*text, "template", "label", "phrase", "size"]
    hits = hits.select(*about, "at", "pos").repartition("key", "h").groupBy(*about, "at", "pos").agg(F.count("*").alias("copies"))
    hits = hits.withColumn("diagonal", F.col("pos") - F.col("at"))
    hits = hits.withColumn("votes", F.count("*").over(Window.partitionBy(*about, "diagonal")))
    need = F.when(F.col("phrase") | (F.col("template") < 0), F.col("size")).otherwise(F.least(F.lit(VOTES), F.col("size")))
    ordered = Window.partitionBy(*about).orderBy("diagonal", "pos")
    step = F.col("diagonal") - F.lag("diagonal").over(ordered)
    new = F.when(step > F.when(F.col("phrase"), 0).otherwise(GAP), 1).otherwise(0)
    spans = hits.filter(F.col("votes") >= need).withColumn("new", new).withColumn("span", F.sum("new").over(ordered))
    spans = spans.groupBy(*about, "span").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), (F.count_distinct("at") / F.col("size")).alias("cover"), F.max("copies").alias("copies"))
    long = F.col("last") - F.col("first") + K
    good = (F.col("template") >= 0) & (F.col("cover") >= COVER) & (long <= STRETCH * (F.col("size") + K - 1))
    span = F.struct("label", "phrase", "template", F.col("first").alias("start"), long.alias("words"), "cover")
    done = spans.groupBy(*text).agg(F.array_sort(F.collect_list(F.when(good, span))).alias("spans"), *(F.max(F.when(F.col("template") < 0, F.col(c))).alias(a) for c, a in (("first", "n_words"), ("copies", "copies"))))
    return done.select(F.col("key").alias(key), "n_words", "spans", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("__one")).drop("__one")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: places of the phrases and labels of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["phrase"])
    starts = F.transform(base, lambda s: s["start"].cast("long"))
    named = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0))
    return found.select("doc_id", F.col("n_words").cast("long"), F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), named(base).alias("base_labels"), named(F.col("spans")).alias("labels"), score.alias("score"))
