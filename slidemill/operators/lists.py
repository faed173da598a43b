"""Nested lists of paragraphs, as ``ul`` and ``ol`` with the lists that are open carried along a text body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape
from . import package
from .palette import KEYS
from .shapes import joined, runs

#: Alignments by their names.
ALIGN = {"r": "right", "ctr": "center", "just": "justify", "dist": "justify"}


def nested(paras: Column) -> Column:
    """HTML of an array of paragraphs, structs kind (ul, ol or null), level, align, html, in order.

    A paragraph of a list closes the lists deeper than its own, goes on with one of its kind at its level, or opens one there, in place of one of
    another kind; a paragraph of no list closes all.  Levels that were skipped hold no list and need no closing.
    """
    none = F.array().cast("array<string>")
    closed = lambda open_: F.array_join(F.transform(F.reverse(F.array_compact(open_)), lambda x: F.concat(F.lit("</"), x, F.lit(">"))), "")
    state = lambda open_, html: F.struct(open_.alias("open"), html.alias("html"))

    def step(a: Column, p: Column) -> Column:
        deep = F.coalesce(p["level"], F.lit(0))
        kept, left = F.slice(a["open"], F.lit(1), deep + 1), F.slice(a["open"], deep + 2, F.greatest(F.size(a["open"]) - deep - 1, F.lit(0)))
        here = F.get(kept, deep)
        opened = F.when(here.isNull(), F.concat(F.lit("<"), p["kind"], F.lit(">"))).when(here != p["kind"], F.concat(F.lit("</"), here, F.lit("><"), p["kind"], F.lit(">"))).otherwise("")
        before = F.slice(kept, F.lit(1), deep)
        stack = F.concat(before, F.array_repeat(F.lit(None).cast("string"), F.greatest(deep - F.size(before), F.lit(0))), F.array(p["kind"]))
        style = F.concat(F.lit(' style="text-align:'), p["align"], F.lit(';">'), p["html"])
        item = state(stack, F.concat(a["html"], closed(left), opened, F.lit("<li"), style, F.lit("</li>")))
        return F.when(p["kind"].isNotNull(), item).otherwise(state(none, F.concat(a["html"], closed(a["open"]), F.lit("<p"), style, F.lit("</p>"))))

    return F.aggregate(paras, state(none, F.lit("")), step, lambda a: F.concat(a["html"], closed(a["open"])))


def note_html(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """(deck_id, slide_part, html): a slide's notes as HTML: the bodies among the placeholders there, one after the other, with nested lists; texts of runs alone, escaped."""
    to_note = package.first_rel(rels, "notesSlide").withColumnRenamed("resolved", "part_path")
    body = nodes.filter((F.col("way") == "nvSpPr/nvPr/ph") & (F.col("attrs")["type"] == "body")).select(*KEYS, "owner").distinct()
    para = nodes.filter(F.col("way") == "txBody/p").select(*KEYS, "owner", F.col("nid").alias("para")).join(body, [*KEYS, "owner"])
    first = lambda tail, what: F.min_by(what, F.when(F.col("way") == f"txBody/p/pPr{tail}", F.col("nid")))
    said = nodes.filter(F.col("way").isin(*(f"txBody/p/pPr{t}" for t in ("", "/buChar", "/buAutoNum")))).groupBy(*KEYS, "para").agg(
        first("", F.col("attrs")["algn"]).alias("algn"), first("", F.col("attrs")["lvl"].try_cast("int")).alias("lvl"), first("/buChar", F.lit(True)).alias("sign"), first("/buAutoNum", F.lit(True)).alias("number")
    )
    words = joined(runs(nodes.filter(~F.col("tag").isin("br", "fld"))), [*KEYS, "para"], "run_ord", "text")
    met = para.join(said, [*KEYS, "para"], "left").join(words, [*KEYS, "para"], "left")
    align = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in ALIGN.items() for x in pair)), F.col("algn")), F.lit("left"))
    one = F.struct("para", F.when(F.col("sign"), "ul").when(F.col("number"), "ol").alias("kind"), F.coalesce("lvl", F.lit(0)).alias("level"), align.alias("align"), F.coalesce(escape(F.col("text")), F.lit("")).alias("html"))
    each = met.groupBy(*KEYS, "owner").agg(F.array_sort(F.collect_list(one)).alias("paras")).select(*KEYS, "owner", nested(F.col("paras")).alias("html"))
    whole = joined(each, KEYS, "owner", "html")
    return to_note.join(whole, KEYS).select("deck_id", F.col("source_part").alias("slide_part"), "html")
