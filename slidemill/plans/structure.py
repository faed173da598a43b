"""The structure of decks without looks: a row for each shape, its kind and its text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frames, shapes
from .document import Deck


def structure(decks: DataFrame) -> DataFrame:
    """(deck_id, slide_index, nid, node_type, id, name, level_texts, text, cells): paragraphs as (level, text); blank texts are null.

    cells holds (row, col, text, grid_span, row_span) of tables, null for other shapes.
    """
    deck = Deck(decks)
    slides = deck.slides().withColumnRenamed("slide_part", "part_path")
    found = shapes.shapes(deck.nodes)
    keys = ["deck_id", "part_path"]
    table = deck.nodes.filter(F.col("tag") == "tbl").select(*keys, F.col("nid").alias("frame"), F.col("owner").alias("nid"))
    kind = F.when(F.col("shape") == "pic", "picture").when(F.col("shape") == "grpSp", "group").when(F.col("frame").isNotNull(), "table").when(F.contains("uri", F.lit("chart")), "chart").when(F.col("shape") == "graphicFrame", "frame").otherwise("shape")
    paras = shapes.paragraphs(deck.nodes).groupBy(*keys, F.col("owner").alias("nid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("para_index", "level", "text"))), lambda p: F.struct(p["level"].alias("level"), p["text"].alias("text"))).alias("level_texts"))
    cell = F.struct("row", "col", "text", "grid_span", "row_span")
    cells = frames.cells(deck.nodes).groupBy(*keys, "frame").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    met = found.join(slides, keys).join(table, [*keys, "nid"], "left").join(paras, [*keys, "nid"], "left").join(cells, [*keys, "frame"], "left")
    text = F.array_join(F.transform("level_texts", lambda p: p["text"]), "\n")
    return met.select("deck_id", "slide_index", "nid", kind.alias("node_type"), "id", "name", "level_texts", F.when(F.trim(text) != "", text).alias("text"), "cells")
