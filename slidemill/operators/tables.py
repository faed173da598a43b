"""Looks of table cells: fills, four borders and text of the style's sections that hold for a cell, under what the cell says itself.

A style's colours are resolved once for each slide that uses it, not for each cell; cells then fold over their sections, in which a value, an
explicit none and nothing at all are three different things.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colors import css
from ..functions.text import border_type
from ..functions.units import emu_to_px, px_to_pt
from ..sources.xmltree import attr, number
from . import frames, matrix
from .palette import KEYS
from .styles import valign

STYLES = "ppt/tableStyles.xml"
SECTIONS = ["wholeTbl", "band1H", "band2H", "band1V", "band2V", "firstRow", "lastRow", "firstCol", "lastCol"]
SIDES = ["top", "bottom", "left", "right"]
#: The elements of a cell's own borders; the width in EMU of a theme's line without one.
OWN = {"lnT": "top", "lnB": "bottom", "lnL": "left", "lnR": "right"}
THIN = 12700
BORDER = "struct<color:string,width:double,type:string>"


def _section_rows(styles: matrix.Styles) -> DataFrame:
    """(deck_id, style, section, kind, side, tag, content, line, idx, bold): what sections of table styles say: fills, text and borders; section is '' for the table's background."""
    named, place = "|".join(SECTIONS), lambda *tags: F.array_position(F.array(*map(F.lit, tags)), F.col("tag"))
    nodes = styles.nodes.filter((F.col("part_path") == STYLES) & F.col("owner").isNotNull()).select(*KEYS, "nid", "parent", "owner", "tag", "way", "attrs")
    inked = nodes.join(styles.raws.withColumnRenamed("holder", "nid"), [*KEYS, "nid"], "left")
    part = lambda pattern, i: F.regexp_extract("way", pattern, i)

    def first(pattern: str, kind: str, order: Column, *more: Column) -> DataFrame:
        rows = inked.filter(F.col("way").rlike(pattern)).withColumn("section", part(pattern, 1))
        got = rows.groupBy("deck_id", F.col("owner").alias("style"), "section").agg(F.min_by(F.struct("tag", "raw", *more), F.struct(order, "nid")).alias("x"))
        return got.select("deck_id", "style", "section", F.lit(kind).alias("kind"), "x.*")

    fill = first(f"^({named})/tcStyle/fill/(?:solidFill|fillRef|noFill)$", "fill", place("solidFill", "fillRef", "noFill"))
    back = first("^()tblBg/(?:solidFill|fillRef)$", "back", place("fillRef", "solidFill"))
    # of a text style the first colour counts, be it in a fill or not
    text = f"^({named})/tcTxStyle(?:/solidFill)?$"
    said = inked.filter(F.col("way").rlike(text)).groupBy("deck_id", F.col("owner").alias("style"), part(text, 1).alias("section")).agg(
        F.min_by("raw", F.when(F.col("raw").isNotNull(), F.col("nid"))).alias("raw"), F.min_by(F.when(attr("b") == "on", True).when(attr("b") == "off", False), F.when(F.col("tag") == "tcTxStyle", F.col("nid"))).alias("bold")
    )
    said = said.withColumn("kind", F.lit("text"))
    edge = f"^({named})/tcStyle/tcBdr/(top|bottom|left|right|insideH|insideV)/(?:ln|lnRef)$"
    at = lambda rows: rows.withColumns({"section": part(edge, 1), "side": part(edge, 2)})
    own = at(styles.lines.filter((F.col("part_path") == STYLES) & F.col("way").rlike(edge))).groupBy("deck_id", F.col("owner").alias("style"), "section", "side").agg(F.min_by("line", "holder").alias("line"))
    referred = at(inked.filter(F.col("way").rlike(edge) & (F.col("tag") == "lnRef"))).groupBy("deck_id", F.col("owner").alias("style"), "section", "side").agg(F.min_by(F.struct("raw", F.coalesce(number(attr("idx")), F.lit(0.0)).cast("int").alias("idx")), "nid").alias("x"))
    # a line of its own counts before a reference
    edges = own.join(referred, ["deck_id", "style", "section", "side"], "full").select("deck_id", "style", "section", "side", F.lit("border").alias("kind"), "line", F.when(F.col("line").isNull(), F.col("x.raw")).alias("raw"), F.when(F.col("line").isNull(), F.col("x.idx")).alias("idx"))
    every = fill.unionByName(back).unionByName(said, allowMissingColumns=True).unionByName(edges, allowMissingColumns=True)
    content = F.when(F.col("line").isNotNull(), matrix.line_content(F.col("line"))).when(F.col("raw").isNotNull(), matrix.solid(F.col("raw")))
    return every.select("deck_id", "style", "section", "kind", "side", "tag", content.alias("content"), "line", "idx", "bold")


def _edge(line: Column, idx: Column, color: Column, theme: Column) -> Column:
    """A border of a line of its own or of a reference to a theme's; null for none."""
    width = F.coalesce(F.when(line["w"] > 0, emu_to_px(line["w"])), emu_to_px(F.lit(float(matrix.THIN))))
    own = F.when(~line["none"] & line["plain"] & ~F.coalesce(F.size(line["gradient"]["stops"]) > 0, F.lit(False)), F.struct(color.alias("color"), (width * 0.75).alias("width"), border_type(F.coalesce(line["dash"], F.lit("solid"))).alias("type")))
    entry = F.try_element_at(theme, idx)
    thick = F.when(entry.isNotNull(), emu_to_px(F.coalesce(entry["w"], F.lit(float(THIN))))).otherwise(1.0)
    referred = F.when((idx > 0) & (thick > 0), F.struct(color.alias("color"), (thick * 0.75).alias("width"), F.lit("solid").alias("type")))
    return F.when(line.isNotNull(), own).otherwise(referred).cast(BORDER)


def cells(nodes: DataFrame, styles: matrix.Styles, palette: DataFrame) -> DataFrame:
    """(deck_id, part_path, frame, tc, row, col, text, grid_span, row_span, h_merge, v_merge, fill, font_color, font_bold, valign, borders, table_borders): cells with their looks; colours as CSS.

    borders is a struct of top, bottom, left and right, each a struct color, width (points), type, or null.  Inner borders of a section count for edges with
    a neighbour, before its outer ones.  palette: with the styles of themes.
    """
    flags = ["bandRow", "bandCol", "firstRow", "lastRow", "firstCol", "lastCol"]
    about = frames.table_flags(nodes)
    grid = nodes.filter(F.col("tag") == "gridCol").join(nodes.filter(F.col("tag") == "tblGrid").select(*KEYS, F.col("nid").alias("parent"), F.col("parent").alias("frame")), [*KEYS, "parent"])
    grid = grid.groupBy(*KEYS, "frame").agg(F.count("*").alias("cols"))
    known = nodes.filter((F.col("part_path") == STYLES) & (F.col("tag") == "tblStyle")).groupBy("deck_id", attr("styleId").alias("style_id")).agg(F.min("nid").alias("style"))
    used = about.filter("style_id IS NOT NULL").select(*KEYS, "style_id").distinct().join(known, ["deck_id", "style_id"])
    wanted = used.join(_section_rows(styles), ["deck_id", "style"]).drop("style")
    mine = styles.fills.filter(F.col("way") == "tcPr/solidFill").groupBy(*KEYS, F.col("owner").alias("tc")).agg(F.min_by("content", "holder").alias("content")).withColumn("kind", F.lit("fill"))
    lines = styles.lines.filter(F.col("way").rlike("^tcPr/ln[LRTB]$")).withColumn("side", F.element_at(F.create_map(*(F.lit(x) for pair in OWN.items() for x in pair)), F.substring("way", 6, 3)))
    lines = lines.groupBy(*KEYS, F.col("owner").alias("tc"), "side").agg(F.min_by("line", "holder").alias("line")).select(*KEYS, "tc", "side", "line", matrix.line_content(F.col("line")).alias("content"), F.lit("border").alias("kind"))
    every = wanted.unionByName(mine, allowMissingColumns=True).unionByName(lines, allowMissingColumns=True).withColumn("reference", F.lit(None).cast("struct<hex:string,alpha:double>"))
    found = matrix.resolved(every, palette).join(palette.select(*KEYS, "line_styles"), KEYS, "left")
    color = F.when(F.col("ink").isNotNull(), css(F.struct(F.col("ink.hex").alias("hex"), F.col("ink.alpha").alias("alpha"))))
    # a fill or line without a colour in it is black
    color = F.when(F.col("tag") == "noFill", None).when(F.col("kind") == "text", color).otherwise(F.coalesce(color, F.lit("#000000")))
    found = found.select(*KEYS, "style_id", "tc", "section", "kind", "side", "bold", color.alias("color"), F.when(F.col("kind") == "border", _edge(F.col("line"), F.col("idx"), color, F.col("line_styles"))).alias("edge"), F.col("line.none").alias("none"))
    said = lambda kind, *what: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct(*what)))).alias(f"{kind}s")
    edge = F.map_from_entries(F.collect_list(F.when((F.col("kind") == "border") & F.col("edge").isNotNull(), F.struct(F.concat_ws("/", "section", "side"), "edge")))).alias("borders")
    by_style = found.filter("style_id IS NOT NULL").groupBy(*KEYS, "style_id").agg(said("fill", "section", F.struct("color")), said("text", "section", F.struct("color", "bold")), edge, F.first(F.when(F.col("kind") == "back", F.col("color")), True).alias("back"), F.collect_set(F.nullif("section", F.lit(""))).alias("there"))
    own = found.filter("tc IS NOT NULL").groupBy(*KEYS, "tc").agg(F.first(F.when(F.col("kind") == "fill", F.col("color")), True).alias("own_fill"), F.map_from_entries(F.collect_list(F.when(F.col("kind") == "border", F.struct("side", F.struct("edge", "none"))))).alias("own_edges"))
    anchor = nodes.filter(F.col("way") == "tcPr").groupBy(*KEYS, F.col("owner").alias("tc")).agg(F.min_by(attr("anchor"), "nid").alias("anchor"))
    rows = frames.cells(nodes)
    counts = rows.groupBy(*KEYS, "frame").agg((F.max("row") + 1).alias("rows"))
    met = rows.join(counts, [*KEYS, "frame"]).join(grid, [*KEYS, "frame"], "left").join(about, [*KEYS, "frame"], "left").fillna(False, flags).fillna(0, ["cols"])
    met = met.join(by_style, [*KEYS, "style_id"], "left").join(own, [*KEYS, "tc"], "left").join(anchor, [*KEYS, "tc"], "left")
    there = F.coalesce("there", F.array().cast("array<string>"))
    met = met.withColumn("sections", frames.style_sections(F.col("row"), F.col("col"), F.col("rows"), F.col("cols"), {c: F.col(c) for c in flags}, there))
    fold = lambda start, step: F.aggregate("sections", start, step)
    fill = fold(F.lit(None).cast("string"), lambda a, s: F.when(F.map_contains_key("fills", s), F.try_element_at("fills", s)["color"]).otherwise(a))
    text = F.try_element_at("texts", F.try_element_at(F.filter("sections", lambda s: F.map_contains_key("texts", s)), F.lit(-1)))
    inner = {"top": ("insideH", F.col("row") > 0), "bottom": ("insideH", F.col("row") < F.col("rows") - 1), "left": ("insideV", F.col("col") > 0), "right": ("insideV", F.col("col") < F.col("cols") - 1)}

    def border(side: str) -> Column:
        name, beside = inner[side]
        of = lambda s, x: F.try_element_at("borders", F.concat(s, F.lit(f"/{x}")))
        by_sections = fold(F.lit(None).cast(BORDER), lambda a, s: F.coalesce(F.when(beside, of(s, name)), of(s, side), a))
        mine = F.try_element_at("own_edges", F.lit(side))
        return F.when(F.coalesce(mine["none"], F.lit(False)), None).otherwise(F.coalesce(mine["edge"], F.when(F.col("borders").isNotNull(), by_sections))).alias(side)

    whole = F.struct(*(F.try_element_at("borders", F.lit(f"wholeTbl/{s}")).alias(s) for s in SIDES))
    styled = F.col("fills").isNotNull()
    return met.select(
        *KEYS, "frame", "tc", "row", "col", "text", "grid_span", "row_span", "h_merge", "v_merge", F.coalesce("own_fill", F.when(styled, fill), "back").alias("fill"), F.when(styled, text["color"]).alias("font_color"), F.when(styled, text["bold"]).alias("font_bold"),
        F.when(F.col("anchor").isin("ctr", "b", "t"), valign(F.col("anchor"))).alias("valign"), F.struct(*map(border, SIDES)).alias("borders"), whole.alias("table_borders"),
    )


def sizes(nodes: DataFrame, height: Column) -> DataFrame:
    """(deck_id, part_path, frame, row_heights, col_widths) in points; rows share ``height`` (EMU) where none has one."""
    points = lambda c: F.transform(c, lambda x: px_to_pt(emu_to_px(x)))
    widths = nodes.filter(F.col("tag") == "tblGrid").select(*KEYS, F.col("nid").alias("parent"), F.col("parent").alias("frame"))
    col = nodes.filter(F.col("tag") == "gridCol").select(*KEYS, "parent", "nid", F.coalesce(number(attr("w")), F.lit(0.0)).alias("w")).join(widths, [*KEYS, "parent"])
    col = col.groupBy(*KEYS, "frame").agg(points(F.transform(F.array_sort(F.collect_list(F.struct("nid", "w"))), lambda x: x["w"])).alias("col_widths"))
    return frames.row_heights(nodes, height).select(*KEYS, "frame", points("heights").alias("row_heights")).join(col, [*KEYS, "frame"], "left")
