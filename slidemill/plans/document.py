"""The document of a deck: slides with their elements, one row for each deck, lengths in points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.colors import css
from ..functions.media import media_type
from ..functions.outlines import custom_paths, preset_path
from ..functions.units import emu_to_px, px_to_pt
from ..operators import frames, looks, matrix, media, package, shapes, styles, tables, textbody
from ..operators.palette import painted, palettes, raw_colors, with_charts, with_drawings
from ..sources import archive, xmltree
from ..storage import cut, small_broadcasts, written


class Deck:
    """What the operators start from: parts and XML elements of decks (deck_id, content); elements are written once, for they are read many times.

    With ``only`` elements of other tags are left out, also for the relationships.
    """

    def __init__(self, decks: DataFrame, only: frozenset[str] | None = None, **limits: int):
        self.parts = archive.parts(decks, **limits)
        self.nodes = written(xmltree.deck_elements(decks, only, **limits))
        self.rels = package.relationships(self.nodes)

    def slides(self) -> DataFrame:
        return package.slides(self.nodes, self.rels, self.parts)


class Colors:
    """What colours of a deck come from: raw colours, palettes of parts with the styles of their themes, and colours where they stand."""

    def __init__(self, deck: Deck):
        raws = cut(raw_colors(deck.nodes))
        self.styles = matrix.Styles(deck.nodes, raws)
        self.drawings = cut(frames.diagram_drawings(deck.nodes, deck.rels, deck.parts))
        self.palette = cut(self.styles.scopes(with_charts(with_drawings(palettes(deck.nodes, deck.rels), self.drawings), deck.rels)))
        self.paint = cut(painted(raws, self.palette))


def elements(deck: Deck, order: DataFrame, colors: Colors | None = None) -> DataFrame:
    """(deck_id, part_path, nid, inner, ph, element): every shape of slides, layouts and masters as a document has it; order: the chain of slides.

    Places, turns and mirrors are those on the slide, whatever groups are around; group is the group's nid, 0 outside of groups.  Frames
    that hold neither a table, a chart, a diagram nor a picture of an object are left out.  A diagram is a group, in which the shapes of the part
    that draws it stand, moved to its frame: these have the frame's part, nid and group, and their own place in inner; one that nothing draws is left out.
    """
    nodes, rels = deck.nodes, deck.rels
    colors = colors or Colors(deck)
    palette, paint = colors.palette, colors.paint
    found = cut(shapes.flattened(cut(shapes.shapes(nodes))))
    behind = lambda part: found.filter(F.col("part_path").startswith(part))
    on_layouts, on_masters = behind("ppt/slideLayouts/"), behind("ppt/slideMasters/")
    # a slide may stand in the list twice: its shapes are placed once
    own = found.withColumnRenamed("part_path", "slide_part").join(order.select("deck_id", "slide_part", "layout_part", "master_part").distinct(), ["deck_id", "slide_part"])
    # placeholders that nothing places stay, at 0
    own = shapes.inherited(cut(own), on_layouts, on_masters).withColumnRenamed("slide_part", "part_path")
    masters = package.first_rel(rels, "slideMaster").select("deck_id", F.col("source_part").alias("part_path"), F.col("resolved").alias("master_part"))
    unmatched = {"l_match": F.lit(None).cast("int"), "m_match": F.lit(None).cast("int"), "l_placed": F.lit(False)}
    layouts = on_layouts.withColumns({"layout_part": F.col("part_path")} | unmatched).join(masters, ["deck_id", "part_path"], "left")
    rest = on_masters.withColumns({"layout_part": F.lit(None).cast("string"), "master_part": F.col("part_path")} | unmatched)
    own = own.unionByName(layouts.select(own.columns)).unionByName(rest.select(own.columns))
    # shapes of diagrams, once for each part that draws one; where they are shown is told at the end
    chains = order.select("deck_id", F.col("slide_part").alias("shown_on"), "layout_part", "master_part").distinct()
    first = colors.drawings.groupBy("deck_id", F.col("drawing").alias("part_path")).agg(F.min("part_path").alias("shown_on"))
    drawing = behind("ppt/diagrams/").join(first, ["deck_id", "part_path"]).join(chains, ["deck_id", "shown_on"]).withColumns(unmatched)
    found = cut(shapes.boxes(own.unionByName(drawing.select(own.columns))))
    keys, by_nid = ["deck_id", "part_path"], ["deck_id", "part_path", "nid"]
    owned = lambda rows: rows.withColumnRenamed("owner", "nid")
    refs = cut(looks.references(nodes, paint))
    inks = refs.filter("font_color IS NOT NULL").select(*keys, F.col("owner").alias("nid"), css(F.col("font_color")).alias("font_color"))
    shown = textbody.style_placeholder(textbody.style_placeholder(found, "layout_part", on_layouts, "l_ph"), "master_part", on_masters, "m_ph")
    shown = cut(shown.select(*by_nid, "ph", "ph_type", "ph_idx", "layout_part", "master_part", "l_ph", "m_ph").join(inks, by_nid, "left"))
    table = nodes.filter(F.col("tag") == "tbl").select(*keys, F.col("nid").alias("frame"), F.col("owner").alias("nid"))
    cells = cut(tables.cells(nodes, colors.styles, palette))
    # texts of cells are bodies like those of shapes, with what the table's style says of text
    behind_cells = cells.join(table, [*keys, "frame"]).join(found.select(*by_nid, "layout_part", "master_part"), by_nid)
    behind_cells = behind_cells.select(*keys, F.col("tc").alias("nid"), F.lit(False).alias("ph"), F.lit(None).cast("string").alias("ph_type"), "layout_part", "master_part", *(F.lit(None).cast("int").alias(c) for c in ("l_ph", "m_ph")), "font_color", "font_bold")
    html = textbody.html(shown.drop("ph_idx").withColumn("font_bold", F.lit(None).cast("boolean")).unionByName(behind_cells), nodes, paint, rels, palette)
    seen = nodes.filter((F.col("tag") == "t") & (F.trim("text") != "")).select(*keys, F.col("owner").alias("nid")).distinct().withColumn("has_text", F.lit(True))
    line = F.col("line")
    own = looks.own_looks(colors.styles, refs, palette, looks.inherited_contents(shown, colors.styles))
    look = cut(own.select(*by_nid, "own_fill", "theme_fill", "more_fill", looks.border(F.when(line.isNotNull(), line)).alias("border"), line["head"].alias("head"), line["tail"].alias("tail"), "shadow"))
    groups = looks.group_fills(found, colors.styles, palette)
    cell = F.struct("row", "col", F.coalesce("html", F.lit("")).alias("text"), "grid_span", "row_span", "h_merge", "v_merge", "fill", "font_color", "font_bold", "valign", "borders")
    inner = cells.join(html.select(*keys, F.col("nid").alias("tc"), "html"), [*keys, "tc"], "left")
    inner = inner.groupBy(*keys, "frame").agg(F.array_sort(F.collect_list(cell), lambda a, b: F.when(a["row"] != b["row"], a["row"] - b["row"]).otherwise(a["col"] - b["col"])).alias("cells"), F.first("table_borders").alias("table_borders"))
    high = table.join(found.select(*by_nid, F.coalesce("cy", F.lit(0.0)).alias("cy")), by_nid).select(*keys, F.col("frame"), "cy")
    measured = tables.sizes(nodes, F.lit(None).cast("double")).join(high, [*keys, "frame"])
    even = F.when(F.forall("row_heights", lambda h: h.isNull()), F.transform("row_heights", lambda _: px_to_pt(emu_to_px(F.col("cy") / F.size("row_heights"))))).otherwise(F.col("row_heights"))
    grid = F.struct(even.alias("row_heights"), "col_widths", F.col("table_borders").alias("borders"))
    listed = inner.join(measured, [*keys, "frame"]).join(table, [*keys, "frame"]).select(*by_nid, "cells", grid.alias("table"))
    series = cut(frames.chart_series(nodes))
    options = frames.chart_options(nodes, series)
    data = series.groupBy(*keys, "chart").agg(F.transform(F.array_sort(F.collect_list(F.struct("series", "name", "categories", "values"))), lambda x: x.dropFields("series")).alias("data"))
    points = frames.scatter(series).select(*keys, F.struct("xs", "ys").alias("points"))
    inked = frames.series_colors(nodes, series, paint, palette)
    charts = data.join(options, keys, "left").join(points, keys, "left").join(inked, keys, "left").select("deck_id", F.col("part_path").alias("target"), F.struct("chart", "data", "colors", "points", "bar_dir", "grouping", "marker", "hole_size", "style").alias("chart"))
    target = rels.select("deck_id", F.col("source_part").alias("part_path"), "rid", F.col("resolved").alias("target"))
    met = styles.links(found, rels).join(target, [*keys, "rid"], "left").join(charts, ["deck_id", "target"], "left")
    # what is known of shapes meets in one grouping instead of a join for each table
    bent = custom_paths(nodes, found.filter("custom").select(*keys, F.col("nid").alias("owner"), F.col("width").alias("w"), F.col("height").alias("h"))).select(*keys, F.col("owner").alias("nid"), F.col("path").alias("custom_path"))
    filters = looks.picture_filters(nodes)
    changes = [c for c in filters.columns if c not in {*keys, "owner"}]
    filters = filters.select(*keys, "owner", F.when(F.coalesce(*changes).isNotNull(), F.struct(*changes)).alias("filters"))
    more = html
    for rows in (seen, listed, look, bent, styles.inherited_bodies(found, styles.bodies(nodes)), *map(owned, (looks.adjustments(nodes), looks.crops(nodes), filters)), media.sources(found, rels, deck.parts)):
        more = more.unionByName(rows, allowMissingColumns=True)
    more = more.groupBy(*by_nid).agg(*(F.first(c, True).alias(c) for c in more.columns if c not in by_nid))
    met = met.join(more, by_nid, "left").join(groups, [*keys, "group_nid"], "left")
    drawn, picture = F.col("shape").isin("sp", "cxnSp"), F.col("shape") == "pic"
    lineal = looks.line_like(F.col("shape"), F.col("prst"), F.col("width") / 0.75, F.col("height") / 0.75)
    own = F.when(F.col("own_fill.type") == "group", F.col("group_fill")).otherwise(F.col("own_fill"))
    met = met.withColumn("fill", F.when(~lineal, F.coalesce(own, "theme_fill", F.when(F.col("ph"), F.col("more_fill")))))
    fill = F.col("fill")
    # a picture paints nothing by itself, what is said to be clear does
    painted_ = (F.coalesce(fill["type"] != "image", F.lit(False)) | (~lineal & F.col("theme_fill").isNotNull())) | F.coalesce(F.col("border.width") > 0, F.lit(False))
    text = styles.is_text(F.col("text_box"), F.col("ph_type"), F.col("custom"), F.col("prst"), F.coalesce("has_text", F.lit(False)), painted_)
    kind = (
        F.when(F.col("formula").isNotNull() | (F.col("ole") == "word"), "math").when(F.col("shape") == "grpSp", "group").when(F.col("cells").isNotNull(), "table").when(F.contains("uri", F.lit("chart")), "chart")
        .when(F.col("shape") == "graphicFrame", F.when(F.contains("uri", F.lit("diagram")), "group").when(F.contains("uri", F.lit("ole")) & (F.col("ole") == "picture"), "image").otherwise("frame"))
        .when(F.col("shape") == "pic", F.when(F.col("video_rid").isNotNull(), "video").when(F.col("audio_rid").isNotNull(), "audio").otherwise("image")).when(text, "text").otherwise("shape")
    )
    path = F.when(drawn, F.coalesce(F.when(F.col("prst").isNotNull(), preset_path(F.col("prst"), F.col("width"), F.col("height"))), F.col("custom_path")))
    outline = F.when(drawn, F.when((F.col("shape") == "cxnSp") & (F.col("prst") == "line"), "straightConnector1").otherwise(F.coalesce("prst", F.when(F.col("custom"), "custom"), F.lit("rect")))).when(picture, F.coalesce("prst", F.lit("rect")))
    filled = F.when(drawn, F.coalesce(fill, matrix.plain(F.lit("transparent"))))
    # a video shows its picture, or else itself; a sound has itself alone
    medium = F.when(picture & F.col("video_rid").isNotNull(), F.coalesce("poster", "blob")).when(picture & F.col("audio_rid").isNotNull(), F.col("blob")).when(picture | F.col("ole").isNotNull() | F.col("formula").isNotNull(), F.col("target"))
    # a line along an axis is a pixel thick
    axis = F.when(drawn & lineal & ((F.col("width") >= 0.75) | (F.col("height") >= 0.75)), looks.line_axis(F.col("width") / 0.75, F.col("height") / 0.75))
    across = F.aggregate("table.col_widths", F.lit(0.0), lambda a, w: a + w)
    thick = {"width": F.when(across > 0, across).when((axis == "v") & (F.col("width") < 0.75), 0.75).otherwise(F.col("width")), "height": F.when((axis == "h") & (F.col("height") < 0.75), 0.75).otherwise(F.col("height"))}
    element = F.struct(
        "nid", kind.alias("type"), "name", "left", "top", *(c.alias(k) for k, c in thick.items()), "rotate", F.col("flip_h").alias("isFlipH"), F.col("flip_v").alias("isFlipV"), outline.alias("shapType"), path.alias("path"), F.col("html").alias("content"),
        filled.alias("fill"), F.when(drawn | picture, F.coalesce("border", looks.no_border())).alias("border"), "shadow", "link", F.when(drawn, F.col("valign")).alias("vAlign"), F.when(drawn, F.col("vertical")).alias("isVertical"), "autofit", "font_scale", "keypoints", "head", "tail", "crop", F.when(picture, F.col("filters")).alias("filters"), medium.alias("ref"), F.when(picture, F.col("blob")).alias("blob"), media_type(medium).alias("media_type"),
        F.col("cells").alias("cells"), "table", "chart", F.col("group_nid").alias("group"), F.col("formula").alias("text"),
    )
    every = met.select(*by_nid, "ph", "cx", "cy", F.contains("uri", F.lit("diagram")).alias("diagram"), element.alias("element")).filter("element.type <> 'frame'")
    # diagrams: frames with a drawing stay, and its shapes are moved to them
    every = cut(every.join(colors.drawings, by_nid, "left").filter("diagram IS NULL OR NOT diagram OR drawing IS NOT NULL"))
    frame = every.filter("drawing IS NOT NULL").select("deck_id", F.col("drawing").alias("part_path"), F.col("part_path").alias("on_part"), F.col("nid").alias("on_nid"), F.col("element.left").alias("dx"), F.col("element.top").alias("dy"))
    inside = every.filter(F.col("part_path").startswith("ppt/diagrams/")).join(frame, ["deck_id", "part_path"])
    moved = F.col("element").withField("left", F.round(F.col("element.left") + F.col("dx"), 4)).withField("top", F.round(F.col("element.top") + F.col("dy"), 4)).withField("group", F.col("on_nid")).withField("nid", F.col("on_nid"))
    inside = inside.select("deck_id", F.col("on_part").alias("part_path"), F.col("on_nid").alias("nid"), F.col("nid").alias("inner"), "ph", "cx", "cy", moved.alias("element"))
    rest = every.filter(~F.col("part_path").startswith("ppt/diagrams/")).withColumn("inner", F.lit(0))
    return rest.select(inside.columns).unionByName(inside)


def documents(decks: DataFrame) -> DataFrame:
    """(deck_id, size, theme_colors, slides): slides in order, each with its elements in document order and those of its master and layout, its
    background, note and transition; texts as HTML.

    Many tables meet here, each of which the driver would hold if it were broadcast: all but small ones are shuffled, and the result is cut, so that this goes for all jobs.
    """
    with small_broadcasts(decks.sparkSession):
        return cut(_documents(decks))


def _documents(decks: DataFrame) -> DataFrame:
    deck = Deck(decks)
    # lineage is cut where several steps go on from a table: plans would hold the way there once for each
    deck.parts = cut(deck.parts.drop("content"))
    deck.rels = cut(package.relationships(deck.nodes))
    order = cut(package.chain(deck.slides(), deck.rels))
    colors = Colors(deck)
    every = cut(elements(deck, order, colors))
    in_order = lambda a, b: F.when(a["nid"] != b["nid"], a["nid"] - b["nid"]).otherwise(a["inner"] - b["inner"])
    listed = lambda rows, part, name: rows.groupBy("deck_id", F.col("part_path").alias(part)).agg(F.transform(F.array_sort(F.collect_list(F.struct("nid", "inner", "element")), in_order), lambda x: x["element"]).alias(name))
    own = listed(every, "slide_part", "elements")
    seen = styles.decorations(every)
    on_layout, on_master = listed(seen.filter(F.col("part_path").startswith("ppt/slideLayouts/")), "layout_part", "on_layout"), listed(seen.filter(F.col("part_path").startswith("ppt/slideMasters/")), "master_part", "on_master")
    shows = package.master_shapes_shown(deck.nodes)
    of = lambda part, name: shows.select("deck_id", F.col("part_path").alias(part), F.col("shows").alias(name))
    none = F.array().cast(own.schema["elements"].dataType)
    met = matrix.backgrounds(order, colors.styles, colors.palette, deck.rels, deck.parts.filter("kind = 'media'"))
    for rows, on in ((own, "slide_part"), (on_layout, "layout_part"), (on_master, "master_part"), (of("slide_part", "slide_shows"), "slide_part"), (of("layout_part", "layout_shows"), "layout_part"), (package.notes(deck.nodes, deck.rels), "slide_part")):
        met = met.join(rows, ["deck_id", on], "left")
    change = styles.transitions(deck.nodes).select("deck_id", F.col("part_path").alias("slide_part"), F.struct("type", "duration", "direction").alias("transition"))
    met = met.join(change, ["deck_id", "slide_part"], "left")
    # what lies behind a slide: the master's shapes, then the layout's
    visible = F.coalesce("slide_shows", F.lit(True))
    backing = F.concat(F.when(visible & F.coalesce("layout_shows", F.lit(True)), F.coalesce("on_master", none)).otherwise(none), F.when(visible, F.coalesce("on_layout", none)).otherwise(none))
    slide = F.struct("slide_index", "slide_part", F.coalesce("elements", none).alias("elements"), backing.alias("layoutElements"), "background", F.coalesce("note", F.lit("")).alias("note"), "transition")
    slides = met.groupBy("deck_id").agg(F.array_sort(F.collect_list(slide), lambda a, b: a["slide_index"] - b["slide_index"]).alias("slides"))
    # the accents are those of the theme that comes first in the archive
    placed = deck.parts.filter("kind = 'theme'").select("deck_id", "part_path", "ordinal")
    accents = package.theme_colors(deck.nodes).join(placed, ["deck_id", "part_path"]).groupBy("deck_id").agg(F.min_by("colors", "ordinal").alias("colors"))
    six = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.lit("#"), F.coalesce(F.col("colors")[F.concat(F.lit("accent"), i.cast("string"))], F.lit("000000"))))
    met = slides.join(package.slide_size(deck.nodes), "deck_id", "left").join(accents, "deck_id", "left")
    return met.select("deck_id", F.struct("width", "height").alias("size"), six.alias("theme_colors"), "slides")


def as_json(docs: DataFrame) -> DataFrame:
    """(deck_id, document): each document as one JSON string."""
    return docs.select("deck_id", F.to_json(F.struct("slides", "theme_colors", "size")).alias("document"))
