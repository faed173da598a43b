"""Tables, charts and diagrams in frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colors import css
from ..functions.units import js_number
from ..sources.xmltree import attr, number
from .shapes import joined, runs
from .styles import series_color

#: Chart kinds in the order in which a part with several is looked through.
CHARTS = ["lineChart", "line3DChart", "barChart", "bar3DChart", "pieChart", "pie3DChart", "doughnutChart", "areaChart", "area3DChart", "scatterChart", "bubbleChart", "radarChart", "stockChart", "surfaceChart", "surface3DChart"]
#: Chart kinds that have numbers on both axes.
SCATTERED = ["scatterChart", "bubbleChart"]
#: Chart kinds that have a colour for each point of the first series.
PIES = ["pieChart", "pie3DChart", "doughnutChart"]
#: Where a series' colour may stand, in the order in which the first one counts.
INKED = ["spPr/solidFill", "spPr/ln/solidFill", "marker/spPr/solidFill", "marker/spPr/ln/solidFill"]


def cells(nodes: DataFrame) -> DataFrame:
    """(deck_id, part_path, frame, tc, row, col, text, grid_span, row_span, h_merge, v_merge): frame is the table's element, tc the cell's, row and col from 0."""
    keys = ["deck_id", "part_path"]
    tr = nodes.filter(F.col("tag") == "tr").select(*keys, F.col("parent").alias("frame"), F.col("nid").alias("tr"))
    tr = tr.withColumn("row", F.row_number().over(Window.partitionBy(*keys, "frame").orderBy("tr")) - 1)
    tc = nodes.filter(F.col("tag") == "tc").select(*keys, F.col("parent").alias("tr"), F.col("nid").alias("tc"), F.coalesce(attr("gridSpan").try_cast("int"), F.lit(1)).alias("grid_span"), F.coalesce(attr("rowSpan").try_cast("int"), F.lit(1)).alias("row_span"), *(F.coalesce(attr(c).isin("1", "true"), F.lit(False)).alias(a) for c, a in (("hMerge", "h_merge"), ("vMerge", "v_merge"))))
    tc = tc.withColumn("col", F.row_number().over(Window.partitionBy(*keys, "tr").orderBy("tc")) - 1)
    lines = joined(runs(nodes), [*keys, "owner", "para"], "run_ord", "text")
    text = joined(lines, [*keys, "owner"], "para", "text", "\n").withColumnRenamed("owner", "tc")
    return tr.join(tc, [*keys, "tr"]).join(text, [*keys, "tc"], "left").select(*keys, "frame", "tc", "row", "col", F.coalesce("text", F.lit("")).alias("text"), "grid_span", "row_span", "h_merge", "v_merge")


def row_heights(nodes: DataFrame, height: Column) -> DataFrame:
    """(deck_id, part_path, frame, heights): in EMU; where all are 0 the frame's height is shared evenly."""
    tr = nodes.filter(F.col("tag") == "tr").select("deck_id", "part_path", F.col("parent").alias("frame"), F.struct("nid", F.coalesce(number(attr("h")), F.lit(0.0)).alias("h")).alias("r"))
    got = tr.groupBy("deck_id", "part_path", "frame").agg(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["h"]).alias("heights"))
    return got.withColumn("heights", F.when(F.forall("heights", lambda h: h == 0), F.transform("heights", lambda _: height / F.size("heights"))).otherwise(F.col("heights")))


def banded(rows: DataFrame, first_row: Column) -> DataFrame:
    """cells with band (0 or 1, null in the first row if that is set apart)."""
    return rows.withColumn("band", F.when(first_row & (F.col("row") == 0), None).otherwise(F.pmod(F.col("row") - first_row.cast("int"), F.lit(2))))


def chart_series(nodes: DataFrame) -> DataFrame:
    """(deck_id, part_path, chart, series, name, categories, values) of each chart part's first kind, in the fixed order of kinds.

    Points that are left out are '' among categories and 0 among values, ptCount telling how many there are.  A series without a name goes by
    the number of its order, or else by its place from 0.
    """
    keys = ["deck_id", "part_path"]
    place = F.array_position(F.array(*map(F.lit, CHARTS)), F.col("tag"))
    chart = nodes.filter(F.col("tag").isin(*CHARTS)).groupBy(*keys).agg(F.min_by(F.struct("nid", "last", "tag"), F.struct(place, "nid")).alias("c"))
    ser = nodes.filter(F.col("tag") == "ser").select(*keys, F.col("nid").alias("owner")).join(chart, keys).filter("owner > c.nid AND owner <= c.last")
    ser = ser.withColumn("series", F.row_number().over(Window.partitionBy(*keys).orderBy("owner")) - 1)
    axis = F.when(F.col("way").rlike("^(cat|xVal)/"), "cat").when(F.col("way").rlike("^(val|yVal)/"), "val")
    below = nodes.filter(F.col("owner").isNotNull()).withColumn("axis", axis).filter("axis IS NOT NULL")
    pt = below.filter(F.col("tag") == "pt").select(*keys, "owner", "axis", F.col("nid").alias("parent"), attr("idx").try_cast("int").alias("idx"))
    v = below.filter(F.col("tag") == "v").select(*keys, "parent", F.col("text").alias("v"))
    points = pt.join(v, [*keys, "parent"]).groupBy(*keys, "owner", "axis", "idx").agg(F.max_by("v", "parent").alias("v"))
    dense = points.groupBy(*keys, "owner").pivot("axis", ["cat", "val"]).agg(F.map_from_entries(F.collect_list(F.struct("idx", "v"))))
    counts = below.filter(F.col("tag") == "ptCount").groupBy(*keys, "owner").pivot("axis", ["cat", "val"]).agg(F.min(attr("val").try_cast("int")))
    counts = counts.withColumnsRenamed({"cat": "n_cat", "val": "n_val"})
    filled = lambda m, n, other, as_: F.when(F.coalesce(n, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(as_(m[i]), F.lit(other)))).otherwise(F.array())
    named = nodes.filter(F.col("owner").isNotNull() & F.col("way").isin("order", "tx/v", "tx/strRef/strCache/pt/v")).groupBy(*keys, "owner").agg(F.min_by("text", F.when(F.col("way") != "order", F.col("nid"))).alias("said"), F.min_by(number(attr("val")), F.when(F.col("way") == "order", F.col("nid"))).alias("order"))
    met = ser.join(dense, [*keys, "owner"], "left").join(counts, [*keys, "owner"], "left").join(named, [*keys, "owner"], "left")
    return met.select(
        *keys, F.col("c.tag").alias("chart"), F.col("c.nid").alias("chart_nid"), "owner", "series", F.coalesce(F.nullif("said", F.lit("")), js_number(F.col("order")), F.col("series").cast("string")).alias("name"), filled(F.col("cat"), F.col("n_cat"), "", lambda x: x).alias("categories"), filled(F.col("val"), F.col("n_val"), 0.0, lambda x: x.try_cast("double")).alias("values")
    )


def scatter(series: DataFrame) -> DataFrame:
    """(deck_id, part_path, xs, ys): numbers on both axes of charts of points, of which the first series alone counts."""
    one = series.filter(F.col("chart").isin(*SCATTERED) & (F.col("series") == 0))
    return one.select("deck_id", "part_path", F.transform("categories", lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))).alias("xs"), F.col("values").alias("ys"))


def series_colors(nodes: DataFrame, series: DataFrame, paint: DataFrame, palette: DataFrame) -> DataFrame:
    """(deck_id, part_path, colors) of the charts whose series are given: a colour for each series, or for each point of a pie's first series.

    What says no colour has the theme's six accents in turn; a pie without points of its own has all six.  paint, palette: of ``palette.with_charts``.
    Colours are opaque; accents that nothing names, also where no slide shows the chart, are black.
    """
    keys = ["deck_id", "part_path"]
    accent = lambda i: F.concat(F.lit("#"), F.regexp_replace(F.coalesce(F.col("theme")[F.concat(F.lit("accent"), i.cast("string"))], F.lit("000000")), "^#", ""))
    six = F.transform(F.sequence(F.lit(1), F.lit(6)), accent)
    said = nodes.filter(F.col("owner").isNotNull() & F.col("way").isin(*INKED, "dPt", "dPt/spPr/solidFill")).select(*keys, "owner", "nid", "way").join(paint.withColumnRenamed("holder", "nid"), [*keys, "nid"], "left")
    said = said.withColumn("ink", F.when(F.col("way") != "dPt", F.coalesce(css(F.struct(F.col("color.hex").alias("hex"), F.lit(1.0).alias("alpha"))), F.lit("#000000"))))
    # a point's fill follows it: the last point that has begun has it
    order = Window.partitionBy(*keys, "owner").orderBy("nid").rowsBetween(Window.unboundedPreceding, 0)
    said = said.withColumn("point", F.when(F.col("way").startswith("dPt"), F.last(F.when(F.col("way") == "dPt", F.col("nid")), True).over(order)))
    own = said.groupBy(*keys, "owner", "point").agg(F.coalesce(*(F.min_by("ink", F.when(F.col("way") == w, F.col("nid"))) for w in [*INKED, "dPt/spPr/solidFill"])).alias("ink"))
    own = own.groupBy(*keys, "owner").agg(F.max(F.when(F.col("point").isNull(), F.col("ink"))).alias("ink"), F.array_sort(F.collect_list(F.when(F.col("point").isNotNull(), F.struct("point", "ink")))).alias("points"))
    met = series.select(*keys, "chart", "owner", "series").join(own, [*keys, "owner"], "left").join(palette.select(*keys, "theme"), keys, "left").withColumn("six", six)
    one = F.struct("series", series_color(F.col("ink"), F.col("series"), F.col("six")).alias("ink"))
    points = F.transform(F.col("points"), lambda p, i: series_color(p["ink"], i, F.col("six")))
    pie = F.when(F.col("series") == 0, F.when(F.size(points) > 0, points).otherwise(F.col("six")))
    met = met.select(*keys, "chart", one.alias("one"), pie.alias("pie")).groupBy(*keys).agg(F.first("chart").alias("chart"), F.array_sort(F.collect_list("one")).alias("all"), F.first("pie", True).alias("pie"))
    return met.select(*keys, F.when(F.col("chart").isin(*PIES), F.col("pie")).otherwise(F.transform("all", lambda x: x["ink"])).alias("colors"))


def chart_options(nodes: DataFrame, series: DataFrame) -> DataFrame:
    """(deck_id, part_path, bar_dir, grouping, marker, hole_size, style) of the charts whose series are given."""
    keys = ["deck_id", "part_path"]
    chart = series.select(*keys, F.col("chart_nid").alias("parent")).distinct()
    below = nodes.filter(F.col("tag").isin("barDir", "grouping", "marker", "holeSize", "scatterStyle", "radarStyle")).join(chart, [*keys, "parent"], "right")
    of = lambda tag: F.min_by(attr("val"), F.when(F.col("tag") == tag, F.col("nid")))
    got = below.groupBy(*keys).agg(of("barDir").alias("bar_dir"), of("grouping").alias("grouping"), F.max(F.coalesce(F.col("tag") == "marker", F.lit(False))).alias("marker"), of("holeSize").alias("hole_size"), F.coalesce(of("radarStyle"), of("scatterStyle")).alias("style"))
    return got.withColumn("bar_dir", F.when(F.col("bar_dir").isin("bar", "col"), F.col("bar_dir")))


def nearest_drawing(frames: DataFrame, drawings: DataFrame) -> DataFrame:
    """(deck_id, frame, drawing): of a deck's drawings the one whose number is nearest to the frame's, the first of equally near ones; a frame without a number takes the first.

    Drawings and frames stand in one line by number, and each frame looks at the drawing before it and the one after it: no pairs are made.
    """
    one = drawings.filter("drawing_number IS NOT NULL").groupBy("deck_id", F.col("drawing_number").alias("number")).agg(F.min("drawing").alias("drawing"))
    first = drawings.groupBy("deck_id").agg(F.min("drawing").alias("any"))
    rows = one.select("deck_id", "number", "drawing", F.lit(None).cast(frames.schema["frame"].dataType).alias("frame")).unionByName(frames.select("deck_id", "number", F.lit(None).cast(one.schema["drawing"].dataType).alias("drawing"), "frame"))
    found = F.when(F.col("drawing").isNotNull(), F.struct("number", "drawing"))
    line = Window.partitionBy("deck_id").orderBy("number", F.col("drawing").isNull())
    back = Window.partitionBy("deck_id").orderBy(F.desc("number"), F.col("drawing").isNull())
    met = rows.withColumns({"before": F.last(found, True).over(line.rowsBetween(Window.unboundedPreceding, 0)), "after": F.last(found, True).over(back.rowsBetween(Window.unboundedPreceding, 0))})
    met = met.filter("frame IS NOT NULL").join(first, "deck_id")
    far = lambda c: F.struct(F.abs(F.col(c)["number"] - F.col("number")).alias("far"), F.col(c)["drawing"].alias("drawing"))
    near = F.array_min(F.array_compact(F.array(*(F.when(F.col(c).isNotNull() & F.col("number").isNotNull(), far(c)) for c in ("before", "after")))))
    return met.select("deck_id", "frame", F.coalesce(near["drawing"], "any").alias("drawing"))


def diagram_drawings(nodes: DataFrame, rels: DataFrame, parts: DataFrame) -> DataFrame:
    """(deck_id, part_path, nid, drawing): the part that draws the diagram in each frame of a slide, of those that the slide has a relationship to and that are there.

    It is the one whose number is nearest to that of the diagram's data, the first of equally near ones, or just the first where the data has no number.
    Frames without any have no row.
    """
    keys = ["deck_id", "part_path"]
    number_ = lambda c, word: F.nullif(F.regexp_extract(c, rf"{word}(\d+)", 1), F.lit("")).cast("long")
    scope = F.struct("deck_id", "part_path")
    frame = nodes.filter((F.col("way") == "graphic/graphicData") & F.contains(attr("uri"), F.lit("diagram"))).select(*keys, F.col("owner").alias("nid"), F.col("nid").alias("parent"))
    data = nodes.filter(F.col("tag") == "relIds").groupBy(*keys, "parent").agg(F.min_by(F.coalesce(attr("r:dm"), attr("dm")), "nid").alias("rid"))
    target = rels.select("deck_id", F.col("source_part").alias("part_path"), "rid", number_(F.col("target"), "data").alias("number"))
    frame = frame.join(data, [*keys, "parent"], "left").join(target, [*keys, "rid"], "left").select(scope.alias("deck_id"), F.col("nid").alias("frame"), "number")
    there = parts.select("deck_id", F.col("part_path").alias("resolved"))
    drawn = rels.filter(F.contains("type", F.lit("diagramDrawing")) | F.contains("target", F.lit("diagrams/drawing"))).join(there, ["deck_id", "resolved"])
    drawn = drawn.select(F.struct("deck_id", F.col("source_part").alias("part_path")).alias("deck_id"), number_(F.col("target"), "drawing").alias("drawing_number"), F.struct("ord", "resolved").alias("drawing"))
    return nearest_drawing(frame, drawn).select("deck_id.*", F.col("frame").alias("nid"), F.col("drawing.resolved").alias("drawing"))


def baked(left: Column, top: Column, width: Column, height: Column, rotate: Column, flip_h: Column, flip_v: Column, group: dict[str, Column]) -> Column:
    """A child's struct left, top, rotate, flip_h, flip_v after its group (width, height, rotate, flip_h, flip_v) is turned and mirrored.

    Both mirrors together are half a turn.
    """
    h, v = group["flip_h"], group["flip_v"]
    x = F.when(h, group["width"] - left - width).otherwise(left)
    y = F.when(v, group["height"] - top - height).otherwise(top)
    turn = F.when(h & v, rotate + 180.0).when(h | v, -rotate).otherwise(rotate)
    dx, dy = x + width / 2.0 - group["width"] / 2.0, y + height / 2.0 - group["height"] / 2.0
    a = F.radians(group["rotate"])
    x2 = dx * F.cos(a) - dy * F.sin(a) + group["width"] / 2.0 - width / 2.0
    y2 = dx * F.sin(a) + dy * F.cos(a) + group["height"] / 2.0 - height / 2.0
    turned = group["rotate"] != 0
    one = lambda own, set_, other: F.when(set_ & ~other, ~own).otherwise(own)
    return F.struct(
        F.when(turned, x2).otherwise(x).alias("left"), F.when(turned, y2).otherwise(y).alias("top"), F.pmod(turn + group["rotate"], F.lit(360.0)).alias("rotate"), one(flip_h, h, v).alias("flip_h"), one(flip_v, v, h).alias("flip_v")
    )


def style_sections(row: Column, col: Column, rows: Column, cols: Column, flags: dict[str, Column], there: Column) -> Column:
    """Sections of a table's style that hold for a cell, later ones before earlier ones in force: those among ``there``, an array of names.

    flags: bandRow, bandCol, firstRow, lastRow, firstCol, lastCol.  A first row that is set apart shifts the bands of rows.
    """
    band = row - flags["firstRow"].cast("int")
    named = [
        (F.lit(True), "wholeTbl"), (flags["bandRow"] & (band >= 0) & (F.pmod(band, F.lit(2)) == 1), "band2H"), (flags["bandRow"] & (band >= 0) & (F.pmod(band, F.lit(2)) == 0), "band1H"),
        (flags["bandCol"] & (col % 2 == 1), "band2V"), (flags["bandCol"] & (col % 2 == 0), "band1V"), (flags["firstRow"] & (row == 0), "firstRow"), (flags["lastRow"] & (row == rows - 1), "lastRow"),
        (flags["firstCol"] & (col == 0), "firstCol"), (flags["lastCol"] & (col == cols - 1), "lastCol"),
    ]
    chosen = F.array_compact(F.array(*(F.when(on, F.lit(name)) for on, name in named)))
    return F.filter(chosen, lambda x: F.array_contains(there, x))


def table_flags(nodes: DataFrame) -> DataFrame:
    """(deck_id, part_path, frame, bandRow, bandCol, firstRow, lastRow, firstCol, lastCol, style_id) of tables, by attributes of tblPr."""
    pr = nodes.filter(F.col("tag") == "tblPr").select("deck_id", "part_path", F.col("parent").alias("frame"), F.col("nid").alias("pr"), *(F.coalesce(attr(c).isin("1", "true"), F.lit(False)).alias(c) for c in ("bandRow", "bandCol", "firstRow", "lastRow", "firstCol", "lastCol")))
    style = nodes.filter(F.col("tag") == "tableStyleId").select("deck_id", "part_path", F.col("parent").alias("pr"), F.trim("text").alias("style_id"))
    return pr.join(style, ["deck_id", "part_path", "pr"], "left").drop("pr")


def table_styles(nodes: DataFrame) -> DataFrame:
    """(deck_id, style_id, sections): names of the sections that each table style has."""
    styles = nodes.filter((F.col("tag") == "tblStyle") & (F.col("part_path") == "ppt/tableStyles.xml")).select("deck_id", F.col("nid").alias("parent"), attr("styleId").alias("style_id"))
    section = nodes.filter(F.col("part_path") == "ppt/tableStyles.xml").select("deck_id", "parent", "tag")
    return styles.join(section, ["deck_id", "parent"]).groupBy("deck_id", "style_id").agg(F.collect_set("tag").alias("sections"))
