"""Fills, lines and borders of shapes, with what they take from a theme's styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colors import let
from ..functions.text import border_type, dash_array
from ..functions.units import px_to_pt
from ..sources.xmltree import attr, number
from ..storage import cut
from . import matrix
from .palette import KEYS, shown

#: Outlines that are lines, beside connectors.
LINES = ["line", "lineinv", "arc", "leftbracket", "rightbracket", "leftbrace", "rightbrace", "bracketpair", "bracepair"]


def line_like(shape: Column, prst: Column, width: Column, height: Column) -> Column:
    """Whether a shape is a line: a connector, an outline without an inside, or one without height or width (lengths in pixels)."""
    key = F.lower(F.coalesce(prst, F.lit("")))
    flat = ((width >= 1) & (height < 1)) | ((width < 1) & (height >= 1))
    return (shape == "cxnSp") | key.isin(*LINES) | key.contains("connector") | F.coalesce(flat, F.lit(False))


def line_axis(width: Column, height: Column) -> Column:
    """h or v for lines along an axis, null for others."""
    return F.when((height == 0) | ((width >= 1) & (height < 1)), "h").when((width == 0) | ((height >= 1) & (width < 1)), "v")


def visible_stop(stops: Column) -> Column:
    """The first colour of stops (pos, color) that shows: not white, and not nearly clear; the last one where none does."""
    clear = lambda c: F.coalesce(F.conv(F.nullif(F.substring(c, 8, 2), F.lit("")), 16, 10).cast("int") < 77, F.lit(False))
    good = F.filter(stops, lambda s: ~clear(s["color"]) & (F.substring(s["color"], 1, 7) != "#ffffff"))
    return F.coalesce(F.try_element_at(good, F.lit(1))["color"], F.try_element_at(stops, F.lit(-1))["color"], F.lit("#000000"))


def references(nodes: DataFrame, paint: DataFrame) -> DataFrame:
    """(deck_id, part_path, owner, fill_idx, fill_color, line_idx, line_color, effect_idx, font_color): what shapes refer to in their theme; null for no reference.  A reference without a colour is black, but for that of fonts."""
    refs = nodes.filter(F.col("way").rlike("^style/(fillRef|lnRef|effectRef|fontRef)$")).select(*KEYS, "owner", "tag", F.col("nid").alias("holder"), F.coalesce(number(attr("idx")), F.lit(0.0)).cast("int").alias("idx")).join(paint, [*KEYS, "holder"], "left")
    black = F.struct(F.lit("000000").alias("hex"), F.lit(1.0).alias("alpha"))
    first = lambda tag, what: F.min_by(what, F.when(F.col("tag") == tag, F.col("holder")))
    color = lambda tag: first(tag, F.coalesce("color", black))
    return refs.groupBy(*KEYS, "owner").agg(first("fillRef", "idx").alias("fill_idx"), color("fillRef").alias("fill_color"), first("lnRef", "idx").alias("line_idx"), color("lnRef").alias("line_color"), first("effectRef", "idx").alias("effect_idx"), first("fontRef", "color").alias("font_color"))


def own_looks(styles: matrix.Styles, refs: DataFrame, palette: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(deck_id, part_path, nid, own_fill, theme_fill, more_fill, line, shadow): what shapes look like by their own elements, by their theme's styles and by ``more``.

    The theme's line stands in whole for one that is absent or said not to be there; its effects for a shape that has no list of its own.  line
    is a struct as ``matrix.drawn`` gives it; theme_fill is there where a shape refers to a fill at all: the theme's entry at that place, or where it has
    none of its own the reference's colour.  palette: with the styles of themes; more: (deck_id, part_path, nid, content), contents from elsewhere.
    """
    rows = styles.own("spPr").unionByName(refs.drop("font_color"), allowMissingColumns=True)
    rows = rows.groupBy(*KEYS, "owner").agg(*(F.first(c, True).alias(c) for c in rows.columns if c not in {*KEYS, "owner"})).join(palette, KEYS, "left")
    entry = lambda idx, of: F.when(F.col(idx) > 0, F.try_element_at(F.col(of), F.col(idx)))
    rows = rows.select(
        *KEYS, F.col("owner").alias("nid"), "content", F.col("line").alias("own_line"), "fill_idx", "fill_color", "line_idx", "line_color",
        entry("fill_idx", "fill_styles").alias("theme_content"), entry("line_idx", "line_styles").alias("theme_line"), F.coalesce("effect", entry("effect_idx", "effect_styles")).alias("effect"),
    )
    explicit = F.col("own_line").isNotNull() & ~F.coalesce(F.col("own_line.none"), F.lit(False))
    rows = cut(rows.withColumn("line", F.when(explicit, F.col("own_line")).otherwise(F.col("theme_line"))))
    no_color = F.lit(None).cast("struct<hex:string,alpha:double>")
    lines = matrix.line_content(F.col("line"))
    shadow = matrix.solid(F.col("effect.raw"))
    layer = lambda name, content, reference=no_color: F.struct(F.lit(name).alias("layer"), content.alias("content"), reference.alias("reference"))
    layers = F.array(
        layer("own", F.col("content")), layer("theme", F.when(F.col("theme_content.tag").isin("solidFill", "gradFill", "pattFill", "noFill"), F.col("theme_content")), F.when(F.col("theme_content.tag") != "pattFill", F.col("fill_color"))),
        layer("line", lines, F.when(lines["tag"] == "solidFill", F.col("line_color"))), layer("shadow", F.when(F.col("effect.inset").isNotNull(), shadow)),
    )
    each = rows.select(*KEYS, "nid", F.inline(layers))
    if more is not None:
        each = each.unionByName(more.select(*KEYS, "nid", F.lit("more").alias("layer"), "content", no_color.alias("reference")))
    each = matrix.resolved(each.filter("content IS NOT NULL"), palette).drop("content", "reference")
    of = lambda name, what: F.first(F.when(F.col("layer") == name, F.col(what)), True)
    got = cut(each.groupBy(*KEYS, "nid").agg(of("own", "fill").alias("own_fill"), of("theme", "fill").alias("theme_fill"), of("line", "fill").alias("line_fill"), of("shadow", "ink").alias("shadow_ink"), of("more", "fill").alias("more_fill")))
    met = rows.join(got, [*KEYS, "nid"], "full")
    by_theme = F.when(F.col("fill_idx").isNotNull(), F.coalesce(matrix.without_gaps(F.col("theme_fill")), matrix.plain(F.coalesce(shown(F.col("fill_color")), F.lit("#000000")))))
    line = matrix.drawn(*map(F.col, ("line", "own_line", "theme_line", "line_idx", "line_color", "line_fill")))
    return met.select(*KEYS, "nid", "own_fill", by_theme.alias("theme_fill"), matrix.without_gaps(F.col("more_fill")).alias("more_fill"), line.alias("line"), matrix.shaded(F.col("effect"), F.col("shadow_ink")).alias("shadow"))


def inherited_contents(bodies: DataFrame, styles: matrix.Styles) -> DataFrame:
    """(deck_id, part_path, nid, content): the fill that placeholders take from their layout's placeholder, or else their master's; bodies: shapes with l_ph and m_ph.

    A plain colour counts if it is written out or a scheme's, a gradient if it has stops, and so do patterns; other fills, and noFill, let the search go on.
    """
    own = styles.own("spPr").filter("content IS NOT NULL")
    met = bodies.filter("ph AND (l_ph IS NOT NULL OR m_ph IS NOT NULL)").select(*KEYS, "nid", "layout_part", "master_part", "l_ph", "m_ph")
    for part, nid, name in (("layout_part", "l_ph", "l_content"), ("master_part", "m_ph", "m_content")):
        met = met.join(own.select("deck_id", F.col("part_path").alias(part), F.col("owner").alias(nid), F.col("content").alias(name)), ["deck_id", part, nid], "left")

    def usable(c: Column) -> Column:
        told = (c["tag"] == "solidFill") & c["raw"]["tag"].isin("srgbClr", "schemeClr", "scrgbClr", "sysClr")
        return F.when(told | (c["tag"] == "pattFill") | ((c["tag"] == "gradFill") & (F.size(c["gradient"]["stops"]) > 0)), c)

    return met.select(*KEYS, "nid", F.coalesce(usable(F.col("l_content")), usable(F.col("m_content"))).alias("content")).filter("content IS NOT NULL")


def group_fills(found: DataFrame, styles: matrix.Styles, palette: DataFrame) -> DataFrame:
    """(deck_id, part_path, group_nid, group_fill): for each group the fill of the nearest one, itself or around it, that has one; found: shapes with group_nid.

    A group without a fill points to the one around it; each round lets pointers point to where their targets point.
    """
    own = styles.own("grpSpPr").filter(F.col("content.tag").isin("solidFill", "gradFill", "blipFill", "pattFill")).select(*KEYS, F.col("owner").alias("nid"), "content", F.lit(None).cast("struct<hex:string,alpha:double>").alias("reference"))
    own = matrix.resolved(own, palette).select(*KEYS, "nid", "fill")
    groups = found.filter(F.col("shape") == "grpSp").select(*KEYS, "nid", "group_nid").join(own, [*KEYS, "nid"], "left")
    at = cut(groups.select(*KEYS, F.col("nid").alias("at"), F.when(F.col("fill").isNotNull(), 0).otherwise(F.col("group_nid")).alias("up"), F.col("fill").alias("group_fill")))
    while at.filter("up > 0").limit(1).count():
        outer = at.select(*KEYS, F.col("at").alias("up"), F.col("up").alias("o_up"), F.col("group_fill").alias("o_fill"))
        at = cut(at.join(outer, [*KEYS, "up"], "left").select(*KEYS, "at", F.coalesce("o_up", F.lit(0)).alias("up"), F.coalesce("group_fill", "o_fill").alias("group_fill")))
    return at.select(*KEYS, F.col("at").alias("group_nid"), "group_fill")


def no_border() -> Column:
    """The border of what has no line."""
    return F.struct(F.lit("#000000").alias("color"), F.lit(0.0).alias("width"), F.lit("solid").alias("type"), F.lit("0").alias("dashes"))


def border(line: Column) -> Column:
    """A struct color, width (points), type, dashes of a row of lines; nothing to see is black and 0 wide."""

    def made(x: Column) -> Column:
        gradient = F.coalesce(F.size(x["stops"]) > 0, F.lit(False))
        seen = ~x["none"] & (gradient | (x["color"].isNotNull() & (x["width"] > 0)))
        width = F.when(gradient, F.greatest(x["width"], F.lit(1.0))).otherwise(x["width"])
        dashes = F.array_join(F.transform(F.filter(F.split(dash_array(x["dash"], x["width"]), ","), lambda d: d != ""), lambda d: F.format_string("%.2f", px_to_pt(d.cast("double")))), ",")
        return F.struct(
            F.when(seen, F.when(gradient, visible_stop(x["stops"])).otherwise(x["color"])).otherwise("#000000").alias("color"), F.when(seen, px_to_pt(width)).otherwise(0.0).alias("width"),
            F.when(seen & ~gradient, border_type(x["dash"])).otherwise("solid").alias("type"), F.when(seen & ~gradient, dashes).otherwise("0").alias("dashes"),
        )

    return let(line, made)


def adjustments(nodes: DataFrame) -> DataFrame:
    """(deck_id, part_path, owner, adjust, keypoints): guides of presets by name, the last of a name, and their shares of a half."""
    gd = nodes.filter((F.col("way") == "spPr/prstGeom/avLst/gd") & attr("name").isNotNull()).select(*KEYS, "owner", "nid", attr("name").alias("name"), F.regexp_extract(attr("fmla"), r"^(?:val\s+)?(-?\d+(?:\.\d+)?)$", 1).try_cast("double").alias("value")).filter("value IS NOT NULL")
    last = gd.groupBy(*KEYS, "owner", "name").agg(F.max_by("value", "nid").alias("value"))
    got = last.groupBy(*KEYS, "owner").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("adjust"))
    return got.withColumn("keypoints", F.transform_values("adjust", lambda k, v: v / 50000.0))


def picture_filters(nodes: DataFrame) -> DataFrame:
    """(deck_id, part_path, owner, brightness, contrast, saturation, temperature, sharpen, opacity): changes of pictures, those of the later format before a plain lum; opacity is null where it is 1."""
    rows = nodes.filter(F.col("owner").isNotNull() & F.col("tag").isin("lum", "brightnessContrast", "saturation", "colorTemperature", "sharpenSoften", "alphaModFix", "alphaMod", "alphaOff") & F.col("way").startswith("blipFill/blip/"))
    of = lambda tag, name: F.min_by(number(attr(name)), F.when(F.col("tag") == tag, F.col("nid"))) / 100000.0
    both = lambda name: F.coalesce(of("brightnessContrast", name), of("lum", name))
    temperature = of("colorTemperature", "colorTemp") * 100000.0
    opacity = F.greatest(F.lit(0.0), F.coalesce(of("alphaModFix", "amt"), F.lit(1.0)) * F.coalesce(of("alphaMod", "val"), F.lit(1.0)) + F.coalesce(of("alphaOff", "val"), F.lit(0.0)))
    return rows.groupBy(*KEYS, "owner").agg(both("bright").alias("brightness"), both("contrast").alias("contrast"), of("saturation", "sat").alias("saturation"), temperature.alias("temperature"), of("sharpenSoften", "amount").alias("sharpen"), F.when(opacity < 1, opacity).alias("opacity"))


def crops(nodes: DataFrame) -> DataFrame:
    """(deck_id, part_path, owner, crop): what is cut off a picture at each side, in shares; null where nothing is."""
    side = lambda c: F.coalesce(number(attr(c)), F.lit(0.0)) / 100000.0
    cut = F.struct(*(side(c).alias(c) for c in "tblr"))
    got = nodes.filter(F.col("way") == "blipFill/srcRect").groupBy(*KEYS, "owner").agg(F.min_by(cut, "nid").alias("crop"))
    return got.withColumn("crop", F.when((F.abs(F.col("crop.t")) + F.abs(F.col("crop.b")) + F.abs(F.col("crop.l")) + F.abs(F.col("crop.r"))) > 0, F.col("crop")))
