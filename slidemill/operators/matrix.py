"""What fills, lines and effects say, apart from where they stand: a theme's styles by place, and what comes of them for a shape.

Elements of shapes, themes, backgrounds and groups are read alike, with colours as they are written.  Only where it is known on whose
slide they count, and which colour a reference names, do they become colours: a theme's phClr stands for the reference's colour
in every place of an entry, with the theme's own changes on top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colors import channels, let, on_white
from ..functions.text import border_type
from ..functions.units import angle_to_deg, emu_to_px
from ..sources.xmltree import attr, number
from ..storage import written
from .palette import KEYS, inked, shown

#: Fills in the order in which the first one counts; patterns without gaps; the width of a line without one, in EMU.
FILLS = ["solidFill", "gradFill", "blipFill", "pattFill", "grpFill", "noFill"]
PLAIN = ["solid", "solidDmnd"]
THIN = 9525
#: Columns of a part's colours: the layout's override, the master's map, the theme's colours.
MAPS = ["override", "mapped", "theme"]


#: Types: a colour as it is written, a gradient and a fill of such.
RAW = "struct<tag:string,attrs:struct<val:string,lastClr:string,hue:string,sat:string,lum:string,r:string,g:string,b:string>,mods:array<struct<name:string,val:double>>>"
GRADIENT = f"struct<stops:array<struct<pos:double,nid:int,raw:{RAW}>>,rot:double,path:string,cx:double,cy:double>"
CONTENT = f"struct<tag:string,raw:{RAW},gradient:{GRADIENT},rid:string,opacity:double,pattern:string,fore:{RAW},back:{RAW}>"


def content(tag: Column, raw: Column, gradient: Column) -> Column:
    """A content of one colour or a gradient."""
    none = lambda c: F.lit(None).alias(c)
    return F.struct(tag.alias("tag"), raw.alias("raw"), gradient.alias("gradient"), *map(none, ("rid", "opacity", "pattern", "fore", "back"))).cast(CONTENT)


def solid(raw: Column) -> Column:
    """A content of one colour."""
    return content(F.lit("solidFill"), raw, F.lit(None))


def _gathered(first: DataFrame, *others: DataFrame, by: str) -> DataFrame:
    """Rows of first with what the others say of the same place: one grouping instead of a join for each."""
    every = first.withColumn("__own", F.lit(True))
    for rows in others:
        every = every.unionByName(rows, allowMissingColumns=True)
    values = [c for c in every.columns if c not in {*KEYS, by}]
    return every.groupBy(*KEYS, by).agg(*(F.first(c, True).alias(c) for c in values)).filter("__own").drop("__own")


def gradients(nodes: DataFrame, raws: DataFrame) -> DataFrame:
    """(deck_id, part_path, holder, gradient): struct stops (pos in percent, nid, raw) by position, rot, path (line, circle, shape, rect), cx, cy."""
    gs = nodes.filter(F.col("tag") == "gs").select(*KEYS, "nid", F.col("parent").alias("list"), (F.coalesce(number(attr("pos")), F.lit(0.0)) / 1000.0).alias("pos"))
    of = nodes.filter(F.col("tag") == "gsLst").select(*KEYS, F.col("nid").alias("list"), F.col("parent").alias("holder"))
    met = gs.join(of, [*KEYS, "list"]).join(raws.withColumnRenamed("holder", "nid"), [*KEYS, "nid"], "left")
    stops = met.groupBy(*KEYS, "holder").agg(F.array_sort(F.collect_list(F.struct("pos", "nid", "raw"))).alias("stops"))
    center = nodes.filter(F.col("tag") == "fillToRect").select(*KEYS, F.col("parent").alias("nid"), F.col("attrs").alias("to"))
    way = nodes.filter(F.col("tag").isin("lin", "path")).join(center, [*KEYS, "nid"], "left").groupBy(*KEYS, F.col("parent").alias("holder")).agg(
        F.min_by(angle_to_deg(F.coalesce(number(attr("ang")), F.lit(0.0))), F.when(F.col("tag") == "lin", F.col("nid"))).alias("rot"), F.min_by(F.struct(attr("path").alias("kind"), "to"), F.when(F.col("tag") == "path", F.col("nid"))).alias("p")
    )
    round_ = F.col("rot").isNull() & F.coalesce(F.col("p.kind").isin("circle", "shape", "rect"), F.lit(False))
    side = lambda c: F.coalesce(number(F.col("p.to")[c]), F.lit(0.0)) / 100000.0
    middle = lambda a, b: F.when(round_, F.when(F.col("p.to").isNull(), 0.5).otherwise((side(a) + (F.lit(1.0) - side(b))) / 2.0))
    return stops.join(way, [*KEYS, "holder"], "left").select(
        *KEYS, "holder", F.struct("stops", F.coalesce("rot", F.lit(0.0)).alias("rot"), F.when(round_, F.col("p.kind")).otherwise("line").alias("path"), middle("l", "r").alias("cx"), middle("t", "b").alias("cy")).alias("gradient")
    )


def contents(nodes: DataFrame, raws: DataFrame, graded: DataFrame) -> DataFrame:
    """(deck_id, part_path, holder, parent, owner, way, pos, content) of every fill outside of texts; graded: ``gradients``; content is a struct tag, raw, gradient, rid, opacity, pattern, fore, back."""
    own = nodes.filter(F.col("tag").isin(*FILLS) & ~F.col("way").contains("txBody")).select(*KEYS, F.col("nid").alias("holder"), "parent", "owner", "way", "pos", "tag", attr("prst").alias("pattern"))
    below = nodes.filter(F.col("tag").isin("fgClr", "bgClr")).select(*KEYS, F.col("parent").alias("holder"), "tag", F.col("nid").alias("part")).join(raws.withColumnRenamed("holder", "part"), [*KEYS, "part"], "left")
    pattern = below.groupBy(*KEYS, "holder").agg(*(F.min_by("raw", F.when(F.col("tag") == t, F.col("part"))).alias(n) for t, n in (("fgClr", "fore"), ("bgClr", "back"))))
    blip = nodes.filter(F.col("tag") == "blip").select(*KEYS, F.col("parent").alias("holder"), F.col("nid").alias("blip"), F.coalesce(attr("r:embed"), attr("embed")).alias("rid"))
    alpha = nodes.filter(F.col("tag").isin("alphaModFix", "alphaMod", "alphaOff")).select(*KEYS, F.col("parent").alias("blip"), "tag", (F.coalesce(number(attr("amt")), number(attr("val"))) / 100000.0).alias("v"))
    alpha = alpha.groupBy(*KEYS, "blip").agg(*(F.min(F.when(F.col("tag") == t, F.col("v"))).alias(t) for t in ("alphaModFix", "alphaMod", "alphaOff")))
    opacity = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("alphaModFix", F.lit(1.0)) * F.coalesce("alphaMod", F.lit(1.0)) + F.coalesce("alphaOff", F.lit(0.0))))
    blip = blip.join(alpha, [*KEYS, "blip"], "left").groupBy(*KEYS, "holder").agg(F.min_by("rid", "blip").alias("rid"), F.min_by(opacity, "blip").alias("opacity"))
    met = _gathered(own, raws, graded, pattern, blip, by="holder")
    return met.select(*KEYS, "holder", "parent", "owner", "way", "pos", F.struct("tag", "raw", "gradient", "rid", "opacity", "pattern", "fore", "back").cast(CONTENT).alias("content"))


def line_contents(nodes: DataFrame, raws: DataFrame, graded: DataFrame, tags: tuple[str, ...] = ("ln", "lnL", "lnR", "lnT", "lnB")) -> DataFrame:
    """(deck_id, part_path, holder, owner, way, pos, line) of lines outside of texts; graded: ``gradients``; line is a struct w, none, plain, raw, gradient, dash, head, tail."""
    own = nodes.filter(F.col("tag").isin(*tags) & ~F.col("way").contains("txBody")).select(*KEYS, F.col("nid").alias("holder"), "owner", "way", "pos", number(attr("w")).alias("w"))
    said = nodes.filter(F.col("tag").isin("noFill", "solidFill", "gradFill", "prstDash", "headEnd", "tailEnd")).select(*KEYS, F.col("parent").alias("line"), F.col("nid").alias("holder"), "tag", "attrs")
    said = said.join(raws, [*KEYS, "holder"], "left").join(graded, [*KEYS, "holder"], "left")
    first = lambda tag, what: F.min_by(what, F.when(F.col("tag") == tag, F.col("holder")))
    end = F.nullif(attr("type"), F.lit("none"))
    said = said.groupBy(*KEYS, F.col("line").alias("holder")).agg(
        first("noFill", F.lit(True)).alias("none"), first("solidFill", F.lit(True)).alias("plain"), first("solidFill", "raw").alias("raw"), first("gradFill", "gradient").alias("gradient"),
        first("prstDash", F.coalesce(F.nullif(attr("val"), F.lit("")), F.lit("solid"))).alias("dash"), first("headEnd", end).alias("head"), first("tailEnd", end).alias("tail"),
    )
    met = _gathered(own, said, by="holder")
    return met.select(*KEYS, "holder", "owner", "way", "pos", F.struct("w", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("none", "plain")), "raw", "gradient", "dash", "head", "tail").alias("line"))


def effect_contents(nodes: DataFrame, raws: DataFrame) -> DataFrame:
    """(deck_id, part_path, holder, parent, owner, way, effect) of lists of effects; effect is a struct inset, dir, dist, blur, raw of the shadow that counts, its fields null where there is none."""
    own = nodes.filter((F.col("tag") == "effectLst") & ~F.col("way").contains("txBody")).select(*KEYS, F.col("nid").alias("holder"), "parent", "owner", "way")
    shadow = nodes.filter(F.col("tag").isin("outerShdw", "innerShdw")).select(*KEYS, F.col("parent").alias("list"), F.col("nid").alias("holder"), (F.col("tag") == "innerShdw").alias("inset"), *(F.coalesce(number(attr(c)), F.lit(0.0)).alias(a) for c, a in (("dir", "dir"), ("dist", "dist"), ("blurRad", "blur"))))
    shadow = shadow.join(raws, [*KEYS, "holder"], "left").groupBy(*KEYS, F.col("list").alias("holder")).agg(F.min_by(F.struct("inset", "dir", "dist", "blur", "raw"), F.struct("inset", "holder")).alias("x")).select(*KEYS, "holder", "x.*")
    met = _gathered(own, shadow, by="holder")
    return met.select(*KEYS, "holder", "parent", "owner", "way", F.struct("inset", "dir", "dist", "blur", "raw").alias("effect"))


class Styles:
    """What the fills, lines and effects of a deck's parts are made of: each table is written once, for several places read it."""

    def __init__(self, nodes: DataFrame, raws: DataFrame):
        self.nodes, self.raws = nodes, raws
        graded = written(gradients(nodes, raws))
        self.fills, self.lines, self.effects = written(contents(nodes, raws, graded)), written(line_contents(nodes, raws, graded)), written(effect_contents(nodes, raws))

    def themes(self) -> DataFrame:
        """(deck_id, theme_part, fill_styles, line_styles, effect_styles): maps from places, counted from 1, to what a theme's lists hold there."""
        at = lambda rows, list_: rows.filter(F.col("owner").isNull() & F.col("way").rlike(f"fmtScheme/{list_}/[A-Za-z]+$"))
        place = self.nodes.filter((F.col("tag") == "effectStyle") & F.col("owner").isNull()).select(*KEYS, F.col("nid").alias("parent"), F.col("pos").alias("idx"))
        effects = self.effects.filter(F.col("owner").isNull()).join(place, [*KEYS, "parent"]).select(*KEYS, "idx", F.col("effect").alias("effect_styles"))
        rows = at(self.fills, "fillStyleLst").select(*KEYS, F.col("pos").alias("idx"), F.col("content").alias("fill_styles"))
        rows = rows.unionByName(at(self.lines, "lnStyleLst").select(*KEYS, F.col("pos").alias("idx"), F.col("line").alias("line_styles")), allowMissingColumns=True).unionByName(effects, allowMissingColumns=True)
        listed = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("idx", c)))).alias(c)
        return rows.groupBy("deck_id", F.col("part_path").alias("theme_part")).agg(*map(listed, ("fill_styles", "line_styles", "effect_styles")))

    def scopes(self, palette: DataFrame) -> DataFrame:
        """palette with the styles of each part's theme."""
        return palette.join(self.themes(), ["deck_id", "theme_part"], "left")

    def own(self, way: str) -> DataFrame:
        """(deck_id, part_path, owner, content, line, effect) of shapes: the fill that counts, the first line and the first list of effects below ``way`` (spPr, grpSpPr)."""
        place = F.array_position(F.array(*map(F.lit, FILLS)), F.col("content.tag"))
        mine = lambda rows, tail: rows.filter(F.col("owner").isNotNull() & F.col("way").rlike(f"^({way})/{tail}$"))
        rows = mine(self.fills, "[A-Za-z]+Fill").groupBy(*KEYS, "owner").agg(F.min_by("content", F.struct(place, "holder")).alias("content"))
        for other, tail, value in ((self.lines, "ln", "line"), (self.effects, "effectLst", "effect")):
            rows = rows.unionByName(mine(other, tail).groupBy(*KEYS, "owner").agg(F.min_by(value, "holder").alias(value)), allowMissingColumns=True)
        return rows.groupBy(*KEYS, "owner").agg(*(F.first(c, True).alias(c) for c in ("content", "line", "effect")))


FILL = "struct<type:string,color:string,stops:array<struct<pos:double,color:string>>,rot:double,path:string,cx:double,cy:double,rid:string,opacity:double,pattern:string,fore:string,back:string>"
_FIELDS = [f.split(":")[0] for f in ("type", "color", "stops", "rot", "path", "cx", "cy", "rid", "opacity", "pattern", "fore", "back")]


def plain(color: Column) -> Column:
    """A fill of one colour."""
    return F.struct(F.lit("color").alias("type"), color.alias("color"), *(F.lit(None).alias(c) for c in _FIELDS[2:])).cast(FILL)


def bare(ink: Column, default: str) -> Column:
    """A colour without what it lets through."""
    return F.coalesce(F.when(ink["hex"].startswith("#"), ink["hex"]).otherwise(F.concat(F.lit("#"), ink["hex"])), F.lit(default))


def resolved(rows: DataFrame, palette: DataFrame) -> DataFrame:
    """rows (deck_id, part_path, content, reference and others) with fill and ink: what contents come to by the maps of the part in ``part_path``.

    fill is a struct as ``FILL`` says, null for no content and for a gradient without stops; noFill has the colour transparent.  ink is the colour of
    the content itself, a struct hex, alpha.  All colours of a content go through one expression, as an array.
    """
    met = rows.join(palette.select(*KEYS, *MAPS), KEYS, "left")
    content, maps = F.col("content"), [F.col(c) for c in MAPS]
    gradient, tag = content["gradient"], content["tag"]
    raws = F.concat(F.array(content["raw"], content["fore"], content["back"]), F.coalesce(F.transform(gradient["stops"], lambda s: s["raw"]), F.slice(F.array(content["raw"]), F.lit(1), F.lit(0))))
    one = lambda raw: let(inked(raw, maps, F.col("reference")), lambda x: F.struct(x["hex"].alias("hex"), x["alpha"].alias("alpha"), shown(x).alias("shown")))
    met = met.withColumn("inks", F.transform(raws, lambda raw: F.when(raw.isNotNull(), one(raw))))
    at = lambda i: F.get("inks", i)
    on = lambda t, value: F.when(tag == t, value)
    black = F.lit("#000000")
    stops = F.transform(gradient["stops"], lambda s, i: F.struct(s["pos"].alias("pos"), F.coalesce(at(i + 3)["shown"], black).alias("color")))
    kind = F.when(tag == "gradFill", "gradient").when(tag == "blipFill", "image").when(tag == "pattFill", "pattern").when(tag == "grpFill", "group").otherwise("color")
    values = [
        kind, F.when(tag == "noFill", "transparent").when(tag == "solidFill", F.coalesce(at(F.lit(0))["shown"], black)), on("gradFill", stops), *(on("gradFill", gradient[c]) for c in ("rot", "path", "cx", "cy")),
        *(on("blipFill", content[c]) for c in ("rid", "opacity")), on("pattFill", F.coalesce(content["pattern"], F.lit("solid"))), on("pattFill", bare(at(F.lit(1)), "#000000")), on("pattFill", bare(at(F.lit(2)), "#ffffff")),
    ]
    made = F.struct(*(v.alias(c) for v, c in zip(values, _FIELDS, strict=True))).cast(FILL)
    there = content.isNotNull() & ((tag != "gradFill") | F.coalesce(F.size(gradient["stops"]) > 0, F.lit(False)))
    return met.select(*rows.columns, F.when(there, made).alias("fill"), at(F.lit(0)).alias("ink"))


def without_gaps(fill: Column) -> Column:
    """A fill that is taken over from elsewhere: patterns count as one colour if they have no gaps, and as clear otherwise."""
    dotted = F.coalesce(fill["type"] == "pattern", F.lit(False))
    return F.when(dotted, plain(F.when(fill["pattern"].isin(*PLAIN), fill["fore"]).otherwise("transparent"))).otherwise(fill)


def line_content(line: Column) -> Column:
    """The colours of a line as a content."""
    gradient = F.coalesce(F.size(line["gradient"]["stops"]) > 0, F.lit(False))
    tag = F.when(gradient, "gradFill").when(line["plain"], "solidFill")
    return F.when(tag.isNotNull(), content(tag, line["raw"], line["gradient"]))


def drawn(line: Column, own: Column, theme: Column, idx: Column, color: Column, fill: Column) -> Column:
    """A struct width (pixels), color, dash, none, stops, head, tail of the line that counts.

    own: the shape's line; theme: its theme's at the reference's place idx, color that of the reference; fill: what ``line_content`` came to.  A line
    without a colour takes the reference's, one without a width or dashes takes the theme's.
    """
    by_reference = F.coalesce(idx > 0, F.lit(False))
    ink = F.when(line["plain"], fill["color"]).when(by_reference, F.coalesce(shown(color), F.lit("#000000")))
    gradient = fill["type"] == "gradient"
    own_width = F.when(line["w"] > 0, emu_to_px(line["w"]))
    from_theme = F.when(theme.isNotNull(), F.when(theme["w"] > 0, emu_to_px(theme["w"]))).otherwise(idx * 0.75)
    usual = F.when(ink.isNotNull() | line["dash"].isNotNull(), emu_to_px(F.lit(float(THIN))))
    width = F.when(gradient, F.coalesce(own_width, F.lit(1.0))).otherwise(F.coalesce(own_width, F.when(by_reference, from_theme), usual, F.lit(0.0)))
    dash = F.coalesce(F.when(border_type(line["dash"]) != "solid", line["dash"]), F.when(by_reference, theme["dash"]), line["dash"], F.lit("solid"))
    return F.struct(width.alias("width"), ink.alias("color"), dash.alias("dash"), line.isNull().alias("none"), F.when(gradient, fill["stops"]).alias("stops"), F.coalesce(own["head"], line["head"]).alias("head"), F.coalesce(own["tail"], line["tail"]).alias("tail"))


def shaded(effect: Column, ink: Column) -> Column:
    """A struct h, v, blur (points), color, inset of a list of effects; null without a shadow.  A shadow without a colour is black."""
    angle, far = F.radians(effect["dir"] / 60000.0), effect["dist"] / 12700.0
    aside = lambda f: F.when(effect["inset"], 0.0).otherwise(far * f(angle))
    black = F.struct(F.lit("000000").alias("hex"), F.lit(1.0).alias("alpha"))
    told = F.coalesce(F.when(ink.isNotNull(), F.struct(ink["hex"].alias("hex"), ink["alpha"].alias("alpha"))), black)
    color = let(told, lambda c: let(channels(c["hex"]), lambda k: F.format_string("rgba(%d,%d,%d,%.3f)", *(k[x].cast("int") for x in "rgb"), c["alpha"])))
    return F.when(effect["inset"].isNotNull(), F.struct(aside(F.cos).alias("h"), aside(F.sin).alias("v"), (effect["blur"] / 12700.0).alias("blur"), color.alias("color"), effect["inset"].alias("inset")))


def backgrounds(chain: DataFrame, styles: Styles, palette: DataFrame, rels: DataFrame, media: DataFrame) -> DataFrame:
    """chain with background: the fill behind each slide, of the first of slide, layout and master that has one; white where there is none.

    Colours are those of the slide's own maps, whatever part the background stands in; a picture is looked up among that part's relationships and
    in ``media`` (deck_id, part_path).  A reference to a theme's backgrounds is its colour alone.  What lets something through is laid on white.
    """
    bg = styles.nodes.filter((F.col("tag") == "bg") & (F.col("depth") == 2)).groupBy(*KEYS).agg(F.min("nid").alias("bg"))
    below = styles.nodes.filter(F.col("tag").isin("bgPr", "bgRef")).select(*KEYS, F.col("parent").alias("bg"), F.col("nid").alias("holder"), "tag")
    below = below.join(styles.raws, [*KEYS, "holder"], "left").groupBy(*KEYS, "bg").agg(F.min_by(F.struct("holder", "tag", "raw"), F.struct(F.col("tag") == "bgRef", "holder")).alias("x"))
    order = F.array_position(F.array(*map(F.lit, ("solidFill", "gradFill", "pattFill", "blipFill"))), F.col("content.tag"))
    content = styles.fills.filter(F.col("way").rlike("bg/bgPr/[A-Za-z]+$") & (order > 0)).groupBy(*KEYS, F.col("parent").alias("props")).agg(F.min_by("content", F.struct(order, "holder")).alias("content"))
    found = bg.join(below, [*KEYS, "bg"], "left").withColumn("props", F.col("x.holder")).join(content, [*KEYS, "props"], "left").select(*KEYS, F.col("x.tag").alias("tag"), F.col("x.raw").alias("raw"), "content")
    target = rels.select("deck_id", F.col("source_part").alias("part_path"), F.col("rid"), F.concat(F.lit("ppt/media/"), F.element_at(F.split("target", "/"), -1)).alias("ref")).join(media.select("deck_id", F.col("part_path").alias("ref")).distinct(), ["deck_id", "ref"])
    found = found.withColumn("rid", F.col("content.rid")).join(target, [*KEYS, "rid"], "left").select(*KEYS, F.struct("tag", "raw", "content", "ref").alias("bg"))
    out = chain
    for level in ("slide_part", "layout_part", "master_part"):
        out = out.join(found.select("deck_id", F.col("part_path").alias(level), F.col("bg").alias(f"__{level}")), ["deck_id", level], "left")
    bg = F.coalesce("__slide_part", "__layout_part", "__master_part")
    rows = out.withColumn("bg", bg)
    tag = F.col("bg.content.tag")
    seen = F.when((F.col("bg.tag") == "bgRef") & F.col("bg.raw").isNotNull(), "reference").when(tag == "solidFill", "plain").when(tag.isin("gradFill", "pattFill"), "drawn").when((tag == "blipFill") & F.col("bg.ref").isNotNull(), "drawn")
    none = F.lit(None).cast("struct<hex:string,alpha:double>")
    rows = rows.select(*chain.columns, seen.alias("seen"), F.col("bg.ref").alias("ref"), F.when(F.col("bg.tag") == "bgRef", solid(F.col("bg.raw"))).otherwise(F.col("bg.content")).alias("content"), none.alias("reference"), F.col("slide_part").alias("part_path"))
    found = resolved(rows, palette)
    ink = F.struct(F.col("ink.hex").alias("hex"), F.col("ink.alpha").alias("alpha"))
    laid = F.when(F.col("ink").isNull(), "#000000").when(F.col("ink.alpha") < 1, on_white(ink)).otherwise(bare(ink, "#000000"))
    white = F.lit("#ffffff")
    color = F.when(F.col("seen") == "reference", F.when(laid != "#000000", laid).otherwise(white)).when(F.col("seen") == "plain", laid).when(F.col("seen").isNull() | F.col("fill").isNull(), white)
    image = F.col("fill.type") == "image"
    made = F.when(color.isNotNull(), plain(color)).otherwise(F.col("fill").withField("opacity", F.when(image, 1.0)))
    return found.select(*chain.columns, made.withField("ref", F.when(F.col("seen").isNotNull() & image, F.col("ref"))).alias("background"))
