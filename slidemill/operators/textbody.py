"""Text as it is shown: styles of paragraphs and runs through six levels, and their HTML.

From the weakest to the strongest level: the master's default style, its style for titles, bodies or others, the master's placeholder,
the layout's placeholder, the shape's own list style, and the paragraph.  What a level says overrides what weaker ones say.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import symbols
from ..functions.colors import css
from ..functions.text import auto_number, escape, escape_attribute, run_html, safe_link
from ..functions.units import angle_to_deg, emu_to_px, js_number
from ..sources.xmltree import attr, number
from ..storage import cut

KEYS = ["deck_id", "part_path"]
#: Kinds of placeholders that take the style of bodies, and those without bullets; names of alignments.
BODY = ["body", "subTitle", "obj", "dt", "ftr", "sldNum"]
PLAIN = ["sldNum", "dt", "ftr", "title", "ctrTitle", "subTitle"]
ALIGN = {"l": "left", "ctr": "center", "r": "right", "just": "justify", "dist": "justify"}
LISTS = "lstStyle|titleStyle|bodyStyle|otherStyle|defaultTextStyle"


def _run_style(first, attrs: Column, prefix: str, fill: Column, props: Column) -> Column:
    """A struct of what an rPr or defRPr says; first(tail): attributes of the first element on a way below it; props: its place."""
    on = lambda name: F.when(attrs[name].isNotNull(), attrs[name].isin("1", "true"))
    line = lambda name, off: F.when(attrs[name] == off, False).when(attrs[name].isNotNull(), True)
    face = lambda script: first(f"{prefix}{script}")["typeface"]
    return F.struct(
        (number(attrs["sz"]) / 100.0).alias("size"), on("b").alias("bold"), on("i").alias("italic"), line("u", "none").alias("under"), line("strike", "noStrike").alias("strike"), (number(attrs["spc"]) / 100.0).alias("spacing"),
        (number(attrs["kern"]) / 100.0).alias("kern"), attrs["cap"].alias("cap"), number(attrs["baseline"]).alias("baseline"), F.nullif(face("latin"), F.lit("")).alias("latin"), F.nullif(face("ea"), F.lit("")).alias("ea"),
        F.nullif(face("cs"), F.lit("")).alias("cs"), fill.alias("fill"), first(f"{prefix}noFill").isNotNull().alias("no_fill"), first(f"{prefix}gradFill").isNotNull().alias("gradient"), F.coalesce(first(f"{prefix}hlinkClick")["r:id"], first(f"{prefix}hlinkClick")["id"]).alias("link_rid"), first(f"{prefix}sym")["typeface"].alias("sym"), props.alias("props"),
    )


def _style(first, holder) -> Column:
    """A struct of what a paragraph's properties say; first(tail) as above, holder(tail): the place of an element."""
    val = lambda tail: number(first(tail)["val"])
    return F.struct(
        F.nullif(first("")["algn"], F.lit("")).alias("align"), emu_to_px(number(first("")["marL"])).alias("margin"), emu_to_px(number(first("")["indent"])).alias("indent"), val("lnSpc/spcPct").alias("line_pct"), val("lnSpc/spcPts").alias("line_pts"),
        (val("spcBef/spcPts") / 100.0).alias("before"), (val("spcBef/spcPct") / 100000.0).alias("before_pct"), (val("spcAft/spcPts") / 100.0).alias("after"), (val("spcAft/spcPct") / 100000.0).alias("after_pct"),
        F.when(first("buChar").isNotNull(), F.coalesce(first("buChar")["char"], F.lit(""))).alias("char"), F.when(first("buAutoNum").isNotNull(), F.coalesce(F.nullif(first("buAutoNum")["type"], F.lit("")), F.lit("arabicPeriod"))).alias("auto"),
        first("buNone").isNotNull().alias("none"), first("buFont")["typeface"].alias("bu_font"), (val("buSzPct") / 100000.0).alias("bu_size"), holder("buClr").alias("bu_color"),
        _run_style(first, first("defRPr"), "defRPr/", holder("defRPr/solidFill"), holder("defRPr")).alias("run"),
    )


def _gathered(rows: DataFrame, keys: list[str], make) -> DataFrame:
    """(keys, style) of rows with tail, attrs, nid."""
    first = lambda tail: F.min_by("attrs", F.when(F.col("tail") == tail, F.col("nid")))
    holder = lambda tail: F.min(F.when(F.col("tail") == tail, F.col("nid")))
    return rows.groupBy(*keys).agg(make(first, holder).alias("style"))


def level_styles(nodes: DataFrame) -> DataFrame:
    """(deck_id, part_path, owner, list, level, style) of list styles; level is null for the style of levels that have none of their own."""
    pattern = f"^(?:.*/)?({LISTS})/(lvl([1-9])pPr|defPPr)(?:/(.*))?$"
    part = lambda i: F.regexp_extract("way", pattern, i)
    rows = nodes.filter(F.col("way").rlike(pattern)).select(*KEYS, "nid", "attrs", F.coalesce("owner", F.lit(0)).alias("owner"), part(1).alias("list"), F.when(part(3) != "", part(3).cast("int") - 1).alias("level"), part(4).alias("tail"))
    return _gathered(rows, [*KEYS, "owner", "list", "level"], _style)


def paragraph_styles(nodes: DataFrame) -> DataFrame:
    """(deck_id, part_path, para, style) of paragraphs with properties."""
    pattern = "^txBody/p/pPr(?:/(.*))?$"
    rows = nodes.filter(F.col("para").isNotNull() & F.col("way").rlike(pattern)).select(*KEYS, "nid", "attrs", "para", F.regexp_extract("way", pattern, 1).alias("tail"))
    return _gathered(rows, [*KEYS, "para"], _style)


def run_rows(nodes: DataFrame) -> DataFrame:
    """(deck_id, part_path, para, run, kind, text, style): runs, fields and breaks; style is null where they have no properties."""
    pattern = "^txBody/p/(r|fld|br)(?:/(.*))?$"
    rows = nodes.filter(F.col("para").isNotNull() & F.col("way").rlike(pattern)).select(*KEYS, "nid", "parent", "attrs", "para", "text", F.regexp_extract("way", pattern, 1).alias("kind"), F.regexp_extract("way", pattern, 2).alias("tail"))
    # a run's elements follow it: the last run that has begun is theirs
    order = Window.partitionBy(*KEYS, "para").orderBy("nid").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.last(F.when(F.col("tail") == "", F.col("nid")), True).over(order))
    first = lambda tail: F.min_by("attrs", F.when(F.col("tail") == tail, F.col("nid")))
    style = _run_style(first, first("rPr"), "rPr/", F.min(F.when(F.col("tail") == "rPr/solidFill", F.col("nid"))), F.min(F.when(F.col("tail") == "rPr", F.col("nid"))))
    got = rows.groupBy(*KEYS, "para", "run").agg(F.first("kind").alias("kind"), F.min_by("text", F.when(F.col("tail") == "t", F.col("nid"))).alias("text"), F.max((F.col("tail") == "rPr").cast("int")).alias("has"), style.alias("style"))
    text = F.when(F.col("kind") == "br", "\n").otherwise(F.coalesce("text", F.lit("")))
    return got.select(*KEYS, "para", "run", text.alias("text"), F.when(F.col("has") == 1, F.col("style")).alias("style"))


def effects(nodes: DataFrame, paint: DataFrame) -> DataFrame:
    """(deck_id, part_path, props, effect) of rPr and defRPr elements with a gradient or an outline: a struct gradient (of the text), width (pixels), color, fade (a gradient) of the outline, as CSS.

    An outline that is said not to be there says nothing.
    """
    ink = paint.select(*KEYS, F.col("holder").alias("nid"), css(F.col("color")).alias("ink"))
    of = lambda tag, *more: nodes.filter((F.col("tag") == tag) & F.col("way").rlike("[rR]Pr/(ln|(ln/)?(gradFill|solidFill|noFill)(/gsLst|/gsLst/gs|/lin)?)$")).select(*KEYS, "nid", "parent", *more)
    stop = of("gs", (F.coalesce(number(attr("pos")), F.lit(0.0)) / 1000.0).alias("pos")).join(ink, [*KEYS, "nid"], "left").join(of("gsLst").select(*KEYS, F.col("nid").alias("parent"), F.col("parent").alias("holder")), [*KEYS, "parent"])
    angles = nodes.filter((F.col("tag") == "lin") & F.col("way").rlike("[rR]Pr/(ln/)?gradFill/lin$")).groupBy(*KEYS, F.col("parent").alias("holder")).agg(F.min_by((angle_to_deg(F.coalesce(number(attr("ang")), F.lit(0.0))) + 90.0) % 360.0, "nid").alias("angle"))
    shown = stop.groupBy(*KEYS, "holder").agg(F.array_sort(F.collect_list(F.struct("pos", "nid", F.coalesce("ink", F.lit("#000000")).alias("ink")))).alias("stops")).join(angles, [*KEYS, "holder"], "left")
    stops = F.array_join(F.transform("stops", lambda s: F.concat(s["ink"], F.format_string(" %.1f%%", s["pos"]))), ", ")
    shown = shown.select(*KEYS, F.col("holder").alias("nid"), F.concat(F.format_string("linear-gradient(%.1fdeg, ", F.coalesce("angle", F.lit(180.0))), stops, F.lit(")")).alias("gradient"))
    # fills and outlines meet at the properties that hold them, fills of outlines at these first
    fill = of("solidFill", "tag").unionByName(of("gradFill", "tag")).unionByName(of("noFill", "tag")).join(ink, [*KEYS, "nid"], "left").join(shown, [*KEYS, "nid"], "left")
    fill = fill.withColumn("ink", F.when(F.col("tag") == "solidFill", F.coalesce("ink", F.lit("#000000"))))
    first = lambda tag, what: F.min_by(what, F.when(F.col("tag") == tag, F.col("nid")))
    held = fill.groupBy(*KEYS, F.col("parent").alias("nid")).agg(first("gradFill", "gradient").alias("gradient"), first("solidFill", "ink").alias("ink"), F.max(F.col("tag") == "noFill").alias("none"))
    width = emu_to_px(F.when(F.col("w") != 0, F.col("w")))
    outline = of("ln", number(attr("w")).alias("w")).join(held, [*KEYS, "nid"], "left").filter("none IS NULL OR NOT none")
    outline = outline.groupBy(*KEYS, F.col("parent").alias("props")).agg(F.min_by(F.struct(F.coalesce(width, F.lit(0.75)).alias("width"), F.col("ink").alias("color"), F.col("gradient").alias("fade")), "nid").alias("o"))
    whole = held.select(*KEYS, F.col("nid").alias("props"), "gradient").join(outline, [*KEYS, "props"], "full").filter("gradient IS NOT NULL OR o IS NOT NULL")
    return whole.select(*KEYS, "props", F.struct("gradient", "o.width", "o.color", "o.fade").alias("effect"))


def category(ph: Column, kind: Column) -> Column:
    """Which of the master's styles a shape takes."""
    return F.when(~ph, "otherStyle").when(kind.isin("title", "ctrTitle"), "titleStyle").when(kind.isNull() | (kind == "") | kind.isin(*BODY), "bodyStyle").otherwise("otherStyle")


def style_placeholder(rows: DataFrame, part: str, others: DataFrame, name: str) -> DataFrame:
    """rows with the first placeholder of a layout or master, in order, of the same index or the same type."""
    o = others.filter("ph").select("deck_id", F.col("part_path").alias(part), F.col("nid").alias("o_nid"), F.col("ph_type").alias("o_type"), F.col("ph_idx").alias("o_idx"))
    keys = ["deck_id", "part_path", "nid"]
    met = rows.filter("ph").select(*keys, part, "ph_type", "ph_idx").join(o, ["deck_id", part]).filter("ph_idx = o_idx OR ph_type = o_type")
    return rows.join(met.groupBy(*keys).agg(F.min("o_nid").alias(name)), keys, "left")


def _fold(levels: list[Column], get) -> Column:
    """The strongest level's value."""
    return F.coalesce(*(get(x) for x in reversed(levels)))


def cascade(levels: list[Column]) -> Column:
    """The struct that comes of the styles of all levels, the weakest first."""
    pick = lambda name: _fold(levels, lambda x: x[name]).alias(name)
    bullet = lambda name: reduce(lambda weaker, x: F.when(F.coalesce(x["none"], F.lit(False)), None).otherwise(F.coalesce(x[name], weaker)), levels, F.lit(None).cast("string")).alias(name)
    line = _fold(levels, lambda x: F.when(x["line_pts"].isNotNull(), F.concat(js_number(x["line_pts"] / 100.0), F.lit("pt"))).when(x["line_pct"].isNotNull(), js_number(F.round(x["line_pct"] / 100000.0, 4))))
    absolute = reduce(lambda a, x: a | x["line_pts"].isNotNull(), levels, F.lit(False))
    return F.struct(*(pick(c) for c in ("align", "margin", "indent", "before", "before_pct", "after", "after_pct", "bu_font", "bu_size")), line.alias("line"), absolute.alias("absolute"), bullet("char"), bullet("auto"))


def run_cascade(levels: list[Column]) -> Column:
    """The struct that comes of run styles, the weakest first."""
    pick = lambda name: _fold(levels, lambda x: x[name]).alias(name)
    font = reduce(lambda weaker, x: F.coalesce(x["latin"], weaker, x["ea"], x["cs"]), levels, F.lit(None).cast("string"))
    no_fill = reduce(lambda a, x: a | F.coalesce(x["no_fill"], F.lit(False)), levels, F.lit(False))
    effect = F.struct(*(_fold(levels, lambda x, c=c: x["effect"][c]).alias(c) for c in ("gradient", "width", "color", "fade")))
    return F.struct(*(pick(c) for c in ("size", "bold", "italic", "under", "strike", "spacing", "kern", "cap", "baseline", "color", "link_rid")), font.alias("font"), no_fill.alias("no_fill"), effect.alias("effect"))


def theme_font(face: Column, fonts: Column) -> Column:
    """A font by its name, or the theme's by a name such as +mj-lt; fonts: a map from those names."""
    return F.coalesce(F.nullif(fonts[face], F.lit("")), face)


def theme_fonts(nodes: DataFrame) -> DataFrame:
    """(deck_id, theme_part, fonts): the theme's fonts by the names that refer to them."""
    pattern = "fontScheme/(majorFont|minorFont)/(latin|ea|cs)$"
    rows = nodes.filter(F.col("way").rlike(pattern)).select("deck_id", F.col("part_path").alias("theme_part"), "nid", F.regexp_extract("way", pattern, 1).alias("kind"), F.regexp_extract("way", pattern, 2).alias("script"), F.coalesce(F.col("attrs")["typeface"], F.lit("")).alias("face"))
    name = F.concat(F.when(F.col("kind") == "majorFont", "+mj-").otherwise("+mn-"), F.when(F.col("script") == "latin", "lt").otherwise(F.col("script")))
    one = rows.groupBy("deck_id", "theme_part", name.alias("name")).agg(F.min_by("face", "nid").alias("face"))
    return one.groupBy("deck_id", "theme_part").agg(F.map_from_entries(F.collect_list(F.struct("name", "face"))).alias("fonts"))


def effect_css(effect: Column, no_fill: Column) -> list[Column]:
    """Properties that gradients and outlines of a text need; a text that is not filled shows its outline alone, which may fade."""
    px = F.concat(F.regexp_replace(F.coalesce(effect["width"], F.lit(0.75)).cast("string"), r"\.0$", ""), F.lit("px"))
    stroke = lambda color: F.concat(F.lit("-webkit-text-stroke-width: "), px, F.lit(";-webkit-text-stroke-color: "), color, F.lit(";paint-order: stroke fill"))
    fades, outlined = no_fill & effect["fade"].isNotNull(), effect["color"].isNotNull()
    mask = F.concat(F.lit("mask-image: "), effect["fade"], F.lit(";-webkit-mask-image: "), effect["fade"])
    return [
        F.concat(F.lit("background: "), effect["gradient"], F.lit(";-webkit-background-clip: text;background-clip: text;color: transparent")), F.when(no_fill, "color: transparent"),
        F.when(fades, stroke(F.lit("#ffffff"))).when(outlined, stroke(effect["color"])), F.when(fades, mask),
    ]


def run_css(style: Column, own: Column, link: Column, hlink: Column, fonts: Column, font_color: Column, font_bold: Column) -> Column:
    """The style attribute of a run: properties in a fixed order.  own: what the run itself says; link: where it leads; font_color, font_bold: of its shape's
    reference or its cell's style, which count before what is inherited and after the run's own.
    """
    size = F.coalesce(F.when(style["size"] != 0, style["size"]), F.lit(12.0))
    pt = lambda name, value: F.concat(F.lit(f"{name}: "), js_number(value), F.lit("pt"))
    lines = F.array_compact(F.array(F.when(style["under"], F.lit("underline")), F.when(style["strike"], F.lit("line-through"))))
    explicit = own["fill"].isNotNull() | F.coalesce(own["gradient"], F.lit(False))
    inherited = F.coalesce(F.when(~explicit, font_color), style["color"], F.lit("#000000"))
    color = F.when(link.isNotNull() & ~explicit & hlink.isNotNull(), F.concat(F.lit("#"), F.regexp_replace(hlink, "^#", ""))).otherwise(inherited)
    fallback = F.coalesce(F.nullif(fonts["+mn-lt"], F.lit("")), F.nullif(fonts["+mn-ea"], F.lit("")))
    font = F.coalesce(theme_font(style["font"], fonts), fallback)
    shift = style["baseline"] / 1000.0
    shifted = F.coalesce(style["baseline"] != 0, F.lit(False))
    parts = [
        pt("font-size", size), F.when(F.coalesce(own["bold"], font_bold, style["bold"]), "font-weight: bold"), F.when(style["italic"], "font-style: italic"), F.when(F.size(lines) > 0, F.concat(F.lit("text-decoration: "), F.array_join(lines, " "))), F.concat(F.lit("color: "), color),
        *effect_css(style["effect"], style["no_fill"]), F.concat(F.lit("font-family: "), font), pt("letter-spacing", style["spacing"]), F.when(style["kern"].isNotNull(), F.when(size >= style["kern"], "font-kerning: normal").otherwise("font-kerning: none")),
        F.when(style["cap"] == "all", "text-transform: uppercase").when(style["cap"] == "small", "font-variant: small-caps"), F.when(shifted, F.concat(F.lit("vertical-align: "), js_number(shift), F.lit("%"))), F.when(shifted & (F.abs(shift) >= 20), pt("font-size", size * 0.65)),
    ]
    return F.concat(F.array_join(F.array_compact(F.array(*parts)), ";"), F.lit(";"))


def paragraph_css(style: Column, size: Column, tabs: Column, no_wrap: Column) -> Column:
    """The style attribute of a paragraph, without the last semicolon; size is that by which relative spaces go."""
    px = lambda name, value: F.concat(F.lit(f"{name}: "), js_number(value), F.lit("px"))
    pt = lambda name, value: F.concat(F.lit(f"{name}: "), js_number(value), F.lit("pt"))
    space = lambda name, own, share: F.when(F.coalesce(own != 0, F.lit(False)), pt(name, own)).when(share != 0, pt(name, share * size))
    named = F.create_map(*(F.lit(x) for pair in ALIGN.items() for x in pair))
    parts = [
        F.when(style["align"].isNotNull(), F.concat(F.lit("text-align: "), F.coalesce(F.try_element_at(named, style["align"]), F.lit("left")))), px("margin-left", style["margin"]), px("text-indent", style["indent"]), F.concat(F.lit("line-height: "), style["line"]),
        space("margin-top", style["before"], style["before_pct"]), space("margin-bottom", style["after"], style["after_pct"]), F.when(tabs, "tab-size: 96px"), F.when(no_wrap, "white-space: nowrap"),
    ]
    return F.array_join(F.array_compact(F.array(*parts)), ";")


def html(bodies: DataFrame, nodes: DataFrame, paint: DataFrame, rels: DataFrame, palette: DataFrame) -> DataFrame:
    """(deck_id, part_path, nid, html): text bodies of shapes as HTML.

    bodies: (deck_id, part_path, nid, ph, ph_type, layout_part, master_part, l_ph, m_ph, font_color, font_bold), with the placeholders whose styles they take; the others: XML
    elements, colours (``palette.painted``), relationships and palettes.
    """
    styles = level_styles(nodes)
    colored = lambda rows, holder, name: rows.join(paint.select(*KEYS, F.col("holder").alias(holder), css(F.col("color")).alias(name)), [*KEYS, holder], "left")
    drawn = cut(effects(nodes, paint))
    effected = lambda rows, props: rows.withColumn("props", F.col(props)).join(drawn, [*KEYS, "props"], "left")
    styles = colored(effected(styles, "style.run.props").withColumn("__fill", F.col("style.run.fill")), "__fill", "__css").withColumn("style", F.struct("style.*", F.col("__css").alias("color"), "effect"))
    styles = colored(styles.withColumn("__bu", F.col("style.bu_color")), "__bu", "__bu_css").withColumn("style", F.col("style").withField("bu_css", F.col("__bu_css"))).drop("__fill", "__css", "__bu", "__bu_css", "props", "effect")
    styles = cut(styles)  # it is looked up ten times
    shape = bodies.withColumn("list", category(F.col("ph"), F.col("ph_type")))
    para = nodes.filter(F.col("tag") == "p").select(*KEYS, F.col("owner").alias("nid"), F.col("nid").alias("para"))
    own = paragraph_styles(nodes)
    level = nodes.filter((F.col("way") == "txBody/p/pPr")).groupBy(*KEYS, "para").agg(F.min_by(F.col("attrs")["lvl"].try_cast("int"), "nid").alias("level"))
    own = colored(effected(own, "style.run.props").withColumn("__fill", F.col("style.run.fill")), "__fill", "__css").withColumn("style", F.struct("style.*", F.col("__css").alias("color"), "effect"))
    own = colored(own.withColumn("__bu", F.col("style.bu_color")), "__bu", "__bu_css").withColumn("style", F.col("style").withField("bu_css", F.col("__bu_css"))).select(*KEYS, "para", F.col("style").alias("s6"))
    met = para.join(shape, [*KEYS, "nid"]).join(level, [*KEYS, "para"], "left").withColumn("level", F.coalesce("level", F.lit(0))).join(own, [*KEYS, "para"], "left")

    def joined(rows: DataFrame, part: str, owner: Column, list_: Column, name: str) -> DataFrame:
        """rows with the style at their level of one list, or else its style for all levels."""
        rows = rows.withColumns({"__part": F.col(part), "__owner": owner, "__list": list_})
        for level_, at in (("level", "__own"), (None, "__all")):
            s = styles.filter(F.col("level").isNotNull() if level_ else F.col("level").isNull()).select("deck_id", F.col("part_path").alias("__part"), F.col("owner").alias("__owner"), F.col("list").alias("__list"), *(["level"] if level_ else []), F.col("style").alias(at))
            rows = rows.join(s, ["deck_id", "__part", "__owner", "__list", *(["level"] if level_ else [])], "left")
        return rows.withColumn(name, F.coalesce("__own", "__all")).drop("__part", "__owner", "__list", "__own", "__all")

    zero, lst = F.lit(0), F.lit("lstStyle")
    met = joined(met, "master_part", zero, F.lit("defaultTextStyle"), "s1")
    met = joined(met, "master_part", zero, F.col("list"), "s2")
    met = joined(met, "master_part", F.col("m_ph"), lst, "s3")
    met = joined(met, "layout_part", F.col("l_ph"), lst, "s4")
    met = joined(met, "part_path", F.col("nid"), lst, "s5")
    levels = [F.col(f"s{i}") for i in range(1, 7)]
    given = F.array(*(F.when(x.isNotNull(), x["run"].withField("color", x["color"]).withField("effect", x["effect"])) for x in levels))
    met = cut(met.select(*KEYS, "nid", "para", "ph_type", "font_color", "font_bold", cascade(levels).alias("style"), given.alias("given"), _fold(levels, lambda x: x["bu_css"]).alias("bu_css")))
    # runs with their own styles on top
    runs = run_rows(nodes)
    runs = colored(effected(runs, "style.props").withColumn("__fill", F.col("style.fill")), "__fill", "__css").withColumn("own", F.col("style").withField("color", F.col("__css")).withField("effect", F.col("effect"))).select(*KEYS, "para", "run", "text", "own")
    look = palette.join(theme_fonts(nodes), ["deck_id", "theme_part"], "left").select(*KEYS, F.col("theme")["hlink"].alias("hlink"), F.coalesce("fonts", F.create_map().cast("map<string,string>")).alias("fonts"))
    runs = runs.join(met.select(*KEYS, "para", "given", "font_color", "font_bold"), [*KEYS, "para"]).join(look, KEYS, "left").withColumn("fonts", F.coalesce("fonts", F.create_map().cast("map<string,string>")))
    given = [F.col("given")[i] for i in range(6)]
    runs = runs.withColumn("style", run_cascade([*given, F.col("own")]))
    address = rels.select("deck_id", F.col("source_part").alias("part_path"), F.col("rid").alias("link_rid"), F.when((F.col("mode") == "External") & safe_link(F.col("target")), F.col("target")).alias("link"))
    runs = runs.withColumn("link_rid", F.col("style.link_rid")).join(address, [*KEYS, "link_rid"], "left")
    sym = F.col("own.sym")
    text = F.when(symbols.is_symbol_font(sym), F.array_join(F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: symbols.symbol(c, sym)), "")).otherwise(F.col("text"))
    tab = F.when(F.contains("text", F.lit("\t")), ";white-space: pre").otherwise("")
    runs = runs.withColumn("css", F.concat(run_css(F.col("style"), F.col("own"), F.col("link"), F.col("hlink"), F.col("fonts"), F.col("font_color"), F.col("font_bold")), tab)).withColumn("inner", run_html(text))
    one = F.struct("run", "text", "css", "inner", "link", F.col("style.size").alias("size"), F.col("own.size").alias("own_size"), F.col("style.color").alias("color"))
    runs = cut(runs.select(*KEYS, "para", "run", "text", "css", "inner", "link", "style", "own"))
    lines = runs.groupBy(*KEYS, "para").agg(F.array_sort(F.collect_list(one)).alias("runs"))
    wrap = nodes.filter(F.col("way") == "txBody/bodyPr").groupBy(*KEYS, F.col("owner").alias("nid")).agg(F.min_by("attrs", "nid").alias("body"))
    met = met.join(lines, [*KEYS, "para"], "left").join(wrap, [*KEYS, "nid"], "left")
    none = F.array().cast(lines.schema["runs"].dataType)
    met = met.withColumn("runs", F.coalesce("runs", none))
    # numbers count the numbered paragraphs of a body that are shown so
    quiet = ~F.exists("runs", lambda r: F.length(r["text"]) > 0) | F.coalesce(F.col("ph_type").isin(*PLAIN), F.lit(False))
    use = F.when(~quiet, F.when(F.length("style.char") > 0, F.struct(F.col("style.char").alias("char"), F.lit(None).cast("string").alias("auto"))).when(F.col("style.auto").isNotNull(), F.struct(F.lit(None).cast("string").alias("char"), F.col("style.auto").alias("auto"))))
    before = Window.partitionBy(*KEYS, "nid").orderBy("para").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("use", use).withColumn("number", F.coalesce(F.sum(F.col("use.auto").isNotNull().cast("int")).over(before), F.lit(0)))
    default = F.coalesce(*(x["size"] for x in reversed([F.col("given")[i] for i in range(6)])))
    size = F.coalesce(F.try_element_at("runs", F.lit(1))["own_size"], default, F.lit(12.0))
    sign = F.coalesce("use.char", auto_number(F.col("use.auto"), F.col("number")))
    symbolic = symbols.is_symbol_font(F.col("style.bu_font"))
    sign = F.when(symbolic, symbols.symbol(sign, F.col("style.bu_font"))).otherwise(sign)
    family = F.when(~symbolic & F.col("style.bu_font").isNotNull(), F.concat(F.lit("font-family: "), F.col("style.bu_font"), F.lit(";"))).otherwise("")
    height = F.when(F.col("style.bu_size") != 1, F.concat(F.lit("font-size: "), F.format_string("%.1f", size * F.col("style.bu_size")), F.lit("pt;")))
    ink = F.coalesce("bu_css", *(F.col("given")[i]["color"] for i in reversed(range(6))), F.try_element_at("runs", F.lit(1))["color"], F.col("font_color"), F.lit("#000000"))
    bullet = F.when(F.col("use").isNotNull(), F.concat(F.lit('<span style="'), family, F.coalesce(height, F.lit("")), F.lit("color: "), ink, F.lit(';">'), escape(sign), F.lit(" </span>"))).otherwise("")
    split = F.col("style.absolute") & F.exists("runs", lambda r: r["text"] == "\n") & F.col("style.line").isNotNull()
    open_line = F.concat(F.lit('<div style="height: '), F.coalesce("style.line", F.lit("")), F.lit(';overflow: visible">'))
    span = lambda a: F.when(a["css"].isNotNull() & (a["text"] != ""), F.concat(F.lit('<span style="'), a["css"], F.lit('">'), a["text"], F.lit("</span>"))).otherwise("")
    state = lambda html_, css_, text_: F.struct(html_.alias("html"), css_.alias("css"), text_.alias("text"))
    nothing = F.lit(None).cast("string")

    def step(a: Column, r: Column) -> Column:
        done = F.concat(a["html"], span(a))
        line_end = F.when(split, F.concat(F.lit("</div>"), open_line)).otherwise("<br/>")
        anchor = F.concat(F.lit('<a href="'), escape_attribute(r["link"]), F.lit('" target="_blank" rel="noopener noreferrer" style="'), r["css"], F.lit('">'), r["inner"], F.lit("</a>"))
        return (
            F.when(r["text"] == "\n", state(F.concat(done, line_end), nothing, F.lit("")))
            .when(r["link"].isNotNull(), state(F.concat(done, anchor), nothing, F.lit("")))
            .when(a["css"] == r["css"], state(a["html"], a["css"], F.concat(a["text"], r["inner"])))
            .otherwise(state(done, r["css"], r["inner"]))
        )

    body = F.aggregate("runs", state(F.when(split, open_line).otherwise(""), nothing, F.lit("")), step, lambda a: F.concat(a["html"], span(a), F.when(split, "</div>").otherwise("")))
    end = nodes.filter(F.col("way") == "txBody/p/endParaRPr").groupBy(*KEYS, "para").agg(F.min_by(number(F.col("attrs")["sz"]), "nid").alias("end_size"))
    met = met.join(end, [*KEYS, "para"], "left")
    tail = F.when((F.try_element_at("runs", F.lit(-1))["text"] == "\n") & F.col("end_size").isNotNull(), F.concat(F.lit('<span style="font-size: '), F.format_string("%.4f", F.col("end_size") / 100.0), F.lit('pt">&#x200B;</span>'))).otherwise("")
    look = paragraph_css(F.col("style"), size, F.exists("runs", lambda r: F.contains(r["text"], F.lit("\t"))), F.coalesce(F.col("body")["wrap"] == "none", F.lit(False)))
    tag = F.when(split, "div").otherwise("p")
    opened = F.concat(F.lit("<"), tag, F.when(look != "", F.concat(F.lit(' style="'), look, F.lit(';"'))).otherwise(""), F.lit(">"))
    line = F.concat(opened, bullet, F.when(F.size("runs") == 0, "<br/>").otherwise(""), body, tail, F.lit("</"), tag, F.lit(">"))
    whole = met.select(*KEYS, "nid", "para", "body", line.alias("line")).groupBy(*KEYS, "nid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "line"))), lambda x: x["line"]), "").alias("html"), F.first("body", True).alias("body"))
    inset = lambda name, default: F.concat(js_number(F.round(F.coalesce(number(F.col("body")[name]), F.lit(float(default))) / 12700.0, 2)), F.lit("pt"))
    framed = F.concat(F.lit('<div style="padding: '), inset("tIns", 45720), F.lit(" "), inset("rIns", 91440), F.lit(" "), inset("bIns", 45720), F.lit(" "), inset("lIns", 91440), F.lit(';">'), F.col("html"), F.lit("</div>"))
    return cut(whole).select(*KEYS, "nid", F.when(F.col("body").isNotNull(), framed).otherwise(F.col("html")).alias("html"))
