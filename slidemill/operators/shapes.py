"""Shapes, their text, and what they take from placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import angle_to_deg, emu_to_px, px_to_pt
from ..sources.xmltree import attr, number
from ..storage import cut

SHAPES = ["sp", "pic", "cxnSp", "graphicFrame", "grpSp"]
#: Elements that hold a shape's place or name, in the order in which they count should a shape have several.
_FRAMES, _NAMED = ["grpSpPr/xfrm", "spPr/xfrm", "xfrm"], ["nvSpPr", "nvPicPr", "nvCxnSpPr", "nvGraphicFramePr", "nvGrpSpPr"]
_HEADS = [*(f.partition("/")[0] for f in _FRAMES), *_NAMED]
#: Elements that tell of a shape, with the attributes that are asked for, and the ways to them.
_ATTRS = {
    "xfrm": ("rot", "flipH", "flipV"), "off": ("x", "y"), "ext": ("cx", "cy"), "chOff": ("x", "y"), "chExt": ("cx", "cy"), "cNvPr": ("id", "name"), "ph": ("type", "idx"), "videoFile": ("r:link",), "audioFile": ("r:link",), "hlinkClick": ("r:id", "action"),
    "prstGeom": ("prst",), "custGeom": (), "graphicData": ("uri",), "chart": ("r:id",), "blip": ("r:embed",), "cNvSpPr": ("txBox",),
}
_WAYS = [w for f in _FRAMES for w in (f, *(f"{f}/{t}" for t in ("off", "ext", "chOff", "chExt")))] + [f"{n}/{t}" for n in _NAMED for t in ("cNvPr", "nvPr/ph", "nvPr/videoFile", "nvPr/audioFile", "cNvPr/hlinkClick")]
_WAYS += ["spPr/prstGeom", "spPr/custGeom", "graphic/graphicData", "graphic/graphicData/chart", "blipFill/blip", "nvSpPr/cNvSpPr"]
_IN_ALTERNATIVES = ["AlternateContent", "Choice", "Fallback", "sp", "oMath", "oMathPara", "t", "blip", "oleObj"]
#: Tags of all elements that ``shapes`` looks at.
TAGS = frozenset([*SHAPES, *_ATTRS, *_IN_ALTERNATIVES])


def shapes(nodes: DataFrame) -> DataFrame:
    """A row for each shape of slides, layouts and masters, with lengths in EMU.

    (deck_id, part_path, nid, last, shape, id, name, x, y, cx, cy, rot, flip_h, flip_v, ph, ph_type, ph_idx, prst, uri, rid, text_box, custom, video_rid, audio_rid, group_nid, ole, formula);
    group_nid is the nearest group around the shape, 0 if there is none.  What stands in an AlternateContent is no shape, in neither branch, but for
    formulas (see ``alternatives``), whose text is in formula; ole is what an embedded object is given out as.
    """
    below = nodes.filter(F.col("owner").isNotNull() & F.col("part_path").rlike("^ppt/(slides|slideLayouts|slideMasters|diagrams)/[^/]+$"))
    # one aggregate for each kind of element that is asked for, wherever shapes have it; other elements go before the grouping
    own, tag = F.col("nid") == F.col("owner"), F.col("tag")
    order = F.col("nid") + F.array_position(F.array(*map(F.lit, _HEADS)), F.substring_index("way", "/", 1)) * F.lit(1 << 32)
    first = [F.min_by(F.struct(F.lit(True).alias("there"), *(attr(n).alias(n) for n in names)), F.when(tag == t, F.col("order"))).alias(t) for t, names in _ATTRS.items()]
    found = below.filter(own | F.col("way").isin(*_WAYS)).withColumn("order", order).groupBy("deck_id", "part_path", "owner")
    found = found.agg(F.max(F.when(own, F.struct("tag", "grp", "alt", "last"))).alias("own"), *first)
    of = lambda t, name="there": F.col(t)[name]
    found = found.select(
        "deck_id", "part_path", "owner", F.col("own.tag").alias("shape"), F.coalesce("own.grp", F.lit(0)).alias("group_nid"), F.col("own.alt").alias("alt"), F.col("own.last").alias("last"), of("cNvPr", "id").alias("id"), of("cNvPr", "name").alias("name"),
        *(number(of("off", c)).alias(c) for c in "xy"), *(number(of("ext", c)).alias(c) for c in ("cx", "cy")),
        *(number(of("chOff", c)).alias(f"ch_{c}") for c in "xy"), *(number(of("chExt", c)).alias(f"ch_{c}") for c in ("cx", "cy")),
        F.coalesce(number(of("xfrm", "rot")), F.lit(0.0)).alias("rot"), of("xfrm", "flipH").isin("1", "true").alias("flip_h"), of("xfrm", "flipV").isin("1", "true").alias("flip_v"),
        F.coalesce(of("ph", "there"), F.lit(False)).alias("ph"), of("ph", "type").alias("ph_type"), of("ph", "idx").try_cast("int").alias("ph_idx"),
        of("prstGeom", "prst").alias("prst"), of("graphicData", "uri").alias("uri"), F.coalesce(of("blip", "r:embed"), of("chart", "r:id")).alias("rid"),
        F.coalesce(of("cNvSpPr", "txBox").isin("1", "true"), F.lit(False)).alias("text_box"), F.coalesce(of("custGeom"), F.lit(False)).alias("custom"),
        of("videoFile", "r:link").alias("video_rid"), of("audioFile", "r:link").alias("audio_rid"), of("hlinkClick", "r:id").alias("link_rid"), of("hlinkClick", "action").alias("link_action"),
    )
    found = found.filter(F.col("shape").isin(*SHAPES)).withColumnRenamed("owner", "nid").fillna(False, ["flip_h", "flip_v"])
    found = found.join(alternatives(nodes), ["deck_id", "part_path", "nid"], "left").filter("alt IS NULL OR formula IS NOT NULL")
    return found.withColumn("rid", F.coalesce("rid", "alt_rid")).drop("alt", "alt_rid")


def alternatives(nodes: DataFrame) -> DataFrame:
    """(deck_id, part_path, nid, alt_rid, ole, formula): what stays of AlternateContent elements, a row for each frame of an object and each formula.

    An embedded object in a frame is the picture that stands for it, the Fallback's before the Choice's; ole is ``word`` for a text
    document, of which the Fallback's picture counts alone, else ``picture``.  A formula is the first shape of the Choice, if there is
    one in its text; formula is that text and alt_rid the picture of the Fallback's shape.
    """
    keys = ["deck_id", "part_path"]
    inside = nodes.filter(F.col("alt").isNotNull() | (F.col("tag") == "AlternateContent")).withColumn("ac", F.coalesce("alt", "nid"))
    inside = inside.filter(F.col("tag").isin(*_IN_ALTERNATIVES))
    first = lambda on, what="nid": F.min_by(what, F.when(on, F.col("nid")))
    tag, own = F.col("tag"), F.col("nid") == F.col("ac")
    formula = tag.isin("oMath", "oMathPara") & F.col("way").startswith("txBody/")
    listed = lambda on, *what: F.collect_list(F.when(on, F.struct("nid", *what)))
    got = inside.groupBy(*keys, "ac").agg(
        first(own, "way").alias("way"), first(own, "owner").alias("frame"), first(tag == "Fallback").alias("fallback"), first(tag == "sp").alias("sp"), first(formula, F.struct("nid", "last", "owner")).alias("f"),
        listed(tag == "t", F.coalesce("text", F.lit("")).alias("text")).alias("texts"), listed(tag == "blip", "way", F.coalesce(attr("r:embed"), attr("embed")).alias("rid")).alias("blips"),
        listed(tag == "oleObj", F.coalesce(attr("progId"), F.lit("")).alias("prog"), F.coalesce(attr("r:id"), attr("id")).alias("rid")).alias("objects"),
    )
    spare = lambda x: F.coalesce(x["nid"] > F.col("fallback"), F.lit(False))
    ranked = F.array_sort(F.transform(F.filter("blips", lambda x: (x["way"] == "blipFill/blip") & x["rid"].isNotNull()), lambda x: F.struct((~spare(x)).alias("choice"), x["nid"].alias("nid"), x["rid"].alias("rid"))))
    word = F.exists("objects", lambda x: ~spare(x) & x["prog"].startswith("Word.Document") & x["rid"].isNotNull())
    picture = F.try_element_at(F.when(word, F.filter(ranked, lambda x: ~x["choice"])).otherwise(ranked), F.lit(1))["rid"]
    frames = got.filter(F.col("frame").isNotNull() & (F.col("way") == "graphic/graphicData/AlternateContent"))
    frames = frames.select(*keys, F.col("frame").alias("nid"), picture.alias("alt_rid"), F.when(word, "word").when(picture.isNotNull(), "picture").alias("ole"), F.lit(None).cast("string").alias("formula"))
    there = F.col("way").rlike("(^|/)spTree/AlternateContent$") | (F.col("way") == "AlternateContent")
    said = F.array_join(F.transform(F.array_sort(F.filter("texts", lambda x: (x["nid"] > F.col("f.nid")) & (x["nid"] <= F.col("f.last")))), lambda x: x["text"]), "")
    seen = F.try_element_at(F.array_sort(F.filter("blips", lambda x: (x["way"] == "spPr/blipFill/blip") & spare(x))), F.lit(1))["rid"]
    formulas = got.filter(there & (F.col("f.owner") == F.col("sp")) & (F.col("fallback").isNull() | (F.col("sp") < F.col("fallback"))))
    return frames.unionByName(formulas.select(*keys, F.col("sp").alias("nid"), seen.alias("alt_rid"), F.lit(None).cast("string").alias("ole"), said.alias("formula")))


def boxes(found: DataFrame) -> DataFrame:
    """shapes with left, top, width, height in points and rotate in degrees."""
    length = lambda c: px_to_pt(emu_to_px(F.coalesce(F.col(c), F.lit(0.0))))
    return found.withColumns({"left": length("x"), "top": length("y"), "width": length("cx"), "height": length("cy"), "rotate": angle_to_deg(F.col("rot"))})


def runs(nodes: DataFrame) -> DataFrame:
    """(deck_id, part_path, owner, para, para_ord, run_ord, text, size, bold, link_rid): runs, fields and breaks in document order."""
    in_text = nodes.filter(F.col("para").isNotNull())
    base = in_text.filter(F.col("tag").isin("r", "br", "fld")).select("deck_id", "part_path", "owner", "para", F.col("nid").alias("run"), F.col("tag").alias("run_tag"))
    inner = in_text.filter(F.col("tag").isin("t", "rPr")).groupBy("deck_id", "part_path", F.col("parent").alias("run")).agg(
        F.min_by(F.coalesce("text", F.lit("")), F.when(F.col("tag") == "t", F.col("nid"))).alias("text"),
        F.min_by(number(attr("sz")), F.when(F.col("tag") == "rPr", F.col("nid"))).alias("size"),
        F.min_by(attr("b"), F.when(F.col("tag") == "rPr", F.col("nid"))).alias("bold"),
    )
    met = base.join(inner, ["deck_id", "part_path", "run"], "left")
    text = F.when(F.col("run_tag") == "br", "\n").otherwise(F.coalesce("text", F.lit("")))
    return met.select("deck_id", "part_path", "owner", "para", F.col("run").alias("run_ord"), text.alias("text"), "size", F.coalesce(F.col("bold").isin("1", "true"), F.lit(False)).alias("bold"))


def joined(rows: DataFrame, keys: list[str], order: str, text: str, sep: str = "") -> DataFrame:
    """(keys, text): texts of a group in order, put together."""
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), sep).alias(text))


def paragraphs(nodes: DataFrame) -> DataFrame:
    """(deck_id, part_path, owner, para, para_index, level, auto_kind, plain, text): paragraphs, also empty ones, para_index from 0 in their shape."""
    keys, tag = ["deck_id", "part_path", "para"], F.col("tag")
    run = F.when(tag == "t", F.col("parent")).when(tag.isin("r", "br", "fld"), F.col("nid"))
    said = F.collect_list(F.when(run.isNotNull(), F.struct(run.alias("run"), "nid", "tag", "text")))
    each = nodes.filter(F.col("para").isNotNull() & tag.isin("p", "pPr", "buAutoNum", "buNone", "r", "br", "fld", "t")).groupBy(*keys).agg(
        F.max(F.when(tag == "p", F.col("owner"))).alias("owner"),
        F.min_by(attr("lvl").try_cast("int"), F.when(tag == "pPr", F.col("nid"))).alias("level"),
        F.min_by(attr("type"), F.when(tag == "buAutoNum", F.col("nid"))).alias("auto_kind"),
        F.max(F.when(tag.isin("pPr", "buAutoNum", "buNone"), tag == "buNone")).alias("plain"),
        F.array_sort(said).alias("said"),
    )
    order = Window.partitionBy("deck_id", "part_path", "owner").orderBy("para")
    return each.select("deck_id", "part_path", "owner", "para", (F.row_number().over(order) - 1).alias("para_index"), F.coalesce("level", F.lit(0)).alias("level"), "auto_kind", F.coalesce("plain", F.lit(False)).alias("plain"), _run_texts(F.col("said")).alias("text"))


def _run_texts(said: Column) -> Column:
    """Texts of runs, fields and breaks with their t, sorted by (run, nid), put together: of each run its first t, which stands next to it."""

    def shown(x: Column, i: Column) -> Column:
        before = F.get(said, i - 1)
        first = (x["tag"] == "t") & (before["run"] == x["run"]) & before["tag"].isin("r", "fld")
        return F.when(x["tag"] == "br", "\n").when(first, F.coalesce(x["text"], F.lit(""))).otherwise("")

    return F.array_join(F.transform(said, shown), "")


def numbered(paras: DataFrame) -> DataFrame:
    """paragraphs with number, the count of numbered ones in their shape so far, from 0; null for others.  Levels and kinds don't reset it."""
    is_one = F.col("auto_kind").isNotNull() & ~F.col("plain")
    order = Window.partitionBy("deck_id", "part_path", "owner").orderBy("para").rowsBetween(Window.unboundedPreceding, 0)
    return paras.withColumn("number", F.when(is_one, F.sum(is_one.cast("int")).over(order) - 1))


def merged_runs(rows: DataFrame, keys: list[str], order: str, style: list[str]) -> DataFrame:
    """Neighbouring runs of equal style as one, breaks at line ends: (keys, island, style..., text)."""
    by = Window.partitionBy(*keys).orderBy(order)
    same = F.lit(True)
    for c in style:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(by))
    new = ~same | (F.col("text") == "\n") | (F.lag("text").over(by) == "\n")
    islands = rows.withColumn("__new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("island", F.sum("__new").over(by) - 1)
    return joined(islands, [*keys, "island", *style], order, "text")


def inherited(on_slide: DataFrame, on_layout: DataFrame, on_master: DataFrame) -> DataFrame:
    """on_slide (deck_id, slide_part, layout_part, master_part, nid, ph, ph_type, ph_idx, x, y, cx, cy) with missing boxes from placeholders.

    Of a layout's placeholders the best is one of the same type and index, then one of the same index where neither has a type, then
    the first of the same type; a shape without type takes any of its index after these.  What the layout lacks the master gives.
    l_match and m_match are the placeholders found, and l_placed tells whether the layout's has a place.
    """

    def best(rows: DataFrame, part: str, others: DataFrame) -> DataFrame:
        o = others.filter("ph").select("deck_id", F.col("part_path").alias(part), F.col("nid").alias("o_nid"), F.col("ph_type").alias("o_type"), F.col("ph_idx").alias("o_idx"), *(F.col(c).alias(f"o_{c}") for c in ("x", "y", "cx", "cy")))
        same_type, same_idx = F.col("ph_type") == F.col("o_type"), F.col("ph_idx") == F.col("o_idx")
        rank = F.when(same_type & same_idx, 0).when(F.col("ph_type").isNull() & F.col("o_type").isNull() & same_idx, 1).when(same_type, 2).when(F.col("ph_type").isNull() & same_idx, 3)
        met = rows.filter("ph").join(o, ["deck_id", part]).withColumn("rank", rank).filter("rank IS NOT NULL")
        return met.groupBy("deck_id", "slide_part", "nid").agg(F.min_by(F.struct("o_x", "o_y", "o_cx", "o_cy", "o_nid"), F.struct("rank", "o_nid")).alias("box"))

    keys = ["deck_id", "slide_part", "nid"]
    a = best(on_slide, "layout_part", on_layout).withColumnRenamed("box", "from_layout")
    b = best(on_slide, "master_part", on_master).withColumnRenamed("box", "from_master")
    met = on_slide.join(a, keys, "left").join(b, keys, "left")
    met = met.withColumns({"l_match": F.col("from_layout.o_nid"), "m_match": F.col("from_master.o_nid"), "l_placed": F.col("from_layout.o_x").isNotNull() & F.col("from_layout.o_cx").isNotNull()})
    return met.withColumns({c: F.coalesce(c, f"from_layout.o_{c}", f"from_master.o_{c}") for c in ("x", "y", "cx", "cy")}).drop("from_layout", "from_master")


#: A map of places in a group to places around it, as columns: matrix (a, b, c, d) and offset (e, f) for centres, scales of sizes, what a turn is multiplied with and what is added to it (in 60000ths), and which mirrors are swapped.
_MAP = ["a", "b", "c", "d", "e", "f", "sx", "sy", "sign", "turn", "swap_h", "swap_v"]


def _group_map() -> dict[str, Column]:
    """The map of a group by its own box, turn and mirrors: centres are moved and scaled, then mirrored and turned around its middle; both mirrors together are half a turn."""
    length = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    h, v = F.col("flip_h"), F.col("flip_v")
    scale = {c: F.when(F.col(f"ch_c{c}") > 0, length(f"c{c}") / F.col(f"ch_c{c}")).otherwise(1.0) for c in "xy"}
    angle = F.radians(F.col("rot") / 60000.0)
    cos, sin, fx, fy = F.cos(angle), F.sin(angle), F.when(h, -1.0).otherwise(1.0), F.when(v, -1.0).otherwise(1.0)
    half_x, half_y = length("cx") / 2.0, length("cy") / 2.0
    a, b, c, d = cos * fx * scale["x"], -sin * fy * scale["y"], sin * fx * scale["x"], cos * fy * scale["y"]
    e = length("x") + half_x - a * length("ch_x") - b * length("ch_y") - cos * fx * half_x + sin * fy * half_y
    f = length("y") + half_y - c * length("ch_x") - d * length("ch_y") - sin * fx * half_x - cos * fy * half_y
    turn = F.col("rot") + F.when(h & v, 180.0 * 60000.0).otherwise(0.0)
    return dict(zip(_MAP, (a, b, c, d, e, f, scale["x"], scale["y"], fx * fy, turn, h & ~v, v & ~h), strict=True))


def _after(o, i) -> dict[str, Column]:
    """The map o(name) after the map i(name)."""
    return {
        "a": o("a") * i("a") + o("b") * i("c"), "b": o("a") * i("b") + o("b") * i("d"), "c": o("c") * i("a") + o("d") * i("c"), "d": o("c") * i("b") + o("d") * i("d"),
        "e": o("a") * i("e") + o("b") * i("f") + o("e"), "f": o("c") * i("e") + o("d") * i("f") + o("f"), "sx": o("sx") * i("sx"), "sy": o("sy") * i("sy"),
        "sign": o("sign") * i("sign"), "turn": o("sign") * i("turn") + o("turn"), "swap_h": o("swap_h") != i("swap_h"), "swap_v": o("swap_v") != i("swap_v"),
    }


def flattened(found: DataFrame) -> DataFrame:
    """Shapes with x, y, cx, cy, rot and mirrors as seen from the slide: offsets, scales, turns and mirrors of all groups around applied, however deep these lie in each other.

    Each round puts a group's map together with that of the group it points to, and lets it point to where that one points: as
    many rounds as the depth has binary digits.  Sizes are scaled along the shape's own axes.  Groups themselves keep no turn and no
    mirror: what lies in them has it.
    """
    keys = ["deck_id", "part_path"]
    maps = cut(found.filter(F.col("shape") == "grpSp").select(*keys, F.col("nid").alias("at"), F.col("group_nid").alias("up"), *(c.alias(k) for k, c in _group_map().items())))
    while maps.filter("up > 0").limit(1).count():
        outer = maps.select(*keys, F.col("at").alias("up"), F.col("up").alias("o_up"), *(F.col(k).alias(f"o_{k}") for k in _MAP))
        met = maps.join(outer, [*keys, "up"], "left")
        both = _after(lambda k: F.col(f"o_{k}"), F.col)
        maps = cut(met.select(*keys, "at", F.coalesce("o_up", F.lit(0)).alias("up"), *(F.when(F.col("o_up").isNull(), F.col(k)).otherwise(both[k]).alias(k) for k in _MAP)))
    met = found.join(maps.select(*keys, F.col("at").alias("group_nid"), *(F.col(k).alias(f"g_{k}") for k in _MAP)), [*keys, "group_nid"], "left")
    inside, g, group = F.col("g_a").isNotNull(), lambda k: F.col(f"g_{k}"), F.col("shape") == "grpSp"
    length = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    px, py = length("x") + length("cx") / 2.0, length("y") + length("cy") / 2.0
    new = {
        "x": g("a") * px + g("b") * py + g("e") - length("cx") * g("sx") / 2.0, "y": g("c") * px + g("d") * py + g("f") - length("cy") * g("sy") / 2.0, "cx": F.col("cx") * g("sx"), "cy": F.col("cy") * g("sy"),
        "rot": F.pmod(g("sign") * F.col("rot") + g("turn"), F.lit(360.0 * 60000.0)), "flip_h": F.col("flip_h") != g("swap_h"), "flip_v": F.col("flip_v") != g("swap_v"),
    }
    # a shape without a place of its own has none in its group either
    placed = {c: F.when(inside & F.col(c).isNotNull(), new[c]).otherwise(F.col(c)) for c in new}
    placed |= {c: F.when(group, F.lit(0.0) if c == "rot" else F.lit(False)).otherwise(placed[c]) for c in ("rot", "flip_h", "flip_v")}
    return met.withColumns(placed).select(*found.columns)
