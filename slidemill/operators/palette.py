"""Colours as they come out on each slide: names of schemes by the chain of slide, layout, master and theme."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colors import css, from_hsl, let, modified, scheme, to_hex
from ..functions.units import js_round
from ..sources.xmltree import attr, number
from . import package

KEYS = ["deck_id", "part_path"]
#: The named colours of the web, in small letters.
NAMED = {
    "aliceblue": "F0F8FF", "antiquewhite": "FAEBD7", "aqua": "00FFFF", "aquamarine": "7FFFD4", "azure": "F0FFFF", "beige": "F5F5DC", "bisque": "FFE4C4", "black": "000000",
    "blanchedalmond": "FFEBCD", "blue": "0000FF", "blueviolet": "8A2BE2", "brown": "A52A2A", "burlywood": "DEB887", "cadetblue": "5F9EA0", "chartreuse": "7FFF00", "chocolate": "D2691E",
    "coral": "FF7F50", "cornflowerblue": "6495ED", "cornsilk": "FFF8DC", "crimson": "DC143C", "cyan": "00FFFF", "darkblue": "00008B", "darkcyan": "008B8B", "darkgoldenrod": "B8860B",
    "darkgray": "A9A9A9", "darkgreen": "006400", "darkgrey": "A9A9A9", "darkkhaki": "BDB76B", "darkmagenta": "8B008B", "darkolivegreen": "556B2F", "darkorange": "FF8C00",
    "darkorchid": "9932CC", "darkred": "8B0000", "darksalmon": "E9967A", "darkseagreen": "8FBC8F", "darkslateblue": "483D8B", "darkslategray": "2F4F4F", "darkslategrey": "2F4F4F",
    "darkturquoise": "00CED1", "darkviolet": "9400D3", "deeppink": "FF1493", "deepskyblue": "00BFFF", "dimgray": "696969", "dimgrey": "696969", "dodgerblue": "1E90FF", "firebrick": "B22222",
    "floralwhite": "FFFAF0", "forestgreen": "228B22", "fuchsia": "FF00FF", "gainsboro": "DCDCDC", "ghostwhite": "F8F8FF", "gold": "FFD700", "goldenrod": "DAA520", "gray": "808080",
    "green": "008000", "greenyellow": "ADFF2F", "grey": "808080", "honeydew": "F0FFF0", "hotpink": "FF69B4", "indianred": "CD5C5C", "indigo": "4B0082", "ivory": "FFFFF0", "khaki": "F0E68C",
    "lavender": "E6E6FA", "lavenderblush": "FFF0F5", "lawngreen": "7CFC00", "lemonchiffon": "FFFACD", "lightblue": "ADD8E6", "lightcoral": "F08080", "lightcyan": "E0FFFF",
    "lightgoldenrodyellow": "FAFAD2", "lightgray": "D3D3D3", "lightgreen": "90EE90", "lightgrey": "D3D3D3", "lightpink": "FFB6C1", "lightsalmon": "FFA07A", "lightseagreen": "20B2AA",
    "lightskyblue": "87CEFA", "lightslategray": "778899", "lightslategrey": "778899", "lightsteelblue": "B0C4DE", "lightyellow": "FFFFE0", "lime": "00FF00", "limegreen": "32CD32",
    "linen": "FAF0E6", "magenta": "FF00FF", "maroon": "800000", "mediumaquamarine": "66CDAA", "mediumblue": "0000CD", "mediumorchid": "BA55D3", "mediumpurple": "9370DB",
    "mediumseagreen": "3CB371", "mediumslateblue": "7B68EE", "mediumspringgreen": "00FA9A", "mediumturquoise": "48D1CC", "mediumvioletred": "C71585", "midnightblue": "191970",
    "mintcream": "F5FFFA", "mistyrose": "FFE4E1", "moccasin": "FFE4B5", "navajowhite": "FFDEAD", "navy": "000080", "oldlace": "FDF5E6", "olive": "808000", "olivedrab": "6B8E23",
    "orange": "FFA500", "orangered": "FF4500", "orchid": "DA70D6", "palegoldenrod": "EEE8AA", "palegreen": "98FB98", "paleturquoise": "AFEEEE", "palevioletred": "DB7093",
    "papayawhip": "FFEFD5", "peachpuff": "FFDAB9", "peru": "CD853F", "pink": "FFC0CB", "plum": "DDA0DD", "powderblue": "B0E0E6", "purple": "800080", "red": "FF0000", "rosybrown": "BC8F8F",
    "royalblue": "4169E1", "saddlebrown": "8B4513", "salmon": "FA8072", "sandybrown": "F4A460", "seagreen": "2E8B57", "seashell": "FFF5EE", "sienna": "A0522D", "silver": "C0C0C0",
    "skyblue": "87CEEB", "slateblue": "6A5ACD", "slategray": "708090", "slategrey": "708090", "snow": "FFFAFA", "springgreen": "00FF7F", "steelblue": "4682B4", "tan": "D2B48C",
    "teal": "008080", "thistle": "D8BFD8", "tomato": "FF6347", "turquoise": "40E0D0", "violet": "EE82EE", "wheat": "F5DEB3", "white": "FFFFFF", "whitesmoke": "F5F5F5", "yellow": "FFFF00",
    "yellowgreen": "9ACD32",
}
#: Elements that say a colour.
COLORS = ["srgbClr", "schemeClr", "sysClr", "prstClr", "hslClr", "scrgbClr"]


def palettes(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """(deck_id, part_path, override, mapped, theme, theme_part) of slides, layouts and masters: the maps by which names of a scheme become colours there."""
    link = lambda kind, source, name: package.first_rel(rels, kind).filter(F.col("source_part").startswith(f"ppt/{source}/")).select("deck_id", F.col("source_part"), F.col("resolved").alias(name))
    to_master, to_theme = link("slideMaster", "slideLayouts", "master"), link("theme", "slideMasters", "theme_part")
    on_slides = link("slideLayout", "slides", "layout").withColumnRenamed("source_part", "part_path")
    on_layouts = to_master.select("deck_id", F.col("source_part").alias("part_path"), F.col("source_part").alias("layout"))
    met = on_slides.unionByName(on_layouts).join(to_master.withColumnRenamed("source_part", "layout"), ["deck_id", "layout"], "left")
    masters = to_theme.select("deck_id", F.col("source_part").alias("part_path"), F.lit(None).cast("string").alias("layout"), F.col("source_part").alias("master"))
    met = met.select(*KEYS, "layout", "master").unionByName(masters).join(to_theme.withColumnRenamed("source_part", "master"), ["deck_id", "master"], "left")
    maps = package.color_maps(nodes)
    met = met.join(maps.select("deck_id", F.col("part_path").alias("layout"), F.col("mapped").alias("override")), ["deck_id", "layout"], "left")
    met = met.join(maps.select("deck_id", F.col("part_path").alias("master"), "mapped"), ["deck_id", "master"], "left")
    themes = package.theme_colors(nodes).select("deck_id", F.col("part_path").alias("theme_part"), F.col("colors").alias("theme"))
    return met.join(themes, ["deck_id", "theme_part"], "left").select(*KEYS, "override", "mapped", "theme", "theme_part")


def with_drawings(palette: DataFrame, drawn: DataFrame) -> DataFrame:
    """palette with rows for parts that draw diagrams: they have the colours of the first slide that shows them; drawn: ``frames.diagram_drawings``."""
    first = drawn.groupBy("deck_id", "drawing").agg(F.min("part_path").alias("part_path"))
    return palette.unionByName(first.join(palette, KEYS).drop("part_path").withColumnRenamed("drawing", "part_path"))


def with_charts(palette: DataFrame, rels: DataFrame) -> DataFrame:
    """palette with rows for chart parts: they have the colours of the first slide that shows them."""
    shown = rels.filter(F.col("type").endswith("/chart") & F.col("source_part").startswith("ppt/slides/") & F.col("resolved").isNotNull())
    first = shown.groupBy("deck_id", "resolved").agg(F.min("source_part").alias("part_path"))
    return palette.unionByName(first.join(palette, KEYS).drop("part_path").withColumnRenamed("resolved", "part_path"))


def modifiers(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """of (keys, c) with mods: modifiers below the colour elements c, in order."""
    mod = nodes.filter(attr("val").isNotNull()).select(*KEYS, F.col("parent").alias("c"), F.struct("nid", F.col("tag").alias("name"), number(attr("val")).alias("val")).alias("mod"))
    mods = of.select(*KEYS, "c").join(mod, [*KEYS, "c"]).groupBy(*KEYS, "c").agg(F.transform(F.array_sort(F.collect_list("mod")), lambda m: F.struct(m["name"].alias("name"), m["val"].alias("val"))).alias("mods"))
    none = F.array().cast("array<struct<name:string,val:double>>")
    return of.join(mods, [*KEYS, "c"], "left").withColumn("mods", F.coalesce("mods", none))


def plain(tag: Column, attrs: Column, override: Column, mapped: Column, theme: Column) -> Column:
    """The colour of an element before its modifiers: six digits, or with # where it was computed; black where nothing is known."""
    of = lambda name: F.coalesce(number(attrs[name]), F.lit(0.0))
    named = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in NAMED.items())), F.lit(","), F.lit(":"))
    part = lambda c: js_round(of(c) / 100000.0 * 255.0).cast("double").alias(c)
    bare = lambda hex: F.regexp_replace(hex, "^#", "")
    hsl = F.struct((of("hue") / 60000.0).alias("h"), (of("sat") / 100000.0).alias("s"), (of("lum") / 100000.0).alias("l"))
    out = (
        F.when(tag == "srgbClr", attrs["val"])
        .when(tag == "schemeClr", scheme(F.coalesce(attrs["val"], F.lit("tx1")), override, mapped, theme))
        .when(tag == "sysClr", F.coalesce(attrs["lastClr"], attrs["val"]))
        .when(tag == "prstClr", F.try_element_at(named, F.lower(F.coalesce(attrs["val"], F.lit("black")))))
        .when(tag == "hslClr", bare(to_hex(from_hsl(hsl))))
        .when(tag == "scrgbClr", bare(to_hex(F.struct(*(part(c) for c in "rgb")))))
    )
    return F.coalesce(out, F.lit("000000"))


#: Attributes of colour elements that tell the colour.
TOLD = ["val", "lastClr", "hue", "sat", "lum", "r", "g", "b"]


def raw_colors(nodes: DataFrame) -> DataFrame:
    """(deck_id, part_path, holder, raw): the first colour in each element that holds one, as it is written: a struct tag, attrs, mods."""
    told = F.struct(*(attr(c).alias(c) for c in TOLD))
    c = nodes.filter(F.col("tag").isin(*COLORS)).groupBy(*KEYS, F.col("parent").alias("holder")).agg(F.min_by(F.struct(F.col("nid").alias("c"), "tag", told.alias("attrs")), "nid").alias("x")).select(*KEYS, "holder", "x.*")
    return modifiers(nodes, c).select(*KEYS, "holder", F.struct("tag", "attrs", "mods").alias("raw"))


def by_reference(raw: Column) -> Column:
    """Whether a raw colour is that of a reference (phClr)."""
    return F.coalesce((raw["tag"] == "schemeClr") & (F.lower(raw["attrs"]["val"]) == "phclr"), F.lit(False))


def inked(raw: Column, maps: list[Column], reference: Column | None = None) -> Column:
    """A struct hex, alpha of a raw colour by a part's maps (override, mapped, theme); the colour ``reference``, where it is known, stands for phClr: changed by the raw colour's modifiers, as opaque as both."""
    none = F.create_map().cast("map<string,string>")
    mods = F.coalesce(raw["mods"], F.array().cast("array<struct<name:string,val:double>>"))
    base = plain(raw["tag"], raw["attrs"], *(F.coalesce(m, none) for m in maps))
    if reference is None:
        return modified(base, mods)
    stands = by_reference(raw) & reference.isNotNull()
    own = modified(F.when(stands, F.regexp_replace(reference["hex"], "^#", "")).otherwise(base), mods)
    return let(own, lambda x: F.struct(x["hex"].alias("hex"), F.when(stands, x["alpha"] * reference["alpha"]).otherwise(x["alpha"]).alias("alpha")))


def painted(raws: DataFrame, found: DataFrame) -> DataFrame:
    """(deck_id, part_path, holder, color) of raw colours where they stand, as struct hex, alpha; found: palettes."""
    return raws.join(found, KEYS, "left").select(*KEYS, "holder", inked(F.col("raw"), [F.col(c) for c in ("override", "mapped", "theme")]).alias("color"))


def shown(color: Column) -> Column:
    """A colour as documents have it: #hex, or with two more digits where it lets something through."""
    return let(color, lambda x: F.when(x["alpha"] >= 1, css(x)).otherwise(F.concat(F.lower(css(F.struct(x["hex"].alias("hex"), F.lit(1.0).alias("alpha")))), F.lpad(F.lower(F.hex(js_round(F.round(x["alpha"], 3) * 255).cast("long"))), 2, "0"))))
