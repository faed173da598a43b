"""Outlines of shapes as SVG paths: polygons of presets by their corners, and custom paths by their commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.xmltree import attr, number
from .units import js_number

#: Corners as shares of width and height, in drawing order.
POLYGONS = {
    "rect": ((0, 0), (1, 0), (1, 1), (0, 1)),
    "rtTriangle": ((0, 0), (1, 1), (0, 1)),
    "diamond": ((0.5, 0), (1, 0.5), (0.5, 1), (0, 0.5)),
}


def _point(letter: str, x: Column, y: Column) -> Column:
    return F.concat(F.lit(letter), js_number(x), F.lit(","), js_number(y))


def polygon(corners: list[tuple[Column, Column]]) -> Column:
    points = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in corners))
    return F.concat(F.lit("M"), F.array_join(F.transform(points, lambda p: F.concat(js_number(p["x"]), F.lit(","), js_number(p["y"]))), " L"), F.lit(" Z"))


def preset_path(name: Column, w: Column, h: Column, adj: Column | None = None) -> Column:
    """The path of a preset in a box; adj is its first adjustment in 100000ths, or null.  Unknown names are rectangles, ``textNoShape`` nothing."""
    zero = F.lit(0.0)
    ss = F.least(w, h)
    given = lambda other: F.coalesce(adj, F.lit(float(other))) if adj is not None else F.lit(float(other))
    fixed = lambda corners: polygon([(w * float(x), h * float(y)) for x, y in corners])
    out = fixed(POLYGONS["rect"])
    for kind in ("rtTriangle", "diamond"):
        out = F.when(name == kind, fixed(POLYGONS[kind])).otherwise(out)
    top = w * given(50000) / 100000.0
    out = F.when(name.isin("triangle", "isosTriangle"), polygon([(top, zero), (w, h), (zero, h)])).otherwise(out)
    cut = ss * F.least(F.greatest(given(29289), zero), F.lit(50000.0)) / 100000.0
    out = F.when(name == "octagon", polygon([(zero, cut), (cut, zero), (w - cut, zero), (w, cut), (w, h - cut), (w - cut, h), (cut, h), (zero, h - cut)])).otherwise(out)
    r = ss * given(16667) / 100000.0
    arc = lambda rx, ry, large, x, y: F.concat(F.lit("A"), js_number(rx), F.lit(","), js_number(ry), F.lit(f" 0 {large},1 "), js_number(x), F.lit(","), js_number(y))
    round_ = [_point("M", r, zero), _point("L", w - r, zero), arc(r, r, 0, w, r), _point("L", w, h - r), arc(r, r, 0, w - r, h), _point("L", r, h), arc(r, r, 0, zero, h - r), _point("L", zero, r), arc(r, r, 0, r, zero), F.lit("Z")]
    out = F.when(name == "roundRect", F.concat_ws(" ", *round_)).otherwise(out)
    oval = [_point("M", w, h / 2.0), arc(w / 2.0, h / 2.0, 1, zero, h / 2.0), arc(w / 2.0, h / 2.0, 1, w, h / 2.0), F.lit("Z")]
    out = F.when(name == "ellipse", F.concat_ws(" ", *oval)).otherwise(out)
    out = F.when(name.isin("line", "straightConnector1"), F.concat_ws(" ", _point("M", zero, zero), _point("L", w, h))).otherwise(out)
    return F.when(name == "textNoShape", F.lit("")).otherwise(out)


#: Letters of commands, how many points each needs, and how many it takes at most.
LETTERS = {"moveTo": ("M", 0, 1), "lnTo": ("L", 0, 1), "cubicBezTo": ("C", 3, 3), "quadBezTo": ("Q", 2, 2), "close": ("Z", 0, 0), "arcTo": ("A", 0, 0)}


def custom_paths(nodes: DataFrame, boxes: DataFrame) -> DataFrame:
    """(deck_id, part_path, owner, commands, path): custom geometry of moves, lines, curves, arcs and closings, scaled to boxes (deck_id, part_path, owner, w, h).

    A path's own extent is its w and h, or where it has none the shape's, in EMU.  Commands (letter, values) are a fold along each path that carries the
    place of the pen, for an arc starts where the pen is: its angles are those at which rays leave the middle of its ellipse.  Arcs without a
    radius or an angle, and curves with too few points, are left out.
    """
    keys = ["deck_id", "part_path", "owner"]
    below = nodes.filter(F.col("way").startswith("spPr/custGeom/pathLst/path"))
    path = below.filter(F.col("way") == "spPr/custGeom/pathLst/path").select(*keys, F.col("nid").alias("path"), number(attr("w")).alias("pw"), number(attr("h")).alias("ph"))
    own = nodes.filter(F.col("way") == "spPr/xfrm/ext").groupBy(*keys).agg(F.min_by(F.struct(number(attr("cx")).alias("cx"), number(attr("cy")).alias("cy")), "nid").alias("ext"))
    size = lambda c: F.coalesce(number(attr(c)), F.lit(0.0)).alias(c)
    command = below.filter(F.col("tag").isin(*LETTERS)).select(*keys, F.col("parent").alias("path"), F.col("nid").alias("cmd"), "tag", F.struct(*map(size, ("wR", "hR", "stAng", "swAng"))).alias("arc"))
    pt = below.filter(F.col("tag") == "pt").select(*keys, F.col("parent").alias("cmd"), F.struct("nid", F.coalesce(number(attr("x")), F.lit(0.0)).alias("x"), F.coalesce(number(attr("y")), F.lit(0.0)).alias("y")).alias("pt"))
    pt = pt.groupBy(*keys, "cmd").agg(F.transform(F.array_sort(F.collect_list("pt")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("pts"))
    met = command.join(pt, [*keys, "cmd"], "left").groupBy(*keys, "path").agg(F.array_sort(F.collect_list(F.struct("cmd", "tag", "arc", "pts"))).alias("commands"))
    met = met.join(path, [*keys, "path"]).join(boxes.select(*keys, "w", "h"), keys).join(own, keys, "left")
    extent = lambda own_, ext: F.coalesce(F.col(own_), F.col(f"ext.{ext}"), F.lit(0.0))
    scale = lambda to, e: F.when(e > 0, F.col(to) / e).otherwise(1.0)
    met = met.withColumns({"kx": scale("w", extent("pw", "cx")), "ky": scale("h", extent("ph", "cy"))})
    none = F.array().cast("array<struct<letter:string,values:array<double>>>")

    def step(a: Column, c: Column) -> Column:
        state = lambda x, y, done: F.struct(x.alias("x"), y.alias("y"), done.alias("done"))
        tag, arc = c["tag"], c["arc"]
        pts = F.coalesce(c["pts"], F.array().cast("array<struct<x:double,y:double>>"))
        letter, least, most = (F.element_at(F.create_map(*(x for k, v in LETTERS.items() for x in (F.lit(k), F.lit(v[i])))), tag) for i in range(3))
        zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        taken = F.when((most == 1) & (F.size(pts) == 0), F.array(zero)).otherwise(F.slice(pts, F.lit(1), most))
        end = F.try_element_at(taken, F.lit(-1))
        values = F.flatten(F.transform(taken, lambda p: F.array(p["x"] * F.col("kx"), p["y"] * F.col("ky"))))
        moved = state(F.coalesce(end["x"], a["x"]), F.coalesce(end["y"], a["y"]), F.concat(a["done"], F.array(F.struct(letter.alias("letter"), values.alias("values")))))
        turn = lambda deg: F.atan2(arc["wR"] * F.sin(F.radians(deg)), arc["hR"] * F.cos(F.radians(deg)))
        first, sweep = arc["stAng"] / 60000.0, arc["swAng"] / 60000.0
        x = a["x"] - arc["wR"] * F.cos(turn(first)) + arc["wR"] * F.cos(turn(first + sweep))
        y = a["y"] - arc["hR"] * F.sin(turn(first)) + arc["hR"] * F.sin(turn(first + sweep))
        flag = lambda on: on.cast("double")
        bent = F.array(arc["wR"] * F.col("kx"), arc["hR"] * F.col("ky"), F.lit(0.0), flag(F.abs(sweep) > 180), flag(sweep > 0), x * F.col("kx"), y * F.col("ky"))
        round_ = (arc["wR"] * F.col("kx") != 0) & (arc["hR"] * F.col("ky") != 0) & (sweep != 0)
        turned = state(x, y, F.concat(a["done"], F.array(F.struct(F.lit("A").alias("letter"), bent.alias("values")))))
        return F.when(tag == "arcTo", F.when(round_, turned).otherwise(a)).when(F.size(pts) < least, a).otherwise(moved)

    folded = F.aggregate("commands", F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), none.alias("done")), step)["done"]
    one = met.select(*keys, "path", folded.alias("done"))
    pairs = lambda v: F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / 2) - 1), lambda i: F.concat_ws(",", js_number(F.get(v, (i * 2).cast("int"))), js_number(F.get(v, (i * 2 + 1).cast("int"))))), " ")
    bent = lambda v: F.concat(js_number(v[0]), F.lit(","), js_number(v[1]), F.lit(" 0 "), js_number(v[3]), F.lit(","), js_number(v[4]), F.lit(" "), js_number(v[5]), F.lit(","), js_number(v[6]))
    written = F.transform("done", lambda c: F.concat(c["letter"], F.when(c["letter"] == "A", bent(c["values"])).when(F.size(c["values"]) == 0, "").otherwise(pairs(c["values"]))))
    one = one.select(*keys, "path", "done", F.array_join(written, " ").alias("s"))
    whole = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("path", "s", "done"))).alias("all"))
    return whole.select(*keys, F.flatten(F.transform("all", lambda x: x["done"])).alias("commands"), F.array_join(F.transform("all", lambda x: x["s"]), " ").alias("path"))
