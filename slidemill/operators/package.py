"""What holds a deck together: relationships, the order of slides, and the chain slide, layout, master, theme."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.xmltree import attr

#: The slots of a theme's colours.
SLOTS = ["dk1", "lt1", "dk2", "lt2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink"]


def resolve_target(base: Column, target: Column) -> Column:
    """The part that a relative target names, seen from a folder; a target from the root keeps to itself."""
    whole = F.when(target.startswith("/"), target).otherwise(F.concat(base, F.lit("/"), target))
    steps = F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.array_join(walked, "/")


def rels_path(part: Column) -> Column:
    """The path of a part's relationships."""
    return F.regexp_replace(part, r"([^/]+)$", r"_rels/$1.rels")


def folder(part: Column) -> Column:
    return F.regexp_extract(part, r"^(.*)/[^/]*$", 1)


def media_path(target: Column) -> Column:
    """Media lie in one folder, whatever way a target takes there."""
    return F.concat(F.lit("ppt/media/"), F.element_at(F.split(target, "/"), -1))


def relationships(nodes: DataFrame) -> DataFrame:
    """(deck_id, source_part, ord, rid, type, target, mode, resolved): of relationships of one id in a part the last counts."""
    found = nodes.filter((F.col("tag") == "Relationship") & F.col("part_path").endswith(".rels"))
    found = found.select("deck_id", F.regexp_replace("part_path", r"_rels/([^/]+)\.rels$", "$1").alias("source_part"), F.col("nid").alias("ord"), attr("Id").alias("rid"), attr("Type").alias("type"), attr("Target").alias("target"), attr("TargetMode").alias("mode"))
    found = found.filter("rid IS NOT NULL AND type IS NOT NULL AND target IS NOT NULL")
    row = F.max_by(F.struct("ord", "type", "target", "mode"), "ord").alias("x")
    found = found.groupBy("deck_id", "source_part", "rid").agg(row).select("deck_id", "source_part", "rid", "x.*")
    return found.withColumn("resolved", F.when(F.coalesce(F.col("mode"), F.lit("")) != "External", resolve_target(folder(F.col("source_part")), F.col("target"))))


def first_rel(rels: DataFrame, kind: str) -> DataFrame:
    """(deck_id, source_part, resolved) of each part's first relationship whose type holds ``kind``."""
    return rels.filter(F.contains("type", F.lit(kind))).groupBy("deck_id", "source_part").agg(F.min_by("resolved", "ord").alias("resolved"))


def slides(nodes: DataFrame, rels: DataFrame, parts: DataFrame) -> DataFrame:
    """(deck_id, slide_index, slide_part): in the order of the slide list, or where there is none of the numbers in relationship ids."""
    main = rels.filter(F.col("source_part") == "ppt/presentation.xml").drop("source_part")
    listed = nodes.filter((F.col("part_path") == "ppt/presentation.xml") & (F.col("tag") == "sldId")).select("deck_id", attr("r:id").alias("rid"), F.col("nid").alias("at"))
    by_list = listed.join(main, ["deck_id", "rid"]).select("deck_id", "at", F.col("resolved").alias("slide_part"))
    digits = F.coalesce(F.regexp_replace("rid", r"\D", "").try_cast("int"), F.lit(0))
    is_slide = F.col("type").endswith("/slide")
    by_number = main.filter(is_slide).join(listed.select("deck_id").distinct(), "deck_id", "left_anti").select("deck_id", digits.alias("at"), F.col("resolved").alias("slide_part"))
    there = parts.filter(F.col("kind") == "slide").select("deck_id", F.col("part_path").alias("slide_part"))
    every = by_list.unionByName(by_number).join(there, ["deck_id", "slide_part"])
    order = Window.partitionBy("deck_id").orderBy("at", "slide_part")
    return every.select("deck_id", (F.row_number().over(order) - 1).alias("slide_index"), "slide_part")


def chain(slide_rows: DataFrame, rels: DataFrame) -> DataFrame:
    """slide_rows with layout_part, master_part and theme_part, null where a link is missing."""
    out = slide_rows
    for name, source, kind in (("layout_part", "slide_part", "slideLayout"), ("master_part", "layout_part", "slideMaster"), ("theme_part", "master_part", "theme")):
        link = first_rel(rels, kind).select("deck_id", F.col("source_part").alias(source), F.col("resolved").alias(name))
        out = out.join(link, ["deck_id", source], "left")
    return out.select(*slide_rows.columns, "layout_part", "master_part", "theme_part")


def slide_size(nodes: DataFrame) -> DataFrame:
    """(deck_id, width, height) in points, as they are."""
    size = nodes.filter((F.col("part_path") == "ppt/presentation.xml") & (F.col("tag") == "sldSz"))
    points = lambda c: attr(c).try_cast("double") / 914400.0 * 96.0 * 0.75
    return size.groupBy("deck_id").agg(F.min_by(points("cx"), "nid").alias("width"), F.min_by(points("cy"), "nid").alias("height"))


def theme_colors(nodes: DataFrame) -> DataFrame:
    """(deck_id, part_path, colors): a map from slots to colours, those of the system by the value last seen."""
    slot = nodes.filter(F.col("tag").isin(*SLOTS) & F.col("way").contains("clrScheme/")).select("deck_id", "part_path", F.col("nid").alias("parent"), F.col("tag").alias("slot"))
    value = nodes.filter(F.col("tag").isin("srgbClr", "sysClr")).select("deck_id", "part_path", "parent", F.when(F.col("tag") == "srgbClr", attr("val")).otherwise(F.coalesce(attr("lastClr"), attr("val"))).alias("value"))
    met = slot.join(value, ["deck_id", "part_path", "parent"]).groupBy("deck_id", "part_path", "slot").agg(F.min_by("value", "parent").alias("value"))
    return met.groupBy("deck_id", "part_path").agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("colors"))


def color_maps(nodes: DataFrame) -> DataFrame:
    """(deck_id, part_path, mapped): a master's map, or a layout's override, from scheme names to theme slots."""
    kept = nodes.filter(F.col("tag").isin("clrMap", "overrideClrMapping"))
    return kept.groupBy("deck_id", "part_path").agg(F.min_by("attrs", "nid").alias("mapped"))


def master_shapes_shown(nodes: DataFrame) -> DataFrame:
    """(deck_id, part_path, shows) of slides and layouts: whether they let the shapes of what lies behind them show."""
    root = nodes.filter((F.col("depth") == 0) & F.col("tag").isin("sld", "sldLayout"))
    return root.select("deck_id", "part_path", (F.coalesce(attr("showMasterSp"), F.lit("1")) != "0").alias("shows"))


def written_by_other_office(nodes: DataFrame) -> DataFrame:
    """(deck_id, other): whether names in the presentation tell of the office suite WPS."""
    main = nodes.filter(F.col("part_path") == "ppt/presentation.xml")
    named = F.exists(F.map_values("attrs"), lambda v: v.rlike("wps|kso|Kingsoft|WPS")) | F.col("tag").rlike("wps|kso")
    return main.groupBy("deck_id").agg(F.bool_or(F.coalesce(named, F.lit(False))).alias("other"))


def all_rels(rels: DataFrame, kind: str) -> DataFrame:
    """(deck_id, source_part, targets): all targets of a part's relationships whose type holds ``kind``, in order."""
    one = rels.filter(F.contains("type", F.lit(kind)))
    return one.groupBy("deck_id", "source_part").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("resolved", "target").alias("t")))), lambda x: x["t"]).alias("targets"))


def notes(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """(deck_id, slide_part, note): the text of a slide's notes: of the shapes there that are placeholders of bodies, without separators, trimmed."""
    keys = ["deck_id", "part_path"]
    to_note = first_rel(rels, "notesSlide").withColumnRenamed("resolved", "part_path")
    body = nodes.filter((F.col("way") == "nvSpPr/nvPr/ph") & (attr("type") == "body")).select(*keys, "owner").distinct()
    words = nodes.filter((F.col("tag") == "t") & F.col("way").startswith("txBody/")).select(*keys, "owner", "nid", F.coalesce("text", F.lit("")).alias("text")).join(body, [*keys, "owner"])
    text = words.groupBy(*keys).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nid", "text"))), lambda x: x["text"]), "")).alias("note"))
    return to_note.join(text, keys).select("deck_id", F.col("source_part").alias("slide_part"), "note")
