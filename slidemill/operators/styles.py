"""Transitions, what bodies of text say of themselves, links, colours of series, and what is a shape or a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_link
from ..sources.xmltree import at, attr, number


def transitions(nodes: DataFrame) -> DataFrame:
    """(deck_id, part_path, type, duration, direction) of slides that have one; durations in milliseconds."""
    t = nodes.filter((F.col("tag") == "transition") & (F.col("depth") == 1)).groupBy("deck_id", "part_path").agg(F.min_by(F.struct("nid", attr("spd").alias("spd"), attr("dir").alias("dir")), "nid").alias("t"))
    kind = nodes.select("deck_id", "part_path", F.col("parent").alias("at"), "pos", "tag")
    met = t.withColumn("at", F.col("t.nid")).join(kind, ["deck_id", "part_path", "at"], "left")
    met = met.groupBy("deck_id", "part_path", "t").agg(F.min_by("tag", "pos").alias("tag"))
    duration = F.when(F.col("t.spd") == "fast", 500).when(F.col("t.spd") == "med", 800).otherwise(1000)
    return met.select("deck_id", "part_path", F.coalesce("tag", F.lit("none")).alias("type"), duration.alias("duration"), F.nullif("t.dir", F.lit("")).alias("direction"))


def bodies(nodes: DataFrame) -> DataFrame:
    """(deck_id, part_path, owner, anchor, vert, autofit, font_scale) of shapes' text bodies, as they say themselves."""
    body = "txBody/bodyPr"
    found = nodes.filter(F.col("owner").isNotNull() & F.col("way").startswith(body)).groupBy("deck_id", "part_path", "owner").agg(
        at(body, F.nullif(attr("anchor"), F.lit(""))).alias("anchor"), at(body, F.nullif(attr("vert"), F.lit(""))).alias("vert"), at(f"{body}/spAutoFit", F.lit(True)).alias("to_shape"), at(f"{body}/normAutofit", F.lit(True)).alias("to_text"), at(f"{body}/normAutofit", number(attr("fontScale"))).alias("scale")
    )
    return found.select("deck_id", "part_path", "owner", "anchor", "vert", F.when(F.col("to_shape"), "shape").when(F.col("to_text"), "text").alias("autofit"), F.when(F.col("to_shape").isNull(), F.col("scale") / 1000.0).alias("font_scale"))


def inherited_bodies(found: DataFrame, said: DataFrame) -> DataFrame:
    """(deck_id, part_path, nid, valign, vertical, autofit, font_scale) of shapes with text bodies; said: ``bodies``.

    found: shapes with the placeholders that they match (``shapes.inherited``).  What a body doesn't say of its alignment and direction its
    layout's placeholder says, if it has a body; else its master's, unless the layout's has a place.
    """
    behind = lambda part, nid, name: said.select("deck_id", F.col("part_path").alias(part), F.col("owner").alias(nid), F.struct("anchor", "vert").alias(name))
    met = found.select("deck_id", "part_path", "nid", "layout_part", "master_part", "l_match", "m_match", "l_placed").join(said.withColumnRenamed("owner", "nid"), ["deck_id", "part_path", "nid"])
    met = met.join(behind("layout_part", "l_match", "l_body"), ["deck_id", "layout_part", "l_match"], "left").join(behind("master_part", "m_match", "m_body"), ["deck_id", "master_part", "m_match"], "left")
    fallback = F.coalesce("l_body", F.when(~F.coalesce("l_placed", F.lit(False)), F.col("m_body")))
    vertical = F.coalesce(F.coalesce("vert", fallback["vert"]).isin("eaVert", "vert", "wordArtVert", "vert270"), F.lit(False))
    return met.select("deck_id", "part_path", "nid", valign(F.coalesce("anchor", fallback["anchor"])).alias("valign"), vertical.alias("vertical"), "autofit", "font_scale")


def valign(anchor: Column) -> Column:
    return F.when(anchor.isin("ctr", "mid", "middle"), "mid").when(anchor.isin("b", "bottom"), "down").otherwise("up")


def links(found: DataFrame, rels: DataFrame) -> DataFrame:
    """shapes with link: #slide-N for a jump, else the address if it leads outside and is safe."""
    r = rels.select("deck_id", F.col("source_part").alias("part_path"), F.col("rid").alias("link_rid"), "target", "mode")
    met = found.join(r, ["deck_id", "part_path", "link_rid"], "left")
    slide = F.regexp_extract("target", r"(?i)slide(\d+)\.xml", 1)
    jump = F.col("link_action") == "ppaction://hlinksldjump"
    link = F.when(F.coalesce(jump, F.lit(False)), F.when(slide != "", F.concat(F.lit("#slide-"), slide))).when((F.col("mode") == "External") & safe_link(F.col("target")), F.col("target"))
    return met.select(*found.columns, link.alias("link"))


def decorations(found: DataFrame) -> DataFrame:
    """Shapes of layouts and masters that show on slides: no placeholders, and not without any extent."""
    return found.filter(~F.col("ph") & ((F.coalesce("cx", F.lit(0.0)) > 0) | (F.coalesce("cy", F.lit(0.0)) > 0)))


def series_color(own: Column, place: Column, accents: Column) -> Column:
    """A series' own colour, or the accent at its place, going round."""
    return F.coalesce(own, F.element_at(accents, (F.pmod(place, F.size(accents)) + 1).cast("int")))


def is_text(text_box: Column, ph_type: Column, custom: Column, prst: Column, has_text: Column, painted: Column) -> Column:
    """Whether a shape is given out as a text: boxes and text placeholders are, outlines other than rectangles and painted ones are not."""
    preset = prst.isNotNull()
    odd = preset & (prst != "rect")
    return (
        F.when(text_box | F.coalesce(ph_type.isin("body", "title", "ctrTitle", "subTitle"), F.lit(False)), True)
        .when(custom, False)
        .when(F.coalesce(odd, F.lit(False)) | ph_type.isNull(), ~((preset & painted) | F.coalesce(odd, F.lit(False)) | (~preset & ~has_text)))
        .otherwise(True)
    )

