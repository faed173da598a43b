"""Decks from tables: the markup of slides as string columns, put together by Spark and packed to archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape
from .archive import pack

_NAMES = (
    'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" '
    'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"'
)
RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def text(*parts: Column | str) -> Column:
    """Strings put together; null columns count as empty."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def clean(value: Column) -> Column:
    """Text as XML can hold it: without control characters, line ends as line feeds, escaped."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")
    return escape(plain)


def xfrm(x: Column, y: Column, cx: Column, cy: Column, extra: Column | str = "", inner: Column | str = "", tag: str = "a:xfrm") -> Column:
    whole = lambda c: c.cast("long")
    return text(f"<{tag} ", extra, '><a:off x="', whole(x), '" y="', whole(y), '"/><a:ext cx="', whole(cx), '" cy="', whole(cy), '"/>', inner, f"</{tag}>")


def run(value: Column, props: Column | str = "") -> Column:
    return text("<a:r><a:rPr ", props, "/><a:t>", clean(value), "</a:t></a:r>")


def paragraph(runs: Column, props: Column | str = "") -> Column:
    return text("<a:p>", props, runs, "</a:p>")


def lines(value: Column) -> Column:
    """A paragraph of one run for each line of a text, cleaned as a whole."""
    return paragraph(text("<a:r><a:rPr /><a:t>", F.replace(clean(value), F.lit("\n"), F.lit("</a:t></a:r></a:p><a:p><a:r><a:rPr /><a:t>")), "</a:t></a:r>"))


def shape(id: Column, name: Column, box: Column | str = "", body: Column | str = "", ph: Column | str = "", geometry: Column | str = "") -> Column:
    return text('<p:sp><p:nvSpPr><p:cNvPr id="', id, '" name="', clean(name), '"/><p:cNvSpPr/><p:nvPr>', ph, "</p:nvPr></p:nvSpPr><p:spPr>", box, geometry, "</p:spPr><p:txBody><a:bodyPr/>", body, "</p:txBody></p:sp>")


def frame(id: Column, inner: Column, uri: str, box: Column | str = "") -> Column:
    return text('<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="', id, '" name="frame"/></p:nvGraphicFramePr>', box, f'<a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/{uri}">', inner, "</a:graphicData></a:graphic></p:graphicFrame>")


def page(children: Column | str, kind: str = "sld", extra: Column | str = "") -> Column:
    """A slide, or a layout (sldLayout) or master (sldMaster)."""
    return text(f"<p:{kind} {_NAMES}><p:cSld><p:spTree>", children, "</p:spTree></p:cSld>", extra, f"</p:{kind}>")


def relationships(each: Column | str) -> Column:
    return text('<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">', each, "</Relationships>")


def relationship(id: Column | str, kind: str, target: Column | str, mode: str = "") -> Column:
    return text('<Relationship Id="', id, f'" Type="{RELATION}/{kind}" Target="', target, '"', f' TargetMode="{mode}"' if mode else "", "/>")


def gathered(rows: DataFrame, keys: list[str], order: str | list[str], value: str) -> DataFrame:
    """(keys, value): strings of a group in order, put together."""
    order = [order] if isinstance(order, str) else order
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]), "").alias(value))


def decks(slides: DataFrame, more: DataFrame | None = None, size: tuple[Column | str, Column | str] = ("9144000", "6858000"), listed: bool = True) -> DataFrame:
    """(deck_id, content) of slides (deck_id, n, at, xml): slide n stands at place ``at`` of the slide list, if there is one.

    ``more`` has further parts (deck_id, part_path, content), such as layouts, charts and relationships of slides.
    """
    own = slides.select("deck_id", text("ppt/slides/slide", F.col("n"), ".xml").alias("part_path"), F.col("xml").alias("content"))
    entry = text('<p:sldId id="', F.col("n") + 255, '" r:id="rId', F.col("n"), '"/>')
    link = relationship(text("rId", F.col("n")), "slide", text("slides/slide", F.col("n"), ".xml"))
    rows = slides.select("deck_id", "n", "at", entry.alias("entry"), link.alias("link"))
    listing = gathered(rows, ["deck_id"], ["at", "n"], "entry")
    main = listing.select("deck_id", F.lit("ppt/presentation.xml").alias("part_path"), text(f"<p:presentation {_NAMES}>", text("<p:sldIdLst>", F.col("entry"), "</p:sldIdLst>") if listed else "", '<p:sldSz cx="', size[0], '" cy="', size[1], '"/></p:presentation>').alias("content"))
    links = gathered(rows, ["deck_id"], ["n"], "link").select("deck_id", F.lit("ppt/_rels/presentation.xml.rels").alias("part_path"), relationships(F.col("link")).alias("content"))
    every = own.unionByName(main).unionByName(links)
    return pack(every.unionByName(more) if more is not None else every)
