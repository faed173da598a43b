"""XML parts to elements, one row each, so that navigating is filtering and joining.

nid is the place in document order (root 1) and last that of the last descendant: d lies below a if a.nid < d.nid <= a.last.  owner
is the nearest shape-like element (``OWNERS``) at or above an element, and way the names of the elements from there on: pivoting by
owner and way needs one grouping, however many properties are asked for.  grp is the nearest group above an element and alt the outermost
AlternateContent above it, noted on the way down, so that neither needs a join of elements with what lies around them.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import archive

#: Paths of parts that are XML.
XML = re.compile(r"\.(xml|rels)$")
#: Elements that own what lies below them, down to the next such element.
OWNERS = frozenset(["sp", "pic", "graphicFrame", "cxnSp", "grpSp", "Relationship", "ser", "tc", "tblStyle"])
_RELATIONS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_SCHEMA = pa.schema(
    [
        ("deck_id", pa.string()), ("part_path", pa.string()), ("nid", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()),
        ("pos", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("owner", pa.int32()), ("way", pa.string()), ("para", pa.int32()), ("grp", pa.int32()), ("alt", pa.int32()),
    ]
)
NODES = "deck_id string, part_path string, nid int, last int, parent int, depth int, pos int, tag string, attrs map<string,string>, text string, owner int, way string, para int, grp int, alt int"


#: Elements in a batch on their way to Spark.
ROWS = 10_000


@lru_cache(4096)
def _local(name: str) -> str:
    return name.rpartition("}")[2]


@lru_cache(4096)
def _attribute(name: str) -> str:
    return ("r:" if name.startswith(_RELATIONS) else "") + _local(name)


class Rows:
    """Columns of elements, gathered over parts until there is a batch of them."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in _SCHEMA.names]
        self.offsets: list[int] = [0]  # of attributes
        self.names: list[str] = []
        self.values: list[str] = []

    def __len__(self) -> int:
        return len(self.columns[0])

    def add(self, deck: str | None, path: str | None, data: bytes, only: frozenset[str] | None = None) -> bool:
        """Add a part's elements, or those of the tags ``only``; False, and none are added, if it is malformed or declares a type."""
        if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
            return False
        try:
            root = ET.fromstring(data)
        except ET.ParseError:
            return False
        decks, paths, nids, lasts, parents, depths, places, tags, _, texts, owners, ways, paras, groups, alts = self.columns
        first = len(nids)
        waiting = [(root, 0, 0, 1, None, "", None, None, None)]
        open_: list[int] = []  # places in columns of the elements on the way down, -1 for those that are left out
        nid = 0
        while waiting:
            node, parent, depth, pos, owner, way, para, grp, alt = waiting.pop()
            while len(open_) > depth:
                if (i := open_.pop()) >= 0:
                    lasts[i] = nid
            nid += 1
            tag = _local(node.tag)
            if tag in OWNERS:
                owner, way = nid, ""
            else:
                way = f"{way}/{tag}" if way else tag
            if tag == "p":
                para = nid
            if only is None or tag in only:
                if said := node.items():
                    attrs = {_attribute(k): v for k, v in said}
                    self.names += attrs
                    self.values += attrs.values()
                self.offsets.append(len(self.names))
                nids.append(nid)
                lasts.append(nid)
                parents.append(parent)
                depths.append(depth)
                places.append(pos)
                tags.append(tag)
                texts.append(node.text)
                owners.append(owner)
                ways.append(way)
                paras.append(para)
                groups.append(grp)
                alts.append(alt)
                open_.append(len(nids) - 1)
            else:
                open_.append(-1)
            if len(node):
                if tag == "grpSp":
                    grp = nid
                elif tag == "AlternateContent" and alt is None:
                    alt = nid
                children = [c for c in node if isinstance(c.tag, str)]
                waiting += [(c, nid, depth + 1, len(children) - i, owner, way, para, grp, alt) for i, c in enumerate(reversed(children))]
        for i in open_:
            if i >= 0:
                lasts[i] = nid
        added = len(nids) - first
        decks += [deck] * added
        paths += [path] * added
        return True

    def batches(self) -> Iterator[pa.RecordBatch]:
        """What was added, at most ``ROWS`` elements at a time."""
        for i in range(0, len(self), ROWS):
            j = min(i + ROWS, len(self))
            offsets = self.offsets[i : j + 1]
            at = slice(offsets[0], offsets[-1])
            attrs = pa.MapArray.from_arrays(pa.array([x - offsets[0] for x in offsets], pa.int32()), pa.array(self.names[at], pa.string()), pa.array(self.values[at], pa.string()))
            yield pa.RecordBatch.from_arrays([attrs if f.name == "attrs" else pa.array(c[i:j], f.type) for c, f in zip(self.columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def walk(data: bytes) -> list[tuple]:
    """Rows (nid, last, parent, depth, pos, tag, attrs, text, owner, way, para, grp, alt) of a document; none if it is malformed or declares a type."""
    rows = Rows()
    rows.add(None, None, data)
    rows.columns[_SCHEMA.get_field_index("attrs")] = [list(zip(rows.names[i:j], rows.values[i:j], strict=True)) for i, j in pairwise(rows.offsets)]
    return list(zip(*rows.columns[2:], strict=True))


def _batches(parts: Iterable[tuple[str, str, bytes]], only: frozenset[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of the elements of parts (deck_id, part_path, content), or of those of the tags ``only``."""
    rows = Rows()
    for deck, path, data in parts:
        rows.add(deck, path, data.removeprefix(b"\xef\xbb\xbf"), only)
        if len(rows) >= ROWS:
            yield from rows.batches()
            rows = Rows()
    yield from rows.batches()


def elements(parts: DataFrame) -> DataFrame:
    """A row for each element of the parts; parts of other kinds than XML should be filtered out before."""

    def run(batches):
        yield from _batches((deck.as_py(), path.as_py(), data.as_py() or b"") for batch in batches for deck, path, data in zip(*batch.columns, strict=True))

    return parts.select("deck_id", "part_path", "content").mapInArrow(run, NODES)


def deck_elements(decks: DataFrame, only: frozenset[str] | None = None, **limits: int | bool | None) -> DataFrame:
    """Elements of the XML parts of decks (deck_id, content): those of ``archive.parts`` with the same limits.

    A deck is unpacked and walked in one step: its XML, many times as long as the archive, stays in the task and is one part long at a time.
    With ``only`` elements of other tags are walked but have no row: who asks for some needn't have the others written.
    """

    def run(batches):
        yield from _batches(((deck, path, data) for batch in batches for deck, path, data in archive.opened(batch, **limits) if path is not None and XML.search(path)), only)

    return decks.select(F.col("deck_id").cast("string"), "content").mapInArrow(run, NODES)


def fault(data: bytes) -> str | None:
    """Why a document has no elements."""
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        return "document type"
    return None if walk(data) else "malformed"


def faults(parts: DataFrame) -> DataFrame:
    """(deck_id, part_path, fault) of parts that are not XML (malformed) or declare a type (document type); ``elements`` has no rows of these."""

    def run(batches):
        for batch in batches:
            found = [(d, p, why) for d, p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True) if (why := fault((data.as_py() or b"").removeprefix(b"\xef\xbb\xbf")))]
            columns = list(zip(*found, strict=True)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["deck_id", "part_path", "fault"])

    return parts.select("deck_id", "part_path", "content").mapInArrow(run, "deck_id string, part_path string, fault string")


def attr(name: str) -> Column:
    """An attribute of the element, or null."""
    return F.col("attrs")[name]


def number(value: Column) -> Column:
    """A numeric attribute: blank is 0, what is no number is null."""
    return F.when(F.trim(value) == "", F.lit(0.0)).otherwise(value.try_cast("double"))


def at(way: str, value: Column, tag: str | None = None) -> Column:
    """For grouping by owner: value of the first element on a way, in document order."""
    return F.min_by(value, F.when((F.col("way") == way) & (F.lit(True) if tag is None else F.col("tag") == tag), F.col("nid")))
