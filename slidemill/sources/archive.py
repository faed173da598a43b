"""Archives to parts and back.

A deck is a row (deck_id, content).  ``parts`` gives a row for each file in it; ``pack`` is the way back.  Bytes of media stay in
column content and out of everything that follows, which reads XML parts alone.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import save

PARTS = "deck_id string, ordinal int, part_path string, size long, content binary, status string"

#: Which paths are parts of which kind; the first that matches counts.
KINDS = [
    ("content_types", r"^\[Content_Types\]\.xml$"),
    ("presentation", r"^ppt/presentation\.xml$"),
    ("presentation_rels", r"^ppt/_rels/presentation\.xml\.rels$"),
    ("table_styles", r"^ppt/tableStyles\.xml$"),
    ("media", r"^ppt/media/"),
    ("slide_rels", r"^ppt/slides/_rels/slide\d+\.xml\.rels$"),
    ("slide", r"^ppt/slides/slide\d+\.xml$"),
    ("notes", r"^ppt/notesSlides/notesSlide\d+\.xml$"),
    ("layout_rels", r"^ppt/slideLayouts/_rels/slideLayout\d+\.xml\.rels$"),
    ("layout", r"^ppt/slideLayouts/slideLayout\d+\.xml$"),
    ("master_rels", r"^ppt/slideMasters/_rels/slideMaster\d+\.xml\.rels$"),
    ("master", r"^ppt/slideMasters/slideMaster\d+\.xml$"),
    ("theme", r"^ppt/theme/theme\d+\.xml$"),
    ("chart", r"^ppt/charts/chart\d+\.xml$"),
    ("chart_style", r"^ppt/charts/style\d+\.xml$"),
    ("chart_colors", r"^ppt/charts/colors\d+\.xml$"),
    ("diagram_drawing", r"^ppt/diagrams/drawing\d+\.xml$"),
    ("embedding", r"^ppt/embeddings/"),
]


def kind(path: Column) -> Column:
    """The kind of a part by its path; null for others."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


def read_decks(spark: SparkSession, path: str, glob: str = "*.pptx") -> DataFrame:
    """(deck_id, content) of the files under a path; deck_id is the file's name without its ending."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("deck_id"), "content")


def _beyond(files: list[zipfile.ZipInfo], max_entries: int | None, max_bytes: int | None, max_entry_bytes: int | None, max_media_bytes: int | None) -> str | None:
    sizes = [x.file_size for x in files]
    media = sum(x.file_size for x in files if x.filename.replace("\\", "/").startswith("ppt/media/"))
    found = (("max_entries", max_entries, len(files)), ("max_entry_bytes", max_entry_bytes, max(sizes, default=0)), ("max_bytes", max_bytes, sum(sizes)), ("max_media_bytes", max_media_bytes, media))
    return next((f"limit: {name}" for name, most, n in found if most is not None and n > most), None)


def _files(deck: str | None, content: bytes, strict: bool = False, **limits: int | None) -> list[tuple]:
    """Rows (deck_id, ordinal, part_path, size, content, status) of one archive."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        files = [x for x in archive.infolist() if not x.is_dir()]
        if why := _beyond(files, **limits):
            found = [(deck, None, None, None, None, why)]
        else:
            found = [(deck, i, x.filename.replace("\\", "/"), x.file_size, archive.read(x), "ok") for i, x in enumerate(files)]
    except (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, OSError) as error:  # as zipfile has it for broken, encrypted and unknown ones
        found = [(deck, None, None, None, None, f"corrupt: {error}")]
    if strict and (bad := [x[5] for x in found if x[5] != "ok"]):
        raise ValueError(f"deck {deck}: {bad[0]}")
    return found


def opened(batch: pa.RecordBatch, max_entries: int | None = None, max_bytes: int | None = None, max_entry_bytes: int | None = None, max_media_bytes: int | None = None, strict: bool = False) -> Iterator[tuple[str | None, str | None, bytes | None]]:
    """(deck_id, part_path, content) of the files of the archives in a batch (deck_id, content), an archive at a time; for tasks."""
    for deck, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        for row in _files(deck, content.as_py() or b"", strict, max_entries=max_entries, max_bytes=max_bytes, max_entry_bytes=max_entry_bytes, max_media_bytes=max_media_bytes):
            yield deck, row[2], row[4]


def parts(decks: DataFrame, max_entries: int | None = None, max_bytes: int | None = None, max_entry_bytes: int | None = None, max_media_bytes: int | None = None, strict: bool = False) -> DataFrame:
    """(deck_id, ordinal, part_path, kind, size, content, status) of the files in decks, in the order of the archive.

    status is ok for all files of a sound deck.  A deck that is no archive, or of which a file can't be unpacked, has one row of status
    corrupt without a path; one beyond a limit has one of status limit and the limit's name: that is seen from the archive's directory, before
    anything is unpacked.  With ``strict`` such a deck ends the job instead.
    """

    limits = {"max_entries": max_entries, "max_bytes": max_bytes, "max_entry_bytes": max_entry_bytes, "max_media_bytes": max_media_bytes, "strict": strict}

    def unzip(batches):
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.string())
        for batch in batches:
            for deck, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if found := _files(deck, content.as_py() or b"", **limits):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["deck_id", "ordinal", "part_path", "size", "content", "status"])

    found = decks.select(F.col("deck_id").cast("string"), "content").mapInArrow(unzip, PARTS)
    return found.withColumn("kind", kind(F.col("part_path")))


#: Files in archives that are archives themselves.
ARCHIVES = r"(?i)\.(docx|docm|xlsx|xlsm|pptx|pptm|zip)$"


def embedded(found: DataFrame, depth: int = 1, **limits: int | bool) -> DataFrame:
    """(deck_id, inside, ordinal, part_path, size, content, status) of the files in archives that lie among the embeddings of decks; found: ``parts``.

    inside is the way to the archive: its path in the deck, and for those deeper down the path in each archive on the way.  ``depth`` levels are
    unpacked.  Limits are those of ``parts``, for each archive: one beyond them, or none at all, has a row that says so.
    """
    named = lambda inside: F.to_json(F.struct("deck_id", inside.alias("inside"))).alias("deck_id")
    level, out = found.filter("kind = 'embedding' AND content IS NOT NULL").select(named(F.col("part_path")), "content"), None
    for _ in range(depth):
        got = parts(level, **limits).withColumn("at", F.from_json("deck_id", "deck_id string, inside string"))
        got = got.select("at.deck_id", "at.inside", "ordinal", "part_path", "size", "content", "status")
        out = got if out is None else out.unionByName(got)
        level = got.filter((F.col("status") == "ok") & F.col("part_path").rlike(ARCHIVES)).select(named(F.concat("inside", F.lit("/"), "part_path")), "content")
    return out


def pack(files: DataFrame) -> DataFrame:
    """(deck_id, content): archives of rows (deck_id, part_path, content), of which content is a string or bytes; files ordered by path.

    The same files give the same bytes: times are fixed.
    """
    grouped = files.select(F.col("deck_id").cast("string"), F.struct("part_path", F.col("content").cast("binary").alias("content")).alias("file"))
    grouped = grouped.groupBy("deck_id").agg(F.array_sort(F.collect_list("file")).alias("files"))

    def write(batches):
        for batch in batches:
            out = []
            for files in batch.column(1):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
                    for f in files.as_py():
                        archive.writestr(zipfile.ZipInfo(f["part_path"], (1980, 1, 1, 0, 0, 0)), f["content"] or b"")
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["deck_id", "content"])

    return grouped.mapInArrow(write, "deck_id string, content binary")


def write_decks(decks: DataFrame, path: str) -> None:
    """Keep decks as a table of archives, one row each."""
    save(decks, path, "overwrite")


def archive_stats(found: DataFrame) -> DataFrame:
    """(deck_id, entries, bytes, largest) by deck, by which archives can be limited afterwards."""
    return found.filter("part_path IS NOT NULL").groupBy("deck_id").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
