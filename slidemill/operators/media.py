"""Media by their bytes: one that many decks hold is one, and shapes refer to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.media import media_type, needs_conversion, unsupported
from .package import media_path

#: Places of media up to which their table is broadcast; a larger one is joined by shuffling.
SMALL = 200_000


def placed(parts: DataFrame) -> DataFrame:
    """(deck_id, part_path, media_id, size, type, conversion, unknown) of media: media_id is the hash of their bytes, which go no further than here.

    conversion tells whether a browser can't show them as they are, unknown whether they can't be shown at all.
    """
    found = parts.filter("kind = 'media' AND content IS NOT NULL")
    path = F.col("part_path")
    return found.select("deck_id", "part_path", F.sha2("content", 256).alias("media_id"), "size", media_type(path).alias("type"), needs_conversion(path).alias("conversion"), unsupported(path).alias("unknown"))


def distinct(places: DataFrame) -> DataFrame:
    """(media_id, deck_id, part_path, size, type, n_places, n_decks): each medium once, with the first place that has it, and how many have."""
    first = F.min(F.struct("deck_id", "part_path", "size", "type")).alias("x")
    return places.groupBy("media_id").agg(first, F.count("*").alias("n_places"), F.count_distinct("deck_id").alias("n_decks")).select("media_id", "x.*", "n_places", "n_decks")


def kept(parts: DataFrame, once: DataFrame) -> DataFrame:
    """(media_id, type, content): each medium's bytes, once, to be written as a table; once: ``distinct``.

    Places to keep are few against bytes: their table is sent to where archives are unpacked, if it is small, so that no bytes are shuffled.
    """
    wanted = once.select("deck_id", "part_path", "media_id", "type")
    small = wanted.limit(SMALL + 1).count() <= SMALL
    found = parts.filter("kind = 'media'").select("deck_id", "part_path", "content")
    return found.join(F.broadcast(wanted) if small else wanted, ["deck_id", "part_path"]).select("media_id", "type", "content")


def sources(found: DataFrame, rels: DataFrame, parts: DataFrame) -> DataFrame:
    """(deck_id, part_path, nid, blob, poster) of shapes that play something; found: shapes with video_rid, audio_rid and rid.

    blob is the medium, or the address of one on the web; null where the deck has neither.  poster is the picture of a video, null if browsers can't show it.
    """
    keys = ["deck_id", "part_path"]
    plays = found.filter("video_rid IS NOT NULL OR audio_rid IS NOT NULL").select(*keys, "nid", F.inline(F.array(F.struct(F.coalesce("video_rid", "audio_rid").alias("rid"), F.lit(False).alias("still")), F.struct(F.when(F.col("video_rid").isNotNull(), F.col("rid")).alias("rid"), F.lit(True).alias("still")))))
    target = rels.select("deck_id", F.col("source_part").alias("part_path"), "rid", "target", media_path(F.col("target")).alias("medium"))
    there = parts.filter("kind = 'media'").select("deck_id", F.col("part_path").alias("medium")).distinct().withColumn("there", F.lit(True))
    met = plays.join(target, [*keys, "rid"], "left").join(there, ["deck_id", "medium"], "left")
    web = F.col("target").rlike("^https?://")
    blob = F.when(~F.col("still"), F.when(web, F.col("target")).when(F.col("there"), F.col("medium")))
    poster = F.when(F.col("still") & F.col("there") & ~unsupported(F.col("medium")), F.col("medium"))
    return met.groupBy(*keys, "nid").agg(F.max(blob).alias("blob"), F.max(poster).alias("poster"))


def used(found: DataFrame, rels: DataFrame, places: DataFrame) -> DataFrame:
    """(deck_id, part_path, nid, media_id): the medium of each shape that refers to one; found: shapes with rid."""
    target = rels.select("deck_id", F.col("source_part").alias("part_path"), "rid", F.col("resolved").alias("medium"))
    at = places.select("deck_id", F.col("part_path").alias("medium"), "media_id")
    return found.select("deck_id", "part_path", "nid", "rid").join(target, ["deck_id", "part_path", "rid"]).join(at, ["deck_id", "medium"]).select("deck_id", "part_path", "nid", "media_id")
