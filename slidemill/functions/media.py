"""Media: their types, and how documents name them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types by the ending of a path.
TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "bmp": "image/bmp", "tiff": "image/tiff",
    "tif": "image/tiff", "emf": "image/x-emf", "wmf": "image/x-wmf", "webp": "image/webp", "mp4": "video/mp4", "m4v": "video/mp4", "webm": "video/webm",
    "avi": "video/x-msvideo", "mp3": "audio/mpeg", "wav": "audio/wav", "m4a": "audio/mp4", "ogg": "audio/ogg",
}


def ending(path: Column) -> Column:
    """What follows the last dot, in small letters; the whole path where there is no dot."""
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def media_type(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, ending(path)), F.lit("application/octet-stream"))


def data_url(path: Column, content: Column) -> Column:
    """The bytes of a medium as an address; base64 without line ends."""
    return F.concat(F.lit("data:"), media_type(path), F.lit(";base64,"), F.regexp_replace(F.base64(content), "[\r\n]", ""))


def unsupported(path: Column) -> Column:
    """Metafiles, which browsers don't show."""
    return ending(path).isin("wmf")


def needs_conversion(path: Column) -> Column:
    return ending(path).isin("emf", "wmf", "tif", "tiff")
