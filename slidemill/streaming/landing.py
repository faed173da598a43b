"""Decks that arrive in a folder: each file is read once, unpacked and appended; no state but the list of files seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.archive import parts

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """A stream of (deck_id, content)."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.pptx").option("maxFilesPerTrigger", files_at_once).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("deck_id"), "content")


def keep_parts(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append the parts of all decks that are there now, and that no earlier run with this checkpoint has seen, to a table of Parquet files."""
    stream = parts(arriving(spark, source))
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
