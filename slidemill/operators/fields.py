"""Fields of text documents: instructions between begin and separate, results between separate and end, nested as they may be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.xmltree import attr
from .palette import KEYS


def _events(nodes: DataFrame) -> DataFrame:
    """Marks of fields, instructions and texts of a document's runs."""
    rows = nodes.filter(F.col("tag").isin("fldChar", "instrText", "t"))
    return rows.select(*KEYS, "nid", "tag", attr("fldCharType").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))


def fields(nodes: DataFrame) -> DataFrame:
    """(deck_id, part_path, field, depth, instruction, result): field is the place of its begin, depth 1 for one that lies in no other.

    Nesting is a running sum over the marks of a document; what stands at a depth belongs to the last field that has begun there, before its
    separate to its instruction and after it to its result.  What inner fields hold is theirs alone.  A field without an end goes to the end
    of the document; an end without a begin is left out.
    """
    order = Window.partitionBy(*KEYS).orderBy("nid").rowsBetween(Window.unboundedPreceding, 0)
    step, ends = F.when(F.col("mark") == "begin", 1).when(F.col("mark") == "end", -1).otherwise(0), F.coalesce((F.col("mark") == "end").cast("int"), F.lit(0))
    rows = _events(nodes).withColumn("sum", F.sum(step).over(order))
    # ends without a begin don't count: the sum starts anew from its lowest place
    rows = rows.withColumn("height", F.col("sum") - F.least(F.lit(0), F.min("sum").over(order)) + ends)
    at = Window.partitionBy(*KEYS, "height").orderBy("nid").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.col("mark") == "begin"
    rows = rows.filter("height > 0").withColumn("field", F.last(F.when(begun, F.col("nid")), True).over(at)).filter("field IS NOT NULL")
    # of the marks at a field's height, the last one before a text tells where it is
    rows = rows.withColumn("state", F.last(F.when(F.col("tag") == "fldChar", F.col("mark")), True).over(at))
    part = lambda tag, state: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("tag") == tag) & (F.col("state") == state), F.struct("nid", "text")))), lambda x: x["text"]), "")
    return rows.groupBy(*KEYS, "field").agg(F.min("height").alias("depth"), part("instrText", "begin").alias("instruction"), part("t", "separate").alias("result"))


def plain_text(nodes: DataFrame) -> DataFrame:
    """(deck_id, part_path, text): what stands outside of fields, trimmed: texts that don't follow a begin, or whose last mark is an end."""
    order = Window.partitionBy(*KEYS).orderBy("nid").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.last(F.when(F.col("mark").isin("begin", "end"), F.col("mark")), True).over(order)
    rows = _events(nodes).withColumn("last_mark", mark)
    shown: Column = F.when((F.col("tag") == "t") & (F.coalesce("last_mark", F.lit("end")) == "end"), F.struct("nid", "text"))
    return rows.groupBy(*KEYS).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["text"]), "")).alias("text"))
