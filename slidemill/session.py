"""A session with the settings that decks want, and the package on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def session(name: str = "slidemill", **conf: str) -> SparkSession:
    """A session with adaptive execution and small Arrow batches, for rows that hold whole archives; ``conf`` by name with __ for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.maxRecordsPerBatch", "64").config("spark.sql.session.timeZone", "UTC")
    # plans are large: noting where each expression was written takes a third of the time in which they are made
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    found = builder.getOrCreate()
    ship(found)
    return found


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once for a session: Python workers on other machines find them there.

    Spark's own file server hands the archive out; its file on the driver's side is read by that server alone.
    """
    context = spark.sparkContext
    if getattr(context, "_slidemill_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    held, path = tempfile.mkstemp(prefix="slidemill-", suffix=".zip")
    with os.fdopen(held, "wb") as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    archive.write(whole, os.path.relpath(whole, os.path.dirname(here)))
    context.addPyFile(path)
    context._slidemill_shipped = True
