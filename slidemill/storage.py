"""Where intermediate tables are kept."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir.

    Only a session that runs in one process, as in tests, may go without that setting and gets a folder of its own: on a cluster
    such a folder would be seen by one machine alone.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not named and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return named or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder: its lineage ends there and survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Bytes that Python workers are handed at a time while archives are made, unpacked and walked.
BATCH = 4 << 20


@contextmanager
def _settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings for jobs that are started meanwhile; names with __ for dots."""
    held = {k.replace("__", "."): spark.conf.get(k.replace("__", "."), None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k.replace("__", "."), v)
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def small_batches(spark: SparkSession, batch: int = BATCH) -> Iterator[None]:
    """Python workers of jobs that are started meanwhile have batches of ``batch`` bytes."""
    with _settings(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(batch)):
        yield


#: Bytes of tables, as stored, that may be broadcast while whole documents are put together: elements take thirty and more times that in memory.
BROADCAST = 256 << 10


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Jobs that are started meanwhile broadcast tables of ``BROADCAST`` bytes at most, or of what the session allows if that is less."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    most = held if held.startswith("-") else str(min(BROADCAST, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(held)))
    with _settings(spark, spark__sql__autoBroadcastJoinThreshold=most, spark__sql__adaptive__autoBroadcastJoinThreshold=most):
        yield


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Files that jobs shuffle by, started meanwhile, go when their query has ended, not when the driver happens to collect garbage."""
    with _settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        yield


#: How tables with bytes in rows (archives) are written: readers hold 4096 rows of a row group at once, whatever these weigh, so a row group has ``BATCH`` bytes, about.
#: They are counted before compression, for pages are larger than that: they close with the row group.
GROUPS = {"parquet.block.size": BATCH, "parquet.page.size": 2 * BATCH, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 16}


def save(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write df to a folder by columns; rows that hold bytes in groups that tasks can hold when they read them."""
    heavy = any(isinstance(f.dataType, BinaryType) for f in df.schema)
    df.write.mode(mode).options(**(GROUPS if heavy else {})).parquet(path)


def written(df: DataFrame, batch: int | None = BATCH) -> DataFrame:
    """df, written to the shared checkpoint folder by columns: whoever reads it later reads what they ask for.

    Python workers of its plan have batches of ``batch`` bytes (None: as the session has it): what they hold doesn't grow with the table, nor does
    what readers hold of it (``save``).
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4()}"
    with _settings(spark, **({} if batch is None else {"spark__sql__execution__arrow__maxBytesPerBatch": str(batch)})):
        save(df, path)
    return spark.read.schema(df.schema).parquet(path)
