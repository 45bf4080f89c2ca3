"""Tables written to the folder that the cluster shares, so that a lost executor costs one task and not a lineage."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and all its tasks run in the driver's process, as in tests.
LOCAL_ROOT = "file:///tmp/checkpoints/pagewright"

#: Names of columns that operators add while they work; inputs may not use this prefix.
ROW = "_pw_row"


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session: spark.checkpoint.dir, else the context's; LOCAL_ROOT in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_ROOT)
        named = LOCAL_ROOT
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the context has already stopped: nothing is left to ask
        return


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back.

    The written table cuts the lineage and fixes row order within each file, so every later pass sees the same rows
    even if the source would be read in another order. It is removed by free(), else when the driver process ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/pagewright-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    held = spark.read.schema(df.schema).parquet(path)
    held._pw_path = path
    return held


def is_staged(df: DataFrame) -> bool:
    """Whether df is a table as stage() gave it."""
    return hasattr(df, "_pw_path")


def free(*tables: DataFrame) -> None:
    """Remove tables from stage() that nothing will read any more."""
    for table in tables:
        _remove(table.sparkSession, table._pw_path)


def stage_rows(df: DataFrame, name: str) -> DataFrame:
    """stage() with a row number ROW that is unique in the table and stays the same in every later pass."""
    return stage(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def power_of_two(n: float) -> int:
    """The smallest power of two that is at least n, 1 or more."""
    return 1 << max(0, int(-(-max(n, 1) // 1) - 1).bit_length())
