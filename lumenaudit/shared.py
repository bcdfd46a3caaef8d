"""Tables that are written on the way, in a folder that the driver and all executors see."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Without one, a local session uses its warehouse; on a cluster that may be
    a folder of the driver's machine, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows of df, written as Parquet into the shared folder and read again: computed once, and no lineage before it.

    rows: narrow rows that there are at most; they come in files of some 200,000, not in one per task.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    (df if rows is None else df.coalesce(8 + rows // 200_000)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by `written` that nothing will read any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_written", None)
        if path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
