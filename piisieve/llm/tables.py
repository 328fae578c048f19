"""Intermediate tables in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import scratch_path


#: Spark's switch for removing an execution's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write the rows as Parquet under the shared checkpoint folder and read them back: lineage is cut,
    executors may be lost, and later readers prune columns. ``release`` removes the shuffle files of the
    write once it has ended, not when the driver's garbage collector comes to them; nothing reads them again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP) if release else None
    if release:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if release:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
