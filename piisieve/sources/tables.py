"""Table readers with column pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Session setting: at least so many tasks for scans of text tables. Unset by default: tables are read as
#: Spark splits them. Local runs over a single small file set it; a table of many files never needs it.
MIN_TASKS = "spark.piisieve.scan.minTasks"


def read_table(spark: SparkSession, path: str, *cols: str, min_tasks: int | None = None) -> DataFrame:
    """The pruned columns of one table; ``min_tasks`` deals the rows out to so many tasks (a shuffle)."""
    df = spark.read.parquet(path)
    if cols:
        df = df.select(*cols)
    return df.repartition(min_tasks) if min_tasks else df
