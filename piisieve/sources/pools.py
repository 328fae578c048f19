"""Value pools / gazetteers (S7): (entity_type, idx, value) tables for detection and surrogates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A small own pool for tests and examples (not the reference's lists).
DEMO_POOLS = {
    "EMAIL_DOMAIN": ["example.com", "example.org", "example.net", "mail.test"],
    "STREET_ADDRESS": ["1 Main Street", "22 Oak Avenue", "305 Elm Road", "48 Pine Lane"],
    "NAME_STUDENT": ["Alex Doe", "Sam Roe", "Kim Poe", "Lee Moe"],
}


def value_pool(spark: SparkSession, pools: dict | None = None) -> DataFrame:
    """Pool from user lists: one row per value, idx dense per type in list order."""
    pools = pools or DEMO_POOLS
    rows = [(t, i, v) for t, vals in pools.items() for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "entity_type string, idx int, value string")


def pool_from_table(df: DataFrame, entity_type: str, col: str) -> DataFrame:
    """Pool from a column of a table: distinct values, idx dense in value order (pools are small
    dictionaries; broadcasts of them are size-checked by the callers)."""
    from ..operators.indexing import with_row_index
    d = df.select(F.col(col).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
    return with_row_index(d, ["value"], "idx").select(F.lit(entity_type).alias("entity_type"), "idx", "value")
