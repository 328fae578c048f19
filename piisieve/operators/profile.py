"""PII profile (R10): entities and affected documents by type and source, with totals.

``pii_profile`` counts exactly. ``profile_sketches`` keeps a count and a HyperLogLog sketch of the document ids for
each (type, source) instead; ``write_profile`` stores them by day and ``read_profile`` merges any days, so a new
day costs a scan of that day alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: log2 of a sketch's registers: at most 16 KiB a sketch. Below 1,500 documents it holds the ids' hashes themselves.
LG_REGISTERS = 14


def standard_error(lg_registers: int = LG_REGISTERS) -> float:
    """Relative standard error of a merged sketch above the sizes at which it is still a list of hashes."""
    return 1.04 / 2 ** (lg_registers / 2)


def pii_profile(matches: DataFrame, doc: str = "doc_id", source: str = "source") -> DataFrame:
    """Counts by (type, source) with rollup totals; ``matches`` carries the source of its document, so
    nothing is joined and partial aggregation comes before the shuffle."""
    return matches.rollup("type", source).agg(F.count(F.lit(1)).alias("n_entities"),
                                              F.countDistinct(doc).alias("n_documents"))


def profile_sketches(matches: DataFrame, doc: str = "doc_id", source: str = "source",
                     lg_registers: int = LG_REGISTERS) -> DataFrame:
    """(type, source, n_entities, documents): one row a group with the sketch of its document ids.

    A group's sketch is built where its rows are and only sketches are shuffled, so neither a hot group
    nor the number of documents makes a large state. A null id counts as an entity without a document."""
    return matches.groupBy("type", F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_entities"), F.hll_sketch_agg(F.col(doc).cast("string"), lg_registers).alias("documents"))


def write_profile(matches: DataFrame, path: str, day: str, doc: str = "doc_id", source: str = "source",
                  lg_registers: int = LG_REGISTERS) -> None:
    """Store the sketches of one day's matches under ``path``; writing a day again replaces it alone."""
    rows = profile_sketches(matches, doc, source, lg_registers)
    # a day's rows are as many as its (type, source) groups: one file
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/day={day}")


def read_profile(spark: SparkSession, path: str, days=None) -> DataFrame:
    """The profile of all stored days, or of ``days``: type, source, level, n_entities, n_documents with rollup totals.

    ``level`` tells a total from a group whose source is null: 0 for a group, 1 for a type, 3 for everything.

    Entities are exact sums. Documents are distinct over all days that a group or total covers, by merged
    sketches, within ``standard_error``; an id that comes again on another day counts once. The rollup
    expands stored rows (types x sources x days), not matches."""
    stored = spark.read.option("basePath", path).schema("type string, source string, n_entities long, documents binary, day string").parquet(path)
    stored = stored if days is None else stored.filter(F.col("day").isin(list(days)))
    return stored.rollup("type", "source").agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n_entities").alias("n_entities"),
        F.hll_sketch_estimate(F.hll_union_agg("documents")).alias("n_documents"))
