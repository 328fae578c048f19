"""Global order without a single-partition window (X5), uniqueness checks, range joins.

``with_row_index`` range-partitions by the order key, sorts inside partitions and freezes that
layout with a reliable checkpoint (range bounds come from sampling, so they must not be
recomputed between the count job and the final job). Per-partition totals - one row per
partition, a bound that does not grow with the data - become an array of offsets, from which each row
adds its partition's to its local position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package


def _num_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return int(n)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _local_weight_prefix(weight_col: str, local_col: str):
    """mapInPandas body: exclusive running sum of ``weight_col`` over one sorted partition."""
    def run(batches):
        import numpy as np
        carry = 0
        for pdf in batches:
            w = pdf[weight_col].fillna(0).to_numpy(dtype=np.int64)
            c = np.cumsum(w)
            pdf[local_col] = carry + c - w
            if len(c):
                carry += int(c[-1])
            yield pdf
    return run


def with_row_index(df: DataFrame, order_cols, out: str = "row_index", weight_col: str | None = None,
                   num_partitions: int | None = None, store: str | None = None) -> DataFrame:
    """Add a global 0-based index in ``order_cols`` order (ascending; make the key unique).

    Without ``weight_col`` the index counts rows (dense 0..n-1). With it, the index is the
    exclusive prefix sum of the weights (pass a narrow frame: rows go through Arrow). With ``store`` the layout is
    frozen as Parquet in that new folder, a fraction of a checkpoint's bytes, which the caller deletes when the result
    has been used.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    n = _num_partitions(df, num_partitions)
    keys = [F.col(c) for c in order_cols]
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(
        "_pid", F.spark_partition_id())
    if weight_col is None:
        ranged = ranged.withColumn(
            "_local", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33))
        ranged = ranged.withColumn("_w", F.lit(1).cast("long"))
    else:
        ranged = ranged.withColumn("_w", F.coalesce(F.col(weight_col).cast("long"), F.lit(0).cast("long")))
        from pyspark.sql.types import LongType, StructField, StructType
        schema = StructType([*ranged.schema.fields, StructField("_local", LongType(), True)])
        ranged = ranged.mapInPandas(_local_weight_prefix("_w", "_local"), schema)
    if store is None:
        frozen = ranged.checkpoint(eager=True)
    else:  # each row carries its partition and its place there, however the files are read
        ranged.write.option("compression", "zstd").parquet(store)
        frozen = spark.read.schema(ranged.schema).parquet(store)
    totals = sorted((r["_pid"], r["total"]) for r in
                    frozen.groupBy("_pid").agg(F.sum("_w").alias("total")).collect())
    offsets, acc = [0] * (int(totals[-1][0]) + 1 if totals else 1), 0
    for pid, total in totals:
        offsets[int(pid)] = int(acc)
        acc += int(total or 0)
    # looked up by partition in an array of constants: no worker has to hand a table of them over
    offset = F.get(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("_pid"))
    return frozen.withColumn(out, F.coalesce(offset, F.lit(0)) + F.col("_local")).drop("_pid", "_local", "_w")


def indexed_by_keys(df: DataFrame, order_cols, out: str = "row_index", condition=None,
                    num_partitions: int | None = None) -> DataFrame:
    """``with_row_index`` for wide rows: only the key columns are range-sorted and checkpointed, and the
    index is joined back on them (the keys must be unique and not null). ``condition`` keeps some of the
    index rows before that join."""
    keys = list(order_cols)
    idx = with_row_index(df.select(*keys), keys, out, num_partitions=num_partitions)
    idx = idx if condition is None else idx.filter(condition)
    return idx if set(df.columns) == set(keys) else df.join(idx, keys)


def count_rows(df: DataFrame) -> int:
    return int(df.count())


PARTITION_BYTES = 4 << 20


def by_key(df: DataFrame, key: str, text: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The rows dealt out by ``key`` into partitions of about ``partition_bytes`` bytes of ``text`` (summed in one
    pass before). What is exploded from a text and grouped by the key and more needs no further shuffle, and
    the groups of a partition, some fifty times its text for a vector of doubles per word, fit into a task."""
    size = df.agg(F.sum(F.octet_length(text)).alias("bytes")).first()["bytes"] or 0
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, -(-size // partition_bytes)), key)


def require_unique(df: DataFrame, keys) -> DataFrame:
    """Raise if a key repeats (T5: a repeated document corrupts word numbering)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    dup = df.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate key {tuple(dup[0][k] for k in keys)} in {keys}")
    return df


def range_overlap_join(left: DataFrame, right: DataFrame, keys, l_start: str, l_end: str,
                       r_start: str, r_end: str, bucket: int = 256, how: str = "inner") -> DataFrame:
    """Pairs whose half-open ranges overlap on equal ``keys`` (range join by bucketing).

    Each side is exploded into the fixed-size buckets its range touches and joined on
    (keys, bucket); pairs are kept once, in the bucket holding the later of the two starts.
    Candidates per bucket are bounded by the rows touching that bucket, not by the key.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)

    def buckets(df, s, e, name):
        lo = F.floor(F.col(s) / F.lit(bucket)).cast("long")
        hi = F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / F.lit(bucket)).cast("long")
        return df.withColumn(name, F.explode(F.sequence(lo, hi)))

    # unique names on both sides: either may stem from the other
    lb = buckets(left, l_start, l_end, "_bk")
    rb = buckets(right, r_start, r_end, "_r_bk").withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = [F.col(k) == F.col(f"_r_{k}") for k in keys] + [F.col("_bk") == F.col("_r_bk")]
    j = lb.join(rb, cond, how)
    overlap = (F.col(l_start) < F.col(r_end)) & (F.col(r_start) < F.col(l_end))
    owner = F.floor(F.greatest(l_start, r_start) / F.lit(bucket)).cast("long") == F.col("_bk")
    return j.filter(overlap & owner).drop("_bk", "_r_bk", *[f"_r_{k}" for k in keys])
