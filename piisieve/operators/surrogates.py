"""Surrogates by type, one-to-one while the pool lasts.

Every distinct value of a type gets a dense index, and a keyed permutation of the type's pool turns the
index into a pool entry. So values of a type share no entry until there are more values than entries; the
next value then starts over with another permutation. The permutation is a Feistel network over the
smallest grid of rows and columns that holds the pool; a place outside the pool is sent on until it
falls inside (cycle walking), which takes at most one step more than there are places outside.

Without the salt nobody can tell which value an entry stands for. To keep surrogates from one run to the
next, store the assignment and give it as ``known``: its values keep their index and new ones follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash32
from .indexing import with_row_index

ROUNDS = 4


def permuted(place: Column, size: Column, *key: Column) -> Column:
    """The keyed permutation of 0..size-1 at ``place`` (longs)."""
    rows = F.ceil(F.sqrt(size)).cast("long")
    columns = F.ceil(size / rows).cast("long")

    def step(x: Column) -> Column:
        left, right = F.floor(x / columns).cast("long"), F.pmod(x, columns)
        for r in range(1, ROUNDS + 1, 2):
            left = F.pmod(left + hash32(*key, F.lit(r), right), rows)
            right = F.pmod(right + hash32(*key, F.lit(r + 1), left), columns)
        return left * columns + right

    outside = (rows * columns - size).cast("int")
    return F.aggregate(F.sequence(F.lit(0), outside), step(place), lambda x, _: F.when(x < size, x).otherwise(step(x)))


def surrogate_index(values: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(entity_type, value, index): the distinct values of each type numbered from 0 in order of value, after
    those of ``known`` (entity_type, value, index), which keep their numbers."""
    found = values.select("entity_type", "value").filter("entity_type IS NOT NULL AND value IS NOT NULL").distinct()
    if known is not None:
        found = found.join(known, ["entity_type", "value"], "left_anti")
    ranked = with_row_index(found, ["entity_type", "value"], "place")
    starts = ranked.groupBy("entity_type").agg(F.min("place").alias("start"))  # one row per type
    if known is not None:
        used = known.groupBy("entity_type").agg((F.max("index") + 1).alias("used"))
        starts = starts.join(used, "entity_type", "left")
    else:
        starts = starts.withColumn("used", F.lit(0).cast("long"))
    new = ranked.join(F.broadcast(starts), "entity_type").select(
        "entity_type", "value", (F.col("place") - F.col("start") + F.coalesce("used", F.lit(0).cast("long"))).alias("index"))
    return new if known is None else known.select("entity_type", "value", "index").unionByName(new)


def assign_surrogates(values: DataFrame, pool: DataFrame, salt: str, known: DataFrame | None = None) -> DataFrame:
    """(entity_type, value, index, surrogate) for each distinct value of (entity_type, value).

    ``pool`` is (entity_type, idx, value) with idx dense from 0 in each type; a type without a pool raises. Pool
    and values meet in one join on (type, place), so neither has to fit into one task.
    """
    sizes = pool.groupBy("entity_type").agg(F.count("*").alias("size"), F.countDistinct("idx").alias("places"),
                                            F.max("idx").cast("long").alias("last"))
    broken = [r["entity_type"] for r in sizes.filter("places <> size OR last <> size - 1").limit(3).collect()]
    if broken:
        raise ValueError(f"idx is not dense from 0 in the pool of {broken}")
    index = surrogate_index(values, known)
    lost = [r["entity_type"] for r in index.select("entity_type").distinct().join(sizes, "entity_type", "left_anti").limit(3).collect()]
    if lost:
        raise ValueError(f"no surrogate pool for {lost}")
    cycle = F.floor(F.col("index") / F.col("size")).cast("long")
    sized = index.join(F.broadcast(sizes.select("entity_type", "size")), "entity_type")  # one row per type
    place = permuted(F.pmod("index", "size"), F.col("size"), F.lit(salt), F.col("entity_type"), cycle)
    entries = pool.select("entity_type", F.col("idx").cast("long").alias("place"), F.col("value").alias("surrogate"))
    return sized.withColumn("place", place).join(entries, ["entity_type", "place"]).select("entity_type", "value", "index", "surrogate")
