"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree. DataFrame functions only.

*Targets.* Sources by code point (null last) weigh ``weights`` in turn and share all words. A target
stops at ``max_repeat`` times its source's size; the excess is shared again by weight until no target
is above. The closed form sorts sources by the level at which they fill up.

*Blocks.* A source's documents fall into ``blocks`` blocks by a hash. Every full multiple of the source
takes all its blocks once; what is left of the target takes blocks in a permuted order, and inside
the one block where it ends whole documents in a permuted order, up to the nearest document end.
Then one document per source and round (``corrections``) joins or leaves to come nearer the target.

*Splitting tree.* The blocks taken (copies count as blocks of their own) are dealt to the output
shards from the top: at each node the numbers of blocks per source that go left are a
multivariate-hypergeometric draw for half the node's places, drawn source by source through the
inverse distribution function with a uniform number hashed from (seed, node, source). The counts of
all shards add up exactly to the quotas. Shards then take disjoint runs of each source's permuted
blocks and are shuffled inside by a hash.

A source holding a third of all rows is spread over its blocks; only block totals and source totals
(bounded by sources times blocks) meet in one place; more than ``max_sources`` sources are refused.
No document is cut.

Defined results: null text has size 0 and is never taken; a null source is a source of its own (last);
an empty table, or one without words, takes nothing; repeated rows and null ids are documents of
their own; reruns give the same mix (hashes of id, text and seed); extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored


@dataclass(frozen=True)
class MixSettings:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    max_repeat: int = 3
    blocks: int = 512
    tree_levels: int = 4  # 2 ** tree_levels output shards
    corrections: int = 2
    max_sources: int = 10_000
    seed: int = 17


def _unit(*parts) -> Column:
    """Uniform number in (0, 1) hashed from the parts."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) + F.lit(0.5)) / float(1 << 40)


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def document_hash(key: str, text: str, seed: int = MixSettings.seed) -> Column:
    """Tells documents apart; repeated rows share it."""
    return F.xxhash64(F.col(key).cast("string"), F.col(text), F.lit(seed))


def source_targets(sizes: DataFrame, s: MixSettings = MixSettings()) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source, all in one place.

    A source is full at water level ``max_repeat * size / weight``. With sources sorted by that level, the
    common level of the others is (all words - what the full ones take) / (weight of the others); the
    first sorted source that lies above it, and all after it, are not full.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(s.weights)))
    weight = F.element_at(F.array(*map(F.lit, s.weights)), (turn + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", s.max_repeat * F.col("source_size").cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_level.rowsBetween(0, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / F.sum("weight").over(onwards))
    rows = rows.withColumn("level", level).withColumn("open", F.col("level") <= F.col("cap") / F.col("weight"))
    # the first open source in that order; sources that fill up at one level are told apart by their names
    first_open = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(whole)
    rows = rows.withColumn("common", first_open["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("common") * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def _blocks_taken(docs: DataFrame, targets: DataFrame, s: MixSettings) -> DataFrame:
    """Blocks with words: source, block, words, place (in the source's permuted order), source_size, target,
    full (times the whole source is taken) and rest (words still missing where the block begins)."""
    sums = docs.groupBy("source", "block").agg(F.sum("size").alias("words")).filter("words > 0")
    joined = sums.join(targets, sums["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(s.seed), "block", F.lit("order")), "block")
    full = F.floor(F.col("target") / F.col("source_size")).cast("int")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return joined.select("source", "block", "words", full.alias("full"),
                         (F.col("target") - full * F.col("source_size") - before).alias("rest"),
                         F.row_number().over(order).alias("place"))


def _log_factorial(n: Column) -> Column:
    """ln n!: exact below 16, then Stirling's series (error under 1e-12)."""
    x = n.cast("double") + 1
    small = F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)]), n.cast("int") + 1)
    series = ((x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
              + 1 / (1260 * x * x * x * x * x))
    return F.when(n < 16, small).otherwise(series)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` places out of ``total`` are among the ``marked``: the inverse distribution
    function at ``u``, summed over the support inside one row."""
    low = F.greatest(F.lit(0), drawn + marked - total)
    high = F.least(marked, drawn)
    base = _log_choose(total, drawn)
    start = F.struct(F.lit(0.0).cast("double").alias("sum"), F.lit(None).cast("int").alias("k"))

    def step(acc: Column, k: Column) -> Column:
        p = F.exp(_log_choose(marked, k) + _log_choose(total - marked, drawn - k) - base)
        return F.when(acc["k"].isNotNull(), acc).otherwise(
            F.struct((acc["sum"] + p).alias("sum"), F.when(acc["sum"] + p >= u, k).alias("k")))

    return F.aggregate(F.sequence(low, high), start, step, lambda acc: F.coalesce(acc["k"], high))


def split_quotas(quotas: DataFrame, s: MixSettings = MixSettings()) -> DataFrame:
    """(shard, source, first, blocks): how many blocks of each source every shard gets and the first one's
    place (from 1), from (source, blocks).

    A node's row holds one number per source. Going down a level, the sources are drawn one after the
    other: each takes a hypergeometric part of the places still open on the left side.
    """
    node = quotas.filter("blocks > 0").agg(F.array_sort(F.collect_list(
        F.struct(F.struct(F.col("source").isNull().alias("last"), "source").alias("source"),
                 F.col("blocks").cast("int").alias("n")))).alias("parts")).select(F.lit(0).alias("shard"), "parts")
    for level in range(s.tree_levels):
        sizes = node.withColumn("total", F.aggregate("parts", F.lit(0), lambda a, p: a + p["n"]))
        seeded = sizes.withColumn("parts", F.transform("parts", lambda p: F.struct(
            p["source"].alias("source"), p["n"].alias("n"),
            _unit(F.lit(s.seed), F.lit(level), F.col("shard"), p["source"]["source"]).alias("u"))))
        start = F.struct(F.col("total").alias("total"), F.ceil(F.col("total") / 2).cast("int").alias("open"),
                         F.array().cast("array<int>").alias("left"))

        def draw(acc: Column, p: Column) -> Column:
            k = hypergeometric(acc["total"], p["n"], acc["open"], p["u"])
            return F.transform(F.array(k), lambda v: F.struct(
                (acc["total"] - p["n"]).alias("total"), (acc["open"] - v).alias("open"),
                F.concat(acc["left"], F.array(v)).alias("left")))[0]

        drawn = seeded.withColumn("left", F.aggregate("parts", start, draw, lambda acc: acc["left"]))
        both = F.arrays_zip("parts", "left")

        def side(number: Column, count) -> Column:
            return F.struct(number.alias("shard"), F.transform(both, lambda b: F.struct(
                b["parts"]["source"].alias("source"), count(b).alias("n"))).alias("parts"))

        node = drawn.select(F.inline(F.array(
            side(2 * F.col("shard"), lambda b: b["left"]),
            side(2 * F.col("shard") + 1, lambda b: b["parts"]["n"] - b["left"]))))
    rows = node.select("shard", F.explode("parts").alias("p")).select(
        "shard", F.col("p.source.source").alias("source"), F.col("p.n").alias("blocks"))
    order = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("first", F.coalesce(F.sum("blocks").over(order), F.lit(0)) + 1).filter("blocks > 0")


def _dealt_blocks(blocks: DataFrame, s: MixSettings) -> DataFrame:
    """Blocks with ``shards``: for each time the block is drawn (the partial time last) its shard."""
    times = F.col("full") + F.when(F.col("rest") > 0, 1).otherwise(0)
    per_source = blocks.groupBy("source").agg(F.sum(times).alias("blocks"), F.count("*").alias("parts"))
    runs = split_quotas(per_source, s).groupBy("source").agg(
        F.collect_list(F.struct("shard", "first", "blocks")).alias("runs"), F.max_by("shard", "first").alias("spare"))
    known = per_source.select(F.col("source").alias("s1"), "parts").join(
        runs.withColumnRenamed("source", "s2"), F.col("s1").eqNullSafe(F.col("s2")), "left").drop("s2")
    # the k-th drawing of the block at place p is number k * parts + p of its source
    numbers = F.transform(F.sequence(F.lit(0), times - 1), lambda k: k * F.col("parts") + F.col("place"))
    shards = F.transform(numbers, lambda i: F.filter(
        "runs", lambda r: (r["first"] <= i) & (i < r["first"] + r["blocks"]))[0]["shard"])
    return (blocks.join(known, blocks["source"].eqNullSafe(F.col("s1")))
            .withColumn("shards", F.when(times > 0, shards).otherwise(F.array().cast("array<int>")))
            .drop("s1", "runs", "parts"))


def mix(docs: DataFrame, settings: MixSettings = MixSettings(), key: str = "doc_id", text: str = "text",
        source: str = "source") -> DataFrame:
    """One row per document: doc_id, source, h (document_hash), size, source_size, target, ``draws`` (array of
    shard and position: one for each copy that the mix takes, sort a shard by position) and taken (words)."""
    s = settings
    rows = stored(docs.select(
        F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"),
        document_hash(key, text, s.seed).alias("h"))
        .withColumns({"block": F.pmod(F.col("h"), F.lit(s.blocks)).cast("int"),
                      "row": F.monotonically_increasing_id()}), "sizes")  # row tells repeated rows apart
    sizes = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source_sizes")
    found_sources = sizes.count()
    if found_sources > s.max_sources:
        raise ValueError(f"{found_sources} sources; targets are shared in one place, so at most max_sources = {s.max_sources}")
    targets = stored(source_targets(sizes, s), "targets")
    blocks = stored(_dealt_blocks(stored(_blocks_taken(rows, targets, s), "blocks"), s), "dealt")
    found = rows.join(blocks.withColumnsRenamed({"source": "s1", "block": "b1"}),
                      F.col("source").eqNullSafe(F.col("s1")) & (F.col("block") == F.col("b1")), "left").drop("s1", "b1")
    ends = (F.col("rest") > 0) & (F.col("rest") < F.col("words"))  # the block where its source's target ends
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("h", F.lit("inside")), "row")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    missing = F.col("rest") - (F.col("upto") - F.col("size"))
    last = found.filter(ends).withColumn("upto", upto).withColumn(  # up to the document end nearest to the target
        "shards", F.when(F.col("upto") - F.col("rest") <= F.greatest(F.lit(0.0), missing), F.col("shards"))
        .otherwise(F.slice("shards", F.lit(1), F.col("full")))).drop("upto")
    taken = found.filter(~F.coalesce(ends, F.lit(False))).unionByName(last)
    shards = F.when((F.col("size") == 0) | F.col("shards").isNull(), F.array().cast("array<int>")).otherwise(F.col("shards"))
    chosen = taken.select("row", "doc_id", "source", "size", "h", "full", "spare", shards.alias("shards"))
    for _ in range(s.corrections):
        chosen = _corrected(stored(chosen, "chosen"), targets)
    draws = F.transform("shards", lambda shard, i: F.struct(
        shard.alias("shard"), F.xxhash64("h", i, F.lit("position")).alias("position")))
    return (chosen.join(targets.withColumnRenamed("source", "s1"), F.col("source").eqNullSafe(F.col("s1")))
            .select("doc_id", "source", "h", "size", "source_size", "target", draws.alias("draws"))
            .withColumn("taken", F.col("size") * F.size("draws")))


def _corrected(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """One document per source joins or leaves the mix: the one whose size is nearest to what the source is
    short of or over by, if that brings it nearer to its target."""
    sums = chosen.groupBy("source").agg(F.sum(F.col("size") * F.size("shards")).alias("words"))
    gaps = sums.join(targets.withColumnRenamed("source", "s1"), F.col("source").eqNullSafe(F.col("s1"))).select(
        "s1", (F.col("target") - F.col("words")).alias("gap"))
    extra = F.size("shards") > F.col("full")
    fits = F.when(F.col("gap") > 0, ~extra).otherwise(extra) & (F.col("size") > 0)
    after = F.abs(F.abs(F.col("gap")) - F.col("size"))
    best = (chosen.join(gaps, F.col("source").eqNullSafe(F.col("s1"))).filter(fits & (after < F.abs("gap")))
            .groupBy("source").agg(F.min_by(F.struct("row", "gap"), F.struct(after.alias("after"), "h", "row")).alias("best"))
            .select(F.col("source").alias("s1"), F.col("best.row").alias("best_row"), F.col("best.gap").alias("gap")))
    mine = F.col("row") == F.col("best_row")
    shards = (F.when(mine & (F.col("gap") > 0), F.concat("shards", F.array("spare")))
              .when(mine, F.slice("shards", F.lit(1), F.col("full"))).otherwise(F.col("shards")))
    return (chosen.join(best, F.col("source").eqNullSafe(F.col("s1")), "left").withColumn("shards", shards)
            .drop("s1", "best_row", "gap"))
