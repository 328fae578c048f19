"""Splits, replication, weighted mixtures, prefix samples, shuffles and de-duplication."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import unit_hash
from ..settings import EXTERNAL_FOLD, KEY_FOLDS, POSITION_FOLDS, RANDOM_SEED, RANDOM_VALID_FRACTION
from .indexing import indexed_by_keys


def split_by_position(df: DataFrame, order_cols, k: int = POSITION_FOLDS, fold: int = 0,
                      position: str = "position", num_partitions: int | None = None) -> DataFrame:
    """M1: position in ``order_cols`` order (the file order); valid when position % k == fold."""
    idx = indexed_by_keys(df, order_cols, position, num_partitions=num_partitions)
    return idx.withColumn("split", F.when(F.col(position) % k == fold, "valid").otherwise("train"))


def split_by_key(df: DataFrame, key: str = "document", k: int = KEY_FOLDS, fold: int = 0,
                 all_data: bool = False) -> tuple[DataFrame, DataFrame]:
    """M2 (+M6): valid = key % k == fold; train = the rest, or everything with ``all_data``."""
    is_valid = F.col(key) % k == fold
    valid = df.filter(is_valid)
    train = df if all_data else df.filter(~is_valid)
    return train, valid


def split_random(df: DataFrame, frac: float = RANDOM_VALID_FRACTION, seed: int = RANDOM_SEED, key: str = "document") -> DataFrame:
    """M3: keyed hash split, stable across reruns, retries and partitionings."""
    return df.withColumn("split", F.when(unit_hash(F.col(key), F.lit(seed)) < F.lit(float(frac)), "valid")
                         .otherwise("train"))


FOLD_MODES = ("pre_training", "mixed", "only_comp")


def split_by_folds(df: DataFrame, folds: DataFrame, mode: str, fold: int = 0, all_data: bool = False,
                   key: str = "document") -> tuple[DataFrame, DataFrame]:
    """M4: fold-table split. Train documents by mode; valid = kfold == fold. Left semi joins
    with the fold table (one row per document, so it is joined, not collected)."""
    if mode not in FOLD_MODES:
        raise ValueError(f"invalid training mode {mode!r}")
    kf = F.col("kfold")
    if all_data:
        cond = kf != EXTERNAL_FOLD if mode == "only_comp" else F.lit(True)
    elif mode == "pre_training":
        cond = kf == EXTERNAL_FOLD
    elif mode == "mixed":
        cond = kf != fold
    else:
        cond = (kf != fold) & (kf != EXTERNAL_FOLD)
    f = folds.select(F.col("document").alias(key), "kfold")
    train = df.join(f.filter(cond).select(key), key, "left_semi")
    valid = df.join(f.filter(kf == fold).select(key), key, "left_semi")
    return train, valid


def dedup_first(df: DataFrame, key: str = "document", order: str = "position") -> DataFrame:
    """M5: keep the first row per key by ``order``.

    A min-by aggregate (map-side partial aggregation), so a key repeated across a third of the
    table is combined before the shuffle instead of landing whole in one window task.
    """
    others = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*others), F.col(order)).alias("_first")
    return df.groupBy(key).agg(best).select(key, "_first.*")


def replicate(df: DataFrame, n, copy_col: str = "copy") -> DataFrame:
    """M7: every row n times (n may be a column); n = 0 drops the row."""
    n = F.lit(int(n)) if isinstance(n, int) else F.col(n) if isinstance(n, str) else n
    return df.filter(n > 0).withColumn(copy_col, F.explode(F.sequence(F.lit(1), n)))


def mix(df: DataFrame, sets, weights, set_col: str = "set_name", available=None) -> DataFrame:
    """M8: weighted mixture. ``sets`` and ``weights`` must have equal length; an unknown set name
    fails even at weight 0. Each set is repeated ``weight`` times (broadcast weight table,
    a literal of len(sets) rows)."""
    sets, weights = list(sets), [int(w) for w in weights]
    if len(sets) != len(weights):
        raise ValueError("datamix sets and weights must have the same length")
    if available is None:
        wanted = df.filter(F.col(set_col).isin(sets)).select(set_col).distinct()
        available = [r[0] for r in wanted.collect()]  # the requested names at most
    unknown = [s for s in sets if s not in set(available)]
    if unknown:
        raise KeyError(f"unknown set(s) {unknown}")
    spark = df.sparkSession
    wt = spark.createDataFrame([(s, i, w) for i, (s, w) in enumerate(zip(sets, weights))],
                               f"{set_col} string, set_order int, weight int")
    return replicate(df.join(F.broadcast(wt.filter(F.col("weight") > 0)), set_col), "weight").drop("weight")


def take_prefix(df: DataFrame, frac: float, order_cols, num_partitions: int | None = None) -> DataFrame:
    """M9: the first int(frac * n) rows in ``order_cols`` order (a prefix, not a random sample)."""
    limit = int(math.floor(frac * df.select(*order_cols).count()))
    return indexed_by_keys(df, order_cols, "_pos", F.col("_pos") < limit, num_partitions).drop("_pos")


def shuffle(df: DataFrame, seed: int, key_cols, out: str = "shuffle_pos",
            num_partitions: int | None = None) -> DataFrame:
    """A seeded permutation: order by md5(key | seed), then a dense position."""
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed))))
    keyed = df.withColumn("_h", h)
    return indexed_by_keys(keyed, ["_h", *key_cols], out, num_partitions=num_partitions).drop("_h")
