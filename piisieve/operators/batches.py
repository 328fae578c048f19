"""Length ordering, batching with dynamic padding, padding and mask augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import pad_to, round_up
from ..functions.hashing import unit_hash
from ..functions.labels import IGNORE_ID, SPECIAL_WORD
from ..settings import BATCH_SIZE, PAD_MULTIPLE
from .indexing import with_row_index
from .windows import MASK, PAD


def order_by_length(df: DataFrame, out: str = "order_idx", num_partitions: int | None = None) -> DataFrame:
    """Dense position in (input_length, document, window) order, computed without a
    single-partition window (range partitions + per-partition offsets)."""
    return with_row_index(df, ["input_length", "document", "window"], out, num_partitions=num_partitions)


def length_buckets(df: DataFrame, batch_size: int = BATCH_SIZE, multiple: int = PAD_MULTIPLE,
                   order_col: str = "order_idx") -> DataFrame:
    """Consecutive batches of ``batch_size`` in length order; every batch pads to its
    longest window rounded up to ``multiple``. Batches hold at most batch_size rows, so the
    window below has no hot key."""
    b = df.withColumn("batch_id", F.floor(F.col(order_col) / F.lit(batch_size)).cast("long"))
    w = Window.partitionBy("batch_id")
    b = b.withColumn("padded_len", round_up(F.max("input_length").over(w), multiple))
    if "n_spans" in b.columns or "spans" in b.columns:
        b = b.withColumn("span_len", F.max("n_spans" if "n_spans" in b.columns else F.size("spans")).over(w))
    return b


def pad_arrays(df: DataFrame) -> DataFrame:
    """Pad pieces ([PAD]), attention mask (0), word ids (-1), labels (-100) to padded_len;
    span arrays to span_len with head = padded_len - 2 and tail = padded_len, span labels with -100."""
    L = F.col("padded_len")
    out = (df.withColumn("attention_mask", pad_to(F.array_repeat(F.lit(1), F.size("pieces")), L, 0))
             .withColumn("pieces", pad_to(F.col("pieces"), L, PAD))
             .withColumn("word_ids", pad_to(F.col("word_ids"), L, SPECIAL_WORD)))
    if "label_ids" in df.columns:
        out = out.withColumn("label_ids", pad_to(F.col("label_ids"), L, IGNORE_ID))
    if "spans" in df.columns and "span_len" in df.columns:
        filler = F.struct(F.lit(SPECIAL_WORD).alias("word"), (L - 2).alias("head"), L.alias("tail"))
        out = out.withColumn("spans", F.concat(
            "spans", F.array_repeat(filler, F.greatest(F.col("span_len") - F.size("spans"), F.lit(0)))))
        if "span_label_ids" in df.columns:
            out = out.withColumn("span_label_ids", pad_to(F.col("span_label_ids"), F.col("span_len"), IGNORE_ID))
    return out


def mask_augment(df: DataFrame, p: float, seed: int, mask_token: str = MASK) -> DataFrame:
    """Replace each non-special piece by the mask piece with probability ``p``.

    The draw is a hash of (document, window, position, seed), so reruns and retries agree.
    """
    z = F.arrays_zip(F.col("pieces").alias("t"), F.col("word_ids").alias("w"))
    return df.withColumn("pieces", F.transform(z, lambda e, i: F.when(
        (e["w"] != F.lit(SPECIAL_WORD))
        & (unit_hash(F.col("document"), F.col("window"), i, F.lit(seed)) < F.lit(float(p))),
        F.lit(mask_token)).otherwise(e["t"])))
