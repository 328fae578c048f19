"""Plain text -> essay table D1 (S3), leading-space pieces (P2/P3), word offsets and rebuild.

Everything is computed inside the document row with array expressions: no shuffle, and the
work for one document is bounded by the size of that one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Only space and newline separate words (avoid \s: Java and RE2 disagree on \x0B).
WORD_SEPARATOR = "[ \n]+"


def tokenise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """S3: text -> (document, full_text, tokens, trailing_whitespace, separators).

    ``tokens`` keeps empty strings (leading/trailing separators), ``separators[i]`` is the exact
    whitespace after ``tokens[i]`` so the text can be rebuilt byte for byte.
    """
    text = F.col(text_col)
    tokens = F.split(text, WORD_SEPARATOR, -1)
    seps = F.regexp_extract_all(text, F.lit("([ \n]+)"), 1)
    out = df.select(
        F.col(id_col).cast("long").alias("document"),
        text.alias("full_text"),
        tokens.alias("tokens"),
        seps.alias("separators"),
        *keep,
    )
    # every token but the last is followed by a separator (no lambda: nothing to re-evaluate)
    return out.withColumn("trailing_whitespace", F.concat(
        F.array_repeat(F.lit(True), F.size("separators")), F.array(F.lit(False))))


def leading_space_tokens(df: DataFrame, mode: str = "leading", tokens: str = "tokens",
                         trailing: str = "trailing_whitespace", out: str = "input_tokens") -> DataFrame:
    """Prefix ' ' to a token when the previous token had trailing whitespace.

    ``mode='none'`` is the variant that never prefixes.
    """
    if mode == "none":
        return df.withColumn(out, F.col(tokens))
    if mode != "leading":
        raise ValueError("mode must be 'leading' or 'none'")
    # zip the previous flag in as an argument of the higher-order function: arguments are
    # evaluated once per row, whereas a column looked up inside the lambda may be inlined and
    # rebuilt for every element
    prev = F.concat(F.array(F.lit(False)), F.slice(F.col(trailing), 1, F.greatest(F.size(tokens) - 1, F.lit(0))))
    z = F.arrays_zip(F.col(tokens).alias("t"), prev.alias("lead"))
    return df.withColumn(out, F.transform(z, lambda e: F.when(
        F.coalesce(e["lead"], F.lit(False)), F.concat(F.lit(" "), e["t"])).otherwise(e["t"])))


def explode_words(df: DataFrame, cols: tuple[str, ...] = ("document",), with_labels: bool = False,
                  with_offsets: bool = False) -> DataFrame:
    """One row per word: (document, token, word[, label][, start, end]).

    ``token`` is the 0-based word position, the key every later join uses.
    """
    fields = [F.col("tokens").alias("word")]
    zipped = ["tokens"]
    if with_labels:
        zipped.append("labels")
    if with_offsets:
        zipped.append("word_starts")
    z = F.arrays_zip(*[F.col(c) for c in zipped])
    out = df.select(*cols, F.posexplode_outer(z).alias("token", "z")).filter(F.col("token").isNotNull())
    sel = [*cols, "token", F.col("z.tokens").alias("word")]
    if with_labels:
        sel.append(F.col("z.labels").alias("label"))
    if with_offsets:
        sel.append(F.col("z.word_starts").alias("start"))
        sel.append((F.col("z.word_starts") + F.length(F.col("z.tokens"))).alias("end"))
    return out.select(*sel)


def _cumsum_series(s: pd.Series) -> pd.Series:
    """Exclusive prefix sums of each array: one cumulative sum over the whole batch, cut at the rows."""
    present = s.notna()
    arrays = [np.asarray(a, dtype=np.int64) for a in s[present]]
    sizes = np.array([len(a) for a in arrays], dtype=np.int64)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    before = np.cumsum(flat) - flat
    ends = np.cumsum(sizes)
    starts = ends - sizes
    first = np.zeros(len(sizes), dtype=np.int64)
    first[sizes > 0] = before[starts[sizes > 0]]
    before -= np.repeat(first, sizes)
    out = pd.Series([None] * len(s), index=s.index, dtype=object)
    out[present] = pd.Series([before[a:b] for a, b in zip(starts, ends)], index=s.index[present], dtype=object)
    return out


_CUMSUM_UDF = []


def _exclusive_cumsum(lengths: Column) -> Column:
    """Exclusive prefix sums of an int array, vectorised per Arrow batch (numpy inside the task)."""
    if not _CUMSUM_UDF:
        from pyspark.sql import SparkSession

        from ..session import ship_package
        active = SparkSession.getActiveSession()
        if active is not None:
            ship_package(active)
        _CUMSUM_UDF.append(F.pandas_udf(_cumsum_series, "array<long>"))
    return _CUMSUM_UDF[0](lengths)


def word_offsets(df: DataFrame) -> DataFrame:
    """Character start of every word, from token and separator lengths.

    Offsets count code points (Spark ``length``), so they index ``full_text`` directly.
    """
    z = F.arrays_zip(F.col("tokens").alias("t"), F.col("separators").alias("sep"))
    lengths = F.transform(z, lambda e: F.length(e["t"]) + F.coalesce(F.length(e["sep"]), F.lit(0)))
    return df.withColumn("word_starts", _exclusive_cumsum(lengths))


def rebuild_text(df: DataFrame, out: str = "rebuilt_text") -> DataFrame:
    """Concatenate tokens and their separators (or one space per trailing flag)."""
    if "separators" in df.columns:
        z = F.arrays_zip(F.col("tokens").alias("t"), F.col("separators").alias("sep"))
        pieces = F.transform(z, lambda e: F.concat(e["t"], F.coalesce(e["sep"], F.lit(""))))
    else:
        z = F.arrays_zip(F.col("tokens").alias("t"), F.col("trailing_whitespace").alias("ws"))
        pieces = F.transform(z, lambda e: F.concat(
            e["t"], F.when(F.coalesce(e["ws"], F.lit(False)), F.lit(" ")).otherwise(F.lit(""))))
    return df.withColumn(out, F.array_join(pieces, ""))
