"""Sub-word pieces, overlapping windows, label alignment and word spans.

A document is one row; its windows are produced by ``explode(sequence(...))`` plus ``slice`` in
the same stage, so windowing never shuffles and the work per document is linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import IGNORE_ID, SPECIAL_WORD, label_to_id_map
from ..settings import MAX_LENGTH, STRIDE

# Default piece rule: letter runs, digit runs, or one other character, each with an optional
# leading space (so a leading-space token keeps its space on its first piece).
PIECE_PATTERN = " ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9 ]"
CLS, SEP, PAD, MASK = "[CLS]", "[SEP]", "[PAD]", "[MASK]"


def _range0(n: Column) -> Column:
    """0..n-1 as an int array; empty when n <= 0 (Spark's sequence(0, -1) would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _label_ids_per_word(labels: Column, taxonomy) -> Column:
    m = label_to_id_map(taxonomy)
    return F.transform(labels, lambda lab: F.coalesce(m[lab], F.lit(IGNORE_ID)))


def split_pieces(df: DataFrame, tokens: str = "input_tokens", pattern: str = PIECE_PATTERN,
                 taxonomy=None, word_labels: str = "labels") -> DataFrame:
    """W1 (+W6): split every word into pieces, keeping the index of the word each piece came from.

    Words that yield no piece (empty strings) get no piece, as with a sub-word tokenizer. With a
    ``taxonomy`` the word labels are aligned at the same time (every piece inherits its word's
    id, unknown labels -100), zipped per word so no lambda looks anything up by index.
    """
    per_word = F.transform(tokens, lambda w: F.regexp_extract_all(w, F.lit(pattern), 0))
    out = (df.withColumn("_pw", per_word)
             .withColumn("pieces", F.flatten("_pw"))
             .withColumn("word_ids", F.flatten(F.transform("_pw", lambda ps, i: F.array_repeat(i, F.size(ps))))))
    if taxonomy is not None:
        z = F.arrays_zip(F.col("_pw").alias("ps"), _label_ids_per_word(F.col(word_labels), taxonomy).alias("y"))
        out = out.withColumn("label_ids", F.flatten(F.transform(z, lambda e: F.array_repeat(
            F.coalesce(e["y"], F.lit(IGNORE_ID)), F.size(e["ps"])))))
    return out.drop("_pw")


def words_as_pieces(df: DataFrame, tokens: str = "tokens", taxonomy=None, word_labels: str = "labels") -> DataFrame:
    """Treat every word as one piece (word-level windows), optionally with aligned label ids."""
    out = (df.withColumn("pieces", F.col(tokens))
             .withColumn("word_ids", _range0(F.size(tokens))))
    if taxonomy is not None:
        out = out.withColumn("label_ids", _label_ids_per_word(F.col(word_labels), taxonomy))
    return out


def window_count(n: Column, cap: int, step: int) -> Column:
    return F.lit(1) + F.greatest(F.lit(0), F.ceil((n - F.lit(cap)) / F.lit(float(step))).cast("int"))


def window(df: DataFrame, max_length: int = MAX_LENGTH, stride: int = STRIDE, n_special: int = 2,
           keep: tuple[str, ...] = ("document",), sliced: dict | None = None) -> DataFrame:
    """Overlapping windows of ``max_length`` pieces, ``stride`` pieces shared by neighbours.

    The special pieces count against ``max_length``: cap = max_length - n_special content pieces,
    step = cap - stride. Output: keep + (window, start, pieces, word_ids, input_length).
    """
    if n_special not in (0, 1, 2):
        raise ValueError("n_special must be 0, 1 or 2")
    cap = max_length - n_special
    step = cap - stride
    if cap <= 0 or stride < 0 or step <= 0:
        raise ValueError("need max_length > n_special and 0 <= stride < max_length - n_special")
    arrays = {"pieces": CLS, "word_ids": SPECIAL_WORD, **(sliced or {})}
    n = F.size("pieces")
    w = df.select(*keep, *arrays,
                  F.explode(F.sequence(F.lit(0), window_count(n, cap, step) - 1)).alias("window"))
    start = F.col("window") * F.lit(step)
    bodies = []
    for name, special in arrays.items():
        body = F.slice(name, start + 1, cap)
        end_special = SEP if name == "pieces" else special
        if n_special == 2:
            body = F.concat(F.array(F.lit(special)), body, F.array(F.lit(end_special)))
        elif n_special == 1:
            body = F.concat(F.array(F.lit(special)), body)
        bodies.append(body.alias(name))
    return (w.select(*keep, "window", start.alias("start"), *bodies)
             .withColumn("input_length", F.size("pieces")))


def window_word_membership(df: DataFrame, cap: int, step: int, n_col: str = "n_words",
                           pos_col: str = "token") -> DataFrame:
    """For word-level windows (no specials): explode every word into the 1..k windows holding it.

    Word t lies in window w iff w*step <= t < w*step + cap; same law as ``window``.
    """
    t = F.col(pos_col)
    last = window_count(F.col(n_col), cap, step) - 1
    lo = F.greatest(F.lit(0), (F.floor((t - F.lit(cap)) / F.lit(float(step))) + 1).cast("int"))
    hi = F.least(last, F.floor(t / F.lit(float(step))).cast("int"))
    return df.withColumn("window", F.explode(F.sequence(lo, hi)))


def align_labels(df: DataFrame, taxonomy="bio13", word_labels: str = "labels", out: str = "label_ids") -> DataFrame:
    """W6 for arbitrary (word_ids, labels) rows: each piece inherits its word's label id;
    specials and unknown labels get -100.

    The lambda looks labels up by word id, so pass ``labels`` as a stored or joined column;
    when pieces are built from words, ``split_pieces(..., taxonomy=...)`` aligns by zipping.
    """
    m = label_to_id_map(taxonomy)
    return df.withColumn(out, F.transform("word_ids", lambda w: F.when(
        w == F.lit(SPECIAL_WORD), F.lit(IGNORE_ID)).otherwise(
        F.coalesce(m[F.try_element_at(F.col(word_labels), w + 1)], F.lit(IGNORE_ID)))))


def _runs(word_ids):
    """Word id arrays (Arrow) -> their runs of real words as (word, head, tail): ``word_spans`` in numpy."""
    import numpy as np
    import pyarrow as pa

    sizes = word_ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = word_ids.flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False)  # an unknown word equals no other and forms no span
    ids = flat.fill_null(SPECIAL_WORD).to_numpy(zero_copy_only=False)
    first = np.zeros(len(ids), dtype=bool)
    first[1:] = (ids[1:] != ids[:-1]) | ~known[1:] | ~known[:-1]
    first[starts[sizes > 0]] = True
    head = np.flatnonzero(first)
    tail = np.append(head[1:], len(ids))[:len(head)]
    row = np.repeat(np.arange(len(sizes)), sizes)[head]
    real = ids[head] != SPECIAL_WORD
    head, tail, row = head[real], tail[real], row[real]
    ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(sizes)))).astype(np.int32)
    span = [pa.array(x.astype(np.int32)) for x in (ids[head], head - starts[row], tail - starts[row])]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(span, ["word", "head", "tail"]), mask=word_ids.is_null())


def _with_runs(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, _runs(b.column("word_ids"))], names=[*b.schema.names, "spans"])


def word_spans(df: DataFrame, reference_rule: bool = False, vectorised: bool = False) -> DataFrame:
    """Maximal runs of equal word id -> spans [head, tail) with their word id.

    Default: every run of a real word (specials never form spans). ``reference_rule=True``
    reproduces the old rule: runs start at position 1 and the last run is never emitted (T8).
    Arrays are zipped as arguments (index, word id, previous word id), so the work is linear. ``vectorised`` finds the
    default rule's runs in numpy, a batch of windows at a time: lambdas are interpreted, at some microsecond a piece. All
    columns of ``df`` go through the Python worker, so select the narrow ones before.
    """
    if vectorised and reference_rule:
        raise ValueError("vectorised spans follow the default rule")
    wid = F.col("word_ids")
    if vectorised:
        from pyspark.sql.types import StructType

        from ..session import ship_package
        ship_package(df.sparkSession)
        df = df.drop("spans")
        spans = StructType.fromDDL("spans array<struct<word:int,head:int,tail:int>>")
        return df.mapInArrow(_with_runs, StructType([*df.schema.fields, *spans.fields]))
    n = F.size(wid)
    first = 1 if reference_rule else 0
    prev = F.concat(F.array(F.lit(None).cast("int")), F.slice(wid, 1, F.greatest(n - 1, F.lit(0))))
    z = F.arrays_zip(_range0(n).alias("i"), wid.alias("w"), prev.alias("pw"))
    changes = F.filter(z, lambda e: (e["i"] >= F.lit(first)) & (
        (e["i"] == F.lit(first)) | ~F.coalesce(e["w"] == e["pw"], F.lit(False))))
    out = df.withColumn("_ch", changes)
    heads = F.transform("_ch", lambda e: e["i"])
    tails = F.concat(F.slice(heads, 2, F.greatest(F.size("_ch") - 1, F.lit(0))), F.array(n))
    runs = F.transform(F.arrays_zip(F.col("_ch").alias("c"), tails.alias("t")), lambda e: F.struct(
        e["c"]["w"].alias("word"), e["c"]["i"].alias("head"), e["t"].alias("tail")))
    if reference_rule:
        out = out.withColumn("_runs", runs)
        spans = F.slice("_runs", 1, F.greatest(F.size("_runs") - 1, F.lit(0)))
        return out.withColumn("spans", spans).drop("_ch", "_runs")
    spans = F.filter(runs, lambda x: x["word"] != F.lit(SPECIAL_WORD))
    return out.withColumn("spans", spans).drop("_ch")


def span_labels(df: DataFrame, taxonomy="bio13", word_labels: str = "labels", out: str = "span_label_ids") -> DataFrame:
    """One label id per span, from the span's word."""
    m = label_to_id_map(taxonomy)
    return df.withColumn(out, F.transform("spans", lambda s: F.when(
        s["word"] == F.lit(SPECIAL_WORD), F.lit(IGNORE_ID)).otherwise(
        F.coalesce(m[F.try_element_at(F.col(word_labels), s["word"] + 1)], F.lit(IGNORE_ID)))))


def filter_min_spans(df: DataFrame, n: int) -> DataFrame:
    """Keep windows with more than ``n`` spans."""
    return df.filter(F.size("spans") > F.lit(n))


def keep_masked_words(df: DataFrame, masks: str = "masks") -> DataFrame:
    """Keep only spans whose word is masked in (mask = 1)."""
    return df.withColumn("spans", F.filter("spans", lambda s: F.coalesce(F.try_element_at(F.col(masks), s["word"] + 1), F.lit(0)) == F.lit(1)))


def drop_special(df: DataFrame, word_col: str = "token") -> DataFrame:
    """Drop occurrences of special / padding pieces."""
    return df.filter(F.col(word_col) != F.lit(SPECIAL_WORD))


def select_model_columns(df: DataFrame, with_labels: bool = True) -> DataFrame:
    """Keep only the columns a model consumes (Catalyst prunes the rest from the scan)."""
    cols = ["document", "window", "pieces", "word_ids", "input_length"]
    if with_labels and "label_ids" in df.columns:
        cols.append("label_ids")
    return df.select(*cols)
