"""Character spans <-> B-/I- word labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import entity_type
from .indexing import range_overlap_join


def spans_to_bio(words: DataFrame, spans: DataFrame, doc: str = "document", bucket: int = 256) -> DataFrame:
    """Words overlapped by a character span get its type; the first such word 'B-', the rest 'I-'.

    ``words``: doc + token + start + end; ``spans``: doc + span_id + type + start + end. Interval
    overlap by the bucketed range join (no all-pairs per document).
    """
    s = spans.select(doc, "span_id", "type", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    w = words.select(doc, "token", F.col("start").alias("w_start"), F.col("end").alias("w_end"))
    j = range_overlap_join(w, s, doc, "w_start", "w_end", "s_start", "s_end", bucket)
    first = F.min("token").over(Window.partitionBy(doc, "span_id"))  # one span's words only
    return j.select(doc, "token", "span_id", "type",
                    F.concat(F.when(F.col("token") == first, F.lit("B-")).otherwise(F.lit("I-")),
                             F.col("type")).alias("label"))


def spans_to_bio_sweep(words: DataFrame, spans: DataFrame, doc: str = "document", block: int = 4096) -> DataFrame:
    """R4 by a sweep over sorted borders: same rows as ``spans_to_bio``, for spans of any length.

    The words of a document are in text order and do not overlap, so the words that a span overlaps are
    numbered in one stretch: from behind the last word that ends at or before the span's start to the last word that
    starts before its end. Both are running maxima of the token number along the sorted borders: every
    word and every span is one row in each of the two sweeps, however long the span. A sweep runs in (document,
    block of ``block`` characters) cells plus one row per cell, so a long document is many tasks' work.

    ``words``: doc + token + start + end, all words of the document with tokens numbered without gaps from
    0; ``spans``: doc + span_id + type + start + end (unique span_id in the document). Spans of documents
    without words, spans between words and rows with nulls give nothing.
    """
    from .runlog import running_stats
    w = words.filter(F.col("start").isNotNull() & F.col("end").isNotNull())
    s = spans.filter(F.col("start").isNotNull() & F.col("end").isNotNull())

    def borders(sweep, word_at, span_at, word_first):
        nothing = F.lit(None)
        of_words = w.select(F.col(doc).alias("_doc"), F.lit(sweep).alias("_sweep"), F.col(word_at).cast("long").alias("_at"), F.lit(not word_first).alias("_late"),
                            F.col("token").cast("double").alias("_token"), nothing.cast("string").alias("_span"), nothing.cast("string").alias("_type"))
        of_spans = s.select(F.col(doc).alias("_doc"), F.lit(sweep).alias("_sweep"), F.col(span_at).cast("long").alias("_at"), F.lit(word_first).alias("_late"),
                            nothing.cast("double").alias("_token"), F.col("span_id").cast("string").alias("_span"), F.col("type").alias("_type"))
        return of_words.unionByName(of_spans)

    # at one place the borders of words come first in the sweep of ends and last in the sweep of starts
    every = borders(0, "end", "start", True).unionByName(borders(1, "start", "end", False))
    met = running_stats(every, ["_doc", "_sweep"], ["_at", "_late"], "_token", F.floor(F.col("_at") / F.lit(block)), "_w_")
    ranges = met.filter(F.col("_span").isNotNull()).groupBy("_doc", "_span").agg(
        F.first("_type").alias("type"),
        (F.coalesce(F.max(F.when(F.col("_sweep") == 0, F.col("_w_max"))), F.lit(-1.0)) + 1).cast("long").alias("_first"),
        F.max(F.when(F.col("_sweep") == 1, F.col("_w_max"))).cast("long").alias("_last"))
    tokens = ranges.filter(F.col("_last") >= F.col("_first")).select(
        F.col("_doc").alias(doc), F.explode(F.sequence("_first", "_last")).alias("token"), F.col("_span").alias("span_id"), "type", "_first")
    return tokens.select(doc, F.col("token").cast(words.schema["token"].dataType).alias("token"),
                         F.col("span_id").cast(spans.schema["span_id"].dataType).alias("span_id"), "type",
                         F.concat(F.when(F.col("token") == F.col("_first"), F.lit("B-")).otherwise(F.lit("I-")), F.col("type")).alias("label"))


def label_matches(essays: DataFrame, rules: dict | None = None, doc: str = "document") -> DataFrame:
    """R4 in the row: (document, token, type, occurrence, label) of every word that a rule's match overlaps.

    ``essays`` has full_text, tokens and separators. Texts without a match leave neither the JVM nor
    the row; the others are cut into word offsets and searched per span (binary search, no join).
    """
    from .detect import PATTERN_RULES, with_spans
    rules = rules or PATTERN_RULES
    found = with_spans(essays, rules, "full_text", "_spans")
    has = F.col("_spans").isNotNull()

    @F.pandas_udf("array<struct<token:int,type:string,occurrence:int,label:string>>")
    def label(spans: pd.Series, words: pd.Series, gaps: pd.Series) -> pd.Series:
        def one(rows, w, g):
            if rows is None or w is None:
                return None
            size, gap = np.asarray(w, dtype=np.int64), np.zeros(len(w), dtype=np.int64)
            gap[:len(g)] = g
            start = np.cumsum(size + gap) - size - gap
            end, out = start + size, []
            for r in rows:
                # words that end after the span's start and start before its end
                first, last = np.searchsorted(end, r["start"], "right"), np.searchsorted(start, r["end"], "left")
                named = [t for t in range(first, last) if size[t] or start[t] > r["start"]]
                out += [{"token": int(t), "type": r["type"], "occurrence": r["occurrence"],
                         "label": ("B-" if t == named[0] else "I-") + r["type"]} for t in named]
            return out
        return pd.Series([one(*x) for x in zip(spans, words, gaps)], dtype=object)

    lengths = F.when(has, F.transform("tokens", lambda t: F.length(t)))
    gaps = F.when(has, F.transform("separators", lambda t: F.length(t)))
    return found.select(doc, F.inline_outer(label(F.col("_spans"), lengths, gaps))).filter(F.col("token").isNotNull())


def bio_spans_in_row(essays: DataFrame, doc: str = "document", labels: str = "labels") -> DataFrame:
    """R5 while the labels are still an array: (document, type, start_token, end_token), no shuffle.

    Entity words are kept with their positions; each is zipped with the one before, a span starts where
    the rule of ``bio_to_spans`` says, and ends before the next start.
    """
    def shifted(arr, first):
        return F.concat(F.array(first), F.slice(arr, F.lit(1), F.greatest(F.size(arr) - 1, F.lit(0))))

    entity = F.filter(F.transform(labels, lambda x, i: F.struct(i.alias("i"), x.alias("label"))), lambda e: e["label"] != "O")
    rows = essays.select(doc, entity.alias("_e"))
    nothing = F.lit(None).cast("struct<i:int,label:string>")
    rows = rows.select(doc, F.arrays_zip(F.col("_e").alias("e"), F.slice(shifted(F.col("_e"), nothing), F.lit(1), F.size("_e")).alias("p")).alias("_z"))
    starts = F.transform("_z", lambda z: F.struct(z["e"]["i"].alias("i"), entity_type(z["e"]["label"]).alias("type"), (
        z["e"]["label"].startswith("B-") | z["p"].isNull() | (z["p"]["i"] != z["e"]["i"] - 1)
        | (entity_type(z["p"]["label"]) != entity_type(z["e"]["label"]))).alias("start")))
    rows = rows.select(doc, starts.alias("_s"))
    ends = F.concat(F.slice(F.transform("_s", lambda x: x["start"]), F.lit(2), F.greatest(F.size("_s") - 1, F.lit(0))), F.array(F.lit(True)))
    rows = rows.select(doc, F.filter("_s", lambda x: x["start"]).alias("_from"), F.filter(
        F.slice(F.arrays_zip(F.col("_s").alias("s"), ends.alias("end")), F.lit(1), F.size("_s")), lambda x: x["end"]).alias("_to"))
    return rows.select(doc, F.inline(F.arrays_zip("_from", "_to"))).select(
        doc, F.col("_from.type").alias("type"), F.col("_from.i").alias("start_token"), (F.col("_to.s.i") + 1).alias("end_token"))


def bio_to_spans(words: DataFrame, doc: str = "document", label: str = "label", block: int = 4096) -> DataFrame:
    """Entity words -> spans. A new span starts on 'B-', on a type change, on a gap in
    token numbers, or at a lone 'I-'.

    Skew-safe: the previous word comes from an equi-join on (document, token - 1), the span a word
    belongs to is the running max of span starts computed in (document, token block) cells plus
    one row per cell, and spans close with an aggregate. No window spans a whole document, so a
    document holding a third of all entity words is still split over many tasks.
    """
    from .runlog import running_stats
    e = (words.filter(F.col(label) != F.lit("O"))
              .select(doc, "token", F.col(label).alias("_label"), entity_type(F.col(label)).alias("_type")))
    prev = e.select(doc, (F.col("token") + 1).alias("token"), F.col("_type").alias("_prev_type"))
    j = e.join(prev, [doc, "token"], "left")
    start = (F.col("_label").startswith("B-") | F.col("_prev_type").isNull()
             | (F.col("_prev_type") != F.col("_type")))
    j = j.withColumn("_start_tok", F.when(start, F.col("token").cast("double")))
    r = running_stats(j, [doc], ["token"], "_start_tok", F.floor(F.col("token") / F.lit(block)), "_s_")
    return (r.groupBy(doc, F.col("_s_max").cast("long").alias("_span"))
             .agg(F.first("_type").alias("type"), F.min("token").alias("start_token"),
                  (F.max("token") + 1).alias("end_token"))
             .drop("_span"))
