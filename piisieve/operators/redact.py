"""Removal: redaction by rules or by spans (R7) and consistent pseudonyms.

Every form works on the offsets of all spans in the original text. Overlapping spans are merged
into their union, which takes the type of its earliest (then longest) span, so no character of any
span survives; touching spans stay apart.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detect import PATTERN_RULES, has_match, rule_spans
from .surrogates import assign_surrogates

SPANS = "array<struct<start:int,end:int,type:string>>"


def merge_spans(spans) -> list[tuple[int, int, str]]:
    """Unions of overlapping (start, end, type) spans in order; empty spans vanish."""
    out: list[list] = []
    for start, end, kind in sorted(((s, e, t) for s, e, t in spans if e > s), key=lambda x: (x[0], -x[1])):
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end, kind])
    return [tuple(x) for x in out]


def replace_spans(text: str, spans, substitute) -> str:
    """The text with each merged span replaced by ``substitute(start, end, type)``; linear in the text."""
    parts, at = [], 0
    for start, end, kind in merge_spans(spans):
        start, end = max(start, at), min(end, len(text))
        if start >= end:
            continue
        parts += [text[at:start], substitute(start, end, kind)]
        at = end
    return "".join([*parts, text[at:]])


def _tag(start: int, end: int, kind: str) -> str:
    return f"[{kind}]"


def redact(df: DataFrame, rules: dict | None = None, text: str = "text", out: str = "redacted") -> DataFrame:
    """R7 pattern form: every match of every rule on the original text becomes '[TYPE]', in the row.

    Texts without a match (a JVM-side test) do not leave the JVM.
    """
    rules = rules or PATTERN_RULES
    find = rule_spans(rules)

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else replace_spans(
            t, [(s, e, kind) for kind, _, s, e, _ in find(t)], _tag))

    matched = F.when(has_match(F.col(text), rules), F.col(text))
    return df.withColumn(out, F.coalesce(rewrite(matched), F.col(text)))


def _rebuild(substitutes: bool):
    @F.pandas_udf("string")
    def rebuild(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, rows):
            if t is None or rows is None:
                return None
            named = {(r["start"], r["end"], r["type"]): r.get("surrogate") for r in rows}
            use = _tag if not substitutes else lambda s, e, k: named.get((s, e, k)) or f"[{k}]"
            return replace_spans(t, list(named), use)
        return pd.Series([one(t, rows) for t, rows in zip(texts, spans)], dtype=object)

    return rebuild


def redact_spans(docs: DataFrame, spans: DataFrame, doc: str = "doc_id", text: str = "text",
                 out: str = "redacted") -> DataFrame:
    """R7 span form: replace the [start, end) offsets of ``spans`` by '[TYPE]'.

    Spans are gathered per document (bounded by the document) and meet the documents in one join;
    texts without spans are passed through untouched.
    """
    per_doc = spans.groupBy(doc).agg(F.collect_list(F.struct(
        F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "type")).alias("_sp"))
    j = docs.join(per_doc, doc, "left")
    touched = F.when(F.col("_sp").isNotNull(), F.col(text))
    return j.withColumn(out, F.coalesce(_rebuild(False)(touched, F.col("_sp")), F.col(text))).drop("_sp")


def pseudonymise(matches: DataFrame, pool: DataFrame, salt: str, value: str = "match", kind: str = "type",
                 out: str = "surrogate", known: DataFrame | None = None) -> DataFrame:
    """A pool entry of the value's type for each value; equal values of a type get the same entry and, while
    the type's pool lasts, different values different ones. One row per match; a null value has no
    surrogate. ``known`` is an earlier run's assignment (see ``surrogates``)."""
    values = matches.select(F.col(kind).alias("entity_type"), F.col(value).alias("value"))
    named = assign_surrogates(values, pool, salt, known).select(
        F.col("entity_type").alias("_kind"), F.col("value").alias("_value"), F.col("surrogate").alias(out))
    return matches.join(named, (F.col(kind) == F.col("_kind")) & (F.col(value) == F.col("_value")), "left").drop("_kind", "_value")


def pseudonymise_text(docs: DataFrame, pool: DataFrame, salt: str, rules: dict, doc: str = "doc_id",
                      text: str = "text", out: str = "pseudonymised", known: DataFrame | None = None) -> DataFrame:
    """R8 in the text: every match of the rules is replaced by its surrogate. A merged span (overlapping
    matches) gets the tag of its type instead, since no single value stands for it."""
    from .detect import all_match_offsets

    found = all_match_offsets(docs, rules, text, (doc,))
    named = pseudonymise(found, pool, salt, known=known)
    per_doc = named.groupBy(doc).agg(F.collect_list(F.struct(
        F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "type", "surrogate")).alias("_sp"))
    j = docs.join(per_doc, doc, "left")
    touched = F.when(F.col("_sp").isNotNull(), F.col(text))
    return j.withColumn(out, F.coalesce(_rebuild(True)(touched, F.col("_sp")), F.col(text))).drop("_sp")
