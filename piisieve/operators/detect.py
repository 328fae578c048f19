"""Rule and dictionary detectors (R1-R3) and word-level rule labels.

Patterns stay inside the subset where Java regex and RE2 agree: explicit classes ([0-9], [ \n]),
no look-around, no back-references.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import entity_type

# Word-level rules: the first matching rule labels the word, otherwise 'O'.
WORD_RULES: list[tuple[str, str]] = [
    ("@[A-Za-z0-9.-]+[.]", "B-EMAIL"),
    ("^[0-9]{16}", "B-ID_NUM"),
    ("^[+]1$", "B-PHONE_NUM"),
    ("^[(][0-9]{3}[)]$", "I-PHONE_NUM"),
    ("^[0-9]{3}-[0-9]{4}", "I-PHONE_NUM"),
]

# Text-level rules for the pattern entity types (users add their own).
PATTERN_RULES: dict[str, str] = {
    "EMAIL": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}",
    "PHONE_NUM": "[+][0-9]{1,3} [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}",
    "ID_NUM": "[0-9]{13,}",
    "URL_PERSONAL": "https?://[A-Za-z0-9.-]+(/[A-Za-z0-9._~%/?#=&+@-]*)?",
}


def word_label(word: Column, rules=WORD_RULES) -> Column:
    expr = F.lit("O")
    for pattern, label in reversed(rules):
        expr = F.when(word.rlike(pattern), F.lit(label)).otherwise(expr)
    return expr


def label_words(df: DataFrame, rules=WORD_RULES, tokens: str = "tokens", out: str = "labels") -> DataFrame:
    """Word-level rule labels, one per token (the gold source of the fixtures)."""
    return df.withColumn(out, F.transform(tokens, lambda w: word_label(w, rules)))


def detect_patterns(df: DataFrame, rules: dict | None = None, text: str = "text",
                    keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every match of every rule -> (keys, type, match, occurrence)."""
    rules = rules or PATTERN_RULES
    per_type = F.array(*[F.struct(F.lit(t).alias("type"),
                                  F.regexp_extract_all(F.col(text), F.lit(p), 0).alias("m"))
                         for t, p in rules.items()])
    return (df.select(*keys, F.inline(per_type))
              .select(*keys, "type", F.posexplode("m").alias("occurrence", "match")))


def has_match(text: Column, rules: dict) -> Column:
    """Whether any rule matches, without leaving the JVM."""
    return text.rlike("|".join(f"(?:{p})" for p in rules.values()))


def rule_spans(rules: dict):
    """text -> [(type, occurrence, start, end, match)] of every rule, offsets in code points."""
    compiled = [(t, re.compile(p)) for t, p in rules.items()]

    def find(text: str):
        return [(t, k, m.start(), m.end(), m.group()) for t, p in compiled
                for k, m in enumerate(p.finditer(text)) if m.end() > m.start()]

    return find


SPAN_TYPE = "array<struct<type:string,occurrence:int,start:int,end:int,match:string>>"


def with_spans(df: DataFrame, rules: dict | None = None, text: str = "text", out: str = "spans") -> DataFrame:
    """R2 in the row: one scan, one array of the spans of all rules; only texts with a match leave the JVM."""
    from ..session import ship_package
    ship_package(df.sparkSession)
    rules = rules or PATTERN_RULES
    find = rule_spans(rules)

    @F.pandas_udf(SPAN_TYPE)
    def spans(texts: pd.Series) -> pd.Series:
        names = ("type", "occurrence", "start", "end", "match")
        return texts.map(lambda t: None if t is None else [dict(zip(names, x)) for x in find(t)])

    return df.withColumn(out, spans(F.when(has_match(F.col(text), rules), F.col(text))))


def all_match_offsets(df: DataFrame, rules: dict | None = None, text: str = "text",
                      keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """R2: (keys, type, occurrence, match, start, end) of every match of every rule."""
    found = with_spans(df.select(*keys, text), rules, text, "_spans")
    # the outer form: the inner one would infer a filter that evaluates the function a second time
    rows = found.select(*keys, F.inline_outer("_spans")).filter(F.col("type").isNotNull())
    return rows.select(*keys, "type", "occurrence", "match", "start", "end")


def match_offsets(df: DataFrame, entity: str, pattern: str, text: str = "text",
                  keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """R2 for one rule."""
    return all_match_offsets(df, {entity: pattern}, text, keys)


def normalise(word: Column) -> Column:
    """Token normalisation for dictionary lookups: strip surrounding punctuation, lower-case."""
    return F.lower(F.regexp_replace(word, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))


def detect_gazetteer(words: DataFrame, pool: DataFrame, word_col: str = "word",
                     keys: tuple[str, ...] = ("document", "token")) -> DataFrame:
    """Equi-join of normalised words with a pool of single values (entity_type, value). The join
    strategy is left to Spark's size estimates."""
    p = pool.select("entity_type", normalise(F.col("value")).alias("_key")).dropDuplicates(["entity_type", "_key"])
    w = words.withColumn("_key", normalise(F.col(word_col))).filter(F.length("_key") > 0)
    return w.join(p, "_key").drop("_key")


def detect_entries(essays: DataFrame, pool: DataFrame, gram_words: int = 3, tokens: str = "tokens",
                   doc: str = "document", max_entries: int = 100_000, max_bytes: int = 4 << 20) -> DataFrame:
    """R3 for entries of any number of words: (document, token, n_words, entity_type).

    An entry is keyed by its whole normalised text. A pool of at most ``max_entries`` entries and ``max_bytes``
    bytes of keys (counted first, which reads the pool alone) is broadcast as an automaton that every text walks
    once (``dictionary``): one read of the texts, no shuffle.

    A larger pool is joined: entries of up to ``gram_words`` words meet n-grams
    built inside the document row from its normalised, non-empty words (shifted copies zipped together);
    only n-grams that start with the first word of some entry reach the join of whole entries. Of a longer
    entry the first ``gram_words`` words are looked up so; where they occur, the words of the document are
    joined again and as many of them as the entry has are compared. Neither way nor ``gram_words`` changes a result.
    """
    from .dictionary import walk_entries
    from .tokenise import WORD_SEPARATOR

    def key(words: Column) -> Column:
        return F.array_join(words, " ")

    def opening(words: str, n: Column) -> Column:
        return F.slice(words, F.lit(1), n)

    entry = F.filter(F.transform(F.split("value", WORD_SEPARATOR, -1), normalise), lambda w: w != "")
    p = (pool.select("entity_type", entry.alias("_w")).filter(F.size("_w") > 0)
         .select("entity_type", key(F.col("_w")).alias("_key"), F.col("_w")[0].alias("_first"), F.size("_w").alias("_n"),
                 F.least(F.size("_w"), F.lit(gram_words)).alias("_m"), key(opening("_w", F.lit(gram_words))).alias("_open"))
         .dropDuplicates(["entity_type", "_key"]))
    words = F.filter(F.transform(tokens, lambda w, i: F.struct(normalise(w).alias("w"), i.alias("token"))), lambda x: x["w"] != "")
    rows = essays.select(doc, words.alias("_all"))
    size = p.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.octet_length("_key")), F.lit(0)).alias("bytes"),
                 F.coalesce(F.max("_n"), F.lit(0)).alias("words")).first()
    if size["entries"] <= max_entries and size["bytes"] <= max_bytes:
        keys = p.groupBy("_key", "_n").agg(F.sort_array(F.collect_list("entity_type")).alias("types")).orderBy("_key").collect()
        return walk_entries(rows.select(doc, F.col("_all.w").alias("_words"), F.col("_all.token").alias("_tokens")),
                            [(r["_key"], r["types"], r["_n"]) for r in keys], doc, "_words", "_tokens")
    shifted = [F.slice("_all", F.lit(k + 1), F.greatest(F.size("_all"), F.lit(1))).alias(f"s{k}") for k in range(gram_words)]
    grams = (rows.select(doc, *shifted).select(doc, F.posexplode(F.arrays_zip(*[f"s{k}" for k in range(gram_words)])).alias("_at", "g"))
             .select(doc, "_at", "g.*").filter("s0 IS NOT NULL")
             .select(doc, "_at", F.col("s0.token").alias("token"), F.col("s0.w").alias("_first"),
                     F.array(*[F.col(f"s{k}.w") for k in range(gram_words)]).alias("_gram")))
    sizes = p.select("_first", "_m").distinct()
    hits = grams.join(sizes, "_first").withColumn("_open", key(opening("_gram", F.col("_m"))))
    hits = hits.filter(F.forall(opening("_gram", F.col("_m")), lambda w: w.isNotNull()))  # none runs over the end
    out = [doc, "token", F.col("_n").alias("n_words"), "entity_type"]
    found = hits.join(p.filter(F.col("_n") <= gram_words).select("entity_type", "_open", "_n"), "_open").select(*out)
    if size["words"] <= gram_words:
        return found
    longer = p.filter(F.col("_n") > gram_words)
    # distinct places of a document id: its rows are compared each, also where an id is repeated
    places = (hits.join(longer.select("_open", "_m", "_n").distinct(), ["_open", "_m"])
              .select(F.col(doc).alias("_doc"), "_at", "_n").distinct())
    # two plain arrays shuffle in half the bytes of an array of structs
    texts = rows.select(doc, F.col("_all.w").alias("_words"), F.col("_all.token").alias("_tokens"))
    whole = (texts.join(places, F.col(doc).eqNullSafe(F.col("_doc")) & (F.col("_at") + F.col("_n") <= F.size("_words")))
             .select(doc, "_n", F.get("_tokens", F.col("_at")).alias("token"),
                     key(F.slice("_words", F.col("_at") + 1, F.col("_n"))).alias("_key")))
    return found.unionByName(whole.join(longer.select("entity_type", "_key", "_n"), ["_key", "_n"]).select(*out))


def email_domain_in_pool(matches: DataFrame, domains: DataFrame, match_col: str = "match",
                         anti: bool = False) -> DataFrame:
    """Left semi (or anti) join of e-mail matches with a domain pool."""
    m = matches.withColumn("_domain", F.lower(F.regexp_extract(F.col(match_col), "@([A-Za-z0-9.-]+)", 1)))
    d = domains.select(F.lower(F.col("value")).alias("_domain")).distinct()
    return m.join(d, "_domain", "left_anti" if anti else "left_semi").drop("_domain")


__all__ = ["WORD_RULES", "PATTERN_RULES", "label_words", "word_label", "detect_patterns", "match_offsets",
           "all_match_offsets", "with_spans", "detect_gazetteer", "detect_entries", "email_domain_in_pool", "normalise", "entity_type"]
