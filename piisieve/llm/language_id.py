"""Language identification: known words first, character n-grams for the rest.

Fitting counts words per language on a bounded sample of labelled documents and keeps the
``vocab_per_lang`` most frequent of each language, with the character n-grams (word borders marked)
of the sampled words. A known word scores its smoothed log frequency in every language. An unseen
word falls back to its n-grams of the greatest length of which any is known, then to shorter ones,
down to single characters; the mean of the known n-grams' log frequencies is its score. A document's
scores are the sums over all its words, normalised to probabilities.

Bounds (parameters): ``docs_per_lang`` sampled documents per language in expectation (drawn by a hash
of the key, so reruns agree), ``vocab_per_lang`` words and ``grams_per_lang`` n-grams of each length
and language. The fitted model is therefore of bounded size; it is the one thing that is broadcast.

Defined results: null text, or text without letters, is ``und`` with score 0; with no labelled
document every text is ``und``; equal scores go to the language first by code point; a word of an
unknown script adds nothing; null and empty labels are not learned; extra columns stay.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
CACHE_WORDS = 400_000
PIECE_LETTERS = 100


@dataclass(frozen=True)
class LanguageModel:
    """Languages by code point; word and n-gram log frequencies per language (rows of equal length)."""

    langs: tuple[str, ...]
    words: dict[str, tuple[float, ...]]
    grams: dict[str, tuple[float, ...]]
    max_gram: int


def _sample(df: DataFrame, key: str, text: str, lang: str, docs_per_lang: int) -> DataFrame:
    """About ``docs_per_lang`` documents of each language, chosen by a hash of the key."""
    labelled = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("t").isNotNull())
    counts = labelled.groupBy("lang").count().collect()  # one row for each language
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, docs_per_lang / r["count"]))).otherwise(share)
    unit = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    return labelled.filter(unit < share)


def _top(df: DataFrame, by: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("n").desc(), F.col("item"))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("rank")


def fit_language_model(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                       docs_per_lang: int = 2_000, vocab_per_lang: int = 20_000, grams_per_lang: int = 10_000,
                       max_gram: int = 4, smoothing: float = 0.5) -> LanguageModel:
    """Count on the cluster, collect the bounded tables of counts."""
    words = (_sample(df, key, text, lang, docs_per_lang)
             .select("lang", F.explode(F.expr(r"regexp_extract_all(lower(t), '\\p{L}+', 0)")).alias("item"))
             .groupBy("lang", "item").agg(F.count("*").alias("n")))
    words = words.checkpoint()  # read by the vocabulary and the n-grams
    marked = F.concat(F.lit("^"), F.col("item"), F.lit("$"))
    grams = None
    for size in range(1, max_gram + 1):
        # runs of any length are cut into pieces that overlap by size - 1 letters, so each n-gram starts in one piece
        piece = F.transform(F.sequence(F.lit(0), F.floor((F.length(marked) - 1) / PIECE_LETTERS).cast("int")),
                            lambda i: F.substring(marked, i * PIECE_LETTERS + 1, F.lit(PIECE_LETTERS + size - 1)))
        pieces = words.select("lang", "n", F.explode(piece).alias("piece"))
        each = (pieces.select("lang", "n", F.lit(size).alias("size"), F.explode(
                    F.transform(F.sequence(F.lit(1), F.least(F.length("piece"), F.lit(PIECE_LETTERS))),
                                lambda i: F.substring(F.col("piece"), i, F.lit(size)))).alias("item"))
                .filter(F.length("item") == size))
        grams = each if grams is None else grams.unionByName(each)
    grams = grams.groupBy("lang", "size", "item").agg(F.sum("n").alias("n"))
    vocabulary = _top(words, ["lang"], vocab_per_lang).select("lang", F.lit(0).alias("size"), "item", "n")
    rows = vocabulary.unionByName(_top(grams, ["lang", "size"], grams_per_lang)).collect()
    return _model(rows, max_gram, smoothing)


def _model(rows, max_gram: int, smoothing: float) -> LanguageModel:
    langs = tuple(sorted({r["lang"] for r in rows}))
    place = {x: i for i, x in enumerate(langs)}
    tables: dict[int, dict[str, list[float]]] = {}
    for r in rows:
        tables.setdefault(r["size"], {}).setdefault(r["item"], [0.0] * len(langs))[place[r["lang"]]] = float(r["n"])
    logs: dict[int, dict[str, tuple[float, ...]]] = {}
    for size, counts in tables.items():
        totals = [sum(c[i] for c in counts.values()) + smoothing * len(counts) for i in range(len(langs))]
        logs[size] = {item: tuple(math.log((c[i] + smoothing) / totals[i]) for i in range(len(langs)))
                      for item, c in counts.items()}
    return LanguageModel(langs, logs.pop(0, {}), {g: v for t in logs.values() for g, v in t.items()}, max_gram)


class _Places(dict):
    """word -> row of the scorer's table."""

    def __init__(self, scorer: "Scorer"):
        super().__init__()
        self.scorer = scorer

    def __missing__(self, word: str) -> int:
        i = self.scorer.add(word)
        self[word] = i
        return i


class Scorer:
    """Word scores of one model, cached in a growing matrix (one row per distinct word)."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.place = _Places(self)
        self.table = np.zeros((1024, len(self.model.langs) + 1))

    def score_word(self, word: str) -> np.ndarray:
        """Log frequency per language, then 1 if the word has a letter."""
        out = np.zeros(len(self.model.langs) + 1)
        out[-1] = any(map(str.isalpha, word))
        known = self.model.words.get(word)
        if known is not None:
            out[:-1] = known
            return out
        marked = f"^{word}$"
        for size in range(self.model.max_gram, 0, -1):
            found = [g for i in range(len(marked) - size + 1) if (g := self.model.grams.get(marked[i:i + size]))]
            if size == 1:  # the border marks say nothing alone
                found = [g for c in word if (g := self.model.grams.get(c))]
            if found:
                out[:-1] = np.mean(found, axis=0)
                return out
        return out

    def add(self, word: str) -> int:
        i = len(self.place)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[i] = self.score_word(word)
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not words or not self.model.langs:
            return UNDETERMINED, 0.0
        if len(self.place) > CACHE_WORDS:
            self.reset()
        rows = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))  # may grow the table, so it is read afterwards
        total = self.table[rows].sum(axis=0)
        if not total[-1]:
            return UNDETERMINED, 0.0
        logs = total[:-1] - total[:-1].max()
        p = np.exp(logs)
        best = int(np.argmax(p))
        return self.model.langs[best], float(p[best] / p.sum())


_SCORERS: dict[int, Scorer] = {}


def detect_language(df: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang_pred",
                    score: str = "score") -> DataFrame:
    """Add the predicted language and its probability; only the text goes through Arrow."""
    model_b = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        value = model_b.value
        scorer = _SCORERS.get(id(value))
        if scorer is None:
            scorer = _SCORERS[id(value)] = Scorer(value)
        found = [scorer.predict(t) for t in texts]
        return pd.DataFrame({"lang": [f[0] for f in found], "score": [f[1] for f in found]})

    return (df.withColumn("_found", predict(F.col(text).cast("string")))
              .withColumns({lang: F.col("_found.lang"), score: F.col("_found.score")}).drop("_found"))
