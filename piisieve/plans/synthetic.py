"""Deterministic stand-in for a token classifier, computed with native expressions.

Every piece occurrence gets a probability vector over the 13 classes of ``bio13`` from
integers only:

    h = 13*document + 29*token + 5*window
    m = 1 + h % 14 on entity words, else 60 + h % 190;   P(O) = m / (m + 1)
    class k in 0..11 shares 1/(m+1) by weight 1 + (k + h) % 5, plus 40 on the favoured class:
    the gold class (the next one, mod 12, when h % 4 = 0), or h % 12 on outside words.

m = 3, 99, 199 give exactly 0.75, 0.99 and 0.995, so inclusive / strict compares are exercised.

The hot path scores exploded occurrences with scalar columns (whole-stage codegen, shared
sub-expressions); ``scored_windows`` gives the per-window array form (D7 as a model emits it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import posexplode_rows
from ..functions.labels import IGNORE_ID, label_id
from ..operators.detect import label_words
from ..operators.tokenise import tokenise
from ..operators.windows import align_labels, window, window_word_membership, words_as_pieces

N_ENTITY = 12


def _h(document: Column, token: Column, win: Column) -> Column:
    return document * 13 + token * 29 + win * 5


def _m(h: Column, g: Column) -> Column:
    ent = (g >= 0) & (g < N_ENTITY)
    return F.when(ent, F.lit(1) + h % 14).otherwise(F.lit(60) + h % 190)


def _fav(h: Column, g: Column) -> Column:
    ent = (g >= 0) & (g < N_ENTITY)
    return F.when(ent, F.when(h % 4 == 0, (g + 1) % N_ENTITY).otherwise(g)).otherwise(h % N_ENTITY)


def _weights(h: Column, fav: Column) -> list[Column]:
    return [F.lit(1) + (F.lit(k) + h) % 5 + F.when(fav == k, 40).otherwise(0) for k in range(N_ENTITY)]


def essays_from_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          keep: tuple[str, ...] = ()) -> DataFrame:
    """documents -> D1 essays with rule-based gold labels."""
    return label_words(tokenise(documents, id_col, text_col, keep))


def score_occurrences(occ: DataFrame, gold_id: str = "g") -> DataFrame:
    """(document, token, window, g) -> + probs, with scalar intermediate columns."""
    s = (occ.withColumn("_h", _h(F.col("document"), F.col("token"), F.col("window")))
            .withColumn("_m", _m(F.col("_h"), F.col(gold_id)))
            .withColumn("_f", _fav(F.col("_h"), F.col(gold_id))))
    ws = _weights(F.col("_h"), F.col("_f"))
    s = s.select("*", *[w.alias(f"_w{k}") for k, w in enumerate(ws)])
    # closed form of the weight total: 12 ones + 40 + sum over 12 consecutive residues mod 5
    h = F.col("_h")
    total = F.lit(12 + 40 + 20) + h % 5 + (h + 1) % 5
    s = s.withColumn("_den", (total * (F.col("_m") + 1)).cast("double"))
    probs = F.array(*[F.col(f"_w{k}").cast("double") / F.col("_den") for k in range(N_ENTITY)],
                    F.col("_m").cast("double") / (F.col("_m") + 1).cast("double"))
    drop = ["_h", "_m", "_f", "_den", *[f"_w{k}" for k in range(N_ENTITY)]]
    return s.withColumn("probs", probs).drop(*drop)


def labelled_words(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents -> one row per word (document, token, word, n_words, label).

    The words are exploded first and labelled with scalar rules, which stay inside whole-stage
    codegen (a lambda over the token array is evaluated interpreted).
    """
    from ..operators.detect import word_label
    t = tokenise(documents, id_col, text_col).select("document", F.size("tokens").alias("n_words"), "tokens")
    w = (t.select("document", "n_words", posexplode_rows(F.col("tokens"), "token", "word"))
          .filter(F.col("token").isNotNull()))
    return w.withColumn("label", word_label(F.col("word")))


def occurrences_from_words(words: DataFrame, max_length: int = 1024, stride: int = 256,
                           labels="bio13", keep: tuple[str, ...] = ()) -> DataFrame:
    """(document, token, n_words, label) -> (document, token, window, probs): every word exploded
    straight into the 1-2 word-level windows that hold it (same law as ``window``), so no window
    array is materialised."""
    cap, step = max_length, max_length - stride
    w = words.select("document", "n_words", "token", label_id(F.col("label"), labels).alias("g"))
    return score_occurrences(window_word_membership(w, cap, step)).select("document", "token", "window", "probs", *keep)


def synthetic_occurrences(essays: DataFrame, max_length: int = 1024, stride: int = 256,
                          labels="bio13") -> DataFrame:
    """(document, token, window, probs) from essays (D1 with labels)."""
    # n_words is computed before the explode, so the token array is not carried into (and
    # copied with) every exploded word row
    per_doc = essays.select("document", F.size("tokens").alias("n_words"), "labels")
    words = (per_doc.select("document", "n_words", posexplode_rows(F.col("labels"), "token", "label"))
                    .filter(F.col("token").isNotNull()))
    return occurrences_from_words(words, max_length, stride, labels)


def scored_windows(essays: DataFrame, max_length: int = 1024, stride: int = 256, labels="bio13",
                   keep_labels: bool = False) -> DataFrame:
    """Word-level windows (no specials) scored by the model hook (R9): per-window probability
    arrays, as a model emits them (D7 before the explode). ``keep_labels`` lets the label ids pass
    through the hook. The scorer is a fixture that is given the gold ids, so scores made with it say
    nothing about quality."""
    from ..operators.score import score_windows, synthetic_model
    pieces = words_as_pieces(essays, taxonomy=labels)
    win = window(pieces, max_length, stride, n_special=0, keep=("document",),
                 sliced={"label_ids": IGNORE_ID})
    return score_windows(win.select("document", "window", "word_ids", "label_ids"), synthetic_model,
                         keep=("label_ids",) if keep_labels else ())
