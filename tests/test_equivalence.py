"""Two formulations of the same thing must agree (sf0.001)."""

from pyspark.sql import functions as F

from conftest import SF
from piisieve.plans import catalog_core as cc


def test_word_membership_equals_array_windows(spark):
    from piisieve.operators.windows import window, window_word_membership, words_as_pieces
    e = cc.essays(spark, SF)
    arr = window(words_as_pieces(e), 64, 16, n_special=0).select(
        "document", "window", F.explode("word_ids").alias("token"))
    words = e.select("document", F.size("tokens").alias("n_words"), F.posexplode("tokens").alias("token", "w"))
    memb = window_word_membership(words, 64, 48).select("document", "window", "token")
    assert arr.exceptAll(memb).count() == 0 and memb.exceptAll(arr).count() == 0


def test_scalar_labels_equal_array_labels(spark):
    from piisieve.operators.tokenise import explode_words
    a = explode_words(cc.essays(spark, SF), with_labels=True).select("document", "token", "label")
    b = cc.words(spark, SF).select("document", "token", "label")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_match_offsets_index_the_text(spark):
    from piisieve.operators.detect import all_match_offsets
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = all_match_offsets(docs).join(docs.select("doc_id", "text"), "doc_id")
    bad = m.filter(F.substring("text", F.col("start") + 1, F.length("match")) != F.col("match"))
    assert m.count() > 0 and bad.count() == 0


def test_codegen_scorer_equals_model_hook(spark):
    from piisieve.operators.evaluate import explode_occurrences
    from piisieve.plans.synthetic import scored_windows
    hook = explode_occurrences(scored_windows(cc.essays(spark, SF))).select(
        "document", "token", *[F.col("probs")[k].alias(f"p{k}") for k in range(13)])
    native = cc.occurrences(spark, SF).select(
        "document", "token", *[F.col("probs")[k].alias(f"p{k}") for k in range(13)])
    assert hook.exceptAll(native).count() == 0 and native.exceptAll(hook).count() == 0
