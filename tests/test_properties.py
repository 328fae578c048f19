"""Properties over the driver tables (sf0.001) and against brute force."""

import random

from pyspark.sql import functions as F

from conftest import SF
from piisieve.operators import curve as C
from piisieve.operators import evaluate as E
from piisieve.operators import windows as W
from piisieve.operators.indexing import range_overlap_join, with_row_index
from piisieve.plans import catalog_core as cc


def test_windows_cover_and_overlap(spark):
    e = cc.essays(spark, SF)
    p = W.split_pieces(W.words_as_pieces(e).withColumn("input_tokens", F.col("tokens")))
    w = W.window(p, max_length=64, stride=16, n_special=2).select("document", "window", "start", "input_length")
    n = p.select("document", F.size("pieces").alias("n"))
    rows = w.join(n, "document").collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.document, []).append(r)
    for doc, ws in by_doc.items():
        ws.sort(key=lambda r: r.window)
        covered = max(r.start + r.input_length - 2 for r in ws)
        assert covered >= ws[0].n
        for a, b in zip(ws, ws[1:]):
            assert a.start + (a.input_length - 2) - b.start == 16


def test_one_pass_curve_equals_naive(spark):
    pred = cc.pred(spark, SF).persist()
    gold = cc.gold(spark, SF).persist()
    curve = {r.grid_idx: (r.tp, r.fp, r.fn) for r in C.threshold_curve(pred, gold).collect()}
    for i in (0, 7, 15, 23):
        th = C.THRESHOLD_GRID[i]
        c = E.type_counts(E.keep_entities(E.apply_threshold(pred, th)), gold).collect()
        tot = (sum(r.tp for r in c), sum(r.fp for r in c), sum(r.fn for r in c))
        if not c:
            tot = (0, 0, gold.count())
        assert curve[i] == tot
    pred.unpersist()
    gold.unpersist()


def test_results_independent_of_partitions(spark):
    vals = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        vals.append(sorted(tuple(r) for r in cc.counts(spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert vals[0] == vals[1]


def test_tp_plus_fn_is_gold(spark):
    c = cc.counts(spark, SF).collect()
    assert sum(r.tp + r.fn for r in c) == cc.gold(spark, SF).count()


def test_row_index_dense_and_ordered(spark):
    df = spark.createDataFrame([(random.Random(i).random(), i) for i in range(500)], "k double, i long")
    out = with_row_index(df, ["k"], "ix", num_partitions=7).orderBy("ix").collect()
    assert [r.ix for r in out] == list(range(500))
    assert [r.k for r in out] == sorted(r.k for r in out)


def test_weighted_row_index(spark):
    df = spark.createDataFrame([(i, i % 3 + 1) for i in range(50)], "k long, w long")
    out = with_row_index(df, ["k"], "off", weight_col="w", num_partitions=5).orderBy("k").collect()
    acc = 0
    for r in out:
        assert r.off == acc
        acc += r.w


def test_range_join_matches_brute_force(spark):
    rnd = random.Random(3)
    left = [(rnd.randint(0, 3), s, s + rnd.randint(0, 40)) for s in (rnd.randint(0, 1000) for _ in range(200))]
    right = [(rnd.randint(0, 3), s, s + rnd.randint(1, 300)) for s in (rnd.randint(0, 1000) for _ in range(60))]
    L = spark.createDataFrame([(i, *x) for i, x in enumerate(left)], "li int, d int, ls int, le int")
    R = spark.createDataFrame([(i, *x) for i, x in enumerate(right)], "ri int, d int, rs int, re int")
    got = {(r.li, r.ri) for r in range_overlap_join(L, R, "d", "ls", "le", "rs", "re", bucket=32).collect()}
    want = {(i, j) for i, a in enumerate(left) for j, b in enumerate(right)
            if a[0] == b[0] and a[1] < b[2] and b[1] < a[2]}
    assert got == want


def test_redacted_text_holds_no_match(spark):
    from piisieve.operators.detect import PATTERN_RULES
    from piisieve.operators.redact import redact
    r = redact(spark.read.parquet(f"{SF}/documents.parquet"))
    for p in PATTERN_RULES.values():
        assert r.filter(F.col("redacted").rlike(p)).count() == 0


def test_rebuild_is_identity(spark):
    from piisieve.operators.tokenise import rebuild_text
    r = rebuild_text(cc.essays(spark, SF))
    assert r.filter(F.col("rebuilt_text") != F.col("full_text")).count() == 0


def test_bio_roundtrip(spark):
    """spans_to_bio then bio_to_spans returns the word ranges of non-overlapping spans."""
    from piisieve.operators.detect import PATTERN_RULES, all_match_offsets
    from piisieve.operators.spans import bio_to_spans, spans_to_bio
    from piisieve.operators.tokenise import explode_words, word_offsets
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    e = word_offsets(cc.essays(spark, SF))
    words = explode_words(e, with_offsets=True)
    m = all_match_offsets(docs, {"PHONE_NUM": PATTERN_RULES["PHONE_NUM"]}).select(
        F.col("doc_id").alias("document"), "type", "start", "end", F.col("occurrence").cast("string").alias("span_id"))
    bio = spans_to_bio(words, m)
    back = bio_to_spans(bio.select("document", "token", "label"))
    assert back.count() == m.count()
    assert back.filter(F.col("end_token") - F.col("start_token") != 3).count() == 0
