"""Hand-written rows, one group per semantic trap (T1-T12) and per fixture rule."""

import pytest
from pyspark.sql import functions as F

from piisieve.functions.labels import taxonomy
from piisieve.operators import curve as C
from piisieve.operators import evaluate as E
from piisieve.operators import windows as W
from piisieve.operators.indexing import require_unique

TAX = taxonomy("bio13")
N = len(TAX)


def occ(spark, rows):
    """rows: (document, token, {class_id: p}, outside) -> occurrences with full vectors."""
    data = []
    for d, t, ent, out in rows:
        v = [0.0] * N
        for k, p in ent.items():
            v[k] = p
        v[-1] = out
        data.append((d, t, v))
    return spark.createDataFrame(data, "document long, token int, probs array<double>")


def test_t1_filter_before_mean(spark):
    p = E.prediction_table(occ(spark, [(1, 0, {0: 0.001}, 0.999), (1, 0, {0: 0.5}, 0.5)]), TAX, 0.995)
    assert p.first()["outside_prob"] == 0.5


def test_t2_strict_cut_inclusive_threshold(spark):
    p = E.prediction_table(occ(spark, [(1, 0, {0: 0.005}, 0.995), (1, 1, {0: 0.1}, 0.9)]), TAX, 0.995)
    rows = {r["token"]: r for r in E.apply_threshold(p, 0.9).collect()}
    assert 0 not in rows                       # 0.995 dropped by the strict cut
    assert rows[1]["label"] == "B-EMAIL"       # 0.9 kept by the inclusive threshold


def test_t3_noop_threshold(spark):
    p = E.prediction_table(occ(spark, [(1, 0, {1: 0.006}, 0.994)]), TAX, 0.995)
    assert E.apply_threshold(p, 0.995).first()["label"] == "B-ID_NUM"


def test_t4_empty_essay_has_no_gold(spark):
    e = spark.createDataFrame([(1, []), (2, ["O", "B-EMAIL"])], "document long, labels array<string>")
    g = E.gold_table(e).collect()
    assert [(r.document, r.token, r.label) for r in g] == [(2, 1, "B-EMAIL")]


def test_t5_duplicate_document_raises(spark):
    e = spark.createDataFrame([(7,), (7,)], "document long")
    with pytest.raises(ValueError):
        require_unique(e, "document")


def test_t6_prefix_mismatch(spark):
    pred = spark.createDataFrame([(1, 0, "I-EMAIL")], "document long, token int, label string")
    gold = spark.createDataFrame([(1, 0, "B-EMAIL")], "document long, token int, label string")
    c = {r.type: (r.tp, r.fp, r.fn) for r in E.type_counts(pred, gold).collect()}
    assert c == {"EMAIL": (0, 1, 1)}


def test_t7_unknown_label_ignored_but_gold_kept(spark):
    e = spark.createDataFrame([(1, ["a"], ["I-EMAIL"])], "document long, tokens array<string>, labels array<string>")
    a = W.align_labels(W.words_as_pieces(e), "bio13")
    assert a.first()["label_ids"] == [-100]
    assert E.gold_table(e).count() == 1


def test_t8_last_run(spark):
    df = spark.createDataFrame([([-1, 0, 0, 1],)], "word_ids array<int>")
    new = W.word_spans(df).first()["spans"]
    old = W.word_spans(df, reference_rule=True).first()["spans"]
    assert [(s.word, s.head, s.tail) for s in new] == [(0, 1, 3), (1, 3, 4)]
    assert [(s.word, s.head, s.tail) for s in old] == [(0, 1, 3)]


def test_t9_masks(spark):
    df = spark.createDataFrame([([-1, 0, 1, -1], [1, 0])], "word_ids array<int>, masks array<int>")
    s = W.keep_masked_words(W.word_spans(df)).first()["spans"]
    assert [x.word for x in s] == [0]


def test_t12_grid_literals():
    assert len(C.THRESHOLD_GRID) == 24
    assert 0.87 not in {round(t, 2) for t in C.THRESHOLD_GRID}


def test_tied_class_takes_lower_id(spark):
    p = E.prediction_table(occ(spark, [(1, 0, {0: 0.2, 1: 0.3, 2: 0.3}, 0.2)]), TAX, 0.995)
    assert p.first()["most_probable_label"] == "B-ID_NUM"


def test_tied_f5_takes_lower_threshold(spark):
    curve = spark.createDataFrame([(0, 0.8, 0.5), (1, 0.9, 0.5), (2, 0.95, 0.4)], "grid_idx int, threshold double, f5 double")
    assert C.best_threshold(curve).first()["best_threshold"] == 0.8


def test_empty_predictions(spark):
    pred = spark.createDataFrame([], "document long, token int, label string")
    gold = spark.createDataFrame([(1, i, "B-EMAIL") for i in range(3)], "document long, token int, label string")
    counts = E.type_counts(pred, gold)
    assert counts.count() == 0
    s = E.overall_scores(counts).first()
    assert (s.ents_p, s.ents_r, s.ents_f5) == (0.0, 0.0, 0.0)


def test_windows_law(spark):
    df = spark.createDataFrame([(1, [f"p{i}" for i in range(10)], list(range(10)))],
                               "document long, pieces array<string>, word_ids array<int>")
    w = W.window(df, max_length=4, stride=1, n_special=0).orderBy("window").collect()
    assert [r.start for r in w] == [0, 3, 6]
    assert w[-1].word_ids == [6, 7, 8, 9]


def test_window_rejects_bad_stride(spark):
    df = spark.createDataFrame([(1, ["a"], [0])], "document long, pieces array<string>, word_ids array<int>")
    with pytest.raises(ValueError):
        W.window(df, max_length=4, stride=2, n_special=2)


def test_padding_multiple(spark):
    from piisieve.operators.batches import length_buckets
    df = spark.createDataFrame([(1, 0, 5, 0), (2, 0, 17, 1)], "document long, window int, input_length int, order_idx long")
    assert {r.padded_len for r in length_buckets(df, 4, 16).collect()} == {32}


def test_mix_weights_and_unknown(spark):
    from piisieve.operators.split import mix
    df = spark.createDataFrame([(1, "a"), (2, "b")], "document long, set_name string")
    m = sorted((r.document, r.copy) for r in mix(df, ["a", "b"], [0, 2]).collect())
    assert m == [(2, 1), (2, 2)]
    with pytest.raises(KeyError):
        mix(df, ["a", "zz"], [1, 0])
    with pytest.raises(ValueError):
        mix(df, ["a", "b"], [1])


def test_prefix_sample(spark):
    from piisieve.operators.split import take_prefix
    df = spark.createDataFrame([(i,) for i in range(10)], "document long")
    assert [r.document for r in take_prefix(df, 0.15, ["document"]).collect()] == [0]


def test_reference_row_id(spark):
    e = spark.createDataFrame([(1, ["O", "B-EMAIL"]), (2, ["B-EMAIL", "O"])], "document long, labels array<string>")
    r = sorted((x.row_id, x.document, x.token) for x in E.reference_table(e).collect())
    assert r == [(1, 1, 1), (2, 2, 0)]


def test_phone_words_and_lone_i(spark):
    from piisieve.operators.detect import label_words
    from piisieve.operators.spans import bio_to_spans
    from piisieve.operators.tokenise import explode_words, tokenise
    d = spark.createDataFrame([(1, "call +1 (743) 555-3824 now")], "doc_id long, text string")
    w = explode_words(label_words(tokenise(d)), with_labels=True)
    assert [r.label for r in w.orderBy("token").collect()] == ["O", "B-PHONE_NUM", "I-PHONE_NUM", "I-PHONE_NUM", "O"]
    s = bio_to_spans(w).collect()
    assert [(x.type, x.start_token, x.end_token) for x in s] == [("PHONE_NUM", 1, 4)]
    lone = spark.createDataFrame([(1, 0, "I-ID_NUM"), (1, 1, "O"), (1, 2, "I-ID_NUM")], "document long, token int, label string")
    assert bio_to_spans(lone).count() == 2


def test_running_best_and_patience(spark):
    from piisieve.operators.runlog import early_stop
    log = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.4)], "run_id long, step long, lb double")
    rows, stops = early_stop(log, "run_id", ["step"], "lb", patience=1)
    got = [(r.is_best, r.patience_counter) for r in rows.orderBy("step").collect()]
    assert got == [(True, 0), (True, 0), (False, 1)]
    assert stops.first().stop_step == 3


def test_auc_ties(spark):
    from piisieve.operators.metrics_extra import roc_auc
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (2.0, 1)], "s double, y int")
    assert roc_auc(df, "s", "y").first().roc_auc == 0.75


def test_taxonomy_must_end_with_outside():
    with pytest.raises(ValueError):
        taxonomy(["B-EMAIL", "O", "I-EMAIL"])
    with pytest.raises(ValueError):
        taxonomy(["O", "O"])


def test_convert_labels_reduced(spark):
    from piisieve.functions.labels import convert_labels
    df = spark.createDataFrame([("B-EMAIL",), ("I-ID_NUM",), ("O",), ("B-LOC",)], "label string")
    out = [r.label_id for r in convert_labels(df, "label", "reduced", reduce_bio=True).collect()]
    assert out == [0, 1, 7, -100]


def test_t10_first_and_last_word_of_a_span_agree(spark):
    from piisieve.operators.windows import word_spans
    df = spark.createDataFrame([([-1, 0, 0, 1, 3, 3, 3, -1],)], "word_ids array<int>")
    r = word_spans(df).first()
    assert [(s.word, r.word_ids[s.head], r.word_ids[s.tail - 1]) for s in r.spans] == [(0, 0, 0), (1, 1, 1), (3, 3, 3)]


def test_t11_searching_a_threshold_does_not_change_the_predictions(spark):
    from piisieve.operators import curve as C
    occ = spark.createDataFrame([(1, 0, [0.0] * 11 + [0.2, 0.8]), (1, 1, [0.0] * 11 + [0.05, 0.95])],
                                "document long, token int, probs array<double>")
    gold = spark.createDataFrame([(1, 0, "I-URL_PERSONAL")], "document long, token int, label string")
    out = C.evaluate(occ, gold, cut=None, threshold=0.9, keep="none")
    before = sorted((r.token, r.label) for r in out["pred"].collect())
    out["best"].collect()
    assert sorted((r.token, r.label) for r in out["pred"].collect()) == before
    assert {t for t, label in before if label != "O"} == {0}


def test_a3_means_are_not_rounded_by_default(spark):
    from piisieve.operators.evaluate import apply_threshold, prediction_table
    occ = spark.createDataFrame([(1, 0, [1.0 - 0.90000000001] + [0.0] * 11 + [0.90000000001])],
                                "document long, token int, probs array<double>")
    assert apply_threshold(prediction_table(occ), 0.9).first().label == "O"
    assert apply_threshold(prediction_table(occ, digits=9), 0.9).first().label == "B-EMAIL"


def test_a8_repeated_gold_rows_count_once_and_contradictions_raise(spark):
    import pytest
    from piisieve.operators.evaluate import reference_table, type_counts
    pred = spark.createDataFrame([(7, 0, "B-EMAIL")], "document long, token int, label string")
    twice = spark.createDataFrame([(7, 0, "B-EMAIL")] * 2, pred.schema)
    assert [(r.tp, r.fp, r.fn) for r in type_counts(pred, twice).collect()] == [(1, 0, 0)]
    both = spark.createDataFrame([(7, 0, "B-EMAIL"), (7, 0, "B-ID_NUM")], pred.schema)
    with pytest.raises(Exception, match="two gold labels"):
        type_counts(pred, both).collect()
    essays = spark.createDataFrame([(7, ["a"], ["B-EMAIL"])] * 2, "document long, tokens array<string>, labels array<string>")
    with pytest.raises(ValueError):
        reference_table(essays)


def test_a1_softmax_is_linear_in_its_length(spark):
    import time
    from pyspark.sql import functions as F
    from piisieve.functions.arrays import softmax

    def seconds(n):
        df = spark.range(2000).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i + F.col("id")).cast("double") / n).alias("x"))
        out = df.select(F.aggregate(softmax(F.col("x")), F.lit(0.0), lambda a, v: a + v).alias("s"))
        out.agg(F.sum("s")).collect()
        t = time.time()
        assert abs(out.agg(F.sum("s")).first()[0] - 2000) < 1e-6
        return time.time() - t
    assert seconds(400) < 60 * max(seconds(13), 0.05)
