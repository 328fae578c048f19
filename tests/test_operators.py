"""Hand-written rows for operators not covered by the trap tests."""

import math

import pytest
from pyspark.sql import functions as F

from piisieve.functions.labels import id_label


def test_pad_arrays_values(spark):
    from piisieve.operators.batches import pad_arrays
    df = spark.createDataFrame(
        [(1, 0, ["[CLS]", "a", "[SEP]"], [-1, 0, -1], [-100, 12, -100], [(0, 1, 2)], 16, 2)],
        "document long, window int, pieces array<string>, word_ids array<int>, label_ids array<int>, "
        "spans array<struct<word:int,head:int,tail:int>>, padded_len int, span_len int")
    r = pad_arrays(df).first()
    assert len(r.pieces) == 16 and r.pieces[3:] == ["[PAD]"] * 13
    assert r.attention_mask == [1, 1, 1] + [0] * 13
    assert r.word_ids[3:] == [-1] * 13 and r.label_ids[3:] == [-100] * 13
    assert [(s.word, s.head, s.tail) for s in r.spans] == [(0, 1, 2), (-1, 14, 16)]


def test_mask_augment_is_keyed_and_skips_specials(spark):
    from piisieve.operators.batches import mask_augment
    df = spark.createDataFrame([(7, 0, ["[CLS]"] + [f"p{i}" for i in range(200)] + ["[SEP]"],
                                 [-1] + list(range(200)) + [-1])],
                               "document long, window int, pieces array<string>, word_ids array<int>")
    a = mask_augment(df, 0.3, seed=5).first().pieces
    b = mask_augment(df, 0.3, seed=5).first().pieces
    c = mask_augment(df, 0.3, seed=6).first().pieces
    assert a == b and a != c
    assert a[0] == "[CLS]" and a[-1] == "[SEP]"
    assert 30 < sum(p == "[MASK]" for p in a) < 90


def test_fold_modes(spark):
    from piisieve.operators.split import split_by_folds
    docs = spark.createDataFrame([(i,) for i in range(6)], "document long")
    folds = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 99), (4, 0), (5, 99)], "document long, kfold int")

    def ids(df):
        return sorted(r.document for r in df.collect())
    tr, va = split_by_folds(docs, folds, "pre_training", 0)
    assert ids(tr) == [3, 5] and ids(va) == [0, 4]
    assert ids(split_by_folds(docs, folds, "mixed", 0)[0]) == [1, 2, 3, 5]
    assert ids(split_by_folds(docs, folds, "only_comp", 0)[0]) == [1, 2]
    assert ids(split_by_folds(docs, folds, "only_comp", 0, all_data=True)[0]) == [0, 1, 2, 4]
    with pytest.raises(ValueError):
        split_by_folds(docs, folds, "nope", 0)


def test_dedup_keeps_first(spark):
    from piisieve.operators.split import dedup_first
    df = spark.createDataFrame([(7, 3, "c"), (7, 1, "a"), (8, 2, "b")], "document long, position int, v string")
    assert sorted((r.document, r.v) for r in dedup_first(df).collect()) == [(7, "a"), (8, "b")]


def test_pseudonyms_are_consistent(spark):
    from piisieve.operators.redact import pseudonymise
    from piisieve.sources.pools import value_pool
    pool = value_pool(spark, {"EMAIL": [f"u{i}@example.org" for i in range(10)]})
    m = spark.createDataFrame([(1, "EMAIL", "a@x.org"), (2, "EMAIL", "a@x.org"), (3, "EMAIL", "b@x.org"), (4, "EMAIL", None)],
                              "doc_id long, type string, match string")
    out = {r.doc_id: r.surrogate for r in pseudonymise(m, pool, "salt").collect()}
    assert out[1] == out[2] != out[3] and out[1].endswith("@example.org") and out[4] is None and len(out) == 4


def test_redact_spans_merges_overlaps(spark):
    from piisieve.operators.redact import redact_spans
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, "abcdefghij"), (3, "abcdefghij"), (4, None), (5, "abc")], "doc_id long, text string")
    spans = spark.createDataFrame(
        [(1, "X", 2, 5), (1, "Y", 3, 8), (1, "Z", 8, 10), (2, "A", 0, 4), (2, "B", 2, 8), (3, "IN", 3, 4), (3, "OUT", 1, 9), (4, "X", 0, 2),
         (5, "E", 1, 1), (5, "F", 2, 99)],
        "doc_id long, type string, start int, end int")
    got = {r.doc_id: r.redacted for r in redact_spans(docs, spans).collect()}
    assert got == {1: "ab[X][Z]", 2: "[A]ij", 3: "a[OUT]j", 4: None, 5: "ab[F]"}


REDACTED = [("see https://x.com/u/ada@x.org/private ok https://y.org/1234567890123456/home",
             "see [URL_PERSONAL] ok [URL_PERSONAL]"),
            ("https://x.com ada@x.org/a", "[URL_PERSONAL] [EMAIL]/a"), ("https://a-b@x.org", "[URL_PERSONAL]"),
            ("n 12345678901234567890123.", "n [ID_NUM]."), ("n 1234567890123456789012345678901 é", "n [ID_NUM] é"),
            ("a.b@c.org,+1 (555) 555-5555", "[EMAIL],[PHONE_NUM]"), ("clean", "clean"), ("", ""), (None, None)]


def test_redact_leaves_nothing_of_overlapping_matches(spark):
    from piisieve.operators.detect import all_match_offsets
    from piisieve.operators.redact import redact, redact_spans
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REDACTED)], "doc_id long, text string")
    want = {i: r for i, (_, r) in enumerate(REDACTED)}
    assert {r.doc_id: r.redacted for r in redact(df).collect()} == want
    assert {r.doc_id: r.redacted for r in redact_spans(df, all_match_offsets(df)).collect()} == want


def test_pseudonymise_text(spark):
    from piisieve.operators.redact import pseudonymise_text
    from piisieve.operators.detect import PATTERN_RULES
    from piisieve.sources.pools import value_pool
    pool = value_pool(spark, {"EMAIL": ["one@example.org"]})
    df = spark.createDataFrame([(1, "a@x.org and b@x.org."), (2, "none"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.pseudonymised for r in pseudonymise_text(df, pool, "s", {"EMAIL": PATTERN_RULES["EMAIL"]}).collect()}
    assert got == {1: "one@example.org and one@example.org.", 2: "none", 3: None}


def test_dictionary_entries_of_several_words(spark):
    from piisieve.operators.detect import detect_entries
    from piisieve.sources.pools import value_pool
    e = spark.createDataFrame([(1, "He lives at 1 Main Street, near Oak .".split(" ")), (2, ["Main"]), (3, [])], "document long, tokens array<string>")
    found = detect_entries(e, value_pool(spark), 4).collect()
    assert [(r.document, r.token, r.n_words, r.entity_type) for r in found] == [(1, 3, 3, "STREET_ADDRESS")]


def test_dictionary_entries_of_any_length(spark):
    from piisieve.operators.detect import detect_entries
    from piisieve.sources.pools import value_pool
    address = "591 Smith Centers Apt. 656\nJoshuamouth, RI 95963"
    pool = value_pool(spark, {"STREET_ADDRESS": [address, address + ", USA", "591 Smith Centers", "Oak", " . "], "PLACE": [address.lower()]})
    text = "at 591 Smith Centers, Apt. 656 - Joshuamouth RI 95963 , USA or 591 Smith Centers Apt. 656 Joshuamouth, RI"
    e = spark.createDataFrame([(1, text.split(" ")), (1, text.split(" ")), (1, ["591"] * 9), (2, []), (None, address.split())],
                              "document long, tokens array<string>")
    want = sorted([(1, 1, 3, "STREET_ADDRESS"), (1, 1, 8, "PLACE"), (1, 1, 8, "STREET_ADDRESS"), (1, 1, 9, "STREET_ADDRESS"),
                   (1, 13, 3, "STREET_ADDRESS")] * 2
                  + [(-1, 0, 3, "STREET_ADDRESS"), (-1, 0, 8, "PLACE"), (-1, 0, 8, "STREET_ADDRESS")])
    # walked by the automaton, then joined: a pool above either size
    for words, bounds in ((3, {}), (1, {"max_entries": 5}), (3, {"max_bytes": 20}), (20, {"max_entries": 0})):
        found = detect_entries(e, pool, words, **bounds).collect()
        assert sorted((-1 if r.document is None else r.document, r.token, r.n_words, r.entity_type) for r in found) == want


def test_dictionary_walk_counts_code_points_and_handles_empty_pools(spark):
    from piisieve.operators.detect import detect_entries
    from piisieve.operators.dictionary import automaton, places
    walker = automaton([("a b", ["X", "Y"], 2), ("b", ["Z"], 1), ("b a", ["X"], 2)])
    assert sorted(places(walker, "\U0001f600 a b a b ab")) == [
        (1, 2, "X"), (1, 2, "Y"), (2, 1, "Z"), (2, 2, "X"), (3, 2, "X"), (3, 2, "Y"), (4, 1, "Z")]
    e = spark.createDataFrame([(1, ["Oak", None, "\U0001f600x", "oak"]), (2, None)], "document long, tokens array<string>")
    none = spark.createDataFrame([("X", " . "), (None, None)], "entity_type string, value string")
    one = spark.createDataFrame([("X", "OAK"), ("X", "oak"), ("X", None)], "entity_type string, value string")
    for bounds in ({}, {"max_entries": 0}):
        assert detect_entries(e, none, **bounds).collect() == []
        assert sorted((r.document, r.token) for r in detect_entries(e, one, **bounds).collect()) == [(1, 0), (1, 3)]


def test_log_loss_of_a_zero_probability(spark):
    from piisieve.operators.metrics_extra import token_log_loss
    df = spark.createDataFrame([([[0.0, 1.0], [0.5, 0.5]], [0, 0])], "probs array<array<double>>, label_ids array<int>")
    assert token_log_loss(df).first().log_loss == math.inf
    r = token_log_loss(df, floor=1e-15).first()
    assert r.n_pieces == 2 and abs(r.log_loss - (-(math.log(1e-15) + math.log(0.5)) / 2)) < 1e-9


def test_mixture_json_object(spark, tmp_path):
    import json
    from piisieve.sources.essays import read_mixture
    essay = {"document": 1, "full_text": "a b", "tokens": ["a", "b"], "trailing_whitespace": [True, False], "labels": ["O", "B-EMAIL"]}
    path = str(tmp_path / "mix.json")
    with open(path, "w") as f:
        json.dump({"competition": [essay, {**essay, "document": 2}], "x": [], "odd name": [{**essay, "document": 3}]}, f)
    rows = read_mixture(spark, path, ["competition", "odd name"], json_object=True).collect()
    assert sorted((r.set_name, r.position, r.document, r.labels[1]) for r in rows) == [
        ("competition", 0, 1, "B-EMAIL"), ("competition", 1, 2, "B-EMAIL"), ("odd name", 0, 3, "B-EMAIL")]
    assert read_mixture(spark, path, json_object=True).count() == 3
    assert read_mixture(spark, path, ["x"], json_object=True).count() == 0
    with pytest.raises(KeyError):
        read_mixture(spark, path, ["competition", "nope"], json_object=True)


def test_essays_from_one_json_array(spark, tmp_path):
    import json
    from piisieve.sources.essays import read_essays
    path = str(tmp_path / "train.json")
    with open(path, "w") as f:
        json.dump([{"document": 7, "full_text": "x", "tokens": ["x"], "trailing_whitespace": [False]}], f, indent=1)
    r = read_essays(spark, path).first()
    assert (r.document, r.tokens, r.labels) == (7, ["x"], None)


def test_model_loader_is_called_once_per_worker(spark):
    from piisieve.operators.score import score_windows, synthetic_model
    df = spark.createDataFrame([(i, 0, [0, 1], [12, 12]) for i in range(40)],
                               "document long, window int, word_ids array<int>, label_ids array<int>").repartition(4)

    def loader():
        calls = []

        def fn(pdf):
            calls.append(1)
            return synthetic_model(pdf)
        return fn
    a = score_windows(df, loader=loader, keep=("label_ids",)).collect()
    b = score_windows(df, synthetic_model).collect()
    assert sorted((r.document, r.probs) for r in a) == sorted((r.document, r.probs) for r in b)
    assert all(r.label_ids == [12, 12] for r in a)
    with pytest.raises(ValueError):
        score_windows(df)


def test_spans_to_bio_multiword(spark):
    from piisieve.operators.spans import spans_to_bio
    words = spark.createDataFrame([(1, 0, 0, 4), (1, 1, 5, 8), (1, 2, 9, 14), (1, 3, 15, 18)],
                                  "document long, token int, start int, end int")
    spans = spark.createDataFrame([(1, "s1", "PHONE_NUM", 5, 14)], "document long, span_id string, type string, start int, end int")
    got = sorted((r.token, r.label) for r in spans_to_bio(words, spans, bucket=4).collect())
    assert got == [(1, "B-PHONE_NUM"), (2, "I-PHONE_NUM")]


def test_log_loss_ignores_minus_100(spark):
    from piisieve.operators.metrics_extra import token_log_loss
    df = spark.createDataFrame([([[0.5, 0.5], [0.25, 0.75], [0.9, 0.1]], [0, -100, 1])],
                               "probs array<array<double>>, label_ids array<int>")
    r = token_log_loss(df).first()
    assert r.n_pieces == 2 and abs(r.log_loss - (-(math.log(0.5) + math.log(0.1)) / 2)) < 1e-12


def test_softmax_and_id_label_default(spark):
    from piisieve.operators.metrics_extra import softmax_probs
    p = softmax_probs(spark.createDataFrame([([1.0, 2.0, 3.0],)], "logits array<double>")).first().probs
    assert abs(sum(p) - 1.0) < 1e-12 and p[2] > p[1] > p[0]
    df = spark.createDataFrame([(0,), (12,), (-100,)], "i int")
    assert [r.l for r in df.select(id_label(F.col("i"), "bio13", default="O").alias("l")).collect()] == ["B-EMAIL", "O", "O"]


def test_mixture_json_is_many_bounded_objects(spark, tmp_path):
    import glob
    import json
    from piisieve.sources.essays import read_mixture, write_mixture_json
    rows = [("hot", 1 + i // 2, ["a", str(i)], ["O", "B-EMAIL"]) for i in range(50)] + [("odd name", 7, [], []), ("other", 8, ["x"], ["O"])]
    df = spark.createDataFrame(rows, "set_name string, document long, tokens array<string>, labels array<string>")
    path, sets = str(tmp_path / "mix"), ["hot", "odd name", "none"]
    write_mixture_json(df, path, sets, block_essays=8)
    files = [open(f).read().splitlines() for f in glob.glob(path + "/part-*.json")]
    assert max(len(f) for f in files) == 1
    sizes = [sum(len(v) for v in json.loads(f[0]).values()) for f in files if f]
    assert sum(sizes) == 51 and max(sizes) == 8
    got = read_mixture(spark, path, sets, json_object=True).collect()
    assert sorted((r.set_name, r.document, r.tokens, r.labels) for r in got) == sorted(r for r in rows if r[0] != "other")
    write_mixture_json(df.limit(0), path, sets)
    assert read_mixture(spark, path, sets, json_object=True).count() == 0


def test_rounding_half_away_of_odd_values(spark):
    """The short form equals floor and exact remainder, value by value."""
    import math
    import random
    from piisieve.functions.arrays import round_half_away
    rng = random.Random(5)
    values = [0.0, -0.0, 0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, 1e-320, 4503599627370495.5, 2.0 ** 52, -2.0 ** 53, 1e300,
              float("inf"), float("-inf"), *[rng.uniform(-2, 2) for _ in range(200)], *[rng.randrange(-999, 999) / 8 for _ in range(200)]]

    def plain(x, digits):
        y = abs(x) * 10.0 ** digits
        if y >= 2.0 ** 52:
            return x
        fl = float(math.floor(y))
        return math.copysign(1.0 if x else 0.0, x) * (fl + (1.0 if y - fl >= 0.5 else 0.0)) / 10.0 ** digits
    df = spark.createDataFrame([(v,) for v in [*values, float("nan"), None]], "x double")
    for digits in (0, 2, 9):
        found = [r[0] for r in df.select(round_half_away("x", digits)).collect()]
        assert [repr(f) for f in found[:-2]] == [repr(plain(v, digits)) for v in values]
        assert math.isnan(found[-2]) and found[-1] is None
