"""Best / last outputs, typed surrogates, user tokenizers, model hook batches, span means."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F


def predictions(spark, n):
    sub = spark.createDataFrame([(i, 1, i, "B-EMAIL") for i in range(n)], "row_id long, document long, token int, label string")
    return sub, sub.select("document", "token", F.array(F.lit(0.5)).alias("probs"))


def test_best_and_last(spark, tmp_path):
    from piisieve.sources import sinks as SK
    base = f"file://{tmp_path}/out"
    assert SK.read_pointer(spark, base, "best") is None
    with pytest.raises(FileNotFoundError):
        SK.read_outputs(spark, base)
    became = [SK.write_outputs(*predictions(spark, n), base, n, s) for n, s in enumerate([0.4, 0.7, 0.7, 0.2, float("nan")], 1)]
    assert became == [True, True, True, False, False]  # a tie replaces
    best, best_pred = SK.read_outputs(spark, base)
    last, _ = SK.read_outputs(spark, base, "last")
    assert (best.count(), best_pred.count(), last.count()) == (3, 3, 5)
    assert SK.read_pointer(spark, base, "best")["step"] == 3 and SK.read_pointer(spark, base, "last")["score"] is None
    assert len(SK.drop_old_outputs(spark, base)) == 3
    assert SK.read_outputs(spark, base)[0].count() == 3 and SK.read_outputs(spark, base, "last")[0].count() == 5


@pytest.mark.parametrize("dies_at", ["write_submission", "write_predictions", "_swap_pointer"])
def test_a_crash_leaves_the_old_outputs(spark, tmp_path, monkeypatch, dies_at):
    from piisieve.sources import sinks as SK
    base = f"file://{tmp_path}/out"
    SK.write_outputs(*predictions(spark, 2), base, 1, 0.5)

    def die(*_a, **_k):
        raise RuntimeError("lost")

    monkeypatch.setattr(SK, dies_at, die)
    with pytest.raises(RuntimeError):
        SK.write_outputs(*predictions(spark, 9), base, 2, 0.9)
    monkeypatch.undo()
    for name in ("best", "last"):
        assert SK.read_pointer(spark, base, name)["step"] == 1 and SK.read_outputs(spark, base, name)[0].count() == 2
    assert SK.write_outputs(*predictions(spark, 9), base, 2, 0.9) and SK.read_outputs(spark, base)[0].count() == 9


def test_permutation_is_one_to_one(spark):
    from piisieve.operators.surrogates import permuted
    for n in (1, 2, 3, 4, 5, 7, 10, 97, 1000):
        places = [r.p for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit("salt"), F.lit(0)).alias("p")).collect()]
        assert sorted(places) == list(range(n))
        other = [r.p for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit("pepper"), F.lit(0)).alias("p")).collect()]
        assert n < 97 or places != other


def test_surrogates_of_several_types(spark):
    from piisieve.operators.redact import pseudonymise
    from piisieve.operators.surrogates import assign_surrogates
    from piisieve.sources.pools import DEMO_POOLS, value_pool
    pool = value_pool(spark)
    rows = [(i, kind, f"{kind} {i % 9}") for kind in DEMO_POOLS for i in range(40)] + [(99, "EMAIL_DOMAIN", None)]
    m = spark.createDataFrame(rows, "doc_id long, type string, match string")
    got = pseudonymise(m, pool, "salt").collect()
    assert len(got) == len(rows)
    for kind, entries in DEMO_POOLS.items():
        by_value = {}
        for r in got:
            if r.type == kind and r.match is not None:
                by_value.setdefault(r.match, set()).add(r.surrogate)
        assert all(len(s) == 1 and s <= set(entries) for s in by_value.values())
        used = [next(iter(s)) for s in by_value.values()]
        assert {used.count(e) for e in entries} == {2, 3}  # nine values, four entries
    assert [r.surrogate for r in got if r.match is None] == [None]
    few = m.filter("match LIKE '% 1' OR match LIKE '% 2' OR match LIKE '% 3'")
    distinct = {(r.type, r.match): r.surrogate for r in pseudonymise(few, pool, "salt").collect()}
    assert len(distinct) == 9 and all(len({s for (t, _), s in distinct.items() if t == k}) == 3 for k in DEMO_POOLS)
    values = few.select(F.col("type").alias("entity_type"), F.col("match").alias("value"))
    known = spark.createDataFrame(
        [tuple(r) for r in assign_surrogates(values, pool, "salt").select("entity_type", "value", "index").collect()], "entity_type string, value string, index long")
    later = {(r.type, r.match): r.surrogate for r in pseudonymise(m.filter("match IS NOT NULL"), pool, "salt", known=known).collect()}
    assert all(later[k] == s for k, s in distinct.items())
    with pytest.raises(ValueError, match="no surrogate pool"):
        pseudonymise(m, pool.filter("entity_type <> 'EMAIL_DOMAIN'"), "salt").count()
    with pytest.raises(ValueError, match="not dense"):
        pseudonymise(m, pool.filter("idx <> 0"), "salt").count()


def windows(spark, sizes):
    rng = random.Random(1)
    rows = [(i, 0, [rng.randint(0, 9) for _ in range(n)]) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "document long, window int, word_ids array<int>").coalesce(1)


def constant_model(value):
    def load():
        import pandas as pd

        return lambda pdf: pd.DataFrame({"document": pdf["document"], "v": [value] * len(pdf)})
    return load


def test_two_loaders_keep_their_models(spark):
    from piisieve.operators.score import score_windows
    w = windows(spark, [3, 4])
    for value in (1, 2, 1, 3):
        got = score_windows(w, loader=constant_model(value), schema="document long, v int").collect()
        assert [r.v for r in got] == [value, value]


def test_length_batches(spark):
    from piisieve.operators.score import score_windows
    sizes = [5, 300, 7, 64, 1, 0, 33, 290, 16, 17, 2]

    def model(pdf):
        import pandas as pd
        widths = [len(x) for x in pdf["word_ids"]]
        assert len(set(widths)) == 1 and widths[0] % 16 == 0 and len(pdf) <= 3  # one padded width a batch
        return pd.DataFrame({"document": pdf["document"], "width": widths, "doubled": [[2 * y for y in x] for x in pdf["word_ids"]]})

    w = windows(spark, sizes)
    got = score_windows(w, model, schema="document long, width int, doubled array<int>", batch_size=3, keep=("window",)).collect()
    want = {r.document: [2 * x for x in r.word_ids] for r in w.collect()}
    assert [r.document for r in got] == list(range(len(sizes)))
    assert {r.document: r.doubled for r in got} == want
    assert sum(r.width for r in got) < sum(-(-max(sizes) // 16) * 16 for _ in sizes) / 2


def test_user_tokenizer(spark):
    from piisieve.operators.tokenizers import split_with_tokenizer, subwords
    rows = [(1, ["alphabet", "b", "", None, "ééééé"], ["B-EMAIL", "O", "O", "O", "odd"]), (2, [], []), (3, None, None)]
    df = spark.createDataFrame(rows, "document long, tokens array<string>, labels array<string>")
    got = {r.document: r for r in split_with_tokenizer(df, subwords(4), "tokens", "bio13").collect()}
    assert got[1].pieces == ["alph", "##abet", "b", "éééé", "##é"] and got[1].word_ids == [0, 0, 1, 4, 4]
    assert got[1].label_ids[0] == got[1].label_ids[1] and got[1].label_ids[2] == 12 and got[1].label_ids[3:] == [-100, -100]
    assert got[2].pieces == got[3].pieces == []
    with pytest.raises(Exception, match="equal length"):
        split_with_tokenizer(df, lambda: lambda docs: [(["x"], []) for _ in docs], "tokens").collect()


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/word_bpe_49k.json"), reason="no tokenizer file")
def test_tokenizer_file(spark):
    from piisieve.operators.tokenizers import split_with_tokenizer, tokenizer_file
    from tokenizers import Tokenizer
    path = "/opt/tokenizers/word_bpe_49k.json"
    words = ["Unbelievable", "results", "for", "John", "!"]
    df = spark.createDataFrame([(1, words)], "document long, tokens array<string>")
    r = split_with_tokenizer(df, tokenizer_file(path), "tokens").first()
    want = Tokenizer.from_file(path).encode(words, is_pretokenized=True, add_special_tokens=False)
    assert (r.pieces, r.word_ids) == (want.tokens, list(want.word_ids)) and set(r.word_ids) <= set(range(5))


def test_span_means(spark):
    from piisieve.operators.metrics_extra import span_mean
    rng = random.Random(2)
    vectors = {k: [rng.uniform(-1, 1) for _ in range(100)] for k in range(5)}
    rows, want = [], {}
    for doc in range(20):
        keys = [rng.randint(0, 7) for _ in range(rng.randint(0, 30))]
        spans = [(w, h, min(len(keys), h + 3)) for w, h in enumerate(range(0, len(keys), 3))]
        rows.append((doc, 0, keys, spans))
        for w, h, t in spans:
            if any(k in vectors for k in keys):
                want[doc, w] = [sum(vectors.get(k, [0.0] * 100)[i] for k in keys[h:t]) / (t - h) for i in range(100)]
    win = spark.createDataFrame(rows, "document long, window int, piece_keys array<long>, spans array<struct<word:int,head:int,tail:int>>")
    vec = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()], "vec_key long, vector array<double>")
    got = {(r.document, r.word): r.mean for r in span_mean(win, vec).collect()}
    assert all(all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got[k], v)) for k, v in want.items())
    assert len(got) == sum(len(r[3]) for r in rows) and all(not any(got[k]) for k in got if k not in want)


def test_half_away_is_the_column_form(spark):
    import numpy as np
    from piisieve.functions.arrays import round_half_away
    from piisieve.operators.metrics_extra import _half_away
    rng = random.Random(3)
    x = [0.0, 0.5e-6, -0.5e-6, 1.0000005, -2.5, 0.1234565, 123.4567895] + [rng.uniform(-2, 2) for _ in range(2000)]
    want = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").coalesce(1).select(round_half_away("x", 6).alias("y")).collect()]
    assert list(_half_away(np.array(x), 6)) == want


def test_scores_are_made_in_calls_of_few_pieces(spark):
    """Many long windows in one Arrow batch reach the model in several calls, in order, each row once."""
    from piisieve.operators.score import CALL_PIECES, score_windows

    def model(pdf):
        pieces = int(pdf["word_ids"].map(len).sum())
        return pdf.assign(call=pieces, n=pdf["word_ids"].map(len))[["document", "n", "call"]]

    long, n = CALL_PIECES // 4, 11
    w = spark.range(n, numPartitions=1).selectExpr("id AS document", f"CASE WHEN id = 5 THEN null ELSE sequence(1, {long}) END AS word_ids")
    w = w.withColumn("word_ids", F.coalesce("word_ids", F.array().cast("array<int>")))
    got = score_windows(w, model, schema="document long, n int, call int").collect()
    assert [(r.document, r.n) for r in got] == [(i, 0 if i == 5 else long) for i in range(n)]
    assert max(r.call for r in got) <= CALL_PIECES
    batched = score_windows(w, model, schema="document long, n int, call int", batch_size=8).collect()
    assert len(batched) == n


def test_span_means_of_windows_that_share_a_key(spark):
    """The arrays of windows meet a key of their own, not their first piece's; floats travel as floats."""
    from piisieve.operators.metrics_extra import span_mean
    win = spark.createDataFrame([(d, w, [5, None, 5, d], [(0, 0, 1), (1, 1, 3), (2, 3, 4)]) for d in range(4) for w in range(3)] + [(9, 0, [], [])],
                                "document long, window int, piece_keys array<long>, spans array<struct<word:int,head:int,tail:int>>")
    vec = spark.createDataFrame([(5, [1.0, 0.5]), (1, [4.0, 8.0])], "vec_key long, vector array<float>")
    out = span_mean(win, vec)
    got = {(r.document, r.window, r.word): (r.n_pieces, r.mean) for r in out.collect()}
    assert len(got) == 36 and all(got[d, w, 0] == (1, [1.0, 0.5]) and got[d, w, 1] == (2, [0.5, 0.25]) for d in range(4) for w in range(3))
    assert all(got[d, w, 2] == (1, [4.0, 8.0] if d == 1 else [0.0, 0.0]) for d in range(4) for w in range(3))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "window " in plan and "cast(vector" not in plan


def test_span_means_as_columns(spark):
    """The mean's dimensions as columns are those of its array, cut or filled with zeros; spans of one piece and of more."""
    from piisieve.operators.metrics_extra import span_mean
    rng = random.Random(4)
    rows = [(d, w, [rng.choice([None, 1, 2, 3, 9]) for _ in range(12)], [(0, 0, 1), (1, 1, 4), (2, 4, 5), (3, 5, 11), (4, 2, 2), (5, 11, 12)]) for d in range(5) for w in range(30)]
    win = spark.createDataFrame([*rows, (7, 0, [9, 9], [(0, 0, 2)]), (8, 0, [], [])],
                                "document long, window int, piece_keys array<long>, spans array<struct<word:int,head:int,tail:int>>")
    vec = spark.createDataFrame([(1, [0.1234565, -2.0, 3.0]), (2, [-0.0, 1e-7]), (3, [7.5, 0.3333333, -0.1234565])], "vec_key long, vector array<double>")
    for digits in (None, 3):
        want = {tuple(r[:6]): [*r.mean, 0.0, 0.0, 0.0] for r in span_mean(win, vec, digits=digits).collect()}
        for names in (("a", "b"), ("a", "b", "c", "d", "e")):
            out = span_mean(win, vec, digits=digits, columns=names)
            assert out.columns == ["document", "window", "word", "head", "tail", "n_pieces", *names]
            got = {tuple(r[:6]): list(r[6:]) for r in out.collect()}
            assert len(got) == 5 * 30 * 5 + 1 and got == {k: [*v, 0.0, 0.0][:len(names)] for k, v in want.items()}


def test_spans_in_numpy_are_those_of_the_lambdas(spark):
    from piisieve.operators.windows import word_spans
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 0, 0, 1, 2, None]) for _ in range(rng.randint(0, 20))]) for i in range(200)] + [(200, None), (201, []), (202, [-1, -1])]
    df = spark.createDataFrame(rows, "document long, word_ids array<int>").repartition(3, "document")
    want, out = word_spans(df), word_spans(df, vectorised=True)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [(f.name, f.dataType.simpleString()) for f in want.schema]
    assert sorted(out.collect()) == sorted(want.collect())
    with pytest.raises(ValueError, match="default rule"):
        word_spans(df, reference_rule=True, vectorised=True)


def test_sums_of_occurrences_are_those_of_a_group_by(spark):
    """Documents that end in, at and beyond a batch, come twice or have one word; and none at all."""
    from piisieve.functions.arrays import round_half_away
    from piisieve.operators.evaluate import sum_occurrences
    rng = random.Random(6)
    rows = [(doc, t, [rng.uniform(0, 1) for _ in range(3)]) for doc, n in enumerate([1, 5, 6, 40, 1, 0, 7, 7, 3, 100, 2]) for w in (0, 1, 1)
            for t in range(w * n // 2, n)]
    occ = spark.createDataFrame(rows, "document long, token int, probs array<double>")
    want = occ.groupBy("document", "token").agg(F.count(F.lit(1)).alias("n_occ"), *[round_half_away(F.sum(F.col("probs")[k]), 9).alias(f"sum_p{k}") for k in range(3)])
    dealt = occ.repartition(3, "document").sortWithinPartitions("document")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sum_occurrences(dealt, 3, 9)
        assert got.columns == want.columns and sum_occurrences(dealt.filter("document < 0"), 3, 9).count() == 0
        got, want = ({(r.document, r.token): tuple(r[2:]) for r in x.collect()} for x in (got, want))
        assert got.keys() == want.keys() and len(got) == len({r[:2] for r in rows})
        assert all(got[k][0] == v[0] and all(math.isclose(a, b, abs_tol=2e-9) for a, b in zip(got[k][1:], v[1:])) for k, v in want.items())
        with pytest.raises(Exception, match="order of their documents"):
            sum_occurrences(occ.coalesce(1).sortWithinPartitions(F.desc("document")), 3, 9).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_packed_arrays_come_back(spark):
    import numpy as np
    from piisieve.operators.metrics_extra import _packed, _unpacked
    arrays = [np.array(x, dtype=np.int64) for x in ([], [0, -1, 127], [128, -129], [2 ** 31, 5], [2 ** 63 - 1, -2 ** 63])]
    data = _packed(arrays)
    assert [a.tolist() for a in _unpacked(data, 5)] == [a.tolist() for a in arrays]
    assert len(data) == 8 * 5 + 5 + 3 + 2 * 2 + 2 * 8 + 2 * 8
