"""Word labels by a sweep over borders (R4) and profiles merged from stored sketches."""
import random

import pytest
from pyspark.sql import functions as F


def _brute(words, spans):
    out = []
    for doc, sid, kind, s, e in spans:
        if s is None or e is None:
            continue
        met = sorted(t for d, t, a, b in words if d == doc and a is not None and a < e and s < b)
        out += [(doc, t, sid, kind, ("B-" if t == met[0] else "I-") + kind) for t in met]
    return sorted(out)


def _case(seed):
    rng = random.Random(seed)
    words, spans = [], []
    for doc in range(4):
        at = rng.randrange(3)
        for token in range(rng.choice([0, 1, 7, 60])):
            size = rng.choice([0, 1, 1, 2, 5, 40])
            words.append((doc, token, at, at + size))
            at += size + rng.choice([0, 1, 1, 3])
        spans.append((doc, f"all{doc}", "ALL", 0, at + 5))  # over the whole text
        for k in range(12):
            s = rng.randrange(at + 3)
            spans.append((doc, f"s{k}", rng.choice("XY"), s, s + rng.choice([0, 1, 2, 9, 70])))
    spans += [(9, "no words", "X", 0, 4), (0, "null", "X", None, 3), (0, "backwards", "X", 9, 2)]
    return words, spans


WORDS = "document long, token int, start int, end int"
SPANS = "document long, span_id string, type string, start int, end int"


@pytest.mark.parametrize("seed,block", [(1, 8), (2, 16), (3, 4096)])
def test_sweep_equals_brute_force(spark, seed, block):
    from piisieve.operators.spans import spans_to_bio_sweep
    words, spans = _case(seed)
    got = spans_to_bio_sweep(spark.createDataFrame(words, WORDS), spark.createDataFrame(spans, SPANS), block=block)
    assert got.columns == ["document", "token", "span_id", "type", "label"]
    assert sorted(tuple(r) for r in got.collect()) == _brute(words, spans)


def test_sweep_without_rows(spark):
    from piisieve.operators.spans import spans_to_bio_sweep
    words, spans = _case(4)
    none_w, none_s = spark.createDataFrame([], WORDS), spark.createDataFrame([], SPANS)
    assert spans_to_bio_sweep(none_w, spark.createDataFrame(spans, SPANS)).collect() == []
    assert spans_to_bio_sweep(spark.createDataFrame(words, WORDS), none_s).collect() == []


def test_sweep_keeps_one_row_a_side(spark):
    """No explode before the sweep: a long span is one row in each sweep (a join by buckets repeats it)."""
    from piisieve.operators.spans import spans_to_bio_sweep
    words, spans = _case(5)
    plan = spans_to_bio_sweep(spark.createDataFrame(words, WORDS), spark.createDataFrame(spans, SPANS))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.index("Generate explode") < plan.index("Window")


def _matches(spark, ids):
    return spark.range(ids).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "EMAIL").otherwise("PHONE").alias("type"),
                                   F.when(F.col("id") % 5 > 0, F.concat(F.lit("s"), F.col("id") % 2)).alias("source"))


def test_days_merge_to_the_whole(spark, tmp_path):
    from piisieve.operators.profile import profile_sketches, read_profile, write_profile
    m = _matches(spark, 1200)
    m = m.unionByName(m.filter("doc_id % 4 = 0"))  # documents with two matches
    # every document comes on two days: distinct documents must not double
    for day in range(3):
        write_profile(m.filter(F.col("doc_id") % 3 != day), str(tmp_path / "days"), f"d{day}")
    write_profile(m.unionByName(m), str(tmp_path / "whole"), "d")
    key = lambda r: (str(r["type"]), str(r["source"]), r["level"])
    days = sorted(map(tuple, read_profile(spark, str(tmp_path / "days")).collect()), key=str)
    whole = sorted(map(tuple, read_profile(spark, str(tmp_path / "whole")).collect()), key=str)
    assert days == whole
    exact = m.rollup("type", "source").agg(F.grouping_id().cast("int").alias("level"), (2 * F.count("*")).alias("n_entities"),
                                           F.countDistinct("doc_id").alias("n_documents"))
    assert days == sorted(map(tuple, exact.collect()), key=str)
    assert len({key(r) for r in exact.collect()}) == len(days)  # a null source and a total are two rows
    assert profile_sketches(m.limit(0)).collect() == []


def test_rewritten_day_and_chosen_days(spark, tmp_path):
    from piisieve.operators.profile import read_profile, write_profile
    path, m = str(tmp_path / "p"), _matches(spark, 90)
    total = lambda days=None: read_profile(spark, path, days).filter("level = 3").select("n_entities", "n_documents").first()
    write_profile(m, path, "2024-01-01")
    write_profile(m.filter("doc_id < 60"), path, "2024-01-02")
    assert tuple(total()) == (150, 90) and tuple(total(["2024-01-02"])) == (60, 60)
    write_profile(m.filter("doc_id < 10"), path, "2024-01-01")
    assert tuple(total()) == (70, 60)


def test_large_sketch_within_its_error(spark, tmp_path):
    from piisieve.operators.profile import read_profile, standard_error, write_profile
    path = str(tmp_path / "p")
    for day in range(4):
        write_profile(spark.range(day * 30_000, day * 30_000 + 60_000).selectExpr("id AS doc_id", "'EMAIL' AS type", "'s' AS source"), path, f"d{day}")
    got = read_profile(spark, path).filter("level = 0").first()
    assert got["n_entities"] == 240_000
    assert abs(got["n_documents"] - 150_000) <= 4 * standard_error() * 150_000
