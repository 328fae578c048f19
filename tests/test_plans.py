"""Plan checks: pruning, no Python outside the model hook, one exchange for mean + compare."""

import pytest

from conftest import SF
from piisieve.plans import catalog_core as cc


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned(spark):
    p = plan(cc.pred(spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_no_python_in_flagship(spark):
    p = plan(cc.counts(spark, SF))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in p


def test_mean_is_one_hash_aggregate(spark):
    p = plan(cc.pred(spark, SF))
    assert p.count("Exchange hashpartitioning") == 1
    assert "ObjectHashAggregate" not in p and "SortAggregate" not in p


def test_gold_join_is_hash_join_without_sorting_predictions(spark):
    p = plan(cc.counts(spark, SF))
    assert "ShuffledHashJoin" in p and "SortMergeJoin" not in p


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def query_plan(spark, name):
    import __spark_entry__ as e
    return plan(e.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["match_offsets", "redact", "spans_to_bio"])
def test_rules_scan_the_text_once_without_a_join(spark, no_broadcast, name):
    p = query_plan(spark, name)
    assert p.count("FileScan parquet") == 1 and "Join" not in p and "hashpartitioning" not in p


def test_span_mean_joins_only_the_vectors(spark, no_broadcast):
    p = query_plan(spark, "span_mean")
    assert p.count("FileScan parquet") == 2 and p.count("SortMergeJoin") + p.count("ShuffledHashJoin") == 1


def test_spans_in_the_row_do_not_shuffle(spark, no_broadcast):
    assert "hashpartitioning" not in query_plan(spark, "bio_to_spans")


def test_early_stop_has_few_exchanges(spark, no_broadcast):
    assert query_plan(spark, "early_stop").count("Exchange hashpartitioning") <= 5


def test_wide_rows_are_not_range_sorted(spark):
    from piisieve.operators.split import split_by_position
    from pyspark.sql import functions as F
    df = spark.range(100).select(F.col("id").alias("document"), F.repeat(F.lit("x"), 1000).alias("full_text"))
    out = split_by_position(df, ["document"])
    assert out.filter("split = 'valid'").count() == 20 and "full_text" in out.columns
    assert "rangepartitioning" not in plan(out)  # the keys were ordered before, in a checkpoint


def test_evaluation_uses_one_prediction_table(spark):
    from piisieve.operators import curve as C
    out = C.evaluate(cc.occurrences(spark, SF), cc.gold(spark, SF), keep="store")
    for name in ("curve", "counts", "per_type", "scores"):
        assert "_p0" not in plan(out[name])  # the mean aggregate is behind the stored table
    kept = C.evaluate(cc.occurrences(spark, SF), cc.gold(spark, SF), keep="persist")
    assert kept["scores"].count() == 1 and kept["pred"].count() > 0
    kept["release"]()


def test_no_size_switch_and_no_hidden_shuffle(spark):
    before = spark.conf.get("spark.piisieve.scan.minTasks")
    spark.conf.unset("spark.piisieve.scan.minTasks")
    try:
        assert "RoundRobin" not in plan(cc.words(spark, SF))
    finally:
        spark.conf.set("spark.piisieve.scan.minTasks", before)


def test_mixture_weights_are_broadcast(spark):
    import __spark_entry__ as e
    p = plan(e.queries()["mix"](spark, SF))
    assert "BroadcastHashJoin" in p


def test_vectors_of_words_are_not_shuffled(spark):
    """The texts are dealt out by id; the means per word are then grouped without another exchange."""
    p = plan(cc.pred(spark, SF))
    assert "REPARTITION_BY_NUM" in p and "hashpartitioning(document" not in p and "hashpartitioning(doc_id" in p


def test_partitions_by_key_follow_the_texts(spark):
    from pyspark.sql import functions as F
    from piisieve.operators.indexing import by_key
    df = spark.range(200).select((F.col("id") % 50).alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"))
    out = by_key(df, "doc_id", "text", 1000)
    assert out.rdd.getNumPartitions() == 20 and out.count() == 200
    ids = out.select("doc_id", F.spark_partition_id().alias("p")).distinct()
    assert ids.count() == 50  # all rows of an id lie together
    assert by_key(df.filter("doc_id < 0"), "doc_id", "text").count() == 0


def test_row_index_hands_over_no_table(spark):
    """The offsets of partitions are constants of the plan: no Python worker and no broadcast makes them."""
    from pyspark.sql import functions as F
    from piisieve.operators.indexing import with_row_index
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("k"))
    out = with_row_index(df, ["k"], "ix", num_partitions=7)
    assert "Broadcast" not in plan(out) and "Join" not in plan(out)
    assert all(r.k == r.ix for r in out.collect()) and out.schema["ix"].dataType.simpleString() == "bigint"
    assert with_row_index(df.filter("k < 0"), ["k"], "ix", num_partitions=3).count() == 0


@pytest.mark.parametrize("name", ["mean_probs", "prediction_table", "apply_threshold", "keep_entities", "score_sets", "type_counts",
                                  "per_type_scores", "overall_scores", "type_report", "threshold_curve", "explode_occurrences"])
def test_generated_methods_are_compiled(spark, name):
    """HotSpot leaves methods over 8000 bytes of bytecode to its interpreter, unless a session's JVM flag says otherwise."""
    import re
    import __spark_entry__ as e
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        executed = e.queries()[name](spark, SF)._jdf.queryExecution().executedPlan()
        text = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenString(executed)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < 8000


def test_best_and_last_store_their_gold_words(spark, monkeypatch):
    """Four evaluations read the gold words; they are made from the texts once."""
    from piisieve.plans import catalog_splits as cs
    plans, made = [], cs.E.type_counts
    monkeypatch.setattr(cs.E, "type_counts", lambda p, g: plans.append(plan(g)) or made(p, g))
    assert cs.q_write_best_last(spark, SF).count() > 0
    assert len(plans) == 4 and all("Generate" not in p and "Exchange" not in p for p in plans)


def method_sizes(spark, name):
    """Bytes of the largest generated method of each stage of a query."""
    import re
    import __spark_entry__ as e
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        executed = e.queries()[name](spark, SF)._jdf.queryExecution().executedPlan()
        text = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenString(executed)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]


def test_span_mean_is_compiled(spark):
    """No expression per dimension: with 64 of them the method passed 8000 bytes."""
    assert max(method_sizes(spark, "span_mean")) < 4000
    assert "filter(arrays_zip" not in query_plan(spark, "span_mean")  # runs are not found by interpreted lambdas


def test_vectors_of_the_model_are_not_shuffled(spark):
    """The texts are dealt out by id; what the model hook gives for them is summed where it is made."""
    p = query_plan(spark, "explode_occurrences")
    assert p.count("Exchange") == 1 and "REPARTITION_BY_NUM" in p and "doc_id" in p.split("Exchange hashpartitioning(")[1][:10]


def test_best_and_last_leave_only_what_they_point_to(spark, monkeypatch):
    """Four evaluations leave the outputs that a pointer names, compressed; no checkpoint, no scratch table, no older version."""
    import json
    import os
    from urllib.parse import urlparse
    from piisieve.plans import catalog_splits as cs
    from piisieve.session import ensure_checkpoint_dir
    top = urlparse(ensure_checkpoint_dir(spark)).path
    before, steps, write = set(os.listdir(top)), [], cs.SK.write_outputs

    def written(submission, predictions, base, step, score):
        steps.append((step, predictions.count(), submission.count()))
        return write(submission, predictions, base, step, score)

    monkeypatch.setattr(cs.SK, "write_outputs", written)
    rows = cs.q_write_best_last(spark, SF).groupBy("output", "step").count().collect()
    assert [s[0] for s in steps] == [0, 1, 2, 3] and len({s[1] for s in steps}) == 1 and steps[0][1] > steps[3][2] > 0
    assert {r.output: (r.step, r["count"]) for r in rows}["last"] == (3, steps[3][2])
    left = set(os.listdir(top)) - before
    assert len(left) == 1 and next(iter(left)).startswith("scratch-outputs-")
    base = os.path.join(top, *left)
    named = {json.load(open(os.path.join(base, n)))["version"] for n in ("best", "last")}
    assert set(os.listdir(f"{base}/versions")) == named
    files = [f for v in named for part in ("submission", "predictions") for f in os.listdir(f"{base}/versions/{v}/{part}") if f.startswith("part-")]
    assert files and all(f.endswith((".csv.gz", ".zstd.parquet")) for f in files)


def test_a_stored_row_index_is_the_checkpointed_one(spark, tmp_path):
    from pyspark.sql import functions as F
    from piisieve.operators.evaluate import submission
    label = F.when(F.col("id") % 3 == 0, "B-EMAIL").otherwise("I-EMAIL")
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("document"), F.col("id").cast("int").alias("token"),
                                 (F.col("id") % 5 / 5).alias("outside_prob"), label.alias("most_probable_label"))
    want = sorted(submission(df, 0.5, 7).collect())
    got = submission(df, 0.5, 7, store=f"file://{tmp_path}/ranks")
    assert sorted(got.collect()) == want and [r.row_id for r in want] == list(range(300)) and got.dtypes == submission(df, 0.5, 7).dtypes
    assert submission(df.filter("document < 0"), 0.5, 3, store=f"file://{tmp_path}/none").count() == 0
