import math
import re
from collections import Counter

from llm_fixtures import documents, prose, with_clashes
from piisieve.llm.mixing import MixSettings, hypergeometric, mix, split_quotas
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda k: (k is None, k or ""))
    weight, total, full = {k: weights[i % len(weights)] for i, k in enumerate(names)}, sum(sizes.values()), set()
    while True:
        rest, share = total - sum(most * sizes[k] for k in full), sum(weight[k] for k in names if k not in full)
        target = {k: float(most * sizes[k]) if k in full else rest * weight[k] / share for k in names}
        above = {k for k in names if k not in full and target[k] > most * sizes[k]}
        if not above:
            return target
        full |= above


def check(df):
    rows = mix(df).collect()
    sizes, n = Counter(), Counter()
    for r in df.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
        n[r.doc_id, r.source, len(WORD.findall(r.text or ""))] += 1
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == n
    target, taken, largest = brute_targets(sizes), Counter(), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.size * len(r.draws) <= 3 * r.size and all(0 <= d.shard < 16 for d in r.draws)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for k in target:
        assert abs(taken[k] - target[k]) <= largest[k] / 2 + 1
    return rows


def test_odd_documents(spark):
    rows = check(with_clashes(documents(spark)))
    again = mix(documents(spark).repartition(7)).collect()
    assert Counter(str((r.doc_id, r.taken, r.draws)) for r in rows) == Counter(str((r.doc_id, r.taken, r.draws)) for r in again)


def test_small_sources_stop_at_three_times_their_size(spark):
    import random

    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(1, 60)), "en", ("a" if i < 3 else "b" if i < 200 else "c" if i < 204 else None), 1) for i in range(320)]
    got = check(documents(spark, rows))
    assert {len(r.draws) for r in got if r.source == "a"} == {3}


def test_empty_tables(spark):
    assert mix(documents(spark, [])).collect() == []
    got = mix(documents(spark, [(1, None, "en", "a", 0), (2, " ", "en", None, 1)])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0), (0, 0.0, 0)]


def test_hypergeometric_is_the_inverse_distribution(spark):
    n = 5000
    df = spark.range(n).select(hypergeometric(F.lit(50), F.lit(20), F.lit(15), (F.col("id") + 0.5) / n).alias("k"))
    share = {r.k: r["count"] / n for r in df.groupBy("k").count().collect()}
    for k in range(16):
        assert abs(share.get(k, 0) - math.comb(20, k) * math.comb(30, 15 - k) / math.comb(50, 15)) < 1 / n + 1e-9


def test_tree_deals_all_blocks(spark):
    quotas = spark.createDataFrame([("a", 700), ("b", 3), (None, 41), ("z", 0)], "source string, blocks long")
    rows = split_quotas(quotas, MixSettings()).collect()
    total, per_shard = Counter(), Counter()
    for r in rows:
        total[r.source] += r.blocks
        per_shard[r.shard] += r.blocks
    assert total == {"a": 700, "b": 3, None: 41}
    assert max(per_shard.values()) - min(per_shard.values()) <= 4  # halves differ by one block at each level
    for source, blocks in (("a", 700), (None, 41)):
        places = sorted(p for r in rows if r.source == source for p in range(r.first, r.first + r.blocks))
        assert places == list(range(1, blocks + 1))


def test_plan_has_no_python(spark):
    plan = mix(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_targets_under_ties(spark):
    import pytest
    from piisieve.llm.mixing import source_targets

    cases = [{f"s{i}": 8 for i in range(6)}, {"a": 100, "b": 40, "c": 20}, {f"s{i:03}": 8 for i in range(300)}, {f"s{i}": 160 for i in range(6)},
             {"a": 8, "b": 8, None: 8}, {"a": 0, "b": 5, "c": 0}, {"a": 1, "b": 1000, "c": 1, "d": 1000, "e": 7, None: 1}]
    for sizes in cases:
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_targets(df).collect()}
        want = brute_targets(sizes)
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) and got[k] >= 0 for k in sizes)
        assert math.isclose(sum(got.values()), sum(min(3 * n, 1e18) if got[k] >= 3 * n else got[k] for k, n in sizes.items()))
        if all(got[k] < 3 * n for k, n in sizes.items()):
            assert math.isclose(sum(got.values()), sum(sizes.values()))
    with pytest.raises(ValueError):
        mix(documents(spark), MixSettings(max_sources=2))


def test_mix_of_equal_sources(spark):
    import random

    rng = random.Random(3)
    rows = [(i, prose(rng, 8), "en", f"s{i % 60:02}", 1) for i in range(240)]
    got = check(documents(spark, rows))
    assert abs(sum(r.taken for r in got) - 240 * 8) <= 60 * 5
