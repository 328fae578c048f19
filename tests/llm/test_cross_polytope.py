import math

import numpy as np
from llm_fixtures import with_clashes
from piisieve.llm.cross_polytope import AnnSettings, BestLists, Rotations, exact_neighbours, hadamard, nearest_neighbours, sized
from pyspark.sql import functions as F


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


def search(df, k=10, every=20, settings=None):
    got = {}
    for r in nearest_neighbours(df, F.col("id") % every == 0, k, settings).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in got.items()}


def clustered(n=1500, d=32, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, d))
    x = centres[rng.integers(0, 30, n)] + 0.5 * rng.normal(size=(n, d))
    return {i: x[i].astype(np.float32).astype(np.float64) for i in range(n)}


def test_recall_and_exact_scores(spark):
    vectors = clustered()
    df = with_clashes(table(spark, [(i, v.tolist()) for i, v in vectors.items()]))
    for s in (AnnSettings(), AnnSettings(part_vectors=50, block_queries=5)):
        got = search(df, settings=s)
        want = exact_neighbours(vectors, list(got), 10)
        assert set(got) == {i for i in vectors if i % 20 == 0}
        hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in got)
        assert hits >= 0.95 * 10 * len(got)
        for q, rows in got.items():
            assert [r[0] for r in rows] == list(range(1, 11))
            assert all(math.isclose(s, float(np.linalg.norm(vectors[v] - vectors[q])), rel_tol=1e-12, abs_tol=1e-12) for _, v, s in rows)
            assert all((a[2], a[1]) < (b[2], b[1]) for a, b in zip(rows, rows[1:]))


def test_rows_that_take_no_part_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [-1.0, 0.0, 0.0]), (5, None),
            (6, [0.0, 0.0, 0.0]), (7, [nan, 1.0, 0.0]), (8, [inf, 1.0, 0.0]), (9, [1.0, None, 0.0]), (10, [1.0, 2.0]), (None, [1.0, 0.0, 0.0]),
            (20, [1.0, 1e-30, 0.0]), (20, [0.0, 0.0, 5.0]), (40, []), (60, [nan, nan, nan])]
    got = search(table(spark, rows), k=3)
    assert set(got) == {0, 20}
    assert [v for _, v, _ in got[0]] == [1, 2, 20]
    assert [s for _, _, s in got[0]] == [0.0, 0.0, float(np.float32(1e-30))]
    assert [v for _, v, _ in got[20]] == [0, 1, 2]
    assert [v for _, v, _ in search(table(spark, rows), k=50)[0]] == [1, 2, 20, 3, 4]  # all candidates, if fewer


def test_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0] * 8) for i in range(300)] + [(i, rng.normal(size=8).tolist()) for i in range(300, 400)]
    got = search(table(spark, rows), settings=AnnSettings(part_vectors=64, block_queries=4))
    assert [v for _, v, _ in got[0]] == list(range(1, 11)) and [v for _, v, _ in got[280]] == list(range(10))


def test_doubles_keep_their_precision(spark):
    rows = [(i, [1.0 + i * 1e-12, 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search(df, k=3)
    assert [v for _, v, _ in got[0]] == [1, 2, 3] and got[0][0][2] == abs(rows[1][1][0] - rows[0][1][0])
    whole = spark.createDataFrame([(0, [3, 4]), (1, [0, 1]), (2, None)], "vec_id long, embedding array<int>")
    assert search(whole)[0] == [(1, 1, 18 ** 0.5)]


def test_empty_and_single(spark):
    assert search(table(spark, [])) == {} and search(table(spark, [(0, [1.0, 2.0])])) == {} and search(table(spark, [(5, None)])) == {}


def test_transform_is_orthonormal_and_probes_start_at_home():
    x = np.random.default_rng(1).normal(size=(20, 16))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    s = AnnSettings(tables=3, probes=5)
    r = Rotations(12, s)
    v = np.random.default_rng(2).normal(size=(20, 12))
    home, asked = r.codes(v), r.probe_codes(v).reshape(20, 3, 5)
    assert (asked[:, :, 0] == home).all() and all(len(set(a)) == 5 for q in asked for a in q)


def test_best_lists_over_parts():
    rng = np.random.default_rng(3)
    x, ids = rng.normal(size=(500, 6)), np.arange(500)
    best = BestLists(7)
    for at in range(0, 500, 60):
        best.add(np.array([3, 9]), x[[3, 9]], ids[at:at + 60], x[at:at + 60])
    got = best.flush().to_pandas()
    want = exact_neighbours(dict(zip(ids.tolist(), x)), [3, 9], 7)
    for q in (3, 9):
        assert set(got[got.query_id == q].vec_id) == {v for v, _ in want[q]}


def test_repeated_rows_take_one_place():
    rng = np.random.default_rng(6)
    x, ids = rng.normal(size=(60, 6)), np.arange(60)
    want = exact_neighbours(dict(zip(ids.tolist(), x)), [3, 9], 10)
    nearest = [v for v, _ in want[3]][:1]
    for often in (2, 11):
        for many in (ids, np.array(nearest)):  # every row, or one near row, repeated
            at = np.concatenate([ids, np.repeat(many, often - 1)])
            best = BestLists(10)
            best.add(np.array([3, 9]), x[[3, 9]], at, x[at])
            got = best.flush().to_pandas()
            for q in (3, 9):
                assert sorted(got[got.query_id == q].vec_id) == sorted(v for v, _ in want[q])
    # one id with several different vectors is one candidate at its smallest distance
    best = BestLists(10)
    best.add(np.array([3]), x[[3]], np.concatenate([ids, np.full(30, 7)]), np.concatenate([x, x[[3]] + 1e-3 * rng.normal(size=(30, 6))]))
    got = best.flush().to_pandas()
    assert set(got.vec_id) == {7, *[v for v, _ in want[3] if v != 7][:9]}


def test_ties_keep_the_smallest_ids():
    best = BestLists(4)
    ids = np.arange(5_000)[::-1].copy()
    best.add(np.array([0, 2, 9_999]), np.ones((3, 8)), ids, np.ones((5_000, 8)))
    got = best.flush().to_pandas()
    for q, want in ((0, [1, 2, 3, 4]), (2, [0, 1, 3, 4]), (9_999, [0, 1, 2, 3])):
        assert sorted(got[got.query_id == q].vec_id) == want


def test_repeated_rows_change_no_result(spark):
    vectors = clustered(400, 16)
    rows = [(i, v.tolist()) for i, v in vectors.items()]
    want = search(table(spark, rows))
    assert all(len(v) == 10 for v in want.values())
    assert search(table(spark, rows * 11)) == want


def test_sizes_follow_the_number_of_vectors():
    assert sized(0) == sized(4_999) == AnnSettings()
    assert (sized(51_282).last_axes, sized(51_282).probes) == (32, 46)
    for n in (10 ** 4, 10 ** 6, 10 ** 9):
        assert n / 2_000 < sized(n).last_axes <= n / 1_000


def test_more_hashes_than_two_and_their_probes():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 8))
    for last in (4, 8, 32, 256):
        r = Rotations(8, AnnSettings(tables=3, last_axes=last, probes=12))
        assert math.prod(r.axes[1:]) == last and r.buckets == 16 * 2 ** (len(r.axes) - 1) * last
        codes, probes = r.codes(x), r.probe_codes(x).reshape(40, 3, 12)
        assert (probes[:, :, 0] == codes).all()
        for t in range(3):
            assert ((codes[:, t] >= t * r.buckets) & (codes[:, t] < (t + 1) * r.buckets)).all()
            unit = r.unit(x)
            losses = [np.sort(((v := r._sides(r.rotated(unit, t, h)[:, :a])).max(axis=1, keepdims=True) - v) ** 2, axis=1)
                      for h, a in enumerate(r.axes)]
            for row in range(40):  # the least sums over all choices of axes
                sums = np.zeros(1)
                for at in losses:
                    sums = np.sort((sums[:, None] + at[row][None, :]).reshape(-1))[:5_000]
                got = []
                for c in probes[row, t]:
                    loss, rest = 0.0, int(c) - t * r.buckets
                    for h in reversed(range(len(r.axes))):
                        rest, side = divmod(rest, 2 * r.axes[h])
                        v = r._sides(r.rotated(unit[row:row + 1], t, h)[:, :r.axes[h]])[0]
                        loss += (v.max() - v[side]) ** 2
                    got.append(loss)
                assert np.allclose(got, sums[:12]) and len(set(probes[row, t].tolist())) == 12


def test_recall_with_a_larger_index(spark):
    vectors = clustered()
    df = table(spark, [(i, v.tolist()) for i, v in vectors.items()])
    got = search(df, settings=AnnSettings(last_axes=64, probes=64, broadcast_buckets=0))
    want = exact_neighbours(vectors, list(got), 10)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in got)
    assert hits >= 0.9 * 10 * len(got)
