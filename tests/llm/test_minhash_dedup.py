import random
import re

import numpy as np

from llm_fixtures import documents, prose, with_clashes
from piisieve.llm.components import connected_components
from piisieve.llm.minhash_dedup import NearDupSettings, OutlierBlock, band_keys, near_duplicates, shingle_set

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """doc_id -> (set size, component): all pairs, rows with one id are one document."""
    rows = [r for r in rows if r[0] is not None]
    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def got(df, settings=NearDupSettings()):
    return sorted((tuple(r) for r in near_duplicates(df, settings).collect() if r.doc_id is not None))


def test_odd_documents(spark):
    df = with_clashes(documents(spark))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(df) == brute(rows)
    null_row = [r for r in near_duplicates(df).collect() if r.doc_id is None]
    assert len(null_row) == 1 and null_row[0].component_id is None and null_row[0].kept


def edited(rng, words, edits):
    words = list(words)
    for i in rng.sample(range(len(words)), edits):
        words[i] = f"new{rng.randint(0, 10**9)}"
    return " ".join(words)


def test_groups_near_the_limit(spark):
    """Groups whose members often miss the centre: every link counts, also between two outliers."""
    rng, rows = random.Random(1), []
    for g in range(6):
        words = prose(rng, 90).split()
        rows += [(len(rows) + k, edited(rng, words, rng.randint(0, 4))) for k in range(25)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(df) == brute(rows)
    small = NearDupSettings(members_per_task=2, outlier_block=2, member_block=3)  # many parts and blocks
    assert got(df, small) == brute(rows)


def test_empty_table_and_no_links(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).collect() == []
    apart = [(1, "a b c d e f"), (2, "g h i j k l")]
    assert got(spark.createDataFrame(apart, "doc_id long, text string")) == brute(apart)


def test_short_sets_still_collide():
    """Densified signatures of small sets agree like those of large ones."""
    rng, hits, pairs = random.Random(2), 0, 300
    for _ in range(pairs):
        words = prose(rng, 14).split()  # 10 shingles; one changed end word leaves 9 of 11
        a = shingle_set(" ".join(words).encode(), 5)
        b = shingle_set(" ".join([*words[:-1], "other"]).encode(), 5)
        hits += bool(set(band_keys(a, 32, 4).tolist()) & set(band_keys(b, 32, 4).tolist()))
    assert hits == pairs


def test_block_counts_what_sets_have_in_common():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(8)]
    block = OutlierBlock([(i, i, s) for i, s in enumerate(sets)])
    x = np.unique(rng.integers(0, 60, 40).astype(np.uint64))
    assert block.common(x).tolist() == [len(np.intersect1d(s, x)) for s in sets]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
