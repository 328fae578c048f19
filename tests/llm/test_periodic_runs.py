"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import documents, odd_documents, prose, with_clashes
from piisieve.llm.periodic_runs import LEAST_SPACING, collapse_runs, periodic_runs, solve_tile, tiles, word_numbers, z_function
from piisieve.llm.queries import with_planted_runs

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute_runs(words, least=24):
    """(start, length, period): stretches keeping each period, smaller periods first."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 3 * q) and not any(s == i and m == length and q % p == 0 for s, m, p in out.get(i, [])):
                out.setdefault(i, []).append((i, length, q))
            i = j
    return sorted((r for rows in out.values() for r in rows), key=lambda r: (r[0], r[2]))


def brute(text):
    words = WORD.findall(text or "")
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def solved(words):
    """The operator's tiles, solver and stitching rule on one document, without Spark."""
    pieces = {}
    for spacing, low, numbers, boundaries in tiles(word_numbers([w.encode() for w in words])):
        for q, s, e in solve_tile(numbers.tolist(), spacing, boundaries.tolist()):
            pieces.setdefault(q, set()).add((low + s, low + e))
    runs = []
    for q, found in pieces.items():
        merged = []
        for s, e in sorted(found):
            if merged and s <= merged[-1][1] - q:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        runs += [(s, e - s, q) for s, e in merged if e - s >= max(24, 3 * q)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 9)), max_size=8))
def test_tiles_find_all_runs(parts):
    words = [str(x) for block, times in parts for x in block * times]
    assert solved(words) == brute_runs(words)


def test_long_runs_over_many_tiles():
    rng = random.Random(5)
    for period in (1, 2, 7, 8, 15, 16, 17, 31, 63, 64, 100, 513):
        for times in (3, 4, 30):
            block = [str(rng.randint(0, 5)) for _ in range(period)]
            words = prose(rng, rng.randint(0, 40)).split() + (block * (times + 24 // period + 1))[:-1] + prose(rng, 9).split()
            assert solved(words) == brute_runs(words)
    words = ["a"] * 5000
    assert solved(words) == [(0, 5000, 1)]


def test_z_function():
    s = list("aabaabaaab")
    want = [0] + [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]
    assert z_function(s, len(s)) == want


def corpus():
    rng = random.Random(9)
    rows = odd_documents() + [
        (20, "la " * 4000, "en", "a", 1), (21, "la " * 23, "en", "a", 1), (22, "la " * 24, "en", "a", 1),
        (23, " ".join((prose(rng, 400) + " ") * 3), "en", "a", 1), (24, "a b c d e f g h " * 3, "en", "a", 1),
        (25, "a b c d e f g h i " * 3 + "a", "en", "a", 1), (None, "x y " * 30, "en", "a", 1), (None, "x y " * 30, "en", "a", 1),
        (20, "la " * 4000, "en", "a", 1), (20, "lo " * 400 + "la " * 400, "en", "a", 1),
        (26, ("a a b " * 9 + "c ") * 40, "en", "a", 1), (27, "\n".join([prose(rng, 13)] * 50), "en", "a", 1)]
    return rows + [(i, prose(rng, rng.randint(1, 300)), "en", "a", 1) for i in range(100, 200)]


def test_documents(spark):
    rows = corpus()
    got = collapse_runs(with_clashes(documents(spark, rows))).drop("n_words", "n_kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], *brute(r[1]))) for r in rows)
    listed = periodic_runs(documents(spark, rows)).collect()
    want = {(r[0], *run) for r in rows for run in brute_runs(WORD.findall(r[1] or ""))}
    assert sorted(map(str, map(tuple, listed))) == sorted(map(str, want))


def test_planted_runs(spark):
    rows = [r for r in corpus() if r[0] is not None]
    got = {(r.doc_id, r.text) for r in with_planted_runs(documents(spark, rows)).collect()}
    want = set()
    for doc, text, *_ in rows:
        words, h = WORD.findall(text or ""), zlib.crc32(str(doc).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))
        want.add((doc, text))
    assert got == want and sum(1 for r in rows if zlib.crc32(str(r[0]).encode()) % 10 == 0) > 5


def test_collapsed_text(spark):
    got = collapse_runs(documents(spark, [(1, "x " + "a b " * 12 + "y", "en", "a", 1)]), with_text=True).first()
    assert (got.collapsed, got.n_kept, got.start, got.length, got.period) == ("x a b y", 4, 1, 24, 2)


def test_empty_table_and_limits(spark):
    assert collapse_runs(documents(spark, [])).collect() == []
    assert periodic_runs(documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        collapse_runs(documents(spark, []), min_words=3 * LEAST_SPACING - 1)


def test_tile_size_is_bounded():
    numbers = np.zeros(200_000, dtype=np.int32)
    got = list(tiles(numbers))
    assert max(len(t[2]) / max(t[0], 64) for t in got) <= 8 + 6 and sum(len(t[2]) for t in got) <= 2 * 16 * 200_000
