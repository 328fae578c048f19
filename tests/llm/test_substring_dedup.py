import hashlib
import random
import re

import numpy as np

from llm_fixtures import documents, prose, with_clashes
from piisieve.llm.substring_dedup import _repeated, longest_repeats, remove_repeats, window_minima
from piisieve.llm.words import hashed_words, run_hashes, window_hashes, word_hashes

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows, size=13):
    """(doc_id, n_words, n_removed, sha256) of rows (doc_id, text)."""
    first = {}
    for doc, text in rows:
        w = WORD.findall(text or "")
        if doc is not None:
            for i in range(len(w) - size + 1):
                k = tuple(w[i:i + size])
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - size + 1):
            if doc is not None and first[tuple(w[i:i + size])] < doc:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in remove_repeats(df).collect()), key=str)


def test_odd_documents(spark):
    df = with_clashes(documents(spark))
    assert result(df) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert remove_repeats(df.limit(0)).collect() == []


def test_passages_in_many_documents(spark):
    rng = random.Random(12)
    passages = [prose(rng, n) for n in (12, 13, 14, 30, 80)]
    few = "a b a b c".split()
    rows = []
    for i in range(150):
        parts = [rng.choice([prose(rng, rng.randint(0, 30)), rng.choice(passages), " ".join(rng.choice(few) for _ in range(20))]) for _ in range(4)]
        rows.append((rng.randint(0, 99), rng.choice([" ", "\n", "\t "]).join(parts)))  # ids repeat
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df) == brute(rows)


def test_kept_text(spark):
    p = " ".join(map(str, range(13)))
    rows = [(1, p), (2, f"x {p}\ny"), (3, p)]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert (got[2].kept_text, got[3].kept_text, got[3].n_removed) == ("x y", "", 13)


def test_levels_double_until_none_survive(spark):
    rng = random.Random(2)
    shared, short = prose(rng, 60), prose(rng, 15)
    rows = [(1, shared + " " + prose(rng, 9)), (2, prose(rng, 5) + " " + shared), (3, short), (4, "q " + short)]
    got = {(r.doc_id, r.pos): r.length for r in longest_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {}
    for doc, at, n in ((1, 0, 60), (2, 5, 60), (3, 0, 15), (4, 1, 15)):
        for size in (13, 26, 52):
            want.update({(doc, at + i): size for i in range(n - size + 1)})
    assert got == want


def test_every_window_keeps_a_representative():
    h = word_hashes([str(i).encode() for i in np.random.default_rng(1).integers(0, 5, 200)])
    found, parts = window_minima(h, 13, 7), window_hashes(h, 7)
    assert all(found[i] == parts[i:i + 7].min() for i in range(len(h) - 12))


def brute_longest(rows, size=13):
    """(doc_id, longest) with every length of every window tried, documents of one word sequence as one."""
    first = {}
    for doc, text in rows:
        w = tuple(WORD.findall(text or ""))
        if doc is not None and len(w) >= size:
            first[w] = min(first.get(w, doc), doc)
    best = dict.fromkeys(first, 0)
    while size <= max(map(len, first), default=0):
        holders = {}
        for w, doc in first.items():
            for i in range(len(w) - size + 1):
                holders.setdefault(w[i:i + size], set()).add(doc)
        for w in first:
            if any(len(holders[w[i:i + size]]) > 1 for i in range(len(w) - size + 1)):
                best[w] = size
        size *= 2
    return sorted(((doc, best.get(tuple(WORD.findall(text or "")), 0) if doc is not None else 0) for doc, text in rows), key=str)


def longest(df):
    return sorted(((r.doc_id, r.longest_repeat) for r in remove_repeats(df, longest=True).collect()), key=str)


def test_longest_of_odd_documents(spark):
    df = with_clashes(documents(spark))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert longest(df) == brute_longest(rows)
    whole = remove_repeats(df, longest=True)
    assert sorted((tuple(r)[:4] for r in whole.collect()), key=str) == brute(rows)
    assert remove_repeats(df.limit(0), longest=True).collect() == []
    alone = spark.createDataFrame([(1, prose(random.Random(1), 40))], "doc_id long, text string")
    assert longest(alone) == [(1, 0)]


def test_longest_by_doubling(spark):
    rng = random.Random(21)
    passages = [prose(rng, n) for n in (12, 13, 25, 26, 27, 52, 120, 230)]
    few = "a b".split()
    rows = []
    for i in range(120):
        parts = [rng.choice([prose(rng, rng.randint(0, 30)), rng.choice(passages), " ".join(rng.choice(few) for _ in range(40))]) for _ in range(4)]
        rows.append((rng.randint(0, 99), " ".join(parts)))  # ids repeat
    rows += [(200 + i, rows[i][1]) for i in range(10)]  # copies
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_longest(rows)
    assert longest(df) == want and {n for _, n in want} >= {0, 13, 26, 104, 208}
    assert sorted((tuple(r)[:4] for r in remove_repeats(df, longest=True).collect()), key=str) == brute(rows)


def test_kept_text_with_longest(spark):
    p = " ".join(map(str, range(30)))
    rows = [(1, p), (2, f"x {p}\ny"), (3, p), (4, "alone")]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True, longest=True).collect()}
    assert (got[2].kept_text, got[3].kept_text, got[1].kept_text) == ("x y", "", None)
    assert [got[i].longest_repeat for i in (1, 2, 3, 4)] == [26, 26, 26, 0]


def test_words_of_many_texts_are_hashed_as_each_alone():
    odd = [b"", b" \t\n", b"a", b" a\x00 a\x00\x00 a", b"\x0b\x0cabcdefgh abcdefg\rabcdefghi ", b"x" * 127 + b" " + b"x" * 128 + b" " + b"x" * 129,
           b"y" * 4000 + b" end", "grüß   \x1f \x85".encode(), b"abcdefgh abcdefgi abcdefghabcdefgh abcdefghabcdefgi", b"last"]
    sizes, first, second = hashed_words(odd)
    words = [w for text in odd for w in text.split()]
    assert sizes.tolist() == [len(text.split()) for text in odd] and len(first) == len(second) == len(words)
    for hashes in (first, second):
        assert len(set(hashes.tolist())) == len(set(words)) == len(set(zip(words, hashes.tolist())))
    assert not set(first.tolist()) & set(second.tolist())
    alone = [hashed_words([text]) for text in odd]
    assert np.concatenate([a[1] for a in alone]).tolist() == first.tolist()
    assert [x.tolist() for x in hashed_words([])] == [[], [], []]


def test_run_hashes_tell_runs_apart():
    rng = np.random.default_rng(3)
    h = hashed_words([" ".join(map(str, rng.integers(0, 3, 3000))).encode()])[1]
    for size in (1, 2, 5, 7, 13, 26):
        runs = [h[i:i + size].tobytes() for i in range(len(h) - size + 1)]
        found = run_hashes(h, size).tolist()
        assert len(found) == len(runs) and len(set(found)) == len(set(runs)) == len(set(zip(runs, found)))
    assert len(run_hashes(h[:4], 5)) == 0


def test_windows_are_compared_without_python(spark):
    rows = spark.createDataFrame([], "k1 long, k2 long, doc_id long, t1 long, pos long, state byte")
    plan = _repeated(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "InArrow" not in plan


def test_a_window_in_very_many_batches(spark):
    rng = random.Random(5)
    common = prose(rng, 14)
    rows = [(i, f"{prose(rng, 6)} {common} {prose(rng, 3)}") for i in range(60)] + [(None, common), (7, prose(rng, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    assert result(df) == brute(rows)
    assert longest(df) == brute_longest(rows)
