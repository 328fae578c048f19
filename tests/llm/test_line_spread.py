import random

from llm_fixtures import documents, prose, with_clashes
from piisieve.llm.line_spread import LineSpreadSettings, boilerplate_lines, remove_boilerplate

BLANKS = " \t\x0b\x0c\r"


def brute(rows, limit):
    """Rows of (doc_id, text, source) -> sorted (doc_id, text, n_lines, n_removed)."""
    sites, first = {}, {}
    for doc, text, source in rows:
        for line in (text or "").split("\n") if text is not None else []:
            k = line.strip(BLANKS)
            if k:
                sites.setdefault(k, set()).add(source)
                if doc is not None:
                    first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text, source in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if not (len(sites.get(x.strip(BLANKS), ())) >= limit and doc is not None and doc > first[x.strip(BLANKS)])]
        out.append((doc, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def result(df, settings):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in remove_boilerplate(df, settings).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    common = [prose(rng, 5) for _ in range(12)]
    rows = []
    for i in range(240):
        lines = [rng.choice(common[: 1 + i % 12]) if rng.random() < 0.4 else prose(rng, 4) for _ in range(rng.randint(0, 9))]
        lines = [rng.choice(["", " ", "\t"]) + x + rng.choice(["", " ", "\r"]) for x in lines]
        rows.append((i, "\n".join(lines), rng.choice([None, *(f"s{k}" for k in range(1 + i % 17))])))
    rows += [(3, rows[3][1], rows[3][2]), (3, "another text\n" + common[0], "s1"), (None, common[0] + "\nx", "s2"), (500, None, "s1"),
             (501, "", "s2"), (502, "\n\n", "s3"), (503, common[0] + "\n", "s4"), (504, common[0], "s5")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for limit in (2, 5, 10):
        assert result(df, LineSpreadSettings(min_sites=limit)) == brute(rows, limit)


def test_sketches_decide_far_lines_and_counts_the_near_ones(spark):
    limit = 100  # the margin is about nine sites
    rows = [(i, f"far\nnear\nbelow\nown {i}", f"s{i}") for i in range(60)]
    rows += [(i, "far\nnear", f"s{i}") for i in range(60, 99)] + [(i, "far", f"s{i}") for i in range(99, 400)]
    rows += [(1000, "near", "s0"), (1001, "near", "s7")]  # 99 sites, 101 lines
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = boilerplate_lines(df, LineSpreadSettings(min_sites=limit)).collect()
    assert len(found) == 1
    more = df.unionByName(spark.createDataFrame([(2000, "near", "s99")], df.schema))
    assert len(boilerplate_lines(more, LineSpreadSettings(min_sites=limit)).collect()) == 2


def test_odd_documents_keep_their_other_columns(spark):
    df = with_clashes(documents(spark))
    out = remove_boilerplate(df, LineSpreadSettings(min_sites=2))
    assert out.columns == [c for c in df.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    assert result(df, LineSpreadSettings(min_sites=2)) == brute(rows, 2)
    assert remove_boilerplate(df.limit(0)).collect() == []
