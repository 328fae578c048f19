"""The pipeline against its operators run by brute force, stage by stage."""

import hashlib
import random
import re

import corpus_pipeline
import numpy as np
from llm_fixtures import documents, odd_documents, prose
from piisieve.llm.queries import piece_model_path
from piisieve.llm.tables import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng, rows = random.Random(11), []
    boiler = prose(rng, 6)
    for i in range(100, 400):
        text = prose(rng, rng.randint(25, 70))
        kind = i % 10
        if kind == 1:
            text = " ".join(w + "###" for w in text.split())
        elif kind == 2 and i > 110:
            text = rows[-10][1] + " extra"  # near copy
        elif kind == 3:
            text = boiler + "\n" + text
        rows.append((i, text, "en", f"s{i % 23}", len(text)))
    return rows + odd_documents()


def labels(spark, tmp, rows):
    df = spark.createDataFrame([(r[0], 0 if "###" in (r[1] or "") else 1, 0) for r in rows if r[0] is not None and r[0] >= 100],
                               "doc_id long, quality int, toxic int")
    df.write.parquet(f"{tmp}/labels.parquet")


def test_stages(spark, tmp_path):
    from test_decision_list import brute as statistics
    from test_line_spread import brute as line_brute
    from test_minhash_dedup import brute as near_brute

    rows = corpus()
    labels(spark, tmp_path, rows)
    docs, seen = documents(spark, rows), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), "stage")
        seen[name] = docs
        if name != "token ids":
            assert docs.columns == COLUMNS
    kept = sorted((r[0] for r in rows if r[0] is not None and "###" not in (r[1] or "") and (s := statistics(r[1]))[0] >= 20
                   and 100 * s[4] <= 30 * s[0]))
    quality = seen["quality rules"].collect()
    assert sorted(r.doc_id for r in quality if r.doc_id is not None) == kept
    cut = line_brute([(r.doc_id, r.text, r.source) for r in quality], 10)
    lines = seen["line dedup"].collect()
    assert sorted(((r.doc_id, r.text) for r in lines), key=str) == sorted(((d, t) for d, t, _, n in cut if not n or t.strip()), key=str)
    assert any(n for *_, n in cut)
    want = {d for d, _, c, k in near_brute([(r.doc_id, r.text) for r in lines]) if k}
    near = seen["near-dedup"].collect()
    assert {r.doc_id for r in near if r.doc_id is not None} == want
    assert {(r.doc_id, r.text) for r in seen["mixing"].collect()} <= {(r.doc_id, r.text) for r in near}
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    ids = {(r.doc_id, tuple(library.encode(r.text, add_bos=True, add_eos=True))) for r in seen["mixing"].collect()}
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in seen["token ids"].collect()} == {
        (d, len(i), hashlib.sha256(np.array(i, dtype="<u4").tobytes()).hexdigest()) for d, i in ids}


def test_run_is_the_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "stage")
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))


def test_empty_documents(spark, tmp_path):
    labels(spark, tmp_path, [])
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.collect() == []


def test_near_dedup_of_shared_and_missing_ids(spark):
    rng = random.Random(6)
    a, b, c, d, e = (prose(rng, 40) for _ in range(5))
    rows = [(1, a), (2, a), (2, b), (None, a), (None, d), (None, d), (3, c), (3, c), (4, e + " more"), (None, e), (5, None), (5, None), (6, "")]
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in rows])
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(
        [(1, a), (2, b), (None, d), (3, c), (4, e + " more"), (5, None), (6, "")], key=str)


def test_near_dedup_of_own_ids_is_the_operator(spark):
    from piisieve.llm.minhash_dedup import near_duplicates

    docs = documents(spark, [r for r in corpus() if r[0] is not None and r[0] >= 100])
    want = {r.doc_id for r in near_duplicates(docs).filter("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want
