import random

from llm_fixtures import documents, with_clashes
from piisieve.llm.language_id import LanguageModel, Scorer, detect_language, fit_language_model
from pyspark.sql import functions as F

SYLLABLES = {"aa": "ba da ga ka la".split(), "bb": "scho mpf nger ich ung".split(), "cc": "ción ez ll ñe os".split()}


def speak(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def corpus(n=240):
    rng = random.Random(9)
    return [(i, speak(rng, lang := "aa bb cc".split()[i % 3], rng.randint(3, 60)), lang, "s", 1) for i in range(n)]


def test_held_out_accuracy(spark):
    df = documents(spark, corpus())
    model = fit_language_model(df.filter("doc_id % 4 <> 2"), docs_per_lang=50, vocab_per_lang=40, grams_per_lang=200)
    found = detect_language(df.filter("doc_id % 4 = 2"), model).collect()
    assert model.langs == ("aa", "bb", "cc") and len(model.words) <= 120
    assert sum(r.lang == r.lang_pred for r in found) == len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_texts(spark):
    model = fit_language_model(documents(spark, corpus()))
    texts = [None, "", "12 345 ² ½ _ ...", "日本語", "BADA", "schompf" * 5000, "kala " * 20_000, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"score": F.lit("old"), "_found": F.lit(1)})
    got = {r.doc_id: (r.lang_pred, r.score) for r in detect_language(df, model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0)
    assert got[3][0] in model.langs and got[4][0] == "aa" and got[5][0] == "bb" and got[6][0] == "aa"


def test_nothing_to_learn(spark):
    none = fit_language_model(documents(spark, [(1, "abc", None, "s", 1), (2, None, "en", "s", 1), (3, "abc", "", "s", 1)]))
    assert none.langs == ()
    assert [(r.lang_pred, r.score) for r in detect_language(documents(spark, [(1, "abc", None, "s", 1)]), none).collect()] == [("und", 0.0)]
    assert fit_language_model(documents(spark, [])).langs == ()
    fit_language_model(with_clashes(documents(spark)))


def test_backoff_uses_the_longest_known_grams():
    model = LanguageModel(("a", "b"), {"known": (-1.0, -5.0)}, {"xyz": (-2.0, -3.0), "x": (-9.0, -1.0)}, 3)
    s = Scorer(model)
    assert s.score_word("known").tolist() == [-1.0, -5.0, 1.0]
    assert s.score_word("qxyz").tolist() == [-2.0, -3.0, 1.0]  # the trigram, not the single letter
    assert s.score_word("xq").tolist() == [-9.0, -1.0, 1.0]
    assert s.score_word("qq").tolist() == [0.0, 0.0, 1.0]
    assert s.predict("qq")[0] == "a"  # a tie goes to the first language


def test_a_full_cache_changes_nothing(monkeypatch):
    import piisieve.llm.language_id as m

    model = LanguageModel(("a", "b"), {}, {c: (-float(i), -float(30 - i)) for i, c in enumerate("abcdefghij")}, 1)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(50)) for _ in range(200)]
    whole = [Scorer(model).predict(t) for t in texts]
    monkeypatch.setattr(m, "CACHE_WORDS", 5)
    one = Scorer(model)
    assert [one.predict(t) for t in texts] == whole


def test_long_runs_teach_their_ngrams(spark):
    import math
    from collections import Counter

    rng = random.Random(5)
    run = {x: ["".join(rng.choice(SYLLABLES[x]) for _ in range(60)) for _ in range(12)] for x in ("aa", "bb")}
    rows = [(i, r, x, "s", 1) for x in run for i, r in enumerate(run[x])] + [(99, "".join(run["aa"]) * 3, "aa", "s", 1)]
    assert min(len(r[1]) for r in rows) > 100
    model = fit_language_model(documents(spark, rows), smoothing=0.5)
    counts = {}
    for _, t, x, *_ in rows:
        for size in range(1, 5):
            marked = f"^{t}$"
            counts.setdefault(size, {}).setdefault(x, Counter()).update(marked[i:i + size] for i in range(len(marked) - size + 1))
    for size, by_lang in counts.items():
        items = set().union(*by_lang.values())
        assert {g for g in model.grams if len(g) == size} == items
        for i, x in enumerate(model.langs):
            total = sum(by_lang[x].values()) + 0.5 * len(items)
            assert all(math.isclose(model.grams[g][i], math.log((by_lang[x][g] + 0.5) / total)) for g in items)
    test = spark.createDataFrame([(1, "".join(rng.choice(SYLLABLES["bb"]) for _ in range(70)))], "doc_id long, text string")
    assert detect_language(test, model).first().lang_pred == "bb"
