"""Small tables for the operator tests: odd rows and columns whose names clash with internal ones."""

import random

WORDS = "ab cd ef gh ij kl mn op qr st uv wx yz fox dog sun map key box ink".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 999)) for _ in range(n))


def odd_documents():
    """(doc_id, text, lang, source, n_chars) with copies, near copies, nulls, blanks, repeats and a very long text."""
    rng = random.Random(3)
    base, other, passage = prose(rng, 60), prose(rng, 40), prose(rng, 30)
    words = base.split()
    near = " ".join([*words[:30], "CHANGED", *words[31:]])
    rows = [
        (1, base, "en", "a", len(base)), (2, base, "en", "b", 1), (3, near, "en", None, 1), (4, other, "de", "a", 1),
        (5, None, "en", "a", None), (6, "", None, "b", 0), (7, " \t\n\x0b\x0c\r ", "en", "c", 7),
        (8, "one two three", "en", "c", 13), (9, "One TWO three", "en", "c", 13),
        (10, passage + "\n" + prose(rng, 30), "fr", "c", 1), (11, prose(rng, 25) + " " + passage, "fr", "a", 1),
        (12, "x" * 30_000, "en", "b", 30_000), (13, prose(rng, 6_000), None, "b", 1),
        (14, "é " * 25 + "日本語 " * 5, "fr", "a", 1), (4, other, "de", "a", 1), (None, base, "en", "a", 1),
        (15, "same words here and there again now ok " * 6, "en", "c", 1), (16, "no\u00a0break \u2028 line 👍 end", "es", None, 1),
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=None):
    return spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA).repartition(3)


def with_clashes(df):
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["key", "data", "row", "body", "component", "lines", "cuts", "t", "h", "block", "shards", "a", "b", "node",
             "centre", "bands", "found", "part", "code", "rank", "id", "size", "n_words", "host", "segment", "words"]
    return df.withColumns({n: F.lit("extra") for n in names if n not in df.columns})
