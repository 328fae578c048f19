"""Splits, mixtures, samples and the file sources / sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import round_half_away
from ..functions.hashing import unit_hash
from ..operators import evaluate as E
from ..operators import split as M
from ..session import scratch_path, shuffles_released
from ..sources import essays as SE
from ..sources import sinks as SK
from ..sources.json_array import write_json_array
from ..sources.pools import pool_from_table
from ..settings import EXTERNAL_SAMPLING_RATE, RANDOM_SEED
from . import sql as S
from .catalog_core import CUT, DIGITS, PRED, THRESHOLD, _predicted_sql, essays, gold, pred
from .registry import read, register
from .synthetic import essays_from_documents

SEED = RANDOM_SEED
MIX_SETS = ["src1", "src2", "src3", "src4", "src5"]
MIX_WEIGHTS = [0, 1, 2, 0, 1]
COMPETITION = "src0"
SAMPLE_FRAC = EXTERNAL_SAMPLING_RATE
H = "(('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0)"


def docs(spark, d, *cols):
    return read(spark, d, "documents", *cols).withColumnRenamed("doc_id", "document")


@register("split_by_position", """
SELECT document, position, CASE WHEN position % 5 = 0 THEN 'valid' ELSE 'train' END AS split FROM (
  SELECT doc_id AS document, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS position FROM documents)""")
def q_split_by_position(spark, d):
    """M1: fold by position in file order (doc_id order) mod 5."""
    return M.split_by_position(docs(spark, d, "doc_id"), ["document"], 5, 0).select("document", "position", "split")


@register("split_by_key", """
SELECT doc_id AS document, CASE WHEN doc_id % 4 = 0 THEN 'valid' ELSE 'train' END AS split FROM documents""")
def q_split_by_key(spark, d):
    """M2: valid = document % 4 == fold."""
    train, valid = M.split_by_key(docs(spark, d, "doc_id"), "document", 4, 0)
    return train.select("document", F.lit("train").alias("split")).unionByName(
        valid.select("document", F.lit("valid").alias("split")))


@register("split_all_data", """
SELECT doc_id AS document, 'train' AS split FROM documents
UNION ALL SELECT doc_id, 'valid' FROM documents WHERE doc_id % 4 = 0""")
def q_split_all_data(spark, d):
    """M6: all_data keeps every row for training; validation rows stay inside it."""
    train, valid = M.split_by_key(docs(spark, d, "doc_id"), "document", 4, 0, all_data=True)
    return train.select("document", F.lit("train").alias("split")).unionByName(
        valid.select("document", F.lit("valid").alias("split")))


@register("split_random", f"""
SELECT doc_id AS document, CASE WHEN {H.format(f"CAST(doc_id AS VARCHAR) || '|{SEED}'")} < 0.25 THEN 'valid' ELSE 'train' END AS split
FROM documents""")
def q_split_random(spark, d):
    """M3: seeded 75/25 split by key hash."""
    return M.split_random(docs(spark, d, "doc_id"), 0.25, SEED).select("document", "split")


FOLDS_SQL = f"""folds AS (
  SELECT doc_id AS document, CASE WHEN {H.format("source")} < 0.25 THEN 99 ELSE doc_id % 4 END AS kfold FROM documents)"""


def folds(spark, d):
    df = docs(spark, d, "doc_id", "source")
    return df.select("document", F.when(unit_hash(F.col("source")) < 0.25, 99)
                     .otherwise(F.col("document") % 4).cast("int").alias("kfold"))


@register("read_folds", S.chain(FOLDS_SQL) + "SELECT document, kfold FROM folds")
def q_read_folds(spark, d):
    """Fold table written as Parquet and read back with its declared schema."""
    path = scratch_path(spark, "folds")
    folds(spark, d).write.mode("overwrite").parquet(path)
    return SE.read_folds(spark, path)


@register("split_by_folds", S.chain(FOLDS_SQL) + """
SELECT document, 'pre_training' AS mode, 'train' AS split FROM folds WHERE kfold = 99
UNION ALL SELECT document, 'mixed', 'train' FROM folds WHERE kfold <> 0
UNION ALL SELECT document, 'only_comp', 'train' FROM folds WHERE kfold <> 0 AND kfold <> 99
UNION ALL SELECT document, 'only_comp_all', 'train' FROM folds WHERE kfold <> 99
UNION ALL SELECT document, 'mixed_all', 'train' FROM folds
UNION ALL SELECT document, 'valid', 'valid' FROM folds WHERE kfold = 0""")
def q_split_by_folds(spark, d):
    """M4: fold-table modes via left semi joins (and all_data lifting the fold test)."""
    base, f = docs(spark, d, "doc_id"), folds(spark, d)
    out = []
    for mode, all_data, tag in [("pre_training", False, "pre_training"), ("mixed", False, "mixed"),
                                ("only_comp", False, "only_comp"), ("only_comp", True, "only_comp_all"),
                                ("mixed", True, "mixed_all")]:
        train, valid = M.split_by_folds(base, f, mode, 0, all_data)
        out.append(train.select("document", F.lit(tag).alias("mode"), F.lit("train").alias("split")))
    out.append(valid.select("document", F.lit("valid").alias("mode"), F.lit("valid").alias("split")))
    u = out[0]
    for o in out[1:]:
        u = u.unionByName(o)
    return u


@register("dedup_validation", """
SELECT md5(text) AS text_key, min(doc_id) AS document FROM documents GROUP BY md5(text)""")
def q_dedup_validation(spark, d):
    """M5: keep the first row per key (here exact text copies, first by doc_id)."""
    df = docs(spark, d, "doc_id", "text").select(F.md5("text").alias("text_key"), "document")
    return M.dedup_first(df, "text_key", "document")


@register("replicate", """
SELECT doc_id AS document, c AS copy FROM documents, generate_series(1, 3) AS t(c) WHERE doc_id % 4 <> 0""")
def q_replicate(spark, d):
    """M7: competition train rows times comp_multiplier (3)."""
    train, _ = M.split_by_key(docs(spark, d, "doc_id"), "document", 4, 0)
    return M.replicate(train, 3).select("document", "copy")


MIX_VALUES = ", ".join(f"('{s}', {i}, {w})" for i, (s, w) in enumerate(zip(MIX_SETS, MIX_WEIGHTS)))
MIX_SQL = f"""wt(set_name, set_order, weight) AS (VALUES {MIX_VALUES}),
ext AS (
  SELECT d.doc_id AS document, d.source AS set_name, wt.set_order, c AS copy
  FROM documents d JOIN wt ON d.source = wt.set_name, generate_series(1, wt.weight) AS t(c)
  WHERE wt.weight > 0)"""


@register("mix", S.chain(MIX_SQL) + f"""
SELECT document, set_name, copy, 'external' AS role FROM ext
UNION ALL SELECT doc_id, source, 1, 'competition' FROM documents WHERE source = '{COMPETITION}'""")
def q_mix(spark, d):
    """M8: weighted union of named sets (broadcast weight table) plus the competition rows."""
    df = docs(spark, d, "doc_id", "source").withColumnRenamed("source", "set_name")
    ext = M.mix(df, MIX_SETS, MIX_WEIGHTS).select("document", "set_name", "copy", F.lit("external").alias("role"))
    comp = df.filter(F.col("set_name") == COMPETITION).select(
        "document", "set_name", F.lit(1).alias("copy"), F.lit("competition").alias("role"))
    return ext.unionByName(comp)


@register("take_prefix", S.chain(MIX_SQL) + f"""
SELECT document, set_name, copy FROM (
  SELECT *, row_number() OVER (ORDER BY set_order, copy, document) - 1 AS pos FROM ext)
WHERE pos < floor({SAMPLE_FRAC} * (SELECT count(*) FROM ext))""")
def q_take_prefix(spark, d):
    """M9: the first int(0.15 * n) external rows in list order (sets, copies, file order)."""
    df = docs(spark, d, "doc_id", "source").withColumnRenamed("source", "set_name")
    ext = M.mix(df, MIX_SETS, MIX_WEIGHTS)
    return M.take_prefix(ext, SAMPLE_FRAC, ["set_order", "copy", "document"]).select("document", "set_name", "copy")


@register("shuffle", f"""
SELECT doc_id AS document, CAST(row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '|{SEED}'), doc_id) - 1 AS BIGINT) AS shuffle_pos
FROM documents""")
def q_shuffle(spark, d):
    """Seeded permutation by key hash."""
    return M.shuffle(docs(spark, d, "doc_id"), SEED, ["document"]).select("document", "shuffle_pos")


ESSAY_SUMMARY = S.chain(S.WORDS, S.LWORDS) + """
SELECT document, CAST(count(*) AS BIGINT) AS n_tokens, CAST(sum(CASE WHEN label <> 'O' THEN 1 ELSE 0 END) AS BIGINT) AS n_entities,
       CAST(sum(length(word)) AS BIGINT) AS n_chars FROM lwords GROUP BY document"""


def essay_summary(e):
    return e.select("document", F.size("tokens").alias("n_tokens"),
                    F.size(F.filter("labels", lambda x: x != "O")).alias("n_entities"),
                    F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a + F.length(t)).alias("n_chars"))


@register("read_essays", ESSAY_SUMMARY)
def q_read_essays(spark, d):
    """Essays written as JSON and read back with the declared D1 schema."""
    path = scratch_path(spark, "essays")
    e = essays(spark, d).select("document", "full_text", "tokens", "trailing_whitespace", "labels")
    e.write.mode("overwrite").json(path)
    return essay_summary(SE.read_essays(spark, path, multi_line=False))


@register("read_essays_array", ESSAY_SUMMARY)
def q_read_essays_array(spark, d):
    """Essays written as files of one JSON array each and read back in byte ranges."""
    path = scratch_path(spark, "essay-array")
    e = essays(spark, d).select("document", "full_text", "tokens", "trailing_whitespace", "labels")
    write_json_array(e, path)
    return essay_summary(SE.read_essays(spark, path, split=True))


@register("read_mixture", S.chain(S.WORDS, S.LWORDS) + """
SELECT l.document, d.source AS set_name, CAST(count(*) AS BIGINT) AS n_tokens FROM lwords l
JOIN documents d ON d.doc_id = l.document WHERE d.source IN ('src1', 'src2') GROUP BY l.document, d.source""")
def q_read_mixture(spark, d):
    """A mixture stored as Parquet partitioned by set_name; a set filter prunes directories."""
    path = scratch_path(spark, "mixture")
    e = essays(spark, d).join(docs(spark, d, "doc_id", "source"), "document").withColumnRenamed("source", "set_name")
    SE.write_essays_parquet(e.select("document", "tokens", "labels", "set_name"), path, "set_name")
    m = SE.read_mixture(spark, path, ["src1", "src2"])
    return m.select("document", "set_name", F.size("tokens").alias("n_tokens"))


@register("read_mixture_json", S.chain(S.WORDS, S.LWORDS) + """
SELECT l.document, d.source AS set_name, CAST(count(*) AS BIGINT) AS n_tokens,
       CAST(sum(CASE WHEN l.label <> 'O' THEN 1 ELSE 0 END) AS BIGINT) AS n_entities FROM lwords l
JOIN documents d ON d.doc_id = l.document WHERE d.source IN ('src1', 'src2', 'src3') GROUP BY l.document, d.source""")
def q_read_mixture_json(spark, d):
    """Three sets written as one JSON object (set -> essays) and read back by name."""
    path = scratch_path(spark, "mixture-json")
    sets = ["src1", "src2", "src3"]
    own = read(spark, d, "documents", "doc_id", "text", "source").filter(F.col("source").isin(sets))
    e = essays_from_documents(own, keep=("source",))
    SE.write_mixture_json(e.withColumnRenamed("source", "set_name"), path, sets)
    m = SE.read_mixture(spark, path, sets, json_object=True)
    return m.select("document", "set_name", F.size("tokens").alias("n_tokens"),
                    F.size(F.filter("labels", lambda x: x != "O")).alias("n_entities"))


SUB_SQL = S.chain(*_predicted_sql()) + """
SELECT CAST(row_number() OVER (ORDER BY document, token) - 1 AS BIGINT) AS row_id, document, token, label FROM predicted"""


@register("write_submission", SUB_SQL)
def q_write_submission(spark, d):
    """Submission CSV written by all tasks and read back."""
    path = scratch_path(spark, "submission")
    SK.write_submission(E.submission(pred(spark, d), THRESHOLD), path)
    return SK.read_submission(spark, path)


OUTPUT_CUTS = (0.9, 0.97, 0.99, 0.99)  # thresholds of four evaluations in a row; the last two tie


def _scored_sql() -> str:
    p = "(CAST(tp AS DOUBLE) / (tp + fp + 1e-100))"
    r = "(CAST(tp AS DOUBLE) / (tp + fn + 1e-100))"
    return f"""g AS (SELECT document, token, label FROM gold),
ev AS (SELECT step, cut FROM (VALUES {', '.join(f'({i}, {c}::DOUBLE)' for i, c in enumerate(OUTPUT_CUTS))}) v(step, cut)),
said AS (SELECT step, document, token, most_probable_label AS label FROM pred, ev WHERE outside_prob <= cut AND most_probable_label <> 'O'),
hits AS (SELECT step, count(*) AS n, count(g.label) AS tp FROM said LEFT JOIN g USING (document, token, label) GROUP BY step),
scores AS (SELECT step, coalesce(tp, 0) AS tp, coalesce(n, 0) - coalesce(tp, 0) AS fp, (SELECT count(*) FROM g) - coalesce(tp, 0) AS fn
           FROM ev LEFT JOIN hits USING (step)),
f AS (SELECT step, (26.0 * {p} * {r}) / (25.0 * {p} + {r} + 1e-100) AS f5 FROM scores),
chosen AS (SELECT 'best' AS output, max(step) AS step FROM f WHERE f5 = (SELECT max(f5) FROM f) UNION ALL SELECT 'last', max(step) FROM ev)"""


@register("write_best_last", S.chain(*PRED, S.GOLD, _scored_sql()) + """
SELECT output, step, CAST(row_number() OVER (PARTITION BY output ORDER BY document, token) - 1 AS BIGINT) AS row_id, document, token, label
FROM chosen JOIN said USING (step)""")
def q_write_best_last(spark, d):
    """Four evaluations written as last and, if not worse, as best; both read back through their pointers.
    What neither pointer names any more, and what an evaluation or the whole job has read to the end, is deleted."""
    base = scratch_path(spark, "outputs")
    path = scratch_path(spark, "predictions")
    gold_path = scratch_path(spark, "gold")  # four evaluations read the gold words
    with shuffles_released(spark):
        SK.write_predictions(pred(spark, d), path)
        gold(spark, d).write.parquet(gold_path)
        p, g = spark.read.parquet(path), spark.read.parquet(gold_path)
        for step, cut in enumerate(OUTPUT_CUTS):
            labelled = E.keep_entities(E.apply_threshold(p, cut))
            score = E.overall_scores(E.type_counts(labelled, g)).first()["lb"]  # one number
            ranks = scratch_path(spark, "ranks")
            SK.write_outputs(E.submission(p, cut, store=ranks), p, base, step, score)
            SK.drop_old_outputs(spark, base)
            SK.remove(spark, ranks)
            _, p = SK.read_outputs(spark, base, "last")  # the next evaluation reads what this one has written
            if step == 0:
                SK.remove(spark, path)
    SK.remove(spark, gold_path)
    rows = []
    for name in ("best", "last"):
        submission, _ = SK.read_outputs(spark, base, name)
        rows.append(submission.select(F.lit(name).alias("output"), F.lit(SK.read_pointer(spark, base, name)["step"]).alias("step"),
                                      "row_id", "document", "token", "label"))
    return rows[0].unionByName(rows[1])


@register("write_predictions", S.chain(*PRED) + """
SELECT document, token, outside_prob, most_probable_label, """ + ", ".join(f"p{k}" for k in range(13)) + """ FROM pred""")
def q_write_predictions(spark, d):
    """pred_df (probability arrays included) written as Parquet and read back."""
    path = scratch_path(spark, "predictions")
    SK.write_predictions(pred(spark, d), path)
    p = spark.read.parquet(path)
    return p.select("document", "token", "outside_prob", "most_probable_label",
                    *[F.col("probs")[k].alias(f"p{k}") for k in range(13)])


@register("value_pool", """
SELECT 'NATION' AS entity_type, CAST(row_number() OVER (ORDER BY n_name) - 1 AS BIGINT) AS idx, n_name AS value
FROM (SELECT DISTINCT n_name FROM nation)""")
def q_value_pool(spark, d):
    """A value pool built from a table column (dense idx in value order)."""
    return pool_from_table(read(spark, d, "nation", "n_name"), "NATION", "n_name")


@register("preview_entities", S.chain(S.WORDS, S.LWORDS) + """
SELECT document, token, word, label FROM lwords WHERE label <> 'O' AND document IN (
  SELECT DISTINCT document FROM lwords WHERE label <> 'O' ORDER BY document LIMIT 5)""")
def q_preview_entities(spark, d):
    """P10: non-O words of the first 5 essays that have any (a preview: the limit is the feature)."""
    from ..operators.tokenise import explode_words
    w = explode_words(essays(spark, d), with_labels=True).filter(F.col("label") != "O")
    first = w.select("document").distinct().orderBy("document").limit(5)
    return w.join(first, "document", "left_semi")


@register("stage_counts", S.chain(*_predicted_sql()) + f"""
SELECT 'documents' AS stage, CAST(count(*) AS BIGINT) AS n FROM documents
UNION ALL SELECT 'words', count(*) FROM lwords
UNION ALL SELECT 'gold', count(*) FROM gold
UNION ALL SELECT 'occurrences', count(*) FROM occ
UNION ALL SELECT 'kept_occurrences', count(*) FROM occ WHERE p12 < {CUT}
UNION ALL SELECT 'pred', count(*) FROM pred
UNION ALL SELECT 'entities', count(*) FROM predicted""")
def q_stage_counts(spark, d):
    """Row counts per stage: documents from a pruned scan, the rest from two levels of one aggregate
    (occurrences by word, words in total), so the text is split once."""
    from .catalog_core import words
    from .synthetic import N_ENTITY, occurrences_from_words
    occ = occurrences_from_words(words(spark, d), keep=("g",))
    outside = F.col("probs")[N_ENTITY]
    kept = outside < F.lit(CUT)
    per_word = occ.groupBy("document", "token").agg(
        F.first("g").alias("g"), F.count(F.lit(1)).alias("n"), F.count(F.when(kept, 1)).alias("k"),
        F.sum(F.when(kept, outside)).alias("s"))
    entity = round_half_away(F.col("s") / F.col("k"), DIGITS) <= F.lit(THRESHOLD)
    stages = {"words": F.count(F.lit(1)), "gold": F.count(F.when(F.col("g") != N_ENTITY, 1)), "occurrences": F.sum("n"),
              "kept_occurrences": F.sum("k"), "pred": F.count(F.when(F.col("k") > 0, 1)),
              "entities": F.count(F.when((F.col("k") > 0) & entity, 1))}
    one = per_word.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in stages.items()])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).alias("n")) for n in stages])))
    total = docs(spark, d, "doc_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("documents").alias("stage"), "n")
    return rows.unionByName(total)
