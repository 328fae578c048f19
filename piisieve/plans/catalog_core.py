"""Flagship family: documents -> words -> gold -> windows -> occurrences -> mean -> labels -> scores."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from ..functions.arrays import round_half_away

from ..operators import curve as C
from ..operators import evaluate as E
from ..operators.indexing import by_key
from ..operators.tokenise import explode_words
from ..settings import CUT_TOKEN_MODEL, THRESHOLD_SPAN_MODELS
from . import sql as S
from .registry import read, register
from .synthetic import essays_from_documents, labelled_words, occurrences_from_words, synthetic_occurrences

CUT = CUT_TOKEN_MODEL               # confident-outside cut
DIGITS = 9                          # the queries round means, as their SQL twins do
THRESHOLD = THRESHOLD_SPAN_MODELS   # outside threshold used by the flagship report


def essays(spark, d):
    return essays_from_documents(read(spark, d, "documents", "doc_id", "text"))


def documents(spark, d, *keep):
    """Whole documents dealt out by id before anything is exploded from them: the texts are shuffled once, and the
    means per word and their comparison with the gold words, grouped by (document, token), find every row of a
    document in one partition, so no vector is shuffled."""
    return by_key(read(spark, d, "documents", "doc_id", "text", *keep), "doc_id", "text")


def words(spark, d):
    """Labelled words straight from the documents (scalar rules after the explode)."""
    return labelled_words(documents(spark, d))


def occurrences(spark, d):
    return occurrences_from_words(words(spark, d))


def pred(spark, d):
    return E.prediction_table(occurrences(spark, d), "bio13", CUT, DIGITS)


def gold(spark, d):
    w = words(spark, d)
    return w.filter(F.col("label") != F.lit("O")).select("document", "token", "label")


def counts(spark, d, th=THRESHOLD):
    return E.type_counts(E.keep_entities(E.apply_threshold(pred(spark, d), th)), gold(spark, d))


P_COLS = [f"p{k}" for k in range(13)]
BASE = [S.WORDS, S.LWORDS]
OCC = BASE + [S.occurrences()]
PRED = OCC + [S.pred(CUT)]


@register("tokenise", S.chain(*BASE) + """
SELECT document, token, word, label FROM lwords""")
def q_tokenise(spark, d):
    """S3 + rule labels: one row per word, empty strings kept."""
    return explode_words(essays(spark, d), with_labels=True)


@register("explode_occurrences", S.chain(*OCC) + """
SELECT document, token, CAST(count(*) AS BIGINT) AS n_occ, """ + ", ".join(f"round(sum(p{k}), 9) AS sum_p{k}" for k in range(13)) + """
FROM occ GROUP BY document, token""")
def q_explode_occurrences(spark, d):
    """A2 (+R9): per-window probability arrays from the model hook, zip-exploded per occurrence
    (summarised per word, where its document lies: no vector is shuffled)."""
    from .synthetic import scored_windows
    texts = documents(spark, d).sortWithinPartitions("doc_id")
    occ = E.explode_occurrences(scored_windows(essays_from_documents(texts)))
    return E.sum_occurrences(occ, 13, 9)


@register("drop_confident_outside", S.chain(*OCC) + f"""
SELECT document, token, win AS window, p12 AS outside_prob FROM occ WHERE p12 < {CUT}""")
def q_drop_confident_outside(spark, d):
    """P5: occurrences surviving the strict cut (applied before the mean)."""
    occ = E.drop_confident_outside(occurrences(spark, d), CUT, n_classes=13)
    return occ.select("document", "token", "window", F.col("probs")[12].alias("outside_prob"))


@register("mean_probs", S.chain(*PRED) + f"""
SELECT document, token, {', '.join(P_COLS)} FROM mean""")
def q_mean_probs(spark, d):
    """A3: element-wise mean vector per word over surviving occurrences."""
    p = pred(spark, d)
    return p.select("document", "token", *[F.element_at("probs", k + 1).alias(f"p{k}") for k in range(13)])


@register("prediction_table", S.chain(*PRED) + """
SELECT document, token, outside_prob, most_probable_label FROM pred""")
def q_prediction_table(spark, d):
    """A4 + A5 (D8): outside probability and best entity label per word."""
    return pred(spark, d).select("document", "token", "outside_prob", "most_probable_label")


@register("apply_threshold", S.chain(*PRED, S.labelled(THRESHOLD)) + """
SELECT document, token, label FROM labelled""")
def q_apply_threshold(spark, d):
    """Inclusive outside threshold; everything else becomes 'O'."""
    return E.apply_threshold(pred(spark, d), THRESHOLD).select("document", "token", "label")


@register("keep_entities", S.chain(*PRED, S.labelled(THRESHOLD)) + """
SELECT document, token, label FROM labelled WHERE label <> 'O'""")
def q_keep_entities(spark, d):
    """Entity rows only."""
    return E.keep_entities(E.apply_threshold(pred(spark, d), THRESHOLD)).select("document", "token", "label")


@register("gold_table", S.chain(*BASE, S.GOLD) + """
SELECT document, token, label FROM gold""")
def q_gold_table(spark, d):
    """Gold words without 'O' (posexplode: an empty essay yields no row)."""
    return E.gold_table(essays(spark, d))


@register("reference_table", S.chain(*BASE) + """
SELECT row_id, document, token, label FROM (
  SELECT CAST(row_number() OVER (ORDER BY document, token) - 1 AS BIGINT) AS row_id, document, token, label
  FROM lwords) WHERE label <> 'O'""")
def q_reference_table(spark, d):
    """Gold rows keyed by the global exploded row number (gaps where words are 'O')."""
    return E.reference_table(essays(spark, d), "document")


def _predicted_sql(th=THRESHOLD):
    return [*PRED, S.labelled(th), "predicted AS (SELECT document, token, label FROM labelled WHERE label <> 'O')",
            S.GOLD]


@register("score_sets", S.chain(*_predicted_sql()) + """
SELECT document, token, label, 'tp' AS status FROM (SELECT document, token, label FROM predicted INTERSECT SELECT document, token, label FROM gold)
UNION ALL SELECT document, token, label, 'fp' FROM (SELECT document, token, label FROM predicted EXCEPT SELECT document, token, label FROM gold)
UNION ALL SELECT document, token, label, 'fn' FROM (SELECT document, token, label FROM gold EXCEPT SELECT document, token, label FROM predicted)""")
def q_score_sets(spark, d):
    """tp = P intersect G, fp = P minus G, fn = G minus P on (document, token, label)."""
    p = E.keep_entities(E.apply_threshold(pred(spark, d), THRESHOLD))
    return E.score_sets(p, gold(spark, d))


@register("type_counts", S.chain(*_predicted_sql(), S.type_counts()) + """
SELECT type, tp, fp, fn FROM counts""")
def q_type_counts(spark, d):
    """tp/fp/fn per entity type after exact matching with prefix."""
    return counts(spark, d)


@register("per_type_scores", S.chain(*_predicted_sql(), S.type_counts()) + f"""
SELECT type, tp, fp, fn, {S.prf()} FROM counts WHERE type <> 'O'""")
def q_per_type_scores(spark, d):
    """Precision, recall, F1 and F5 per type."""
    return E.per_type_scores(counts(spark, d))


@register("fbeta_beta2", S.chain(*_predicted_sql(), S.type_counts()) + f"""
SELECT type, tp, fp, fn, {S.prf(beta=2.0)} FROM counts WHERE type <> 'O'""")
def q_fbeta_beta2(spark, d):
    """A11 with beta as a parameter (beta = 2)."""
    return E.per_type_scores(counts(spark, d), beta=2.0)


def _overall_sql(th):
    p = "(CAST(tp AS DOUBLE) / (CAST(tp AS DOUBLE) + CAST(fp AS DOUBLE) + 1e-100))"
    r = "(CAST(tp AS DOUBLE) / (CAST(tp AS DOUBLE) + CAST(fn AS DOUBLE) + 1e-100))"
    f5 = f"(26.0 * {p} * {r}) / (25.0 * {p} + {r} + 1e-100)"
    return S.chain(*_predicted_sql(th), S.type_counts(),
                   "tot AS (SELECT CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(fp), 0) AS BIGINT) AS fp, "
                   "CAST(coalesce(sum(fn), 0) AS BIGINT) AS fn FROM counts)") + f"""
SELECT tp, fp, fn, {p} AS ents_p, {r} AS ents_r, {f5} AS ents_f5, {f5} AS lb FROM tot"""


@register("overall_scores", _overall_sql(THRESHOLD))
def q_overall_scores(spark, d):
    """Micro totals over all types."""
    return E.overall_scores(counts(spark, d))


@register("empty_prediction_scores", _overall_sql(0.4))
def q_empty_prediction_scores(spark, d):
    """A threshold no word passes -> no type rows, all scores 0."""
    return E.overall_scores(counts(spark, d, 0.4))


@register("score_merge", S.chain(*_predicted_sql(), S.type_counts()) + """
SELECT type, tp, fp, fn FROM counts""")
def q_score_merge(spark, d):
    """Counts computed per source set and added up equal the counts of the whole."""
    docs = documents(spark, d, "source")
    es = essays_from_documents(docs, keep=("source",))
    parts = []
    for half in ([f"src{i}" for i in range(0, 10)], None):
        cond = F.col("source").isin(half) if half else ~F.col("source").isin([f"src{i}" for i in range(0, 10)])
        part = es.filter(cond)
        p = E.prediction_table(synthetic_occurrences(part), "bio13", CUT, DIGITS)
        parts.append(E.type_counts(E.keep_entities(E.apply_threshold(p, THRESHOLD)), E.gold_table(part),
                                   ).select("type", "tp", "fp", "fn"))
    return E.merge_counts(*parts)


@register("type_report", S.chain(*_predicted_sql(), S.type_counts()) + """
SELECT type, round(p, 3) AS p, round(r, 3) AS r, round(f1, 3) AS f1, round(f5, 3) AS f5, tp, fp, fn FROM (
  SELECT type, tp, fp, fn, """ + S.prf() + """ FROM counts WHERE type <> 'O')""")
def q_type_report(spark, d):
    """Per-type report, sorted by type, 3 digits."""
    return E.type_report(counts(spark, d))


def _curve_sql():
    return S.chain(*PRED, S.GOLD, S.GRID, """
pt AS (
  SELECT g.grid_idx, g.threshold, p.document, p.token, p.most_probable_label AS label
  FROM grid g JOIN pred p ON p.outside_prob <= g.threshold),
tpc AS (
  SELECT pt.grid_idx, count(*) AS hits FROM pt JOIN gold USING (document, token, label) GROUP BY pt.grid_idx),
npc AS (SELECT grid_idx, count(*) AS npred FROM pt GROUP BY grid_idx),
c AS (
  SELECT g.grid_idx, g.threshold, CAST(coalesce(tpc.hits, 0) AS BIGINT) AS tp,
         CAST(coalesce(npc.npred, 0) - coalesce(tpc.hits, 0) AS BIGINT) AS fp,
         CAST((SELECT count(*) FROM gold) - coalesce(tpc.hits, 0) AS BIGINT) AS fn
  FROM grid g LEFT JOIN tpc USING (grid_idx) LEFT JOIN npc USING (grid_idx))""")


@register("threshold_curve", _curve_sql() + f"""
SELECT grid_idx, threshold, tp, fp, fn, {S.prf()} FROM c""")
def q_threshold_curve(spark, d):
    """A15 (X1): the 24-point curve in one pass (a naive per-threshold join is the oracle)."""
    return C.threshold_curve(pred(spark, d), gold(spark, d)).select(
        "grid_idx", "threshold", "tp", "fp", "fn", "p", "r",
        (F.lit(2.0) * ((F.col("p") * F.col("r")) / (F.col("p") + F.col("r") + F.lit(1e-100)))).alias("f1"), "f5")


@register("curve_points", _curve_sql() + f"""
SELECT round(threshold, 2) AS threshold, round(f5, 4) AS f5 FROM (SELECT threshold, {S.prf()} FROM c)""")
def q_curve_points(spark, d):
    """The printed curve, (threshold to 2 digits, F5 to 4 digits)."""
    return C.curve_points(C.threshold_curve(pred(spark, d), gold(spark, d)))


@register("best_threshold", _curve_sql() + f"""
SELECT threshold AS best_threshold, f5 AS best_f5 FROM (SELECT threshold, {S.prf()} FROM c)
ORDER BY f5 DESC, threshold ASC LIMIT 1""")
def q_best_threshold(spark, d):
    """The lowest threshold with the best F5."""
    return C.best_threshold(C.threshold_curve(pred(spark, d), gold(spark, d)))


@register("submission", S.chain(*_predicted_sql()) + """
SELECT CAST(row_number() OVER (ORDER BY document, token) - 1 AS BIGINT) AS row_id, document, token, label
FROM predicted""")
def q_submission(spark, d):
    """Entity rows with a dense row_id in (document, token) order."""
    return E.submission(pred(spark, d), THRESHOLD)


_CURVE_PARTS = _curve_sql()[len("WITH "):].rstrip()
_BUNDLE_METRICS = ["tp", "fp", "fn", "p", "r", "f5"]


def _long(section: str, name: str, source: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{section}' AS section, CAST({name} AS VARCHAR) AS name, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {source}"
        for m in _BUNDLE_METRICS)


_OVERALL = f"""(SELECT tp, fp, fn, {S.prf()} FROM (SELECT coalesce(sum(tp), 0) AS tp, coalesce(sum(fp), 0) AS fp, coalesce(sum(fn), 0) AS fn FROM counts))"""


@register("evaluate", "WITH " + _CURVE_PARTS + f""",
{S.labelled(THRESHOLD)}, predicted AS (SELECT document, token, label FROM labelled WHERE label <> 'O'),
{S.type_counts()},
cs AS (SELECT grid_idx, threshold, tp, fp, fn, {S.prf()} FROM c),
top AS (SELECT threshold, f5 FROM cs ORDER BY f5 DESC, threshold LIMIT 1)
{_long('overall', "'all'", _OVERALL)}
UNION ALL {_long('type', 'type', f"(SELECT type, tp, fp, fn, {S.prf()} FROM counts WHERE type <> 'O')")}
UNION ALL {_long('curve', 'grid_idx', 'cs')}
UNION ALL SELECT 'curve', CAST(grid_idx AS VARCHAR), 'threshold', threshold FROM cs
UNION ALL SELECT 'best', 'all', 'threshold', threshold FROM top
UNION ALL SELECT 'best', 'all', 'f5', f5 FROM top""")
def q_evaluate(spark, d):
    """The evaluation bundle (overall, per type, curve, best threshold) from one prediction table."""
    out = C.evaluate(occurrences(spark, d), gold(spark, d), "bio13", CUT, THRESHOLD, keep="store", digits=DIGITS)
    return C.bundle_rows(out)
