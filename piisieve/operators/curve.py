"""One-pass threshold sweep (A15, X1) and the evaluation bundle.

At threshold t the predicted set is {outside_prob <= t}; it only grows with t. Every prediction
is mapped to the first grid index that admits it, predictions and gold are cogrouped once, and
the curve is a cumulative sum over at most 25 buckets, instead of 24 full rescoring passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import round_half_away

from ..functions.metrics import prf_columns
from ..session import scratch_path
from .evaluate import (KEYS, apply_threshold, compare, keep_entities, overall_scores, per_type_scores,
                       prediction_table, submission, type_counts)

# ---- fixed values: the reference sweeps linspace(0.75, 0.99, 24); literals, so that no engine
# recomputes them (rounded to 2 digits the points skip 0.87) ----
THRESHOLD_GRID = [
    0.75, 0.7604347826086957, 0.7708695652173913, 0.7813043478260869, 0.7917391304347826,
    0.8021739130434783, 0.8126086956521739, 0.8230434782608695, 0.8334782608695652,
    0.8439130434782609, 0.8543478260869565, 0.8647826086956522, 0.8752173913043478,
    0.8856521739130434, 0.8960869565217391, 0.9065217391304348, 0.9169565217391304,
    0.9273913043478261, 0.9378260869565217, 0.9482608695652174, 0.9586956521739131,
    0.9691304347826086, 0.9795652173913043, 0.99,
]
# ---- end of fixed values ----


def grid_table(spark: SparkSession, grid=THRESHOLD_GRID) -> DataFrame:
    return spark.createDataFrame([(i, float(t)) for i, t in enumerate(grid)], "grid_idx int, threshold double")


def threshold_curve(pred: DataFrame, gold: DataFrame, grid=THRESHOLD_GRID, beta: float = 5.0) -> DataFrame:
    """(grid_idx, threshold, tp, fp, fn, p, r, f<beta>) for every grid point."""
    spark = pred.sparkSession
    n = len(grid)
    grid_arr = F.array(*[F.lit(float(t)) for t in grid])
    # no point of the grid admits a word beyond its last threshold: such words need not meet the gold words
    outside = F.col("outside_prob")
    c = compare(pred.filter(outside.isNull() | (outside <= F.lit(float(max(grid))))), gold, "most_probable_label", extra=("outside_prob",))
    bucket = F.size(F.filter(grid_arr, lambda g: g < F.col("outside_prob")))
    per_bucket = c.groupBy(F.when(F.col("p_label").isNotNull(), bucket).alias("bucket")).agg(
        F.sum(F.when(F.col("p_label") == F.col("g_label"), 1).otherwise(0)).cast("long").alias("hit"),
        F.sum(F.when(F.col("p_label").isNotNull() & ~F.coalesce(F.col("p_label") == F.col("g_label"), F.lit(False)),
                     1).otherwise(0)).cast("long").alias("miss"),
        F.sum(F.when(F.col("g_label").isNotNull(), 1).otherwise(0)).cast("long").alias("n_gold"))
    # at most n + 2 rows from here on: bucket b counts for every grid index >= b
    idx = F.col("grid_idx")
    spread = (per_bucket.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("grid_idx"), "bucket",
                                "hit", "miss", "n_gold")
              .groupBy("grid_idx").agg(
                  F.sum(F.when(F.col("bucket") <= idx, F.col("hit")).otherwise(0)).cast("long").alias("tp"),
                  F.sum(F.when(F.col("bucket") <= idx, F.col("miss")).otherwise(0)).cast("long").alias("fp"),
                  F.sum("n_gold").cast("long").alias("n_gold")))
    curve = (grid_table(spark, grid).join(spread, "grid_idx", "left")
             .select("grid_idx", "threshold",
                     F.coalesce("tp", F.lit(0)).cast("long").alias("tp"),
                     F.coalesce("fp", F.lit(0)).cast("long").alias("fp"),
                     (F.coalesce("n_gold", F.lit(0)) - F.coalesce("tp", F.lit(0))).cast("long").alias("fn")))
    p, r, _, fb = prf_columns(beta=beta)
    return curve.select("grid_idx", "threshold", "tp", "fp", "fn", p.alias("p"), r.alias("r"), fb.alias(f"f{beta:g}"))


def curve_points(curve: DataFrame, score: str = "f5") -> DataFrame:
    """The reference's printed curve: (threshold rounded to 2, F-beta rounded to 4)."""
    return curve.select(round_half_away("threshold", 2).alias("threshold"), round_half_away(score, 4).alias(score))


def best_threshold(curve: DataFrame, score: str = "f5") -> DataFrame:
    """Best F-beta; strict improvement, so the lowest threshold wins ties (24 rows, one task)."""
    return curve.orderBy(F.col(score).desc(), F.col("threshold").asc()).limit(1).select(
        F.col("threshold").alias("best_threshold"), F.col(score).alias(f"best_{score}"))


def evaluate(occurrences: DataFrame, gold: DataFrame, labels="bio13", cut: float = 0.995, threshold: float = 0.995,
             grid=THRESHOLD_GRID, beta: float = 5.0, keep: str = "persist", digits: int | None = None) -> dict:
    """The whole evaluation from per-piece probabilities and gold words.

    The prediction table is made once and feeds the curve, the scores and the submission: ``keep`` is
    ``persist`` (call ``release`` when done), ``store`` (written under the shared checkpoint folder, so
    lost executors cost nothing) or ``none`` (recomputed by each output).
    """
    if keep not in ("persist", "store", "none"):
        raise ValueError("keep must be 'persist', 'store' or 'none'")
    pred = prediction_table(occurrences, labels, cut, digits)
    release = lambda: None
    if keep == "persist":
        pred = pred.persist()
        release = pred.unpersist
    elif keep == "store":
        path = scratch_path(pred.sparkSession, "predictions")
        pred.write.parquet(path)
        pred = pred.sparkSession.read.schema(pred.schema).parquet(path)
    labelled = apply_threshold(pred, threshold)
    counts = type_counts(keep_entities(labelled), gold)
    curve = threshold_curve(pred, gold, grid, beta)
    score = f"f{beta:g}"
    return {
        "pred": labelled,
        "counts": counts,
        "per_type": per_type_scores(counts, beta),
        "scores": overall_scores(counts, beta),
        "curve": curve,
        "best": best_threshold(curve, score),
        "submission": lambda: submission(pred, threshold),
        "score": score,
        "release": release,
    }


def bundle_rows(out: dict) -> DataFrame:
    """The bundle's tables as rows (section, name, metric, value): overall, type, curve, best."""
    score = out["score"]

    def long(df: DataFrame, section: str, name, metrics) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in metrics])
        return df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), F.inline(cells))

    same = [(m, m) for m in ("tp", "fp", "fn", "p", "r", score)]
    overall = [("tp", "tp"), ("fp", "fp"), ("fn", "fn"), ("p", "ents_p"), ("r", "ents_r"), (score, f"ents_{score}")]
    return (long(out["scores"], "overall", F.lit("all"), overall)
            .unionByName(long(out["per_type"], "type", F.col("type"), same))
            .unionByName(long(out["curve"], "curve", F.col("grid_idx"), [*same, ("threshold", "threshold")]))
            .unionByName(long(out["best"], "best", F.lit("all"), [("threshold", "best_threshold"), (score, f"best_{score}")])))


__all__ = ["THRESHOLD_GRID", "threshold_curve", "best_threshold", "curve_points", "evaluate", "bundle_rows", "KEYS"]
