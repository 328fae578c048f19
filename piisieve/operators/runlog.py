"""Training-run logs over many runs (L1-L4): running mean, running best, patience, eval points.

Running aggregates are computed in two levels so a hot run is never one window task:
rows are grouped into (run, block) cells (a time bucket chosen by the caller); each cell gets
its local running values with a window over that cell only, and the totals of the earlier cells
of the same run - one row per cell, a far smaller table - come from a second window and a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import PATIENCE

UNB = Window.unboundedPreceding


def running_stats(df: DataFrame, part, order, value: str, block: Column | None = None,
                  prefix: str = "run_") -> DataFrame:
    """Add {prefix}count / sum / max (inclusive) and {prefix}prev_max (exclusive) per partition."""
    part = [part] if isinstance(part, str) else list(part)
    order = [order] if isinstance(order, str) else list(order)
    v = F.col(value)
    if block is None:
        w = Window.partitionBy(*part).orderBy(*order)
        return (df.withColumn(f"{prefix}count", F.count(F.lit(1)).over(w.rowsBetween(UNB, 0)))
                  .withColumn(f"{prefix}sum", F.sum(v).over(w.rowsBetween(UNB, 0)))
                  .withColumn(f"{prefix}max", F.max(v).over(w.rowsBetween(UNB, 0)))
                  .withColumn(f"{prefix}prev_max", F.max(v).over(w.rowsBetween(UNB, -1))))
    b = df.withColumn("_blk", block)
    cell = Window.partitionBy(*part, "_blk").orderBy(*order)
    local = (b.withColumn("_lc", F.count(F.lit(1)).over(cell.rowsBetween(UNB, 0)))
              .withColumn("_ls", F.sum(v).over(cell.rowsBetween(UNB, 0)))
              .withColumn("_lm", F.max(v).over(cell.rowsBetween(UNB, 0)))
              .withColumn("_lp", F.max(v).over(cell.rowsBetween(UNB, -1))))
    cells = b.groupBy(*part, "_blk").agg(F.count(F.lit(1)).alias("_cc"), F.sum(v).alias("_cs"), F.max(v).alias("_cm"))
    before = Window.partitionBy(*part).orderBy("_blk").rowsBetween(UNB, -1)
    offs = cells.select(*part, "_blk",
                        F.coalesce(F.sum("_cc").over(before), F.lit(0)).alias("_oc"),
                        F.sum("_cs").over(before).alias("_os"),
                        F.max("_cm").over(before).alias("_om"))
    j = local.join(offs, [*part, "_blk"])
    return (j.withColumn(f"{prefix}count", F.col("_oc") + F.col("_lc"))
             .withColumn(f"{prefix}sum", F.coalesce(F.col("_os"), F.lit(0.0)) + F.col("_ls"))
             .withColumn(f"{prefix}max", F.greatest(F.col("_om"), F.col("_lm")))
             .withColumn(f"{prefix}prev_max", F.greatest(F.col("_om"), F.col("_lp")))
             .drop("_blk", "_lc", "_ls", "_lm", "_lp", "_oc", "_os", "_om"))


def running_loss(log: DataFrame, run: str = "run_id", epoch: str = "epoch", order=("step",),
                 loss: str = "loss", block: Column | None = None) -> DataFrame:
    """L1: running mean of the loss, reset every epoch."""
    s = running_stats(log, [run, epoch], list(order), loss, block, "_e_")
    return (s.withColumn("running_loss", F.col("_e_sum") / F.col("_e_count"))
             .drop("_e_count", "_e_sum", "_e_max", "_e_prev_max"))


def running_best(log: DataFrame, run: str = "run_id", order=("step",), score: str = "lb",
                 block: Column | None = None) -> DataFrame:
    """L2: running best score; a tie counts as a new best (>=), the start value is -1."""
    s = running_stats(log, [run], list(order), score, block, "_b_")
    return (s.withColumn("best_lb", F.greatest(F.col("_b_max"), F.lit(-1.0)))
             .withColumn("is_best", F.col(score) >= F.coalesce(F.col("_b_prev_max"), F.lit(-1.0)))
             .withColumnRenamed("_b_count", "eval_no")
             .drop("_b_sum", "_b_max", "_b_prev_max"))


def early_stop(log: DataFrame, run: str = "run_id", order=("step",), score: str = "lb", patience: int = PATIENCE,
               block: Column | None = None, step: str = "step") -> tuple[DataFrame, DataFrame]:
    """L3: patience counter (evaluations since the last best) and the first step reaching patience.

    counter = position - position of the last best. One pass over (run, block) cells: a row knows its
    cell's running maximum and count; a cell's row holds its size, its maximum and the last position
    of that maximum, which is a best exactly when it reaches the maximum before the cell. Windows
    over the cells (one row each) give what came before, one join brings it to the rows.
    """
    v = F.col(score)
    b = log.withColumn("_blk", F.lit(0) if block is None else block)
    cell = Window.partitionBy(run, "_blk").orderBy(*order)
    local = (b.withColumn("_lc", F.count(F.lit(1)).over(cell.rowsBetween(UNB, 0)))
              .withColumn("_lp", F.max(v).over(cell.rowsBetween(UNB, -1))))
    cells = local.groupBy(run, "_blk").agg(F.count(F.lit(1)).alias("_cc"), F.max(v).alias("_cm"), F.max(
        F.struct(v.alias("v"), F.col("_lc").alias("at"))).alias("_top"))
    before = Window.partitionBy(run).orderBy("_blk").rowsBetween(UNB, -1)
    cells = cells.select(run, "_blk", "_cm", "_top", F.coalesce(F.sum("_cc").over(before), F.lit(0)).alias("_oc"),
                         F.coalesce(F.max("_cm").over(before), F.lit(-1.0)).alias("_om"))
    best_in = F.when(F.greatest("_om", F.lit(-1.0)) <= F.col("_cm"), F.col("_oc") + F.col("_top.at"))
    cells = cells.withColumn("_ob", F.max(best_in).over(before)).select(run, "_blk", "_oc", "_om", "_ob")
    j = local.join(cells, [run, "_blk"])
    j = (j.withColumn("eval_no", F.col("_oc") + F.col("_lc"))
          .withColumn("is_best", v >= F.greatest(F.lit(-1.0), "_om", "_lp")))
    last = F.greatest(F.max(F.when(F.col("is_best"), F.col("eval_no"))).over(cell.rowsBetween(UNB, 0)),
                      F.coalesce("_ob", F.lit(0)))
    best = F.greatest(F.lit(-1.0), "_om", F.max(v).over(cell.rowsBetween(UNB, 0)))
    rows = (j.withColumn("best_lb", best).withColumn("patience_counter", (F.col("eval_no") - last).cast("long"))
             .drop("_blk", "_lc", "_lp", "_oc", "_om", "_ob"))
    stops = (rows.filter(F.col("patience_counter") >= patience)
                 .groupBy(run).agg(F.min_by(F.col(step), F.col("eval_no")).alias("stop_step"),
                                   F.min("eval_no").alias("stop_eval_no")))
    return rows, stops


def eval_points(log: DataFrame, n: int, pos: str = "eval_no") -> DataFrame:
    """L4: rows where the 1-based position within the run is a multiple of n."""
    return log.filter(F.col(pos) % n == 0)
