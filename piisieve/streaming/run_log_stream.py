"""Running mean, running best and patience (L1-L3) of run logs that arrive in pieces.

Each micro-batch goes through the two-level operators of ``operators.runlog``, so a run that holds most of the rows
is still many cells; what came before it enters as one row for each run (evaluations, best score, place of
the last best, last order key) and one for each run and epoch (rows, sum of the loss). This state is written anew for each
micro-batch under its number, and the output too, both by overwriting: a micro-batch that is run again after a lost
driver reads the state before it and replaces its own folders, so results equal the batch operators' after any cut
and any restart. State of batches before the last one is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runlog import early_stop, running_stats
from ..settings import PATIENCE
from ..sources.sinks import _files


def _parquet(spark: SparkSession, path: str) -> DataFrame | None:
    jvm, files = _files(spark, path)
    return spark.read.parquet(path) if files.util().exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")) else None


def with_losses(log: DataFrame, state: DataFrame | None, run: str, epoch: str, order, loss: str,
                block: Column) -> tuple[DataFrame, DataFrame]:
    """L1 of one piece of the log after ``state``: (rows with ``running_loss``, the state after the piece)."""
    rows = running_stats(log, [run, epoch], list(order), loss, block, "_e_")
    totals = log.groupBy(run, epoch).agg(F.count(F.lit(1)).alias("_n"), F.sum(loss).cast("double").alias("_total"))
    if state is None:
        return rows.withColumn("running_loss", F.col("_e_sum") / F.col("_e_count")).drop("_e_count", "_e_sum", "_e_max", "_e_prev_max"), totals
    rows = rows.join(state, [run, epoch], "left")
    mean = (F.coalesce("_total", F.lit(0.0)) + F.col("_e_sum")) / (F.coalesce("_n", F.lit(0)) + F.col("_e_count"))
    after = state.unionByName(totals).groupBy(run, epoch).agg(F.sum("_n").alias("_n"), F.sum("_total").alias("_total"))
    return rows.withColumn("running_loss", mean).drop("_e_count", "_e_sum", "_e_max", "_e_prev_max", "_n", "_total"), after


def with_best(log: DataFrame, state: DataFrame | None, run: str, order, score: str, block: Column,
              patience: int = PATIENCE) -> DataFrame:
    """L2 and L3 of one piece of the log after ``state``: rows with ``eval_no``, ``is_best``, ``best_lb``,
    ``patience_counter`` and ``stop`` (the patience is used up).

    The best before the piece takes part as one row ahead of each run, in a cell of its own; joins by cell
    drop it again. A row that is not behind all rows of its run's earlier pieces raises.
    """
    key = F.struct(*order)
    if state is None:
        rows, _ = early_stop(log, run, order, score, patience, block, step=order[-1])
    else:
        ahead = state.join(log.select(run).distinct(), run, "left_semi").select(run, F.col("_best").alias(score))
        both = log.withColumn("_cell", block).unionByName(ahead, allowMissingColumns=True)
        rows, _ = early_stop(both, run, order, score, patience, F.col("_cell"), step=order[-1])
        rows = rows.drop("_cell").join(state, run, "left")
        late = F.col("_last").isNotNull() & (key <= F.col("_last"))
        before = F.when(late, F.raise_error(F.concat(F.lit("a row behind its time in run "), F.col(run).cast("string")))).otherwise(F.col("_evals"))
        # without a row ahead (a new run) numbers start at one; with it, at two
        number = F.col("eval_no") + F.coalesce(before.cast("long") - 1, F.lit(0))
        since = F.when(F.col("patience_counter") == F.col("eval_no") - 1, F.col("patience_counter") + F.col("_evals") - F.col("_at"))
        rows = (rows.withColumn("patience_counter", F.when(F.col("_evals").isNull(), F.col("patience_counter"))
                                .otherwise(F.coalesce(since, F.col("patience_counter"))))
                .withColumn("eval_no", number).drop("_evals", "_best", "_at", "_last"))
    return rows.withColumn("stop", F.col("patience_counter") >= patience)


def state_after(rows: DataFrame, state: DataFrame | None, run: str, order) -> DataFrame:
    """One row for each run: evaluations, best score, place of the last best and last order key, after ``rows``."""
    after = rows.groupBy(run).agg(F.max("eval_no").alias("_evals"), F.max("best_lb").alias("_best"),
                                  F.max(F.col("eval_no") - F.col("patience_counter")).alias("_at"), F.max(F.struct(*order)).alias("_last"))
    return after if state is None else after.unionByName(state.join(after.select(run), run, "left_anti"))


def start_run_log(log: DataFrame, sink: str, checkpoint: str, run: str = "run_id", epoch: str = "epoch", order=("ts", "step"),
                  loss: str = "loss", score: str = "lb", block: Column | None = None, patience: int = PATIENCE):
    """Start the query over a streaming ``log`` and process what is there (``availableNow``); started again with the
    same folders, it goes on behind the last micro-batch. ``block`` deals a run's rows to cells that follow its order.
    Rows per micro-batch: ``sink/rows/batch=<number>``; read them with :func:`read_run_log`."""
    spark, cells = log.sparkSession, F.lit(0) if block is None else block

    def piece(rows: DataFrame, number: int) -> None:
        before = [_parquet(spark, f"{sink}/{kind}/{number - 1}") for kind in ("losses", "bests")]
        if number and None in before:
            raise RuntimeError(f"{sink} lacks the state before micro-batch {number}")
        losses, loss_state = with_losses(rows, before[0], run, epoch, order, loss, cells)
        out = with_best(losses, before[1], run, order, score, cells, patience)
        out.write.mode("overwrite").parquet(f"{sink}/rows/batch={number}")
        loss_state.write.mode("overwrite").parquet(f"{sink}/losses/{number}")
        done = spark.read.parquet(f"{sink}/rows/batch={number}")
        state_after(done, before[1], run, order).write.mode("overwrite").parquet(f"{sink}/bests/{number}")
        jvm, files = _files(spark, sink)
        for kind in ("losses", "bests"):
            files.delete(jvm.org.apache.hadoop.fs.Path(f"{sink}/{kind}/{number - 2}"), True)

    return log.writeStream.foreachBatch(piece).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_run_log(spark: SparkSession, sink: str) -> DataFrame:
    """The rows of all micro-batches."""
    return spark.read.parquet(f"{sink}/rows").drop("batch")
