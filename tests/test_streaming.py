"""A streaming redaction run over the sf0.001 documents equals the batch result."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF
from piisieve.operators.redact import redact
from piisieve.streaming.redact_stream import start_redaction


def test_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="piisieve-stream-")
    src = os.path.join(base, "in")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(src)
    q = start_redaction(spark, src, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(base, "out")).select("doc_id", F.md5("redacted").alias("h"))
    want = redact(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", F.md5("redacted").alias("h"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def _log(spark, rows):
    return spark.createDataFrame(rows, "run_id long, epoch int, ts long, step long, loss double, lb double")


def _arrive(spark, base, rows):
    """The rows as one more file, and the stream run over what is new."""
    from piisieve.streaming.run_log_stream import read_run_log, start_run_log
    _log(spark, rows).coalesce(1).write.mode("append").parquet(f"{base}/in")
    arriving = spark.readStream.schema(_log(spark, []).schema).parquet(f"{base}/in")
    start_run_log(arriving, f"{base}/out", f"{base}/ckpt", block=F.floor(F.col("ts") / 4), patience=3).awaitTermination()
    return read_run_log(spark, f"{base}/out")


def _plain(rows):
    """Row by row: running mean by epoch, best with ties, evaluations since the last best."""
    out, sums, bests = {}, {}, {}
    for run, epoch, ts, step, loss, lb in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        n, total = sums.get((run, epoch), (0, 0.0))
        sums[run, epoch] = n + 1, total + loss
        evals, best, at = bests.get(run, (0, -1.0, 0))
        is_best, evals = lb >= best, evals + 1
        bests[run] = evals, max(best, lb), evals if is_best else at
        out[run, step] = (round((total + loss) / (n + 1), 9), evals, is_best, max(best, lb), evals - bests[run][2], evals - bests[run][2] >= 3)
    return out


def test_run_log_equals_the_plain_result_after_any_cut(spark, tmp_path):
    rows = [(run, ts // 7, ts // 2, ts, float((ts * 7 + run) % 5), [-2.0, 0.5, 0.25, 0.5, 0.125, 0.75, 0.0][(ts * (run + 1)) % 7] if run else -2.0)
            for ts in range(20) for run in range(4) if not (run == 3 and ts < 12) and not (run == 2 and ts > 8)]
    want = _plain(rows)
    for k, cuts in enumerate(([], [9], [1, 2, 13])):
        at = [0, *cuts, 99]
        for low, high in zip(at, at[1:]):
            got = _arrive(spark, tmp_path / str(k), [r for r in rows if low <= r[3] < high])
        assert {(r.run_id, r.step): (round(r.running_loss, 9), r.eval_no, r.is_best, r.best_lb, r.patience_counter, r.stop)
                for r in got.collect()} == want and got.count() == len(rows)


def test_a_late_row_of_a_run_raises(spark, tmp_path):
    import pytest
    _arrive(spark, tmp_path, [(1, 0, 5, 5, 1.0, 1.0)])
    assert _arrive(spark, tmp_path, [(2, 0, 3, 3, 1.0, 1.0)]).count() == 2  # another run has its own time
    with pytest.raises(Exception, match="behind its time"):
        _arrive(spark, tmp_path, [(1, 0, 4, 4, 1.0, 1.0)])
