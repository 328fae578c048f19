"""Session helpers: a tuned local/cluster session and the shared checkpoint folder."""

from __future__ import annotations

import logging
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

log = logging.getLogger(__name__)

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "piisieve",
                shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the web UI off."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        settings.setdefault("spark.driver.memory", "16g")
        # let HotSpot JIT wide generated stages (methods over 8000 bytes are otherwise interpreted);
        # on a cluster set the same flag in spark.executor.extraJavaOptions
        settings.setdefault("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, reading ``spark.checkpoint.dir`` from the session.

    A folder is only invented when the session names none (local runs and tests).
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext (Spark Connect): the server's setting applies
        return spark.conf.get("spark.checkpoint.dir", "") or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="piisieve-ckpt-")
        log.warning("spark.checkpoint.dir unset; using %s (local mode only)", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint directory for files a job writes and reads back."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch-{name}-{uuid.uuid4().hex[:12]}"


#: Spark's switch for removing an execution's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession):
    """Within it, the shuffle files of an action go when the action has ended, not when the driver's garbage collector
    comes to them. For jobs of several actions, each of which reads stored tables."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Ship this package to the executors' Python workers (``addPyFile`` of a zip), once per
    application, so UDF and ``mapInPandas`` bodies resolve their module on every worker."""
    try:
        sc = spark.sparkContext
        key = sc.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect: install the package on the server instead
        return
    if key in _SHIPPED:
        return
    import os
    import zipfile

    pkg_root = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(pkg_root)
    zip_path = os.path.join(tempfile.mkdtemp(prefix="piisieve-pyfiles-"), "piisieve.zip")
    with zipfile.ZipFile(zip_path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg_root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, parent))
    sc.addPyFile(zip_path)
    _SHIPPED.add(key)
