"""Spark session defaults and the shared folder used for checkpoints and written tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "telemetra",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """A session with the settings this library is tuned for.

    AQE re-plans joins and coalesces small shuffle partitions at runtime; skew-join splitting is on.
    The UI stays off. Times are UTC so that timestamps mean the same in every engine.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus) * 2
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         # A persisted frame keeps the partitioning it was built with, so scans chained on the
         # (device, segment) shuffle do not shuffle again after reading the persisted copy.
         .config("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Runtime settings the plans are tuned for; none of them changes a result.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "false",
}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors, once per application, so that functions sent to Python workers find it
    wherever the driver was started (what ``--py-files`` does on submission)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
    zipped = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix=f"{name}-ship-"), name), "zip", root, name)
    spark.sparkContext.addPyFile(zipped)
    _shipped.add(app)


def tune(spark: SparkSession) -> SparkSession:
    """Apply ``RUNTIME_SETTINGS`` to a session built elsewhere (they are runtime SQL settings)."""
    ship_package(spark)
    for k, v in RUNTIME_SETTINGS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this must be configured; only a local-mode session without one (tests, a laptop)
    gets a fresh folder of its own, which is then registered as the checkpoint folder.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if path:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(path)
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="telemetra-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique location for a written intermediate table under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
