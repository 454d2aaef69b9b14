"""Session and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "aspectspark",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings this library expects.

    On a cluster the master, memory and shuffle sizing come from the
    submitter; these defaults only matter for local runs and tests.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    parts = shuffle_partitions or max(8, cores * 2)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    if (master or "").startswith("local"):
        # small local inputs: AQE would coalesce by shuffle bytes down to a
        # few tasks, but the stages after the shuffles are CPU-bound; keep
        # at least two tasks per core
        builder = (builder
                   .config("aspectspark.inputPartitions", str(cores))
                   .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
                   .config("spark.sql.adaptive.coalescePartitions.minPartitionNum", str(parts)))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Shared storage root for checkpoints and written intermediate tables.

    Uses the directory the cluster names in ``spark.checkpoint.dir``.  Where
    that is unset, a local master gets a fresh local directory, registered
    as the checkpoint directory; any other master is an error, as executors
    would each write to their own disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="aspectspark-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared directory."""
    root = shared_dir(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (``addPyFile`` of a
    zip of the package, once per SparkContext).  Needed wherever a pandas
    UDF closure refers to functions of this package.  The zip is a driver
    side artifact served to executors by Spark itself (like ``--py-files``);
    on a cluster where the package is installed, set
    ``aspectspark.shipped=true`` to skip it."""
    sc = spark.sparkContext
    key = sc.applicationId
    with _SHIP_LOCK:
        if key in _SHIPPED:
            return
        _ship(spark, sc, key)


def _ship(spark: SparkSession, sc, key: str) -> None:
    import zipfile

    try:  # already importable on the workers (installed, or shipped by submit)
        if spark.conf.get("aspectspark.shipped", "false") == "true":
            _SHIPPED.add(key)
            return
    except Exception:  # noqa: BLE001
        pass
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="aspectspark-pyfiles-")
    path = os.path.join(out_dir, "aspectspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    spark.conf.set("aspectspark.shipped", "true")
    _SHIPPED.add(key)


#: Rows of a flat table (annotations) that a task takes at most, about: some
#: hundred MB where it sorts and aggregates them for all members.
TASK_ROWS = 1 << 17


def task_count(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int | None:
    """Tasks for so many rows, ``each`` per task; None where one task takes
    them all.  No fewer than shuffles have, so a join keeps this number."""
    if rows <= each:
        return None
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def dealt(df: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Deal a table by keys to as many tasks as its rows need.

    Adaptive execution merges partitions by shuffled bytes, before a task
    derives several rows from each and sorts them; this number is kept, so the
    memory of a task does not grow with the table.  ``rows`` (default: counted,
    for a file from its footers) is the table's number of rows."""
    n = task_count(df.sparkSession, df.count() if rows is None else rows)
    return df.repartition(n, *keys) if n else df


def input_partitions(spark: SparkSession) -> int | None:
    """Partitions to deal text tables into after the scan, as the session's
    ``aspectspark.inputPartitions`` says; unset: as the scan splits them.

    :func:`get_session` sets it for local masters alone, whose small inputs
    are single files with one row group, which one task would read.
    """
    value = spark.conf.get("aspectspark.inputPartitions", None)
    return int(value) if value else None
