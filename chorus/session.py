"""Session construction and the shared scratch location.

On a cluster the shared folder is whatever ``spark.checkpoint.dir`` names; this module
only reads it.  A fresh local folder is created solely on a local master without the
setting (local runs and tests); on a cluster its absence is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FIT_ROWS = 8192  # rows that a part has at least in fits on vectors


def get_session(master: str | None = None, app: str = "chorus", shuffle_partitions: int | None = None) -> SparkSession:
    master = master or os.environ.get("CHORUS_MASTER", "local[8]")
    cores = master[6:-1] if master.startswith("local[") else "8"
    parts = shuffle_partitions or (8 if cores in ("*", "") else max(int(cores), 1))
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CHORUS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # broadcast joins are chosen explicitly, behind size checks
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Ready a session someone else built: shared checkpoint folder, the package on the
    workers, and a batch size for whole texts unless one is configured."""
    checkpoint_dir(spark)
    ship_package(spark)
    # rows are whole texts here: smaller Arrow batches bound what a Python worker holds
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark.sparkContext.getConf().contains(batch):
        spark.conf.set(batch, "2000")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``chorus`` importable in the Python workers (pandas functions defined in
    the package run there): the package is zipped once per application and added
    with ``addPyFile``, Spark's own mechanism for distributing Python code."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="chorus-pkg-"), "chorus.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(target)
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a private one only when none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="chorus-ckpt-"))
    return sc.getCheckpointDir().rstrip("/")


def even_parts(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows dealt evenly, two parts a core: for what runs long on rows, or once an iteration.  A
    table of one file is one task otherwise, and small shuffles are put together to a few.  A fit
    on short rows pays for tasks in every iteration: given their number, ``FIT_ROWS`` share a part."""
    parts = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts if rows is None else max(1, min(parts, -(-rows // FIT_ROWS))))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for round-trip writes."""
    base = checkpoint_dir(spark)
    return f"{base}/chorus-scratch/{name}-{uuid.uuid4().hex[:12]}"
