"""Session helpers: one place for the configuration the operators assume."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"  # JSON: of a repeated key the last value holds


def get_spark(app: str = "codesieve", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return a session with AQE on, UTC time and the UI off.

    On a cluster ``master`` stays None and the cluster's own settings win;
    the explicit values here only matter for local runs and tests.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    prepare(spark)
    return spark


#: Batches between the JVM and Python hold whole texts: small ones bound what both sides hold at once.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", "4194304")}


def prepare(spark: SparkSession) -> None:
    """What the operators ask of any session: the option for repeated JSON
    keys, this package on the Python workers, and small batches (where the session keeps Spark's own sizes)."""
    spark.conf.set(REPEATED_KEYS, "true")
    for option, (usual, ours) in BATCHES.items():
        if str(spark.conf.get(option, usual)).upper() in (usual, "64MB", "67108864B"):
            spark.conf.set(option, ours)
    ship_package(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster must set it to a shared file system: without it this raises,
    since files in a machine's own temp folder are lost to the other machines.
    Only a single-JVM local session (tests) gets a fresh folder of its own.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="codesieve-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark application, so
    that functions of its modules load there from any working folder."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="codesieve-ship-"), "codesieve.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
