"""Session helpers: sane defaults for local runs and checkpoint handling.

Lineage is cut with ``DataFrame.checkpoint()`` into the folder the cluster names
in ``spark.checkpoint.dir``; a folder of our own is set only where it names none.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "valora", checkpoint_dir: str | None = None,
                  driver_memory: str = "8g") -> SparkSession:
    """A local session for tests, benches and command-line jobs."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", driver_memory)
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, checkpoint_dir)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The checkpoint folder of the session.

    Reads ``spark.checkpoint.dir`` (or the context's current folder).  Only
    where the session names none one is set: ``fallback``, else a temporary
    folder in local mode, else a folder in the warehouse, which a cluster shares.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    own = fallback or spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        local = sc.master == "local" or sc.master.startswith("local[")
        own = (tempfile.mkdtemp(prefix="valora-checkpoints-") if local
               else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_valora_checkpoints")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later steps start from written rows, so plans that
    are used again stay short and survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors once per application, so
    that tasks with Python code run from any working folder.

    The archive is written on the driver and served to the executors by Spark
    (``addPyFile``); executors never read the driver's folder.
    """
    sc = spark.sparkContext
    if getattr(sc, "_valora_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="valora-package-"), "valora_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._valora_shipped = True
