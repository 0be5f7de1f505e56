"""Model artifacts, run log and versioned models.

Everything is written through Spark / Hadoop file systems, so the root may
be any shared folder the cluster can reach.  Layout under ``root``::

    runs/                       parquet run log (run_id, ts, kind, key, value)
    models/<name>/v=<n>/        PipelineModel of version n
    models/<name>/_claims/<n>   an empty file: number n is taken
    models/<name>/_versions/    parquet version table
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_json(spark: SparkSession, obj, path: str) -> None:
    """One JSON document as a single text file under ``path``."""
    spark.createDataFrame([(json.dumps(obj, default=str),)], "value string") \
        .coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str):
    rows = spark.read.text(path).collect()
    return json.loads("".join(r["value"] for r in rows))


def save_artifacts(pipeline: PipelineModel, metadata: dict, directory: str) -> str:
    """Fitted transform + model (one PipelineModel) and metadata."""
    spark = SparkSession.getActiveSession()
    pipeline.write().overwrite().save(f"{directory}/pipeline")
    write_json(spark, metadata, f"{directory}/metadata")
    return directory


def load_artifacts(directory: str) -> dict:
    """Load them; a missing model is an error, metadata optional."""
    spark = SparkSession.getActiveSession()
    if not _fs_exists(spark, f"{directory}/pipeline"):
        raise FileNotFoundError(f"{directory} holds no saved pipeline")
    pipeline = PipelineModel.load(f"{directory}/pipeline")
    meta = read_json(spark, f"{directory}/metadata") if _fs_exists(spark, f"{directory}/metadata") else {}
    return {"pipeline": pipeline, "metadata": meta}


_RUN_SCHEMA = "run_id string, run_name string, ts timestamp, kind string, key string, value string"


def log_run(spark: SparkSession, root: str, run_name: str, params: dict | None = None,
            metrics: dict | None = None, tags: dict | None = None) -> str:
    """Append params, metrics and tags of one run; returns the run id."""
    run_id = uuid.uuid4().hex
    ts = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = []
    for kind, d in (("param", params), ("metric", metrics), ("tag", tags)):
        for k, v in (d or {}).items():
            rows.append((run_id, run_name, ts, kind, str(k), json.dumps(v, default=str)))
    if not rows:
        rows.append((run_id, run_name, ts, "tag", "empty", "true"))
    spark.createDataFrame(rows, _RUN_SCHEMA).write.mode("append").parquet(f"{root}/runs")
    return run_id


def runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/runs")


_VERSION_SCHEMA = "version int, stage string, run_id string, status string, created timestamp"


def list_versions(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Version, stage, run, status, created — empty when unregistered."""
    path = f"{root}/models/{name}/_versions"
    if not _fs_exists(spark, path):
        return spark.createDataFrame([], _VERSION_SCHEMA)
    return spark.read.parquet(path).orderBy("version")


def claim_version(spark: SparkSession, root: str, name: str) -> int:
    """The next free version number, taken by creating a file that must not
    exist yet: the file system lets one of several writers create it, the others
    go on to the next number.  A writer that fails leaves a gap."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/models/{name}/_claims")
    fs = folder.getFileSystem(conf)
    fs.mkdirs(folder)
    taken = [int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()]
    version = max(taken, default=0) + 1
    while not _created(jvm, fs, jvm.org.apache.hadoop.fs.Path(folder, str(version))):
        version += 1
    return version


def _created(jvm, fs, path) -> bool:
    """Whether this call created the file; one of several callers does."""
    if fs.getScheme() == "file":   # Hadoop's local file system looks first and creates then
        return jvm.java.io.File(path.toUri().getPath()).createNewFile()
    try:
        fs.create(path, False).close()
        return True
    except Py4JJavaError:
        if fs.exists(path):
            return False
        raise


def register_model(pipeline: PipelineModel, root: str, name: str, run_id: str | None = None,
                   stage: str = "None") -> int:
    """Store a new version and record it; returns the version number.  The
    number is claimed before anything is written, so concurrent runs never share
    one; a version is listed once its model is whole."""
    spark = SparkSession.getActiveSession()
    version = claim_version(spark, root, name)
    pipeline.write().overwrite().save(f"{root}/models/{name}/v={version}")
    created = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([(version, stage, run_id, "READY", created)], _VERSION_SCHEMA) \
        .write.mode("append").parquet(f"{root}/models/{name}/_versions")
    return version


def load_version(root: str, name: str, version: str | int = "latest") -> PipelineModel:
    """Load a version by number, or the latest (highest) one."""
    spark = SparkSession.getActiveSession()
    if version == "latest":
        version = list_versions(spark, root, name).agg(F.max("version")).first()[0]
        if version is None:
            raise FileNotFoundError(f"model {name} has no versions")
    path = f"{root}/models/{name}/v={int(version)}"
    if not _fs_exists(spark, path):
        raise FileNotFoundError(path)
    return PipelineModel.load(path)


def model_overview(spark: SparkSession, root: str) -> DataFrame:
    """M6: one row per run name, from its latest run: CV error, RMSE, MAE and R2
    as text, "N/A" where the run has not logged them."""
    latest = (runs(spark, root).groupBy("run_name")
              .agg(F.max_by("run_id", F.struct("ts", "run_id")).alias("run_id")).select("run_id"))
    rows = runs(spark, root).join(latest, "run_id")

    def shown(key: str, digits: int, prefix: str = "") -> Column:
        # of a key that was logged more than once in a run, the largest counts
        value = F.max(F.when((F.col("kind") == "metric") & (F.col("key") == key), F.expr("try_cast(value AS double)")))
        return F.coalesce(F.concat(F.lit(prefix), F.format_number(value, digits)), F.lit("N/A"))

    return rows.groupBy(F.col("run_name").alias("model")).agg(
        shown("best_cv_rmse_log", 5).alias("cv_rmse_log"), shown("rmse", 2, "$").alias("holdout_rmse"),
        shown("mae", 2, "$").alias("holdout_mae"), shown("r2", 4).alias("holdout_r2"))
