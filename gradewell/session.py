"""Session construction and shared-storage settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at cluster scale; local runs inherit them too.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Explicit broadcast hints are only placed on tables whose size is fixed
    # (rule tables, keyword lists); automatic broadcast stays at its default.
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "gradewell") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_CKPT: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and written intermediate tables.

    On a cluster the operator names it in ``spark.checkpoint.dir``; only when
    it is unset (local tests) do we pick a scratch folder of our own.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        key = sc.applicationId
        if key not in _LOCAL_CKPT:
            _LOCAL_CKPT[key] = tempfile.mkdtemp(prefix="gradewell-ckpt-")
        d = _LOCAL_CKPT[key]
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint dir for written intermediate tables."""
    return checkpoint_dir(spark).rstrip("/") + "/" + name


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through Hadoop's FileSystem, so it works for any shared store."""
    try:
        jvm = spark.sparkContext._jvm
        hp = jvm.org.apache.hadoop.fs.Path(path)
        return bool(hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hp))
    except Exception:  # noqa: BLE001 - no JVM access (e.g. Connect): local paths only
        return os.path.exists(path)


def file_signature(spark: SparkSession, path: str) -> str:
    """Length and modification time of a file or folder and what it holds, by Hadoop's
    FileSystem, so that a changed input is noticed on any store."""
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hp):
        return "missing"
    summary, status = fs.getContentSummary(hp), fs.getFileStatus(hp)
    return f"{summary.getLength()}:{summary.getFileCount()}:{status.getModificationTime()}"


def file_length(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of what a folder holds; 0 if it is missing."""
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(hp).getLength() if fs.exists(hp) else 0


def materialize(spark: SparkSession, df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint dir and read it back.

    Cuts lineage (a lost executor re-reads files instead of recomputing the
    plan) and gives later plans a plain scan with pushdown and pruning. A
    finished copy (``_SUCCESS`` present) is reused.
    """
    path = scratch_path(spark, name)
    if not path_exists(spark, path + "/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
