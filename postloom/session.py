"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "postloom") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only where the session names none (tests, local runs) a temporary folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jsc = spark.sparkContext._jsc.sc()
        set_dir = jsc.getCheckpointDir()
        named = set_dir.get() if set_dir.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="postloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_written: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written intermediate table in the shared folder."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Removes all intermediate tables that this application has written; how many. To be called once the results that
    read them are themselves written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = 0
    for path in _written.pop(spark.sparkContext.applicationId, []):
        at = jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(at.getFileSystem(conf).delete(at, True))
    return gone


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back.

    This cuts lineage and survives the loss of executors; later readers prune columns and partitions. Shuffle files of the
    write are removed once it is done: nothing reads them again.
    """
    spark = df.sparkSession
    path, asked = scratch_path(spark, label), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if asked is None else spark.conf.set(_CLEANUP, asked)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, factor: int = 2) -> DataFrame:
    """Repartition a scan that has fewer partitions than the cluster has cores, before work that is heavy per row.

    Scans that are already wide enough (the normal case on large inputs) are left as they are, without a shuffle.
    """
    want = factor * df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want // 2:
        return df
    # In order of the keys, so that a task that is run again sees its rows in the same order.
    return df.repartition(want, *keys).sortWithinPartitions(*keys) if keys else df.repartition(want)


_ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Lets the Python workers of a session import this package, where their path does not already hold it."""
    app = spark.sparkContext.applicationId
    on_path = str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or (spark.sparkContext.master.startswith("local[") and Path.cwd() == _ROOT)
    if on_path or app in _shipped:
        return
    folder = scratch_dir(spark)
    at = Path(folder.removeprefix("file://") if folder.startswith("file:") else tempfile.mkdtemp(prefix="postloom-"))
    at.mkdir(parents=True, exist_ok=True)
    archive = at / f"postloom-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((_ROOT / "postloom").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
