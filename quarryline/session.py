"""Session set-up, table access and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "quarryline", memory: str = "12g", partitions: int | None = None) -> SparkSession:
    """Session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", os.environ.get("SPARK_LOCAL_DIRS") or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (file or folder) of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the cluster's ``spark.checkpoint.dir``, or the one set on the context.

    Where that is unset, a local master (tests, a laptop) gets a folder of its own; on a cluster it is an
    error, as a folder of one machine would lose rows.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _ROOTS.get(context.applicationId) or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _ROOTS[context.applicationId] = root
    return root.rstrip("/")


_WRITTEN: list[str] = []


def forget(spark: SparkSession) -> None:
    """Delete what :func:`materialize` wrote so far; results that read it must have been written elsewhere by then."""
    while _WRITTEN:
        at = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage for iterative operators and for results read more than once. The
    files survive the loss of executors and are compressed, unlike block caches.
    """
    path = f"{checkpoint_root(df.sparkSession)}/quarryline-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
