"""Session helpers: settings that hold for every plan of the engine."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", shuffle: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    shared = os.environ.get("QUARRY_SHARED_DIR") or tempfile.mkdtemp(prefix="quarry-")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", shared)
        .getOrCreate()
    )


#: Temporary folders of local sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Only a session on one machine may leave it unset, as in tests; it gets a
    temporary folder. On a cluster that would be no shared folder, so there an
    unset one is an error.
    """
    have = spark.conf.get("spark.checkpoint.dir", None)
    if have:
        return have
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = os.environ.get("QUARRY_SHARED_DIR") or tempfile.mkdtemp(prefix="quarry-")
    return _LOCAL[context.applicationId]


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/quarry-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table written in the shared folder.

    Unlike a cached block, the written table outlives a lost executor. The
    tables of a session lie in one folder, which `release` removes, at the
    latest when the driver ends.
    """
    spark = df.sparkSession
    folder = _tables(spark)
    if folder not in _HELD:
        _HELD.add(folder)
        atexit.register(_forget, spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_HELD: set[str] = set()


def release(spark: SparkSession) -> None:
    """Remove the tables that `materialize` wrote in this session; DataFrames over them cannot be read any more."""
    folder = _tables(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _forget(spark: SparkSession, folder: str) -> None:
    try:
        release(spark)
    except Exception:  # the session has ended before
        shutil.rmtree(folder.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
