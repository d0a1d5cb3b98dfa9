"""Cutting lineage for tables that several steps read."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session (driver and executors are one process) gets a temporary folder
    that goes when Python ends; on a cluster the setting is required, because executors do not see
    each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def staged(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    A lost executor re-reads files instead of recomputing the inputs, later scans prune columns,
    and the join planner knows the real size of the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def folder(spark: SparkSession) -> str:
    """A path for files in the shared folder that goes with the staged tables."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def unstage(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stage_path", None)
        if path:
            _remove(df.sparkSession, path)


def stages(spark: SparkSession) -> list[str]:
    """Paths of the tables that this application staged and did not remove."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def drop_stages(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Remove staged tables (all of the application's, if none are named); call it when the results are written."""
    for path in stages(spark) if paths is None else paths:
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    left = _written.get(spark.sparkContext.applicationId, [])
    if path in left:
        left.remove(path)
