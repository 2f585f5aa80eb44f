"""Tables that a query writes for itself, in the folder that driver and executors share, and the few file operations that tables with versions need."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local run, whose executors share the driver's disk, may leave it unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-textquarry-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/textquarry/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table: what follows starts from its files, however often it is used and whichever executor is lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it comes in fewer splits than there are cores, as a small file does; larger inputs stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def listed(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """Names in a folder with size and time of change; none if there is no such folder."""
    fs, at = _files(spark, path)
    return {s.getPath().getName(): (s.getLen(), s.getModificationTime()) for s in fs.listStatus(at)} if fs.exists(at) else {}


def removed(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, if it is there."""
    fs, at = _files(spark, path)
    fs.delete(at, True)


def renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Gives source the name target, which must not exist. False if it does."""
    fs, at = _files(spark, source)
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    return not fs.exists(to) and fs.rename(at, to)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Tells one state of a table's files from another: their names, sizes and times."""
    fs, at = _files(spark, path)
    status = fs.getFileStatus(at)
    found = listed(spark, path) if status.isDirectory() else {at.getName(): (status.getLen(), status.getModificationTime())}
    return hashlib.sha256(repr((path, sorted(found.items()))).encode()).hexdigest()[:32]
