"""Intermediate tables in the folder that all executors share (``spark.checkpoint.dir``), and free column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: Where the tables stand that this process has written and not deleted.
_WRITTEN: dict[str, None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where it is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="keystrand-"))
    return _LOCAL[0]


def saved(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _WRITTEN[path] = None
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, with its scheme, for files that a job's tasks write themselves."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    path = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    _WRITTEN[path] = None
    return path


def deleted(spark: SparkSession, path: str) -> None:
    """Delete what stands at a path of :func:`folder`."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.pop(path, None)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`saved` once nothing reads it any more."""
    deleted(df.sparkSession, df.saved_at)


def cleared(spark: SparkSession) -> None:
    """Delete all tables and files that this process has written by :func:`saved` and into :func:`folder`. Results that weren't read yet can't be read
    after it: call it between jobs, once their results are stored."""
    for path in list(_WRITTEN):
        deleted(spark, path)


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
