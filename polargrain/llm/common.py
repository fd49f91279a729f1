"""Shared helpers: the cluster's shared folder, files in it, and text normalisation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which all executors see.

    The name carries its file system, so that Spark and Python writers mean the same place.
    Where the session names no such folder, a local master (as in tests) gets one that is made
    and set; a cluster is an error, as its executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="polargrain-")
        spark.sparkContext.setCheckpointDir(base)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    whole = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return f"{whole.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Settings while :func:`cut` is ``lean``: shuffle files go with the query, workers get small batches.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Run a block under ``wanted`` settings of the session; those before come back after it."""
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def cut(df: DataFrame, name: str, lean: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at durable files.

    ``lean`` deletes the write's shuffle files as soon as it is done, where else they stay until
    the driver collects garbage, and hands texts to Python workers in small batches.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with settings(spark, LEAN if lean else {}):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`cut` wrote and nothing reads any more."""
    for df in tables:
        where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a shared folder's URI; plain paths are local mounts."""
    from pyarrow import fs

    if "://" not in uri:
        uri = uri.removeprefix("file:")
        return fs.LocalFileSystem(), uri
    if uri.startswith("file://"):
        return fs.LocalFileSystem(), uri.removeprefix("file://")
    return fs.FileSystem.from_uri(uri)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure-ASCII texts take the byte-wise ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
