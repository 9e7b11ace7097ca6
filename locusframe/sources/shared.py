"""The folder that the driver and all executors share, and text written to it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; unset, a temporary folder, which only a local master may use."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path for one table in the shared folder; what is written there is deleted when the driver's JVM ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/files-{uuid.uuid4().hex}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{folder.toString()}/table"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings for a while; a stream keeps those that it starts with."""
    former = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in former.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def kept(df: DataFrame) -> DataFrame:
    """df written once and read again, for queries that use it several times: nothing stays in the executors' memory."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_text(records: DataFrame, by: str | None = None) -> str:
    """records' column `value`, lines and all, as text files; with `by`, one file for each of its values, in a folder by=value."""
    path = new_path(records.sparkSession)
    if by:
        records.repartition(by).select("value", by).write.partitionBy(by).text(path)
    else:
        records.select("value").write.text(path)
    return path
