"""The folder for intermediate tables that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.

    Where that is unset, a local master (tests) gets a folder of its own; on a
    cluster no folder of this machine would do, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{tempfile.gettempdir()}/shelfmark/{spark.sparkContext.applicationId}"
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str, now: bool) -> None:
    """Delete a folder of whatever file system Spark reads it from, now or when the driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if now:
        system.delete(place, True)
    else:
        system.deleteOnExit(place)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: computed once and safe from lost executors; it goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete(spark, path, now=False)
    return spark.read.schema(df.schema).parquet(path)


class Steps:
    """Written tables of an iteration; each can be dropped as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.frames: list[DataFrame] = []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        self.frames.append(back)  # ids stay unique as long as the frames live
        return back

    def drop(self, df: DataFrame) -> None:
        if (path := self.paths.pop(id(df), None)) is not None:
            _delete(self.spark, path, now=True)


@contextmanager
def steps(spark: SparkSession) -> Iterator[Steps]:
    """Written tables that all go at the end of the block; what is to outlive it is ``written``."""
    held = Steps(spark)
    try:
        yield held
    finally:
        _delete(spark, held.folder, now=True)
