"""Fresh folders that driver and executors share, for files a query lands and tables it reads more than once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, under a temporary folder, in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            made = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            _local[app] = f"file://{made}"
        found = _local[app]
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` as Parquet in such a folder, read back: what several branches of a report share is computed once."""
    path = path or folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies; none is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables cut from their lineage, deleted when the context is left; ``keep`` is for what a result still reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            removed(self.spark, path)

    def path(self, name: str) -> str:
        """A folder for files of another format, deleted with the tables."""
        self.paths.append(folder(self.spark, name))
        return self.paths[-1]

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name, self.path(name))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name)
