"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, a temporary one, in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        made = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _local[app] = f"file://{made}"
    return _local[app]


class Scratch:
    """Parquet tables in the shared folder: cuts in the lineage that any executor can read again.

    ``drop`` deletes a table once its last reader is done; leaving the context deletes the others.
    What a returned DataFrame still reads is cut by ``keep``, and stays for the clean-up of that folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.held: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*(df for df, _ in self.held))

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read again."""
        out, path = _written(df, name)
        self.held.append((out, path))
        return out

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return _written(df, name)[0]

    def drop(self, *tables: DataFrame) -> None:
        for df, path in [x for x in self.held if any(x[0] is t for t in tables)]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
            self.held = [x for x in self.held if x[1] != path]


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, for a result that is read after this call returns."""
    return _written(df, name)[0]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def broadcast_value(spark: SparkSession, value) -> Callable:
    """A function that gives ``value`` in any task, unpickled once a worker."""
    shared = spark.sparkContext.broadcast(pickle.dumps(value))
    held: list = []

    def get():
        if not held:
            held.append(pickle.loads(shared.value))
        return held[0]

    return get


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def share_of(share: float, *key: str) -> Column:
    """Whether a row's hash of ``key`` falls into the first ``share`` of all hashes."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < max(1, int(min(1.0, share) * (1 << 30)))


def stratified_sample(df: DataFrame, rows: int, stratum: str, *key: str, strata: int = 200) -> DataFrame:
    """About ``rows`` rows of ``df``, in proportion to the strata but with 20 of each at least; all of a smaller table or stratum.

    The ``strata`` largest are kept apart (ties: the smaller name); all others are one stratum, however many there are, so
    that neither the plan nor the sample grows with odd labels. Rows are chosen by a hash of ``key``; in a
    larger table, rows alike in it and the stratum count once.
    """
    counted = df.groupBy(stratum).count()
    total, kinds = counted.agg(F.sum("count"), F.count("*")).first()
    if (total or 0) <= rows:
        return df
    counts = {r[stratum]: r["count"] for r in counted.orderBy(F.desc("count"), stratum).limit(strata).collect()}
    rest = total - sum(counts.values())
    least = max(20, rows // (4 * (len(counts) + (kinds > len(counts)))))

    def share(n: int) -> int:
        return int(min(1.0, max(rows / total, least / n)) * (1 << 30)) if n else 0

    shares = F.create_map(*(F.lit(x) for s, n in counts.items() for x in (s, share(n))))[F.col(stratum)]
    chosen = F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < F.coalesce(shares, F.lit(share(rest)))
    return df.filter(chosen).dropDuplicates([stratum, *key])


def hashed_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """About ``rows`` rows of ``df``, chosen by a hash of ``key``; all of a smaller table.

    The table's count sets the share that is taken, so every task filters its own rows and none
    gathers them. Rows alike in ``key`` go together: derive what is small from them, and then
    count rows alike in that once, before any of it is collected.
    """
    total = df.count()
    return df if total <= rows else df.filter(share_of(rows / total, *key))
