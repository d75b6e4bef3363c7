"""Streaming ingestion: exactly-once by content key, late rows kept apart, windowed counts.

The dedup has no horizon, so it keeps no stream state: each micro-batch is held against an
index of the keys seen so far. The index lies in parts by a hash of the key, and a batch
reads only the parts that its own keys fall into. Rows, keys and a line of the manifest are
written per batch, in this order; what has no line in the manifest is not there for any reader,
so a batch that was cut short is simply written again. One writer at a time is assumed.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rollcall.operators.ingest import new_records, schema_align
from rollcall.schema import strings

#: Parts of the key index; fixed once a master has been written.
PARTS = 64


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _there(spark, path) else spark.createDataFrame([], schema)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(batch, rows) of the batches that are whole."""
    return _read(spark, f"{path}/manifest", "rows long, batch string")


def committed(spark: SparkSession, path: str, batch: str) -> bool:
    return not manifest(spark, path).filter(F.col("batch") == batch).isEmpty()


def _commit(spark: SparkSession, path: str, batch: str, rows: int) -> None:
    spark.createDataFrame([(rows,)], "rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch}")


def master_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The rows of all whole batches at ``path``; empty before the first."""
    rows = _read(spark, f"{path}/rows", strings(*columns, "key", "batch"))
    return rows.join(manifest(spark, path).select("batch"), "batch", "left_semi").select(*columns, "key")


def key_part(key: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def seen_keys(spark: SparkSession, path: str, parts: list[int]) -> DataFrame:
    """Keys of whole batches that lie in ``parts``; no other part is read."""
    keys = _read(spark, f"{path}/keys", "key string, batch string, part int").filter(F.col("part").isin(parts))
    return keys.join(manifest(spark, path).select("batch"), "batch", "left_semi").select("key")


def append_new(batch: DataFrame, path: str, columns: list[str], name: str, seq: str = "seq", parts: int = PARTS) -> int:
    """Append the rows whose key the master lacks, each key once, as batch ``name``; how many there were.

    A batch of a name that is whole already adds nothing. A null key counts as one key of its own
    and is never seen.
    """
    spark = batch.sparkSession
    if committed(spark, path, name):
        return 0
    held = batch.persist()
    here = [r[0] for r in held.select(key_part(F.col("key"), parts)).distinct().collect()]  # at most ``parts`` numbers
    fresh = schema_align(new_records(held, seen_keys(spark, path, here), order=seq), [*columns, "key"])
    fresh.write.mode("overwrite").parquet(f"{path}/rows/batch={name}")
    held.unpersist()
    rows = spark.read.schema(fresh.schema).parquet(f"{path}/rows/batch={name}")
    keys = rows.select("key").withColumn("part", key_part(F.col("key"), parts))
    keys.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/keys/batch={name}")
    n = rows.count()
    _commit(spark, path, name, n)
    return n


def _named(checkpoint: str, number: int) -> str:
    """Batches of one checkpoint are told apart by their number, those of others by the checkpoint's place."""
    return f"b{hashlib.sha256(checkpoint.encode()).hexdigest()[:12]}-{number}"


def dedup_into_master(stream: DataFrame, path: str, columns: list[str], checkpoint: str, seq: str = "seq") -> StreamingQuery:
    """Append each micro-batch's unseen keys to the master; a batch that is run again adds nothing."""

    def append(batch: DataFrame, number: int) -> None:
        append_new(batch, path, columns, _named(checkpoint, number), seq)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_late(stream: DataFrame, path: str, checkpoint: str, time: str, window_s: int, late_s: int) -> StreamingQuery:
    """Each micro-batch in two: rows whose window is still open go to ``path/rows/late=false``, others to ``late=true``.

    A window of ``window_s`` seconds is closed once the newest time of earlier batches, less ``late_s``, has
    reached its end; that is the watermark of ``counts_per_window``, so it loses none of the rows that are
    on time. Rows without a time are on time. Nothing is dropped: late rows stay in their own table.
    """

    def split(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, _named(checkpoint, number)
        if committed(spark, path, name):
            return
        earlier = _read(spark, f"{path}/newest", "newest timestamp, batch string").join(manifest(spark, path).select("batch"), "batch", "left_semi")
        newest = earlier.agg(F.unix_micros(F.max("newest"))).first()[0]
        end = (F.floor(F.unix_seconds(time) / window_s) + 1) * window_s
        late = F.lit(False) if newest is None else F.coalesce(end * 1_000_000 <= newest - late_s * 1_000_000, F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/batch={name}")
        batch.agg(F.max(time).cast("timestamp").alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/batch={name}")
        _commit(spark, path, name, 0)

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_rows(spark: SparkSession, path: str, schema: str, late: bool) -> DataFrame:
    """The late or the timely rows that ``split_late`` has written, of whole batches."""
    rows = _read(spark, f"{path}/rows", f"{schema}, batch string, late boolean").filter(F.col("late") == late)
    return rows.join(manifest(spark, path).select("batch"), "batch", "left_semi").drop("batch", "late")


def timely_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The timely rows as a stream of their own, once ``split_late`` has run."""
    return spark.readStream.schema(f"{schema}, batch string, late boolean").parquet(f"{path}/rows").filter("NOT late").drop("batch", "late")


def counts_per_window(stream: DataFrame, time: str, window: str, late: str, *keys: str) -> DataFrame:
    """Rows per window and keys; for append output, where a window is given out once it has closed and its state is freed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"))


def closed_windows(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the counts of closed windows to ``path``."""
    sink = counts.writeStream.outputMode("append").format("parquet").option("path", path)
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent_dedup(stream: DataFrame, time: str, key: str, horizon: str) -> DataFrame:
    """First row per key within a bounded horizon, for sources that repeat only soon."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])
