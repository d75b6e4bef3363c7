"""Sinks: run files, the append-only master with its keys, ledger, reports, nested payload."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.schema import LEDGER
from rollcall.sources import readers
from rollcall.sources.scratch import Scratch


def flatten_record(records: DataFrame, metadata: list[str]) -> DataFrame:
    """One level of nesting as columns: member_*, metadata_*."""
    member = [F.col("member")[f].alias(f"member_{f}") for f in records.schema["member"].dataType.names]
    extra = [F.try_element_at("metadata", F.lit(k)).alias(f"metadata_{k}") for k in metadata]
    rest = [c for c in records.columns if c not in ("member", "metadata")]
    return records.select(*rest, *member, *extra)


def write_run(records: DataFrame, path: str) -> None:
    """A run's records as JSON, by legislature and day; runs of one day add up."""
    records.write.partitionBy("legislature", "run_date").mode("append").json(path)


def write_flat(records: DataFrame, path: str, metadata: list[str]) -> None:
    """Records as flat CSV for spreadsheets, quotes doubled, each file with a byte-order mark."""
    _marked(flatten_record(records, metadata)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` with a byte-order mark before the first name, so that each CSV file with a header opens with it."""
    first, *rest = rows.columns
    return rows.select(F.col(first).alias("\ufeff" + first), *rest)


def write_xml(rows: DataFrame, path: str, row_tag: str, root_tag: str, most: int = 100_000) -> None:
    """Rows as XML files of at most ``most`` rows, since one task reads a whole file back."""
    rows.write.format("xml").option("rowTag", row_tag).option("rootTag", root_tag).option("maxRecordsPerFile", most).mode("append").save(path)


def append_master(batch: DataFrame, path: str, columns: list[str], name: str | None = None) -> int:
    """Append the rows that the master lacks as one batch (see ``streaming.ingest``); how many were new. ``name`` makes a retry harmless."""
    from rollcall.streaming.ingest import append_new

    return append_new(batch, path, columns, name or f"r{uuid.uuid4().hex}")


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append ledger rows to the log, in folders by legislature and month of the run; nothing that is there is touched."""
    logged = schema_filled(rows, LEDGER).withColumn("month", F.substring("run_date", 1, 7))
    logged.repartition("legislature", "month").write.mode("append").partitionBy("legislature", "month").parquet(path)


def schema_filled(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """``rows`` under ``schema``; columns that are missing are null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def compact_ledger(spark: SparkSession, path: str, until: str) -> None:
    """Months of the log before ``until`` (yyyy-MM) as one file a legislature and month, repeated rows once.

    The new files are written apart first, then take the place of those folders alone: a month that
    is still appended to is neither read nor replaced.
    """
    with Scratch(spark) as scratch:
        old = scratch.cut(readers.ledger_log(spark, path).filter(F.col("month") < until).dropDuplicates(), "ledger")
        settled = old.repartition("legislature", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        settled.partitionBy("legislature", "month").parquet(path)


def land_listing(rows: DataFrame, path: str, keys: list[str], page: str, date: str) -> None:
    """Land a listing in folders by day, and beside it one row a page with its newest date."""
    rows.withColumn("day", F.col(date)).write.mode("append").partitionBy("day").parquet(f"{path}/rows")
    newest = F.max(F.nullif(F.col(date), F.lit(""))).alias("newest")
    rows.groupBy(*keys, page).agg(newest).write.mode("append").parquet(f"{path}/pages")


def write_csv_report(report: DataFrame, path: str, order: list) -> None:
    """A report as CSV for spreadsheets, sorted over all its files, each with a byte-order mark."""
    _marked(report.orderBy(*order)).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_payload(lines: DataFrame, path: str) -> None:
    """The lines of ``reports.payload_lines`` as text by legislature, in order over a legislature's files: its document, a line each."""
    ordered = lines.repartitionByRange("legislature", "area", "member", "member_key").sortWithinPartitions("legislature", "area", "member", "member_key")
    ordered.select("legislature", "json").write.mode("overwrite").partitionBy("legislature").text(path)
