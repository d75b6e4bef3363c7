"""Incremental ingestion: first-wins dedup, new-minus-seen, ledger, cursors, backfill chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions.dates import date10


def batch_dedup(batch: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """The first row of each key; only its columns are moved once, combined before the shuffle."""
    columns = batch.columns
    first = batch.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("r"))
    return first.select(*[F.col("r")[c].alias(c) for c in columns])


def new_records(batch: DataFrame, master: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """Rows of ``batch`` whose key the master lacks, each key once."""
    return batch_dedup(batch.join(master.select(key), key, "left_anti"), key, order)


def schema_align(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` under a master's columns: others are dropped, missing ones are blank."""
    return rows.select(*[F.col(c).cast("string").alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns])


def filter_to_date(rows: DataFrame, date: str, to: str) -> DataFrame:
    """Rows up to ``to``; undated ones stay."""
    day = F.substring(F.coalesce(date, F.lit("")), 1, 10)
    return rows.filter((day == "") | (day <= to))


def filter_date_range(rows: DataFrame, date: str, start: str, to: str) -> DataFrame:
    """Rows from ``start`` to ``to``; those whose date cannot be read stay."""
    day = date10(F.col(date))
    return rows.filter(day.isNull() | day.between(F.lit(start).cast("date"), F.lit(to).cast("date")))


def latest_ledger(ledger: DataFrame) -> DataFrame:
    """The last row of each legislature and data type."""
    rest = [c for c in ledger.columns if c not in ("legislature", "data_type")]
    return ledger.groupBy("legislature", "data_type").agg(F.max_by(F.struct(*rest), F.struct("run_date", "pulled_at")).alias("r")).select("legislature", "data_type", "r.*")


def resume_from(ledger: DataFrame, n_types: int) -> DataFrame:
    """Per legislature: the cursor after its last run in which all ``n_types`` types were complete.

    Flags count for their own run only, so an early end never advances the cursor.
    """
    runs = ledger.groupBy("legislature", "run_date").agg(
        (F.bool_and("complete") & (F.count_distinct("data_type") == n_types)).alias("whole"), F.min(F.least("to_date", "run_date")).alias("cursor")
    )
    return runs.groupBy("legislature").agg(F.max(F.when(F.col("whole"), F.col("cursor"))).alias("resume_from"), F.max("run_date").alias("last_run"))


def pending_types(wanted: DataFrame, ledger: DataFrame) -> DataFrame:
    """Wanted (legislature, data_type, run_date, from_date, to_date) rows without a complete ledger row of that day and range."""
    done = ledger.filter("complete")
    return wanted.join(done, ["legislature", "data_type", "run_date", "from_date", "to_date"], "left_anti")


def run_ledger(records: DataFrame, limit: int) -> DataFrame:
    """A ledger row per legislature, type and run: range, count, and whether the pull stayed below its cap."""
    return records.groupBy("legislature", "data_type", "run_date").agg(
        F.min("date").alias("from_date"), F.max("date").alias("to_date"), F.count("*").alias("count"), (F.count("*") < limit).alias("complete")
    )


def date_chunks(ranges: DataFrame, days: int, half_open: bool = False) -> DataFrame:
    """``ranges`` (.., start, end dates) cut into chunks of ``days``: (chunk_from, chunk_to).

    Inclusive chunks share no day. Half-open ones meet at their ends and leave out a
    start that equals the end.
    """
    step = F.make_interval(days=F.lit(days)) if half_open else F.make_interval(days=F.lit(days + 1))
    last = F.date_sub("end", 1) if half_open else F.col("end")
    starts = F.when(last >= F.col("start"), F.sequence(F.col("start"), last, step)).otherwise(F.array().cast("array<date>"))
    cut = ranges.withColumn("chunk_from", F.explode(starts))
    return cut.withColumn("chunk_to", F.least(F.date_add("chunk_from", days), F.col("end")))


def quarter_chunks(ranges: DataFrame, first_year: int = 2015) -> DataFrame:
    """Calendar quarters of a full pull, from ``first_year`` to each row's end, where the last one is cut: (chunk_from, chunk_to)."""
    start = F.make_date(F.lit(first_year), F.lit(1), F.lit(1))
    starts = F.when(F.col("end") >= start, F.sequence(start, F.col("end"), F.expr("interval 3 months"))).otherwise(F.array().cast("array<date>"))
    cut = ranges.withColumn("chunk_from", F.explode(starts))
    return cut.withColumn("chunk_to", F.least(F.date_sub(F.add_months("chunk_from", 3), 1), F.col("end")))


def stops_at_old_page(rows: DataFrame, keys: list[str], page: str, date: str, bound: Column) -> DataFrame:
    """Rows on or after ``bound`` from the pages of a newest-first listing before the first one that is older as a whole.

    Pages without any date stop nothing. One small row a page decides, so no listing is gathered.
    """
    pages = rows.withColumn("_bound", bound).groupBy(*keys, page).agg(F.max(F.nullif(F.col(date), F.lit(""))).alias("newest"), F.max("_bound").alias("_bound"))
    ends = pages.filter("newest < _bound").groupBy(*keys).agg(F.min(page).alias("_end"))
    read = rows.join(ends, keys, "left").filter(F.col("_end").isNull() | (F.col(page) < F.col("_end")))
    return read.filter(F.col(date) >= bound).drop("_end")


def weekday_calendar(ranges: DataFrame) -> DataFrame:
    """A row per weekday of each range."""
    days = ranges.withColumn("day", F.explode(F.sequence("start", "end")))
    return days.filter(F.weekday("day") < 5)


def stops_after_empty(days: DataFrame, keys: list[str], empty: Column, limit: int) -> DataFrame:
    """Days, newest first, up to the first run of ``limit`` empty ones: where a backward pull ends."""
    order = Window.partitionBy(*keys).orderBy(F.desc("day"))
    runs = days.withColumn("full", F.sum((~empty).cast("int")).over(order))
    since = Window.partitionBy(*keys, "full").orderBy(F.desc("day"))
    counted = runs.withColumn("run", F.sum(empty.cast("int")).over(since))
    reached = F.max((F.col("run") >= limit).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return counted.withColumn("ended", F.coalesce(reached, F.lit(0))).filter("ended = 0").drop("full", "run", "ended")


def source_fallback(rows: DataFrame, keys: list[str], rank: str = "source_rank") -> DataFrame:
    """Rows of the best-ranked source that gave any, per ``keys``."""
    best = rows.groupBy(*keys).agg(F.min(rank).alias(rank))
    return rows.join(best, [*keys, rank], "left_semi")


def ordered_distinct(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct ``keys`` with the place where each first stands."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def capped_listing(rows: DataFrame, keys: list[str], order: list, cap: int) -> DataFrame:
    """The first ``cap`` rows of each listing with ``truncated``; a listing's cap is its feature."""
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    sizes = rows.groupBy(*keys).agg((F.count("*") > cap).alias("truncated"))
    return ranked.filter(F.col("place") <= cap).join(sizes, keys)
