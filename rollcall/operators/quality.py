"""Completeness of records and rosters, limits that are known, run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.text import blank

#: Types for which no rows are normal: chambers do not sit every day.
NORMAL_EMPTY = ("plenary_business", "votes_on_division")


def _half(name: str) -> Column:
    """More than half, in whole numbers."""
    return F.col(name) > F.floor(F.col("n") / 2)


def completeness(records: DataFrame, keys: list[str]) -> DataFrame:
    """Per dataset: row count, blank fields, and what is wrong with them."""
    counted = records.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(blank(F.col("text"))).alias("empty_text"),
        F.count_if(blank(F.col("date"))).alias("empty_date"),
        F.count_if(blank(F.col("member_name"))).alias("empty_name"),
    )
    issues = [
        F.when(F.col("empty_text") == F.col("n"), F.lit("ALL text fields empty")).when(_half("empty_text"), _message("empty_text", "text")),
        F.when(_half("empty_date"), _message("empty_date", "date")),
        F.when(_half("empty_name"), _message("empty_name", "member name")),
    ]
    return counted.withColumn("issues", F.array_join(F.array_compact(F.array(*issues)), "; "))


def _message(name: str, label: str) -> Column:
    return F.concat(F.col(name).cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(f" {label} fields empty"))


def completeness_members(roster: DataFrame, keys: list[str]) -> DataFrame:
    counted = roster.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(blank(F.col("name"))).alias("empty_name"),
        F.count_if(blank(F.col("party"))).alias("empty_party"),
        F.count_if(blank(F.col("id"))).alias("empty_id"),
    )
    issues = [
        F.when(_half("empty_name"), _message("empty_name", "name")),
        F.when(F.col("empty_party") == F.col("n"), F.lit("ALL party fields empty")),
        F.when(F.col("empty_id") == F.col("n"), F.lit("ALL id fields empty")),
    ]
    return counted.withColumn("issues", F.array_join(F.array_compact(F.array(*issues)), "; "))


def quality_status(assessed: DataFrame, soft: Column) -> DataFrame:
    """PASS without issues; WARN where nothing came or a soft check failed; else FAIL."""
    status = F.when((F.col("n") > 0) & (F.col("issues") == ""), "PASS").when((F.col("n") == 0) | soft, "WARN").otherwise("FAIL")
    return assessed.withColumn("status", status)


def run_summary(ledger: DataFrame, limits: DataFrame) -> DataFrame:
    """Fetched, new and skipped rows per legislature and type with a verdict, and a total row.

    ``limits`` (legislature, data_type): known limitations, for which no rows are expected.
    """
    known = limits.withColumn("known", F.lit(True))
    joined = ledger.join(known, ["legislature", "data_type"], "left")
    verdict = (
        F.when((F.col("fetched") == 0) & F.coalesce("known", F.lit(False)), "expected limitation")
        .when((F.col("fetched") == 0) & F.col("data_type").isin(*NORMAL_EMPTY), "normal")
        .when(F.col("fetched") == 0, "needs attention")
        .otherwise("ok")
    )
    rows = joined.withColumn("verdict", verdict).drop("known")
    totals = ledger.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("fetched", "new", "skipped")])
    total = totals.select(F.lit("total").alias("legislature"), F.lit("").alias("data_type"), "fetched", "new", "skipped", F.lit("").alias("verdict"))
    return rows.select("legislature", "data_type", "fetched", "new", "skipped", "verdict").unionByName(total)


def shell_page(text: Column, chrome: list[str], id_pattern: str) -> Column:
    """An empty shell: two chrome markers or more and no item id."""
    markers = sum((F.contains(F.lower(text), F.lit(m.lower())).cast("int") for m in chrome), F.lit(0))
    return (markers >= 2) & ~F.coalesce(text, F.lit("")).rlike(id_pattern)


def content_gate(text: Column, phrases: list[str]) -> Column:
    """Any of the phrases, in any case."""
    return F.exists(F.array(*[F.lit(p.lower()) for p in phrases]), lambda p: F.contains(F.lower(text), p))


def coverage(records: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Records of each source, those with a name, and distinct names."""
    named = F.nullif(F.trim(name), F.lit(""))
    return records.groupBy(*keys).agg(F.count("*").alias("records"), F.count(named).alias("named"), F.count_distinct(named).alias("members"))
