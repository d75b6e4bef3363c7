"""The corpus pipeline: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of ``documents``; the last returns the pieces of packed sequences with their ids.

Awkward input has a defined result in every stage, and none fails on it. A null or empty
text, or one without letters, has no language and goes in the first stage. Rows that repeat
in doc_id and text stay once after the second, and of equal texts the smallest doc_id's. A
null doc_id passes every stage and comes last among copies. An empty table stays empty; an
empty benchmark rejects nothing. Further columns pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import decontamination, language_id, near_dedup, packing, pii
from rollcall.llm.common import Scratch, cut, table


#: What Python workers are started with: memory that a stage has freed goes back to the machine before the next one.
_MEMORY = {"MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_MMAP_THRESHOLD_": "1048576", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def _frugal(spark: SparkSession) -> None:
    """Texts are long, so tasks hold 1,000 of them at once and no more; workers of all stages give memory back."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.sparkContext.environment.update(_MEMORY)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    _frugal(spark)
    return language_id.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    _frugal(spark)
    return near_dedup.keep_one(docs, size=5, percent=80)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    _frugal(spark)
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    _frugal(spark)
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 token ids, neighbours on the space-filling curve together."""
    _frugal(spark)
    return packing.pack(docs, size=2048)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Trained models, signatures and alignment are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-2]:
            docs = scratch.cut(stage(spark, docs, sf_dir), name)
        name, stage = STAGES[-2]
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
