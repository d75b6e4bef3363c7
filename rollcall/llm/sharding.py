"""Sharding by jump consistent hashing, in DataFrame functions alone.

A stable key walks a chain of jumps 0 = j0 < j1 < ...; its shard among n is the
last jump below n. With one more shard a row stays where it is or moves to the
new one, so about 1/(n+1) of the rows move, and no ring table is kept.

The chain's generator is the 64-bit linear congruential one of the published
algorithm. Its wrapping product is done on two 32-bit halves, since Spark's
64-bit product raises an error on overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import cut

MULTIPLIER = 2862933555777941757  # fixed value of the algorithm
_M32 = 0xFFFFFFFF


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) of state * MULTIPLIER + 1 modulo 2**64, both halves below 2**32."""
    m_high, m_low = MULTIPLIER >> 32, MULTIPLIER & _M32
    mask = F.lit(_M32)
    part0 = low.bitwiseAND(F.lit(0xFFFF)) * F.lit(m_low) + F.lit(1)
    part1 = F.shiftright(low, 16) * F.lit(m_low)
    total = part0.bitwiseAND(mask) + F.shiftleft(part1.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftright(total, 32) + F.shiftright(part0, 32) + F.shiftright(part1, 16)
    crossed = (
        high.bitwiseAND(F.lit(0xFFFF)) * F.lit(m_low)
        + F.shiftleft((F.shiftright(high, 16) * F.lit(m_low)).bitwiseAND(F.lit(0xFFFF)), 16)
    ).bitwiseAND(mask)
    new_high = (carry + crossed + (low * F.lit(m_high)).bitwiseAND(mask)).bitwiseAND(mask)
    return new_high, total.bitwiseAND(mask)


def jump_hash(key: Column, n_shards: int) -> Column:
    """struct(shard, grown): the shard of a long key among ``n_shards`` and among one more.

    A null key counts as 0. Each step jumps by at least one, so n_shards + 1
    steps reach the end of any chain.
    """
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(F.lit(_M32)).alias("low"),
        zero.alias("at"),
        zero.alias("shard"),
        zero.alias("grown"),
    )

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        high, low = _next_state(state["high"], state["low"])
        jump = ((at + 1) * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1))).cast("long")
        return F.when(at > n_shards, state).otherwise(
            F.struct(
                high.alias("high"),
                low.alias("low"),
                jump.alias("at"),
                F.when(at < n_shards, at).otherwise(state["shard"]).alias("shard"),
                at.alias("grown"),
            )
        )

    steps = F.sequence(F.lit(1), F.lit(n_shards + 1))
    return F.aggregate(
        steps,
        start,
        step,
        lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")),
    )


def with_shard(df: DataFrame, key: str = "doc_id", n_shards: int = 40, column: str = "shard") -> DataFrame:
    """``df`` with its shard number; narrow, no shuffle. Replaces a column of that name."""
    return df.withColumn(column, jump_hash(F.col(key), n_shards)["shard"])


def shard_manifest(docs: DataFrame, n_shards: int = 40, blocks: int = 64) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``key``: doc_id (null: 0) and the shard count decide. Slots number a
    shard's rows from 0 without gaps, by (block, doc_id, size, text_crc32), nulls
    first. Blocks cut each shard into ``blocks`` parts by doc_id and checksum
    together, so that neither a hot doc_id nor a hot text fills one task; rows
    equal in all of these are counted before the shuffle and take consecutive
    slots. Null text: size 16, checksum 0. An empty table gives no rows; columns
    other than doc_id and text are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(text)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        crc.alias("text_crc32"),
    )
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    block = F.pmod(F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(blocks)) + F.col("text_crc32"), F.lit(blocks))
    jumped = counted.withColumn("jump", jump_hash(F.col("doc_id"), n_shards)).select(
        "doc_id", "size", "text_crc32", "n", F.col("jump.shard").alias("shard"), F.col("jump.grown").alias("grown_shard"), block.alias("block")
    )
    # written once, a few numbers a row: the texts are not read again for the blocks' totals
    placed = cut(jumped, "shards")
    # n_shards * blocks rows at most: the block's first slot within its shard
    totals = placed.groupBy("shard", "block").agg(F.sum("n").alias("total"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    within = (
        Window.partitionBy("shard", "block")
        .orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = placed.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(starts), ["shard", "block"])
    first = F.col("start") + F.col("before")
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot"),
        "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, files_per_shard: int = 8, key: str = "doc_id") -> None:
    """Write whole rows to ``path/shard=N``; each shard is dealt to several tasks by a hash of the row."""
    part = F.pmod(F.xxhash64(*[F.col(c) for c, t in docs.dtypes if not t.startswith("map")]), F.lit(files_per_shard))
    placed = with_shard(docs, key, n_shards)
    placed.repartition(F.col("shard"), part).write.partitionBy("shard").parquet(path)
