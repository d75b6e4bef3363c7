"""Ordered lines and turns: speakers carried forward, headings that open segments.

Everything is per document, in the order of a line number; windows partition by
document, so documents spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions.text import strip


def doc_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line): non-blank lines, trimmed; numbers are those of the text, from 0."""
    lines = docs.select(key, F.posexplode(F.split(text, r"\R")).alias("line_no", "line"))
    return lines.withColumn("line", strip(F.col("line"))).filter("line <> ''")


def carry_speaker(turns: DataFrame, key: str, order: str, name: str, heading: Column) -> DataFrame:
    """``turns`` with ``carried``: the row's own speaker, else the last one since a heading.

    A heading row still gets the speaker before it; what follows starts anew.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(key, "part").orderBy(order)
    parted = turns.withColumn("part", F.coalesce(F.sum(heading.cast("int")).over(before), F.lit(0)))
    own = F.nullif(strip(F.col(name)), F.lit(""))
    return parted.withColumn("carried", F.coalesce(F.last(own, ignorenulls=True).over(within), F.lit(""))).drop("part")


def paragraph_speakers(paragraphs: DataFrame, key: str, order: str, text: str, bold: str, least: int = 20) -> DataFrame:
    """Paragraphs of ``least`` characters or more with ``speaker``: the bold name, else a short prefix before a colon, else the last one found.

    A prefix ends within the first 80 characters, has 1 to 60 of them and opens with no digit.
    """
    head = F.when(F.contains(F.substring(text, 1, 80), F.lit(":")), strip(F.substring_index(text, ":", 1)))
    prefix = F.when(F.length(head).between(1, 60) & ~F.rlike(head, F.lit(r"^\d")), head)
    own = strip(F.coalesce(F.nullif(strip(F.col(bold)), F.lit("")), prefix))
    name = F.nullif(strip(F.regexp_replace(own, ":+$", "")), F.lit(""))
    long = paragraphs.filter(F.length(text) >= least).withColumn("speaker", name)
    sofar = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return long.withColumn("speaker", F.coalesce(F.last("speaker", ignorenulls=True).over(sofar), F.lit("")))


def speech_segments(lines: DataFrame, key: str, speaker: Column, least: int = 10) -> DataFrame:
    """(key, segment, speaker, text): each speaker line opens a segment that later lines join; what stands before the first is dropped."""
    order = Window.partitionBy(key).orderBy("line_no")
    marked = lines.withColumn("speaker", F.nullif(speaker, F.lit("")))
    numbered = marked.withColumn("segment", F.sum(F.col("speaker").isNotNull().cast("int")).over(order)).filter("segment > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")
    out = numbered.groupBy(key, "segment").agg(F.max("speaker").alias("speaker"), joined.alias("text"))
    return out.filter(F.length("text") >= least)


def register_entries(lines: DataFrame, key: str, owner: Column, category: Column, noise: Column, least: int = 5) -> DataFrame:
    """(key, entry, owner, category, text): lines between headings, under the last owner and category.

    ``owner`` and ``category`` are null or blank on lines that are no heading; an
    owner label alone (``:`` at its end) takes the next line as the name. A heading
    that repeats its owner opens no new entry.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    clean = lines.filter(~noise)
    label = owner.isNotNull() & owner.endswith(":")
    named = clean.withColumn("label", label).withColumn("after", F.coalesce(F.lag("label").over(order), F.lit(False)))
    named = named.withColumn("own", F.when(F.col("label"), F.lit(None)).when(F.col("after"), F.col("line")).otherwise(F.nullif(owner, F.lit("")))).filter(~F.col("label"))
    named = named.withColumn("cat", F.when(F.col("own").isNull(), F.nullif(category, F.lit(""))))
    previous = F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    named = named.withColumn("opens", (F.col("own").isNotNull() & ~F.col("own").eqNullSafe(previous)) | F.col("cat").isNotNull())
    heading = F.col("own").isNotNull() | F.col("cat").isNotNull()
    filled = named.withColumns(
        {
            "owner": F.last("own", ignorenulls=True).over(order),
            "category": F.last("cat", ignorenulls=True).over(order),
            "entry": F.sum(F.col("opens").cast("int")).over(order),
            "heading": heading,
        }
    ).filter("not heading and owner is not null")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")
    out = filled.groupBy(key, "entry").agg(F.max("owner").alias("owner"), F.max("category").alias("category"), joined.alias("text"))
    return out.filter(F.length("text") >= least)
