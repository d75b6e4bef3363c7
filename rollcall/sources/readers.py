"""Scans: master CSV, landed JSON and XML, ledgers; all distributed, all with a schema."""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.schema import LEDGER, strings

WRAPPERS = ("items", "results", "value", "data")


def master_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A master table: all strings, blanks kept as blanks, quotes doubled, lines within fields; no file gives no rows."""
    schema = strings(*columns)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path).fillna("")


def _lists(item: T.StructType, wrappers: tuple[str, ...]) -> T.StructType:
    """An array of items under each wrapper; each item stands alone or in ``{value: ...}``."""
    each = T.StructType([T.StructField("value", item), *[f for f in item.fields if f.name != "value"]])
    return T.StructType([T.StructField(w, T.ArrayType(each)) for w in wrappers])


def json_items(spark: SparkSession, path: str, item: T.StructType, wrappers: tuple[str, ...] = WRAPPERS) -> DataFrame:
    """Items of landed JSON batches: the array under the first wrapper that is there, each item perhaps in ``{value: ...}``."""
    landed = spark.read.schema(_lists(item, wrappers)).option("multiLine", True).json(path)
    each = landed.select(F.explode(F.coalesce(*wrappers)).alias("e"))
    return each.select(*[F.coalesce(F.col("e.value")[f.name], F.col("e")[f.name]).alias(f.name) for f in item.fields])


def json_text_items(rows: DataFrame, text: str, item: T.StructType, keep: list[str], wrappers: tuple[str, ...] = WRAPPERS) -> DataFrame:
    """As ``json_items`` for JSON that stands in a column."""
    landed = rows.select(*keep, F.from_json(text, _lists(item, wrappers)).alias("j"))
    each = landed.select(*keep, F.explode(F.coalesce(*[F.col("j")[w] for w in wrappers])).alias("e"))
    return each.select(*keep, *[F.coalesce(F.col("e.value")[f.name], F.col("e")[f.name]).alias(f.name) for f in item.fields])


def leading_list(text: str | None) -> str | None:
    """JSON text of the list that a response leads with: itself, or what stands under the first key, however deep; None if that is no list."""
    try:
        found = json.loads(text or "")
    except (ValueError, RecursionError):
        return None
    while isinstance(found, dict):
        found = next(iter(found.values()), None)
    return json.dumps(found, ensure_ascii=False) if isinstance(found, list) else None


def first_list(text: Column) -> Column:
    """``leading_list`` of each response: wrappers of any names, nested to any depth."""
    return F.pandas_udf(lambda texts: texts.map(leading_list), "string")(text)


def first_list_items(rows: DataFrame, text: str, item: T.StructType, keep: list[str]) -> DataFrame:
    """Items of batches whose wrapper has no known name."""
    each = rows.select(*keep, F.explode(F.from_json(first_list(F.col(text)), T.ArrayType(item))).alias("e"))
    return each.select(*keep, *[F.col("e")[f.name].alias(f.name) for f in item.fields])


def csv_report(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV report read back by the place of its columns, as strings, with or without a byte-order mark."""
    return spark.read.schema(strings(*columns)).option("header", True).option("multiLine", True).option("escape", '"').csv(path).fillna("")


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def xml_rows_by_child(spark: SparkSession, path: str, child: str, fields: list[str]) -> DataFrame:
    """Rows of XML files whatever their tag: the elements with a ``child`` element; ``fields`` are the texts of their children.

    Namespaces and prefixes don't count. Missing fields are null, and of a repeated child the first with a
    text counts. A file is parsed by one task as a stream of elements; a file that is no XML gives the rows
    before its fault. Files may differ in their tags, in what they hold and in the order of it.
    """

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                rows = []
                for row in elements_with_child(content, child):
                    rows.append([row.get(f) for f in fields])
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=fields)
                        rows = []
                yield pd.DataFrame(rows, columns=fields)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parsed, strings(*fields))


def elements_with_child(content: bytes, child: str) -> Iterator[dict[str, str]]:
    """Child name: text, for each element of the file that has an element ``child``; elements are freed as they end."""
    parser = ElementTree.XMLPullParser(("start", "end"))
    path: list[dict[str, str]] = []
    inside: list[ElementTree.Element] = []  # open elements, which would else keep all that ended in them
    try:
        for at in range(0, len(content), 1 << 16):
            parser.feed(content[at : at + (1 << 16)])
            for event, el in parser.read_events():
                if event == "start":
                    path.append({})
                    inside.append(el)
                    continue
                own = path.pop()
                inside.pop()
                if child in own:
                    yield own
                name = el.tag.rsplit("}", 1)[-1]
                text = (el.text or "").strip()
                if path and (name not in path[-1] or text and not path[-1][name]):
                    path[-1][name] = text
                el.clear()
                if inside:
                    inside[-1].remove(el)
    except ElementTree.ParseError:
        return


def ledger_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the ledger's log, with the month folder they lie in."""
    columns = T.StructType([*[f for f in LEDGER.fields if f.name != "legislature"], LEDGER["legislature"], T.StructField("month", T.StringType())])
    return spark.read.schema(columns).parquet(path)


def ledger(spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame:
    """The ledger as it stands, or as it stood at the time ``as_of``."""
    rows = ledger_log(spark, path)
    rows = rows if as_of is None else rows.filter(F.col("pulled_at") <= F.lit(as_of).cast("timestamp"))
    return rows.select(*LEDGER.names)


def listing_since(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], page: str, date: str, bound: str) -> DataFrame:
    """A landed listing back to ``bound``: only folders of its days are read, and pages before the first that is older as a whole.

    One small row a page decides where a listing ends.
    """
    landed = spark.read.schema(T.StructType([*schema.fields, T.StructField("day", T.StringType())])).parquet(f"{path}/rows")
    pages = spark.read.parquet(f"{path}/pages")
    ends = pages.filter(F.col("newest") < bound).groupBy(*keys).agg(F.min(page).alias("_end"))
    since = landed.filter(F.col("day") >= bound).drop("day")
    return since.join(ends, keys, "left").filter(F.col("_end").isNull() | (F.col(page) < F.col("_end"))).drop("_end")
