"""Schemas of the canonical tables: roster, record envelope, lexicon, ledger."""

from __future__ import annotations

from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


MEMBER_FIELDS = ("id", "name", "party", "constituency", "role", "status")
MEMBER = strings(*MEMBER_FIELDS)

ENVELOPE = T.StructType(
    [
        T.StructField("parliament", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("member", MEMBER),
        T.StructField("date", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("pulled_at", T.TimestampType()),
        T.StructField("source_url", T.StringType()),
    ]
)

LEXICON = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("kind", T.StringType()),  # kw, pro, con or tone
        T.StructField("topic", T.StringType()),
        T.StructField("polarity", T.IntegerType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("legislature", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("run_date", T.StringType()),
        T.StructField("from_date", T.StringType()),
        T.StructField("to_date", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("complete", T.BooleanType()),
        T.StructField("pulled_at", T.TimestampType()),
    ]
)

DATA_TYPES = ("members", "register_of_interests", "questions", "plenary_business", "votes_on_division")
