"""Strings: blanks, slugs, record keys, question and motion texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at either end; null counts as blank."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return strip(c) == ""


def first_filled(*columns: Column) -> Column:
    """The first that is not blank, stripped; blank if none is."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in columns], F.lit(""))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def record_key(data_type: Column, member_id: Column, member_name: Column, date: Column, title: Column, text: Column) -> Column:
    """Content hash of an enveloped record: what a second pull of the same record also holds."""
    parts = [data_type, member_id, member_name, F.substring(date, 1, 10), title, F.substring(text, 1, 300)]
    return F.sha1(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]))


def roster_key(member_id: Column, name: Column, party: Column, constituency: Column, role: Column) -> Column:
    """Content hash of a roster row; status is left out, so a change of it saves no second row."""
    parts = [member_id, name, party, constituency, role]
    return F.sha1(F.concat_ws("|", F.lit("member"), *[F.coalesce(p, F.lit("")) for p in parts]))


def question_text(question: Column, answer: Column) -> Column:
    """Question and answer as one text where there is an answer."""
    both = F.concat(F.lit("Question: "), strip(question), F.lit("\n\nAnswer: "), strip(answer))
    return F.when(~blank(answer), both).otherwise(strip(question))


def motion_text(title: Column, text: Column) -> Column:
    """The title, else the text without its ``Voted ... on:`` prefix."""
    stripped = strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)^\s*voted\s+\w+\s+on:\s*", ""))
    return F.when(~blank(title), strip(title)).otherwise(stripped)


def question_id(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?i)^WQ(\d+)$", "WQ-$1")


def html_to_text(c: Column) -> Column:
    """Visible text of a fragment; what holds no ``<`` stays as it is."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(value))
    return F.when(F.contains(c, F.lit("<")), strip(F.regexp_replace(bare, r"\s+", " "))).otherwise(strip(c))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9']+)"), F.lit(1))
