"""Dates in free text and in the sources' formats, as ISO strings; blank where there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def iso(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))


def parsed(c: Column, pattern: str) -> Column:
    return F.to_date(F.try_to_timestamp(F.nullif(c, F.lit("")), F.lit(pattern)))


def date10(c: Column) -> Column:
    """The leading date of an ISO string with or without a time; null if it is none."""
    return parsed(F.regexp_extract(F.coalesce(c, F.lit("")), r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")


def _long_date(c: Column, lead: str = "", flags: str = "(?i)") -> Column:
    found = F.regexp_extract(c, rf"{flags}{lead}\b(\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}})\b", 1)
    return parsed(F.initcap(F.regexp_replace(found, r"\s+", " ")), "d MMMM yyyy")


def extract_date(c: Column) -> Column:
    """First date in a text: ISO as it stands, then D/M/Y or D.M.Y, then D Month YYYY; an invalid one falls through."""
    text = F.coalesce(c, F.lit(""))
    plain = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    slashed = F.replace(F.regexp_extract(text, r"\b(\d{1,2}[./]\d{1,2}[./]\d{4})\b", 1), F.lit("."), F.lit("/"))
    return F.coalesce(F.nullif(plain, F.lit("")), F.nullif(iso(parsed(slashed, "d/M/yyyy")), F.lit("")), iso(_long_date(text)))


def vote_date(c: Column) -> Column:
    """Date a division was taken, else lodged, else any long date."""
    text = F.coalesce(c, F.lit(""))
    return iso(
        F.coalesce(
            _long_date(text, r"Taken in the Chamber on[^0-9]*", ""),
            _long_date(text, r"Date lodged:[^0-9]*", ""),
            _long_date(text, "", ""),
        )
    )


def snapshot_date(c: Column) -> Column:
    """Date of an edition that is captioned "as on D Month YYYY"."""
    return iso(_long_date(F.coalesce(c, F.lit("")), r"as on "))


def day_first(c: Column) -> Column:
    """DD/MM/YYYY or DD-MM-YYYY to ISO."""
    return iso(parsed(F.translate(F.coalesce(c, F.lit("")), "-", "/"), "d/M/yyyy"))


def epoch_millis(c: Column) -> Column:
    """``/Date(ms)/`` to ISO (UTC)."""
    ms = F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"/Date\((-?\d+)", 1), F.lit("")).cast("long")
    return iso(F.to_date(F.timestamp_millis(ms)))


def within_days(a: Column, b: Column, days: int) -> Column:
    """Whether two ISO dates are at most ``days`` apart; false if either is none."""
    return F.coalesce(F.abs(F.datediff(date10(a), date10(b))) <= days, F.lit(False))


def search_format(c: Column) -> Column:
    """``Weekday, Mon D, YYYY`` of an ISO date."""
    return F.date_format(date10(c), "EEEE, MMM d, yyyy")
