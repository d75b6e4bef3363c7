"""Service: eligible divisions, spells of service, terms and turnout.

"Divisions held up to a date" is one running count per legislature over its distinct
division dates, which are few; a member's dates look it up with an equi-join. No range
join is needed: a count between two dates is the difference of two lookups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions.dates import date10, within_days
from rollcall.functions.votes import pct

GAP_DAYS, MIN_MISSED, GRACE_DAYS = 365, 40, 60


def running_divisions(divisions: DataFrame, dates: DataFrame) -> DataFrame:
    """(legislature, date, before, through): divisions before and up to each date that ``divisions`` or ``dates`` hold.

    The running sum goes over a legislature's distinct dates, not over its rows.
    """
    held = divisions.filter("date <> ''").groupBy("legislature", "date").agg(F.count("*").alias("n"))
    asked = dates.select("legislature", "date").distinct().withColumn("n", F.lit(0).cast("long"))
    per_date = held.unionByName(asked).groupBy("legislature", "date").agg(F.sum("n").alias("n"))
    through = F.sum("n").over(Window.partitionBy("legislature").orderBy("date"))
    return per_date.select("legislature", "date", (through - F.col("n")).alias("before"), through.alias("through"))


def divisions_eligible(windows: DataFrame, divisions: DataFrame) -> DataFrame:
    """``windows`` (legislature, member_key, start, end) with the number of divisions from start to end, both included."""
    ends = windows.select("legislature", F.explode(F.array("start", "end")).alias("date"))
    counts = running_divisions(divisions, ends)
    lo = counts.select("legislature", F.col("date").alias("start"), F.col("before"))
    hi = counts.select("legislature", F.col("date").alias("end"), F.col("through"))
    joined = windows.join(lo, ["legislature", "start"], "left").join(hi, ["legislature", "end"], "left")
    return joined.withColumn("eligible", F.greatest(F.coalesce(F.col("through") - F.col("before"), F.lit(0)), F.lit(0))).drop("before", "through")


def service_spells(vote_days: DataFrame, divisions: DataFrame, gap_days: int = GAP_DAYS, min_missed: int = MIN_MISSED, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """(legislature, member_key, spell, start, end) from each member's vote dates.

    A spell ends at a gap that is longer than ``gap_days`` and holds ``min_missed``
    divisions or more. ``keep`` may write the running counts, a row a date.
    """
    counts = running_divisions(divisions, vote_days).withColumn("day", date10(F.col("date"))).filter("day is not null")
    days = vote_days.select("legislature", "member_key", "date")  # a repeated day is no gap
    own = Window.partitionBy("member_key", "legislature").orderBy("date")  # sorted by what differs most
    counted = days.join(keep(counts, "counts"), ["legislature", "date"])
    gap = F.datediff(F.col("day"), F.lag("day").over(own))
    missed = F.col("before") - F.lag("through").over(own)
    broken = F.coalesce((gap > gap_days) & (missed >= min_missed), F.lit(False))
    numbered = counted.withColumn("broken", broken.cast("int")).withColumn("spell", F.sum("broken").over(own) + 1)
    before, after = F.lag("spell").over(own), F.lead("spell").over(own)
    ends = numbered.withColumn("edge", before.isNull() | (before != F.col("spell")) | after.isNull() | (after != F.col("spell"))).filter("edge")
    return ends.groupBy("legislature", "member_key", "spell").agg(F.min("date").alias("start"), F.max("date").alias("end"))


def current_spell(spells: DataFrame) -> DataFrame:
    """Each member's last spell, and how many there are."""
    last = F.max_by(F.struct("start", "end"), "spell").alias("s")
    return spells.groupBy("legislature", "member_key").agg(last, F.count("*").alias("spells")).select("legislature", "member_key", "s.start", "s.end", "spells")


def term_start(spells: DataFrame, members: DataFrame) -> DataFrame:
    """Per legislature: the earliest current-spell start in the month when most sitting members' spells start (ties: the earliest month)."""
    sitting = current_spell(spells).join(members.filter("status = 'current'").select("legislature", "member_key"), ["legislature", "member_key"], "left_semi")
    months = sitting.groupBy("legislature", F.substring("start", 1, 7).alias("month")).agg(F.count("*").alias("n"), F.min("start").alias("term_start"))
    first = Window.partitionBy("legislature").orderBy(F.desc("n"), "month")
    return months.withColumn("rank", F.row_number().over(first)).filter("rank = 1").select("legislature", "term_start")


def turnout(vote_days: DataFrame, divisions: DataFrame, members: DataFrame, gap_days: int = GAP_DAYS, min_missed: int = MIN_MISSED, grace_days: int = GRACE_DAYS, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """Per member: spells, start of the current window, votes and eligible divisions in it, turnout in percent.

    Sitting members are measured from the start of the term if they sat then or
    arrived within ``grace_days`` of it, and up to the last division; others up to
    their own last vote. A sitting member without votes gets none of the term's.
    ``keep`` may write what several branches read: spells are worked out once.
    """
    spells = keep(service_spells(vote_days, divisions, gap_days, min_missed, keep), "spells")
    terms = term_start(spells, members)
    last = divisions.filter("date <> ''").groupBy("legislature").agg(F.max("date").alias("last_division"))
    everyone = members.select("legislature", "member_key", "status").join(current_spell(spells), ["legislature", "member_key"], "left")
    placed = everyone.join(terms, "legislature", "left").join(last, "legislature", "left")
    sitting = (F.col("status") == "current") & F.col("term_start").isNotNull()
    early = (F.col("start") < F.col("term_start")) | within_days(F.col("start"), F.col("term_start"), grace_days)
    start = F.when(sitting & (F.col("start").isNull() | early), F.col("term_start")).otherwise(F.col("start"))
    end = F.when(F.col("status") == "current", F.col("last_division")).otherwise(F.col("end"))
    windows = placed.select("legislature", "member_key", F.coalesce("spells", F.lit(0)).alias("spells"), start.alias("start"), end.alias("end")).filter("start is not null")
    eligible = divisions_eligible(windows, divisions)
    mine = vote_days.groupBy("legislature", "member_key", "date").agg(F.sum("n").alias("n"))
    inside = mine.join(windows.select("legislature", "member_key", "start", "end"), ["legislature", "member_key"]).filter("date >= start and date <= end")
    cast = inside.groupBy("legislature", "member_key").agg(F.sum("n").alias("term_votes"))
    out = eligible.join(cast, ["legislature", "member_key"], "left").withColumn("term_votes", F.coalesce("term_votes", F.lit(0)))
    out = out.withColumn("eligible", F.greatest("eligible", "term_votes"))
    return out.select(
        "legislature", "member_key", "spells", F.col("start").alias("spell_start"), "term_votes", "eligible", pct(F.col("term_votes"), F.col("eligible")).alias("turnout_pct")
    )
