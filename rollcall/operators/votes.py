"""Divisions: tallies, party and chamber lines, agreement and rebellion.

Input votes: legislature, member_key, division, party (at the vote), date, title,
direction, seq. Tallies combine on the map side; the lines they give hold one row per
division and party and join back on those keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.people import whipped_group
from rollcall.functions.votes import NOT_RECORDED, pct

MIN_PARTY_VOTERS = 3
Keep = Callable[[DataFrame, str], DataFrame]


def _as_is(df: DataFrame, _: str) -> DataFrame:
    return df


def cast_votes(votes: DataFrame) -> DataFrame:
    return votes.filter(F.col("direction").isin("aye", "no"))


def party_tally(votes: DataFrame) -> DataFrame:
    return cast_votes(votes).groupBy("legislature", "division", "party").agg(
        F.count_if(F.col("direction") == "aye").alias("ayes"), F.count_if(F.col("direction") == "no").alias("noes")
    )


def totals(votes: DataFrame) -> DataFrame:
    return cast_votes(votes).groupBy("legislature", "division").agg(
        F.count_if(F.col("direction") == "aye").alias("ayes"), F.count_if(F.col("direction") == "no").alias("noes")
    )


def _line():
    return F.when(F.col("ayes") > F.col("noes"), "aye").when(F.col("ayes") < F.col("noes"), "no")


def party_line(votes: DataFrame, least: int = MIN_PARTY_VOTERS) -> DataFrame:
    """The majority side of each whipped party with ``least`` voters or more; none on a tie."""
    return _party_line(party_tally(votes), least)


def _party_line(tally: DataFrame, least: int) -> DataFrame:
    enough = tally.filter(whipped_group(F.col("party")) & (F.col("ayes") + F.col("noes") >= least))
    return enough.select("legislature", "division", "party", _line().alias("line")).filter("line is not null")


def chamber_line(votes: DataFrame) -> DataFrame:
    return totals(votes).select("legislature", "division", _line().alias("line")).filter("line is not null")


def lines(votes: DataFrame, least: int = MIN_PARTY_VOTERS, keep: Keep = _as_is) -> tuple[DataFrame, DataFrame]:
    """(party lines, chamber lines), both from one tally.

    Where ``keep`` writes the tally, Spark knows its size, and votes need no shuffle to meet lines that are few.
    """
    tally = keep(party_tally(votes), "tally")
    both = tally.groupBy("legislature", "division").agg(F.sum("ayes").alias("ayes"), F.sum("noes").alias("noes"))
    return _party_line(tally, least), both.select("legislature", "division", _line().alias("line")).filter("line is not null")


def division_meta(votes: DataFrame, rank: str | None = None, keep: Keep = _as_is) -> DataFrame:
    """Date and title of each division's first row; the date alone of votes without titles.

    ``rank`` may name a number, never null, that does not fall where seq grows: then only the rows of a division's
    least rank, which ``keep`` may write, are held against one another by seq, and the others are not sorted.
    """
    if rank:
        low = keep(votes.groupBy("legislature", "division").agg(F.min(rank).alias(rank)), "ranks")
        votes = votes.join(low, ["legislature", "division", rank], "left_semi")
    shown = [c for c in ("date", "title") if c in votes.columns]
    first = votes.groupBy("legislature", "division").agg(F.min_by(F.struct(*shown), "seq").alias("m"))
    return first.select("legislature", "division", *[f"m.{c}" for c in shown])


def against_lines(votes: DataFrame, least: int = MIN_PARTY_VOTERS, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Cast votes with ``party_line`` and ``chamber_line``, null where there is none; ``known``: the ``lines``."""
    party, chamber = known or lines(votes, least)
    ours = party.withColumnRenamed("line", "party_line")
    all_ = chamber.withColumnRenamed("line", "chamber_line")
    return cast_votes(votes).join(ours, ["legislature", "division", "party"], "left").join(all_, ["legislature", "division"], "left")


def rebellions(votes: DataFrame, least: int = MIN_PARTY_VOTERS, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """A row for each vote against the member's own party line; ``known``: the ``lines``."""
    lined = cast_votes(votes).join(known[0] if known else party_line(votes, least), ["legislature", "division", "party"])
    return lined.filter(F.col("direction") != F.col("line")).select(
        "legislature", "member_key", "party", "date", "division", "title", F.col("direction").alias("their_vote"), F.col("line").alias("party_voted"), "seq"
    )


def chamber_agreement(votes: DataFrame) -> DataFrame:
    """Per member: votes on decided divisions, and those with the chamber's side."""
    lined = cast_votes(votes).join(chamber_line(votes), ["legislature", "division"])
    counted = lined.groupBy("legislature", "member_key").agg(F.count("*").alias("decided"), F.count_if(F.col("direction") == F.col("line")).alias("with_chamber"))
    return counted.withColumn("agreement_pct", pct(F.col("with_chamber"), F.col("decided")))


def member_votes(votes: DataFrame, least: int = MIN_PARTY_VOTERS, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Per member, in one grouping: votes cast, party and chamber agreement, rebellions, first and last vote, votes not recorded."""
    lined = against_lines(votes, least, known).groupBy("legislature", "member_key").agg(
        F.count("*").alias("votes_cast"),
        F.count("party_line").alias("party_line_divisions"),
        F.count_if(F.col("direction") == F.col("party_line")).alias("with_party"),
        F.count_if(F.col("direction") != F.col("party_line")).alias("rebellions"),
        F.count("chamber_line").alias("chamber_decided_divisions"),
        F.count_if(F.col("direction") == F.col("chamber_line")).alias("with_chamber"),
        F.min("date").alias("first_vote"),
        F.max("date").alias("last_vote"),
    )
    absent = votes.filter(F.col("direction").isin(*NOT_RECORDED)).groupBy("legislature", "member_key").agg(F.count("*").alias("no_vote_recorded"))
    joined = lined.join(absent, ["legislature", "member_key"], "full_outer")
    counts = [c for c in joined.columns if c not in ("legislature", "member_key", "first_vote", "last_vote")]
    return joined.fillna(0, counts)


def votes_per_day(votes: DataFrame) -> DataFrame:
    return cast_votes(votes).filter("date <> ''").groupBy("legislature", "member_key", "date").agg(F.count("*").alias("n"))
