"""Vote directions, division keys and results, stances and shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions.text import blank, strip

#: The sources' words for each direction.
DIRECTIONS = {
    "aye": "aye", "yes": "aye", "for": "aye", "1": "aye", "true": "aye",
    "no": "no", "noe": "no", "noes": "no", "against": "no", "2": "no", "false": "no",
    "abstain": "abstain", "abstained": "abstain",
    "did not vote": "no_vote", "didnotvote": "no_vote", "novoterecorded": "no_vote", "not_recorded": "no_vote", "no_vote": "no_vote",
}
NOT_RECORDED = ("no_vote", "novoterecorded", "not_recorded")
STANCE_SHRINK, VOTE_WEIGHT, SPEECH_WEIGHT = 4, 2.0, 1.0


def direction(raw: Column) -> Column:
    """Known words mapped, anything else lower-cased, blank to ``unknown``."""
    key = F.lower(strip(raw))
    known = F.create_map(*[F.lit(x) for pair in DIRECTIONS.items() for x in pair])
    return F.when(key == "", F.lit("unknown")).otherwise(F.coalesce(F.try_element_at(known, key), key))


def division_key(division_id: Column, date: Column, title: Column) -> Column:
    """The source's id, else date and title."""
    made = F.concat(F.substring(F.coalesce(date, F.lit("")), 1, 10), F.lit("|"), F.substring(F.coalesce(title, F.lit("")), 1, 120))
    return F.when(~blank(division_id), strip(division_id)).otherwise(strip(made))


def division_result(ayes: Column, noes: Column) -> Column:
    return F.when(ayes > noes, F.lit("passed")).otherwise(F.lit("not passed"))


def pct(n: Column, d: Column) -> Column:
    """Share in percent to one place; null without a base."""
    return F.when(d != 0, F.round(F.lit(100.0) * n / d, 1))


def stance(pro: Column, con: Column) -> Column:
    """(pro - con) / (pro + con + 4) to three places: thin evidence stays near 0."""
    total = pro + con
    return F.when(total != 0, F.round((pro - con).cast("double") / (total + STANCE_SHRINK), 3)).otherwise(F.lit(0.0))


def combined_stance(spoken: Column, spoken_n: Column, voted: Column, voted_n: Column) -> Column:
    """Average of the signals that are present, votes counting twice; on the rounded stances."""
    num = F.when(spoken_n != 0, SPEECH_WEIGHT * spoken).otherwise(0.0) + F.when(voted_n != 0, VOTE_WEIGHT * voted).otherwise(0.0)
    den = F.when(spoken_n != 0, F.lit(SPEECH_WEIGHT)).otherwise(0.0) + F.when(voted_n != 0, F.lit(VOTE_WEIGHT)).otherwise(0.0)
    return F.when(den != 0, F.round(num / den, 3)).otherwise(F.lit(0.0))
