"""The user-facing reports: member record, benchmarks, payload, area search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions.votes import pct
from rollcall.operators import service
from rollcall.operators import votes as v

MAX_TOPICS, MAX_RECEIPTS, DIVISION_CHARS = 8, 40, 180


def activity(statements: DataFrame, cast: DataFrame) -> DataFrame:
    """Per member: questions, speeches, cast votes with a motion, and all of them."""
    spoken = statements.groupBy("member").agg(F.count_if(F.col("dtype") == "question").alias("n_questions"), F.count_if(F.col("dtype") == "speech").alias("n_speeches"))
    voted = cast.filter(F.col("direction").isin("aye", "no") & (F.col("motion") != "")).groupBy("member").agg(F.count("*").alias("n_votes"))
    both = spoken.join(voted, "member", "full_outer").fillna(0)
    return both.withColumn("activity_total", F.col("n_questions") + F.col("n_speeches") + F.col("n_votes"))


def top_topics(salience: DataFrame, n: int = 3) -> DataFrame:
    """Per member the ``n`` most frequent topics as columns (ties: topic order), and the first one's share."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("statements")).alias("k"), F.col("topic"), F.col("share_pct"))))
    ranked = salience.groupBy("member").agg(order.alias("t"))
    named = [F.coalesce(F.try_element_at("t", F.lit(i + 1))["topic"], F.lit("")).alias(f"top_topic_{i + 1}") for i in range(n)]
    return ranked.select("member", *named, F.try_element_at("t", F.lit(1))["share_pct"].alias("top_topic_1_share_pct"))


def member_record(members: DataFrame, cast: DataFrame, spoken: DataFrame, salience: DataFrame, points: DataFrame | None = None, gap_days: int = 365, min_missed: int = 40, grace_days: int = 60, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df, lines: tuple[DataFrame, DataFrame] | None = None, rank: str | None = None) -> DataFrame:
    """One row per member, seeded from the roster so that those who never act appear too.

    ``members``: legislature, member_key, name, party, constituency, status.
    ``spoken``: member_key, n_questions, n_speeches. ``salience``: member, topic, ... ``points``: legislature,
    member_key, dim1, dim2, shown to three places.
    ``keep`` may write what several branches read, so that votes are read for the lines, the days and
    the divisions alone. ``lines``: those of the votes, where they are known; ``rank``: as in ``division_meta``.
    """
    counters = v.member_votes(cast, known=lines or v.lines(cast, keep=keep))
    divisions = keep(v.division_meta(cast, rank, keep).select("legislature", "date"), "divisions")
    turn = service.turnout(keep(v.votes_per_day(cast), "days"), divisions, members, gap_days, min_missed, grace_days, keep)
    joined = members.join(counters, ["legislature", "member_key"], "left").join(turn, ["legislature", "member_key"], "left").join(spoken, "member_key", "left")
    joined = joined.join(top_topics(salience).withColumnRenamed("member", "member_key"), "member_key", "left")
    if points is not None:
        joined = joined.join(points.select("legislature", "member_key", (F.round("dim1", 3) + 0.0).alias("ideal_dim1"), (F.round("dim2", 3) + 0.0).alias("ideal_dim2")), ["legislature", "member_key"], "left")
    else:
        joined = joined.withColumns({"ideal_dim1": F.lit(None).cast("double"), "ideal_dim2": F.lit(None).cast("double")})
    numbers = ["votes_cast", "party_line_divisions", "with_party", "rebellions", "chamber_decided_divisions", "with_chamber", "no_vote_recorded", "spells", "term_votes", "eligible", "n_questions", "n_speeches"]
    filled = joined.fillna(0, numbers).fillna("", ["spell_start", "top_topic_1", "top_topic_2", "top_topic_3"])
    return filled.select(
        "legislature", "member_key", F.col("name").alias("member"), "party", "constituency", "status", "votes_cast",
        F.col("spells").alias("spells_served"), F.col("spell_start").alias("current_spell_from"), "term_votes", F.col("eligible").alias("divisions_eligible"), "turnout_pct", "no_vote_recorded",
        pct(F.col("with_party"), F.col("party_line_divisions")).alias("party_agreement_pct"), "party_line_divisions",
        pct(F.col("with_chamber"), F.col("chamber_decided_divisions")).alias("chamber_agreement_pct"), "chamber_decided_divisions",
        "rebellions", pct(F.col("rebellions"), F.col("party_line_divisions")).alias("rebellion_rate_pct"), "ideal_dim1", "ideal_dim2",
        "n_questions", "n_speeches", "top_topic_1", "top_topic_2", "top_topic_3", "top_topic_1_share_pct",
    )


def benchmarks(record: DataFrame) -> DataFrame:
    """Per chamber: exact medians over members with a value, and how many ever rebelled."""

    def mid(c: str):
        return F.round(F.median(c), 1).alias(f"median_{c}")

    return record.groupBy("legislature").agg(
        F.count("*").alias("members"), mid("turnout_pct"), mid("party_agreement_pct"), mid("chamber_agreement_pct"), mid("rebellion_rate_pct"), mid("rebellions"),
        F.count_if(F.col("rebellions") > 0).alias("ever_rebelled"),
    )


def receipts(rebellions: DataFrame, cap: int = MAX_RECEIPTS, keep: str = "oldest") -> DataFrame:
    """Up to ``cap`` rebellions a member as receipts, newest first in ``shown`` order, with the first three marked and the overflow counted."""
    order = ["date", "seq"] if keep == "oldest" else [F.desc("date"), F.desc("seq")]
    own = Window.partitionBy("legislature", "member_key")
    sizes = rebellions.groupBy("legislature", "member_key").agg(F.count("*").alias("all"))  # apart, so that the limit on places stays pushed down
    first = rebellions.withColumn("place", F.row_number().over(own.orderBy(*order))).filter(F.col("place") <= cap)
    ranked = first.join(sizes, ["legislature", "member_key"])
    shown = F.row_number().over(own.orderBy(F.desc("date"), F.desc("seq")))
    out = ranked.withColumn("shown", shown)
    return out.select(
        "legislature", "member_key", "shown", "date", F.substring("title", 1, DIVISION_CHARS).alias("division"), "their_vote", "party_voted",
        (F.col("shown") <= 3).alias("preview"), F.greatest(F.col("all") - 3, F.lit(0)).alias("more"),
    )


def app_payload(record: DataFrame, salience: DataFrame, rebellions: DataFrame, current_only: bool = True) -> DataFrame:
    """A nested row per placed member: figures, up to 8 topics, up to 40 receipts."""
    placed = record.filter("constituency <> ''")
    placed = placed.filter("status = 'current'") if current_only else placed
    listed = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("statements")).alias("k"), F.col("topic"), F.col("share_pct")))), 1, MAX_TOPICS), lambda t: F.struct(t["topic"].alias("topic"), (-t["k"]).alias("n"), F.coalesce(t["share_pct"], F.lit(0.0)).alias("share")))
    tops = salience.groupBy(F.col("member").alias("member_key")).agg(listed.alias("topics"))
    slips = receipts(rebellions).groupBy("legislature", "member_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("shown", "date", "division", "their_vote", "party_voted"))), lambda r: F.struct(r["date"].alias("date"), r["division"].alias("division"), r["their_vote"].alias("their_vote"), r["party_voted"].alias("party_voted"))).alias("receipts")
    )
    return placed.join(tops, "member_key", "left").join(slips, ["legislature", "member_key"], "left")


def payload_lines(payload: DataFrame, bench: DataFrame) -> DataFrame:
    """The export, a JSON document a legislature, as its lines: (legislature, area, member, member_key, json).

    The first line, of a blank area, holds topics and benchmarks; then each member has one, by area and name.
    ``document`` puts lines together. A legislature is never gathered in one row, however many sit in it.
    """
    member = F.struct(
        F.col("member").alias("name"), "party", F.col("constituency").alias("area"), F.col("legislature").alias("parliament"), F.col("votes_cast").alias("votesCast"), F.col("term_votes").alias("termVotes"),
        F.col("divisions_eligible").alias("eligible"), F.col("turnout_pct").alias("turnout"), F.col("spells_served").alias("spells"), F.col("current_spell_from").alias("spellFrom"), F.col("party_agreement_pct").alias("partyAgreement"),
        F.col("party_line_divisions").alias("partyLineDivisions"), F.col("chamber_agreement_pct").alias("chamberAgreement"), "rebellions", F.col("rebellion_rate_pct").alias("rebellionRate"), F.col("ideal_dim1").alias("dim1"),
        F.col("ideal_dim2").alias("dim2"), F.col("n_questions").alias("questions"), F.col("n_speeches").alias("speeches"), F.coalesce("topics", F.array()).alias("topics"), F.coalesce("receipts", F.array()).alias("receipts"),
    )
    whole = {"ignoreNullFields": "false"}
    lines = payload.select("legislature", F.col("constituency").alias("area"), "member", "member_key", F.to_json(member, whole).alias("json"))
    named = payload_topics(payload).groupBy("legislature").agg(F.sort_array(F.collect_list("topic")).alias("topics"))  # as many as the lexicon has
    figures = F.struct(
        "members", F.col("median_turnout_pct").alias("turnout"), F.col("median_party_agreement_pct").alias("partyAgreement"), F.col("median_chamber_agreement_pct").alias("chamberAgreement"),
        F.col("median_rebellion_rate_pct").alias("rebellionRate"), F.col("median_rebellions").alias("rebellions"), F.col("ever_rebelled").alias("everRebelled"),
    )
    head = F.struct(F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), figures.alias("benchmarks"))
    blank = F.lit("")
    heads = bench.join(named, "legislature", "left").select("legislature", blank.alias("area"), blank.alias("member"), blank.alias("member_key"), F.to_json(head, whole).alias("json"))
    return heads.unionByName(lines)


def document(lines: list[str]) -> str:
    """The JSON text of a legislature's ``lines``, the first one the head."""
    return lines[0][:-1] + ',"members":[' + ",".join(lines[1:]) + "]}"


def payload_topics(payload: DataFrame) -> DataFrame:
    return payload.select("legislature", F.explode("topics.topic").alias("topic")).distinct()


def area_search(record: DataFrame, query: str, cap: int = 40, first: int = 14) -> DataFrame:
    """Areas for a search text: those whose name holds it, then those of members whose name does; the first ``first`` without a text."""
    areas = record.filter("constituency <> ''").select("legislature", F.col("constituency").alias("area"), "member")
    if not query.strip():
        return areas.select("legislature", "area").distinct().orderBy("area", "legislature").limit(first).withColumn("priority", F.lit(0))
    q = query.strip().lower()
    by_area = F.contains(F.lower("area"), F.lit(q))
    by_name = F.contains(F.lower("member"), F.lit(q))
    priority = F.when(by_area, 0).when(by_name, 1)
    hits = areas.withColumn("priority", priority).filter("priority is not null").groupBy("legislature", "area").agg(F.min("priority").alias("priority"))
    return hits.orderBy("priority", "area", "legislature").limit(cap)


def area_members(record: DataFrame, bench: DataFrame) -> DataFrame:
    """Members of each area by votes cast, their turnout beside the chamber's median, both held to 0-100."""
    place = F.row_number().over(Window.partitionBy("legislature", "constituency").orderBy(F.desc("votes_cast"), "member", "member_key"))
    joined = record.filter("constituency <> ''").join(bench.select("legislature", F.col("median_turnout_pct").alias("median")), "legislature")

    def held(c: str):
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(c)))

    return joined.select("legislature", F.col("constituency").alias("area"), place.alias("place"), "member", "votes_cast", held("turnout_pct").alias("turnout_pct"), held("median").alias("median_pct"))


def topic_bars(salience: DataFrame, n: int = 5) -> DataFrame:
    """Each member's first ``n`` topics as widths against the first one, 2 at least."""
    order = Window.partitionBy("member").orderBy(F.desc("statements"), "topic")
    ranked = salience.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    peak = F.max("statements").over(Window.partitionBy("member"))
    return ranked.select("member", "topic", "place", F.greatest(F.lit(2.0), F.round(100.0 * F.col("statements") / peak, 1)).alias("width"))


def current_members(rows: DataFrame, blank_passes: bool = False) -> DataFrame:
    """Members in office; ``blank_passes`` keeps those without a status as well."""
    blank = F.coalesce(F.col("status"), F.lit("")) == ""
    return rows.filter((F.col("status") == "current") | blank) if blank_passes else rows.filter("status = 'current'")


def payload_areas(payload: DataFrame) -> DataFrame:
    """Distinct areas of the placed members."""
    return payload.filter("constituency <> ''").select("legislature", F.col("constituency").alias("area")).distinct()


def report_order(name: str) -> list:
    """The order in which a report is written."""
    return {
        "record": lambda: ["legislature", "member", "member_key"],
        "rebellions": lambda: ["legislature", "member_key", "date", "seq"],
        "salience": lambda: ["member", F.desc("statements"), "topic"],
        "payload": lambda: ["legislature", "area", "member", "member_key"],
    }[name]()
