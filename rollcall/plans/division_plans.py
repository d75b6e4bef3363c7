"""Divisions, agreement, rebellion and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions import people
from rollcall.operators import scaling
from rollcall.operators import votes as v
from rollcall.plans.catalog import query
from rollcall.plans.views import members, votes
from rollcall.sources.scratch import Scratch

NON_PARTY_SQL = str(people.NON_PARTY)

LINES = f"""
party_tally AS (SELECT legislature, division, party, count_if(direction = 'aye') AS ayes, count_if(direction = 'no') AS noes FROM cast_ GROUP BY 1, 2, 3),
totals AS (SELECT legislature, division, count_if(direction = 'aye') AS ayes, count_if(direction = 'no') AS noes FROM cast_ GROUP BY 1, 2),
party_lines AS (SELECT legislature, division, party, CASE WHEN ayes > noes THEN 'aye' ELSE 'no' END AS line FROM party_tally
  WHERE ayes + noes >= 3 AND ayes <> noes AND lower(trim(party)) NOT IN {NON_PARTY_SQL} AND NOT starts_with(lower(trim(party)), 'independent')),
chamber_lines AS (SELECT legislature, division, CASE WHEN ayes > noes THEN 'aye' ELSE 'no' END AS line FROM totals WHERE ayes <> noes),
lined AS (SELECT c.*, p.line AS party_line, h.line AS chamber_line FROM cast_ c LEFT JOIN party_lines p USING (legislature, division, party)
  LEFT JOIN chamber_lines h USING (legislature, division)),
rebellions AS (SELECT legislature, member_key, party, date, division, title, direction AS their_vote, party_line AS party_voted, seq FROM lined
  WHERE direction <> party_line),
division_meta AS (SELECT legislature, division, arg_min(date, seq) AS date, arg_min(title, seq) AS title FROM votes GROUP BY 1, 2),
counted AS (SELECT legislature, member_key, count(*) AS votes_cast, count(party_line) AS party_line_divisions, count_if(direction = party_line) AS with_party,
  count_if(direction <> party_line) AS rebellions, count(chamber_line) AS chamber_decided_divisions, count_if(direction = chamber_line) AS with_chamber,
  min(date) AS first_vote, max(date) AS last_vote FROM lined GROUP BY 1, 2),
absent AS (SELECT legislature, member_key, count(*) AS no_vote_recorded FROM votes WHERE direction IN ('no_vote', 'novoterecorded', 'not_recorded') GROUP BY 1, 2),
member_votes AS (SELECT coalesce(c.legislature, a.legislature) AS legislature, coalesce(c.member_key, a.member_key) AS member_key,
  coalesce(votes_cast, 0) AS votes_cast, coalesce(party_line_divisions, 0) AS party_line_divisions, coalesce(with_party, 0) AS with_party,
  coalesce(rebellions, 0) AS rebellions, coalesce(chamber_decided_divisions, 0) AS chamber_decided_divisions, coalesce(with_chamber, 0) AS with_chamber,
  first_vote, last_vote, coalesce(no_vote_recorded, 0) AS no_vote_recorded
  FROM counted c FULL JOIN absent a ON c.legislature = a.legislature AND c.member_key = a.member_key)"""

MATRIX = """
matrix AS (SELECT legislature, member_key, division, arg_max(CASE WHEN direction = 'aye' THEN 1 ELSE -1 END, seq) AS v FROM cast_ GROUP BY 1, 2, 3),
keep_d AS (SELECT legislature, division FROM matrix GROUP BY 1, 2 HAVING count(*) >= 20 AND least(count_if(v > 0), count_if(v < 0)) >= 3),
keep_m AS (SELECT legislature, member_key FROM matrix GROUP BY 1, 2 HAVING count(*) >= 25),
cells AS (SELECT * FROM matrix SEMI JOIN keep_d USING (legislature, division) SEMI JOIN keep_m USING (legislature, member_key)),
centred AS (SELECT legislature, member_key, division, v - avg(v) OVER (PARTITION BY legislature, division) AS v FROM cells)"""


@query("SELECT * FROM party_tally", ctes=LINES)
def division_party_tally(spark, d):
    return v.party_tally(votes(spark, d))


@query("SELECT * FROM totals", ctes=LINES)
def division_totals(spark, d):
    return v.totals(votes(spark, d))


@query("SELECT * FROM party_lines", ctes=LINES)
def party_line(spark, d):
    return v.party_line(votes(spark, d))


@query("SELECT * FROM chamber_lines", ctes=LINES)
def chamber_line(spark, d):
    return v.chamber_line(votes(spark, d))


@query("SELECT * FROM division_meta", ctes=LINES)
def division_meta(spark, d):
    return v.division_meta(votes(spark, d))


@query("SELECT * FROM rebellions", ctes=LINES)
def rebellions(spark, d):
    return v.rebellions(votes(spark, d))


@query("""SELECT legislature, member_key, count(*) AS decided, count_if(direction = chamber_line) AS with_chamber,
  round(100.0::DOUBLE * count_if(direction = chamber_line) / count(*), 1) AS agreement_pct FROM lined WHERE chamber_line IS NOT NULL GROUP BY 1, 2""", ctes=LINES)
def chamber_agreement(spark, d):
    return v.chamber_agreement(votes(spark, d))


@query("SELECT * FROM member_votes", ctes=LINES)
def member_votes(spark, d):
    return v.member_votes(votes(spark, d))


@query("SELECT legislature, member_key, date, count(*) AS n FROM cast_ GROUP BY 1, 2, 3")
def votes_per_day(spark, d):
    return v.votes_per_day(votes(spark, d))


@query("SELECT legislature, member_key, division, v::INT AS v FROM matrix", ctes=MATRIX)
def vote_matrix(spark, d):
    return scaling.vote_matrix(votes(spark, d), "legislature")


def _cells(spark, d):
    return scaling.scaling_filter(scaling.vote_matrix(votes(spark, d), "legislature"), "legislature")


@query("SELECT legislature, member_key, division, v::INT AS v FROM cells", ctes=MATRIX)
def scaling_filter(spark, d):
    return _cells(spark, d)


@query("SELECT legislature, member_key, division, round(v, 6) AS v FROM centred", ctes=MATRIX)
def centred_votes(spark, d):
    return scaling.centred_votes(_cells(spark, d), "legislature").withColumn("v", F.round("v", 6))


@query("""SELECT x.legislature, x.member_key AS a, y.member_key AS b, round(sum(x.v * y.v), 4) + 0.0 AS dot FROM centred x JOIN centred y USING (legislature, division)
  WHERE x.member_key <= y.member_key GROUP BY 1, 2, 3""", ctes=MATRIX)
def agreement_kernel(spark, d):
    """The Gram matrix of members, all pairs: the check of ideal points on a legislature's few thousand seats."""
    with Scratch(spark) as scratch:
        matrix = scratch.cut(scaling.vote_matrix(votes(spark, d), "legislature"), "matrix")
        cells = scratch.keep(scaling.centred_votes(scaling.scaling_filter(matrix, "legislature"), "legislature"), "cells")
    kernel = scaling.agreement_kernel(cells, "legislature")
    # half up as DuckDB does it; F.round makes a decimal of each number, which takes longer than its product
    return kernel.withColumn("dot", F.signum("dot") * F.floor(F.abs("dot") * 10000 + 0.5) / 10000 + 0.0)


def _power(gram: str, name: str, steps: int = 34) -> str:
    """The leading eigenvector of each legislature's matrix ``gram`` (a, b, x): squared until one direction is left."""
    out = [f"{name}_0 AS MATERIALIZED (SELECT legislature, a, b, x / sum(x) FILTER (a = b) OVER (PARTITION BY legislature) AS x FROM {gram})"]
    for k in range(steps):
        out.append(
            f"{name}_{k}_ AS MATERIALIZED (SELECT p.legislature, p.a, q.b, sum(p.x * q.x) AS x FROM {name}_{k} p JOIN {name}_{k} q ON p.legislature = q.legislature AND p.b = q.a GROUP BY 1, 2, 3),\n"
            f"{name}_{k + 1} AS MATERIALIZED (SELECT legislature, a, b, x / sum(x) FILTER (a = b) OVER (PARTITION BY legislature) AS x FROM {name}_{k}_)"
        )
    last = f"{name}_{steps}"
    out.append(
        f"{name}_at AS (SELECT legislature, arg_max(a, x) AS b, max(x) AS x FROM {last} WHERE a = b GROUP BY 1),\n"
        f"{name} AS MATERIALIZED (SELECT p.legislature, p.a, p.x / sqrt(t.x) AS v FROM {last} p JOIN {name}_at t USING (legislature, b)),\n"
        f"{name}_square AS MATERIALIZED (SELECT g.legislature, sum(p.v * g.x * q.v) AS s FROM {gram} g JOIN {name} p ON p.legislature = g.legislature AND p.a = g.a "
        f"JOIN {name} q ON q.legislature = g.legislature AND q.a = g.b GROUP BY 1)"
    )
    return ",\n".join(out)


#: Ideal points of current members by dense matrices: their Gram matrix, its leading eigenvector, and that of what the first leaves.
POINTS = f"""
own AS (SELECT c.* FROM cast_ c SEMI JOIN (SELECT * FROM members WHERE status = 'current') m ON m.legislature = c.legislature AND m.member_key = c.member_key),
{MATRIX.replace("FROM cast_ GROUP", "FROM own GROUP").strip()},
gram AS MATERIALIZED (SELECT x.legislature, x.member_key AS a, y.member_key AS b, sum(x.v * y.v) AS x FROM centred x JOIN centred y USING (legislature, division) GROUP BY 1, 2, 3),
{_power("gram", "one")},
rest AS MATERIALIZED (SELECT g.legislature, g.a, g.b, g.x - s.s * p.v * q.v AS x FROM gram g JOIN one_square s USING (legislature)
  JOIN one p ON p.legislature = g.legislature AND p.a = g.a JOIN one q ON q.legislature = g.legislature AND q.a = g.b),
{_power("rest", "two")},
pair AS (SELECT o.legislature, o.a AS member_key, o.v AS x, t.v AS y FROM one o JOIN two t USING (legislature, a)),
scaled AS (SELECT legislature, member_key, x / first_value(x) OVER (PARTITION BY legislature ORDER BY abs(x) DESC, member_key) AS x,
  y / first_value(y) OVER (PARTITION BY legislature ORDER BY abs(y) DESC, member_key) AS y FROM pair),
party_sums AS (SELECT legislature, party, count(*) AS n, sum(x) AS total FROM scaled JOIN members USING (legislature, member_key) WHERE party <> '' GROUP BY 1, 2),
facing AS (SELECT legislature, CASE WHEN total < 0 THEN -1.0 ELSE 1.0 END AS sign FROM party_sums QUALIFY row_number() OVER (PARTITION BY legislature ORDER BY n DESC, party) = 1),
points AS (SELECT legislature, member_key, x * coalesce(sign, 1.0) AS dim1, y * coalesce(sign, 1.0) AS dim2 FROM scaled LEFT JOIN facing USING (legislature)),
shares AS (SELECT legislature, one_square.s / total AS dim1_share, two_square.s / total AS dim2_share
  FROM (SELECT legislature, sum(x) FILTER (a = b) AS total FROM gram GROUP BY 1) JOIN one_square USING (legislature) JOIN two_square USING (legislature))"""


def points_of(spark, d, cast=None):
    """(points, report) of every legislature, over its current members alone."""
    cast = votes(spark, d) if cast is None else cast
    return scaling.ideal_points(cast, members(spark, d).filter("status = 'current'"))


@query("SELECT legislature, member_key, round(dim1, 3) + 0.0 AS ideal_dim1, round(dim2, 3) + 0.0 AS ideal_dim2 FROM points", ctes=POINTS)
def ideal_points(spark, d):
    points, _ = points_of(spark, d)
    return points.select("legislature", "member_key", *[(F.round(f"dim{k}", 3) + 0.0).alias(f"ideal_dim{k}") for k in (1, 2)])


@query("""SELECT legislature, count(p.member_key) AS members_placed, round(any_value(dim1_share), 6) AS dim1_share, round(any_value(dim2_share), 6) AS dim2_share
  FROM (SELECT DISTINCT legislature FROM own) LEFT JOIN points p USING (legislature) LEFT JOIN shares USING (legislature) GROUP BY 1""", ctes=POINTS)
def scaling_report(spark, d):
    _, report = points_of(spark, d)
    return report.select("legislature", "members_placed", F.round("dim1_share", 6).alias("dim1_share"), F.round("dim2_share", 6).alias("dim2_share"))
