"""Rosters, resolution of records, memberships and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions import people
from rollcall.operators import identity
from rollcall.plans.catalog import query
from rollcall.plans.views import roster, statements, table


def norm_sql(c: str) -> str:
    n = f"lower(trim({c}))"
    swapped = f"CASE WHEN contains({n}, ',') THEN trim(substr({n}, instr({n}, ',') + 1)) || ' ' || trim(substr({n}, 1, instr({n}, ',') - 1)) ELSE {n} END"
    return f"trim(regexp_replace(regexp_replace({swapped}, '\\b(mr|mrs|ms|miss|dr|sir|dame|rt|hon|the)\\b', ' ', 'g'), '[^a-z ]+', ' ', 'g'))"


def gradeable_sql(c: str) -> str:
    n = f"lower(trim({c}))"
    chair = " OR ".join(f"contains({n}, '{m}')" for m in people.CHAIR_MARKERS)
    return f"({n} <> '' AND NOT regexp_matches({n}, '[0-9]') AND NOT ({chair}) AND length(regexp_replace({n}, '[^a-z]', '', 'g')) >= 2)"


RESOLVED = f"""
by_id AS (SELECT legislature, id, arg_max({{'key': id, 'name': name, 'party': party, 'constituency': constituency, 'status': status}}, seq) AS info FROM roster GROUP BY 1, 2),
by_name AS (SELECT legislature, {norm_sql('name')} AS rname, arg_max({{'key': id, 'name': name, 'party': party, 'constituency': constituency, 'status': status}}, seq) AS info FROM roster GROUP BY 1, 2),
looked AS (SELECT s.*, {norm_sql('member_name')} AS rname, coalesce(i.info, n.info) AS info FROM statements s
  LEFT JOIN by_id i ON i.legislature = s.legislature AND i.id = s.member_id
  LEFT JOIN by_name n ON n.legislature = s.legislature AND n.rname = {norm_sql('s.member_name')}),
resolved AS (SELECT *, legislature || ':' || CASE WHEN info IS NOT NULL THEN info.key ELSE 'name:' || rname END AS member_key FROM looked
  WHERE info IS NOT NULL OR ({gradeable_sql('member_name')} AND rname <> ''))"""


@query(f"""SELECT legislature, 'id' AS kind, id AS key, arg_max(name, seq) AS name, arg_max(party, seq) AS party FROM roster GROUP BY legislature, id
  UNION ALL SELECT legislature, 'name', {norm_sql('name')} AS k, arg_max(name, seq), arg_max(party, seq) FROM roster GROUP BY legislature, k""")
def roster_lookup(spark, d):
    by_id, by_name = identity.lookups(roster(spark, d))
    one = by_id.select("legislature", F.lit("id").alias("kind"), F.col("id").alias("key"), "info.name", "info.party")
    two = by_name.select("legislature", F.lit("name").alias("kind"), F.col("norm_name").alias("key"), "info.name", "info.party")
    return one.unionByName(two)


def _resolved(spark, d):
    return identity.resolve(statements(spark, d), roster(spark, d))


@query("SELECT statement_id, member_key, coalesce(info.name, '') AS roster_name FROM resolved", ctes=RESOLVED)
def resolve_member(spark, d):
    return _resolved(spark, d).select("statement_id", "member_key", F.coalesce("info.name", F.lit("")).alias("roster_name"))


@query("""SELECT legislature, member_key, arg_min(coalesce(info.name, member_name), kind_order || seq) AS name,
  arg_min(coalesce(info.party, member_party), kind_order || seq) AS party, arg_min(coalesce(info.constituency, member_constituency), kind_order || seq) AS constituency,
  arg_min(coalesce(info.status, ''), kind_order || seq) AS status FROM resolved GROUP BY 1, 2""", ctes=RESOLVED)
def first_attributes(spark, d):
    return identity.first_attributes(_resolved(spark, d))


@query("""SELECT s.statement_id, s.legislature, s.member_name, coalesce(nullif(s.member_party, ''), r.party, '') AS member_party, s.member_constituency
  FROM statements s LEFT JOIN roster r ON r.legislature = s.legislature AND r.id = s.member_id""")
def enrich_member(spark, d):
    return identity.enrich(statements(spark, d), roster(spark, d)).select("statement_id", "legislature", "member_name", "member_party", "member_constituency")


@query("""SELECT legislature, id, CASE WHEN status = 'current' THEN name ELSE 'Lord ' || name END AS name FROM roster""")
def union_unseen(spark, d):
    """Members in office, and from a second list of everybody those that the first lacks."""
    r = roster(spark, d)
    lords = r.withColumn("name", F.concat(F.lit("Lord "), "name"))
    return identity.union_unseen(r.filter("status = 'current'"), lords).select("legislature", "id", "name")


MEMBERSHIPS = """memberships AS (SELECT o_custkey AS person_id, o_orderpriority AS party, strftime(o_orderdate, '%Y-%m-%d') AS from_date,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE strftime(o_orderdate + INTERVAL 100 DAY, '%Y-%m-%d') END AS until_date FROM orders)"""


def memberships(spark, d):
    o = table(spark, d, "orders")
    until = F.when(F.col("o_orderstatus") != "O", F.date_format(F.date_add("o_orderdate", 100), "yyyy-MM-dd"))
    return o.select(F.col("o_custkey").alias("person_id"), F.col("o_orderpriority").alias("party"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("from_date"), until.alias("until_date"))


@query("SELECT person_id, party FROM memberships QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY until_date IS NULL DESC, from_date DESC, party DESC) = 1", ctes=MEMBERSHIPS)
def current_party(spark, d):
    return identity.current_party(memberships(spark, d))


@query("SELECT person_id, arg_max(party, from_date || party) AS party FROM memberships GROUP BY 1", ctes=MEMBERSHIPS)
def latest_party(spark, d):
    return identity.latest_of(memberships(spark, d), ["person_id"], [F.col("from_date"), F.col("party")], "party", "party")


@query("""SELECT regexp_extract(url, '://([^/?#]*)', 1) AS person, arg_min(url, (CASE WHEN contains(url, 'utm') THEN '1' ELSE '0' END) || lpad(page_id::VARCHAR, 12, '0')) AS url
  FROM pages GROUP BY 1""")
def default_link(spark, d):
    """One link per person, a default link (here: one without a campaign tag) first."""
    p = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("person"), "url", "page_id")
    default = ~F.contains("url", F.lit("utm"))
    order = [default.alias("default"), (-F.col("page_id")).alias("first")]
    return identity.latest_of(p, ["person"], order, "url", "url")


@query("""SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, arg_max(url, lpad(regexp_extract(url, '/([0-9]+)', 1), 6, '0') || url) AS url FROM pages GROUP BY 1""")
def newest_link(spark, d):
    """The link with the largest number in it, as the newest register is chosen by its year."""
    p = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), "url")
    year = F.lpad(F.regexp_extract("url", "/([0-9]+)", 1), 6, "0")
    return identity.latest_of(p, ["host"], [year.alias("y"), F.col("url")], "url", "url")

