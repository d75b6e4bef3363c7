"""Normalisers of each source: rows of the tables in the landed shapes, through to the record envelope.

Customers stand for people, orders and line items for what they ask, say, declare and
vote; blanks, repeats, unknown people and fallback fields occur in each shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.plans.catalog import query
from rollcall.plans.views import table
from rollcall.sources import normalise as n
from rollcall.sources.scratch import written

C = F.col


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd")


def _people(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select(C("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(nation, "c_nationkey")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return table(spark, d, "orders").join(people.hint("merge"), "o_custkey").withColumn("day", _day("o_orderdate"))


def _roster(spark: SparkSession, d: str, role: str) -> DataFrame:
    """All people; every third one stands there under another id and name, so that records do not find them."""
    gone = C("c_custkey") % 3 == 0
    return _people(spark, d).select(
        F.concat(F.when(gone, "former ").otherwise(""), C("c_custkey").cast("string")).alias("id"), F.concat(F.when(gone, "Former ").otherwise(""), "c_name").alias("name"), C("c_mktsegment").alias("party"), C("n_name").alias("constituency"), F.lit(role).alias("role"),
        F.when(C("c_custkey") % 5 == 0, "historical").otherwise("current").alias("status"),
    )


def _flat(records: DataFrame, *metadata: str) -> DataFrame:
    """The envelope with its member and some metadata as columns."""
    m = [C("member")[f].alias(f"member_{f}") for f in ("id", "name", "party", "constituency", "role")]
    return records.select("data_type", *m, "date", "text", "title", *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in metadata])


SQL = """
people AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey),
asked AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders JOIN customer ON o_custkey = c_custkey),
rostered AS (SELECT c_custkey AS person, CASE WHEN c_custkey % 3 = 0 THEN 'former ' ELSE '' END || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'Former ' ELSE '' END || c_name AS name,
  c_mktsegment AS party, n_name AS constituency, CASE WHEN c_custkey % 5 = 0 THEN 'historical' ELSE 'current' END AS status FROM people),
listed AS (SELECT CASE WHEN person % 3 <> 0 THEN person END AS k, * FROM rostered),
spoken AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events)"""


# ---- members --------------------------------------------------------------------


@query("""SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 4 = 0 THEN 'Sir ' || c_name ELSE c_name END AS name, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_mktsegment END AS party, n_name AS constituency,
  CASE WHEN h = 'Commons' THEN 'MP' ELSE 'Lord' END AS role, CASE WHEN h = 'Commons' THEN 'current' ELSE 'historical' END AS status FROM people, (VALUES ('Commons'), ('Lords')) t(h)""", ctes=SQL)
def uk_members(spark, d):
    items = _people(spark, d).select(
        C("c_custkey").alias("id"), F.when(C("c_custkey") % 4 == 0, "  ").otherwise(C("c_name")).alias("nameDisplayAs"), F.concat(F.lit("Sir "), "c_name").alias("nameFullTitle"),
        F.when(C("c_custkey") % 6 != 0, F.struct(C("c_mktsegment").alias("name"))).alias("latestParty"), F.struct(C("n_name").alias("membershipFrom")).alias("latestHouseMembership"),
    )
    return n.uk_members(items, "Commons", True).unionByName(n.uk_members(items, "Lords", False))


@query("""SELECT DISTINCT c_custkey::VARCHAR AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'org ' || c_mktsegment ELSE c_mktsegment END AS party, '' AS constituency, 'MLA' AS role, 'current' AS status
  FROM asked""", ctes=SQL)
def ni_members(spark, d):
    """A roster whose members repeat."""
    rows = _asked(spark, d).select(C("o_custkey").cast("string").alias("PersonId"), C("c_name").alias("MemberName"), F.when(C("o_custkey") % 4 == 0, " ").otherwise(C("c_mktsegment")).alias("PartyName"), F.concat(F.lit("org "), "c_mktsegment").alias("PartyOrganisation"))
    return n.ni_members(rows)


@query("SELECT DISTINCT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS party, '' AS constituency, 'MLA' AS role, 'current' AS status FROM asked WHERE o_custkey % 7 <> 0", ctes=SQL)
def ni_members_derived(spark, d):
    """No roster landed: the people that the interests name."""
    rows = _asked(spark, d).select(C("o_custkey").cast("string").alias("PersonId"), F.when(C("o_custkey") % 7 == 0, "").otherwise(C("c_name")).alias("MemberName"), C("c_mktsegment").alias("PartyName"))
    return n.ni_members_or_derived(rows.filter(F.lit(False)), rows)


SCOTS = f"""{SQL},
memberships AS (SELECT o_custkey, o_orderkey, day, o_orderstatus = 'O' AS open, ['red', 'green', 'blue'][o_orderkey % 3 + 1] AS party FROM asked),
best AS (SELECT o_custkey, arg_max(party, (open, day, party)) AS found FROM memberships GROUP BY 1),
msps AS (SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 2 = 0 THEN 'Ann ' || c_name ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'old' ELSE c_mktsegment END AS party,
  n_name AS constituency, 'MSP' AS role, CASE WHEN c_acctbal >= 0 THEN 'current' ELSE 'historical' END AS status FROM people)"""


def _msps(spark, d):
    k, start = C("c_custkey"), lambda day, party: F.struct(F.lit(day).alias("ValidFromDate"), party.alias("PartyName"))
    rows = _people(spark, d).select(
        k.alias("PersonID"), F.when(k % 2 == 0, F.concat("c_name", F.lit(" , Ann"))).otherwise(C("c_name")).alias("ParliamentaryName"), C("n_name").alias("ConstituencyName"), (C("c_acctbal") >= 0).alias("IsCurrent"),
        F.when(k % 3 == 1, F.array(start("2021-05-01", F.lit("old")), start("2010-05-01", C("c_mktsegment")))).when(k % 3 == 2, F.array(start("2020-01-01", F.lit("old")), start("2022-01-01", C("c_mktsegment"))))
        .otherwise(F.array().cast("array<struct<ValidFromDate:string,PartyName:string>>")).alias("MemberParties"),
    )
    return n.scottish_members(rows)


@query("SELECT * FROM msps", ctes=SCOTS)
def scottish_members(spark, d):
    return _msps(spark, d)


@query("SELECT id, name, CASE WHEN party <> '' THEN party ELSE coalesce(found, '') END AS party, constituency, role, status FROM msps LEFT JOIN best ON id = o_custkey::VARCHAR", ctes=SCOTS)
def scottish_parties(spark, d):
    memberships = _asked(spark, d).select(C("o_custkey").alias("PersonID"), (C("o_orderkey") % 3).alias("PartyID"), C("day").alias("ValidFromDate"), F.when(C("o_orderstatus") != "O", "2030-01-01").alias("ValidUntilDate"))
    parties = spark.createDataFrame([(0, "red"), (1, "green"), (2, "blue")], "ID long, PartyName string")
    return n.scottish_parties(_msps(spark, d), memberships, parties)


@query("""SELECT id, name, party, constituency, role, status, url AS profile_url FROM msps LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority || o_orderkey, (o_orderstatus = 'F', o_orderpriority || o_orderkey)) AS url FROM asked GROUP BY 1)
  ON id = o_custkey::VARCHAR""", ctes=SCOTS)
def profile_links(spark, d):
    sites = _asked(spark, d).select(C("o_custkey").alias("PersonID"), F.concat("o_orderpriority", C("o_orderkey").cast("string")).alias("WebURL"), (C("o_orderstatus") == "F").alias("IsDefault"))
    return n.profile_links(_msps(spark, d), sites)


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_mktsegment END AS party, n_name AS constituency, 'MS' AS role, 'current' AS status FROM people", ctes=SQL)
def welsh_members(spark, d):
    """Wards with their councillors, one of them listed twice."""
    one = F.struct(C("c_custkey").alias("councillorid"), F.concat("c_name", F.when(C("c_custkey") % 2 == 0, " MS").otherwise("")).alias("fullusername"), F.when(C("c_custkey") % 6 == 0, " ").otherwise(C("c_mktsegment")).alias("politicalpartytitle"))
    wards = _people(spark, d).groupBy(C("n_name").alias("wardtitle")).agg(F.collect_list(one).alias("c")).select("wardtitle", F.concat("c", F.slice("c", 1, 1)).alias("councillor"))
    return n.welsh_members(wards)


# ---- interests ------------------------------------------------------------------


@query("""SELECT 'register_of_interests' AS data_type, id AS member_id, name AS member_name, party AS member_party, constituency AS member_constituency, 'MP' AS member_role, day AS date,
  CASE WHEN o_orderkey % 4 = 0 THEN 'about ' || o_orderkey ELSE o_orderpriority || ' ' || o_orderkey END AS text, o_orderpriority AS title, o_orderpriority AS category, o_orderkey::VARCHAR AS interest_id
  FROM asked JOIN listed ON person = o_custkey WHERE status = 'current' AND o_orderkey % 9 <> 0""", ctes=SQL)
def uk_interests(spark, d):
    key = C("o_orderkey").cast("string")
    entry = F.struct(
        key.alias("id"), F.when(C("o_orderkey") % 4 == 0, "").when(C("o_orderkey") % 9 == 0, " ").otherwise(F.concat("o_orderpriority", F.lit(" "), key)).alias("interest"),
        F.when(C("o_orderkey") % 9 == 0, "").otherwise(F.concat(F.lit("about "), key)).alias("description"), F.concat("day", F.lit("T10:00")).alias("createdWhen"), F.lit("").alias("lastAmendedWhen"), F.lit("false").alias("registeredLate"),
    )
    who = _roster(spark, d, "MP").select(F.regexp_replace("id", "^former ", "").alias("person"), "status", F.struct("id", "name", "party", "constituency", "role").alias("who"))
    grouped = _asked(spark, d).groupBy(C("o_custkey").cast("string").alias("person"), C("o_orderpriority").alias("name")).agg(F.collect_list(entry).alias("interests")).join(who, "person")
    return _flat(n.uk_interests(grouped, C("who"), C("status")), "category", "interest_id")


@query("""SELECT 'register_of_interests' AS data_type, o_custkey::VARCHAR AS member_id, coalesce(name, 'inline ' || c_name) AS member_name, coalesce(party, 'P') AS member_party, coalesce(constituency, '') AS member_constituency,
  'MLA' AS member_role, day AS date, CASE WHEN o_orderkey % 4 = 0 THEN 'other ' || o_orderkey ELSE 'entry ' || o_orderkey END AS text, o_orderpriority AS title, o_orderpriority AS category, (o_orderkey % 10)::VARCHAR AS interest_id
  FROM asked LEFT JOIN listed ON k = o_custkey WHERE o_orderkey % 8 <> 0""", ctes=SQL)
def ni_interests(spark, d):
    key = C("o_orderkey").cast("string")
    rows = _asked(spark, d).select(
        C("o_custkey").alias("PersonId"), F.concat(F.lit("inline "), "c_name").alias("MemberName"), F.lit("P").alias("PartyName"), F.when(C("o_orderkey") % 4 == 0, " ").otherwise(F.concat(F.lit("entry "), key)).alias("RegisterEntry"),
        F.when(C("o_orderkey") % 8 == 0, "").otherwise(F.concat(F.lit("other "), key)).alias("Description"), F.concat("day", F.lit("T00:00:00")).alias("RegisterEntryStartDate"), C("o_orderpriority").alias("RegisterCategory"),
        (C("o_orderkey") % 10).cast("string").alias("RegisterCategoryId"),
    )
    return _flat(n.ni_interests(rows, _roster(spark, d, "MLA")), "category", "interest_id")


@query("""SELECT 'register_of_interests' AS data_type, coalesce(name, inline) AS member_name, CASE WHEN l.id IS NOT NULL THEN l.id WHEN known THEN o_custkey::VARCHAR ELSE '' END AS member_id, coalesce(party, '') AS member_party,
  coalesce(constituency, '') AS member_constituency, 'MSP' AS member_role, CASE WHEN o_orderkey % 2 = 0 THEN day ELSE '' END AS date, 'paid' || CASE WHEN o_orderkey % 2 = 0 THEN ' on ' || day ELSE '' END AS text,
  o_orderpriority AS title, o_orderpriority AS category FROM (SELECT *, o_orderkey % 2 = 1 AS known, upper(c_name) AS inline FROM asked) LEFT JOIN listed l ON k = o_custkey WHERE o_orderkey % 10 <> 0""", ctes=SQL)
def scottish_interests(spark, d):
    """Odd orders carry the person's id, even ones the name alone, in capitals."""
    rows = _asked(spark, d).select(
        F.when(C("o_orderkey") % 2 == 1, C("o_custkey")).alias("PersonID"), F.upper("c_name").alias("MemberName"), C("o_orderpriority").alias("Category"),
        F.when(C("o_orderkey") % 10 == 0, "").when(C("o_orderkey") % 2 == 0, F.concat(F.lit("paid on "), "day")).otherwise("paid").alias("Description"),
    )
    return _flat(n.scottish_interests(rows, _roster(spark, d, "MSP")), "category")


# ---- questions --------------------------------------------------------------------


@query("""SELECT 'question' AS data_type, o_custkey::VARCHAR AS member_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Inline ' || c_name ELSE coalesce(l.name, '') END AS member_name,
  CASE WHEN o_orderkey % 3 = 0 THEN 'P' ELSE coalesce(party, '') END AS member_party, CASE WHEN o_orderkey % 3 = 0 THEN 'M' ELSE coalesce(constituency, '') END AS member_constituency, 'MP' AS member_role, day AS date,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Question: why ' || o_orderkey || chr(10) || chr(10) || 'Answer: so' ELSE 'why ' || o_orderkey END AS text, o_orderpriority AS title, o_orderkey::VARCHAR AS question_id,
  'Treasury' AS answering_body, '2020-01-01' AS answer_date FROM asked LEFT JOIN listed l ON k = o_custkey""", ctes=SQL)
def uk_questions(spark, d):
    """Every question pulled twice, the second pull changed."""
    key = C("o_orderkey")
    first = _asked(spark, d).select(
        key.cast("string").alias("id"), F.concat(F.lit(" why "), key.cast("string")).alias("questionText"), F.when(key % 2 == 0, "so ").otherwise(" ").alias("answerText"), C("o_custkey").alias("askingMemberId"),
        F.concat("day", F.lit("T09:00")).alias("tabledWhen"), C("o_orderpriority").alias("heading"), F.lit("Treasury").alias("answeringBodyName"), F.lit("2020-01-01T00").alias("dateAnswered"), F.lit("false").alias("isWithdrawn"),
        F.struct(F.when(key % 3 == 0, F.concat(F.lit("Inline "), "c_name")).alias("name"), F.lit("").alias("listAs"), F.lit("P").alias("party"), F.lit("M").alias("memberFrom")).alias("askingMember"), F.lit(1).alias("seq"),
    )
    again = first.withColumns({"questionText": F.lit("changed"), "seq": F.lit(2)})
    rows = first.unionByName(again).withColumn("askingMember", F.when(C("askingMember.name").isNotNull(), C("askingMember")))
    inline = n.uk_questions(rows, _roster(spark, d, "MP"))
    return _flat(inline, "question_id", "answering_body", "answer_date")


@query("""SELECT 'question' AS data_type, o_custkey::VARCHAR AS member_id, c_name AS member_name, c_mktsegment AS member_party, '' AS member_constituency, 'MLA' AS member_role, day AS date,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Question: why?' || chr(10) || chr(10) || 'Answer: ' || o_orderpriority ELSE 'why?' END AS text, 'AQ ' || o_orderkey AS title, CASE WHEN o_orderstatus = 'F' THEN 'oral' ELSE 'written' END AS question_type,
  CASE WHEN o_orderkey % 5 = 0 THEN 'AQ ' || o_orderkey ELSE o_orderkey::VARCHAR END AS question_id FROM asked""", ctes=SQL)
def ni_questions(spark, d):
    key = C("o_orderkey")
    base = _asked(spark, d).select(
        "o_orderstatus", F.when(key % 5 == 0, "").otherwise(key.cast("string")).alias("DocumentId"), F.concat(F.lit("AQ "), key.cast("string")).alias("Reference"), C("o_custkey").cast("string").alias("TablerPersonId"),
        C("c_name").alias("TablerName"), C("c_mktsegment").alias("PartyName"), F.concat("day", F.lit("T00")).alias("TabledDate"), F.lit("why?").alias("QuestionText"), F.when(key % 2 == 0, C("o_orderpriority")).otherwise("").alias("AnswerText"),
    )
    oral, rest = base.filter("o_orderstatus = 'F'"), base.filter("o_orderstatus <> 'F'")
    return _flat(n.ni_questions(oral, rest.withColumnsRenamed({"QuestionText": "Question", "AnswerText": "AnswerPlainText", "TabledDate": "Date"})), "question_type", "question_id")


@query("""SELECT 'question' AS data_type, '' AS member_id, CASE WHEN r = 'question' THEN 'Jo Bell' ELSE 'Ann Hill' END AS member_name, CASE WHEN r = 'question' THEN 'Red' ELSE '' END AS member_party,
  CASE WHEN r = 'question' THEN 'North' ELSE '' END AS member_constituency, 'MSP' AS member_role, CASE WHEN r = 'question' OR o_orderkey % 3 <> 0 THEN '2020-03-05' ELSE '2020-04-' || lpad((o_orderkey % 9 + 10)::VARCHAR, 2, '0') END AS date,
  CASE WHEN r = 'question' THEN 'To ask about order ' || o_orderkey ELSE 'The answer is ' || o_orderpriority END AS text, 'S6W-' || o_orderkey AS title, r AS qa_role FROM asked, (VALUES ('question'), ('answer')) t(r)
  WHERE o_orderkey % 4 <> 0 AND (r = 'question' OR o_orderkey % 5 <> 0) AND NOT (r = 'answer' AND o_orderkey % 3 <> 0 AND FALSE)""", ctes=SQL)
def scottish_cards(spark, d):
    """Card texts; one in four lodged too early, one in five with an answer too short, two in three without a date of answer."""
    key = C("o_orderkey")
    answered = F.concat(F.lit("Answered by Ann Hill on "), (key % 9 + 10).cast("string"), F.lit(" April 2020\n"))
    text = F.concat(
        F.lit("Question reference: S6W-"), key.cast("string"), F.lit("\nAsked by: Jo Bell, MSP for North, Red\nDate lodged: "), F.when(key % 4 == 0, "05 March 2010").otherwise("05 March 2020"), F.lit("\n"),
        F.when(key % 3 == 0, answered).otherwise(F.lit("Answered by Ann Hill on 31 Someday 2020\n")), F.lit("Question\nTo ask about order "), key.cast("string"), F.lit("\nAnswer\n"),
        F.when(key % 5 == 0, "Yes.").otherwise(F.concat(F.lit("The answer is "), "o_orderpriority")),
    )
    return _flat(n.scottish_cards(_asked(spark, d).select(text.alias("text")), "2015-01-01"), "qa_role")


@query("""SELECT 'question' AS data_type, o_custkey::VARCHAR AS member_id, c_name AS member_name, 'P' AS member_party, '' AS member_constituency, 'MS' AS member_role, strftime(o_orderdate, '%Y-%m-%d') AS date,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Question: why' || chr(10) || chr(10) || 'Answer: so' ELSE 'why' END AS text, 'WQ-' || o_orderkey AS title FROM asked WHERE o_orderkey % 7 <> 0""", ctes=SQL)
def welsh_questions(spark, d):
    """Order-paper rows, each repeated under another spelling of its id."""
    key = C("o_orderkey").cast("string")
    rows = _asked(spark, d).select(
        F.concat(F.lit("WQ"), key).alias("questionId"), C("o_custkey").cast("string").alias("memberId"), F.concat("c_name", F.lit(" MS")).alias("memberName"), F.lit("P").alias("party"),
        F.concat(F.lit("Tabled on "), F.date_format("o_orderdate", "dd/MM/yyyy")).alias("label"), F.when(C("o_orderkey") % 7 == 0, " ").otherwise("why").alias("question"), F.when(C("o_orderkey") % 2 == 0, "so").otherwise("").alias("answer"), F.lit(1).alias("seq"),
    )
    again = rows.withColumns({"questionId": F.concat(F.lit(" WQ-"), key_of("questionId")), "memberName": F.lit("other"), "seq": F.lit(2)})
    return _flat(n.welsh_questions(rows.unionByName(again)))


def key_of(c: str):
    return F.substring(c, F.lit(3), F.length(c))


@query("""SELECT 'question' AS data_type, '' AS member_id, c_name AS member_name, '' AS member_party, '' AS member_constituency, 'MS' AS member_role, strftime(o_orderdate, '%Y-%m-%d') AS date, 'why' AS text, 'WQ-' || o_orderkey AS title FROM asked""", ctes=SQL)
def welsh_search_questions(spark, d):
    """Rows of the search interface: other field names."""
    rows = _asked(spark, d).select(F.concat(F.lit("wq"), C("o_orderkey").cast("string")).alias("id"), C("c_name").alias("tabledBy"), F.date_format("o_orderdate", "d/M/yyyy").alias("date"), F.lit("why").alias("text"), F.lit(1).alias("seq"))
    return _flat(n.welsh_questions(rows))


# ---- plenary ------------------------------------------------------------------------

_SAID = """SELECT 'plenary_speech' AS data_type, user_id::VARCHAR AS member_id, CASE WHEN event_id % 3 = 0 THEN 'The Chair' ELSE coalesce(l.name, '') END AS member_name, coalesce(l.party, '') AS member_party,
  coalesce(constituency, '') AS member_constituency, 'MP' AS member_role, day AS date, 'said ' || event_id || ' & more' AS text, event_type AS title, event_id::VARCHAR AS contribution_id, {kind} AS contribution_type
  FROM spoken LEFT JOIN listed l ON k = user_id WHERE event_id % 6 <> 0"""


def _said(spark, d):
    key = C("event_id").cast("string")
    body = F.when(C("event_id") % 6 == 0, "<p> a</p>").otherwise(F.concat(F.lit("<p>said <b>"), key, F.lit("</b> &amp;\n more</p>")))
    return table(spark, d, "events").select(
        C("user_id").alias("MemberId"), F.when(C("event_id") % 3 == 0, "The Chair").otherwise("").alias("AttributedTo"), body.alias("ContributionTextFull"), F.concat(_day("ts"), F.lit("T12")).alias("SittingDate"),
        C("event_type").alias("DebateSection"), key.alias("ContributionExtId"), F.lit("x").alias("DebateSectionExtId"), F.lit("Commons").alias("House"),
    )


@query(_SAID.format(kind="'spoken'"), ctes=SQL)
def uk_contributions(spark, d):
    return _flat(n.uk_contributions(_said(spark, d), _roster(spark, d, "MP")), "contribution_id", "contribution_type")


@query(_SAID.format(kind="'written_statement'") + " AND day >= '2024-01-10'", ctes=SQL)
def uk_statements(spark, d):
    return _flat(n.uk_statements(_said(spark, d), _roster(spark, d, "MP"), "2024-01-10"), "contribution_id", "contribution_type")


@query(_SAID.format(kind="'spoken'") + " UNION ALL " + _SAID.format(kind="'written_statement'") + " AND day >= '2024-01-10'", ctes=SQL)
def uk_plenary(spark, d):
    said, roster = _said(spark, d), _roster(spark, d, "MP")
    return _flat(n.uk_plenary(n.uk_contributions(said, roster), n.uk_statements(said, roster, "2024-01-10")), "contribution_id", "contribution_type")


@query("""SELECT 'plenary_speech' AS data_type, '' AS member_id, coalesce(nullif(named, ''), last_value(nullif(named, '') IGNORE NULLS) OVER (PARTITION BY l_orderkey, part ORDER BY at_), '') AS member_name, '' AS member_party,
  '' AS member_constituency, 'MLA' AS member_role, day AS date, text, '' AS title, l_orderkey::VARCHAR AS report_id, at_ AS component_id FROM (
  SELECT *, coalesce(sum((kind = 0)::INT) OVER (PARTITION BY l_orderkey ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM (
    SELECT l_orderkey, lpad(l_linenumber::VARCHAR, 3, '0') || '-' || lpad(l_partkey::VARCHAR, 9, '0') || '-' || lpad(l_suppkey::VARCHAR, 9, '0') || '-' || l_quantity::INT AS at_, l_partkey % 5 AS kind, strftime(l_shipdate, '%Y-%m-%d') AS day,
      CASE WHEN l_partkey % 5 = 1 THEN 'Member ' || chr(65 + (l_suppkey % 26)::INT) WHEN l_partkey % 5 = 2 THEN 'Mr Hill' ELSE '' END AS named,
      CASE WHEN l_partkey % 5 = 2 THEN 'Mr Hill: what part ' || l_partkey ELSE 'a longer text on part ' || l_partkey END AS text FROM lineitem WHERE l_partkey % 5 <> 4))""")
def ni_components(spark, d):
    """Report components: named in the header, by a prefix or not at all; headings start anew, and one in five is too short."""
    k = C("l_partkey") % 5
    at = F.concat_ws("-", F.lpad(C("l_linenumber").cast("string"), 3, "0"), F.lpad(C("l_partkey").cast("string"), 9, "0"), F.lpad(C("l_suppkey").cast("string"), 9, "0"), C("l_quantity").cast("int").cast("string"))
    text = F.when(k == 4, "short").when(k == 2, F.concat(F.lit("Mr Hill: what part "), C("l_partkey").cast("string"))).otherwise(F.concat(F.lit("a longer text on part "), C("l_partkey").cast("string")))
    header = F.when(k == 1, F.concat(F.lit("Member "), F.char(65 + C("l_suppkey") % 26))).when(k == 3, "10:30 am").otherwise("")
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", at.alias("ComponentId"), text.alias("ComponentText"), header.alias("ComponentHeader"), F.when(k == 0, "Agenda heading").otherwise("Spoken").alias("ComponentType"), _day("l_shipdate").alias("PlenaryDate"),
    )
    return _flat(n.ni_components(rows, "l_orderkey", "ComponentId"), "report_id", "component_id")


@query("""SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) )::BIGINT AS segment, 'Person ' || (o_orderkey % 50) AS speaker, 'I speak of ' || o_orderpriority || ' and then' AS text FROM asked""", ctes=SQL)
def scottish_report(spark, d):
    """A report a customer, four lines an order: a column number, a running date, a speaker with words, words that go on."""
    key = C("o_orderkey").cast("string")
    who = F.concat(F.lit("Person "), (C("o_orderkey") % 50).cast("string"), F.lit(" (North) (Red): I speak of "), "o_orderpriority")
    lines = F.array(key, F.lit("5 MARCH 2020 6"), who, F.lit("and then"))
    each = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.posexplode(lines).alias("place", "line"))
    numbered = each.withColumn("line_no", C("o_orderkey") * 10 + C("place")).withColumn("line", F.when(C("place") == 0, F.lit("1234")).otherwise(C("line")))
    return n.scottish_report(numbered, "o_custkey")


@query("""SELECT 'plenary_speech' AS data_type, user_id::VARCHAR AS member_id, 'Speaker ' || user_id AS member_name, '' AS member_party, '' AS member_constituency, 'MS' AS member_role, CASE WHEN event_id % 5 = 0 THEN '' ELSE day END AS date,
  'said ' || event_id AS text, event_type AS title, 'C' AS contribution_type FROM spoken WHERE event_id % 6 <> 0 AND (event_id % 5 = 0 OR day BETWEEN '2024-01-05' AND '2024-01-20')""", ctes=SQL)
def welsh_transcripts(spark, d):
    rows = table(spark, d, "events").select(
        C("user_id").cast("string").alias("Member_Id"), F.concat(F.lit("Speaker "), C("user_id").cast("string"), F.lit(" MS")).alias("Member_name_English"), F.when(C("event_id") % 5 == 0, "").otherwise(F.concat(_day("ts"), F.lit("T13"))).alias("MeetingDate"),
        F.when(C("event_id") % 6 == 0, "<p>a</p>").otherwise(F.concat(F.lit("<p>said <i>"), C("event_id").cast("string"), F.lit("</i></p>"))).alias("Contribution_English"), C("event_type").alias("Agenda_item_english"), F.lit("C").alias("contribution_type"),
    )
    return _flat(n.welsh_transcripts(rows, "2024-01-05", "2024-01-20"), "contribution_type")


# ---- votes --------------------------------------------------------------------------------


@query("""SELECT 'vote' AS data_type, l_suppkey::VARCHAR AS member_id, 'S' || l_suppkey AS member_name, '' AS member_party, '' AS member_constituency, 'MP' AS member_role, o_day AS date, 'Voted ' || direction || ' on: T' || l_orderkey AS text,
  'T' || l_orderkey AS title, l_orderkey::VARCHAR AS division_id, CASE WHEN ayes > noes THEN 'passed' ELSE 'not passed' END AS division_result FROM (
  SELECT l_orderkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'aye' WHEN 'N' THEN 'no' ELSE 'no_vote' END AS direction, strftime(o_orderdate, '%Y-%m-%d') AS o_day,
    count_if(l_returnflag = 'A') OVER w AS ayes, count_if(l_returnflag = 'N') OVER w AS noes FROM lineitem JOIN orders ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY l_orderkey))""")
def uk_votes(spark, d):
    """Orders as divisions that list their voters by side."""
    one = F.struct(C("l_suppkey").alias("MemberId"), F.concat(F.lit("S"), C("l_suppkey").cast("string")).alias("Name"), F.lit(" ").alias("Party"))
    flag = C("l_returnflag")
    side = lambda x: F.collect_list(F.when(x, one))
    day = table(spark, d, "orders").select(C("o_orderkey").alias("l_orderkey"), F.concat(_day("o_orderdate"), F.lit("T11:00")).alias("Date"))
    each = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        side(flag == "A").alias("Ayes"), side(flag == "N").alias("Noes"), side(~flag.isin("A", "N")).alias("NoVoteRecorded"), F.count_if(flag == "A").alias("AyeCount"), F.count_if(flag == "N").alias("NoeCount")
    )
    divisions = each.join(day, "l_orderkey").withColumn("Title", F.concat(F.lit("T"), C("l_orderkey").cast("string"))).withColumnRenamed("l_orderkey", "DivisionId")
    return _flat(n.uk_votes(divisions), "division_id", "division_result")


@query("""SELECT 'vote' AS data_type, coalesce(l_suppkey::VARCHAR, '') AS member_id, coalesce('S' || l_suppkey, '') AS member_name, '' AS member_party, '' AS member_constituency, 'MLA' AS member_role, strftime(o_orderdate, '%Y-%m-%d') AS date,
  'Voted ' || CASE WHEN l_orderkey IS NULL THEN 'unknown' WHEN l_returnflag = 'A' THEN 'aye' WHEN l_returnflag = 'N' THEN 'no' ELSE 'odd' END || ' on: ' || o_orderpriority AS text, o_orderpriority AS title,
  CASE WHEN o_orderkey % 4 = 0 THEN 'e' || o_orderkey ELSE o_orderkey::VARCHAR END AS division_id FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def ni_votes(spark, d):
    """Orders without items are divisions without voters."""
    token = F.when(C("l_returnflag") == "A", "AYE").when(C("l_returnflag") == "N", "No").otherwise(" Odd ")
    one = F.struct(C("l_suppkey").alias("PersonID"), F.concat(F.lit("S"), C("l_suppkey").cast("string")).alias("MemberName"), F.lit("").alias("PartyName"), token.alias("VoteType"))
    voters = table(spark, d, "lineitem").groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.collect_list(one).alias("MemberVoting"))
    divisions = table(spark, d, "orders").join(voters, "o_orderkey", "left").select(
        "MemberVoting", F.when(C("o_orderkey") % 4 != 0, C("o_orderkey")).alias("DocumentID"), F.concat(F.lit("e"), C("o_orderkey").cast("string")).alias("EventID"), F.concat(_day("o_orderdate"), F.lit("T1")).alias("DivisionDate"),
        C("o_orderpriority").alias("DivisionSubject"), F.lit("").alias("DivisionResult"),
    )
    return _flat(n.ni_votes(divisions), "division_id")


@query("""SELECT 'vote' AS data_type, 's' || l_suppkey AS member_id, 'S' || l_suppkey AS member_name, '' AS member_party, '' AS member_constituency, 'MSP' AS member_role,
  CASE WHEN l_orderkey % 2 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '2020-03-05' END AS date, 'Voted ' || CASE l_returnflag WHEN 'A' THEN 'aye' WHEN 'N' THEN 'no' ELSE 'unknown' END || ' on: M' || l_orderkey AS text,
  'M' || l_orderkey AS title, 'r' AS division_result FROM lineitem""")
def scottish_votes(spark, d):
    page = F.concat(F.lit("Date lodged: 05 March 2020 "), F.when(C("l_orderkey") % 2 == 0, F.concat(F.lit("Taken in the Chamber on "), F.date_format("l_shipdate", "d MMMM yyyy"))).otherwise(""))
    rows = table(spark, d, "lineitem").select(
        F.concat(F.lit("https://x.test/p/s"), C("l_suppkey").cast("string"), F.when(C("l_linenumber") % 2 == 0, "/?tab=1").otherwise("")).alias("profile_url"), F.concat(F.lit("S"), C("l_suppkey").cast("string")).alias("name"),
        F.when(C("l_returnflag") == "A", "For").when(C("l_returnflag") == "N", "Against").otherwise("").alias("vote"), F.concat(F.lit("M"), C("l_orderkey").cast("string")).alias("title"), page.alias("page_text"), F.lit("r").alias("result"),
    )
    return _flat(n.scottish_votes(rows), "division_result")


# ---- registers and listings -------------------------------------------------------------------


@query("""SELECT DISTINCT substr(u, 7, 4) || '-' || substr(u, 4, 2) || '-' || substr(u, 1, 2) AS date, id FROM (
  SELECT strftime(arg_max(o_orderdate, o_orderkey), '%d-%m-%Y') AS u, (o_orderkey % 97)::VARCHAR AS id FROM orders GROUP BY o_orderkey % 97)""")
def meeting_links(spark, d):
    """Listing pages that name each meeting more than once, the last link winning."""
    link = F.concat(F.lit('<a href="/meeting-of-parliament-'), F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit("?meeting="), (C("o_orderkey") % 97).cast("string"), F.lit('">m</a>'))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", link.alias("link")))), lambda x: x["link"])
    pages = table(spark, d, "orders").groupBy((C("o_orderkey") % 97).alias("page")).agg(F.concat_ws("\n", listed).alias("html"))
    return n.meeting_links(pages)


@query("""SELECT o_custkey, entry, 'Jo ' || o_custkey AS owner, '1. Gifts' AS category, 'gift from ' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ' on ' || strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS text,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '2021-01-01' END AS date, o_orderkey % 2 = 1 AS date_is_snapshot_fallback FROM (
  SELECT *, (1 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT AS entry FROM orders)""")
def register_text(spark, d):
    """A register a customer: the name under its label, then a category and a line for each order, with page numbers between."""
    key = C("o_orderkey")
    gift = F.concat(F.lit("gift from "), "o_orderpriority", F.when(key % 2 == 0, F.concat(F.lit(" on "), _day("o_orderdate"))).otherwise(""))
    body = table(spark, d, "orders").select("o_custkey", key.alias("k"), F.posexplode(F.array(F.lit("1. Gifts"), F.lit("Page 3 of 9"), gift)).alias("place", "line"))
    head = table(spark, d, "orders").select("o_custkey").distinct().select("o_custkey", F.lit(-1).cast("long").alias("k"), F.posexplode(F.array(F.lit("Name:"), F.concat(F.lit("Jo "), C("o_custkey").cast("string"), F.lit(" MS")))).alias("place", "line"))
    lines = body.unionByName(head).select("o_custkey", (C("k") * 10 + C("place")).alias("line_no"), "line")
    return n.register_text(lines, "o_custkey", "Name", F.lit("2021-01-01"))


EDITIONS = """
snapshots AS (
  SELECT c_custkey, 'https://register.test/c' || c_custkey || '/register-of-interests.pdf' AS url, 'Fifth Register of interests' AS term, '' AS date FROM customer
  UNION ALL SELECT c_custkey, 'https://docs.register.test/c' || c_custkey || '/register-1.pdf', 'Sixth Register of interests', '1996-04-08' FROM customer
  UNION ALL SELECT c_custkey, 'https://register.test/c' || c_custkey || '/register-2.pdf', 'Sixth Register of interests', '1998-05-02' FROM customer),
edition_records AS (
  SELECT url, c_custkey::VARCHAR AS member_id, c_name AS member_name, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE date END AS date,
    'gift from ' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ' on ' || strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS text, 'Gifts of ' || o_orderkey AS title, term, date AS register_snapshot_date,
    CASE WHEN o_orderkey % 2 = 1 AND date <> '' THEN 'true' ELSE 'false' END AS date_is_snapshot_fallback
  FROM snapshots JOIN customer USING (c_custkey) JOIN orders ON o_custkey = c_custkey WHERE date = '' OR strftime(o_orderdate, '%Y-%m-%d') <= date)"""


def _links(spark, d):
    """A site a customer: its main page links to a register, twice to an archive, and away; the archive to two editions."""
    base = F.concat(F.lit("https://register.test/c"), C("c_custkey").cast("string"))

    def link(page, position, href, text):
        return F.struct(page.alias("page"), F.lit(position).alias("position"), href.alias("href"), F.lit(text).alias("text"))

    main, archive, own = F.concat(base, F.lit("/")), F.concat(base, F.lit("/register-of-interests-archive")), F.concat(F.lit("/c"), C("c_custkey").cast("string"))
    found = F.array(
        link(main, 1, F.concat(own, F.lit("/register-of-interests.pdf")), "Fifth Register of interests"), link(main, 2, F.concat(own, F.lit("/register-of-interests-archive")), "Sixth Register of interests"),
        link(main, 3, archive, "Register of interests, again"), link(main, 4, F.concat(F.lit("https://share.test/?u=https://register.test/register-of-interests"), own), "Share"), link(main, 5, F.lit("mailto:register.interests@register.test"), "Write"),
        link(main, 6, F.lit("/about"), "About us"), link(archive, 1, F.concat(F.lit("//docs.register.test"), own, F.lit("/register-1.pdf")), "Register of interests as on 8 April 1996 (PDF 1MB)"),
        link(archive, 2, F.concat(own, F.lit("/register-2.pdf")), "Compiled register AS ON 2 may 1998"), link(archive, 3, F.lit("/minutes.pdf"), "Minutes as on 3 May 1998"),
    )
    each = table(spark, d, "customer").select("c_custkey", main.alias("main"), F.explode(found).alias("l")).select("c_custkey", "main", "l.*")
    return each


def _snapshots(spark, d):
    return n.register_snapshots(_links(spark, d), "main", "https://register.test")


def _editions(spark, d):
    """Editions of each customer's register, each with the orders up to its date: a name, numbered headings, a line each."""
    snapshots = _snapshots(spark, d).withColumn("o_custkey", F.regexp_extract("url", r"/c(\d+)/", 1).cast("long"))
    orders = _asked(spark, d).join(snapshots.hint("merge"), "o_custkey").filter((C("date") == "") | (C("day") <= C("date")))
    key = C("o_orderkey")
    gift = F.concat(F.lit("gift from "), "o_orderpriority", F.when(key % 2 == 0, F.concat(F.lit(" on "), "day")).otherwise(""))
    heading = F.concat(F.when(key % 3 == 0, "7) Gifts of ").otherwise("12. Gifts of "), key.cast("string"))
    body = orders.select("url", key.alias("k"), F.posexplode(F.array(heading, gift)).alias("place", "line"))
    top = orders.select("url", "c_name").distinct().select("url", F.lit(-1).cast("long").alias("k"), F.posexplode(F.array(F.lit("Contents of 1. Gifts"), F.concat(F.upper("c_name"), F.lit(" MS")))).alias("place", "line"))
    lines = body.unionByName(top).select("url", (C("k") * 10 + C("place")).alias("line_no"), "line")
    people = _people(spark, d).select(C("c_custkey").cast("string").alias("id"), C("c_name").alias("name"), C("c_mktsegment").alias("party"), C("n_name").alias("constituency"), F.lit("MS").alias("role"))
    return n.register_editions(lines, snapshots.select("url", "term", "date"), people)


@query("SELECT url, term, date FROM snapshots", ctes=EDITIONS)
def register_snapshots(spark, d):
    """Links of register pages to editions with their term and date."""
    return _snapshots(spark, d)


@query("SELECT url, member_id, member_name, date, text, title, term, register_snapshot_date, date_is_snapshot_fallback FROM edition_records", ctes=EDITIONS)
def register_editions(spark, d):
    found = _editions(spark, d)
    meta = [C("metadata")[k].alias(k) for k in ("term", "register_snapshot_date", "date_is_snapshot_fallback")]
    return found.select("url", C("member.id").alias("member_id"), C("member.name").alias("member_name"), "date", "text", "title", *meta)


@query("""SELECT member_id, text, title, register_snapshot_date AS edition FROM edition_records
  WHERE register_snapshot_date = CASE WHEN member_id::BIGINT % 3 = 0 THEN '1996-04-08' WHEN member_id::BIGINT % 3 = 1 THEN '1998-05-02' ELSE 'none' END""", ctes=EDITIONS)
def register_as_of(spark, d):
    """What each member's register said on a day: that day itself, a later one, or one before the first edition."""
    k = C("c_custkey")
    days = table(spark, d, "customer").select(k.cast("string").alias("member_id"), F.when(k % 3 == 0, "1998-05-01").when(k % 3 == 1, "1998-05-02").otherwise("1996-04-07").alias("day"))
    found = n.register_as_of(written(_editions(spark, d), "editions"), days)
    return found.select(C("member.id").alias("member_id"), "text", "title", C("metadata")["register_snapshot_date"].alias("edition"))
