"""Scalar functions and predicates, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions import casts, dates, people, text
from rollcall.functions import votes as vf
from rollcall.operators import quality
from rollcall.operators import votes as v
from rollcall.plans.catalog import query
from rollcall.plans.division_plans import LINES, NON_PARTY_SQL
from rollcall.plans.identity_plans import gradeable_sql, norm_sql
from rollcall.plans.views import _WORD, roster, statements, table, votes, word
from rollcall.sources.readers import first_list_items, json_text_items

# ---- names -----------------------------------------------------------------

NAMES = f"""names AS (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN c_mktsegment || ', Mrs ' || {_WORD.format('c_custkey')}
  WHEN 1 THEN 'The Rt Hon ' || {_WORD.format('c_custkey')} WHEN 2 THEN 'Deputy Speaker ' || {_WORD.format('c_custkey')} WHEN 3 THEN c_name WHEN 4 THEN ' ' ELSE 'Dr ' || {_WORD.format('c_custkey')} || ' MS' END AS name,
  CASE c_custkey % 5 WHEN 0 THEN 'Independent Group' WHEN 1 THEN ' Crossbench' WHEN 2 THEN c_mktsegment WHEN 3 THEN '' ELSE 'No Party Affiliation' END AS party,
  CASE WHEN c_acctbal >= 0 THEN 'current' ELSE 'historical' END AS status FROM customer)"""


def _names(spark, d):
    c, w = table(spark, d, "customer"), word(F.col("c_custkey"))
    k = F.col("c_custkey")
    name = (
        F.when(k % 6 == 0, F.concat("c_mktsegment", F.lit(", Mrs "), w)).when(k % 6 == 1, F.concat(F.lit("The Rt Hon "), w)).when(k % 6 == 2, F.concat(F.lit("Deputy Speaker "), w))
        .when(k % 6 == 3, F.col("c_name")).when(k % 6 == 4, F.lit(" ")).otherwise(F.concat(F.lit("Dr "), w, F.lit(" MS")))
    )
    party = F.when(k % 5 == 0, "Independent Group").when(k % 5 == 1, " Crossbench").when(k % 5 == 2, F.col("c_mktsegment")).when(k % 5 == 3, "").otherwise("No Party Affiliation")
    return c.select(k.alias("id"), name.alias("name"), party.alias("party"), F.when(F.col("c_acctbal") >= 0, "current").otherwise("historical").alias("status"))


@query(f"SELECT id, {norm_sql('name')} AS norm_name FROM names", ctes=NAMES)
def norm_name(spark, d):
    return _names(spark, d).select("id", people.norm_name(F.col("name")).alias("norm_name"))


@query(f"SELECT id, {gradeable_sql('name')} AS gradeable FROM names", ctes=NAMES)
def gradeable_name(spark, d):
    return _names(spark, d).select("id", people.gradeable_name(F.col("name")).alias("gradeable"))


@query(f"SELECT id, lower(trim(party)) NOT IN {NON_PARTY_SQL} AND NOT starts_with(lower(trim(party)), 'independent') AS whipped FROM names", ctes=NAMES)
def whipped_group(spark, d):
    return _names(spark, d).select("id", people.whipped_group(F.col("party")).alias("whipped"))


@query("SELECT id, trim(regexp_replace(regexp_replace(lower(name || ' -- ' || party), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM names", ctes=NAMES)
def slug(spark, d):
    return _names(spark, d).select("id", text.slug(F.concat("name", F.lit(" -- "), "party")).alias("slug"))


@query("SELECT id, regexp_replace(trim(name), '(?i)\\s+(MS|AS|AM|AC)$', '') AS name FROM names", ctes=NAMES)
def role_suffix(spark, d):
    return _names(spark, d).select("id", people.without_role_suffix(F.col("name")).alias("name"))


@query("SELECT id, CASE WHEN status = 'current' AND lower(trim(party)) = 'no party affiliation' THEN 'Presiding Officer' ELSE party END AS party FROM names", ctes=NAMES)
def relabel_office(spark, d):
    return _names(spark, d).select("id", people.relabelled_office(F.col("status"), F.col("party")).alias("party"))


@query("SELECT id, coalesce(nullif(trim(party), ''), status) AS party FROM names", ctes=NAMES)
def party_at_vote(spark, d):
    return _names(spark, d).select("id", people.party_at_vote(F.col("party"), F.col("status")).alias("party"))


@query("SELECT id, name, party FROM names WHERE NOT (trim(name) = '' AND trim(party) = '')", ctes=NAMES)
def junk_guard(spark, d):
    n = _names(spark, d)
    return n.filter(people.usable_member(F.col("party"), F.col("name"))).select("id", "name", "party")


@query("""SELECT id, trim(name) || ', MSP for ' || status AS asker, trim(string_split(name, ',')[1]) AS name, CASE WHEN id % 2 = 0 THEN 'Blue' ELSE '' END AS party, 'Area ' || id AS constituency
  FROM names WHERE trim(name) <> '' AND NOT contains(name, ',')""", ctes=NAMES)
def split_asker(spark, d):
    n = _names(spark, d).filter("trim(name) <> '' and not contains(name, ',')")
    tail = F.when(F.col("id") % 2 == 0, F.lit(", Blue, MSP")).otherwise(F.lit(", MSP"))
    asked = F.concat(F.col("name"), F.lit(", MSP for Area "), F.col("id").cast("string"), tail)
    return n.select("id", F.concat(F.trim("name"), F.lit(", MSP for "), "status").alias("asker"), people.split_asker(asked)["name"].alias("name"), people.split_asker(asked)["party"].alias("party"), people.split_asker(asked)["constituency"].alias("constituency"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'North ' || id WHEN id % 3 = 1 THEN 'South' ELSE '' END AS area FROM names", ctes=NAMES)
def current_role(spark, d):
    now = F.when(F.col("id") % 3 == 0, F.concat(F.lit("MSP for North "), F.col("id").cast("string"), F.lit(" (Constituency)"))).when(F.col("id") % 3 == 1, F.lit("MSP for South (Region)")).otherwise("")
    return _names(spark, d).select("id", people.current_role(F.concat(F.lit("Former MSP for East (Region) "), now, F.lit(" since then"))).alias("area"))


@query("""SELECT id, CASE id % 4 WHEN 0 THEN 'Green' WHEN 1 THEN 'Plaid Cymru' WHEN 2 THEN 'Labour and Co-operative' ELSE '' END AS party FROM names""", ctes=NAMES)
def party_from_text(spark, d):
    shown = F.when(F.col("id") % 4 == 0, "Party: Green | more").when(F.col("id") % 4 == 1, "sits for plaid cymru").when(F.col("id") % 4 == 2, "of Labour and Co-operative here").otherwise("nothing")
    return _names(spark, d).select("id", people.party_in_text(shown, ["Labour", "Labour and Co-operative", "Plaid Cymru", "Green"]).alias("party"))


# ---- dates -----------------------------------------------------------------

DATED = """dated AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%-d %B %Y') AS long_, strftime(o_orderdate, '%-d/%-m/%Y') AS dmy, epoch_ms(o_orderdate) AS ms FROM orders)"""


def _dated(spark, d):
    o = table(spark, d, "orders")
    day = F.col("o_orderdate")
    return o.select(F.col("o_orderkey").alias("id"), F.date_format(day, "yyyy-MM-dd").alias("iso"), F.date_format(day, "d MMMM yyyy").alias("long_"), F.date_format(day, "d/M/yyyy").alias("dmy"), F.unix_millis(day.cast("timestamp")).alias("ms"))


@query("SELECT id, CASE WHEN id % 5 = 4 THEN '' ELSE iso END AS date FROM dated", ctes=DATED)
def extract_date(spark, d):
    k = F.col("id") % 5
    shown = (
        F.when(k == 0, F.concat(F.lit("(Registered "), F.col("long_"), F.lit(")"))).when(k == 1, F.concat(F.lit("on "), F.translate("dmy", "/", "."), F.lit(" x")))
        .when(k == 2, F.concat(F.lit("at "), F.col("iso"), F.lit("T09:00"))).when(k == 3, F.concat(F.lit("31/02/2024 then "), F.upper("long_"))).otherwise(F.lit("31/02/2024"))
    )
    return _dated(spark, d).select("id", dates.extract_date(shown).alias("date"))


@query("SELECT id, CASE WHEN id % 4 = 3 THEN '' ELSE iso END AS date FROM dated", ctes=DATED)
def extract_vote_date(spark, d):
    k = F.col("id") % 4
    shown = (
        F.when(k == 0, F.concat(F.lit("Date lodged: 1 May 1999. Taken in the Chamber on "), F.col("long_"))).when(k == 1, F.concat(F.lit("2 June 1999 Date lodged: "), F.col("long_")))
        .when(k == 2, F.concat(F.lit("held "), F.col("long_"), F.lit("."))).otherwise(F.lit("no date"))
    )
    return _dated(spark, d).select("id", dates.vote_date(shown).alias("date"))


@query("SELECT id, iso AS slashed, iso AS dashed, iso AS millis FROM dated", ctes=DATED)
def date_formats(spark, d):
    epoch = F.concat(F.lit("/Date("), F.col("ms").cast("string"), F.lit(")/"))
    return _dated(spark, d).select("id", dates.day_first(F.col("dmy")).alias("slashed"), dates.day_first(F.translate("dmy", "/", "-")).alias("dashed"), dates.epoch_millis(epoch).alias("millis"))


@query("SELECT id, strftime(iso::DATE, '%A, %b %-d, %Y') AS shown FROM dated", ctes=DATED)
def format_date(spark, d):
    return _dated(spark, d).select("id", dates.search_format(F.col("iso")).alias("shown"))


# ---- votes -----------------------------------------------------------------

RAW = ("For", "AGAINST", "DidNotVote", " Abstain ", "2", "Tellers", "")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE l_partkey % 7 WHEN 0 THEN 'aye' WHEN 1 THEN 'no' WHEN 2 THEN 'no_vote' WHEN 3 THEN 'abstain' WHEN 4 THEN 'no'
  WHEN 5 THEN 'tellers' ELSE 'unknown' END AS direction FROM lineitem""")
def vote_direction(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in RAW]), (F.col("l_partkey") % 7 + 1).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", vf.direction(raw).alias("direction"))


@query("SELECT seq, CASE WHEN starts_with(title, 'red') THEN title ELSE trim(motion) END AS motion FROM votes")
def motion_text(spark, d):
    title = F.when(F.col("title").startswith("red"), F.col("title")).otherwise(" ")
    return votes(spark, d).select("seq", text.motion_text(title, F.concat(F.lit("Voted aye on: "), "motion")).alias("motion"))


@query("SELECT seq, CASE WHEN starts_with(title, 'red') THEN division ELSE date || '|' || title END AS division_key FROM votes")
def division_key(spark, d):
    source = F.when(F.col("title").startswith("red"), F.col("division")).otherwise("")
    return votes(spark, d).select("seq", vf.division_key(source, F.col("date"), F.col("title")).alias("division_key"))


@query("SELECT legislature, division, CASE WHEN ayes > noes THEN 'passed' ELSE 'not passed' END AS result FROM totals", ctes=LINES)
def division_result(spark, d):
    return v.totals(votes(spark, d)).select("legislature", "division", vf.division_result(F.col("ayes"), F.col("noes")).alias("result"))


_STANCE = "CASE WHEN {0} + {1} <> 0 THEN round(({0} - {1})::DOUBLE / ({0} + {1} + 4), 3) ELSE 0.0::DOUBLE END"


@query(f"SELECT legislature, division, party, {_STANCE.format('ayes', 'noes')} AS stance FROM party_tally", ctes=LINES)
def stance_score(spark, d):
    return v.party_tally(votes(spark, d)).select("legislature", "division", "party", vf.stance(F.col("ayes"), F.col("noes")).alias("stance"))


@query(f"""SELECT legislature, division, party, CASE WHEN ayes = 0 THEN round(2.0 * st / 2.0, 3) ELSE round((1.0 * st + 2.0 * -st / 2) / 3.0, 3) END AS combined FROM (
  SELECT *, {_STANCE.format('ayes', 'noes')} AS st FROM party_tally)""", ctes=LINES)
def combined_stance(spark, d):
    t = v.party_tally(votes(spark, d)).withColumn("st", vf.stance(F.col("ayes"), F.col("noes")))
    voted = F.when(F.col("ayes") == 0, F.col("st")).otherwise(-F.col("st") / 2)
    return t.select("legislature", "division", "party", vf.combined_stance(F.col("st"), F.col("ayes"), voted, F.lit(1)).alias("combined"))


# ---- texts -----------------------------------------------------------------


@query("SELECT doc_id, sha1('speech|' || doc_id || '|' || source || '|2024-01-01|' || lang || '|' || substr(coalesce(text, ''), 1, 300)) AS key FROM documents")
def record_key(spark, d):
    key = text.record_key(F.lit("speech"), F.col("doc_id").cast("string"), F.col("source"), F.lit("2024-01-01T09:00"), F.col("lang"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", key.alias("key"))


@query("SELECT legislature, id, sha1('member|' || id || '|' || name || '|' || party || '|' || constituency || '|' || role) AS key FROM roster")
def roster_key(spark, d):
    return roster(spark, d).select("legislature", "id", text.roster_key(*[F.col(c) for c in ("id", "name", "party", "constituency", "role")]).alias("key"))


@query("""SELECT q.conv_id, q.turn, CASE WHEN trim(coalesce(a.text, '')) <> '' THEN 'Question: ' || regexp_replace(q.text, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || 'Answer: ' || regexp_replace(a.text, '^\\s+|\\s+$', '', 'g')
  ELSE regexp_replace(q.text, '^\\s+|\\s+$', '', 'g') END AS text FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'""")
def qa_text(spark, d):
    c = table(spark, d, "conversations")
    q, a = c.filter("role = 'user'"), c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"], "left").select("conv_id", "turn", text.question_text(F.col("text"), F.col("answer")).alias("text"))


@query("SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'WQ-' || conv_id WHEN 1 THEN 'OPQ' || conv_id ELSE 'WQ-' || turn END AS id FROM conversations")
def question_id(spark, d):
    k = F.col("conv_id").cast("string")
    raw = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(" wq"), k)).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("OPQ"), k)).otherwise(F.concat(F.lit("WQ"), F.col("turn").cast("string")))
    return table(spark, d, "conversations").select("conv_id", "turn", text.question_id(raw).alias("id"))


@query("SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'Mrs Smith (North)' WHEN 1 THEN 'Jane Smith' WHEN 2 THEN 'The Speaker' ELSE '' END AS speaker FROM conversations")
def speaker_prefix(spark, d):
    k = (F.col("conv_id") + F.col("turn")) % 5
    lead = F.when(k == 0, "Mrs Smith (North): ").when(k == 1, "Jane Smith:").when(k == 2, "The Speaker : ").when(k == 3, "they said: ").otherwise("none ")
    return table(spark, d, "conversations").select("conv_id", "turn", people.speaker_prefix(F.concat(lead, F.lower("text"))).alias("speaker"))


_VISIBLE = "html"
for _pattern, _flag in ((r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "g"), (r"<[^>]*>", "g")):
    _VISIBLE = f"regexp_replace({_VISIBLE}, '{_pattern}', ' ', '{_flag}')"
for _name, _value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _VISIBLE = f"replace({_VISIBLE}, '{_name}', '{_value}')"


@query(f"SELECT page_id, trim(regexp_replace({_VISIBLE}, '\\s+', ' ', 'g')) AS text FROM pages")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+'), ' ') AS tokens FROM documents")
def tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


@query("SELECT statement_id FROM statements WHERE length(trim(text)) >= 300")
def min_length(spark, d):
    return statements(spark, d).filter(F.length(F.trim("text")) >= 300).select("statement_id")


@query("""SELECT page_id, (contains(lower(html), '<nav>')::INT + contains(lower(html), 'class="ad"')::INT + contains(lower(html), '&copy;')::INT) >= 2 AND NOT regexp_matches(html, 'track\\([0-9]*7\\)') AS shell FROM pages""")
def shell_page(spark, d):
    return table(spark, d, "pages").select("page_id", quality.shell_page(F.col("html"), ["<nav>", 'class="AD"', "&copy;"], r"track\([0-9]*7\)").alias("shell"))


@query("SELECT doc_id, contains(lower(text), 'apache license') OR contains(lower(text), 'licensed under') OR contains(lower(text), 'public license') AS gated FROM documents")
def content_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", quality.content_gate(F.col("text"), ["Apache License", "licensed under", "Public License"]).alias("gated"))


# ---- records ---------------------------------------------------------------


def _enveloped(spark, d):
    s = statements(spark, d)
    member = F.struct(F.col("member_id").alias("id"), F.col("member_name").alias("name"), F.col("member_party").alias("party"), F.col("member_constituency").alias("constituency"), F.lit("MP").alias("role"))
    return s.select("statement_id", F.col("legislature").alias("parliament"), F.col("dtype").alias("data_type"), member.alias("member"), "date", text.strip(F.col("text")).alias("text"), F.lit("").alias("title"), F.create_map(F.lit("kind"), F.col("kind_order").cast("string"), F.lit("member"), F.col("member")).alias("metadata"))


@query("""SELECT statement_id, legislature AS parliament, dtype AS data_type, date, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, '' AS title, member_id, member_name, member_party, member_constituency,
  'MP' AS member_role, kind_order::VARCHAR AS metadata_kind, NULL::VARCHAR AS metadata_house FROM statements""")
def flatten_record(spark, d):
    from rollcall.sources.sinks import flatten_record as flatten

    return flatten(_enveloped(spark, d), ["kind", "house"])


@query("SELECT statement_id, legislature AS parliament, dtype AS data_type, member_name AS name, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))::INT AS n, member FROM statements")
def envelope(spark, d):
    e = _enveloped(spark, d)
    return e.select("statement_id", "parliament", "data_type", F.col("member.name").alias("name"), F.length("text").alias("n"), F.col("metadata")["member"].alias("member"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_id::VARCHAR AS event_id, event_type FROM events")
def json_unwrap(spark, d):
    """A day's events as one landed batch under ``items``, every second one wrapped in ``value``, and read back."""
    e = table(spark, d, "events")
    item = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("event_type", T.StringType())])
    own = F.struct(F.col("event_id").cast("string").alias("event_id"), "event_type")
    even = F.col("event_id") % 2 == 0
    one = F.struct(F.when(even, own).alias("value"), F.when(~even, own["event_id"]).alias("event_id"), F.when(~even, own["event_type"]).alias("event_type"))
    page = F.floor(F.col("event_id") / 50)
    landed = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), page).agg(F.to_json(F.struct(F.collect_list(one).alias("items"))).alias("batch"))
    return json_text_items(landed, "batch", item, ["day"])


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_id::VARCHAR AS event_id, event_type FROM events")
def first_list_unwrap(spark, d):
    """A day's events as landed batches, bare or under keys of any name, and read back."""
    e = table(spark, d, "events")
    item = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("event_type", T.StringType())])
    page = F.floor(F.col("event_id") / 50)
    rows = F.to_json(F.collect_list(F.struct(F.col("event_id").cast("string").alias("event_id"), "event_type")))
    bare = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), page.alias("page")).agg(rows.alias("rows"))
    kinds = F.when(F.col("page") % 3 == 0, F.col("rows")).when(F.col("page") % 3 == 1, F.concat(F.lit('{"Found": '), "rows", F.lit(', "n": 1}')))
    batch = kinds.otherwise(F.concat(F.lit('{"Answer": {"Row": '), "rows", F.lit("}}")))
    return first_list_items(bare.withColumn("batch", batch), "batch", item, ["day"])


@query("""SELECT event_id, try_cast(t AS DOUBLE) AS number, coalesce(trunc(try_cast(t AS DOUBLE))::BIGINT, 0) AS whole, round(try_cast(t AS DOUBLE), 1) AS rounded FROM (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id / 8.0::DOUBLE)::VARCHAR WHEN 1 THEN ' -' || event_id || ' ' WHEN 2 THEN event_type ELSE '' END AS t FROM events)""")
def tolerant_casts(spark, d):
    e = table(spark, d, "events")
    way = F.col("event_id") % 4
    text = F.when(way == 0, (F.col("event_id") / 8.0).cast("string")).when(way == 1, F.concat(F.lit(" -"), F.col("event_id").cast("string"), F.lit(" "))).when(way == 2, F.col("event_type")).otherwise("")
    t = e.select("event_id", text.alias("t"))
    return t.select("event_id", casts.number(F.col("t")).alias("number"), casts.whole(F.col("t")).alias("whole"), casts.rounded(F.col("t")).alias("rounded"))
