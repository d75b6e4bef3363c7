"""Reports over votes, service and statements: member record, benchmarks, payload, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions import casts
from rollcall.operators import reports, topics
from rollcall.operators import votes as v
from rollcall.plans.catalog import query
from rollcall.plans.division_plans import LINES, POINTS, points_of
from rollcall.plans.text_plans import LEXICON, SALIENCE
from rollcall.plans.views import members, statements, votes
from rollcall.sources import readers, sinks
from rollcall.sources.scratch import Scratch, folder

GAP, MISSED, GRACE = 100, 20, 60

#: Who spoke, as members who vote: m7 speaks for F:7 and O:7.
RECORD = f"""{LINES}, {SALIENCE},
day_n AS (SELECT legislature, member_key, date, count(*) AS n FROM cast_ GROUP BY 1, 2, 3),
div_dates AS (SELECT legislature, date, count(*) AS n FROM division_meta GROUP BY 1, 2),
asked AS (SELECT legislature, date, sum(n) AS n FROM (SELECT legislature, date, n FROM div_dates UNION ALL SELECT DISTINCT legislature, date, 0 FROM day_n) GROUP BY 1, 2),
run_ AS (SELECT legislature, date, sum(n) OVER w - n AS before_, sum(n) OVER w AS through FROM asked WINDOW w AS (PARTITION BY legislature ORDER BY date)),
stepped AS (SELECT legislature, member_key, date, date_diff('day', lag(date::DATE) OVER w, date::DATE) AS gap, before_ - lag(through) OVER w AS missed FROM day_n JOIN run_ USING (legislature, date)
  WINDOW w AS (PARTITION BY legislature, member_key ORDER BY date)),
spelled AS (SELECT *, sum(CASE WHEN gap > {GAP} AND missed >= {MISSED} THEN 1 ELSE 0 END) OVER (PARTITION BY legislature, member_key ORDER BY date) AS spell FROM stepped),
spells AS (SELECT legislature, member_key, spell, min(date) AS start, max(date) AS stop FROM spelled GROUP BY 1, 2, 3),
cur AS (SELECT legislature, member_key, arg_max(start, spell) AS start, arg_max(stop, spell) AS stop, count(*) AS spells FROM spells GROUP BY 1, 2),
months AS (SELECT legislature, substr(start, 1, 7) AS month, count(*) AS n, min(start) AS term_start FROM cur JOIN members USING (legislature, member_key) WHERE status = 'current' GROUP BY 1, 2),
terms AS (SELECT legislature, term_start FROM months QUALIFY row_number() OVER (PARTITION BY legislature ORDER BY n DESC, month) = 1),
ends AS (SELECT legislature, max(date) AS last_division FROM division_meta GROUP BY 1),
placed AS (SELECT m.legislature, m.member_key, coalesce(spells, 0) AS spells, CASE WHEN status = 'current' AND term_start IS NOT NULL AND (start IS NULL OR start < term_start
    OR abs(date_diff('day', start::DATE, term_start::DATE)) <= {GRACE}) THEN term_start ELSE start END AS start, CASE WHEN status = 'current' THEN last_division ELSE stop END AS stop
  FROM members m LEFT JOIN cur USING (legislature, member_key) LEFT JOIN terms USING (legislature) LEFT JOIN ends USING (legislature)),
turn AS (SELECT p.legislature, p.member_key, p.spells, p.start, (SELECT coalesce(sum(n), 0) FROM day_n t WHERE t.legislature = p.legislature AND t.member_key = p.member_key AND t.date BETWEEN p.start AND p.stop)::BIGINT AS term_votes,
  (SELECT coalesce(sum(n), 0) FROM div_dates h WHERE h.legislature = p.legislature AND h.date BETWEEN p.start AND p.stop)::BIGINT AS held FROM placed p WHERE p.start IS NOT NULL),
turned AS (SELECT legislature, member_key, spells, start, term_votes, greatest(held, term_votes) AS eligible FROM turn),
ranked AS (SELECT member, topic, share_pct, row_number() OVER (PARTITION BY member ORDER BY statements DESC, topic) AS r FROM salience),
tops AS (SELECT member, max(topic) FILTER (r = 1) AS t1, max(topic) FILTER (r = 2) AS t2, max(topic) FILTER (r = 3) AS t3, max(share_pct) FILTER (r = 1) AS s1 FROM ranked GROUP BY 1),
record AS (SELECT m.legislature, m.member_key, m.name AS member, m.party, m.constituency, m.status, coalesce(votes_cast, 0) AS votes_cast, coalesce(u.spells, 0) AS spells_served, coalesce(u.start, '') AS current_spell_from,
  coalesce(term_votes, 0) AS term_votes, coalesce(eligible, 0) AS divisions_eligible, CASE WHEN eligible <> 0 THEN round(100.0::DOUBLE * term_votes / eligible, 1) END AS turnout_pct, coalesce(no_vote_recorded, 0) AS no_vote_recorded,
  CASE WHEN party_line_divisions <> 0 THEN round(100.0::DOUBLE * with_party / party_line_divisions, 1) END AS party_agreement_pct, coalesce(party_line_divisions, 0) AS party_line_divisions,
  CASE WHEN chamber_decided_divisions <> 0 THEN round(100.0::DOUBLE * with_chamber / chamber_decided_divisions, 1) END AS chamber_agreement_pct, coalesce(chamber_decided_divisions, 0) AS chamber_decided_divisions,
  coalesce(v.rebellions, 0) AS rebellions, CASE WHEN party_line_divisions <> 0 THEN round(100.0::DOUBLE * v.rebellions / party_line_divisions, 1) END AS rebellion_rate_pct,
  coalesce(n_questions, 0) AS n_questions, coalesce(n_speeches, 0) AS n_speeches, coalesce(t1, '') AS top_topic_1, coalesce(t2, '') AS top_topic_2, coalesce(t3, '') AS top_topic_3, s1 AS top_topic_1_share_pct
  FROM members m LEFT JOIN member_votes v USING (legislature, member_key) LEFT JOIN turned u USING (legislature, member_key)
  LEFT JOIN spoken s ON s.member = 'm' || split_part(m.member_key, ':', 2) LEFT JOIN tops t ON t.member = 'm' || split_part(m.member_key, ':', 2)),
bench AS (SELECT legislature, count(*) AS members, round(median(turnout_pct), 1) AS median_turnout_pct, round(median(party_agreement_pct), 1) AS median_party_agreement_pct,
  round(median(chamber_agreement_pct), 1) AS median_chamber_agreement_pct, round(median(rebellion_rate_pct), 1) AS median_rebellion_rate_pct, round(median(rebellions), 1) AS median_rebellions,
  count_if(rebellions > 0) AS ever_rebelled FROM record GROUP BY 1),
slips AS (SELECT *, row_number() OVER (PARTITION BY legislature, member_key ORDER BY date DESC, seq DESC) AS shown FROM (
  SELECT *, count(*) OVER (PARTITION BY legislature, member_key) AS all_ FROM rebellions QUALIFY row_number() OVER (PARTITION BY legislature, member_key ORDER BY date, seq) <= 40))"""


def _spoken_keys(df):
    """``m7`` to the member keys F:7 and O:7."""
    return df.withColumn("house", F.explode(F.array(F.lit("F"), F.lit("O")))).withColumn("member", F.concat("house", F.lit(":"), F.substring("member", 2, 20))).drop("house")


def _salience(spark, d):
    return _spoken_keys(topics.salience(statements(spark, d), LEXICON))


VOTE_COLUMNS = ("legislature", "member_key", "party", "division", "date", "direction", "seq")


def _reported(spark, build):
    """The report that ``build`` makes, written; what its branches share on the way is deleted again."""
    with Scratch(spark) as scratch:
        return scratch.keep(build(scratch), "report")


def _cast(spark, d, scratch, *more):
    """Votes joined to their members and divisions once, in the columns that reports read, and ``more``.

    rank is the number that seq begins with: -1 for a negative one, whose sign sorts before digits, and the largest without seq.
    """
    odd = F.when(F.col("seq").isNull(), F.lit(2**63 - 1)).otherwise(F.lit(-1))
    return scratch.cut(votes(spark, d).select(*VOTE_COLUMNS, *more, F.coalesce(F.substring("seq", 1, 12).try_cast("long"), odd).alias("rank")), "votes")


def _record(spark, d, scratch, cast=None, salience=None, points=None, lines=None):
    s = statements(spark, d)
    spoken = s.groupBy("member").agg(F.count_if(F.col("dtype") == "question").alias("n_questions"), F.count_if(F.col("dtype") == "speech").alias("n_speeches"))
    spoken = _spoken_keys(spoken).withColumnRenamed("member", "member_key")
    cast, salience = cast or _cast(spark, d, scratch), salience or _salience(spark, d)
    return reports.member_record(members(spark, d), cast, spoken, salience, points, GAP, MISSED, GRACE, scratch.cut, lines, "rank")


@query("SELECT r.*, round(dim1, 3) + 0.0 AS ideal_dim1, round(dim2, 3) + 0.0 AS ideal_dim2 FROM record r LEFT JOIN points USING (legislature, member_key)", ctes=f"{RECORD}, {POINTS}")
def member_record(spark, d):
    def build(scratch):
        cast = _cast(spark, d, scratch)
        return _record(spark, d, scratch, cast, points=points_of(spark, d, cast)[0])

    return _reported(spark, build)


@query("SELECT * FROM bench", ctes=RECORD)
def benchmarks(spark, d):
    return _reported(spark, lambda scratch: reports.benchmarks(_record(spark, d, scratch)))


@query("SELECT member, coalesce(t1, '') AS top_topic_1, coalesce(t2, '') AS top_topic_2, coalesce(t3, '') AS top_topic_3, s1 AS top_topic_1_share_pct FROM tops", ctes=RECORD)
def top_topics(spark, d):
    return reports.top_topics(topics.salience(statements(spark, d), LEXICON))


@query("SELECT member, topic, (row_number() OVER w)::INT AS place, greatest(2.0, round(100.0::DOUBLE * statements / max(statements) OVER (PARTITION BY member), 1)) AS width FROM salience WINDOW w AS (PARTITION BY member ORDER BY statements DESC, topic) QUALIFY place <= 5", ctes=RECORD)
def topic_bars(spark, d):
    return reports.topic_bars(topics.salience(statements(spark, d), LEXICON))


@query("SELECT legislature, member_key, shown::INT AS shown, date, substr(title, 1, 180) AS division, their_vote, party_voted, shown <= 3 AS preview, greatest(all_ - 3, 0) AS more FROM slips", ctes=RECORD)
def receipts(spark, d):
    return reports.receipts(v.rebellions(votes(spark, d)))


def _payload(spark, d):
    def build(scratch):
        cast, salience = _cast(spark, d, scratch, "title"), scratch.cut(_salience(spark, d), "salience")
        lines = v.lines(cast, keep=scratch.cut)
        return reports.app_payload(_record(spark, d, scratch, cast, salience, lines=lines), salience, v.rebellions(cast, known=lines))

    return _reported(spark, build)


@query("""SELECT r.legislature, r.member_key, r.member, r.votes_cast, r.rebellions, coalesce((SELECT string_agg(topic || '=' || statements, ';' ORDER BY statements DESC, topic) FROM salience s
    WHERE s.member = 'm' || split_part(r.member_key, ':', 2)), '') AS topics,
  coalesce((SELECT string_agg(date || ' ' || substr(title, 1, 180) || ' ' || their_vote || ' ' || party_voted, ';' ORDER BY shown) FROM slips p WHERE p.legislature = r.legislature AND p.member_key = r.member_key), '') AS receipts
  FROM record r WHERE constituency <> '' AND status = 'current'""", ctes=RECORD)
def app_payload(spark, d):
    """The nested payload, its arrays written out as text so that both engines show them alike."""
    p = _payload(spark, d)
    shown = F.transform("topics", lambda t: F.concat(t["topic"], F.lit("="), t["n"].cast("string")))
    slips = F.transform("receipts", lambda r: F.concat_ws(" ", r["date"], r["division"], r["their_vote"], r["party_voted"]))
    return p.select("legislature", "member_key", "member", "votes_cast", "rebellions", F.coalesce(F.array_join(shown, ";"), F.lit("")).alias("topics"), F.coalesce(F.array_join(slips, ";"), F.lit("")).alias("receipts"))


@query("""SELECT DISTINCT r.legislature, s.topic FROM record r JOIN salience s ON s.member = 'm' || split_part(r.member_key, ':', 2) WHERE constituency <> '' AND status = 'current'""", ctes=RECORD)
def payload_topics(spark, d):
    return reports.payload_topics(_payload(spark, d))


@query("""SELECT legislature, area, min(p) AS priority FROM (SELECT legislature, constituency AS area, CASE WHEN contains(lower(constituency), '_1') THEN 0 WHEN contains(lower(name), '_1') THEN 1 END AS p FROM members) WHERE p IS NOT NULL
  GROUP BY 1, 2 ORDER BY 3, 2, 1 LIMIT 40""")
def area_search(spark, d):
    return reports.area_search(members(spark, d).withColumnRenamed("name", "member"), "_1")


@query("""SELECT r.legislature, constituency AS area, row_number() OVER (PARTITION BY r.legislature, constituency ORDER BY votes_cast DESC, member, member_key)::INT AS place, member, votes_cast,
  greatest(0.0, least(100.0, turnout_pct)) AS turnout_pct, greatest(0.0, least(100.0, median_turnout_pct)) AS median_pct FROM record r JOIN bench USING (legislature) WHERE constituency <> ''""", ctes=RECORD)
def area_members(spark, d):
    def build(scratch):
        record = scratch.cut(_record(spark, d, scratch), "record")
        return reports.area_members(record, reports.benchmarks(record))

    return _reported(spark, build)


@query("SELECT member, topic, statements, share_pct FROM salience", ctes=RECORD)
def report_scan(spark, d):
    """The salience report as sorted CSV, read back and cast."""
    path = folder(spark, "report")
    sinks.write_csv_report(topics.salience(statements(spark, d), LEXICON).select("member", "topic", "statements", "share_pct"), path, reports.report_order("salience"))
    back = readers.csv_report(spark, path, ["member", "topic", "statements", "share_pct"])
    return back.select("member", "topic", casts.whole(F.col("statements")).alias("statements"), casts.rounded(F.col("share_pct")).alias("share_pct"))


WHOLE = ("votes_cast", "spells_served", "term_votes", "divisions_eligible", "no_vote_recorded", "party_line_divisions", "chamber_decided_divisions", "rebellions", "n_questions", "n_speeches", "statements")
DECIMAL = ("turnout_pct", "party_agreement_pct", "chamber_agreement_pct", "rebellion_rate_pct", "ideal_dim1", "ideal_dim2", "top_topic_1_share_pct", "share_pct")


def _through_csv(scratch, report, name, order):
    """A report written as CSV and read back; its numbers are texts until they are cast."""
    path = scratch.path(name)
    sinks.write_csv_report(report, path, order)
    back = readers.csv_report(scratch.spark, path, report.columns)
    cast = {c: casts.whole(F.col(c)) for c in report.columns if c in WHOLE} | {c: casts.number(F.col(c)) for c in report.columns if c in DECIMAL}
    return back.withColumns(cast)


_JSON_MEMBER = """json_object('name', r.member, 'party', party, 'area', constituency, 'parliament', r.legislature, 'votesCast', votes_cast, 'termVotes', term_votes, 'eligible', divisions_eligible, 'turnout', turnout_pct, 'spells', spells_served,
    'spellFrom', current_spell_from, 'partyAgreement', party_agreement_pct, 'partyLineDivisions', party_line_divisions, 'chamberAgreement', chamber_agreement_pct, 'rebellions', r.rebellions, 'rebellionRate', rebellion_rate_pct,
    'dim1', round(dim1, 3) + 0.0, 'dim2', round(dim2, 3) + 0.0, 'questions', n_questions, 'speeches', n_speeches,
    'topics', coalesce((SELECT list({'topic': topic, 'n': statements, 'share': share_pct} ORDER BY statements DESC, topic)[:8] FROM salience s WHERE s.member = 'm' || split_part(r.member_key, ':', 2)), []),
    'receipts', coalesce((SELECT list({'date': date, 'division': substr(title, 1, 180), 'their_vote': their_vote, 'party_voted': party_voted} ORDER BY shown) FROM slips p WHERE p.legislature = r.legislature AND p.member_key = r.member_key), []))"""


@query(f"""SELECT r.legislature, constituency AS area, r.member, r.member_key, {_JSON_MEMBER}::VARCHAR AS json FROM record r LEFT JOIN points p ON p.legislature = r.legislature AND p.member_key = r.member_key WHERE constituency <> '' AND status = 'current'
  UNION ALL SELECT b.legislature, '', '', '', json_object('topics', coalesce((SELECT list(DISTINCT topic ORDER BY topic) FROM record t JOIN salience s ON s.member = 'm' || split_part(t.member_key, ':', 2)
      WHERE t.legislature = b.legislature AND constituency <> '' AND status = 'current'), []), 'benchmarks', json_object('members', members, 'turnout', median_turnout_pct, 'partyAgreement', median_party_agreement_pct,
      'chamberAgreement', median_chamber_agreement_pct, 'rebellionRate', median_rebellion_rate_pct, 'rebellions', median_rebellions, 'everRebelled', ever_rebelled))::VARCHAR FROM placed_bench b""", ctes=f"""{RECORD}, {POINTS},
placed_bench AS (SELECT legislature, count(*) AS members, round(median(turnout_pct), 1) AS median_turnout_pct, round(median(party_agreement_pct), 1) AS median_party_agreement_pct,
  round(median(chamber_agreement_pct), 1) AS median_chamber_agreement_pct, round(median(rebellion_rate_pct), 1) AS median_rebellion_rate_pct, round(median(rebellions), 1) AS median_rebellions,
  count_if(rebellions > 0) AS ever_rebelled FROM record WHERE constituency <> '' AND status = 'current' GROUP BY 1)""")
def payload_export(spark, d):
    """The nested export, from the three reports as they are read back from CSV."""

    def build(scratch):
        cast, order = _cast(spark, d, scratch, "title"), reports.report_order
        lines = v.lines(cast, keep=scratch.cut)
        salience = _through_csv(scratch, _salience(spark, d).select("member", "topic", "statements", "share_pct"), "salience", order("salience"))
        record = _through_csv(scratch, _record(spark, d, scratch, cast, salience, points_of(spark, d, cast)[0], lines), "record", order("record"))
        slips = _through_csv(scratch, v.rebellions(cast, known=lines).select("legislature", "member_key", "date", "title", "their_vote", "party_voted", "seq"), "rebellions", order("rebellions"))
        payload = reports.app_payload(record, salience, slips)
        lines = scratch.cut(reports.payload_lines(payload, reports.benchmarks(reports.current_members(record).filter("constituency <> ''"))), "lines")
        sinks.write_payload(lines, scratch.path("payload"))
        return lines

    return _reported(spark, build)


@query("SELECT legislature, constituency AS area, 0 AS priority FROM members WHERE constituency <> '' GROUP BY 1, 2 ORDER BY 2, 1 LIMIT 14")
def area_list(spark, d):
    """The first areas, where no text is searched for."""
    return reports.area_search(members(spark, d).withColumnRenamed("name", "member"), " ")


@query("SELECT DISTINCT legislature, constituency AS area FROM members WHERE status = 'current' AND constituency <> ''")
def payload_areas(spark, d):
    return reports.payload_areas(reports.current_members(members(spark, d)))


UNSURE = "seats AS (SELECT member_key, CASE WHEN hash_ % 3 = 0 THEN '' ELSE status END AS status FROM (SELECT *, length(member_key) + length(name) AS hash_ FROM members))"


@query("SELECT member_key FROM seats WHERE status IN ('current', '')", ctes=UNSURE)
def current_or_blank(spark, d):
    """Members in office or without a status, where some statuses are blank."""
    blank = (F.length("member_key") + F.length("name")) % 3 == 0
    seats = members(spark, d).select("member_key", F.when(blank, "").otherwise(F.col("status")).alias("status"))
    return reports.current_members(seats, blank_passes=True).select("member_key")
