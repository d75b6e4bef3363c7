"""Spells of service, terms and turnout, over the orders' dates."""

from __future__ import annotations

from rollcall.operators import service
from rollcall.plans.catalog import query
from rollcall.plans.views import service_days, service_divisions, service_members
from rollcall.sources.scratch import written

GAP, MISSED, GRACE = 200, 30, 60

SPELLS = f"""
held AS (SELECT legislature, date, count(*) AS n FROM service_divisions GROUP BY 1, 2),
running AS (SELECT legislature, date, sum(n) OVER (PARTITION BY legislature ORDER BY date) - n AS before_,
  sum(n) OVER (PARTITION BY legislature ORDER BY date) AS through FROM held),
stepped AS (SELECT s.legislature, s.member_key, s.date, date_diff('day', lag(s.date::DATE) OVER w, s.date::DATE) AS gap,
  before_ - lag(through) OVER w AS missed FROM service_days s JOIN running USING (legislature, date)
  WINDOW w AS (PARTITION BY s.legislature, s.member_key ORDER BY s.date)),
spelled AS (SELECT *, 1 + sum(CASE WHEN gap > {GAP} AND missed >= {MISSED} THEN 1 ELSE 0 END) OVER (PARTITION BY legislature, member_key ORDER BY date) AS spell FROM stepped),
spells AS (SELECT legislature, member_key, spell::BIGINT AS spell, min(date) AS start, max(date) AS "end" FROM spelled GROUP BY 1, 2, 3),
current_spells AS (SELECT legislature, member_key, arg_max(start, spell) AS start, arg_max("end", spell) AS "end", count(*) AS spells FROM spells GROUP BY 1, 2),
months AS (SELECT legislature, substr(start, 1, 7) AS month, count(*) AS n, min(start) AS term_start FROM current_spells
  JOIN service_members USING (legislature, member_key) WHERE status = 'current' GROUP BY 1, 2),
terms AS (SELECT legislature, term_start FROM months QUALIFY row_number() OVER (PARTITION BY legislature ORDER BY n DESC, month) = 1),
last_ AS (SELECT legislature, max(date) AS last_division FROM service_divisions GROUP BY 1),
placed AS (SELECT m.legislature, m.member_key, coalesce(spells, 0) AS spells,
  CASE WHEN status = 'current' AND term_start IS NOT NULL AND (start IS NULL OR start < term_start OR abs(date_diff('day', start::DATE, term_start::DATE)) <= {GRACE})
    THEN term_start ELSE start END AS start, CASE WHEN status = 'current' THEN last_division ELSE "end" END AS "end"
  FROM service_members m LEFT JOIN current_spells USING (legislature, member_key) LEFT JOIN terms USING (legislature) LEFT JOIN last_ USING (legislature)),
windows_ AS (SELECT * FROM placed WHERE start IS NOT NULL),
eligible AS (SELECT w.legislature, w.member_key, w.start, w."end", w.spells, coalesce(sum(h.n), 0)::BIGINT AS eligible
  FROM windows_ w LEFT JOIN held h ON h.legislature = w.legislature AND h.date BETWEEN w.start AND w."end" GROUP BY ALL),
term_votes AS (SELECT w.legislature, w.member_key, coalesce(sum(s.n), 0)::BIGINT AS term_votes
  FROM windows_ w LEFT JOIN service_days s ON s.legislature = w.legislature AND s.member_key = w.member_key AND s.date BETWEEN w.start AND w."end" GROUP BY 1, 2)"""


def _inputs(spark, d):
    return service_days(spark, d), service_divisions(spark, d), service_members(spark, d)


def _spells(spark, d):
    days, divisions, _ = _inputs(spark, d)
    return service.service_spells(days, divisions, GAP, MISSED)


@query("SELECT * FROM spells", ctes=SPELLS)
def service_spells(spark, d):
    return _spells(spark, d)


@query("SELECT * FROM current_spells", ctes=SPELLS)
def current_spell(spark, d):
    return service.current_spell(_spells(spark, d))


@query("SELECT * FROM terms", ctes=SPELLS)
def term_start(spark, d):
    return service.term_start(_spells(spark, d), service_members(spark, d))


@query('SELECT legislature, member_key, start, "end", spells, eligible FROM eligible', ctes=SPELLS.replace("windows_ AS (SELECT * FROM placed WHERE start IS NOT NULL)", "windows_ AS (SELECT * FROM current_spells)"))
def divisions_eligible(spark, d):
    return service.divisions_eligible(service.current_spell(_spells(spark, d)), service_divisions(spark, d))


@query("""SELECT e.legislature, e.member_key, e.spells, e.start AS spell_start, t.term_votes, greatest(e.eligible, t.term_votes) AS eligible,
  CASE WHEN greatest(e.eligible, t.term_votes) <> 0 THEN round(100.0::DOUBLE * t.term_votes / greatest(e.eligible, t.term_votes), 1) END AS turnout_pct
  FROM eligible e JOIN term_votes t USING (legislature, member_key)""", ctes=SPELLS)
def turnout(spark, d):
    return service.turnout(*_inputs(spark, d), GAP, MISSED, GRACE, written)
