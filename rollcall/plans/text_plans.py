"""Lexicon analytics over documents and conversations, with a small lexicon of frequent words."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.operators import reports, topics
from rollcall.operators.topics import Term
from rollcall.plans.catalog import query
from rollcall.plans.views import statements, votes

LEXICON = [
    Term("the", "kw", "Pro-Alpha"), Term("That", "kw", "Pro-Alpha"), Term("of the", "pro", "Pro-Alpha"), Term("is", "pro", "Pro-Alpha"),
    Term("and the", "con", "Pro-Alpha"), Term("was", "con", "Pro-Alpha"), Term("la", "kw", "Beta"), Term("der", "kw", "Beta"),
    Term("that", "kw", "Beta"), Term("de la", "pro", "Beta"), Term("que", "con", "Beta"), Term("in the", "kw", "Beta"),
    Term("with", "tone", "", 1), Term("est", "tone", "", 1), Term("und", "tone", "", -1), Term("in", "tone", "", -1), Term("est", "tone", "", -1),
    Term("the anea eriner", "kw", "Gamma"), Term("and attion to", "con", "Gamma"), Term("the and attion to", "pro", "Gamma"),
    Term("Thanedble the, anea eriner", "kw", "Pro-Alpha"), Term("to thanedble the anea", "kw", "Gamma"), Term("the the the the", "tone", "", -1), Term("the the the", "kw", "Gamma"),
]
CUES = ("to", "of", "le", "die", "el")
MOTIONS = [Term("red", "pro", "Colour"), Term("blue", "con", "Colour"), Term("widget", "kw", "Goods"), Term("ring", "pro", "Goods"), Term("small", "con", "Goods")]


#: Tokens of the longest term.
LONGEST = max(len(t.term.split()) for t in LEXICON)


def _values(lexicon: list[Term]) -> str:
    return ", ".join(f"('{t.term}', '{t.kind}', '{t.topic}', {t.polarity})" for t in lexicon)


def grams_sql(at: str) -> str:
    """(k, pos, n, term) of all runs of up to LONGEST tokens in ``at`` (k, w, pos)."""
    return " UNION ALL ".join(f"SELECT k, pos, {n} AS n, array_to_string(w[pos + 1 : pos + {n}], ' ') AS term FROM {at} WHERE pos + {n} <= len(w)" for n in range(1, LONGEST + 1))


def hits_sql(p: str, lexicon: list[Term], source: str, key: str) -> str:
    """CTEs {p}hits (key, pos, n, term, neg) and {p}sides (key, topic, side) of the texts in ``source``."""
    cues = ", ".join(f"'{c}'" for c in CUES)
    return f"""
{p}lexicon(term, kind, topic, polarity) AS (VALUES {_values(lexicon)}),
{p}terms AS (SELECT array_to_string(regexp_extract_all(lower(term), '[a-z0-9'']+'), ' ') AS term, kind, topic, polarity FROM {p}lexicon),
{p}words AS (SELECT {key} AS k, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+') AS w FROM {source}),
{p}at AS (SELECT k, w, unnest(range(len(w))) AS pos FROM {p}words),
{p}found AS (SELECT k, pos, max(n) AS n FROM ({grams_sql(p + "at")})
  WHERE term IN (SELECT term FROM {p}terms) GROUP BY 1, 2),
{p}greedy AS (SELECT k, list_reduce(list_prepend({{'nxt': 0::BIGINT, 'hits': []::STRUCT(pos BIGINT, n INTEGER)[]}},
    list_transform(l, lambda x: {{'nxt': x.n::BIGINT, 'hits': [{{'pos': x.pos, 'n': x.n::INTEGER}}]::STRUCT(pos BIGINT, n INTEGER)[]}})),
    lambda a, x: CASE WHEN x.hits[1].pos >= a.nxt THEN {{'nxt': x.hits[1].pos + x.nxt, 'hits': list_concat(a.hits, x.hits)}} ELSE a END).hits AS hits
  FROM (SELECT k, list({{'pos': pos, 'n': n}} ORDER BY pos) AS l FROM {p}found GROUP BY 1)),
{p}hits AS (SELECT k, h.pos AS pos, h.n AS n, array_to_string(w[h.pos + 1 : h.pos + h.n], ' ') AS term,
    h.pos > 0 AND list_has_any(w[greatest(1, h.pos - 2) : h.pos], [{cues}]) AS neg
  FROM (SELECT k, unnest(hits) AS h FROM {p}greedy) JOIN {p}words USING (k)),
{p}sides AS (SELECT k, topic, CASE WHEN kind = 'kw' OR NOT neg THEN kind WHEN kind = 'pro' THEN 'con' ELSE 'pro' END AS side
  FROM {p}hits JOIN (SELECT DISTINCT term, kind, topic FROM {p}terms WHERE kind <> 'tone') USING (term)),
{p}tones AS (SELECT k, CASE WHEN neg THEN -t ELSE t END AS v FROM {p}hits JOIN (SELECT term, min(polarity) AS t FROM {p}terms WHERE kind = 'tone' GROUP BY 1) USING (term))"""


HITS = hits_sql("s_", LEXICON, "statements", "statement_id")
_MENTIONS = f"""
kw AS (SELECT lower(trim(term)) AS term, regexp_replace(topic, '^Pro-', '') AS topic FROM s_lexicon WHERE kind = 'kw'),
mentions AS (SELECT DISTINCT k, topic FROM (SELECT k, pos, arg_max(term, n) AS term FROM (
  {grams_sql("s_at")})
  WHERE term IN (SELECT term FROM kw) GROUP BY 1, 2) JOIN kw USING (term)),
spoken AS (SELECT member, count(*) AS spoken, count_if(dtype = 'question') AS n_questions, count_if(dtype = 'speech') AS n_speeches FROM statements GROUP BY 1),
salience AS (SELECT member, topic, count(*) AS statements, round(100.0::DOUBLE * count(*) / any_value(spoken), 1) AS share_pct
  FROM mentions JOIN statements ON k = statement_id JOIN spoken USING (member) GROUP BY 1, 2)"""
SALIENCE = f"{HITS},{_MENTIONS}"
_M = hits_sql("m_", MOTIONS, "(SELECT DISTINCT motion, motion AS text FROM votes)", "motion")
_STANCE = "CASE WHEN {0} + {1} <> 0 THEN round(({0} - {1})::DOUBLE / ({0} + {1} + 4), 3) ELSE 0.0::DOUBLE END"
LEANS = f"""{_M},
leans AS (SELECT k AS motion, topic, sign(count_if(side = 'pro') - count_if(side = 'con'))::INT AS lean FROM m_sides GROUP BY 1, 2),
vote_stance AS (SELECT member, topic, count_if(lean * (CASE direction WHEN 'aye' THEN 1 ELSE -1 END) > 0) AS vote_pro, count_if(lean * (CASE direction WHEN 'aye' THEN 1 ELSE -1 END) < 0) AS vote_con
  FROM cast_ JOIN leans USING (motion) WHERE lean <> 0 GROUP BY 1, 2)"""

#: Statements of the people who also vote: member F:k or O:k, with one lexicon for both.
BOTH = MOTIONS + [t for t in LEXICON if t.kind != "kw" or t.topic == "Beta"]
_B = hits_sql("b_", BOTH, "owned", "statement_id")
_BM = hits_sql("bm_", BOTH, "(SELECT DISTINCT motion, motion AS text FROM votes)", "motion")
SCORES = f"""
owned AS (SELECT statement_id, legislature || ':' || substr(member, 2) AS member, dtype, text FROM statements), {_B}, {_BM},
spoken_side AS (SELECT member, topic, count_if(side = 'kw') AS mentions, count_if(side = 'pro') AS spoken_pro, count_if(side = 'con') AS spoken_con
  FROM b_sides JOIN owned ON k = statement_id GROUP BY 1, 2),
b_leans AS (SELECT k AS motion, topic, sign(count_if(side = 'pro') - count_if(side = 'con'))::INT AS lean FROM bm_sides GROUP BY 1, 2),
vote_side AS (SELECT member, topic, count_if(lean * (CASE direction WHEN 'aye' THEN 1 ELSE -1 END) > 0) AS vote_pro, count_if(lean * (CASE direction WHEN 'aye' THEN 1 ELSE -1 END) < 0) AS vote_con
  FROM cast_ JOIN b_leans USING (motion) WHERE lean <> 0 GROUP BY 1, 2),
sided AS (SELECT coalesce(s.member, v.member) AS member, coalesce(s.topic, v.topic) AS topic, coalesce(mentions, 0) AS mentions, coalesce(spoken_pro, 0) AS spoken_pro, coalesce(spoken_con, 0) AS spoken_con,
  coalesce(vote_pro, 0) AS vote_pro, coalesce(vote_con, 0) AS vote_con FROM spoken_side s FULL JOIN vote_side v ON s.member = v.member AND s.topic = v.topic),
stanced AS (SELECT *, {_STANCE.format('spoken_pro', 'spoken_con')} AS spoken_stance, {_STANCE.format('vote_pro', 'vote_con')} AS vote_stance FROM sided),
scores AS (SELECT *, CASE WHEN spoken_pro + spoken_con > 0 AND vote_pro + vote_con > 0 THEN round((spoken_stance + 2.0 * vote_stance) / 3.0, 3)
  WHEN spoken_pro + spoken_con > 0 THEN spoken_stance WHEN vote_pro + vote_con > 0 THEN round(2.0 * vote_stance / 2.0, 3) ELSE 0.0 END AS combined_stance
  FROM stanced WHERE mentions > 0 OR spoken_pro + spoken_con > 0 OR vote_pro + vote_con > 0),
said AS (SELECT member, count_if(dtype = 'question') AS n_questions, count_if(dtype = 'speech') AS n_speeches FROM owned GROUP BY 1),
cast_n AS (SELECT member, count(*) AS n_votes FROM cast_ WHERE motion <> '' GROUP BY 1),
activity AS (SELECT coalesce(s.member, c.member) AS member, coalesce(n_questions, 0) AS n_questions, coalesce(n_speeches, 0) AS n_speeches, coalesce(n_votes, 0) AS n_votes,
  coalesce(n_questions, 0) + coalesce(n_speeches, 0) + coalesce(n_votes, 0) AS activity_total FROM said s FULL JOIN cast_n c ON s.member = c.member),
toned AS (SELECT member, count_if(v > 0) AS tone_pos, count_if(v < 0) AS tone_neg FROM b_tones JOIN owned ON k = statement_id WHERE v <> 0 GROUP BY 1)"""


@query("""SELECT term, list_sort(list(DISTINCT topic) FILTER (kind = 'kw')) AS kw_list, coalesce(min(polarity) FILTER (kind = 'tone'), 0) AS tone, count_if(term IN (SELECT term FROM s_hits)) > 0 AS seen FROM s_terms GROUP BY 1""".replace("list_sort(list(DISTINCT topic) FILTER (kind = 'kw')) AS kw_list", "coalesce(string_agg(DISTINCT topic, ',' ORDER BY topic) FILTER (kind = 'kw'), '') AS kw"), ctes=HITS)
def lexicon_index(spark, d):
    """The index of the lexicon, with whether each term occurs in the statements."""
    index = topics.lexicon_index(topics.lexicon_frame(spark, LEXICON))
    seen = topics.lexicon_hits(statements(spark, d), LEXICON).select("term").distinct().withColumn("seen", F.lit(True))
    return index.join(seen, "term", "left").select("term", F.array_join("kw", ",").alias("kw"), "tone", F.coalesce("seen", F.lit(False)).alias("seen"))


@query("SELECT k AS statement_id, pos::INT AS pos, n, term FROM s_hits", ctes=HITS)
def lexicon_hits(spark, d):
    return topics.lexicon_hits(statements(spark, d).select("statement_id", "text"), LEXICON).select("statement_id", "pos", "n", "term")


@query("SELECT k AS statement_id, pos::INT AS pos, neg FROM s_hits", ctes=HITS)
def negation_flip(spark, d):
    return topics.lexicon_hits(statements(spark, d).select("statement_id", "text"), LEXICON, cues=CUES).select("statement_id", "pos", "neg")


@query("SELECT k AS statement_id, topic, count_if(side = 'kw') AS mentions, count_if(side = 'pro') AS pro, count_if(side = 'con') AS con FROM s_sides GROUP BY 1, 2", ctes=HITS)
def topic_hits(spark, d):
    return topics.topic_hits(statements(spark, d), LEXICON, ["statement_id"], CUES)


@query("SELECT member, count_if(v > 0) AS tone_pos, count_if(v < 0) AS tone_neg FROM s_tones JOIN statements ON k = statement_id WHERE v <> 0 GROUP BY 1", ctes=HITS)
def tone(spark, d):
    return topics.tone(statements(spark, d), LEXICON, ["member"], CUES)


@query("SELECT k AS statement_id, topic FROM mentions", ctes=SALIENCE)
def topic_mentions(spark, d):
    return topics.topic_mentions(statements(spark, d), LEXICON)


@query("SELECT * FROM salience", ctes=SALIENCE)
def salience(spark, d):
    return topics.salience(statements(spark, d), LEXICON)


@query("SELECT * FROM leans", ctes=LEANS)
def motion_stance(spark, d):
    return topics.motion_stance(votes(spark, d), MOTIONS, CUES)


@query("SELECT * FROM vote_stance", ctes=LEANS)
def vote_stance(spark, d):
    return topics.vote_stance(votes(spark, d), MOTIONS, CUES)


def _owned(spark, d):
    member = F.concat("legislature", F.lit(":"), F.substring("member", 2, 20))
    return statements(spark, d).withColumn("member", member)


@query("SELECT * FROM scores", ctes=SCORES)
def member_topic_scores(spark, d):
    return topics.member_topic_scores(_owned(spark, d), votes(spark, d), BOTH, CUES)


@query("SELECT * FROM activity", ctes=SCORES)
def activity(spark, d):
    return reports.activity(_owned(spark, d), votes(spark, d))


@query(f"""SELECT a.*, coalesce(topics_engaged, 0) AS topics_engaged, coalesce(top_pro, '') AS top_pro, coalesce(top_con, '') AS top_con,
  {_STANCE.format('coalesce(tone_pos, 0)', 'coalesce(tone_neg, 0)')} AS tone_score
  FROM activity a LEFT JOIN (SELECT member, count_if(combined_stance <> 0) AS topics_engaged,
    arg_min(topic, {{'s': -combined_stance, 't': topic}}) FILTER (combined_stance > 0 AND spoken_pro + spoken_con + vote_pro + vote_con >= 3) AS top_pro,
    arg_min(topic, {{'s': combined_stance, 't': topic}}) FILTER (combined_stance < 0 AND spoken_pro + spoken_con + vote_pro + vote_con >= 3) AS top_con FROM scores GROUP BY 1) USING (member)
  LEFT JOIN toned USING (member)""", ctes=SCORES)
def member_grades(spark, d):
    s, cast = _owned(spark, d), votes(spark, d)
    scores = topics.member_topic_scores(s, cast, BOTH, CUES)
    return topics.member_grades(scores, reports.activity(s, cast), topics.tone(s, BOTH, ["member"], CUES))
