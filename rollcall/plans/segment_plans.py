"""Lines, carried speakers, segments, register entries, unpivoted lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.operators import segments
from rollcall.plans.catalog import query
from rollcall.plans.views import table, votes
from rollcall.sources import normalise

LINES = r"""
lines AS (SELECT doc_id, i - 1 AS line_no, regexp_replace(parts[i], '^\s+|\s+$', '', 'g') AS line FROM (
  SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\x0b\f\r\x{85}\x{2028}\x{2029}]') AS parts FROM documents))
  WHERE line <> '')"""


def _lines(spark, d):
    return segments.doc_lines(table(spark, d, "documents"), "doc_id")


@query("SELECT doc_id, line_no::INT AS line_no, line FROM lines", ctes=LINES)
def doc_lines(spark, d):
    return _lines(spark, d)


@query("""SELECT conv_id, turn, coalesce(nullif(name, ''), last_value(nullif(name, '') IGNORE NULLS) OVER (PARTITION BY conv_id, part ORDER BY turn), '') AS carried FROM (
  SELECT *, coalesce(sum((turn % 4 = 3)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM (
  SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN '' ELSE role || turn END AS name FROM conversations))""")
def carry_speaker(spark, d):
    name = F.when(F.col("turn") % 3 == 1, "").otherwise(F.concat("role", F.col("turn").cast("string")))
    c = table(spark, d, "conversations").select("conv_id", "turn", name.alias("name"))
    return segments.carry_speaker(c, "conv_id", "turn", "name", F.col("turn") % 4 == 3).select("conv_id", "turn", "carried")


@query("""SELECT doc_id, segment, max(speaker) AS speaker, string_agg(line, ' ' ORDER BY line_no) AS text FROM (
  SELECT *, sum((speaker IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS segment FROM (
  SELECT *, CASE WHEN length(line) % 3 = 0 THEN nullif(regexp_extract(line, '^([A-Z][a-z]+) ', 1), '') END AS speaker FROM lines)) WHERE segment > 0 GROUP BY 1, 2
  HAVING length(string_agg(line, ' ' ORDER BY line_no)) >= 10""", ctes=LINES)
def speech_segments(spark, d):
    speaker = F.when(F.length("line") % 3 == 0, F.regexp_extract("line", "^([A-Z][a-z]+) ", 1)).otherwise("")
    return segments.speech_segments(_lines(spark, d), "doc_id", speaker)


@query("""SELECT doc_id, entry::BIGINT AS entry, max(owner) AS owner, max(category) AS category, string_agg(line, ' ' ORDER BY line_no) AS text FROM (
  SELECT *, last_value(own IGNORE NULLS) OVER w AS owner, last_value(cat IGNORE NULLS) OVER w AS category, sum(opens::INT) OVER w AS entry FROM (
  SELECT *, (own IS NOT NULL AND own IS DISTINCT FROM previous) OR cat IS NOT NULL AS opens FROM (
  SELECT *, CASE WHEN own IS NULL AND length(line) % 3 = 0 THEN substr(line, 1, 4) END AS cat,
    last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM (
  SELECT *, CASE WHEN after_ THEN line WHEN length(line) % 5 = 0 THEN substr(line, 1, 6) END AS own FROM (
  SELECT *, coalesce(lag(label) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS after_ FROM (
  SELECT *, length(line) % 11 = 0 AS label FROM lines WHERE NOT regexp_matches(line, '^[A-Z]+$'))) WHERE NOT label)))
  WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) WHERE own IS NULL AND cat IS NULL AND owner IS NOT NULL GROUP BY 1, 2
  HAVING length(string_agg(line, ' ' ORDER BY line_no)) >= 5""", ctes=LINES)
def register_entries(spark, d):
    size = F.length("line")
    owner = F.when(size % 11 == 0, F.lit("Name:")).when(size % 5 == 0, F.regexp_replace(F.substring("line", 1, 6), ":$", ";"))
    category = F.when(size % 3 == 0, F.substring("line", 1, 4))
    return segments.register_entries(_lines(spark, d), "doc_id", owner, category, F.col("line").rlike("^[A-Z]+$"))


QA = """pairs AS (SELECT q.conv_id, q.turn, q.text AS question, coalesce(a.text, '') AS answer FROM conversations q
  LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user')"""


@query("""SELECT conv_id, turn, 'question' AS qa_role, trim(question) AS text FROM pairs WHERE length(trim(question)) >= 10
  UNION ALL SELECT conv_id, turn, 'answer', trim(answer) FROM pairs WHERE length(trim(answer)) >= 10""", ctes=QA)
def qa_unpivot(spark, d):
    c = table(spark, d, "conversations")
    q, a = c.filter("role = 'user'"), c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = q.join(a, ["conv_id", "turn"], "left").select("conv_id", "turn", F.col("text").alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))
    return normalise.question_and_answer(pairs, ["conv_id", "turn"])


@query("SELECT legislature, division, member_id, seq, direction FROM votes")
def vote_lists_unpivot(spark, d):
    """Votes gathered into the landed shape (three lists a division and day) and taken apart again."""
    one = F.struct("member_id", "seq")

    def listed(direction: str):
        return F.collect_list(F.when(F.col("direction") == direction, one))

    landed = votes(spark, d).groupBy("legislature", "division", "date").agg(listed("aye").alias("ayes"), listed("no").alias("noes"), listed("no_vote").alias("no_vote_recorded"))
    return normalise.vote_lists(landed, ["legislature", "division"], ["member_id", "seq"])


MEETINGS = """SELECT id, arg_max(date, event_id) AS date, bool_or(has_votes) AS has_votes FROM (
  SELECT event_id, user_id::VARCHAR AS id, strftime(ts, '%Y-%m-%d') AS date, event_id % 2 = 0 AS has_votes FROM events WHERE event_type IN ('view', 'click')) GROUP BY 1"""


@query(MEETINGS)
def meeting_listing(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), F.lit(" Plenary in the chamber")).otherwise(F.lit(" Committee"))
    kinds = F.when(F.col("event_id") % 2 == 0, F.lit("Votes")).otherwise(F.lit("Transcript"))
    link = F.concat(F.lit("/x?meetingID="), F.col("user_id").cast("string"), F.lit("&xmlDownloadType="), kinds)
    rows = e.select(F.col("event_id").alias("seq"), F.concat(F.date_format("ts", "dd/MM/yyyy HH:mm"), kind).alias("text"), F.array(link).alias("links"))
    return normalise.meeting_listing(rows, "2024-01-01", "2025-01-01").select("id", "date", "has_votes")


@query("""SELECT doc_id, line_no::INT AS line_no, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), '') AS speaker FROM (
  SELECT doc_id, line_no, nullif(trim(regexp_replace(CASE WHEN bold <> '' THEN bold WHEN length(head) BETWEEN 1 AND 60 AND NOT regexp_matches(head, '^[0-9]') THEN head END, ':+$', '')), '') AS own FROM (
  SELECT doc_id, line_no, line, regexp_extract(line, '^(M[a-z]+) ', 1) AS bold, CASE WHEN contains(substr(line, 1, 80), ':') THEN trim(split_part(line, ':', 1)) END AS head FROM lines) WHERE length(line) >= 20)""", ctes=LINES)
def paragraph_speakers(spark, d):
    """Lines as paragraphs, their first word bold where it opens with M."""
    paragraphs = _lines(spark, d).withColumn("bold", F.regexp_extract("line", "^(M[a-z]+) ", 1))
    return segments.paragraph_speakers(paragraphs, "doc_id", "line_no", "line", "bold").select("doc_id", "line_no", "speaker")
