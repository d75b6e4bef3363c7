"""Dedup, ledger, cursors, chunks, completeness and run summaries over pulled events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollcall.operators import ingest, quality
from rollcall.plans.catalog import query
from rollcall.plans.views import pulls, roster, statements, table
from rollcall.sources import readers, sinks
from rollcall.sources.scratch import folder

TYPES = 5
LEDGER = """ledger AS (SELECT legislature, data_type, run_date, min(date) AS from_date, max(date) AS to_date, count(*) AS count, count(*) < 20 AS complete
  FROM pulls GROUP BY 1, 2, 3)"""


def _ledger(spark, d):
    return ingest.run_ledger(pulls(spark, d), limit=20)


def _log(spark, d) -> str:
    """The ledger's log on files: the first half of the month, then the second, one of its appends tried twice."""
    path, rows = folder(spark, "ledger"), _ledger(spark, d).withColumn("pulled_at", F.to_timestamp("run_date"))
    for part in ("run_date < '2024-01-16'", "run_date >= '2024-01-16'", "run_date >= '2024-01-16'"):
        sinks.append_ledger(rows.filter(part), path)
    return path


@query("SELECT legislature, data_type, run_date, key, date, seq FROM pulls QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq) = 1")
def batch_dedup(spark, d):
    return ingest.batch_dedup(pulls(spark, d).select("legislature", "data_type", "run_date", "key", "date", "seq"))


@query("""SELECT legislature, data_type, run_date, key, seq FROM pulls WHERE run_date >= '2024-01-16' AND key NOT IN (SELECT key FROM pulls WHERE run_date < '2024-01-16')
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq) = 1""")
def new_records(spark, d):
    p = pulls(spark, d).select("legislature", "data_type", "run_date", "key", "seq")
    return ingest.new_records(p.filter("run_date >= '2024-01-16'"), p.filter("run_date < '2024-01-16'"))


@query("SELECT key::VARCHAR AS key, legislature::VARCHAR AS legislature, '' AS title, date::VARCHAR AS date, seq::VARCHAR AS seq FROM pulls")
def schema_align(spark, d):
    return ingest.schema_align(pulls(spark, d), ["key", "legislature", "title", "date", "seq"])


@query("SELECT * FROM ledger", ctes=LEDGER)
def run_ledger(spark, d):
    return _ledger(spark, d)


@query("""SELECT legislature, max(CASE WHEN whole THEN cursor_ END) AS resume_from, max(run_date) AS last_run FROM (
  SELECT legislature, run_date, bool_and(complete) AND count(DISTINCT data_type) = 5 AS whole, min(least(to_date, run_date)) AS cursor_ FROM ledger GROUP BY 1, 2) GROUP BY 1""", ctes=LEDGER)
def resume_from(spark, d):
    """From the log as it was appended."""
    return ingest.resume_from(readers.ledger(spark, _log(spark, d)), TYPES)


@query("SELECT legislature, data_type, run_date, from_date, to_date FROM ledger WHERE NOT complete", ctes=LEDGER)
def pending_types(spark, d):
    """What the log, compacted, does not have as complete."""
    path = _log(spark, d)
    sinks.compact_ledger(spark, path, "2024-02")
    return ingest.pending_types(_ledger(spark, d).select("legislature", "data_type", "run_date", "from_date", "to_date"), readers.ledger(spark, path))


@query("""SELECT legislature, data_type, run_date, from_date, to_date, count, complete FROM ledger WHERE run_date <= '2024-01-20'
  QUALIFY row_number() OVER (PARTITION BY legislature, data_type ORDER BY run_date DESC) = 1""", ctes=LEDGER)
def ledger_snapshot(spark, d):
    """The last row of each type as the compacted log stood on a day."""
    path = _log(spark, d)
    sinks.compact_ledger(spark, path, "2024-02")
    return ingest.latest_ledger(readers.ledger(spark, path, "2024-01-20")).drop("pulled_at")


RANGES = "ranges AS (SELECT o_custkey AS id, min(o_orderdate)::DATE AS start, max(o_orderdate)::DATE AS stop FROM orders GROUP BY 1)"


def _ranges(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").cast("date").alias("start"), F.max("o_orderdate").cast("date").alias("end"))


@query("""SELECT id, strftime(s, '%Y-%m-%d') AS chunk_from, strftime(least((s + INTERVAL 180 DAY)::DATE, stop), '%Y-%m-%d') AS chunk_to FROM (
  SELECT id, stop, unnest(generate_series(start::TIMESTAMP, (stop - 1)::TIMESTAMP, INTERVAL 180 DAY)) AS s FROM ranges WHERE start < stop)""", ctes=RANGES)
def date_chunks(spark, d):
    chunks = ingest.date_chunks(_ranges(spark, d), 180, half_open=True)
    return chunks.select("id", F.date_format("chunk_from", "yyyy-MM-dd").alias("chunk_from"), F.date_format("chunk_to", "yyyy-MM-dd").alias("chunk_to"))


@query("""SELECT id, strftime(s, '%Y-%m-%d') AS chunk_from, strftime(least((s + INTERVAL 14 DAY)::DATE, stop), '%Y-%m-%d') AS chunk_to FROM (
  SELECT id, stop, unnest(generate_series(start::TIMESTAMP, stop::TIMESTAMP, INTERVAL 15 DAY)) AS s FROM ranges)""", ctes=RANGES)
def date_chunks_inclusive(spark, d):
    chunks = ingest.date_chunks(_ranges(spark, d), 14)
    return chunks.select("id", F.date_format("chunk_from", "yyyy-MM-dd").alias("chunk_from"), F.date_format("chunk_to", "yyyy-MM-dd").alias("chunk_to"))


CALENDAR = """spans AS (SELECT event_type AS legislature, min(ts)::DATE AS start, max(ts)::DATE AS stop FROM events GROUP BY 1),
days AS (SELECT legislature, unnest(generate_series(start::TIMESTAMP, stop::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM spans)"""


def _spans(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("legislature")).agg(F.min("ts").cast("date").alias("start"), F.max("ts").cast("date").alias("end"))


@query("SELECT legislature, strftime(day, '%Y-%m-%d') AS day FROM days WHERE isodow(day) < 6", ctes=CALENDAR)
def weekday_calendar(spark, d):
    return ingest.weekday_calendar(_spans(spark, d)).select("legislature", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("""SELECT legislature, strftime(day, '%Y-%m-%d') AS day FROM (SELECT *, coalesce(max((run >= 2)::INT) OVER (PARTITION BY legislature ORDER BY day DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM (
  SELECT *, sum(empty_) OVER (PARTITION BY legislature, full_ ORDER BY day DESC) AS run FROM (
  SELECT *, sum(1 - empty_) OVER (PARTITION BY legislature ORDER BY day DESC) AS full_ FROM (
  SELECT d.legislature, d.day, (count(p.seq) < 62)::INT AS empty_ FROM days d LEFT JOIN pulls p ON p.legislature = d.legislature AND p.ts::DATE = d.day GROUP BY 1, 2)))) WHERE ended = 0""", ctes=CALENDAR)
def backward_pull_days(spark, d):
    days = _spans(spark, d).withColumn("day", F.explode(F.sequence("start", "end"))).select("legislature", "day")
    per_day = pulls(spark, d).groupBy("legislature", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    held = days.join(per_day, ["legislature", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    found = ingest.stops_after_empty(held, ["legislature"], F.col("n") < 62, 2)
    return found.select("legislature", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("SELECT seq, date FROM pulls WHERE date = '' OR date <= '2024-01-12'")
def filter_to_date(spark, d):
    return ingest.filter_to_date(pulls(spark, d).select("seq", "date"), "date", "2024-01-12")


@query("SELECT seq, date FROM pulls WHERE date = '' OR date BETWEEN '2024-01-05' AND '2024-01-12'")
def filter_date_range(spark, d):
    return ingest.filter_date_range(pulls(spark, d).select("seq", "date"), "date", "2024-01-05", "2024-01-12")


@query("""SELECT p.legislature, data_type, seq, source_rank FROM (SELECT *, CASE WHEN text = '' THEN 9 ELSE user_rank END AS source_rank FROM (
  SELECT *, CASE WHEN value < 20 THEN 0 WHEN value < 60 THEN 1 ELSE 2 END AS user_rank FROM pulls)) p
  QUALIFY source_rank = min(source_rank) OVER (PARTITION BY legislature, data_type)""")
def source_fallback(spark, d):
    rank = F.when(F.col("text") == "", 9).when(F.col("value") < 20, 0).when(F.col("value") < 60, 1).otherwise(2)
    rows = pulls(spark, d).withColumn("source_rank", rank)
    return ingest.source_fallback(rows, ["legislature", "data_type"]).select("legislature", "data_type", "seq", "source_rank")


@query("SELECT legislature, key, min(seq) AS seq FROM pulls GROUP BY 1, 2")
def ordered_distinct(spark, d):
    return ingest.ordered_distinct(pulls(spark, d), ["legislature", "key"], "seq")


@query("""SELECT legislature, seq, date, row_number() OVER (PARTITION BY legislature ORDER BY ts DESC, seq)::INT AS place, count(*) OVER (PARTITION BY legislature) > 50 AS truncated FROM pulls
  QUALIFY place <= 50""")
def capped_listing(spark, d):
    rows = pulls(spark, d).select("legislature", "seq", "date", "ts")
    return ingest.capped_listing(rows, ["legislature"], [F.desc("ts"), "seq"], 50).drop("ts")


ORAL = ("questions", "plenary_business")


@query(f"SELECT legislature, data_type, seq, 'oral' AS source FROM pulls WHERE data_type IN {ORAL} UNION ALL SELECT legislature, data_type, seq, 'written' FROM pulls WHERE data_type NOT IN {ORAL}")
def plenary_union(spark, d):
    p = pulls(spark, d).select("legislature", "data_type", "seq")
    oral = F.col("data_type").isin(*ORAL)
    return p.filter(oral).withColumn("source", F.lit("oral")).unionByName(p.filter(~oral).withColumn("source", F.lit("written")))


def _issues(*parts: str) -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), '; ')"


RECORDS = f"""assessed AS (SELECT legislature, data_type, n, empty_text, empty_date, empty_name, {_issues(
  "CASE WHEN empty_text = n THEN 'ALL text fields empty' WHEN empty_text > n // 2 THEN empty_text || '/' || n || ' text fields empty' END",
  "CASE WHEN empty_date > n // 2 THEN empty_date || '/' || n || ' date fields empty' END",
  "CASE WHEN empty_name > n // 2 THEN empty_name || '/' || n || ' member name fields empty' END")} AS issues FROM (
  SELECT legislature, data_type, count(*) AS n, count_if(trim(text) = '') AS empty_text, count_if(trim(date) = '') AS empty_date, count_if(trim(member_name) = '') AS empty_name
  FROM pulls GROUP BY 1, 2))"""


@query("SELECT * FROM assessed", ctes=RECORDS)
def completeness(spark, d):
    return quality.completeness(pulls(spark, d), ["legislature", "data_type"])


@query("SELECT *, CASE WHEN issues = '' THEN 'PASS' WHEN data_type = 'questions' THEN 'WARN' ELSE 'FAIL' END AS status FROM assessed", ctes=RECORDS)
def quality_status(spark, d):
    assessed = quality.completeness(pulls(spark, d), ["legislature", "data_type"])
    return quality.quality_status(assessed, F.col("data_type") == "questions")


@query(f"""SELECT legislature, n, empty_name, empty_party, empty_id, {_issues("CASE WHEN empty_name > n // 2 THEN empty_name || '/' || n || ' name fields empty' END",
  "CASE WHEN empty_party = n THEN 'ALL party fields empty' END", "CASE WHEN empty_id = n THEN 'ALL id fields empty' END")} AS issues FROM (
  SELECT legislature, count(*) AS n, count_if(trim(name) = '') AS empty_name, count_if(trim(party) = '') AS empty_party, count_if(trim(id) = '') AS empty_id FROM roster GROUP BY 1)""")
def completeness_members(spark, d):
    return quality.completeness_members(roster(spark, d), ["legislature"])


SUMMARY = """fetched AS (SELECT legislature, data_type, count(*) FILTER (NOT (legislature = 'error' AND data_type IN ('questions', 'votes_on_division', 'members'))) AS fetched,
  count(DISTINCT key) FILTER (NOT (legislature = 'error' AND data_type IN ('questions', 'votes_on_division', 'members'))) AS new FROM pulls GROUP BY 1, 2)"""


@query("""SELECT legislature, data_type, fetched, new, fetched - new AS skipped, CASE WHEN fetched = 0 AND data_type = 'members' THEN 'expected limitation'
  WHEN fetched = 0 AND data_type IN ('plenary_business', 'votes_on_division') THEN 'normal' WHEN fetched = 0 THEN 'needs attention' ELSE 'ok' END AS verdict FROM fetched
  UNION ALL SELECT 'total', '', sum(fetched)::BIGINT, sum(new)::BIGINT, sum(fetched - new)::BIGINT, '' FROM fetched""", ctes=SUMMARY)
def run_summary(spark, d):
    p = pulls(spark, d)
    kept = ~((F.col("legislature") == "error") & F.col("data_type").isin("questions", "votes_on_division", "members"))
    counts = p.groupBy("legislature", "data_type").agg(F.count_if(kept).alias("fetched"), F.count_distinct(F.when(kept, F.col("key"))).alias("new"))
    limits = p.filter("legislature = 'error' and data_type = 'members'").select("legislature", "data_type").distinct()
    return quality.run_summary(counts.withColumn("skipped", F.col("fetched") - F.col("new")), limits)


@query("""SELECT id, strftime(s, '%Y-%m-%d') AS chunk_from, strftime(least((s + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE, stop), '%Y-%m-%d') AS chunk_to FROM (
  SELECT id, stop, unnest(generate_series(TIMESTAMP '1992-01-01', stop::TIMESTAMP, INTERVAL 3 MONTH)) AS s FROM ranges)""", ctes=RANGES)
def quarter_chunks(spark, d):
    chunks = ingest.quarter_chunks(_ranges(spark, d), 1992)
    return chunks.select("id", F.date_format("chunk_from", "yyyy-MM-dd").alias("chunk_from"), F.date_format("chunk_to", "yyyy-MM-dd").alias("chunk_to"))


PAGES = """listing AS (SELECT legislature, date, seq, (dense_rank() OVER (PARTITION BY legislature ORDER BY date DESC) - 1) // 2 AS page FROM pulls),
ends AS (SELECT legislature, min(page) AS stop_ FROM (SELECT legislature, page FROM listing GROUP BY 1, 2 HAVING max(date) < '2024-01-10') GROUP BY 1)"""


@query("""SELECT legislature, date, seq, page FROM listing LEFT JOIN ends USING (legislature) WHERE date >= '2024-01-10' AND (stop_ IS NULL OR page < stop_)""", ctes=PAGES)
def stops_at_old_page(spark, d):
    """Listings of two days a page, newest first, landed by day and read back to a bound."""
    path, rows = folder(spark, "listing"), listing(spark, d)
    sinks.land_listing(rows, path, ["legislature"], "page", "date")
    return readers.listing_since(spark, path, rows.schema, ["legislature"], "page", "date", "2024-01-10")


def listing(spark, d):
    p = pulls(spark, d).select("legislature", "date", "seq")
    days = p.select("legislature", "date").distinct()
    page = F.floor((F.dense_rank().over(Window.partitionBy("legislature").orderBy(F.desc("date"))) - 1) / 2)
    return p.join(days.withColumn("page", page), ["legislature", "date"])


@query("SELECT legislature, dtype AS data_type, count(*) AS records, count(nullif(trim(member_name), '')) AS named, count(DISTINCT nullif(trim(member_name), '')) AS members FROM statements GROUP BY 1, 2")
def coverage(spark, d):
    return quality.coverage(statements(spark, d).withColumnRenamed("dtype", "data_type"), ["legislature", "data_type"], "member_name")
