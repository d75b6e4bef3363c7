"""Scans of landed files and the streaming twins; each lands rows of the tables and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.plans.catalog import query
from rollcall.plans.views import pulls, statements, votes
from rollcall.schema import strings
from rollcall.sources import normalise, readers, sinks
from rollcall.sources.scratch import folder
from rollcall.streaming import ingest as streaming


@query("SELECT statement_id, member_name, date, text FROM statements")
def csv_scan(spark, d):
    """Statements as a master CSV, quotes and line breaks within fields included, scanned back."""
    columns = ["statement_id", "member_name", "date", "text"]
    path = folder(spark, "csv")
    statements(spark, d).select(*columns).write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(path)
    return readers.master_csv(spark, path, columns)


@query("SELECT member_key AS member_id, date, division, direction, title FROM votes")
def xml_scan(spark, d):
    """Votes as XML rows, scanned back and normalised."""
    path = folder(spark, "xml")
    v = votes(spark, d)
    token = F.when(F.col("direction") == "aye", "For").when(F.col("direction") == "no", "Against").otherwise("DidNotVote")
    rows = v.select(
        F.col("member_key").alias("Member_Id"), F.col("member_name").alias("Member_name_English"), F.col("date").alias("MeetingDate"), token.alias("Results_Result"),
        F.col("title").alias("Vote_Name_English"), F.col("division").alias("Contribution_ID"),
    )
    sinks.write_xml(rows, path, "row", "rows")
    schema = strings("Member_Id", "Member_name_English", "MeetingDate", "Results_Result", "Vote_Name_English", "Contribution_ID")
    found = normalise.welsh_votes(readers.xml_rows(spark, path, "row", schema))
    return found.select(F.col("member.id").alias("member_id"), "date", F.col("metadata")["division_id"].alias("division"), F.col("metadata")["vote_direction"].alias("direction"), "title")


@query("SELECT member_key AS member_id, CASE WHEN legislature = 'F' THEN date ELSE '' END AS date, division, direction, title FROM votes")
def xml_by_child(spark, d):
    """Votes in files of two schemas in one folder, one of them in a namespace; rows are known by a child element alone."""
    path, v = folder(spark, "xml"), votes(spark, d)
    token = F.when(F.col("direction") == "aye", "For").when(F.col("direction") == "no", "Against").otherwise("DidNotVote")
    six = v.filter("legislature = 'F'").select(
        F.col("member_key").alias("Member_Id"), F.col("date").alias("MeetingDate"), token.alias("Results_Result"), F.col("title").alias("Vote_Name_English"), F.col("division").alias("Contribution_ID")
    )
    seven = v.filter("legislature <> 'F'").select(token.alias("Results_Result"), F.col("division").alias("Contribution_ID"), F.col("title").alias("Vote_Name"), F.col("member_key").alias("Member_Id"))
    sinks.write_xml(six, path, "Votes_Sixth", 'list xmlns="urn:sixth"')
    sinks.write_xml(seven, path, "Votes_Seventh", "list")
    found = normalise.welsh_votes(readers.xml_rows_by_child(spark, path, "Results_Result", ["Member_Id", "MeetingDate", "Results_Result", "Vote_Name_English", "Vote_Name", "Contribution_ID"]))
    return found.select(F.col("member.id").alias("member_id"), "date", F.col("metadata")["division_id"].alias("division"), F.col("metadata")["vote_direction"].alias("direction"), "title")


LANDED = "key string, legislature string, date string, seq long, ts timestamp"


def _landed(spark, d):
    path = folder(spark, "landed")
    pulls(spark, d).select("key", "legislature", "date", "seq", F.col("ts").cast("timestamp").alias("ts")).write.parquet(path)
    return spark.readStream.schema(LANDED).parquet(path)


@query("SELECT legislature, date, seq::VARCHAR AS seq, key FROM pulls QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq) = 1")
def stream_dedup(spark, d):
    """Pulled records through the exactly-once stream, twice; the second run adds nothing."""
    master, columns = folder(spark, "master"), ["legislature", "date", "seq"]
    stream = _landed(spark, d)
    for run in ("one", "two"):
        streaming.dedup_into_master(stream, master, columns, folder(spark, run)).awaitTermination()
    return streaming.master_table(spark, master, columns)


@query("SELECT DISTINCT key FROM pulls")
def stream_recent_dedup(spark, d):
    """Keys of a source that repeats within two months, once each, by a watermark."""
    out = folder(spark, "recent")
    once = streaming.recent_dedup(_landed(spark, d), "ts", "key", "60 days").select("key")
    streaming.closed_windows(once, out, folder(spark, "cp")).awaitTermination()
    return spark.read.schema("key string").parquet(out)


DAY_S = 86_400
#: Records in three landings, by value; a landing's newest time, less a day, closes windows for the next.
LATE = f"""landings AS (SELECT *, CASE WHEN value < 20 THEN 0 WHEN value < 60 THEN 1 ELSE 2 END AS landing, floor(epoch(ts) / {DAY_S}) * {DAY_S} + {DAY_S} AS closes FROM pulls),
marks AS (SELECT landing, max(max(epoch_us(ts))) OVER (ORDER BY landing) / 1e6 - {DAY_S} AS mark FROM landings GROUP BY 1),
timed AS (SELECT l.*, coalesce(closes <= m.mark, FALSE) AS late FROM landings l LEFT JOIN marks m ON m.landing = l.landing - 1)"""


def _split(spark, d):
    """The records landed one part after the other, each split into late and timely rows."""
    landed, out, checkpoint = folder(spark, "landed"), folder(spark, "split"), folder(spark, "cp")
    part = F.when(F.col("value") < 20, 0).when(F.col("value") < 60, 1).otherwise(2)
    rows = pulls(spark, d).select("key", "legislature", "date", "seq", F.col("ts").cast("timestamp").alias("ts"), part.alias("landing"))
    for k in range(3):
        rows.filter(F.col("landing") == k).drop("landing").write.mode("append").parquet(landed)
        streaming.split_late(spark.readStream.schema(LANDED).parquet(landed), out, checkpoint, "ts", DAY_S, DAY_S).awaitTermination()
    return out


@query("SELECT legislature, seq, key FROM timed WHERE late", ctes=LATE)
def stream_late_rows(spark, d):
    """Rows that came after their window had closed, kept in a table of their own."""
    return streaming.split_rows(spark, _split(spark, d), LANDED, True).select("legislature", "seq", "key")


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, legislature, count(*) AS n FROM timed WHERE NOT late AND closes <= (SELECT max(mark) FROM marks) GROUP BY 1, 2", ctes=LATE)
def stream_window_counts(spark, d):
    """Timely rows per day and legislature, given out by the stream as the days close."""
    out = folder(spark, "windows")
    counts = streaming.counts_per_window(streaming.timely_stream(spark, _split(spark, d), LANDED), "ts", "1 day", "1 day", "legislature")
    flat = counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "legislature", "n")
    streaming.closed_windows(flat, out, folder(spark, "cp")).awaitTermination()
    return spark.read.schema("day string, legislature string, n long").parquet(out)


@query("""SELECT 'statement' AS data_type, member_id, member_name, 'said by ' || member_name AS text, date, statement_id FROM statements""")
def flat_csv(spark, d):
    """Records as flat CSV for spreadsheets, with a byte-order mark, read back by place."""
    path = folder(spark, "flat")
    rows = statements(spark, d)
    who = normalise.member_of(F.col("member_id"), F.col("member_name"), F.col("member_party"), F.lit(""), F.lit(""))
    records = normalise.record(rows, "statement", who, F.col("date"), F.concat(F.lit("said by "), "member_name"), F.lit(""), {"statement_id": F.col("statement_id")}, "any")
    sinks.write_flat(records, path, ["statement_id"])
    columns = sinks.flatten_record(records, ["statement_id"]).columns
    return readers.csv_report(spark, path, columns).select("data_type", "member_id", "member_name", "text", "date", F.col("metadata_statement_id").alias("statement_id"))


@query("SELECT legislature, 'members' AS data_type, run_date, count(*) AS rows FROM pulls GROUP BY 1, 3")
def run_files(spark, d):
    """Runs as JSON files by legislature and day, read back."""
    path = folder(spark, "runs")
    sinks.write_run(pulls(spark, d).select("legislature", "run_date", "key", "text"), path)
    back = spark.read.schema("key string, text string, legislature string, run_date string").json(path)
    return back.groupBy("legislature", F.lit("members").alias("data_type"), "run_date").agg(F.count("*").alias("rows"))
