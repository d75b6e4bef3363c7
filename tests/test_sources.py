"""Scans, sinks, normalisers and the streaming twin on small landed fixtures."""

import csv
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions import casts
from rollcall.operators import ingest, reports, segments
from rollcall.schema import strings
from rollcall.sources import normalise as n
from rollcall.sources import readers, sinks
from rollcall.streaming import ingest as streaming

ROSTER = "id string, name string, party string, constituency string, role string, status string, legislature string"


def roster(spark):
    return spark.createDataFrame([("7", "Jane Smith", "Blue", "North", "MP", "current", "F")], ROSTER)


def landed(spark, path, value):
    path.write_text(json.dumps(value))
    return str(path)


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def test_master_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes('﻿id,text\n1,"a ""b""\nc"\n2,\n'.encode())
    rows = {r["id"]: r["text"] for r in readers.master_csv(spark, str(tmp_path / "m.csv"), ["id", "text"]).collect()}
    assert rows == {"1": 'a "b"\nc', "2": ""}
    assert readers.master_csv(spark, str(tmp_path / "none.csv"), ["id"]).count() == 0


def test_json_items_under_any_wrapper(spark, tmp_path):
    item = strings("id", "name")
    for k, value in enumerate(({"items": [{"value": {"id": "1"}}]}, {"results": [{"id": "2"}]}, {"data": [{"id": "3"}]})):
        assert one(readers.json_items(spark, landed(spark, tmp_path / f"{k}.json", value), item))["id"] == str(k + 1)


def test_xml_rows(spark, tmp_path):
    (tmp_path / "v.xml").write_text("<r><row><Member_Id>9</Member_Id><Results_Result>For</Results_Result><Vote_Name_English>M</Vote_Name_English><MeetingDate>2024-01-02T00:00</MeetingDate></row></r>")
    fields = strings("Member_Id", "Member_name_English", "MeetingDate", "Results_Result", "Vote_Name_English")
    r = one(n.welsh_votes(readers.xml_rows(spark, str(tmp_path / "v.xml"), "row", fields)))
    assert (r["member"]["id"], r["metadata"]["vote_direction"], r["date"], r["title"]) == ("9", "aye", "2024-01-02", "M")


def test_uk_members_questions_and_votes(spark, tmp_path):
    named = T.StructType([T.StructField("name", T.StringType())])
    item = T.StructType([*strings("id", "nameDisplayAs", "nameFullTitle").fields, T.StructField("latestParty", named), T.StructField("latestHouseMembership", strings("membershipFrom"))])
    path = landed(spark, tmp_path / "m.json", {"items": [{"value": {"id": "7", "nameDisplayAs": "Jane", "latestParty": {"name": "Blue"}, "latestHouseMembership": {"membershipFrom": "North"}}}]})
    assert tuple(one(n.uk_members(readers.json_items(spark, path, item), "Commons", True))) == ("7", "Jane", "Blue", "North", "MP", "current")
    asked = T.StructType(strings("id", "questionText", "answerText", "askingMemberId", "tabledWhen", "heading", "answeringBodyName", "dateAnswered", "isWithdrawn").fields + [T.StructField("askingMember", strings("name", "listAs", "party", "memberFrom")), T.StructField("seq", T.IntegerType())])
    q = spark.createDataFrame([("1", "why", "so", "7", "2024-01-02T00", "H", "B", "2024-02-01", "false", None, 1), ("1", "late", "", "7", "2024-01-03", "H", "B", "", "false", None, 2)], asked)
    r = one(n.uk_questions(q, roster(spark)))
    assert (r["member"]["name"], r["text"], r["date"]) == ("Jane Smith", "Question: why\n\nAnswer: so", "2024-01-02")
    who = "array<struct<MemberId:int,Name:string,Party:string>>"
    d = spark.createDataFrame([(5, "T", "2024-01-02T1", 2, 1, [(1, "a", "x")], [(2, "b", "y")], [])], f"DivisionId int, Title string, Date string, AyeCount int, NoeCount int, Ayes {who}, Noes {who}, NoVoteRecorded {who}")
    assert sorted((r["member"]["id"], r["metadata"]["vote_direction"], r["metadata"]["division_result"]) for r in n.uk_votes(d).collect()) == [("1", "aye", "passed"), ("2", "no", "passed")]


def test_uk_interests_and_speeches(spark):
    c = spark.createDataFrame([("Gifts", [("1", "cup", None, "2024-01-02T0", None, "false"), ("2", " ", "", None, None, "false")])], "name string, interests array<struct<id:string,interest:string,description:string,createdWhen:string,lastAmendedWhen:string,registeredLate:string>>")
    member = n.member_of(F.lit("7"), F.lit("Jane"), F.lit("Blue"), F.lit("North"), F.lit("MP"))
    r = one(n.uk_interests(c, member, F.lit("current")))
    assert (r["text"], r["date"], r["metadata"]["category"]) == ("cup", "2024-01-02", "Gifts")
    assert n.uk_interests(c, member, F.lit("historical")).count() == 0
    s = spark.createDataFrame([("<p>Hello  there</p>", "2024-01-02T1", "7", "", "Debate"), ("ab", "2024-01-02", "7", "", "")], "ContributionTextFull string, SittingDate string, MemberId string, AttributedTo string, DebateSection string")
    r = one(n.uk_contributions(s, roster(spark)))
    assert (r["text"], r["member"]["name"], r["member"]["party"], r["title"]) == ("Hello there", "Jane Smith", "Blue", "Debate")
    assert n.uk_plenary(n.uk_contributions(s, roster(spark)), n.uk_statements(s, roster(spark), "2024-02-01")).count() == 1


def test_ni(spark):
    empty = spark.createDataFrame([], "PersonId string, MemberName string, PartyName string, ConstituencyName string")
    interests = spark.createDataFrame([("7", "Jane Smith", "Blue", "cup", "Gifts", "3", "2024-01-02T0"), ("7", "Jane Smith", "Blue", "mug", "Gifts", "4", "2024-01-03"), ("8", "", "", "x", "", "", "")], "PersonId string, MemberName string, PartyName string, RegisterEntry string, RegisterCategory string, RegisterCategoryId string, RegisterEntryStartDate string")
    assert [r["id"] for r in n.ni_members_or_derived(empty, interests).collect()] == ["7"]
    assert {r["text"] for r in n.ni_interests(interests, roster(spark)).collect()} == {"cup", "mug", "x"}
    oral = spark.createDataFrame([("q", "", "7", "Jane", "2024-01-02", "R1")], "QuestionText string, AnswerText string, TablerPersonId string, TablerName string, TabledDate string, Reference string")
    assert {r["metadata"]["question_type"] for r in n.ni_questions(oral, oral).collect()} == {"oral", "written"}
    d = spark.createDataFrame([(1, 2, "Motion", "2024-01-02", "Carried", [(7, "Jane", "Blue", "AYE")]), (3, 4, "Other", "2024-01-02", "", None)], "EventID int, DocumentID int, DivisionSubject string, DivisionDate string, DivisionResult string, MemberVoting array<struct<PersonID:int,MemberName:string,PartyName:string,VoteType:string>>")
    assert sorted((r["title"], r["metadata"]["vote_direction"]) for r in n.ni_votes(d).collect()) == [("Motion", "aye"), ("Other", "unknown")]
    parts = spark.createDataFrame([("r", 1, "Mr Smith: good morning all"), ("r", 2, "and so it goes on here"), ("r", 3, "short")], "report string, no int, ComponentText string").withColumns({"ComponentType": F.lit("Text"), "ComponentHeader": F.lit("")})
    assert [r["member"]["name"] for r in n.ni_components(parts, "report", "no").collect()] == ["Mr Smith", "Mr Smith"]


def test_memberships_sorted_by_person_are_not_shuffled_again(spark):
    members = spark.createDataFrame([("1", ""), ("2", "Kept"), ("3", "")], "id string, party string")
    memberships = spark.createDataFrame([(1, 1, "2001", None), (1, 2, "2011", "2012"), (2, 1, "2001", None), (None, 1, "2001", None)], "PersonID long, PartyID int, ValidFromDate string, ValidUntilDate string")
    parties = F.broadcast(spark.createDataFrame([(1, "Open"), (2, "Closed")], "ID int, PartyName string"))
    sites = memberships.select("PersonID", F.col("ValidFromDate").alias("WebURL"), F.col("ValidUntilDate").isNotNull().alias("IsDefault"))
    for got, column, want in (
        (n.scottish_parties(members, memberships.repartition(3, "PersonID"), parties), "party", {"1": "Open", "2": "Kept", "3": ""}),
        (n.profile_links(members, sites.repartition(3, "PersonID")), "profile_url", {"1": "2011", "2": "2001", "3": None}),
    ):
        assert {r["id"]: r[column] for r in got.collect()} == want
        assert "_groupingexpression" not in got._jdf.queryExecution().executedPlan().toString()


def test_scotland(spark):
    party = "array<struct<ValidFromDate:string,PartyName:string>>"
    m = spark.createDataFrame([("1", "Smith, Jane", True, [("2001", "Old"), ("2011", "New")])], f"PersonID string, ParliamentaryName string, IsCurrent boolean, MemberParties {party}")
    r = one(n.scottish_members(m))
    assert (r["name"], r["party"], r["status"]) == ("Jane Smith", "New", "current")
    blank = n.scottish_members(m).withColumn("party", F.lit(""))
    memberships = spark.createDataFrame([("1", 1, "2001", None), ("1", 2, "2011", "2012")], "PersonID string, PartyID int, ValidFromDate string, ValidUntilDate string")
    parties = spark.createDataFrame([(1, "Open"), (2, "Closed")], "ID int, PartyName string")
    assert one(n.scottish_parties(blank, memberships, parties))["party"] == "Open"
    sites = spark.createDataFrame([("1", "z", False), ("1", "a", True)], "PersonID string, WebURL string, IsDefault boolean")
    assert one(n.profile_links(blank, sites))["profile_url"] == "a"
    card = "Question reference: S6W-1\nAsked by: Jane Smith, MSP for North, Blue\nDate lodged: 12 May 2024\nCurrent Status: Answered by Tom Lee on 16 June 2024\nQuestion\nWhy is it so late?\nAnswer\nBecause it is so."
    rows = {r["metadata"]["qa_role"]: r for r in n.scottish_cards(spark.createDataFrame([(card,)], "text string")).collect()}
    assert (rows["question"]["member"]["constituency"], rows["question"]["date"], rows["question"]["text"]) == ("North", "2024-05-12", "Why is it so late?")
    assert (rows["answer"]["member"]["name"], rows["answer"]["date"]) == ("Tom Lee", "2024-06-16")
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(["running head", "Jane Smith (North) (Blue): I rise to speak", "about this", "12", "The Convener (Tom Lee): thank you very much"])], "doc string, line_no int, line string")
    found = n.scottish_report(lines, "doc").orderBy("segment").collect()
    assert [(r["speaker"], r["text"]) for r in found] == [("Jane Smith", "I rise to speak about this"), ("The Convener", "thank you very much")]
    vote = spark.createDataFrame([("Did not vote", "https://x/msps/jane-smith", "Jane", "T", "Taken in the Chamber on 2 May 2024")], "vote string, profile_url string, name string, title string, page_text string")
    r = one(n.scottish_votes(vote))
    assert (r["member"]["id"], r["metadata"]["vote_direction"], r["date"]) == ("jane-smith", "no_vote", "2024-05-02")
    i = spark.createDataFrame([("9", "JANE SMITH", "Owns a cup since 2 May 2024")], "PersonID string, MemberName string, Description string")
    assert one(n.scottish_interests(i, roster(spark)))["member"]["id"] == "7"


def test_registers(spark):
    texts = ["preamble", "Member’s Name: Jane Smith MSP", "1. Gifts", "A cup", "from a friend, 12 May 2024", "3", "Member’s Name:", "Tom Lee", "2. Land", "A field of turnips"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc string, line_no int, line string")
    found = n.register_text(lines, "doc", "Member’s Name", F.lit("2023-01-01")).orderBy("entry").collect()
    assert [(r["owner"], r["category"], r["text"], r["date"], r["date_is_snapshot_fallback"]) for r in found] == [
        ("Jane Smith MSP", "1. Gifts", "A cup from a friend, 12 May 2024", "2024-05-12", False),
        ("Tom Lee", "2. Land", "A field of turnips", "2023-01-01", True),
    ]


def test_wales(spark):
    wards = spark.createDataFrame([("North", [("1", "Jane Smith MS", "Blue"), ("1", "Jane Smith MS", "Blue")])], "wardtitle string, councillor array<struct<councillorid:string,fullusername:string,politicalpartytitle:string>>")
    assert one(n.welsh_members(wards))["name"] == "Jane Smith"
    q = spark.createDataFrame([("WQ12", "Jane Smith MS", "why", "so", "tabled 02/05/2024", 1), ("wq12", "x", "again", "", "", 2), ("WQ13", "x", " ", "", "", 3)], "questionId string, memberName string, question string, answer string, label string, seq int")
    r = one(n.welsh_questions(q))
    assert (r["metadata"]["question_id"], r["date"], r["member"]["name"], r["text"]) == ("WQ-12", "2024-05-02", "Jane Smith", "Question: why\n\nAnswer: so")
    t = spark.createDataFrame([("1", "Jane Smith MS", "<b>Hi</b> all", "2024-05-02", "Item"), ("1", "x", "Hi all", "2020-01-01", "")], "Member_Id string, Member_name_English string, Contribution_English string, MeetingDate string, Agenda_item_english string")
    assert one(n.welsh_transcripts(t, "2024-01-01", "2024-12-31"))["text"] == "Hi all"
    p = spark.createDataFrame([("<a href='/meeting-of-parliament-02-05-2024?meeting=9'>x</a><a href='/meeting-of-parliament-03-05-2024?meeting=9'>y</a>",)], "html string")
    assert tuple(one(n.meeting_links(p))) == ("9", "2024-05-03")


def test_sinks_and_stream_keep_keys_once(spark, tmp_path):
    columns = ["key", "text"]
    rows = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "3", 3)], "key string, text string, seq int")
    master = str(tmp_path / "master")
    aligned = ["text"]
    assert sinks.append_master(rows, master, aligned) == 2
    assert sinks.append_master(rows, master, aligned) == 0
    source = str(tmp_path / "landed")
    rows.unionByName(spark.createDataFrame([("c", "4", 4)], rows.schema)).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    streaming.dedup_into_master(stream, master, aligned, str(tmp_path / "cp")).awaitTermination()
    held = streaming.master_table(spark, master, aligned)
    assert sorted((r["key"], r["text"]) for r in held.collect()) == [("a", "1"), ("b", "3"), ("c", "4")]
    assert held.columns == ["text", "key"]


def test_a_batch_cut_short_is_written_again(spark, tmp_path, monkeypatch):
    """Killed after its rows, or after its keys: no reader sees the batch, and the rerun gives what one run gives."""
    schema = "key string, text string, seq int"
    source, master, checkpoint = (str(tmp_path / x) for x in ("landed", "master", "cp"))
    land = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
    run = lambda: streaming.dedup_into_master(spark.readStream.schema(schema).parquet(source), master, ["text"], checkpoint).awaitTermination()
    seen = lambda: sorted((r["key"], r["text"]) for r in streaming.master_table(spark, master, ["text"]).collect())
    land([("a", "1", 1), ("b", "2", 2)])
    run()
    land([("b", "again", 3), ("c", "3", 4), ("c", "later", 5)])
    commit = streaming._commit

    def cut(*_):
        raise OSError("executor and driver lost")

    monkeypatch.setattr(streaming, "_commit", cut)
    with pytest.raises(Exception, match="lost"):
        run()
    assert seen() == [("a", "1"), ("b", "2")] and len(list((tmp_path / "master" / "rows").glob("batch=*"))) == 2
    monkeypatch.setattr(streaming, "_commit", commit)
    run()
    run()
    assert seen() == [("a", "1"), ("b", "2"), ("c", "3")]
    # the same batch tried again after it was committed, and a retry by name
    assert streaming.append_new(spark.createDataFrame([("d", "4", 1)], schema), master, ["text"], "again") == 1
    assert streaming.append_new(spark.createDataFrame([("e", "5", 1)], schema), master, ["text"], "again") == 0


def test_a_batch_reads_its_own_parts_of_the_key_index(spark, tmp_path):
    master = str(tmp_path / "master")
    rows = spark.range(5000).select(F.col("id").cast("string").alias("key"), F.col("id").cast("string").alias("text"), F.col("id").alias("seq"))
    streaming.append_new(rows, master, ["text"], "one")
    keys = streaming.seen_keys(spark, master, [3, 5])
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan and "PartitionFilters: [" in plan and "IN (3,5)" in plan.replace("IN [3,5]", "IN (3,5)")
    parts = {r[0] for r in keys.select(streaming.key_part(F.col("key"))).distinct().collect()}
    assert parts == {3, 5} and keys.count() == rows.filter(streaming.key_part(F.col("key")).isin(3, 5)).count()


def test_closed_windows_free_their_state_and_late_rows_are_kept(spark, tmp_path):
    """Three landings, the second with rows of a closed day: they stand aside, days come out as they close, state stays small."""
    schema = "key string, ts timestamp"
    landed, split, out = (str(tmp_path / x) for x in ("landed", "split", "out"))
    batches = [["2024-01-01 10:00", "2024-01-02 09:00", "2024-01-04 12:00"], ["2024-01-01 11:00", "2024-01-04 13:00", "2024-01-06 01:00", None], ["2024-01-05 08:00", "2024-01-09 00:00"]]
    for k, times in enumerate(batches):
        rows = spark.createDataFrame([(f"{k}-{t}", t) for t in times], "key string, ts string").withColumn("ts", F.to_timestamp("ts"))
        rows.write.mode("append").parquet(landed)
        streaming.split_late(spark.readStream.schema(schema).parquet(landed), split, str(tmp_path / "cp"), "ts", 86_400, 86_400).awaitTermination()
        counts = streaming.counts_per_window(streaming.timely_stream(spark, split, schema), "ts", "1 day", "1 day")
        query = streaming.closed_windows(counts.select("window.start", "n"), out, str(tmp_path / "cp2"))
        query.awaitTermination()
    late = {r["key"] for r in streaming.split_rows(spark, split, schema, True).collect()}
    timely = {r["key"] for r in streaming.split_rows(spark, split, schema, False).collect()}
    assert late == {"1-2024-01-01 11:00"} and len(timely) == 8 and "1-None" in timely
    found = {str(r["start"])[:10]: r["n"] for r in spark.read.parquet(out).collect()}
    assert found == {"2024-01-01": 1, "2024-01-02": 1, "2024-01-04": 2, "2024-01-05": 1, "2024-01-06": 1}
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 1  # the last day alone is still open


def test_ledger_log_is_appended_compacted_and_read_as_of(spark, tmp_path):
    path = str(tmp_path / "ledger")
    schema = "legislature string, data_type string, run_date string, from_date string, to_date string, count long, complete boolean, pulled_at timestamp"
    rows = [("F", t, f"2024-0{m}-0{k}", "2024-01-01", f"2024-0{m}-0{k}", 1, m < 3 or t != "e", None) for m in (1, 2, 3) for k in (1, 2) for t in "abcde"]
    frame = spark.createDataFrame(rows, schema).withColumn("pulled_at", F.to_timestamp("run_date"))
    for m in (1, 2, 3):
        for k in (1, 2, 2):  # each second append is tried twice
            sinks.append_ledger(frame.filter(F.col("run_date") == f"2024-0{m}-0{k}"), path)
    before = [tuple(r) for r in ingest.resume_from(readers.ledger(spark, path), 5).collect()]
    files = lambda month: len(list((tmp_path / "ledger" / "legislature=F" / f"month={month}").glob("part-*.parquet")))
    untouched = sorted(p.name for p in (tmp_path / "ledger" / "legislature=F" / "month=2024-03").iterdir())
    assert files("2024-01") == 3
    sinks.compact_ledger(spark, path, "2024-03")
    assert (files("2024-01"), files("2024-02"), files("2024-03")) == (1, 1, 3)
    assert untouched == sorted(p.name for p in (tmp_path / "ledger" / "legislature=F" / "month=2024-03").iterdir())
    assert [tuple(r) for r in ingest.resume_from(readers.ledger(spark, path), 5).collect()] == before == [("F", "2024-02-02", "2024-03-02")]
    assert readers.ledger(spark, path, "2024-01-31").count() == 10 and readers.ledger(spark, path).count() == 20 + 15
    sinks.compact_ledger(spark, path, "2024-04")
    assert readers.ledger(spark, path).count() == 30
    wanted = frame.select("legislature", "data_type", "run_date", "from_date", "to_date")
    assert {r["data_type"] for r in ingest.pending_types(wanted, readers.ledger(spark, path)).collect()} == {"e"}


def test_listings_read_the_folders_since_the_bound_alone(spark, tmp_path):
    rows = spark.createDataFrame([("F", f"2024-01-{d:02}", d, (30 - d) // 3) for d in range(1, 31)] + [("O", "", 0, 0), ("O", "2024-01-25", 1, 0)], "legislature string, date string, seq int, page int")
    rows = rows.unionByName(spark.createDataFrame([("F", "2024-01-29", 99, 9)], rows.schema))  # new, but behind a page that is older as a whole
    path = str(tmp_path / "listing")
    sinks.land_listing(rows, path, ["legislature"], "page", "date")
    found = readers.listing_since(spark, path, rows.schema, ["legislature"], "page", "date", "2024-01-20")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    got = {(r["legislature"], r["seq"]) for r in found.collect()}
    assert got == {("F", d) for d in range(20, 31)} | {("O", 1)}
    wanted = ingest.stops_at_old_page(rows, ["legislature"], "page", "date", F.lit("2024-01-20"))
    assert got == {(r["legislature"], r["seq"]) for r in wanted.collect()}


def test_xml_rows_by_child_of_any_tag_and_namespace(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?><v:list xmlns:v="urn:x"><v:SixthRow><v:Text> one &amp; two </v:Text><v:Id>1</v:Id></v:SixthRow><v:Other><v:Id>9</v:Id></v:Other></v:list>')
    (tmp_path / "b.xml").write_text('<list xmlns="urn:y"><group><Row><Id>2</Id><Text/><Text>late</Text><Extra><Deep>x</Deep></Extra></Row></group><Row><Text></Text></Row></list>')
    (tmp_path / "c.xml").write_text("<list><Row><Text>before the fault</Text></Row><Row><Text>x</list>")
    (tmp_path / "d.xml").write_text("")
    found = readers.xml_rows_by_child(spark, str(tmp_path), "Text", ["Id", "Text", "None"])
    assert sorted((r["Id"] or "", r["Text"]) for r in found.collect()) == [("", ""), ("", "before the fault"), ("1", "one & two"), ("2", "late")]
    assert all(r["None"] is None for r in found.collect())
    many = b"<l>" + b"<r><T>x</T></r>" * 200_000 + b"</l>"
    assert sum(1 for _ in readers.elements_with_child(many, "T")) == 200_000


def test_editions_of_a_register(spark):
    links = [
        ("m", 1, "/old-register-of-interests.PDF", "Fourth Assembly"), ("m", 2, "archive/register-interests", "Sixth Senedd Register"), ("m", 3, "https://site.test/archive/register-interests", "again"),
        ("m", 4, "https://else.test/register-interests", "away"), ("m", 5, "mailto:register@interests", "mail"), ("m", 6, "", "register interests"),
        ("https://site.test/archive/register-interests", 1, "a.pdf?x=1", "Register as on 8 April 2026 (PDF)"), ("https://site.test/archive/register-interests", 2, "b.pdf", "register, no date"),
    ]
    frame = spark.createDataFrame([("m", *x) for x in links], "main string, page string, position int, href string, text string")
    found = {tuple(r) for r in n.register_snapshots(frame, "main", "https://site.test").collect()}
    assert found == {
        ("https://site.test/old-register-of-interests.PDF", "Fourth Assembly", ""), ("https://site.test/a.pdf?x=1", "Sixth Senedd Register", "2026-04-08"),
        ("https://site.test/b.pdf", "Sixth Senedd Register", ""),
    }
    text = ["1. Gifts (contents)", "ANN ROE MS", "stray words before any heading", "1. Gifts", "a pen given", "on 02/06/2021", "2) Work", "I am a member", "Ann Roe", "of no heading", "tiny", "Bo Day", "3. Gifts", "four"]
    lines = [(u, k, x) for u in ("p", "q") for k, x in enumerate(text)]
    roster = spark.createDataFrame([("1", "Ann Roe", "Red", "N", "MS"), ("2", "Bo Day", "Blue", "S", "MS")], "id string, name string, party string, constituency string, role string")
    editions = spark.createDataFrame([("p", "Sixth", "2026-04-08"), ("q", "Fifth", "")], "url string, term string, date string")
    rows = n.register_editions(spark.createDataFrame(lines, "url string, line_no int, line string"), editions, roster)
    got = sorted((r["url"], r["member"]["id"], r["date"], r["title"], r["text"], r["metadata"]["term"], r["metadata"]["date_is_snapshot_fallback"]) for r in rows.collect())
    of = lambda u, term, day, flag: [(u, "1", "2021-06-02", "Gifts", "a pen given on 02/06/2021", term, "false"), (u, "1", day, "", "of no heading tiny", term, flag), (u, "1", day, "", "stray words before any heading", term, flag), (u, "1", day, "Work", "I am a member", term, flag)]
    assert got == sorted(of("p", "Sixth", "2026-04-08", "true") + of("q", "Fifth", "", "false"))
    days = spark.createDataFrame([("1", "2026-04-08"), ("1", "2026-04-07"), ("2", "2030-01-01")], "member_id string, day string")
    assert {(r["url"], r["day"]) for r in n.register_as_of(rows, days).collect()} == {("p", "2026-04-08")}


def test_export_lines_make_one_document(spark, tmp_path):
    lines = spark.createDataFrame([("F", "", "", "", '{"topics":["a"],"benchmarks":{"members":2}}'), ("F", "North", "Bo", "2", '{"name":"Bo"}'), ("F", "East", "Al", "1", '{"name":"Al"}'), ("O", "", "", "", '{"topics":[]}')], "legislature string, area string, member string, member_key string, json string")
    sinks.write_payload(lines.repartition(3), str(tmp_path / "out"))
    files = sorted((tmp_path / "out" / "legislature=F").glob("part-*"))
    text = reports.document([line for f in files for line in f.read_text().splitlines()])
    assert json.loads(text) == {"topics": ["a"], "benchmarks": {"members": 2}, "members": [{"name": "Al"}, {"name": "Bo"}]}
    assert json.loads(reports.document(['{"topics":[]}'])) == {"topics": [], "members": []}


def test_run_files(spark, tmp_path):
    s = spark.createDataFrame([("F", "2024-01-01", ("1", "Jane"), {"house": "H"})], "legislature string, run_date string, member struct<id:string,name:string>, metadata map<string,string>")
    sinks.write_run(s, str(tmp_path / "json"))
    sinks.write_flat(s, str(tmp_path / "csv"), ["house", "none"])
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert one(back.select("member_name", "metadata_house"))["member_name"] == "Jane"
    assert all(f.read_bytes().startswith(b"\xef\xbb\xbf") for f in (tmp_path / "csv").glob("part-*.csv"))
    assert one(spark.read.json(str(tmp_path / "json")))["legislature"] == "F"


def test_flags_of_an_old_run_do_not_advance_the_cursor(spark):
    rows = [("F", t, "2024-01-02", "2024-01-01", "2024-01-02", 1, True) for t in "abcde"] + [("F", "a", "2024-01-09", "2024-01-02", "2024-01-09", 1, True)]
    ledger = spark.createDataFrame(rows, "legislature string, data_type string, run_date string, from_date string, to_date string, count int, complete boolean")
    r = one(ingest.resume_from(ledger, 5))
    assert (r["resume_from"], r["last_run"]) == ("2024-01-02", "2024-01-09")


def test_first_lists_of_any_wrapper(spark):
    texts = ['[{"a": "1"}]', '{"x": [{"a": "2"}]}', '{"x": {"y": [{"a": "3"}]}, "z": [{"a": "0"}]}', '{"n": 1, "rows": [{"a": "0"}]}', "[]", "{}", "", None, "not json", '{"a":' * 60 + '[{"a": "deep"}]' + "}" * 60]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = readers.first_list_items(rows, "t", T.StructType([T.StructField("a", T.StringType())]), ["i"])
    assert sorted((r["i"], r["a"]) for r in got.collect()) == [(0, "1"), (1, "2"), (2, "3"), (9, "deep")]


def test_csv_report_is_sorted_and_marked(spark, tmp_path):
    path = str(tmp_path / "report")
    rows = [("b", 'says "x"', "2"), ("a", "two\nlines", "3"), ("c", "", "1")]
    sinks.write_csv_report(spark.createDataFrame(rows, "name string, title string, n string"), path, ["name"])
    files = sorted((tmp_path / "report").glob("part-*.csv"))
    assert files and all(f.read_bytes().startswith(b"\xef\xbb\xbfname,title,n") for f in files)
    back = [tuple(r) for r in readers.csv_report(spark, path, ["name", "title", "n"]).collect()]
    assert sorted(back) == sorted(rows)
    assert [line[0] for f in files for line in csv.reader(f.read_text("utf-8-sig").splitlines(True)) if line[0] != "name"] == ["a", "b", "c"]


def test_casts_never_fail(spark):
    cases = {"1.5": (1.5, 1), " -2.9 ": (-2.9, -2), "1e3": (1000.0, 1000), "1d": (None, 7), "nan": (None, 7), "1e999": (None, 7), "1e30": (1e30, 7), "": (None, 7), None: (None, 7), "x": (None, 7)}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", casts.number(F.col("t")).alias("n"), casts.whole(F.col("t"), 7).alias("w"))
    assert {r["t"]: (r["n"], r["w"]) for r in rows.collect()} == cases


def test_paragraph_speakers(spark):
    rows = [(1, "Ann Roe: good morning to all of you", ""), (2, "and then a further paragraph follows", ""), (3, "short: one", "Bo"), (4, "a paragraph of the next speaker here", "Cy Day:"), (5, "12 March: the date of a sitting day", ""), (6, "x" * 90 + ": too far behind", "")]
    got = segments.paragraph_speakers(spark.createDataFrame([("d", *r) for r in rows], "k string, n int, t string, b string"), "k", "n", "t", "b")
    assert {r["n"]: r["speaker"] for r in got.collect()} == {1: "Ann Roe", 2: "Ann Roe", 4: "Cy Day", 5: "Cy Day", 6: "Cy Day"}


def test_joins_of_registers_hold_no_growing_table_on_the_driver(spark):
    """Every join of editions is by merge, however small Spark takes its tables for."""
    lines = spark.createDataFrame([("p", 0, "Ann Roe"), ("p", 1, "a pen given")], "url string, line_no int, line string")
    roster = spark.createDataFrame([("1", "Ann Roe", "Red", "N", "MS")], "id string, name string, party string, constituency string, role string")
    rows = n.register_editions(lines, spark.createDataFrame([("p", "Sixth", "2026-04-08")], "url string, term string, date string"), roster)
    links = spark.createDataFrame([("m", "m", 1, "/a.pdf", "register of interests")], "main string, page string, position int, href string, text string")
    days = spark.createDataFrame([("1", "2026-04-08")], "member_id string, day string")
    for df, joins in ((rows, 3), (n.register_as_of(rows, days), 7), (n.register_snapshots(links, "main", "https://site.test"), 1)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == joins


def test_xml_elements_are_freed_and_files_bounded(spark, tmp_path):
    import tracemalloc

    many = b"<l>" + b"<r><T>x</T><U>y</U></r>" * 100_000 + b"</l>"
    tracemalloc.start()
    assert sum(r == {"T": "x", "U": "y"} for r in readers.elements_with_child(many, "T")) == 100_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000  # some 64 KB of text at a time, however many rows
    rows = spark.range(250).coalesce(1).select(F.col("id").cast("string").alias("T"))
    sinks.write_xml(rows, str(tmp_path / "x"), "r", "l", most=100)
    assert len(list((tmp_path / "x").glob("part-*"))) == 3
    assert readers.xml_rows_by_child(spark, str(tmp_path / "x"), "T", ["T"]).distinct().count() == 250


def test_archives_are_shuffled_before_their_captions_are_sorted(spark):
    links = spark.createDataFrame([], "page string, position int, href string, text string, main string")
    plan = str(n.register_snapshots(links, "main", "https://site.test")._jdf.queryExecution().executedPlan())
    assert "REPARTITION_BY_COL" in plan
