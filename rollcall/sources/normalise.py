"""Landed rows of each source to the record envelope: one projection a source.

Candidate fields are tried in order and the first that is not blank counts. A
normaliser reads columns of the landed shape (see FIXTURES.md) and returns the columns
of ``record``: data_type, member, date, text, title, metadata. Field names and labels of the
landed shapes are fixed values of the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.functions import dates, people, votes
from rollcall.functions.text import blank, first_filled, html_to_text, question_id, question_text, strip


def has(df: DataFrame, *names: str) -> list[Column]:
    """The candidate fields that the landed rows have."""
    return [F.col(n) for n in names if n.split(".")[0] in df.columns]


def pick(df: DataFrame, *names: str) -> Column:
    found = has(df, *names)
    return first_filled(*found) if found else F.lit("")


def member_of(id_: Column, name: Column, party: Column, constituency: Column, role: Column) -> Column:
    return F.struct(id_.alias("id"), name.alias("name"), party.alias("party"), constituency.alias("constituency"), role.alias("role"))


def record(df: DataFrame, data_type: str, member: Column, date: Column, text: Column, title: Column, metadata: dict[str, Column], parliament: str) -> DataFrame:
    """The envelope; text and title stripped, metadata a map of strings."""
    pairs = [x for k, c in metadata.items() for x in (F.lit(k), c.cast("string"))]
    filled = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(
        F.lit(parliament).alias("parliament"), F.lit(data_type).alias("data_type"), member.alias("member"), F.coalesce(date, F.lit("")).alias("date"),
        strip(text).alias("text"), strip(title).alias("title"), filled.alias("metadata"),
    )




def _none() -> Column:
    return F.lit("")


# ---- members (N1, N8, N13, N19) ---------------------------------------------


def uk_members(items: DataFrame, house: str, current: bool) -> DataFrame:
    role = "MP" if house == "Commons" else "Lord"
    return items.select(
        F.col("id").cast("string").alias("id"), first_filled(F.col("nameDisplayAs"), F.col("nameFullTitle")).alias("name"), first_filled(F.col("latestParty.name")).alias("party"),
        first_filled(F.col("latestHouseMembership.membershipFrom")).alias("constituency"), F.lit(role).alias("role"), F.lit("current" if current else "historical").alias("status"),
    )


def ni_members(rows: DataFrame) -> DataFrame:
    out = rows.select(
        pick(rows, "PersonId", "MemberId").alias("id"), pick(rows, "MemberName", "MemberFullDisplayName").alias("name"), pick(rows, "PartyName", "PartyOrganisation").alias("party"),
        pick(rows, "ConstituencyName", "Constituency").alias("constituency"), F.lit("MLA").alias("role"), F.lit("current").alias("status"),
    )
    return out.dropDuplicates(["id"])


def ni_members_or_derived(rows: DataFrame, interests: DataFrame) -> DataFrame:
    """The roster; where none landed, the distinct people named in the interests."""
    primary = ni_members(rows).withColumn("rank", F.lit(0))
    derived = ni_members(interests.filter(~blank(F.col("MemberName")))).withColumn("rank", F.lit(1))
    both = primary.unionByName(derived)
    return both.join(both.agg(F.min("rank").alias("rank")), "rank", "left_semi").drop("rank")


def scottish_members(rows: DataFrame) -> DataFrame:
    """``Surname, Forename`` swapped; the party of the membership that started last."""
    name = F.col("ParliamentaryName")
    swapped = F.when(F.contains(name, F.lit(",")), F.concat(strip(F.substring_index(name, ",", -1)), F.lit(" "), strip(F.substring_index(name, ",", 1)))).otherwise(strip(name))
    latest = F.element_at(F.sort_array(F.transform("MemberParties", lambda m: F.struct(m["ValidFromDate"], m["PartyName"]))), -1)["PartyName"]
    return rows.select(
        F.col("PersonID").cast("string").alias("id"), swapped.alias("name"), F.when(F.size("MemberParties") > 0, first_filled(latest)).otherwise("").alias("party"),
        pick(rows, "ConstituencyName").alias("constituency"), F.lit("MSP").alias("role"), F.when(F.col("IsCurrent"), "current").otherwise("historical").alias("status"),
    )


def scottish_parties(members: DataFrame, memberships: DataFrame, parties: DataFrame) -> DataFrame:
    """Blank parties filled from memberships and the party list: an open membership first, then the latest start.

    Memberships are grouped by the id as it landed, so those that a join has sorted by it are not shuffled and sorted again.
    """
    named = memberships.join(parties.select(F.col("ID").alias("PartyID"), "PartyName"), "PartyID")
    order = F.struct(F.col("ValidUntilDate").isNull(), F.col("ValidFromDate"), F.col("PartyName"))
    best = named.groupBy("PersonID").agg(F.max_by("PartyName", order).alias("found")).select(F.col("PersonID").cast("string").alias("id"), "found")
    return members.join(best, "id", "left").withColumn("party", first_filled(F.col("party"), F.col("found"))).drop("found")


def profile_links(members: DataFrame, websites: DataFrame) -> DataFrame:
    """Each member's profile address, the default link before others."""
    best = websites.groupBy("PersonID").agg(F.max_by("WebURL", F.struct("IsDefault", "WebURL")).alias("profile_url")).select(F.col("PersonID").cast("string").alias("id"), "profile_url")
    return members.join(best, "id", "left")


def welsh_members(wards: DataFrame) -> DataFrame:
    each = wards.select(F.col("wardtitle").alias("constituency"), F.explode("councillor").alias("c"))
    out = each.select(
        F.col("c.councillorid").cast("string").alias("id"), people.without_role_suffix(F.col("c.fullusername")).alias("name"), first_filled(F.col("c.politicalpartytitle")).alias("party"),
        "constituency", F.lit("MS").alias("role"), F.lit("current").alias("status"),
    )
    return out.dropDuplicates(["id"])


# ---- registered interests (N2, N9, N14) --------------------------------------


def uk_interests(categories: DataFrame, member: Column, status: Column) -> DataFrame:
    """Two levels, category then interest; blank texts and historical members go."""
    each = categories.filter(status == "current").withColumn("i", F.explode("interests"))
    return record(
        each.filter(~blank(first_filled(F.col("i.interest"), F.col("i.description")))), "register_of_interests", member, F.substring(first_filled(F.col("i.createdWhen"), F.col("i.lastAmendedWhen")), 1, 10),
        first_filled(F.col("i.interest"), F.col("i.description")), F.col("name"), {"category": F.col("name"), "interest_id": F.col("i.id"), "registered_late": F.col("i.registeredLate")}, "UK Parliament",
    )


def ni_interests(rows: DataFrame, roster: DataFrame) -> DataFrame:
    """Joined to the roster by id, inline fields where it does not know them."""
    known = roster.select(F.col("id").alias("PersonId"), F.struct("id", "name", "party", "constituency", "role").alias("known"))
    joined = rows.withColumn("PersonId", F.col("PersonId").cast("string")).join(known, "PersonId", "left")
    inline = member_of(F.coalesce("PersonId", F.lit("")), pick(rows, "MemberName"), pick(rows, "PartyName"), _none(), F.lit("MLA"))
    text = pick(joined, "RegisterEntry", "InterestDescription", "Description", "Interest")
    return record(
        joined.filter(~blank(text)), "register_of_interests", F.coalesce("known", inline), F.substring(pick(joined, "RegisterEntryStartDate"), 1, 10), text, pick(joined, "RegisterCategory"),
        {"category": pick(joined, "RegisterCategory"), "interest_id": pick(joined, "RegisterCategoryId")}, "Northern Ireland Assembly",
    )


def scottish_interests(rows: DataFrame, roster: DataFrame) -> DataFrame:
    """Roster by id, then by lower-case name, else the inline fields."""
    info = F.struct("id", "name", "party", "constituency", "role")
    by_id = roster.select(F.col("id").alias("PersonID"), info.alias("one"))
    by_name = roster.groupBy(F.lower("name").alias("lower")).agg(F.min(info).alias("two"))
    joined = rows.withColumn("PersonID", F.col("PersonID").cast("string")).withColumn("lower", F.lower(pick(rows, "MemberName"))).join(by_id, "PersonID", "left").join(by_name, "lower", "left")
    inline = member_of(F.coalesce("PersonID", F.lit("")), pick(rows, "MemberName"), _none(), _none(), F.lit("MSP"))
    text = pick(joined, "Description", "InterestText")
    return record(joined.filter(~blank(text)), "register_of_interests", F.coalesce("one", "two", inline), dates.extract_date(text), text, pick(joined, "Category"), {"category": pick(joined, "Category")}, "Scottish Parliament")


# ---- questions (N3, N10, N16, N21, N26) --------------------------------------


def uk_questions(rows: DataFrame, roster: DataFrame, seq: str = "seq") -> DataFrame:
    """First row of each question id; the asking member inline, else from the roster."""
    columns = rows.columns
    first = rows.groupBy("id").agg(F.min_by(F.struct(*columns), seq).alias("r")).select(*[F.col("r")[c].alias(c) for c in columns])
    known = roster.select(F.col("id").alias("askingMemberId"), F.struct("id", "name", "party", "constituency", "role").alias("known"))
    joined = first.withColumn("askingMemberId", F.col("askingMemberId").cast("string")).join(known, "askingMemberId", "left")
    a = F.col("askingMember")
    inline = member_of(F.col("askingMemberId"), first_filled(a["name"], a["listAs"]), first_filled(a["party"]), first_filled(a["memberFrom"]), F.lit("MP"))
    member = F.when(~blank(first_filled(a["name"], a["listAs"])), inline).otherwise(F.coalesce("known", inline))
    return record(
        joined, "question", member, F.substring("tabledWhen", 1, 10), question_text(F.col("questionText"), F.col("answerText")), F.col("heading"),
        {"question_id": F.col("id"), "question_type": F.lit("written"), "answering_body": F.col("answeringBodyName"), "answer_date": F.substring("dateAnswered", 1, 10), "is_withdrawn": F.col("isWithdrawn"), "answer_text": F.col("answerText")}, "UK Parliament",
    )


def ni_questions(oral: DataFrame, written: DataFrame) -> DataFrame:
    def one(rows: DataFrame, kind: str) -> DataFrame:
        asked, answer = pick(rows, "QuestionText", "Question"), pick(rows, "AnswerText", "AnswerPlainText")
        member = member_of(pick(rows, "TablerPersonId", "MemberId"), pick(rows, "TablerName", "MemberName"), pick(rows, "PartyName"), pick(rows, "ConstituencyName"), F.lit("MLA"))
        meta = {"question_id": pick(rows, "DocumentId", "Reference"), "question_type": F.lit(kind), "minister": pick(rows, "MinisterName", "MinisterTitle"), "department": pick(rows, "DepartmentName"), "answer_text": answer}
        return record(rows, "question", member, F.substring(pick(rows, "TabledDate", "Date"), 1, 10), question_text(asked, answer), pick(rows, "Reference"), meta, "Northern Ireland Assembly")

    return one(oral, "oral").unionByName(one(written, "written"))


def question_and_answer(pairs: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """Up to two rows a pair: the question and the answer, each of ``least`` characters or more."""
    both = F.array(F.struct(F.lit("question").alias("qa_role"), F.trim("question").alias("text")), F.struct(F.lit("answer").alias("qa_role"), F.trim("answer").alias("text")))
    each = pairs.select(*keys, F.explode(F.filter(both, lambda r: F.length(r["text"]) >= least)).alias("r"))
    return each.select(*keys, "r.qa_role", "r.text")


def scottish_cards(cards: DataFrame, start: str = "") -> DataFrame:
    """Labelled card texts to question and answer rows; cards lodged before ``start`` go, the answer's date falls back to the lodged one."""
    t = F.col("text")
    asked = people.split_asker(F.regexp_extract(t, r"Asked by: ([^\n]+)", 1))
    lodged = dates.extract_date(F.regexp_extract(t, r"Date lodged: ([^\n]+)", 1))
    status = F.regexp_extract(t, r"(?i)Answered by\s+(.+?)\s+on\s+\d{1,2}\s+\w+\s+\d{4}", 1)
    answered = dates.extract_date(F.regexp_extract(t, r"(?i)Answered by\s+.+?\s+on\s+(\d{1,2}\s+\w+\s+\d{4})", 1))
    marked = cards.select(
        F.regexp_extract(t, r"Question reference: (S\d+\w-\d+)", 1).alias("question_ref"), asked.alias("asker"), lodged.alias("lodged"), status.alias("answered_by"),
        first_filled(answered, lodged).alias("answered"), F.regexp_extract(t, r"(?s)Question\n(.*?)(?:\nAnswer\n|$)", 1).alias("question"), F.regexp_extract(t, r"(?s)\nAnswer\n(.*)$", 1).alias("answer"),
    ).filter((F.col("lodged") == "") | (F.col("lodged") >= start))
    each = question_and_answer(marked, ["question_ref", "asker", "lodged", "answered_by", "answered"])
    is_question = F.col("qa_role") == "question"
    asker = member_of(_none(), F.col("asker.name"), F.col("asker.party"), F.col("asker.constituency"), F.lit("MSP"))
    answerer = member_of(_none(), F.col("answered_by"), _none(), _none(), F.lit("MSP"))
    meta = {"question_ref": F.col("question_ref"), "qa_role": F.col("qa_role"), "answered_by": F.col("answered_by"), "asked_by": F.col("asker.name")}
    return record(each, "question", F.when(is_question, asker).otherwise(answerer), F.when(is_question, F.col("lodged")).otherwise(F.col("answered")), F.col("text"), F.col("question_ref"), meta, "Scottish Parliament")


def welsh_questions(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Order-paper or search rows: id normalised, first of each id, day-first dates in the label, blank texts dropped."""
    qid = question_id(pick(rows, "questionId", "id"))
    member = member_of(pick(rows, "memberId"), people.without_role_suffix(pick(rows, "memberName", "MemberName", "tabledBy", "askedBy", "author")), pick(rows, "party"), pick(rows, "constituency"), F.lit("MS"))
    date = dates.day_first(F.regexp_extract(pick(rows, "label", "date"), r"(\d{1,2}/\d{1,2}/\d{4})", 1))
    answer = pick(rows, "answer", "answerText")
    full = rows.withColumns({"qid": qid, "asked": pick(rows, "question", "questionText", "text")}).filter("asked <> ''")
    kept = full.groupBy("qid").agg(F.min_by(F.struct(*full.columns), seq).alias("r")).select(*[F.col("r")[c].alias(c) for c in full.columns])
    return record(kept, "question", member, date, question_text(F.col("asked"), answer), F.col("qid"), {"question_id": F.col("qid"), "answer_text": answer}, "Welsh Parliament")


# ---- plenary (N4, N5, N6, N11, N17, N22) ---------------------------------------


def uk_contributions(rows: DataFrame, roster: DataFrame, kind: str = "spoken", least: int = 3) -> DataFrame:
    text = html_to_text(pick(rows, "ContributionTextFull", "ContributionText", "Value", "text"))
    known = roster.select(F.col("id").alias("MemberId"), F.struct("id", "name", "party", "constituency", "role").alias("known"))
    joined = rows.withColumn("MemberId", F.col("MemberId").cast("string")).withColumn("body", text).filter(F.length("body") >= least).join(known, "MemberId", "left")
    shown = first_filled(*has(joined, "AttributedTo", "MemberName"), F.col("known.name"))
    member = member_of(F.coalesce("MemberId", F.lit("")), shown, first_filled(F.col("known.party")), first_filled(F.col("known.constituency")), F.lit("MP"))
    meta = {"contribution_id": pick(rows, "ContributionExtId"), "debate_section": pick(rows, "DebateSection"), "debate_ext_id": pick(rows, "DebateSectionExtId"), "house": pick(rows, "House"), "contribution_type": F.lit(kind)}
    return record(joined, "plenary_speech", member, F.substring(pick(rows, "SittingDate", "dateMade"), 1, 10), F.col("body"), pick(rows, "DebateSection", "title"), meta, "UK Parliament")


def uk_statements(rows: DataFrame, roster: DataFrame, start: str) -> DataFrame:
    """Written statements from ``start`` on."""
    return uk_contributions(rows, roster, "written_statement").filter(F.col("date") >= start)


def uk_plenary(spoken: DataFrame, written: DataFrame) -> DataFrame:
    return spoken.unionByName(written)


def ni_components(rows: DataFrame, key: str, order: str, least: int = 10) -> DataFrame:
    """Report components in order: short ones go, the speaker is the field, a header that is no time, or a prefix; then carried forward."""
    from rollcall.operators.segments import carry_speaker

    full = rows.filter(F.length(pick(rows, "ComponentText", "Text")) >= least)
    header = pick(rows, "ComponentHeader")
    named = first_filled(*has(rows, "MemberName", "Speaker"), F.when(~header.rlike(r"^\d{1,2}[:.]\d{2}") & (F.length(header) < 80), header), people.speaker_prefix(pick(rows, "ComponentText", "Text")))
    heading = F.lower(pick(rows, "ComponentType")).rlike("header|heading|agenda")
    carried = carry_speaker(full.withColumn("named", named), key, order, "named", heading)
    member = member_of(pick(rows, "PersonId"), F.col("carried"), _none(), _none(), F.lit("MLA"))
    return record(carried, "plenary_speech", member, pick(rows, "PlenaryDate", "ReportDate"), pick(rows, "ComponentText", "Text"), pick(rows, "ComponentTitle"), {"report_id": F.col(key), "component_id": pick(rows, "ComponentId")}, "Northern Ireland Assembly")


SPEAKER_LINE = r"^([^():]{3,69}) \(([^()]+)\)(?: \(([^()]+)\))?: ?(.*)$"


def scottish_report(lines: DataFrame, key: str) -> DataFrame:
    """Report lines to contributions: running dates and column numbers go, each ``Name (Area) (Party):`` line opens one."""
    from rollcall.operators.segments import speech_segments

    noise = F.col("line").rlike(r"^(?:\d{1,4}|\d{1,2} [A-Z]+ \d{4}.*)$")
    speaker = F.when(F.col("line").rlike(SPEAKER_LINE), F.regexp_extract("line", SPEAKER_LINE, 1))
    out = speech_segments(lines.filter(~noise), key, speaker)
    return out.withColumn("text", strip(F.regexp_replace("text", r"^[^():]{3,69} \([^()]+\)(?: \([^()]+\))?: ?", "")))


def welsh_transcripts(rows: DataFrame, start: str, to: str, least: int = 3) -> DataFrame:
    body = html_to_text(pick(rows, "Contribution_English", "contribution"))
    date = F.substring(pick(rows, "MeetingDate"), 1, 10)
    kept = rows.withColumns({"body": body, "day": date}).filter((F.length("body") >= least) & ((F.col("day") == "") | F.col("day").between(start, to)))
    member = member_of(pick(rows, "Member_Id"), people.without_role_suffix(pick(rows, "Member_name_English")), _none(), _none(), F.lit("MS"))
    return record(kept, "plenary_speech", member, F.col("day"), F.col("body"), pick(rows, "Agenda_item_english"), {"meeting_id": pick(rows, "Meeting_Id"), "contribution_type": pick(rows, "contribution_type")}, "Welsh Parliament")


# ---- votes (N7, N12, N18, N23) -------------------------------------------------


def vote_lists(divisions: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Three lists a division (ayes, noes, no_vote_recorded) to a row a vote."""
    sides = F.array(*[F.struct(F.lit(d).alias("direction"), F.filter(c, lambda m: m.isNotNull()).alias("who")) for d, c in (("aye", "ayes"), ("no", "noes"), ("no_vote", "no_vote_recorded"))])
    each = divisions.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.direction", F.explode("s.who").alias("m"))
    return each.select(*keys, "direction", *[F.col("m")[f].alias(f) for f in fields])


def uk_votes(divisions: DataFrame) -> DataFrame:
    shaped = divisions.withColumnsRenamed({"Ayes": "ayes", "Noes": "noes", "NoVoteRecorded": "no_vote_recorded"})
    result = votes.division_result(F.col("AyeCount"), F.col("NoeCount"))
    keyed = shaped.withColumn("result", result)
    each = vote_lists(keyed, ["DivisionId", "Title", "Date", "AyeCount", "NoeCount", "result"], ["MemberId", "Name", "Party"])
    member = member_of(F.col("MemberId").cast("string"), first_filled(F.col("Name")), first_filled(F.col("Party")), _none(), F.lit("MP"))
    meta = {"division_id": F.col("DivisionId"), "vote_direction": F.col("direction"), "division_result": F.col("result"), "ayes": F.col("AyeCount"), "noes": F.col("NoeCount")}
    return record(each, "vote", member, F.substring("Date", 1, 10), F.concat(F.lit("Voted "), "direction", F.lit(" on: "), "Title"), F.col("Title"), meta, "UK Parliament")


def ni_votes(divisions: DataFrame) -> DataFrame:
    """A row a vote; a division without any gives one placeholder."""
    each = divisions.withColumn("m", F.explode_outer("MemberVoting"))
    direction = F.when(F.col("m").isNull(), F.lit("unknown")).otherwise(votes.direction(F.col("m.VoteType")))
    member = member_of(first_filled(F.col("m.PersonID").cast("string")), first_filled(F.col("m.MemberName")), first_filled(F.col("m.PartyName")), _none(), F.lit("MLA"))
    meta = {"division_id": first_filled(F.col("DocumentID").cast("string"), F.col("EventID").cast("string")), "vote_direction": direction, "division_result": F.col("DivisionResult")}
    return record(each, "vote", member, F.substring("DivisionDate", 1, 10), F.concat(F.lit("Voted "), direction, F.lit(" on: "), "DivisionSubject"), F.col("DivisionSubject"), meta, "Northern Ireland Assembly")


def scottish_votes(rows: DataFrame) -> DataFrame:
    """Roll-call rows; the member's id is the last part of the profile address."""
    direction = votes.direction(F.col("vote"))
    member = member_of(F.regexp_extract("profile_url", r"/([^/?#]+)/?(?:[?#].*)?$", 1), first_filled(F.col("name")), pick(rows, "party"), _none(), F.lit("MSP"))
    meta = {"vote_direction": direction, "division_result": pick(rows, "result"), "motion_ref": pick(rows, "motion_ref")}
    return record(rows, "vote", member, dates.vote_date(F.col("page_text")), F.concat(F.lit("Voted "), direction, F.lit(" on: "), "title"), F.col("title"), meta, "Scottish Parliament")


def welsh_votes(rows: DataFrame) -> DataFrame:
    direction = votes.direction(F.col("Results_Result"))
    motion = pick(rows, "Vote_Name_English", "Vote_Name")
    member = member_of(pick(rows, "Member_Id"), people.without_role_suffix(pick(rows, "Member_name_English")), _none(), _none(), F.lit("MS"))
    meta = {
        "division_id": pick(rows, "Contribution_ID"), "vote_direction": direction, "division_result": pick(rows, "Vote_Result_English"), "ayes": pick(rows, "VotesTotalFor"), "noes": pick(rows, "VotesTotalAgainst"),
        "abstentions": pick(rows, "VotesTotalAbstain"), "meeting_id": pick(rows, "Meeting_Id"),
    }
    return record(rows, "vote", member, F.substring(pick(rows, "MeetingDate"), 1, 10), F.concat(F.lit("Voted "), direction, F.lit(" on: "), motion), motion, meta, "Welsh Parliament")


# ---- registers and listings (N15, N20, N24, N25) --------------------------------


def register_text(lines: DataFrame, key: str, label: str, snapshot: Column | None = None, boilerplate: str = r"^(?:\d{1,4}|Page \d+.*|Register of .*)$") -> DataFrame:
    """Register lines to entries: ``label`` opens a member (name on the line or the next), ``1. Category`` a category.

    An entry's date is the one in its text, else ``snapshot``, which is then flagged.
    """
    from rollcall.operators.segments import register_entries

    line = F.col("line")
    after = strip(F.regexp_extract(line, rf"^(?:{label}):?\s*(.*)$", 1))
    owner = F.when(line.rlike(rf"^(?:{label})"), F.when(after == "", F.lit("name:")).otherwise(people.without_role_suffix(after)))
    category = F.when(line.rlike(r"^\d{1,2}\. \S"), line)
    found = register_entries(lines, key, owner, category, line.rlike(boilerplate))
    own = dates.extract_date(F.col("text"))
    asof = snapshot if snapshot is not None else F.lit("")
    return found.withColumns({"owner": people.without_role_suffix(F.col("owner")), "date": first_filled(own, asof), "date_is_snapshot_fallback": (own == "") & (asof != "")})


def absolute(base: Column, href: Column) -> Column:
    """``href`` as an address under the site ``base``."""
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(base, href)).otherwise(F.concat(base, F.lit("/"), href))
    )


def register_snapshots(links: DataFrame, main: str, base: str) -> DataFrame:
    """Editions (url, term, date) that the links (page, position, href, text) of register pages lead to.

    ``main`` names the column with the page from which each row's site starts. A PDF linked there is an edition
    without a date; any other page of the site ``base`` linked there is an archive, whose register PDFs are editions of
    its term, dated by "as on D Month YYYY". An archive linked twice counts once, under its first caption.
    """
    site = F.lit(base)
    own = links.filter(F.col("href") != "").withColumn("url", absolute(site, F.col("href")))
    both = F.lower(F.concat(F.col("href"), F.lit(" "), F.col("text")))
    told = own.filter((F.col("page") == F.col(main)) & F.contains(both, F.lit("register")) & F.contains(both, F.lit("interest")))
    pdf = F.lower("href").endswith(".pdf")
    direct = told.filter(pdf).select("url", F.col("text").alias("term"), F.lit("").alias("date"))
    host = F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1))
    home = F.lower(F.regexp_extract(site, r"^https?://([^/?#]+)", 1))
    archives = told.filter(~pdf & ((host == home) | F.endswith(host, F.concat(F.lit("."), home))))
    shared = archives.select(F.col("url").alias("page"), "text", "position").repartition("page")  # texts are grouped by sorting: not all those of one file's task
    first = shared.groupBy("page").agg(F.min_by("text", "position").alias("term"))
    listed = own.filter(F.contains("href", F.lit(".pdf")) & F.contains(both, F.lit("register"))).join(first.hint("merge"), "page")
    return direct.unionByName(listed.select("url", "term", dates.snapshot_date(F.col("text")).alias("date")))


def register_editions(lines: DataFrame, editions: DataFrame, roster: DataFrame, least: int = 5) -> DataFrame:
    """Lines (url, line_no, line) of many dated editions (url, term, date) to records, with their ``url``.

    A line that is a roster name, with or without a role behind it, opens a member, a numbered one a category;
    what stands before the first member goes. An entry's date is the one in its text, else its edition's, which
    is then flagged; term and edition go along. Rosters and editions grow with the registers, and Spark takes those that
    are made from narrow tables for smaller than they are, so the joins are by merge and the driver holds neither.
    """
    info = F.struct("id", "name", "party", "constituency", "role")
    known = roster.filter("name <> ''").groupBy(F.lower(strip(F.col("name"))).alias("known")).agg(F.max_by(info, "id").alias("found"))
    bare = F.lower(people.without_role_suffix(F.col("line")))
    clean = lines.withColumn("line", strip(F.col("line"))).filter("line <> ''").withColumn("bare", bare).withColumn("whole", F.lower("line"))
    by_line = clean.join(known.select(F.col("known").alias("whole"), F.col("found").alias("one")).hint("merge"), "whole", "left")
    marked = by_line.join(known.select(F.col("known").alias("bare"), F.col("found").alias("two")).hint("merge"), "bare", "left").withColumn("who", F.coalesce("one", "two"))
    pattern = r"^(\d{1,2})[.)]\s+(.{3,120})$"
    heading = F.when(F.col("who").isNull() & F.col("line").rlike(pattern), strip(F.regexp_extract("line", pattern, 2)))
    order = Window.partitionBy("url").orderBy("line_no")
    named = marked.withColumn("heading", heading).withColumn("person", F.sum(F.col("who").isNotNull().cast("int")).over(order))
    opens = (F.col("who").isNotNull() | F.col("heading").isNotNull()).cast("int")
    within = Window.partitionBy("url", "person").orderBy("line_no")
    filled = named.withColumns({"entry": F.sum(opens).over(order), "member": F.last("who", ignorenulls=True).over(within), "category": F.last("heading", ignorenulls=True).over(within)})
    body = filled.filter("person > 0 AND who IS NULL AND heading IS NULL")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")
    entries = body.groupBy("url", "entry").agg(F.first("member").alias("member"), F.first(F.coalesce("category", F.lit(""))).alias("category"), joined.alias("text"))
    each = entries.filter(F.length("text") >= least).join(editions.withColumnRenamed("date", "edition").hint("merge"), "url").withColumn("own", dates.extract_date(F.col("text")))
    fallback = (F.col("own") == "") & (F.col("edition") != "")
    meta = {"source_format": F.lit("pdf"), "term": F.col("term"), "register_snapshot_date": F.col("edition"), "date_is_snapshot_fallback": fallback, "url": F.col("url")}
    found = record(each, "register_of_interests", F.col("member"), first_filled(F.col("own"), F.col("edition")), F.col("text"), F.col("category"), meta, "Welsh Parliament")
    return found.withColumn("url", F.col("metadata")["url"])


def register_as_of(records: DataFrame, days: DataFrame) -> DataFrame:
    """For each of ``days`` (member_id, day) the records of the member's latest dated edition on or before that day, with the ``day``."""
    edition = F.col("metadata")["register_snapshot_date"]
    dated = records.filter(edition != "").select(F.col("member.id").alias("member_id"), edition.alias("day"), edition.alias("edition")).distinct()
    asked = days.select("member_id", "day", F.lit(None).cast("string").alias("edition"))
    order = Window.partitionBy("member_id").orderBy("day", F.col("edition").isNull())  # an edition of the day itself counts
    line = dated.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
    latest = line.withColumn("edition", F.last("edition", ignorenulls=True).over(order)).filter("asks AND edition IS NOT NULL").select("member_id", "day", "edition")
    return records.withColumns({"member_id": F.col("member.id"), "edition": edition}).join(latest.hint("merge"), ["member_id", "edition"]).drop("member_id", "edition")


def meeting_listing(rows: DataFrame, start: str, to: str) -> DataFrame:
    """Plenary rows of a listing: id, date, has_votes; once an id (its last row), within the dates, newest first."""
    link = F.element_at("links", 1)
    each = rows.filter(F.contains(F.lower("text"), F.lit("plenary"))).select(
        "seq", F.regexp_extract(link, r"meetingID=(\d+)", 1).alias("id"), dates.day_first(F.regexp_extract("text", r"(\d{2}/\d{2}/\d{4})", 1)).alias("date"),
        F.exists("links", lambda x: F.contains(x, F.lit("xmlDownloadType=Votes"))).alias("has_votes"),
    ).filter("id <> ''")
    one = each.groupBy("id").agg(F.max_by("date", "seq").alias("date"), F.bool_or("has_votes").alias("has_votes"))
    return one.filter((F.col("date") == "") | F.col("date").between(start, to)).orderBy(F.desc("date"), "id")


def meeting_links(pages: DataFrame, pattern: str = r"/meeting-of-parliament-(\d{2}-\d{2}-\d{4})\?meeting=(\d+)") -> DataFrame:
    """Plenary links in pages: id and date, the last link of an id winning."""
    dated = F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    ids = F.regexp_extract_all("html", F.lit(pattern), F.lit(2))
    each = pages.select(F.posexplode(F.arrays_zip(ids.alias("id"), dated.alias("day"))).alias("pos", "x"))
    return each.groupBy(F.col("x.id").alias("id")).agg(F.max_by("x.day", "pos").alias("day")).select("id", dates.day_first(F.col("day")).alias("date")).orderBy(F.desc("date"))
