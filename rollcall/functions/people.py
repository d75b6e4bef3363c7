"""Names, speakers, askers, parties and roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions.text import blank, first_filled, strip

#: Words that mark a chair or an office, and groups that are no party.
CHAIR_MARKERS = (
    "speaker", "presiding officer", "llywydd", "lywydd", "chairman",
    "chairperson", "the chair", "deputy chair", "lord speaker",
    "clerk", "temporary chair",
)
NON_PARTY = (
    "independent", "independent labour", "independent conservative",
    "non-affiliated", "nonaffiliated", "no party affiliation", "none",
    "crossbench", "crossbencher", "bishops", "lord speaker",
    "speaker", "the speaker", "deputy speaker", "presiding officer",
    "deputy presiding officer", "unaffiliated", "other", "",
)
#: Titles before a name.
HONORIFICS = "mr|mrs|ms|miss|dr|sir|dame|rt|hon|the"


def norm_name(c: Column) -> Column:
    """``Surname, Mrs Forename`` and ``Mrs Forename Surname`` to ``forename surname``; letters a-z and blanks only."""
    n = F.lower(strip(c))
    comma = F.instr(n, ",")
    swapped = F.concat(strip(F.substring(n, comma + 1, F.length(n))), F.lit(" "), strip(F.substring(n, F.lit(1), comma - 1)))
    n = F.when(comma > 0, swapped).otherwise(n)
    return strip(F.regexp_replace(F.regexp_replace(n, rf"\b({HONORIFICS})\b", " "), "[^a-z ]+", " "))


def gradeable_name(c: Column) -> Column:
    """A person's name: no digit, no chair or office, two letters at least."""
    n = F.lower(strip(c))
    chair = F.lit(False)
    for marker in CHAIR_MARKERS:
        chair = chair | F.contains(n, F.lit(marker))
    return (n != "") & ~n.rlike("[0-9]") & ~chair & (F.length(F.regexp_replace(n, "[^a-z]", "")) >= 2)


def whipped_group(party: Column) -> Column:
    p = F.lower(strip(party))
    return (p != "") & ~p.isin(*NON_PARTY) & ~p.startswith("independent")


def party_at_vote(recorded: Column, roster: Column) -> Column:
    """The party on the record itself, else the roster's."""
    return first_filled(recorded, roster)


def speaker_prefix(text: Column) -> Column:
    """The speaker before the first colon: a title, or two words or more that all start with a capital; 70 characters at most."""
    prefix = strip(F.substring_index(F.coalesce(text, F.lit("")), ":", 1))
    titled = prefix.rlike(r"^(?:Mr|Mrs|Ms|Dr|Prof|Rev|Lord|Lady|Sir|Dame|The\s+(?:Speaker|Presiding Officer|Deputy Speaker|Minister|Principal Deputy Speaker))\b")
    words = F.split(prefix, r"\s+")
    capitals = (F.size(words) >= 2) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}"))
    usable = F.contains(text, F.lit(":")) & (prefix != "") & (F.length(prefix) <= 70)
    return F.when(usable & (titled | capitals), prefix).otherwise("")


def split_asker(c: Column) -> Column:
    """struct(name, party, constituency) of ``Name, MSP for Area, Party``."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda p: p != "")
    rest = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    areas = F.filter(rest, lambda p: p.rlike(r"(?i)^msp\s+for\s+.+"))
    others = F.filter(rest, lambda p: ~p.rlike(r"(?i)^msp\s+for\s+.+") & ~p.rlike(r"(?i)^msp$"))
    return F.struct(
        F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")).alias("name"),
        F.coalesce(F.try_element_at(others, F.lit(-1)), F.lit("")).alias("party"),
        F.coalesce(F.regexp_replace(F.try_element_at(areas, F.lit(-1)), r"(?i)^msp\s+for\s+", ""), F.lit("")).alias("constituency"),
    )


def current_role(profile: Column) -> Column:
    """First area of a profile's roles that is not a former one."""
    found = F.regexp_extract_all(F.coalesce(profile, F.lit("")), F.lit(r"((?:Former )?MSP for [^()]+ \((?:Constituency|Region)\))"), F.lit(1))
    now = F.try_element_at(F.filter(found, lambda r: ~r.startswith("Former")), F.lit(1))
    return F.coalesce(F.regexp_extract(now, r"MSP for (.+) \(", 1), F.lit(""))


def without_role_suffix(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?i)\s+(MS|AS|AM|AC)$", "")


def party_in_text(text: Column, parties: list[str]) -> Column:
    """A labelled ``Party: X``, else the longest known party that the text holds."""
    labelled = strip(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)party:[ ]*([^\n|]+)", 1))
    known = F.array(*[F.lit(p) for p in sorted(parties, key=lambda p: (-len(p), p))])
    held = F.filter(known, lambda p: F.contains(F.lower(text), F.lower(p)))
    return F.when(labelled != "", labelled).otherwise(F.coalesce(F.try_element_at(held, F.lit(1)), F.lit("")))


def relabelled_office(status: Column, party: Column) -> Column:
    chair = (status == "current") & (F.lower(strip(party)) == "no party affiliation")
    return F.when(chair, F.lit("Presiding Officer")).otherwise(party)


def usable_member(member_id: Column, name: Column) -> Column:
    """Junk guard: a row needs an id or a name."""
    return ~(blank(member_id) & blank(name))
