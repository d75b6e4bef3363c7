"""Who a record belongs to: roster lookups and resolution.

Both lookups have one row per person, so their joins neither grow the records nor
need a hint; Spark broadcasts a roster where its size allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.people import gradeable_name, norm_name
from rollcall.functions.text import blank, first_filled, strip

ATTRIBUTES = ("name", "party", "constituency", "status")


def with_roster_key(roster: DataFrame) -> DataFrame:
    """``key``: the id where there is one, else ``name:`` and the normalised name."""
    key = F.when(~blank(F.col("id")), strip(F.col("id"))).otherwise(F.concat(F.lit("name:"), norm_name(F.col("name"))))
    return roster.withColumn("key", key)


def lookups(roster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by id, by normalised name), the last row in ``seq`` order winning."""
    keyed = with_roster_key(roster)
    info = F.struct("key", *ATTRIBUTES)
    by_id = keyed.filter(~blank(F.col("id"))).groupBy("legislature", strip(F.col("id")).alias("id")).agg(F.max_by(info, "seq").alias("info"))
    by_name = keyed.groupBy("legislature", norm_name(F.col("name")).alias("norm_name")).agg(F.max_by(info, "seq").alias("info"))
    return by_id, by_name.filter("norm_name <> ''")


def resolve(records: DataFrame, roster: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """``records`` with ``member_key`` and the roster's ``info``: by id, then by name, else under the name itself.

    A speaker that the roster does not know and that is no person's name is
    dropped; so is one whose name leaves nothing, unless ``keep_unknown``.
    """
    by_id, by_name = lookups(roster)
    marked = records.withColumns({"rid": strip(F.col("member_id")), "rname": norm_name(F.coalesce("member_name", F.lit("")))})
    one = marked.join(by_id.select(F.col("legislature"), F.col("id").alias("rid"), F.col("info").alias("by_id")), ["legislature", "rid"], "left")
    two = one.join(by_name.select("legislature", F.col("norm_name").alias("rname"), F.col("info").alias("by_name")), ["legislature", "rname"], "left")
    info = F.coalesce("by_id", "by_name")
    named = F.when(F.col("rname") != "", F.concat(F.lit("name:"), F.col("rname")))
    if keep_unknown:
        named = F.coalesce(named, F.lit("unknown"))
    key = F.when(info.isNotNull(), info["key"]).when(gradeable_name(F.col("member_name")), named)
    return two.withColumns({"info": info, "member_key": F.concat_ws(":", "legislature", key)}).filter(key.isNotNull()).drop("rid", "rname", "by_id", "by_name")


def first_attributes(resolved: DataFrame) -> DataFrame:
    """One row per member: attributes of the first record with a name, by record kind and order."""
    shown = {a: first_filled(F.col("info")[a], F.col(f"member_{a}") if a != "status" else F.lit("")) for a in ATTRIBUTES}
    value = F.struct(*[c.alias(a) for a, c in shown.items()])
    found = resolved.filter(~blank(shown["name"])).groupBy("legislature", "member_key").agg(F.min_by(value, F.struct("kind_order", "seq")).alias("a"))
    return found.select("legislature", "member_key", "a.*")


def enrich(records: DataFrame, roster: DataFrame) -> DataFrame:
    """Inline member fields, the roster's where they are blank; joined on id."""
    by_id, _ = lookups(roster)
    joined = records.join(by_id.select("legislature", F.col("id").alias("member_id"), "info"), ["legislature", "member_id"], "left")
    filled = {f"member_{a}": first_filled(F.col(f"member_{a}"), F.col("info")[a]) for a in ("name", "party", "constituency")}
    return joined.withColumns(filled).drop("info")


def union_unseen(members: DataFrame, more: DataFrame) -> DataFrame:
    """``members`` and those of ``more`` whose id is not among them."""
    return members.unionByName(more.join(members.select("legislature", "id"), ["legislature", "id"], "left_anti"))


def latest_of(rows: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    """One row per key: ``value`` of the row that is largest in ``order``."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(name))


def current_party(memberships: DataFrame) -> DataFrame:
    """Each person's party: an open membership before a closed one, then the latest start."""
    order = [F.col("until_date").isNull().alias("open"), F.col("from_date"), F.col("party")]
    return latest_of(memberships, ["person_id"], order, "party", "party")
