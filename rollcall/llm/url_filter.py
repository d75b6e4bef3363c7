"""URL filtering: a list of rules, then association rules mined from its decisions.

A URL that the list decides is a labelled one; the others are its background. Spark's
FP-growth mines combinations of URL tokens among the blocked ones. A rule needs a number of
blocked URLs (support), has to hold among labelled URLs (confidence), and must be blocked more
often than comparable URLs are (lift): of URLs under one top-level domain a certain share is
blocked, and the URLs with a rule's tokens must exceed what their domains make of them. So
what is merely usual on the web is no rule. Combinations that restate a whole rule of the list,
or decide no open URL, are left out, and so are those that a more general rule covers. Rules are
a table under an inverted index: each is filed under its rarest token, and meets the URLs that
have this token by an equal join, in mining and in judging alike.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import Scratch, fresh

Rule = tuple[str, str, str]  # host, path, verdict

#: Fixed values of the contract.
RULES: tuple[Rule, ...] = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if null or without ``://``."""
    after = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.contains(url, F.lit("://")), host).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    after = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def listed(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; its fields are null where none does."""
    found, first = None, sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    for h, p, verdict in first:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, top-level domain, path segments that are no numbers, query names."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    top = F.array(F.concat(F.lit("top:"), F.substring_index(host, ".", -1)))
    parts = F.transform(F.filter(F.split(path, r"[/.]"), lambda x: (x != "") & ~x.rlike(r"^[0-9]+$")), lambda x: F.concat(F.lit("path:"), x))
    names = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("query:"), x))
    return F.array_distinct(F.concat(labels, top, parts, names))


def restated(rules: tuple[Rule, ...]) -> list[list[str]]:
    """The tokens of each blocking rule of the list, as a whole."""
    return [sorted({f"host:{x}" for x in h.split(".") if x} | {f"path:{x}" for x in p.replace(".", "/").split("/") if x}) for h, p, verdict in rules if verdict == "block"]


def _stand_ins(blocked: DataFrame) -> DataFrame:
    """(token, same): tokens that occur in the very same rows have one stand-in, so that long fixed parts of URLs don't multiply itemsets."""
    each = blocked.select(F.explode("tokens").alias("token"), F.xxhash64("tokens").alias("row"))
    alike = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("row").cast("decimal(20,0)")).alias("rows"), F.bit_xor("row").alias("mixed"))
    first = alike.groupBy("n", "rows", "mixed").agg(F.min("token").alias("same"))
    return alike.join(first, ["n", "rows", "mixed"]).select("token", "same")


def _filed(itemsets: DataFrame, tokens: DataFrame) -> DataFrame:
    """``itemsets`` (items, ...) with ``anchor``: the item with the fewest rows in ``tokens`` (token, n), the first on ties."""
    each = itemsets.select("items", F.explode("items").alias("token")).join(tokens, "token")
    anchors = each.groupBy("items").agg(F.min_by("token", F.struct("n", "token")).alias("anchor"))
    return itemsets.join(anchors, "items")


def _holding(rows: DataFrame, filed: DataFrame) -> DataFrame:
    """Each row of ``rows`` (tokens, ...) beside each of ``filed`` (items, anchor, ...) whose items are among its tokens."""
    met = rows.withColumn("anchor", F.explode("tokens")).join(filed, "anchor")
    return met.filter(F.size(F.array_except("items", "tokens")) == 0)


def mine(urls: DataFrame, scratch: Scratch, least_count: int = 10, least_confidence: float = 0.9, least_lift: float = 1.3, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Pruned rules (items, anchor, blocked, labelled, every, lift), from ``tokens``, ``family`` and ``verdict`` (block, allow, or null for open).

    A rule has ``least_count`` blocked URLs at least, the same number at every size of the table. Its lift is their
    number over the number that is expected of its URLs by the share of blocked URLs in each one's family.
    Rows count as often as they occur.
    """
    spark = urls.sparkSession
    empty = spark.createDataFrame([], "items array<string>, anchor string, blocked long, labelled long, every long, lift double")
    alike = urls.groupBy("tokens", "family", "verdict").agg(F.count("*").alias("n"))
    alike = scratch.cut(alike, "urls")
    blocked = alike.filter("verdict = 'block'")
    n_blocked = blocked.agg(F.sum("n")).first()[0] or 0
    if n_blocked < least_count:
        return empty
    same = scratch.cut(_stand_ins(blocked), "stand_ins")
    # the list's own tokens, by their stand-ins
    listed_tokens = sorted({t for whole in restated(rules) for t in whole})
    named = {r["token"]: r["same"] for r in same.filter(F.col("token").isin(listed_tokens)).collect()}
    each = blocked.withColumn("row", F.xxhash64("tokens", "family")).select("row", "n", F.explode("tokens").alias("token"))
    baskets = each.join(same.filter("token = same").select("token"), "token").groupBy("row", "n").agg(F.sort_array(F.collect_set("token")).alias("items"))
    baskets = scratch.cut(baskets.select("items", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("items"), "baskets")
    # itemsets and no rules are asked for; the support is a share of the baskets
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (least_count - 0.5) / max(1, baskets.count())), minConfidence=1.0).fit(baskets).freqItemsets
    itemsets = found.select(F.sort_array("items").alias("items"))
    for whole in restated(rules):
        if all(t in named for t in whole):
            restates = F.size(F.array_except(F.array(*[F.lit(named[t]) for t in whole]), F.col("items"))) == 0
            itemsets = itemsets.filter(~restates)
    tokens = scratch.cut(alike.select("n", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("n").alias("n")), "tokens")
    filed = scratch.cut(_filed(scratch.cut(itemsets, "itemsets"), tokens), "filed")
    block, label = F.when(F.col("verdict") == "block", F.col("n")), F.when(F.col("verdict").isNotNull(), F.col("n"))
    tally = [F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in ((block, "blocked"), (label, "labelled"), (F.col("n"), "every"))]
    families = alike.groupBy("family").agg(*tally).select("family", (F.col("blocked") / F.col("every")).alias("share"))
    counted = _holding(alike, filed).groupBy("items", "anchor", "family").agg(*tally)
    whole = counted.join(families, "family").groupBy("items", "anchor").agg(*[F.sum(c).alias(c) for c in ("blocked", "labelled", "every")], F.sum(F.col("every") * F.col("share")).alias("expected"))
    strong = whole.withColumn("lift", F.col("blocked") / F.col("expected")).filter(
        (F.col("blocked") >= least_count) & (F.col("blocked") >= least_confidence * F.col("labelled")) & (F.col("lift") >= least_lift) & (F.col("every") > F.col("labelled"))
    )
    strong = scratch.cut(strong.select("items", "anchor", "blocked", "labelled", "every", "lift"), "strong")
    general = strong.select(F.col("items").alias("fewer"), "anchor", (F.col("blocked") / F.col("labelled")).alias("held"))
    own = strong.select("items", "blocked", "labelled", F.explode("items").alias("anchor"))
    covered = own.join(general, "anchor").filter(
        (F.size("fewer") < F.size("items")) & (F.size(F.array_except("fewer", "items")) == 0) & (F.col("held") >= F.col("blocked") / F.col("labelled"))
    )
    return scratch.cut(strong.join(covered.select("items").distinct(), "items", "left_anti").select(*strong.columns), "rules")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, least_count: int = 10, least_confidence: float = 0.9, least_lift: float = 1.3, into: str = "filtered") -> DataFrame:
    """``pages`` with a struct column ``into`` (host, path, rule, verdict).

    Null or malformed URLs have an empty host and path, fit no rule and are allowed. With fewer blocked URLs than
    ``least_count`` nothing is mined. Repeated rows are judged alike, and count as often as they occur; an
    empty table gives no rows. Other columns pass through; where one is called ``into``, the new column's name gets
    an underscore. The result reads a table in the shared folder.
    """
    name, own, hit_ = fresh(pages, into), fresh(pages, "own_tokens"), fresh(pages, "hit_tokens")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    by_list = listed(host, path, rules)
    tokens = F.sort_array(tokens_of(F.col("url"), host, path))
    with Scratch(pages.sparkSession) as scratch:
        shaped = pages.select(tokens.alias("tokens"), F.substring_index(host, ".", -1).alias("family"), by_list["verdict"].alias("verdict"))
        mined = mine(shaped, scratch, least_count, least_confidence, least_lift, rules)
        open_ = shaped.filter("verdict IS NULL").select("tokens").distinct()
        hit = scratch.keep(_holding(open_, mined.select("items", "anchor")).select(F.col("tokens").alias(hit_)).distinct(), "hits")

    def judged(verdict: Column) -> Column:
        return F.struct(host.alias("host"), path.alias("path"), by_list["rule"].alias("rule"), verdict.alias("verdict")).alias(name)

    decided = by_list["verdict"].isNotNull()
    known = pages.filter(decided).select("*", judged(by_list["verdict"]))
    rest = pages.filter(~decided).withColumn(own, tokens).join(hit, F.col(own) == F.col(hit_), "left")
    return known.unionByName(rest.select(*[F.col(f"`{c}`") for c in pages.columns], judged(F.when(F.col(hit_).isNotNull(), "block").otherwise("allow"))))
