"""Lexicon text analytics: topics, stance and tone of statements.

Two scanners, as the metrics define them. ``topic_mentions`` looks for the longest
keyword at every position. ``lexicon_hits`` moves from left to right and consumes what
it matches. Both walk a trie of the terms' tokens over a text's tokens, so a text costs
what it is long, however many terms the lexicon has and however many tokens a term. Terms
are joined to their topics by equal keys, and a lexicon is broadcast up to a checked size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.text import tokens
from rollcall.functions.votes import combined_stance, stance

#: Words that turn a term round when one stands in the three tokens before it.
NEGATIONS = (
    "not", "no", "never", "without", "cannot", "can't", "don't", "dont",
    "doesn't", "doesnt", "isn't", "isnt", "aren't", "arent", "won't",
    "wont", "wasn't", "weren't", "nor", "neither", "hardly", "barely",
    "lacks", "lacking", "against", "oppose", "opposed", "reject",
)
WINDOW = 3
#: Terms of a lexicon that is broadcast in joins; above it Spark chooses.
BROADCAST_TERMS = 200_000
_TOKEN = re.compile(r"[a-z0-9']+")


@dataclass(frozen=True)
class Term:
    """One lexicon entry: ``kind`` is kw, pro, con or tone; ``polarity`` is for tone alone."""

    term: str
    kind: str
    topic: str = ""
    polarity: int = 0


def lexicon_frame(spark, lexicon: list[Term]) -> DataFrame:
    rows = [(t.term, t.kind, t.topic, t.polarity) for t in lexicon]
    return spark.createDataFrame(rows, "term string, kind string, topic string, polarity int")


def lexicon_index(lexicon: DataFrame) -> DataFrame:
    """One row per normalised term: its topics by kind and its tone, a negative tone overruling a positive one."""
    term = F.array_join(tokens(F.col("term")), " ")

    def topics(kind: str) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("topic"))))

    tone = F.coalesce(F.min(F.when(F.col("kind") == "tone", F.col("polarity"))), F.lit(0))
    return lexicon.groupBy(term.alias("term")).agg(topics("kw").alias("kw"), topics("pro").alias("pro"), topics("con").alias("con"), tone.alias("tone")).filter("term <> ''")


def _small(df: DataFrame, lexicon: list[Term]) -> DataFrame:
    return F.broadcast(df) if len(lexicon) <= BROADCAST_TERMS else df


class TermTrie:
    """Terms as paths of tokens; a walk from a position gives the longest term that starts there."""

    def __init__(self, terms: Iterable[list[str]]):
        self.root: dict = {}
        for tokens_ in terms:
            node = self.root
            for t in tokens_:
                node = node.setdefault(t, {})
            if tokens_:
                node[None] = True

    def longest(self, words: list[str], at: int) -> int:
        node, best, k = self.root, 0, at
        while k < len(words) and (node := node.get(words[k])) is not None:
            k += 1
            if None in node:
                best = k - at
        return best

    def consumed(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """(position, tokens) of the leftmost longest terms; what one covers is not looked at again."""
        at = 0
        while at < len(words):
            n = self.longest(words, at)
            if n:
                yield at, n
            at += n or 1

    def everywhere(self, words: list[str]) -> set[str]:
        """The longest terms of all positions."""
        return {" ".join(words[at : at + n]) for at, w in enumerate(words) if w in self.root and (n := self.longest(words, at))}


def _tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def sliced(batches: Iterator[pd.Series], found: Callable[[str | None], list], chars: int = 1 << 20) -> Iterator[pd.Series]:
    """What is ``found`` in each text, given back after every ``chars`` characters of texts, so that a task never holds the hits of a whole batch."""
    for texts in batches:
        out, size = [], 0
        for t in texts:
            out.append(found(t))
            size += len(t or "") + 1
            if size >= chars:
                yield pd.Series(out, dtype=object)
                out, size = [], 0
        if out:
            yield pd.Series(out, dtype=object)


def lexicon_hits(statements: DataFrame, lexicon: list[Term], text: str = "text", cues: tuple[str, ...] = NEGATIONS, window: int = WINDOW) -> DataFrame:
    """A row per hit: the statement's columns without the text, ``pos``, ``n``, ``term`` and ``neg``.

    Leftmost longest match first; what a match covers is not looked at again. ``neg``: whether a cue
    stands in the ``window`` tokens before it. Null text has no hits.
    """
    names = [c for c in statements.columns if c != text]
    shared = statements.sparkSession.sparkContext.broadcast((TermTrie(_tokens(x.term) for x in lexicon), frozenset(cues)))

    def hits(text: str | None) -> list[tuple]:
        (trie, turning), words = shared.value, _tokens(text)
        return [(p, n, " ".join(words[p : p + n]), not turning.isdisjoint(words[max(0, p - window) : p])) for p, n in trie.consumed(words)]

    @F.pandas_udf("array<struct<pos:int,n:int,term:string,neg:boolean>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return sliced(batches, hits)

    return statements.select(*names, F.explode(scan(F.col(text))).alias("h")).select(*names, "h.pos", "h.n", "h.term", "h.neg")


def scored_hits(statements: DataFrame, lexicon: list[Term], cues: tuple[str, ...] = NEGATIONS) -> DataFrame:
    """Hits with the index entry of their term."""
    index = lexicon_index(lexicon_frame(statements.sparkSession, lexicon))
    return lexicon_hits(statements, lexicon, cues=cues).join(_small(index, lexicon), "term")


def topic_hits(statements: DataFrame, lexicon: list[Term], keys: list[str], cues: tuple[str, ...] = NEGATIONS) -> DataFrame:
    """Per ``keys`` and topic: mentions, pro, con; a cue swaps pro and con but not mentions."""
    hits = scored_hits(statements, lexicon, cues)

    def side(kind: str, flipped: str) -> Column:
        return F.transform(
            F.col(kind), lambda t: F.struct(t.alias("topic"), F.when(F.lit(kind == "kw"), F.lit("kw")).when(F.col("neg"), F.lit(flipped)).otherwise(F.lit(kind)).alias("side"))
        )

    sides = hits.select(*keys, F.explode(F.concat(side("kw", "kw"), side("pro", "con"), side("con", "pro"))).alias("s"))
    return sides.groupBy(*keys, F.col("s.topic").alias("topic")).agg(
        F.count_if(F.col("s.side") == "kw").alias("mentions"), F.count_if(F.col("s.side") == "pro").alias("pro"), F.count_if(F.col("s.side") == "con").alias("con")
    )


def tone(statements: DataFrame, lexicon: list[Term], keys: list[str], cues: tuple[str, ...] = NEGATIONS) -> DataFrame:
    """Per ``keys``: hits of positive and negative tone, cues turning a hit round."""
    hits = scored_hits(statements, lexicon, cues).filter("tone <> 0")
    value = F.when(F.col("neg"), -F.col("tone")).otherwise(F.col("tone"))
    return hits.groupBy(*keys).agg(F.count_if(value > 0).alias("tone_pos"), F.count_if(value < 0).alias("tone_neg"))


def topic_mentions(statements: DataFrame, lexicon: list[Term], key: str = "statement_id") -> DataFrame:
    """Distinct (key, topic): the longest keyword at each position, none consumed; keywords as they stand, lower-cased."""
    # a keyword is met as it stands, so one that is no row of tokens is never found
    keywords = [t.term.lower().strip().split(" ") for t in lexicon if t.kind == "kw"]
    shared = statements.sparkSession.sparkContext.broadcast(TermTrie(keywords))

    @F.pandas_udf("array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return sliced(batches, lambda t: sorted(shared.value.everywhere(_tokens(t))))

    found = statements.select(key, F.explode(scan(F.col("text"))).alias("term"))
    frame = lexicon_frame(statements.sparkSession, [t for t in lexicon if t.kind == "kw"])
    topics = frame.select(F.lower(F.trim("term")).alias("term"), F.regexp_replace("topic", "^Pro-", "").alias("topic")).distinct()
    return found.join(_small(topics, lexicon), "term").select(key, "topic").distinct()


def salience(statements: DataFrame, lexicon: list[Term]) -> DataFrame:
    """Per member and topic: statements that mention it, and their share of the member's statements."""
    from rollcall.functions.votes import pct

    owned = statements.select("statement_id", "member")
    counted = topic_mentions(statements, lexicon).join(owned, "statement_id").groupBy("member", "topic").agg(F.count("*").alias("statements"))
    spoken = owned.groupBy("member").agg(F.count("*").alias("spoken"))
    return counted.join(spoken, "member").select("member", "topic", "statements", pct(F.col("statements"), F.col("spoken")).alias("share_pct"))


def motion_stance(motions: DataFrame, lexicon: list[Term], cues: tuple[str, ...] = NEGATIONS) -> DataFrame:
    """(motion, topic, lean): the sign of pro less con of each distinct motion; scored once, however many voted on it."""
    distinct = motions.select("motion").distinct().withColumn("text", F.col("motion"))
    hits = topic_hits(distinct, lexicon, ["motion"], cues)
    return hits.select("motion", "topic", F.signum((F.col("pro") - F.col("con")).cast("double")).cast("int").alias("lean"))


def vote_stance(votes: DataFrame, lexicon: list[Term], cues: tuple[str, ...] = NEGATIONS) -> DataFrame:
    """Per member and topic: votes along and against its pro side; motions without a lean are skipped."""
    leans = motion_stance(votes, lexicon, cues).filter("lean <> 0")
    cast = votes.filter(F.col("direction").isin("aye", "no") & (F.col("motion") != ""))
    per_motion = cast.groupBy("member", "motion", "direction").agg(F.count("*").alias("n"))
    along = F.col("lean") * F.when(F.col("direction") == "aye", 1).otherwise(-1) > 0
    joined = per_motion.join(leans, "motion")
    return joined.groupBy("member", "topic").agg(F.sum(F.when(along, F.col("n")).otherwise(0)).alias("vote_pro"), F.sum(F.when(~along, F.col("n")).otherwise(0)).alias("vote_con"))


def member_topic_scores(statements: DataFrame, votes: DataFrame, lexicon: list[Term], cues: tuple[str, ...] = NEGATIONS) -> DataFrame:
    """Per member and engaged topic: mentions, spoken and voted stance, and both combined."""
    spoken = topic_hits(statements.select("member", "text"), lexicon, ["member"], cues).withColumnsRenamed({"pro": "spoken_pro", "con": "spoken_con"})
    both = spoken.join(vote_stance(votes, lexicon, cues), ["member", "topic"], "full_outer").fillna(0, ["mentions", "spoken_pro", "spoken_con", "vote_pro", "vote_con"])
    out = both.withColumns({"spoken_stance": stance(F.col("spoken_pro"), F.col("spoken_con")), "vote_stance": stance(F.col("vote_pro"), F.col("vote_con"))})
    spoken_n, vote_n = F.col("spoken_pro") + F.col("spoken_con"), F.col("vote_pro") + F.col("vote_con")
    out = out.withColumn("combined_stance", combined_stance(F.col("spoken_stance"), spoken_n, F.col("vote_stance"), vote_n))
    return out.filter((F.col("mentions") > 0) | (spoken_n > 0) | (vote_n > 0))


def member_grades(scores: DataFrame, activity: DataFrame, tones: DataFrame, least_hits: int = 3) -> DataFrame:
    """Per member: activity, tone, engaged topics, and the topics with the clearest stance either way (ties: topic order)."""
    evidence = F.col("spoken_pro") + F.col("spoken_con") + F.col("vote_pro") + F.col("vote_con")
    sure = (F.col("combined_stance") != 0) & (evidence >= least_hits)
    pro = F.when(sure & (F.col("combined_stance") > 0), F.struct((-F.col("combined_stance")).alias("s"), F.col("topic").alias("t")))
    con = F.when(sure & (F.col("combined_stance") < 0), F.struct(F.col("combined_stance").alias("s"), F.col("topic").alias("t")))
    per = scores.groupBy("member").agg(F.count_if(F.col("combined_stance") != 0).alias("topics_engaged"), F.min(pro)["t"].alias("top_pro"), F.min(con)["t"].alias("top_con"))
    joined = activity.join(per, "member", "left").join(tones, "member", "left").fillna(0, ["topics_engaged", "tone_pos", "tone_neg"]).fillna("", ["top_pro", "top_con"])
    return joined.withColumn("tone_score", stance(F.col("tone_pos"), F.col("tone_neg"))).drop("tone_pos", "tone_neg")
