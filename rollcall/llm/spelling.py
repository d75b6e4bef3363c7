"""Spelling variants: the vocabulary's acceptor composed with a one-edit transducer and with itself.

Words are near if one code point inserted, deleted or replaced makes one into the other. The
composition acceptor - edit - acceptor accepts just these pairs. It is cut by initial states: a
part fixes how a word begins and ends and leaves a region between them free, so that it starts
in the states behind its beginnings. The edit of a pair lies at the first code point in which
both differ, so in one region alone, and each pair is accepted in one part. A part of too many
words is cut again by halves of its region; with one free code point it cannot hold more words
than the alphabet's square.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PAIRED = "word string, n_near long, near_n long, near string"


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, drop_one_in: int = 97) -> DataFrame:
    """word, n: runs of letters of all texts (null: none), A-Z lower-cased, with planted slips of one letter.

    Where the CRC-32 of ``<doc_id>:<run>`` divides by ``drop_one_in``, the run loses a code point; a null
    doc_id counts as empty there. Words of ``least_length`` code points and ``least_count`` occurrences
    stay. Repeated rows count each time.
    """
    # a shorter run gives no word, so the pattern passes it over
    run = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[a-z\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(run).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % drop_one_in == 0, slipped).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


class Acceptor:
    """A minimised acceptor of words given in order: states with equal right languages are one state."""

    def __init__(self, words: list[str]):
        self.out: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        self._known: dict[tuple, int] = {}
        self._meets: dict[tuple[int, int], tuple[str, ...]] = {}
        path: list[int] = [0]  # states of the last word that further words may still share
        last = ""
        for w in words:
            same = 0
            while same < len(last) and same < len(w) and last[same] == w[same]:
                same += 1
            self._settle(path, last, same)
            for c in w[same:]:
                self.out.append({})
                self.final.append(False)
                self.out[path[-1]][c] = len(self.out) - 1
                path.append(len(self.out) - 1)
            self.final[path[-1]] = True
            last = w
        self._settle(path, last, 0)

    def _settle(self, path: list[int], last: str, depth: int) -> None:
        """Replace the states of ``path`` below ``depth`` by equal ones known before."""
        while len(path) - 1 > depth:
            state = path.pop()
            like = self._known.setdefault((self.final[state], tuple(self.out[state].items())), state)
            self.out[path[-1]][last[len(path) - 1]] = like

    def common(self, p: int, q: int) -> tuple[str, ...]:
        """The strings that both states accept; each pair of states is worked out once."""
        start = (p, q) if p <= q else (q, p)
        todo = [start]
        while todo:  # without recursion, as words may be very long
            pair = todo[-1]
            if pair in self._meets:
                todo.pop()
                continue
            a, b = self.out[pair[0]], self.out[pair[1]]
            steps = [(c, (a[c], b[c]) if a[c] <= b[c] else (b[c], a[c])) for c in (a if len(a) <= len(b) else b) if c in a and c in b]
            missing = [s for _, s in steps if s not in self._meets]
            if missing:
                todo.extend(missing)
                continue
            here = ("",) if self.final[pair[0]] and self.final[pair[1]] else ()
            self._meets[pair] = here + tuple(c + rest for c, s in steps for rest in self._meets[s])
            todo.pop()
        return self._meets[start]

    def pairs(self, at_end: bool) -> Iterator[tuple[str, str]]:
        """Accepted pairs of the composition, each once: the edit is at the first code point that differs.

        ``at_end``: whether a code point may be inserted behind the last one.
        """
        todo = [(0, "")]
        while todo:
            p, before = todo.pop()
            edges = sorted(self.out[p].items())
            for k, (c, q) in enumerate(edges):
                for d, r in edges[k + 1 :]:  # replaced
                    for rest in self.common(q, r):
                        yield before + c + rest, before + d + rest
                for d, r in edges:  # c inserted before d
                    if d != c and d in self.out[q]:
                        for rest in self.common(r, self.out[q][d]):
                            yield before + d + rest, before + c + d + rest
                if at_end and self.final[p] and self.final[q]:
                    yield before, before + c
                todo.append((q, before + c))


def near_in_part(words: list[str], counts: list[int], m: int, a: int, b: int) -> dict[str, list]:
    """word: [near words, the best one's count, the best one] within one part: words of ``m`` or m+1 code points.

    The part's words share their first ``a`` and last m-b code points (a word whose hash collides with
    another part's falls to a part of its own here).
    """
    found: dict[str, list] = {}
    parts: dict[tuple[str, str], list[int]] = defaultdict(list)
    tail = max(0, m - b)
    for k, w in enumerate(words):
        parts[w[:a], w[len(w) - tail :]].append(k)
    for (left, right), rows in parts.items():
        if len(rows) < 2:
            continue
        n_of = {words[k]: counts[k] for k in rows}
        middles = sorted(words[k][a : len(words[k]) - tail] for k in rows)
        for x, y in Acceptor(middles).pairs(b > m):
            if len(x) == len(y) and a + len(x) + tail > m:
                continue  # two of the longer words: their pair belongs to the class of their own length
            x, y = left + x + right, left + y + right
            for own, other in ((x, y), (y, x)):
                n = n_of[other]
                if (best := found.get(own)) is None:
                    found[own] = [1, n, other]
                else:
                    best[0] += 1
                    if n > best[1] or n == best[1] and other < best[2]:
                        best[1:] = n, other
    return found


def _parts(words: DataFrame, regions: Column) -> DataFrame:
    """A row for each word and region (m, a, b), with the key of its part."""
    rows = words.select("word", "n", F.explode(regions).alias("r")).select("word", "n", "r.m", "r.a", "r.b")
    left = F.substring("word", F.lit(1), F.col("a"))
    right = F.when(F.col("m") > F.col("b"), F.right("word", F.col("m") - F.col("b"))).otherwise(F.lit(""))
    return rows.withColumn("part", F.xxhash64("m", "a", "b", left, right))


def _region(m: Column, a: Column, b: Column) -> Column:
    return F.struct(m.cast("int").alias("m"), a.cast("int").alias("a"), b.cast("int").alias("b"))


def near_words(words: DataFrame, scratch: Scratch, most: int = 4096, task_rows: int = 100_000) -> DataFrame:
    """word, n_near, near_n, near: how many near words each has (if any), and the commonest, the smallest on ties.

    ``words`` has one row a word with its count ``n``. Parts of more than ``most`` words are cut into halves
    until they are smaller or have one free code point, so none is gathered that grows with the data.
    """
    size = F.length("word")
    halves = [(size - k, F.ceil((size - k) / 2)) for k in (0, 1)]
    regions = F.array(*(_region(m, x, y) for m, c in halves for x, y in ((F.lit(0), c), (c, m + 1))))
    rows = _parts(words, regions).filter("m > 0")
    settled: DataFrame | None = None
    while True:
        counted = rows.withColumn("size", F.count("*").over(Window.partitionBy("part"))).filter("size > 1")
        held = scratch.cut(counted, "parts")
        large = (F.col("size") > most) & (F.col("b") - F.col("a") > 1)
        light = held.filter(~large)
        settled = light if settled is None else settled.unionByName(light)
        if held.filter(large).isEmpty():
            break
        middle = F.floor((F.col("a") + F.col("b")) / 2)
        again = held.filter(large).select("word", "n", F.array(_region(F.col("m"), F.col("a"), middle), _region(F.col("m"), middle, F.col("b"))).alias("again"))
        rows = _parts(again, F.col("again"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(groups: Iterator[pd.DataFrame]) -> pd.DataFrame:
            out = []
            for g in groups:
                part = near_in_part(g["word"].tolist(), g["n"].tolist(), int(g["m"].iat[0]), int(g["a"].iat[0]), int(g["b"].iat[0]))
                out.extend((w, *x) for w, x in part.items())
            return pd.DataFrame(out, columns=["word", "n_near", "near_n", "near"])

        held: list[pd.DataFrame] = []
        for batch in batches:  # rows of a part are neighbours; the last part may go on in the next batch
            if not len(batch):
                continue
            edges = batch["part"].ne(batch["part"].shift()).to_numpy().nonzero()[0].tolist() + [len(batch)]
            groups = [batch.iloc[x:y] for x, y in zip(edges, edges[1:])]
            if held and held[-1]["part"].iat[-1] == groups[0]["part"].iat[0]:
                held.append(groups.pop(0))
                if not groups:
                    continue
            done = [pd.concat(held)] if held else []
            held = [groups.pop()]
            yield flush(iter(done + groups))
        if held:
            yield flush(iter([pd.concat(held)]))

    tasks = max(1, -(-settled.count() // task_rows), int(settled.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = settled.repartition(tasks, "part").sortWithinPartitions("part").select("part", "word", "n", "m", "a", "b")
    first = F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))
    found = dealt.mapInPandas(run, _PAIRED).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(first).alias("first"))
    return found.select("word", "n_near", (-F.col("first.n")).alias("near_n"), F.col("first.w").alias("near"))


def group(words: DataFrame, ratio: int = 2, most: int = 4096) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n; one row a word, n above 0).

    A word's form is its commonest near word, if that is ``ratio`` times as common (2 or more); the root
    is the end of the chain of forms. Counts grow along a chain by ``ratio`` each time, so chains are
    short and no circle exists; their ends are found by doubling. Words without near words have
    n_near 0 and are their own root; ties between near words go to the smallest in code-point order.
    Words of any length are compared whole. An empty table gives no rows; other columns are not read.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as common")
    with Scratch(words.sparkSession) as scratch:
        words = scratch.cut(words.select("word", F.col("n").cast("long").alias("n")), "words")
        near = words.join(near_words(words, scratch, most), "word", "left")
        is_form = F.col("near_n") >= ratio * F.col("n")
        held = near.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")
        )
        held = scratch.cut(held, "forms")
        roots = scratch.cut(held.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
        while True:
            further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
            step = scratch.cut(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
            scratch.drop(roots)
            roots = step.select("word", "root")
            if step.filter("moved").isEmpty():
                break
        found = held.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return scratch.keep(found, "variants")
