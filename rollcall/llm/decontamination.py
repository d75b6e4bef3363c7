"""Benchmark decontamination: rare n-gram seeds joined to passages, then Smith-Waterman alignment.

One scan of the documents finds the n-grams that the benchmark may have, by a bitmap of
bounded size. Their document counts make the rarest n-gram of each short window of an item
its seed, so every part of an item keeps one, and seeds meet the documents in an equal join
of hashes. Passages of a document that share n-grams with such an item, and enough words to
reach the least score, are aligned with it; the alignment's score, as a share of the item's
full score, finds edited and paraphrased copies too.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import Scratch, broadcast_value, fresh

MATCH, MISMATCH, GAP = 2, -1, -1
SMALL = 4 << 20  # bytes of items' texts that tasks may hold with their seeds, some 150 MB there


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of the whole text, split at ASCII white space, without ASCII punctuation at their ends."""
    return [w for w in (x.strip(b".,;:!?\"'()[]{}#*$%&|<>") for x in (text or "").encode("utf-8", "surrogatepass").lower().split()) if w]


def _rows(item: list[int], passage: list[int], anchored: bool) -> Iterator[np.ndarray]:
    """The rows of the alignment's table, one a word of the item and one before them, with linear gaps.

    Local alignments start anywhere at 0; ``anchored`` ones start at the first words of both.
    """
    p = np.asarray(passage)
    ramp = np.arange(len(p) + 1) * -GAP
    row = -ramp if anchored else np.zeros(len(p) + 1, np.int64)
    yield row
    for w in item:
        fresh = np.full_like(row, row[0] + GAP if anchored else 0)
        fresh[1:] = np.maximum(row[:-1] + np.where(p == w, MATCH, MISMATCH), row[1:] + GAP)
        if not anchored:
            np.maximum(fresh, 0, out=fresh)
        row = np.maximum.accumulate(fresh + ramp) - ramp  # gaps in the item, carried from the left
        yield row


def alignment(item: list[int], passage: list[int]) -> tuple[int, int, int]:
    """(best local score, its end in the passage, its end in the item) of Smith-Waterman, the first on ties."""
    best, end, last = 0, 0, 0
    for k, row in enumerate(_rows(item, passage, False)):
        top = int(row.argmax())
        if row[top] > best:
            best, end, last = int(row[top]), top, k
    return best, end, last


def alignment_start(item: list[int], passage: list[int], score: int) -> int:
    """Where in the passage an alignment of ``score`` starts that ends with the last words of both: the nearest such place."""
    for row in _rows(item[::-1], passage[::-1], True):
        at = np.flatnonzero(row == score)
        if len(at):
            return len(passage) - int(at[0])
    return 0


class Items:
    """Benchmark items with the places of their word n-grams; a shorter item is one n-gram."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.n = n
        self.items = [(i, w) for i, t in rows if (w := words(t))]
        self.grams: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            size = min(n, len(w))
            for j in range(len(w) - size + 1):
                self.grams[tuple(w[j : j + size])].append((k, j))
        self.sizes = sorted({len(g) for g in self.grams})

    def matches(self, w: list[bytes], least: float) -> list[tuple[int, float, int, int]]:
        """(item id, score, first word, end word) of the best passage for each item with a score of ``least`` or more."""
        starts: dict[int, set[int]] = defaultdict(set)  # item: where it would begin in the text
        for size in self.sizes:
            for i, g in enumerate(zip(*(w[j:] for j in range(size)))):
                for k, j in self.grams.get(g, ()):
                    starts[k].add(i - j)
        out = []
        for k, at in starts.items():
            item_id, item = self.items[k]
            ids: dict[bytes, int] = {}
            coded = [ids.setdefault(x, len(ids)) for x in item]
            own = np.bincount(coded)
            best, slack, done = (0.0, 0, 0), max(4, len(item) // 2), -1
            for a in sorted(at):
                if a <= done:
                    continue
                lo = max(0, a - slack)
                hi = min(len(w), a + slack + len(item) + 2 * slack)  # as far as the last start that is passed over would reach
                done = a + slack  # starts this near lie in the same passage
                passage = [ids.get(x, -1) for x in w[lo:hi]]
                shared = np.minimum(np.bincount([x for x in passage if x >= 0], minlength=len(own)), own).sum()
                if shared / len(item) < least or shared / len(item) <= best[0]:
                    continue  # no alignment matches more words than both have
                score, end, last = alignment(coded, passage)
                share = score / (MATCH * len(item))
                if share > best[0]:
                    best = (share, lo + alignment_start(coded[:last], passage[:end], score), lo + end)
            if best[0] >= least:
                out.append((item_id, *best))
        return sorted(out, key=lambda x: (x[0] is None, x[0]))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(w: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words, the same in every task. Two n-grams of one hash only cost an alignment."""
    if len(w) < size:
        return np.zeros(0, np.uint64)
    h = np.fromiter((crc32(x) for x in w), np.uint64, len(w))
    g = np.full(len(w) - size + 1, size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            g = (g ^ h[j : j + len(g)]) * _ODD
            g ^= g >> np.uint64(29)
    return g * _ODD


def _item_grams(items: DataFrame, n: int) -> DataFrame:
    """(item, place, gram, size): the n-grams of each of ``items`` (item, text), in their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b["item"], b["text"]):
                w = words(t)
                size = min(n, len(w))
                if size:
                    out += [(k, j, g, size) for j, g in enumerate(gram_hashes(w, size).view(np.int64).tolist())]
            yield pd.DataFrame(out, columns=["item", "place", "gram", "size"])

    return items.select("item", "text").mapInPandas(run, "item long, place int, gram long, size int")


def _filter_of(grams: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """(shift, bits): a bitmap of the grams' leading bits, 16 bits a gram and at most 256 MB, so what tasks hold has a bound."""
    log = min(31, max(16, (16 * max(1, count) - 1).bit_length()))
    at = F.shiftrightunsigned("gram", 64 - log)
    set_ = grams.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("bits")).toPandas()
    bits = np.zeros(1 << (log - 6), np.uint64)
    bits[set_["at"].to_numpy(np.int64)] = set_["bits"].to_numpy(np.int64).view(np.uint64)
    return 64 - log, bits


def _scan(docs: DataFrame, grams: DataFrame, scratch: Scratch, *columns: str) -> DataFrame:
    """(columns, text, grams) of the documents that may hold a gram of the benchmark, in one scan whatever the benchmark's size."""
    sizes = grams.groupBy("size").agg(F.count("*").alias("n")).collect()  # n rows at most
    shift, bits = _filter_of(grams, sum(r["n"] for r in sizes))
    get = broadcast_value(docs.sparkSession, (shift, bits, [r["size"] for r in sizes]))

    @F.pandas_udf("array<long>")
    def held(texts: pd.Series) -> pd.Series:
        by, bitmap, lengths = get()
        out = []
        for t in texts:
            w, found = words(t), []
            for size in lengths:
                g = gram_hashes(w, size)
                at = g >> np.uint64(by)
                found.append(g[(bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1])
            out.append(np.unique(np.concatenate(found)).view(np.int64) if found else np.zeros(0, np.int64))
        return pd.Series(out, dtype=object)

    found = docs.select(*columns, "text").filter("text IS NOT NULL").withColumn("grams", held(F.col("text"))).filter(F.size("grams") > 0)
    return scratch.cut(found.withColumn("row", F.monotonically_increasing_id()), "scanned")


def rare_seeds(grams: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(item, gram): the rarest gram of each ``window`` neighbouring places of an item, by the documents that hold it.

    Grams that no document holds are no seeds, and count as absent from their windows: every part of an item that
    documents have anything of keeps a seed. Ties go by the gram.
    """
    known = grams.join(counts, "gram").select("item", "place", "gram", "docs")
    each = known.withColumn("start", F.explode(F.sequence(F.col("place") - window + 1, F.col("place"))))
    return each.groupBy("item", "start").agg(F.min_by("gram", F.struct("docs", "gram")).alias("gram")).select("item", "gram").distinct()


def _seeded(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, n: int, window: int, *columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scanned documents (row, columns, text, grams), the items (item, item_id, text) and their seeds (item, gram)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    items = scratch.cut(items.withColumn("item", F.monotonically_increasing_id()), "items")
    grams = scratch.cut(_item_grams(items, n), "grams")
    scanned = _scan(docs, grams, scratch, *columns)
    counts = scanned.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("docs"))
    return scanned, items, scratch.cut(rare_seeds(grams, counts, window), "seeds")


def _beside_items(scanned: DataFrame, items: DataFrame, seeds: DataFrame, n: int, least: float, small: int) -> tuple[DataFrame, Callable]:
    """(documents that share a seed with items, with a column ``by``; what gives the matches of a text from its ``by``).

    Seeds meet the documents' n-grams in an equal join. Where the items have up to ``small`` bytes of text, tasks hold them
    and their seeds, and the join is made where the documents are; otherwise items are brought to them in a shuffle.
    """
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= small:
        held = {r["item"]: (r["item_id"], r["text"]) for r in items.collect()}
        index: dict[int, list[int]] = defaultdict(list)
        for r in seeds.collect():
            index[r["gram"]].append(r["item"])
        get, made = broadcast_value(items.sparkSession, (held, dict(index))), {}

        def near(w: list[bytes], grams) -> list[tuple[int, float, int, int]]:
            texts, at = get()
            out = []
            for k in {k for g in grams for k in at.get(int(g), ())}:
                if k not in made:
                    made[k] = Items([texts[k]], n)
                out += made[k].matches(w, least)
            return sorted(out, key=lambda x: (x[0] is None, x[0]))

        return scanned.withColumnRenamed("grams", "by"), near
    pairs = scanned.select("row", F.explode("grams").alias("gram")).join(seeds, "gram").select("row", "item").distinct()
    own = pairs.join(items, "item").groupBy("row").agg(F.collect_list(F.struct("item_id", "text")).alias("by"))

    def listed(w: list[bytes], rows) -> list[tuple[int, float, int, int]]:
        return Items(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x)), n).matches(w, least)

    return scanned.drop("grams").join(own, "row"), listed


def matches(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.5, window: int = 2, small: int = SMALL) -> DataFrame:
    """One row for each document row and benchmark item that it holds a copy of: doc_id, item_id, score, first_word, end_word.

    ``window`` neighbouring n-grams of an item have one seed, the rarest among all documents. Seeds meet the
    documents' n-grams in an equal join; then a document's passages are aligned with the items that it
    shares seeds with. Null or empty texts and items match nothing; an item shorter than ``n`` words has
    itself as its only seed; an item with several passages in a document gives its best one, the first on ties.
    Repeated documents give repeated matches, repeated items count once. An empty documents or benchmark table gives
    no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        scanned, items, seeds = _seeded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, scratch, n, window, "doc_id")
        beside, near = _beside_items(scanned, items, seeds, n, least, small)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = [(d, *m) for d, t, by in zip(b["doc_id"], b["text"], b["by"]) for m in near(words(t), by)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "score", "first_word", "end_word"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        found = beside.select("doc_id", "text", "by").mapInPandas(run, "doc_id long, item_id long, score double, first_word long, end_word long")
        return scratch.keep(found, "matches")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.5, window: int = 2, small: int = SMALL, few: int = 200_000) -> DataFrame:
    """The rows of ``docs`` that hold no copy of any item; columns as they are.

    Whether a row stays depends on its text alone, so what goes is known by the texts' hashes, which are broadcast
    up to ``few`` of them. Null and empty texts stay, repeated rows are treated alike; an empty table stays
    empty, and an empty benchmark rejects nothing.
    """
    key, name = F.sha2(F.col("text").cast("binary"), 256), fresh(docs, "contaminated")
    with Scratch(docs.sparkSession) as scratch:
        beside, near = _beside_items(*_seeded(docs, benchmark, scratch, n, window), n, least, small)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                gone = [t for t, by in zip(b["text"], b["by"]) if near(words(t), by)]
                yield pd.DataFrame({"gone": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in gone]}, dtype=object)

        gone = scratch.keep(beside.select("text", "by").mapInPandas(run, "gone string").select(F.col("gone").alias(name)).distinct(), "contaminated")
    gone = F.broadcast(gone) if gone.count() <= few else gone
    return docs.join(gone, key == gone[name], "left_anti")
