"""Prefix trie of conversations: double arrays by prefix shard, shared upper nodes merged.

A node is a distinct sequence of first turns, known by a chained hash. Equal conversations are
counted once. The others are dealt to shards by the shortest prefix that few enough turns follow;
prefixes of more turns are told apart at twice the depth, so a common opening doesn't gather in
one task. A shard packs the BASE and CHECK arrays of its trie over dense ids of its own turns, and
reads all nodes off them. What lies at or below a conversation's cut is whole in one shard; nodes
above it are shared by shards, and their figures are merged by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import Scratch

_WORD = "[^\\x20\\x09-\\x0D]+"
_ROOT = "0" * 32
_NODE = (
    "node string, parent string, depth long, shared boolean, conv_id long, parent_conv_id long, n_convs long, n_words long, "
    "n_children long, n_leaves long, saved_tokens long, path array<string>"
)
_COLUMNS = [c.split()[0] for c in _NODE.split(", ")]


def _chained(keys: Column) -> Column:
    """The node that the turns ``keys`` lead to: each step hashes the node before and the turn."""
    return F.aggregate(keys, F.lit(_ROOT), lambda node, key: F.substring(F.sha2(F.concat(node, key).cast("binary"), 256), 1, 32))


def rebuilt(conversations: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """conv_id, keys, words: each conversation's turns, by the hash of role and text and by their number of words.

    The first h turns of conversation c - c % every come first, then c's own behind its first h, with
    h = CRC-32 of the decimal c modulo ``heads``; with ``heads`` 1 conversations stay as they are. Turns go
    by (turn, role, hash), null turns first. Null role or text is empty. Texts are read where they are: the
    shuffles carry 44 bytes a turn. Turns without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), role.alias("role"), key.alias("key"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words")).alias("t"),
    )
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.key").alias("keys"), F.col("t.words").alias("words"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    opening = own.filter(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("keys", 1, heads).alias("base_keys"), F.slice("words", 1, heads).alias("base_words")
    )
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h.cast("int")).join(opening, "base", "left")

    def spliced(name: str, kind: str) -> Column:
        head = F.coalesce(F.slice(f"base_{name}", F.lit(1), F.col("h")), F.array().cast(f"array<{kind}>"))
        return F.concat(head, F.slice(name, F.col("h") + 1, F.greatest(F.size(name), F.lit(1)))).alias(name)

    return joined.select("conv_id", spliced("keys", "string"), spliced("words", "bigint"))


class DoubleArray:
    """A trie in two arrays: the child of slot s by id c is slot BASE[s] + c, if CHECK there is s. Slot 0 is the root."""

    def __init__(self, sequences: list[list[int]]):
        """``sequences``: distinct, in ascending order, of ids from 0."""
        self.base = np.zeros(1024, np.int64)
        self.check = np.full(1024, -1, np.int64)
        self.check[0] = 0  # taken
        self.end = 1  # slots from here on are free
        self._free = 1  # below it none is
        todo = [(0, 0, 0, len(sequences))]  # slot, depth, rows that share the path
        while todo:
            slot, depth, lo, hi = todo.pop()
            while lo < hi and len(sequences[lo]) == depth:
                lo += 1
            if lo == hi:
                continue
            codes, starts = [], []
            k = lo
            while k < hi:
                c = sequences[k][depth]
                codes.append(c)
                starts.append(k)
                k = self._behind(sequences, c, depth, k, hi)
            at = self._place(codes)
            self.base[slot] = at
            for c in codes:
                self.check[at + c] = slot
            self.end = max(self.end, at + codes[-1] + 1)
            todo.extend((at + c, depth + 1, x, y) for c, x, y in zip(codes, starts, starts[1:] + [hi]))

    @staticmethod
    def _behind(sequences: list[list[int]], c: int, depth: int, lo: int, hi: int) -> int:
        """The first row from ``lo`` on whose id at ``depth`` is above ``c``: steps that double, then halves."""
        step = 1
        while lo + step < hi and sequences[lo + step][depth] == c:
            lo, step = lo + step, step * 2
        hi = min(hi, lo + step)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if sequences[mid][depth] == c else (lo, mid)
        return hi

    def _place(self, codes: list[int]) -> int:
        """A base that leaves the slots of all ``codes`` free: in the first gaps if one fits, else behind the last."""
        while self._free < self.end and self.check[self._free] >= 0:
            self._free += 1
        ids = np.asarray(codes)
        top = self.end + codes[-1] + 2
        while top > len(self.check):
            self.base = np.concatenate([self.base, np.zeros(len(self.base), np.int64)])
            self.check = np.concatenate([self.check, np.full(len(self.check), -1, np.int64)])
        gaps = np.flatnonzero(self.check[self._free : self._free + 256] < 0)[:16] + self._free
        for slot in gaps:
            at = int(slot) - codes[0]
            if at + codes[-1] < len(self.check) and (self.check[ids + at] < 0).all():
                return at
        return self.end - codes[0]

    def step(self, slot: int, c: int) -> int:
        """The child of ``slot`` by ``c``, or -1."""
        to = int(self.base[slot]) + c
        return to if 0 < to < self.end and self.check[to] == slot else -1


def shard_nodes(keys: list[list[str]], words: list[list[int]], counts: list[int], smallest: list[int], cuts: list[int]) -> pd.DataFrame:
    """All nodes of one shard's trie (see ``_NODE``), from its distinct sequences.

    Figures of a node count what the shard holds; ``n_leaves`` and ``saved_tokens`` leave out the nodes
    shared with other shards, which are those above a sequence's cut.
    """
    ids = {key: k for k, key in enumerate(sorted({x for row in keys for x in row}))}
    rows = sorted(([ids[x] for x in row], k) for k, row in enumerate(keys))
    trie = DoubleArray([codes for codes, _ in rows])
    size = trie.end
    depth, n_words = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    n_convs, conv = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max, np.int64)
    shared, names = np.zeros(size, bool), [""] * size
    depth[0], names[0] = 0, _ROOT
    for codes, k in rows:
        slot, many, least, cut = 0, counts[k], smallest[k], cuts[k]
        path = [0]
        for d, c in enumerate(codes):
            to = trie.step(slot, c)
            if depth[to] < 0:
                depth[to], n_words[to] = d + 1, words[k][d]
                names[to] = hashlib.sha256((names[slot] + keys[k][d]).encode()).hexdigest()[:32]
            slot = to
            path.append(to)
        at = np.asarray(path)
        n_convs[at] += many
        conv[at] = np.minimum(conv[at], least)
        shared[at[:cut]] = True
    slots = np.flatnonzero(depth >= 0)
    slots = slots[np.argsort(depth[slots], kind="stable")]
    parent = trie.check[:size]
    n_children = np.bincount(parent[slots[1:]], minlength=size)
    private = ~shared
    leaves = np.where(private & (n_children == 0), 1, 0)
    saved = np.where(private, (n_convs - 1) * n_words, 0)
    at_depth = np.searchsorted(depth[slots], np.arange(int(depth[slots[-1]]) + 2))
    for d in range(len(at_depth) - 2, 0, -1):
        these = slots[at_depth[d] : at_depth[d + 1]]
        np.add.at(leaves, parent[these], leaves[these])
        np.add.at(saved, parent[these], saved[these])
    # a child counts here if it is this shard's alone; shared children are counted when they are merged
    own_children = np.bincount(parent[slots[1:]], weights=private[slots[1:]], minlength=size).astype(np.int64)
    paths: dict[int, list[str]] = {}
    for s in slots.tolist():
        if shared[s]:
            paths[s] = (paths[int(parent[s])] if s else []) + [names[s]]
    up = parent[slots]
    return pd.DataFrame(
        {
            "node": [names[s] for s in slots],
            "parent": [names[p] if s else None for s, p in zip(slots, up)],
            "depth": depth[slots],
            "shared": shared[slots],
            "conv_id": conv[slots],
            "parent_conv_id": pd.Series(conv[up], dtype="Int64").mask(shared[up]),  # null: to be read off the merged nodes
            "n_convs": n_convs[slots],
            "n_words": n_words[slots],
            "n_children": np.where(shared[slots], own_children[slots], n_children[slots]),
            "n_leaves": leaves[slots],
            "saved_tokens": saved[slots],
            "path": [paths.get(s) for s in slots.tolist()],
        }
    )[_COLUMNS]


def _cut_depths(distinct: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """``distinct`` with cut (a depth) and prefix (its node there): at most ``most`` turns, or one sequence, share a prefix."""
    open_, depth, done = distinct, 1, None
    while True:
        placed = open_.withColumn("cut", F.lit(depth)).withColumn("prefix", _chained(F.slice("keys", 1, depth)))
        weights = placed.groupBy("prefix").agg(F.sum(F.size("keys")).alias("turns"), F.count("*").alias("rows"))
        heavy = scratch.cut(weights.filter((F.col("turns") > most) & (F.col("rows") > 1)).select("prefix"), "heavy")
        if heavy.isEmpty():
            return placed if done is None else done.unionByName(placed)
        placed = scratch.cut(placed, "placed")
        light = placed.join(heavy, "prefix", "left_anti").select(*placed.columns)
        done = light if done is None else done.unionByName(light)
        open_, depth = placed.join(heavy, "prefix", "left_semi").select(*distinct.columns), 2 * depth


def _ends(held: DataFrame) -> DataFrame:
    """node, ends_sha256: the hash of the ids of the conversations that end there, ascending.

    Ids are sorted over the cluster and packed into texts of up to 64 kB, so that a node at which very
    many conversations end sends few rows to the task that hashes them, one after the other.
    """

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, first, ids, length = None, 0, [], 0
        for b in batches:
            out = []
            for x, c in zip(b["node"], b["conv_id"]):
                if x != node or length > 1 << 16:
                    if ids:
                        out.append((node, first, ",".join(ids)))
                    node, first, ids, length = x, c, [], 0
                ids.append(str(c))
                length += len(ids[-1]) + 1
            yield pd.DataFrame(out, columns=["node", "first", "ids"])
        if ids:
            yield pd.DataFrame([(node, first, ",".join(ids))], columns=["node", "first", "ids"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, sha = None, None
        for b in batches:
            out = []
            for x, ids in zip(b["node"], b["ids"]):
                if x != node:
                    if sha:
                        out.append((node, sha.hexdigest()))
                    node, sha = x, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if sha:
            yield pd.DataFrame([(node, sha.hexdigest())], columns=["node", "ends_sha256"])

    runs = held.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    texts = runs.mapInPandas(packed, "node string, first long, ids string")
    return texts.repartition("node").sortWithinPartitions("node", "first").mapInPandas(hashed, "node string, ends_sha256 string")


def nodes(conversations: DataFrame, every: int = 20, heads: int = 4, most: int = 30_000) -> DataFrame:
    """One row for each node of the trie of all rebuilt conversations (see ``rebuilt``).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. ``most`` turns
    go to one shard, or those of one sequence. Repeated rows are turns of their own; equal conversations
    share all nodes; those without turns are members of the root alone. An empty table gives no rows;
    columns other than conv_id, turn, role and text are not read. One task holds the turns of a conversation
    at 80 bytes each, however long their texts.
    """
    with Scratch(conversations.sparkSession) as scratch:
        held = scratch.cut(rebuilt(conversations, every, heads).withColumn("node", _chained(F.col("keys"))), "rebuilt")
        distinct = scratch.cut(held.groupBy("keys", "words").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")), "distinct")
        total = distinct.agg(F.sum(F.size("keys"))).first()[0] or 0
        shards = max(1, -(-total // most))

        def packed(rows: pd.DataFrame) -> pd.DataFrame:
            return shard_nodes(
                [k.split() for k in rows["keys"]], [list(w) for w in rows["words"]], rows["n"].tolist(), rows["conv_id"].tolist(), rows["cut"].tolist()
            )

        dealt = _cut_depths(distinct, scratch, most).select(
            F.pmod(F.xxhash64("prefix"), F.lit(shards)).alias("shard"), F.array_join("keys", " ").alias("keys"), "words", "n", "conv_id", "cut"
        )
        found = scratch.cut(dealt.groupBy("shard").applyInPandas(packed, _NODE), "nodes")

        upper = found.filter("shared").groupBy("node").agg(
            F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("n_words").alias("n_words"),
            F.sum("n_children").alias("own_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.first("path").alias("path"),
        )
        upper = scratch.cut(upper, "upper")
        children = upper.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
        upper = scratch.cut(upper.join(children, "node", "left").withColumn("n_children", F.col("own_children") + F.coalesce("more", F.lit(0))).drop("own_children", "more"), "upper")
        # each shared node adds what it is itself to all above it and to itself
        own = upper.select(
            F.explode("path").alias("node"), F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("kept")
        )
        sums = own.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.sum("kept").alias("kept"))
        upper = scratch.cut(
            upper.join(sums, "node").select(
                "node", "parent", "depth", "conv_id", "n_convs", "n_children", (F.col("leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved") + F.col("kept")).alias("saved_tokens")
            ),
            "upper",
        )
        root = upper.filter("depth = 0").select("conv_id").first()
        columns = ["node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
        whole = found.filter("NOT shared").select(*columns, "parent_conv_id").unionByName(upper.select(*columns, F.lit(None).cast("long").alias("parent_conv_id")))
        # the root is the parent of any number of nodes, so it is no join's key
        below_root = whole.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root[0] if root else None).cast("long")))
        above = upper.filter("depth > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
        below_shared = whole.filter("depth > 1 AND parent_conv_id IS NULL").join(above, "parent").withColumn("parent_conv_id", F.col("above"))
        named = whole.filter("depth > 1 AND parent_conv_id IS NOT NULL")
        for part in (below_root, below_shared):
            named = named.unionByName(part.select(*named.columns))
        none = hashlib.sha256(b"").hexdigest()
        out = named.join(_ends(held), "node", "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
        )
        return scratch.keep(out, "trie")
