"""Hierarchical Pitman-Yor language model: words after two words, after one, and alone.

Every pair of words has a restaurant for the words that follow it; those of all pairs
with the same last word share the restaurant of that word as parent, and all of these
share the root, whose base measure is uniform over the training words and one slot for
all others. A table of a restaurant is a customer of its parent.

Seating is sampled by Gibbs. What is reseated at once is a dish of a restaurant: all
its customers and tables leave, and a number of tables t is drawn given the others,
with weight S(c, t) (d v h)^t. S is the generalised Stirling number (the seatings of c
customers at t tables), h the parent's probability of the dish without the tables that
left, and v ~ Gamma(strength / d + tables) the auxiliary variable that makes the dishes
of one restaurant independent, so that a step over all of them is exact for a given
parent, up to the weights: S comes from its recurrence up to 200 customers, above that from
a saddle point on a grid of some 300 table counts (at most 3e-10 off in the tests). As in other
distributed samplers, the dishes of a level move at the same time, so h is that of the sweep
before. Predictive probabilities are averaged over the samples, but for those of the root and
of words that are dealt over buckets (below): these keep the one seating that is drawn from what the
buckets sent, and the more buckets there are the more words are dealt.

A text's tokens go to the bucket of the word before them. So a bucket holds all that a
restaurant of that word and of its pairs needs, and a word's count too, as each token
is the context of one other. A word that would fill a large part of a bucket is dealt
over several by the word before it: its pairs stay whole, and its own restaurant is
seated with the root, from sums over the buckets. Nothing of the size of the corpus or
of its vocabulary reaches the driver or is broadcast.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import Scratch, broadcast_value, hashed_sample

END = b""  # the end token, and the context of the first words; no word is empty
ROOT, WORD, PAIR = (0.8, 1.0), (0.75, 1.0), (0.8, 1.0)  # (discount, strength) by level
BUCKET = 1_200_000  # tokens of a bucket
COMMON = 60_000  # words of the sample whose place in a list stands for them in a bucket's rows
CHUNK = 1_000_000  # tokens that a task splits at once
BASE, VALUE = 27, 22  # binary places of a text's sums in a bucket
_EXACT = 200  # customers up to which Stirling numbers come from their recurrence


def words(text: str | None) -> list[bytes]:
    """Words of the whole text, A-Z lower-cased, then the end token."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    found.append(END)
    return found


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 1 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 1


# ---- drawing tables ------------------------------------------------------------


@lru_cache(maxsize=8)
def stirling(d: float, top: int = _EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of c customers at t tables, c and t up to ``top``."""
    s = np.full((top + 1, top + 1), -np.inf)
    s[1, 1] = 0
    for c in range(1, top):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            s[c + 1, t] = np.logaddexp(s[c, t - 1], np.where(t <= c, np.log(np.maximum(c - t * d, 1e-300)) + s[c, t], -np.inf))
    return s


@lru_cache(maxsize=8)
def _saddle(d: float) -> tuple[np.ndarray, np.ndarray]:
    """(log of customers a table, log y) along the saddle points x = 1 - y of ((1 - (1 - x)^d) / d)^t."""
    y = np.concatenate([np.exp(np.linspace(math.log(1e-60), math.log(0.5), 40_000)), 1 - np.exp(np.linspace(math.log(0.5), math.log(1e-9), 4_000))])
    a = np.log((1 - y) * d * y ** (d - 1) / (1 - y**d))
    order = np.argsort(a)
    return a[order], np.log(y[order])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function, by Stirling's series above seven."""
    z = x + 7
    rising = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(rising)


def stirling_of_many(c: int, t: np.ndarray, d: float) -> np.ndarray:
    """The same logarithms for more customers and an array of tables.

    c! / (t! d^t) times the chance that t draws with generating function 1 - (1 - x)^d add
    up to c. Up to 1.5 c^d tables that chance is the sum of its binomial expansion, whose
    terms fall fast there; beyond, it comes from the saddle point.
    """
    out = np.empty(len(t))
    few = t <= 1.5 * c**d
    j = np.arange(1, 81)[:, None]
    some = t[few]
    with np.errstate(divide="ignore"):
        falling = np.cumsum(np.log(np.maximum(some - j + 1, 0)), axis=0)  # t! / (t - j)!, none for j > t
    size = falling - _lgamma(j + 1.0) + _lgamma(1 + d * j) + _lgamma(c - d * j)
    top = size.max(axis=0)
    chance = np.log((np.exp(size - top) * np.sin(math.pi * d * j) * (-1.0) ** (j + 1)).sum(axis=0) / math.pi) + top
    out[few] = chance - _lgamma(some + 1) - some * math.log(d)
    at, log_y = _saddle(d)
    many = t[~few]
    y = np.exp(np.interp(np.log(c / many), at, log_y))
    x, f = 1 - y, (1 - y**d) / d
    ratio = x * y ** (d - 1) / f
    spread = np.maximum(ratio * (1 + x * (1 - d) / y - ratio), 1e-300)
    log_c = _lgamma(np.array([c + 1.0]))[0]
    out[~few] = log_c - _lgamma(many + 1) + many * np.log(f) - c * np.log1p(-y) - 0.5 * np.log(2 * math.pi * many * spread)
    out[t == c] = 0.0
    return out


@lru_cache(maxsize=3000)
def _numbers_of_tables(c: int, d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of tables for c customers, of how many each stands (those beyond 64 for the run up to the next one), and the logarithms of their weights."""
    t = np.unique(np.concatenate([np.arange(1, 65), np.geomspace(64, c, 250).astype(np.int64)]))
    wide = np.diff(t, append=c + 1)
    return t, wide, stirling_of_many(c, t.astype(float), d) + np.log(wide)


def draw_tables(c: np.ndarray, weight: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of many dishes of ``c`` customers, drawn with weight S(c, t) * weight^t; none without customers."""
    tables = np.minimum(c, 1).astype(np.int64)
    log_weight = np.log(np.maximum(weight, 1e-300))
    two = np.flatnonzero(c == 2)
    tables[two] = 1 + (1 - d < rng.random(len(two)) * (1 - d + weight[two]))
    low = 2
    for high in (4, 12, 48, _EXACT):
        some = np.flatnonzero((c > low) & (c <= high))
        for at in np.array_split(some, 1 + len(some) * high // 2_000_000):
            if len(at):
                t = np.arange(1, high + 1)
                tables[at] = 1 + _pick(stirling(d)[c[at], 1 : high + 1] + log_weight[at, None] * t, rng)
        low = high
    for i in np.flatnonzero(c > _EXACT):
        t, wide, logs = _numbers_of_tables(int(c[i]), d)
        first = _pick((logs + log_weight[i] * t)[None], rng)[0]
        tables[i] = t[first] + rng.integers(wide[first])
    return tables


def _pick(logs: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    p = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
    return (p < rng.random((len(p), 1)) * p[:, -1:]).sum(axis=1)


def predictive(c, t, d: float, strength: float, customers, tables, parent) -> np.ndarray:
    """Probability of a dish with c customers and t tables in a restaurant, given the parent's."""
    return (np.maximum(c - d * t, 0) + (strength + d * tables) * parent) / (strength + customers)


# ---- from texts to buckets ------------------------------------------------------


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = xxhash.xxh64_intdigest(word)
        return self[word]


def _mix(a: np.ndarray, b) -> np.ndarray:
    """A hash of two unsigned 64-bit numbers."""
    x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value, byte by byte of their numbers."""
    planes = []
    for a in arrays:
        each = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)
        planes.append((a.dtype.str, np.ascontiguousarray(each.T).tobytes()))
    return zstandard.compress(pickle.dumps(planes), 3)


def _unpack(body: bytes) -> list[np.ndarray]:
    found = []
    for dtype, data in pickle.loads(zstandard.decompress(bytes(body))):
        planes = np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
        each = np.empty(planes.shape[::-1], np.uint8)
        for i, plane in enumerate(planes):
            each[:, i] = plane
        found.append(each.reshape(-1).view(dtype))
    return found


def _unique(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``keys``, which are below ``bound``, and the place of each among them; sorted together with their positions where both fit 64 bits."""
    bits = len(keys).bit_length()
    if not len(keys) or bound << bits >= 2**64:
        return np.unique(keys, return_inverse=True)
    both = np.sort((keys.astype(np.uint64) << np.uint64(bits)) | np.arange(len(keys), dtype=np.uint64))
    at = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    both >>= np.uint64(bits)
    first = np.concatenate([[True], both[1:] != both[:-1]])
    inverse = np.empty(len(keys), np.int64)
    inverse[at] = np.cumsum(first) - 1
    return both[first].astype(np.int64), inverse


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences of neighbours, which compress better than numbers that hardly fall; a sum over them gives the numbers back."""
    return np.diff(a.astype(np.uint32), prepend=np.uint32(0))


def _fixed(x: np.ndarray, bits: int) -> np.ndarray:
    """``x`` with ``bits`` binary places, as whole numbers, whose sums do not depend on their order."""
    return np.rint(np.ldexp(x, bits)).astype(np.int64)


class Layout:
    """How many buckets there are, the words that are dealt over several (sorted hashes, numbers of buckets), and common words' hashes."""

    def __init__(self, buckets: int, spread: dict[int, int], common=()):
        self.buckets = buckets
        self.common = np.array(common, np.uint64)
        self.hot = np.array(sorted(spread), np.uint64)
        self.parts = np.array([spread[h] for h in sorted(spread)], np.uint64)

    def number(self, word: np.ndarray) -> np.ndarray:
        """1 + position among the dealt words; 0 for others."""
        if not len(self.hot):
            return np.zeros(len(word), np.int64)
        at = np.minimum(np.searchsorted(self.hot, word), len(self.hot) - 1)
        return np.where(self.hot[at] == word, at + 1, 0)

    def bucket(self, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        k = self.number(word)
        parts = np.concatenate([np.ones(1, np.uint64), self.parts])[k]
        return (_mix(word, _mix(before, 1) % parts) % np.uint64(self.buckets)).astype(np.int64)


def plan_layout(rows: DataFrame, bucket: int = BUCKET) -> Layout:
    """Buckets of about ``bucket`` tokens, by the texts' length at six characters a token.

    Words that take over half a bucket are found on a sample of 2,000 rows and 20 a bucket; they
    decide only where tokens go. There are at most twice as many of them as buckets.
    """
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(chars / 6 / bucket))
    if buckets == 1:
        return Layout(1, {})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w, c = np.unique(np.array([w for t in b["text"] for w in map(_Hashes().__getitem__, words(t))], np.uint64), return_counts=True)
            yield pd.DataFrame({"w": w.view(np.int64), "c": c})

    counts = hashed_sample(rows.select("text"), 2000 + 20 * buckets, "text").mapInPandas(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    with Scratch(rows.sparkSession) as scratch:
        counts = scratch.cut(counts, "sampled")
        total = counts.agg(F.sum("c")).first()[0] or 0
        large = counts.filter(F.col("c") * 2 * buckets > total).collect()
        common = [r["w"] % 2**64 for r in counts.filter("c > 1").orderBy(F.desc("c"), "w").limit(COMMON).collect()]
    return Layout(buckets, {r["w"] % 2**64: math.ceil(2 * buckets * r["c"] / total) for r in large}, common)


def split(rows: DataFrame, layout: Layout, by_text: bool = True) -> DataFrame:
    """(bucket, chunk, body): the tokens of all rows, each with the two before it and its text; alike ones of a text once, with their number.

    A chunk is a run of texts of one task, of about ``CHUNK`` tokens. Not ``by_text``, alike
    ones of a chunk stand once, with their number in the texts that teach.
    """
    get = broadcast_value(rows.sparkSession, layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            found, counts = _words_of(b.column("text"))
            starts = np.cumsum([0, *counts])
            null = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(b.column("doc_id"), 0).to_numpy()
            out = b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            at = 0
            while at < len(counts):
                upto = waiting + np.cumsum(counts[at:] + 1)
                stop = at + int(np.searchsorted(upto, CHUNK, side="right")) + 1
                end = min(stop, len(counts))
                held.append((ids[at:end], null[at:end], out[at:end], counts[at:end], found.slice(starts[at], starts[end] - starts[at])))
                waiting = upto[end - at - 1]
                if stop <= len(counts):
                    yield _dealt(held, chunk, get(), by_text)
                    chunk, held, waiting = chunk + 1, [], 0
                at = end
        if held:
            yield _dealt(held, chunk, get(), by_text)

    return rows.mapInArrow(run, "bucket int, chunk long, body binary")


def _words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts behind one another, as ``words`` has them, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = lists.flatten()
    filled = pc.binary_length(found).to_numpy(zero_copy_only=False) > 0
    upto = np.concatenate([[0], np.cumsum(filled)])
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
    return (found if filled.all() else found.filter(pa.array(filled))), np.diff(upto[offsets])


def _dealt(held: list[tuple], chunk: int, layout: Layout, by_text: bool) -> pa.RecordBatch:
    ids, null, out, counts = (np.concatenate([x[i] for x in held]) for i in range(4))
    coded = pa.concat_arrays([x[4] for x in held]).dictionary_encode()
    names = [END, *coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)]
    vocabulary, own = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names)), return_inverse=True)
    sizes = counts + 1
    last = np.cumsum(sizes) - 1
    first = last + 1 - sizes
    code = np.full(sizes.sum(), own[0])
    inside = np.ones(len(code), bool)
    inside[last] = False
    code[inside] = own[1 + coded.indices.to_numpy(zero_copy_only=False)]
    del coded, names, inside
    times = np.bincount(code, minlength=len(vocabulary))
    order = np.argsort(-times, kind="stable")  # frequent words get small codes, which compress well
    listed = np.argsort(layout.common)
    place = np.searchsorted(layout.common, vocabulary, sorter=listed)
    common = place < len(listed)
    common[common] = layout.common[listed[place[common]]] == vocabulary[common]
    place[common] = listed[place[common]]
    order = order[~common[order]]
    place[order] = len(listed) + np.arange(len(order))  # words that are not listed follow, until each body numbers its own
    size = len(listed) + len(order)
    known = np.concatenate([layout.common, vocabulary[order]])
    word = place.astype(np.int32)[code]  # half the memory of whole words of the machine
    del code, place
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), sizes)
    u1 = np.roll(word, 1)
    u1[first] = word[-1]
    u2 = np.roll(u1, 1)
    u2[first] = word[-1]
    bucket = layout.bucket(known, np.zeros(len(known), np.uint64)).astype(np.int32)[u1]
    hot = np.flatnonzero((layout.number(known) > 0)[u1])
    bucket[hot] = layout.bucket(known[u1[hot]], known[u2[hot]])
    home = bucket[last]  # the bucket of a text's last token, which alone gets its id
    if not by_text and 2 * layout.buckets * size**3 < 2**64:
        # nothing but the key is asked of a token here, so the keys alone are sorted, with whether they teach
        key = bucket.astype(np.uint64)
        for column, bound in ((u1, size), (word, size), (u2, size), (~out[doc], 2)):
            key *= np.uint64(bound)
            key += column.astype(np.uint64)
        key.sort()
        teaches = (key & np.uint64(1)).astype(np.uint32)
        key >>= np.uint64(1)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        m = np.add.reduceat(teaches, starts)
        bucket, u1, word, u2 = _apart(key[starts], size)
        del key, teaches, doc
    else:
        if by_text:
            at = _ordered((bucket, u1, word), (layout.buckets, size, size))
            columns = (word, u1, u2, doc)
        else:
            at = _ordered((bucket, u1, word, u2), (layout.buckets, size, size, size))
            columns = (word, u1, u2)
        new = np.zeros(len(at), bool)
        new[0] = True
        for x in columns:
            x = x[at]
            new[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(new)
        m = np.add.reduceat((np.ones(len(at), np.uint32) if by_text else (~out[doc[at]]).astype(np.uint32)), starts)
        at = at[starts]
        bucket, u1, word, u2, doc = (x[at] for x in (bucket, u1, word, u2, doc))
        del columns, x, at
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    bodies = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        used = np.concatenate([u2[lo:hi], u1[lo:hi], word[lo:hi]])
        far = used >= len(listed)
        rare, own = np.unique(used[far], return_inverse=True)
        used[far] = len(listed) + own
        c2, c1, c0 = np.split(used, 3)
        docs, d = np.unique(doc[lo:hi], return_inverse=True) if by_text else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        here = docs[home[docs] == bucket[lo]]
        bodies.append(
            _pack(known[rare], c2.astype(np.uint32), _steps(c1), _steps(c0), d.astype(np.uint32), m[lo:hi], _steps(docs), out[docs], _steps(here), ids[here], null[here])
        )
    kinds = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("body", pa.binary())])
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array(np.full(len(bodies), chunk)), pa.array(bodies, pa.binary())], schema=kinds)


def _apart(key: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """The four numbers that ``key`` was made of, of which the last three are below ``size``."""
    found = []
    for _ in range(3):
        rest = key // np.uint64(size)
        found.append((key - rest * np.uint64(size)).astype(np.int32))
        key = rest
    return key.astype(np.int32), *found[::-1]


def _ordered(columns: tuple[np.ndarray, ...], bounds: tuple[int, ...]) -> np.ndarray:
    """Positions of rows by their columns, the first one first, rows alike as they stood; each column is below its bound."""
    bits = len(columns[0]).bit_length()
    if math.prod(bounds) < 2**64:
        key = columns[0].astype(np.uint64)
        for column, bound in zip(columns[1:], bounds[1:]):
            key *= np.uint64(bound)
            key += column.astype(np.uint64)
        if math.prod(bounds) << bits >= 2**64:
            return np.argsort(key, kind="stable")
        key <<= np.uint64(bits)
        key |= np.arange(len(key), dtype=np.uint64)
        key.sort()
        key &= np.uint64((1 << bits) - 1)
        return key.view(np.int64)
    return np.lexsort(columns[::-1])


# ---- a bucket's restaurants --------------------------------------------------------


class Bucket:
    """The restaurants of a bucket's words and pairs of words, and its texts' tokens."""

    def __init__(self, bodies, layout: Layout):
        parts = [_unpack(b) for b in bodies]
        listed = len(layout.common)
        self.words, code = np.unique(np.concatenate([layout.common, *(p[0] for p in parts)]), return_inverse=True)
        starts = np.cumsum([0, *(len(p[0]) for p in parts)])
        doc_starts = np.cumsum([0, *(len(p[6]) for p in parts)])
        for p, s in zip(parts, starts):
            for i in (2, 3, 6, 8):
                p[i] = np.cumsum(p[i], dtype=np.uint32)
            for i in (1, 2, 3):  # places in the list stay, those beyond it move to the words of this row
                p[i] = code[np.where(p[i] < listed, p[i], p[i] + s)]
        u2, u1, w = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        self.doc = np.concatenate([p[4].astype(np.uint32) + np.uint32(s) for p, s in zip(parts, doc_starts)])
        self.m = np.concatenate([p[5] for p in parts]).astype(np.float64)
        self.out = np.concatenate([p[7] for p in parts])
        self.texts = [(p[6], *p[8:]) for p in parts]  # by row: numbers in the chunk, and those, ids and null ids of texts at home here
        del parts, code
        size = len(self.words)
        taught = np.where(self.out[self.doc], 0.0, self.m) if len(self.doc) else self.m
        self.u1, self.count = u1.astype(np.uint32), np.bincount(u1, taught, size).astype(np.int64)
        self.pairs, pair = _unique(u1 * size + w, size**2)
        del w
        dishes, self.dish = _unique(u2 * len(self.pairs) + pair, size * len(self.pairs))
        del u2, pair
        self.c = np.bincount(self.dish, taught, len(dishes)).astype(np.int64)
        self.pair = dishes % len(self.pairs)
        self.pu, self.pw = self.pairs // size, self.pairs % size
        _, self.house = _unique(dishes // len(self.pairs) * size + self.pu[self.pair], size**2)
        del dishes
        self.customers = np.bincount(self.house, self.c)
        self.many = np.flatnonzero(self.c > 1)  # one customer always has one table
        self.busy, self.busy_at = np.unique(self.house[self.many], return_inverse=True)
        self.up, self.up_at = np.unique(self.pair[self.many], return_inverse=True)
        alone = self.c == 1
        self.alone = np.bincount(self.house[alone], minlength=len(self.customers)).astype(np.float64)  # tables of dishes of one customer, which never move
        self.alone_c2 = np.bincount(self.pair[alone], minlength=len(self.pairs))
        self.own = np.flatnonzero(np.diff(self.pu, prepend=-1))  # pairs are sorted, so each first word is a run of them
        self.run = np.cumsum(np.diff(self.pu, prepend=-1) != 0) - 1
        number = layout.number(self.words)
        self.number = number  # of each word among those dealt over several buckets
        self.k = number[self.pu]
        self.root = np.full(size, 1 / (size + 1))
        self.given = np.full(len(self.pairs), np.nan)  # probabilities in restaurants that are seated elsewhere
        self.seated = PAIR[1] + self.customers
        self.dish_seated = self.seated[self.house]
        self.many_pair, self.many_c = self.pair[self.many], self.c[self.many]
        self.own_alone = np.where(alone, 1 - PAIR[0], 0.0) / self.dish_seated
        self.t, self.c2 = np.minimum(self.c, 1), None
        self._hand_up()
        self.t2 = np.minimum(self.c2, 1)

    def asked(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(k, place, edges) of what the restaurants above know, by part: words in the root (k = 0), pairs in the words dealt over buckets.

        Part i is what lies from edge i to edge i + 1.
        """
        own = self.k == 0
        seen = np.unique(self.pw[own])
        other = np.flatnonzero(~own)
        k = np.concatenate([np.zeros(len(seen), np.int64), self.k[other]])
        part = _mix(self.words[np.concatenate([seen, self.pw[other]])], 7) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        return k[order], np.concatenate([seen, other])[order], np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))

    def take(self, parts: int, replies) -> None:
        """Probabilities from the restaurants above: (part, in the order in which it was asked)."""
        k, place, edges = self.asked(parts)
        p = np.full(len(k), np.nan)
        for part, found in replies:
            p[edges[part] : edges[part + 1]] = found
        root = (k == 0) & ~np.isnan(p)
        self.root[place[root]] = p[root]
        self.given[place[k > 0]] = p[k > 0]

    def _hand_up(self) -> None:
        self.c2 = self.alone_c2.copy()
        self.c2[self.up] += np.bincount(self.up_at, self.t[self.many], len(self.up)).astype(np.int64)

    def _tables(self) -> np.ndarray:
        """Tables of each pair's restaurant."""
        tables = self.alone.copy()
        tables[self.busy] += np.bincount(self.busy_at, self.t[self.many], len(self.busy))
        return tables

    def _by_word(self, x: np.ndarray) -> np.ndarray:
        """``x`` of the pairs, summed by their first words."""
        return np.add.reduceat(x, self.own) if len(x) else x

    def _above(self, at=slice(None), less=0) -> np.ndarray:
        """Probability of the second word of the pairs ``at`` after the first, without ``less`` customers of it."""
        d, strength = WORD
        u = self.run[at]
        c = np.maximum(self.c2[at] - less, 0)
        p = np.maximum(c - d * np.minimum(self.t2[at], c), 0)
        p += (strength + d * self._by_word(self.t2))[u] * self.root[self.pw[at]]  # ``predictive``, with what a word's pairs share worked out once
        p /= (strength + self._by_word(self.c2))[u]
        given = self.given[at]
        known = np.flatnonzero(~np.isnan(given))
        p[known] = given[known]
        return p

    def sweep(self, rng: np.random.Generator) -> None:
        d, strength = PAIR
        many = self.many
        v = rng.gamma(strength / d + self._tables()[self.busy])
        weight = d * v[self.busy_at] * self._above(self.many_pair, self.t[many])
        self.t[many] = draw_tables(self.many_c, weight, d, rng)
        self._hand_up()
        d, strength = WORD
        tables = self._by_word(self.t2)
        self.t2 = np.minimum(self.c2, 1)
        many = np.flatnonzero(self.c2 > 1)
        at = np.cumsum(np.diff(self.run[many], prepend=-1) != 0) - 1
        busy = self.run[many[np.flatnonzero(np.diff(at, prepend=-1))]]
        self.t2[many] = draw_tables(self.c2[many], d * rng.gamma(strength / d + tables[busy])[at] * self.root[self.pw[many]], d, rng)

    def probabilities(self) -> np.ndarray:
        """Of each dish, after its pair of words."""
        d, strength = PAIR
        room = (strength + d * self._tables()) / self.seated
        out = room[self.house]
        out *= self._above()[self.pair]
        own = self.own_alone.copy()
        own[self.many] = np.maximum(self.many_c - d * self.t[self.many], 0) / self.dish_seated[self.many]
        out += own
        return out

    def messages(self, number: int, parts: int) -> pd.DataFrame:
        """What the restaurants above need: customers by (k, word), in ``parts`` by the word's hash; counts of words in the rows without a part."""
        k, place, edges = self.asked(parts)
        root = k == 0
        w = self.words[np.where(root, place, self.pw[np.where(root, 0, place)])]
        own = self.k == 0
        c = np.where(root, np.bincount(self.pw[own], self.t2[own], len(self.words))[np.where(root, place, 0)], self.c2[np.where(root, 0, place)]).astype(np.int64)
        cuts = [(p, slice(*edges[p : p + 2])) for p in np.flatnonzero(np.diff(edges))]
        rows = [(int(p), number, 0, 0, 0, _pack(k[at].astype(np.uint32), w[at], c[at].astype(np.uint32))) for p, at in cuts]
        hot = np.flatnonzero((self.number > 0) & (np.bincount(self.pu, minlength=len(self.words)) > 0))
        rows += [(-1, number, int(self.number[i]), int(self.count[i]), 0, None) for i in hot]
        plain = self.number == 0
        rows.append((-1, number, 0, int(self.count[plain].sum()), int((self.count[plain] > 0).sum()), None))
        return pd.DataFrame(rows, columns=["part", "bucket", "k", "n", "v", "body"])


def seat_above(bodies, kinds: int, v: int, customers: np.ndarray | None, tables: np.ndarray | None, seed: int):
    """Seat what the buckets handed up: (k, words, customers, tables, probability in the root, place of each sent row).

    ``customers`` and ``tables``: of all parts, by k; without them each dish has one table.
    """
    sent = [_unpack(b) for b in bodies]
    k, w, c = (np.concatenate([s[i] for s in sent]) for i in range(3))
    _, first, inverse = np.unique(_mix(w, k.astype(np.uint64)), return_index=True, return_inverse=True)
    c = np.bincount(inverse, c, len(first)).astype(np.int64)
    k, w = k[first].astype(np.int64), w[first]
    names, at = np.unique(w, return_inverse=True)
    own = np.bincount(at[k == 0], c[k == 0], len(names)).astype(np.int64)
    hot = k > 0
    t = np.minimum(c, 1)
    root_t = np.minimum(own + np.bincount(at[hot], t[hot], len(names)), 1).astype(np.int64)
    rng = np.random.default_rng(seed)
    if customers is not None:
        for _ in range(3):
            root_c = own + np.bincount(at[hot], t[hot], len(names)).astype(np.int64)
            less = root_c[at] - t
            p = predictive(less, np.minimum(root_t[at], less), *ROOT, customers[0], tables[0], 1 / (v + 1))
            d, strength = WORD
            aux = np.array([np.random.default_rng((seed, i)).gamma(strength / d + x) for i, x in enumerate(tables)])
            t[hot] = draw_tables(c[hot], d * aux[k[hot]] * p[hot], d, rng)
            root_c = own + np.bincount(at[hot], t[hot], len(names)).astype(np.int64)
            d, strength = ROOT
            root_t = draw_tables(root_c, np.full(len(names), d * rng.gamma(strength / d + tables[0]) / (v + 1)), d, rng)
    root_c = own + np.bincount(at[hot], t[hot], len(names)).astype(np.int64)
    total = np.zeros((2, kinds))
    for row, x, y in ((0, c, root_c), (1, t, root_t)):
        total[row] = np.bincount(k[hot], x[hot], kinds)
        total[row, 0] = y.sum()
    return k, w, c, t, root_c[at], root_t[at], total, inverse, [len(s[0]) for s in sent]


def _totals(messages: DataFrame, layout: Layout, v: int, found) -> tuple[np.ndarray, np.ndarray]:
    """(customers, tables) by k over all parts, of the seating that ``found`` of an earlier pass leads to."""
    kinds = len(layout.hot) + 1

    def run(b: pd.DataFrame) -> pd.DataFrame:
        total = seat_above(b.sort_values("bucket")["body"], kinds, v, *found, seed=int(b["part"].iloc[0]))[6]
        some = np.flatnonzero(total[0])
        return pd.DataFrame({"k": some, "c": total[0][some], "t": total[1][some]})

    rows = messages.groupBy("part").applyInPandas(run, "k long, c double, t double").groupBy("k").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).collect()
    out = np.zeros((2, kinds))
    for r in rows:
        out[:, r["k"]] = r["c"], r["t"]
    return out[0], out[1]


def _replies(messages: DataFrame, layout: Layout, v: int) -> DataFrame:
    """(bucket, part, body): probabilities in the root and in the dealt words' restaurants, in the order in which customers were sent."""
    kinds = len(layout.hot) + 1
    start = _totals(messages, layout, v, (None, None))
    seated = _totals(messages, layout, v, start)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("bucket")
        k, w, c, t, root_c, root_t, _, inverse, sizes = seat_above(b["body"], kinds, v, *start, seed=int(b["part"].iloc[0]))
        customers, tables = seated
        root = predictive(root_c, root_t, *ROOT, customers[0], tables[0], 1 / (v + 1))
        p = np.where(k > 0, predictive(c, t, *WORD, customers[k], tables[k], root), root)
        cuts = np.cumsum(sizes)[:-1]
        bodies = [_pack(p[i].astype(np.float32)) for i in np.split(inverse, cuts)]
        return pd.DataFrame({"bucket": b["bucket"].to_numpy(), "part": b["part"].to_numpy(), "body": bodies})

    return messages.groupBy("part").applyInPandas(run, "bucket int, part int, body binary")


# ---- scoring ----------------------------------------------------------------------------


def score(docs: DataFrame, bucket: int = BUCKET, burn_in: int = 3, samples: int = 4) -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from the rows that are not held out, scores all. Null text counts as
    empty: the end token alone. Without any training rows every token has base
    and model probability one. Repeated rows are scored alike; columns other than
    doc_id and text are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    with Scratch(spark) as scratch, _freed_shuffles(spark):
        # a text's number is its place in its task's rows, which a task that is run again must find as they were
        rows = scratch.keep(rows, "rows") if "Exchange" in rows._jdf.queryExecution().executedPlan().toString() else rows
        layout = plan_layout(rows, bucket)
        get = broadcast_value(spark, layout)
        learned = split(rows, layout, by_text=False).groupBy("bucket").applyInPandas(_learner(get, burn_in), "part int, bucket int, k int, n long, v long, body binary")
        sent = scratch.cut(learned, "messages")
        stats = {r["k"]: (r["n"], r["v"]) for r in sent.filter("part < 0").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
        n = sum(x for x, _ in stats.values())
        counts = np.array([0, *(stats.get(k + 1, (0, 0))[0] for k in range(len(layout.hot)))])
        v = sum(x for _, x in stats.values()) + int((counts > 0).sum())
        replies = scratch.keep(_replies(sent.filter("part >= 0").select("part", "bucket", "body"), layout, v), "replies")
    scored = split(rows, layout).groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInPandas(
        _scorer(get, broadcast_value(spark, counts), burn_in, samples),
        "chunk long, body binary",
    )
    each = scored.groupBy("chunk").applyInPandas(_add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    base = F.col("base_score") - F.col("n_tokens") * math.log10(n + 0.5 * (v + 1))
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return each.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", perplexity.alias("perplexity"))


@contextmanager
def _freed_shuffles(spark) -> Iterator[None]:
    """Spark deletes the shuffle files of each query that runs in here when it ends, so that those of the passes never lie on disk together."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _parts(layout: Layout) -> int:
    """In how many parts the root is seated."""
    return max(1, layout.buckets // 4)


def _learner(get: Callable, sweeps: int) -> Callable:
    def run(b: pd.DataFrame) -> pd.DataFrame:
        layout, number = get(), int(b["bucket"].iloc[0])
        here = Bucket(b["body"], layout)
        rng = np.random.default_rng((1, number))
        for _ in range(sweeps):
            here.sweep(rng)
        return here.messages(number, _parts(layout))

    return run


def _scorer(get: Callable, get_counts: Callable, burn_in: int, samples: int) -> Callable:
    def run(b: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        layout, number = get(), int(b["bucket"].iloc[0])
        here = Bucket(b["body"], layout)
        here.take(_parts(layout), ((int(part), *_unpack(body)) for part, body in zip(replies["part"], replies["body"])))
        rng = np.random.default_rng((2, number))
        p = np.zeros(len(here.c))
        for s in range(burn_in + samples):
            here.sweep(rng)
            if s >= burn_in:
                p += here.probabilities() / samples
        count = np.where(here.number > 0, get_counts()[here.number], here.count)
        p = np.log10(p)

        def sums(x) -> np.ndarray:
            return np.bincount(here.doc, here.m * x, len(here.out))

        found = sums(1).astype(np.uint32), sums((count > 0)[here.u1]).astype(np.uint32), _fixed(sums(np.log10(count + 0.5)[here.u1]), BASE), _fixed(sums(p[here.dish]), VALUE), here.out
        cuts = np.cumsum([len(docs) for docs, *_ in here.texts])[:-1]
        bodies = [_pack(_steps(docs), *each, _steps(home), *ids) for (docs, home, *ids), *each in zip(here.texts, *(np.split(x, cuts) for x in found))]
        return pd.DataFrame({"chunk": b["chunk"].to_numpy(), "body": bodies})

    return run


def _add_up(b: pd.DataFrame) -> pd.DataFrame:
    """The texts of a chunk, from what the buckets say about them."""
    parts = [_unpack(x) for x in b["body"]]
    docs, home = (np.concatenate([np.cumsum(p[i], dtype=np.uint32) for p in parts]) for i in (0, 6))
    n, known, base, value, out, ids, null = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3, 4, 5, 7, 8))
    total = np.zeros((4, len(home)), np.int64)
    for row, x in zip(total, (n, known, base, value)):
        np.add.at(row, docs, x.astype(np.int64))
    held = np.zeros(len(home), bool)
    held[docs] = out
    return pd.DataFrame(
        {
            "doc_id": pd.arrays.IntegerArray(ids, null),
            "held_out": held[home],
            "n_tokens": total[0, home],
            "n_known": total[1, home],
            "base_score": np.ldexp(total[2, home].astype(float), -BASE),
            "score": np.ldexp(total[3, home].astype(float), -VALUE),
        }
    )
