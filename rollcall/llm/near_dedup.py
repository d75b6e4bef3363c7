"""Near-duplicate grouping: SuperMinHash signatures, banding, verification, union of links.

1. Every document's set of word shingles gives a digest and a SuperMinHash signature.
   Documents with one digest form a class; all later work is on classes.
2. Bands of the signature put classes into buckets. In each bucket every class is
   paired with the bucket's smallest (a star, not all pairs). Pairs whose sizes or
   signatures rule the threshold out are dropped, and each class's likeliest center is
   verified on the full sets.
3. Buckets that still hold several components are searched, by signatures alone, for
   the pairs across components that a star can miss. What such pairs connect is a
   neighbourhood; each class lies in one at most, so its full set is fetched once.
   Inside a neighbourhood every class is compared on full sets with the classes of
   other components.

A bucket or neighbourhood too large for one task is dealt into cells. A cell holds some
residents; only classes outside the largest component visit every cell, and a class
whose set, but for shingles that no other component has, is too small to link is left
out first. Links are joined by spreading the smallest label, with pointer jumping.

Sets are not stored: those of the few classes that need one are made again from the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import Scratch, fresh

LENGTH, BANDS, ROWS = 256, 51, 5  # signature length, bands and rows a band: a pair at 0.8 misses all bands once in 6e8
SLACK = 0.14  # 5.6 standard deviations of the estimate at 0.8: a pair there fails once in 2e7
CELL_CLASSES, CELL_SHINGLES = 512, 1 << 19  # residents of a cell, and shingles of theirs, about
_FILTER_BITS = 1 << 25
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``size``-word shingles; all words as one if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, _U)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b"\x00".join(words), seed=1)], _U)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words))
    n = len(h) - size + 1
    out = h[:n]
    for k in range(1, size):
        out = _mixed(out) ^ h[k : k + n]
    return np.unique(_mixed(out))


def super_minhash(items: np.ndarray, length: int = LENGTH, chunk: int = 4096) -> np.ndarray:
    """SuperMinHash of 64-bit items: per item a random permutation of the slots; slot p[j] is offered rank j plus a random part.

    Ranks are visited for all items at once and stop as soon as no slot can get
    lower. Values hold the rank above 25 random bits, so slots compare as integers.
    """
    best = np.full(length, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(items), chunk):
        part = items[begin : begin + chunk]
        n, every = len(part), np.arange(len(part))
        slots = np.tile(np.arange(length, dtype=np.uint8 if length <= 256 else np.uint16), (n, 1))
        state = _mixed(part)
        for j in range(length):
            if int(best.max()) >> 25 < j:
                break  # rank j can't lower any slot
            state = _mixed(state)
            r = (state >> _U(39)).astype(np.uint32)
            k = j + ((state & _U(0xFFFFFFFF)) * _U(length - j) >> _U(32)).astype(np.int64)
            chosen = slots[every, k]
            slots[every, k] = slots[:, j]
            slots[:, j] = chosen
            np.minimum.at(best, chosen, np.uint32(j << 25) | r)
    return best


def _mark() -> Column:
    """128 bits that stand for a row's doc_id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.concat(F.lit("\0t"), F.col("text")), F.lit("\0")))))


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """A row per document row: row (unique), doc_id, mark, n, digest, signature (8 bits a slot)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            for k in range(0, len(b), 500):
                part, out = b.iloc[k : k + 500], []
                for d, t, m in zip(part["doc_id"], part["text"], part["mark"]):
                    s = shingles(t, size)
                    digest = hashlib.md5(s.tobytes()).digest() if len(s) else None
                    out.append((row, d, m, len(s), digest, super_minhash(s).astype(np.uint8).tobytes() if len(s) else None))
                    row += 1
                yield pd.DataFrame(out, columns=["row", "doc_id", "mark", "n", "digest", "signature"]).astype({"doc_id": "Int64"})

    schema = "row long, doc_id long, mark binary, n long, digest binary, signature binary"
    return docs.select(F.col("doc_id").cast("long"), "text", _mark().alias("mark")).mapInPandas(run, schema)


def components(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` (node, comp) after joining what ``links`` (a, b) connect: comp is the smallest node reachable.

    Works on components, so the labels are read once; each round spreads the
    smallest neighbour and then jumps to the label's own label.
    """
    at = labels.select(F.col("node"), F.col("comp"))
    ends = links.join(at.withColumnsRenamed({"node": "a", "comp": "u"}), "a").join(at.withColumnsRenamed({"node": "b", "comp": "v"}), "b")
    edges = scratch.cut(ends.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    if edges.isEmpty():
        return labels
    # larger end -> smaller end, until every vertex points at a root
    while True:
        low = edges.groupBy("v").agg(F.min("u").alias("root"))
        # hang each vertex's other neighbours below its smallest one
        spread = edges.join(low, "v").filter("u <> root").select(F.col("root").alias("u"), F.col("u").alias("v")).distinct()
        kept = low.select(F.col("root").alias("u"), "v")
        both = kept.unionByName(spread)
        # point past a vertex that has a root of its own
        jumped = both.join(low.withColumnsRenamed({"v": "u", "root": "up"}), "u", "left").select(F.coalesce("up", "u").alias("u"), "v", F.col("up").isNotNull().alias("moved"))
        step = scratch.cut(jumped.filter("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("moved").alias("moved")), "edges")
        scratch.drop(edges)
        state = step.agg(F.max("moved").alias("moved"), F.count("*").alias("n"), F.countDistinct("v").alias("m")).first()
        edges = step
        if not state["moved"] and state["n"] == state["m"]:
            break
    renamed = edges.select(F.col("v").alias("comp"), F.col("u").alias("root"))
    return scratch.cut(labels.join(renamed, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "labels")


def _may_hold(wanted: DataFrame):
    """A test of marks that passes all those in ``wanted`` (mark) and few others: a bit map of fixed size, whatever the rows."""
    spark = wanted.sparkSession
    at = F.pmod(F.xxhash64("mark"), F.lit(_FILTER_BITS))
    maps = wanted.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    size = 4096
    bits = bytearray(size * (_FILTER_BITS // (8 * size) + 2))
    for m in maps:  # at most _FILTER_BITS / 32768 rows of 4096 bytes
        bits[size * m["k"] : size * (m["k"] + 1)] = m["bits"]
    shared = spark.sparkContext.broadcast(bytes(bits))

    @F.pandas_udf("boolean")
    def held(bucket: pd.Series, bit: pd.Series) -> pd.Series:
        map_ = np.frombuffer(shared.value, np.uint8)
        b = bit.to_numpy(np.int64)
        return pd.Series((map_[size * bucket.to_numpy(np.int64) + (b >> 3)] >> (b & 7) & 1).astype(bool))

    def test(mark: Column) -> Column:
        place = F.pmod(F.xxhash64(mark), F.lit(_FILTER_BITS))
        return held(F.bitmap_bucket_number(place), F.bitmap_bit_position(place))

    return test


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, items): the shingle sets of the classes in ``wanted`` (node, mark), made from their texts."""

    @F.pandas_udf(T.BinaryType())
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, size).tobytes() for t in texts], dtype=object)

    near = docs.select("text", _mark().alias("mark")).filter(_may_hold(wanted)(F.col("mark")))
    once = near.groupBy("mark").agg(F.first("text").alias("text"))
    return once.join(wanted.select("node", "mark"), "mark").select("node", made("text").alias("items"))


def _verified(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on their full sets."""

    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            a, b = np.frombuffer(x, _U), np.frombuffer(y, _U)
            both = np.concatenate([a, b])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            out.append(100 * shared >= percent * (len(a) + len(b) - shared))
        return pd.Series(out, dtype=bool)

    one = pairs.join(items.withColumnsRenamed({"node": "a", "items": "left"}), "a")
    two = one.join(items.withColumnsRenamed({"node": "b", "items": "right"}), "b")
    return two.filter(linked("left", "right")).select("a", "b")


@F.pandas_udf(T.DoubleType())
def _agreement(left: pd.Series, right: pd.Series) -> pd.Series:
    a = np.frombuffer(b"".join(left), np.uint8).reshape(len(left), -1)
    b = np.frombuffer(b"".join(right), np.uint8).reshape(len(right), -1)
    return pd.Series((a == b).mean(axis=1) if len(left) else np.zeros(0))


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can reach the threshold: the smaller one may lie in the larger."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _stars(members: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """(a, b, near): each class with the centers of its buckets, where sizes and signatures may reach the threshold."""
    pairs = members.filter((F.col("node") != F.col("center")) & _sizes_allow("n", "center_n", percent)).select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    left, right = signatures.withColumnsRenamed({"node": "a", "signature": "left"}), signatures.withColumnsRenamed({"node": "b", "signature": "right"})
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", _agreement("left", "right").alias("near")).filter(F.col("near") >= percent / 100 - SLACK)


def _with_blocks(rows: DataFrame, weight: Column, most: int) -> DataFrame:
    """``rows`` (key, node, comp, ...) of the keys with several components, with the number of blocks that their key needs, its heaviest component and its number of components."""
    parts = rows.groupBy("key", "comp").agg(F.sum(weight).alias("w"), F.count("*").alias("k"))
    keys = parts.groupBy("key").agg(F.sum("w").alias("w"), F.sum("k").alias("k"), F.max_by("comp", F.struct("w", "comp")).alias("main"), F.count("*").alias("n_comps")).filter("n_comps > 1")
    blocks = F.greatest(F.ceil(F.col("w") / most), F.ceil(F.col("k") / CELL_CLASSES)).cast("int").alias("blocks")
    return rows.join(keys.select("key", "main", "n_comps", blocks), "key")


def _dealt(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``_with_blocks`` in cells (key, cell): each as a resident of its own, those outside the heaviest component as visitors of all.

    A cell's residents stand before its visitors. Two components need no residents of the lighter one.
    """
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cell = lambda at, visitor: F.struct(at.alias("cell"), F.lit(visitor).alias("visitor"))
    home = F.when((F.col("comp") == F.col("main")) | (F.col("n_comps") > 2), F.array(cell(own, False))).otherwise(F.array().cast("array<struct<cell:int,visitor:boolean>>"))
    away = F.when(F.col("comp") != F.col("main"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: cell(j, True))).otherwise(F.array().cast("array<struct<cell:int,visitor:boolean>>"))
    spread = rows.withColumn("at", F.explode(F.concat(home, away))).select("key", "at.cell", "at.visitor", "node", "comp", *columns)
    return spread.repartition("key", "cell").sortWithinPartitions("key", "cell", "visitor")


class _Forest:
    """Union of nodes; says which links join two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _meetings(batches: Iterator[pd.DataFrame], columns: list[str], residents) -> Iterator[tuple[tuple[int, int], tuple, object]]:
    """(cell, visitor, residents of its cell) in turn; ``residents`` makes the third of a list of rows, once a cell. Only visitors of cells with residents come."""
    cell, held, made = None, [], None
    for b in batches:
        for r in zip(*(b[c] for c in ("key", "cell", "visitor", "node", "comp", *columns))):
            if r[:2] != cell:
                cell, held, made = r[:2], [], None
            if not r[2]:
                held.append(r[3:])
            elif held:
                if made is None:
                    made = residents(held)
                yield cell, r[3:], made


def _paired(dealt: DataFrame, columns: list[str], residents, partners, forest_of) -> DataFrame:
    """(a, b): for each cell the links that join trees, between a visitor and the residents that ``partners`` gives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, forest, found = None, _Forest(), []
        for cell, visitor, made in _meetings(batches, columns, residents):
            if cell != now:
                now, forest = cell, _Forest()
            x = forest_of(visitor)
            found += [(min(visitor[0], y), max(visitor[0], y)) for y, top in partners(visitor, made) if forest.join(x, top)]
            if len(found) > 10000:
                yield pd.DataFrame(found, columns=["a", "b"])
                found = []
        yield pd.DataFrame(found, columns=["a", "b"])

    return dealt.mapInPandas(run, "a long, b long").distinct()


def _near_links(open_: DataFrame, percent: int) -> DataFrame:
    """(a, b) that connect the classes of a bucket whose sizes and signatures may reach the threshold across components."""
    least = percent / 100 - SLACK

    def residents(rows):
        return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)

    def partners(visitor, made):
        node, comp, n, signature = made
        _, c, m, s = visitor
        likely = np.flatnonzero((comp != c) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
        near = likely[(signature[likely] == np.frombuffer(s, np.uint8)).mean(axis=1) >= least] if len(likely) else likely
        return [(y, y) for y in node[near].tolist()]

    columns = ["n", "signature"]
    return _paired(_dealt(open_, columns), columns, residents, partners, lambda visitor: visitor[0])


def _exact_links(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b) that join components: pairs of a cell that reach the threshold on their full sets."""

    def residents(rows):
        sets = [np.frombuffer(r[2], _U) for r in rows]
        sizes = np.array([len(s) for s in sets])
        values, places = np.unique(np.concatenate(sets), return_inverse=True)
        return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]]), values, places

    def partners(visitor, made):
        node, comp, sizes, starts, values, places = made
        items = np.frombuffer(visitor[2], _U)
        at = np.minimum(np.searchsorted(values, items), len(values) - 1)
        flag = np.zeros(len(values), bool)
        flag[at[values[at] == items]] = True
        shared = np.add.reduceat(flag[places], starts, dtype=np.int64)
        linked = np.flatnonzero((comp != visitor[1]) & (100 * shared >= percent * (sizes + len(items) - shared)))
        return list(zip(node[linked].tolist(), comp[linked].tolist()))

    return _paired(dealt, ["items"], residents, partners, lambda visitor: visitor[1])


def _narrowed(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (key, node, comp, items) that may link with another component of their key.

    Shingles that no other component of the key has can't be shared; a class links only if
    the rest make up ``percent`` of its set.
    """

    @F.pandas_udf("array<long>")
    def listed(items: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, np.int64) for x in items], dtype=object)

    each = rows.select("key", "node", "comp", F.explode(listed("items")).alias("shingle"))
    both = each.groupBy("key", "shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key", "shingle")
    counts = each.join(both, ["key", "shingle"]).groupBy("node").agg(F.count("*").alias("shared"))
    return rows.join(counts, "node").filter(100 * F.col("shared") >= percent * (F.length("items") / 8)).drop("shared")


def _neighbour_links(docs: DataFrame, classes: DataFrame, labels: DataFrame, near: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """The links across components within what ``near`` (a, b) connects."""
    nodes = scratch.cut(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    hoods = components(nodes.select("node", F.col("node").alias("comp")), near, scratch).withColumnRenamed("comp", "key")
    rows = hoods.join(labels, "node").join(classes.select("node", "mark"), "node")
    held = scratch.cut(rows.select("key", "node", "comp").join(_sets_of(docs, rows, size), "node"), "hoods")
    weight = F.length("items") / 8
    blocked = _with_blocks(held, weight, CELL_SHINGLES)
    links = _exact_links(_dealt(blocked.filter("blocks = 1"), ["items"]), percent)
    large = blocked.filter("blocks > 1").select("key", "node", "comp", "items")
    if large.isEmpty():
        return links
    left = scratch.cut(_narrowed(large, percent), "narrowed")
    return links.unionByName(_exact_links(_dealt(_with_blocks(left, weight, CELL_SHINGLES), ["items"]), percent))


def group(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept, mark.

    Two documents are linked if the Jaccard similarity of their sets of
    ``size``-word shingles is at least ``percent`` / 100. component_id is the
    smallest doc_id reachable; a document without words is linked with nothing and
    is its own component. ``kept`` marks rows whose doc_id is the component's. Null
    doc_ids take part, count last, and are kept only where a component has no other.
    Repeated rows agree in everything. Empty tables give no rows; other columns are
    not read. ``mark`` stands for a row's doc_id and text.
    """
    with Scratch(docs.sparkSession) as scratch:
        stored = scratch.cut(_signed(docs, size), "signed")
        full = stored.filter("n > 0")
        whole = full.groupBy("digest").agg(F.min(F.struct("row", "n", "mark", "signature")).alias("x"), F.min("doc_id").alias("least_id"))
        classes = scratch.cut(whole.select("digest", "least_id", F.col("x.row").alias("node"), "x.n", "x.mark", "x.signature"), "classes")
        labels = classes.select("node", F.col("node").alias("comp"))
        signatures = classes.select("node", "signature")
        # a band is five of the signature's bytes
        bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(F.substring("signature", k * ROWS + 1, F.lit(ROWS)), k))
        banded = classes.select("node", "n", F.explode(bands).alias("key"))
        buckets = banded.groupBy("key").agg(F.count("*").alias("k"), F.min(F.struct("node", "n")).alias("center")).filter("k > 1")
        members = scratch.cut(banded.join(buckets.select("key", F.col("center.node").alias("center"), F.col("center.n").alias("center_n")), "key"), "members")
        stars = scratch.cut(_stars(members, signatures, percent), "stars")
        pairs = scratch.cut(stars.groupBy("b").agg(F.max_by("a", F.struct("near", "a")).alias("a")), "pairs")
        if not pairs.isEmpty():
            wanted = classes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
            items = scratch.cut(_sets_of(docs, wanted, size), "items")
            links = scratch.cut(_verified(pairs, items, percent), "links")
            scratch.drop(items, stars, pairs)
            labels = components(labels, links, scratch)
            several = _with_blocks(members.select("key", "node", "n").join(labels, "node"), F.lit(1), CELL_CLASSES)
            near = scratch.cut(_near_links(several.join(signatures, "node"), percent), "near")
            scratch.drop(members)
            if not near.isEmpty():
                labels = components(labels, scratch.cut(_neighbour_links(docs, classes, labels, near, size, percent, scratch), "links"), scratch)

        named = labels.join(classes.select("node", "digest", "least_id"), "node")
        ids = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
        by_class = named.join(ids, "comp").select("digest", "component_id")
        found = full.select("doc_id", "n", "digest", "mark").join(by_class, "digest").drop("digest")
        alone = stored.filter("n = 0").select("doc_id", "n", "mark", F.col("doc_id").alias("component_id"))
        every = found.unionByName(alone)
        kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
        return scratch.keep(every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), "mark"), "grouped")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component, with its columns: the one with the smallest doc_id.

    A row that repeats in doc_id and text stays once. Documents without words all stay, once for
    each doc_id and text. An empty table stays empty; columns of any name pass through.

    Rows that surely stay are not shuffled: a bit map of fixed size of the others sorts them out.
    """
    grouped = group(docs, size, percent)
    with Scratch(docs.sparkSession) as scratch:
        rows = grouped.groupBy("mark").agg(F.max("kept").alias("kept"), F.count("*").alias("times"))
        odd = scratch.keep(rows.filter("not kept or times > 1"), "odd")
    mark, found = fresh(docs, "mark"), fresh(docs, "found")
    marked = docs.withColumn(mark, _mark())
    may_be_odd = _may_hold(odd)(F.col(mark))
    decided = odd.select(F.col("mark").alias(mark), F.col("kept").alias(found))
    sure = marked.filter(~may_be_odd).drop(mark)
    rest = marked.filter(may_be_odd).join(decided, mark, "left")
    single = rest.filter(F.col(found).isNull()).drop(mark, found)
    more = rest.filter(F.col(found)).dropDuplicates([mark]).drop(mark, found)
    return sure.unionByName(single).unionByName(more)
