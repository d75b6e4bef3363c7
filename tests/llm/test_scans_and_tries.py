"""Secret scans, spelling variants and prefix tries against brute force, and awkward inputs."""

import collections
import hashlib
import itertools
import math
import random
import re
import string
import time
import zlib

import numpy as np
import pytest

from rollcall.llm import prefix_trie, secret_scan, spelling
from rollcall.llm.common import Scratch

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, secrets string, word string, n int, node string"
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (None, "grenze Grenze GRENZE grenzen grenzen grenzen grenze"), (4, "über ÜBER übers übers übers übers"),
    (5, "kanal kanal kanal kanäle kanäle kanäle kana kana kana"), (5, "kanal kanal kanal kanäle kanäle kanäle kana kana kana"), (6, "a" * 3000 + " " + "a" * 3000 + " " + "a" * 3000),
    (6, "a" * 3001 + "\n" + "a" * 3001 + "\n" + "a" * 3001), (7, "x" * 50_000),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, "clash", "clash", 1, "clash") for r in AWKWARD], DOCS)


# ---- secrets -----------------------------------------------------------------

KEYED = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def plain_base(text):
    found = [("assign", *m.span()) for m in KEYED.finditer(text) if len(m.group(1)) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rng = random.Random(5)
    bits = ["token", "TOKEN", "apiKey", "api_key", "secret", "paſsword", "toKen", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIA" + "Q" * 16, "0123456789abcdef", "abcdef", "x", "\n", "é", "...."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    assert sum(len(plain_base(t)) for t in texts) > 500
    for t in texts:
        assert secret_scan.base_spans(t) == plain_base(t)


def test_random_strings_pass_the_battery_at_its_level():
    rng = random.Random(7)
    for e, (_, alphabet) in enumerate(secret_scan.ENCODINGS):
        ps = np.array([secret_scan.battery("".join(rng.choice(alphabet) for _ in range(40)), e) for _ in range(600)])
        assert (abs((ps < 0.1).mean(axis=0) - 0.1) < 0.07).all() and (ps < 0.001).mean() < 0.01


def test_false_discovery_bound_is_the_step_up_procedure():
    rng = random.Random(3)
    for _ in range(50):
        bins = [rng.choice([0, 0, 0, 1, 5, 20, 35, 60]) for _ in range(rng.randrange(1, 40))]
        rate = rng.choice([0.01, 0.1])
        ps = sorted(10 ** (-b * secret_scan._BIN) for b in bins)
        within = [p for k, p in enumerate(ps, 1) if p * len(ps) <= rate * k]
        least = secret_scan.step_up(collections.Counter((4, 2, b) for b in bins), rate).get((4, 2))
        assert {b for b in bins if least is not None and b >= least} == {b for b in bins if within and 10 ** (-b * secret_scan._BIN) <= max(within)}


def plain_ordinary(text, start):
    """(encoding, string) of a text's ordinary strings, word by word."""
    words = re.findall("[A-Za-z]{2,}", text)
    for e, (name, alphabet) in enumerate(secret_scan.ENCODINGS):
        part, number, turn = "", 0, start + e + 1
        for k, w in enumerate(words):
            number = (number * 31 + len(w) * 7 + k) % 2000
            digits = "" if k % 3 else str(number)
            if name.startswith("hex"):
                part += "".join(alphabet[ord(c) % 16] for c in w)
            elif name in ("lower", "upper"):
                part += getattr(w, name)()
            elif name == "base32":
                part += w.upper() + "".join(alphabet[26 + int(c) % 6] for c in digits)
            elif name.startswith("base36"):
                part += (w.lower() if name == "base36" else w.upper()) + digits
            else:
                part += (w.capitalize() if k % 2 or name == "base62" else w.lower()) + digits + (alphabet[62 + k % 2] if len(alphabet) == 64 else "")
            want = int(16 * 1.25 ** ((turn * 7 % 200) / 10 + 0.05))
            if len(part) >= want:
                if set(part[:want]) - set(string.digits):
                    yield e, part[:want]
                part, turn = "", turn + 1


def test_ordinary_strings_are_learned_from_all_texts(spark):
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice(string.ascii_letters) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "é", "7"]) for _ in range(rng.choice([0, 2, 6, 9, 40]))) for _ in range(3000)] + ["ab " * 9000]
    want = {}
    for t in {*texts}:
        for e, s in plain_ordinary(t, int(hashlib.md5(t.encode()).hexdigest()[:4], 16)):
            want.setdefault((e, secret_scan.band_of(len(s))), []).append(secret_scan.irregularity(secret_scan.battery(s, e)))
    rows = [(t,) for t in [*texts, *texts[:1500], *[texts[0]] * 50, None]]  # copies count once
    got = secret_scan.learn(spark.createDataFrame(rows, "text string").repartition(5))
    assert {k: n for k, (_, _, n) in got.items()} == {k: len(v) for k, v in want.items()}
    for k, v in want.items():
        assert abs(got[k][0] - np.mean(v)) < 1e-4 and (len(v) == 1 or abs(got[k][1] - max(np.std(v, ddof=1), 1e-3)) < 2e-3)


ORDINARY = [
    "ThisIsARatherLongCamelCaseIdentifierName", "snake_case_names_are_common_in_code_2024", "getUserAccountSettingsByAccountIdentifier", "INTERNATIONALIZATIONOFAPPLICATIONS",
    "2024-01-15T12-30-45-000-001", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "abcdefghijklmnopqrstuvwxyz0123456789", "donaudampfschifffahrtsgesellschaft", "the-quick-brown-fox-jumps-over-the-lazy-dog",
    "com/example/project/module/ClassNameImpl2", "1234567812345678", "98765432109876543210987654321098",
]


def test_planted_keys_are_found_and_ordinary_names_are_not(spark):
    rng = random.Random(11)
    rows = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    keys, docs = set(), []
    for i, t in enumerate(rows):
        w = (t or "").split(" ")
        if i % 4 == 0:
            keys.add(key := "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(64)))
            w.insert(rng.randrange(len(w) + 1), key)
        if i % 4 == 1:
            w.insert(rng.randrange(len(w) + 1), ORDINARY[i // 4 % len(ORDINARY)])
        docs.append((i, " ".join(w)))
    found = secret_scan.find(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    added, base = [], 0
    for r in found:
        spans = [x.split(":") for x in r["secrets"]["spans"].split(",") if x]
        kept = [(k, int(s), int(e)) for k, s, e in spans if k != "random"]
        assert kept == plain_base(r["text"])
        assert r["secrets"]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in kept).encode()).hexdigest()
        assert (r["secrets"]["n_assign"], r["secrets"]["n_access"], r["secrets"]["n_hex"]) == tuple(sum(k == x for k, *_ in kept) for x in ("assign", "access", "hex"))
        assert [int(s) for _, s, _ in spans] == sorted(int(s) for _, s, _ in spans)
        base += len(kept)
        added += [r["text"][int(s) : int(e)] for k, s, e in spans if k == "random"]
    assert base > 0 and not set(added) - keys
    assert len(set(added) & keys) >= 0.9 * len(keys)


def test_secrets_of_awkward_rows(spark, awkward):
    rows = secret_scan.find(awkward).collect()
    assert len(rows) == len(AWKWARD) and rows[0]["secrets"] == "clash"
    assert all(r["secrets_"]["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in plain_base(r["text"] or "")) for r in rows)
    assert secret_scan.find(awkward.limit(0)).count() == 0
    began = time.time()
    for t in ("token " * 200_000, "token" + " " * 1_000_000, "AKIA" * 250_000, "abcdef0" * 150_000, "a" * 1_000_000, "token=" * 170_000):
        assert secret_scan.base_spans(t) is not None and list(secret_scan.Scanner({}).candidates(t, [])) == []
    assert time.time() - began < 20


# ---- spelling ----------------------------------------------------------------


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def plain_vocabulary(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_groups(words):
    form, out = {}, []
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
        out.append((w, form[w], n, len(close)))
    rows = []
    for w, f, n, k in out:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, f, root, n, k, words[f] if f else None))
    return sorted(rows, key=str)


def grouped(words_df, **kw):
    return sorted((tuple(r) for r in spelling.group(words_df, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_acceptors_are_minimal_and_accept_just_their_words():
    rng = random.Random(2)
    for _ in range(60):
        words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 30))})
        a = spelling.Acceptor(words)

        def accepted(p, before=""):
            return ([before] if a.final[p] else []) + [x for c, q in sorted(a.out[p].items()) for x in accepted(q, before + c)]

        assert accepted(0) == words
        rights = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:k] for k in range(len(w) + 1))}
        reached, todo = {0}, [0]
        while todo:
            for q in a.out[todo.pop()].values():
                if q not in reached:
                    reached.add(q)
                    todo.append(q)
        assert len(reached) == len(rights)
        pairs = list(a.pairs(True))
        assert len(pairs) == len({frozenset(p) for p in pairs})
        assert {frozenset(p) for p in pairs} == {frozenset(p) for p in itertools.combinations(words, 2) if near(*p)}


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_variants_equal_all_pairs(spark, most):
    rng = random.Random(most)
    words = {}
    for _ in range(500):  # a third begins alike, and runs of equal letters leave the place of an edit open
        w = ("zzzzzz" if rng.random() < 0.3 else "") + "".join(rng.choice("abé") for _ in range(rng.randrange(5, 9)))
        words[w] = rng.randrange(3, 60)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert grouped(df, most=most) == plain_groups(words)


def test_vocabulary_and_variants_of_awkward_rows(spark, awkward):
    words = spelling.vocabulary(awkward)
    expected = plain_vocabulary(AWKWARD)
    assert {r["word"]: r["n"] for r in words.collect()} == expected and len(expected) > 4
    assert grouped(words) == plain_groups(expected)
    assert spelling.group(spelling.vocabulary(awkward.limit(0))).count() == 0
    with pytest.raises(ValueError):
        spelling.group(words, ratio=1)


def test_slips_are_planted_as_stated(spark):
    rows = [(i, f"planted words here variant{'' if i % 2 else 's'} grouping") for i in range(2000)]
    assert {r["word"]: r["n"] for r in spelling.vocabulary(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == plain_vocabulary(rows)


def test_large_parts_are_cut_until_small(spark):
    words = [("abcdef" + "".join(x), 3) for x in itertools.product("abcdefgh", repeat=4)]
    with Scratch(spark) as scratch:
        held = []
        cut = scratch.cut
        scratch.cut = lambda df, name: held.append(cut(df, name)) or held[-1]
        rows = spelling.near_words(spark.createDataFrame(words, "word string, n long"), scratch, most=64).collect()
        assert len(rows) == 8**4 and {r["n_near"] for r in rows} == {4 * 7}
        assert held[0].agg({"size": "max"}).first()[0] == 8**4 and held[-1].agg({"size": "max"}).first()[0] <= 64


# ---- tries -------------------------------------------------------------------


def plain_nodes(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            convs[c].append(((turn is not None, turn), role, key, text))
    convs = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])  # a remainder has the sign of c, as in SQL
    members = collections.defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = collections.defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found_nodes(df, **kw):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in prefix_trie.nodes(df, **kw).select(*columns).collect()), key=str)


TURNS = "conv_id long, turn long, role string, text string, node string, depth string"


@pytest.mark.parametrize("most", [1, 20, 30_000])
def test_nodes_equal_brute_force(spark, most):
    rng = random.Random(most)
    opening = [("user", f"word {k} of an opening") for k in range(11)]
    rows = []
    for c in [*range(0, 90), 400, 401, -3, 10**12]:
        own = list(opening) if c % 3 == 0 else []  # a third shares eleven turns
        own += [(rng.choice(["user", None]), rng.choice(["yes", "no   then", "", None, "a\x0bb"])) for _ in range(rng.randrange(4))]
        if c % 7 == 0:
            own = own[:1]
        rows += [(c, None if k == 0 and c % 5 == 0 else k, *t, "clash", "clash") for k, t in enumerate(own)]
    rows += rows[:6] + [(None, 1, "user", "of no conversation", "", ""), (77, 3, "user", "tie", "", ""), (77, 3, "user", "other tie", "", "")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert found_nodes(df, most=most) == plain_nodes([r[:4] for r in rows])


def test_tries_of_awkward_tables(spark):
    assert found_nodes(spark.createDataFrame([], TURNS)) == []
    alone = [(None, 1, "user", "x", "", "")]
    assert found_nodes(spark.createDataFrame(alone, TURNS)) == []
    turnless = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)
    assert found_nodes(spark.createDataFrame([(turnless, 0, "user", "gone", "", "")], TURNS)) == plain_nodes([(turnless, 0, "user", "gone")])
    long_one = [(0, k, "user", "same words", "", "") for k in range(3000)] + [(1, 0, "user", "w " * 400_000, "", "")]
    found = found_nodes(spark.createDataFrame(long_one, TURNS), most=1000)
    assert max(r[1] for r in found) == 3000


def test_ends_of_a_crowded_node_are_hashed_in_order(spark):
    rows = [(c, k, "user", "hello") for c in range(1000, 41_000) for k in range(4)]
    found = {r[1]: r for r in found_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))}
    assert len(found) == 5 and found[4][7] == hashlib.sha256(",".join(map(str, range(1000, 41_000))).encode()).hexdigest()


def test_double_arrays_hold_every_sequence_and_no_other():
    rng = random.Random(9)
    for size in (1, 3, 50):
        rows = sorted({tuple(rng.randrange(size) for _ in range(rng.randrange(7))) for _ in range(200)})
        trie = prefix_trie.DoubleArray([list(r) for r in rows])
        prefixes = {r[:k] for r in rows for k in range(len(r) + 1)}
        slots = {}
        for p in sorted(prefixes, key=len):
            slots[p] = trie.step(slots[p[:-1]], p[-1]) if p else 0
            assert slots[p] >= 0
            for c in range(size):
                assert (trie.step(slots[p], c) >= 0) == (p + (c,) in prefixes)
        assert len(set(slots.values())) == len(prefixes)
