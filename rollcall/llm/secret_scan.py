"""Secret scans: base patterns, then a battery of randomness tests under false-discovery control.

A run of token characters is read in the narrowest encoding that holds it. Three tests ask whether
its symbols may be random in that encoding: chi-squared uniformity over the alphabet (its symbols,
and stretches of it), the number of runs above and below the middle, and the serial correlation of
neighbours. Fisher's sum of their p-values is then held against the same sum of ordinary strings of that encoding and length, which are
put together from the words of all texts: a run's p-value is the share of ordinary strings that
look as random. The p-values of all distinct runs of the table, per encoding and length band, go
through the step-up procedure of Benjamini and Hochberg; a run is a secret where it is discovered
there and no single test calls it out as not random. Digits alone are numbers, not secrets.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import broadcast_value, fresh

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A run that may be a key; padding belongs to it.
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")

DIGITS = "0123456789"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings from narrow to wide. The two base64 alphabets differ in their last two symbols.
ENCODINGS = (
    ("hex", DIGITS + LOWER[:6]),
    ("hex_upper", DIGITS + UPPER[:6]),
    ("lower", LOWER),
    ("upper", UPPER),
    ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER),
    ("base36_upper", DIGITS + UPPER),
    ("base62", UPPER + LOWER + DIGITS),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64_url", UPPER + LOWER + DIGITS + "-_"),
)
_PLACES = [{c: k for k, c in enumerate(alphabet)} for _, alphabet in ENCODINGS]
_SETS = [frozenset(alphabet) for _, alphabet in ENCODINGS]
_SHORTEST, _RATIO, _BANDS = 16, 1.25, 20
_BIN = 0.1  # width of a bin of -log10 p
_CHUNK = 1_000_000  # bytes of texts whose ordinary strings a task makes at once
_UNIT = 1 << 16  # irregularities are added as whole multiples of its inverse


def encoding_of(run: str) -> int | None:
    """Index of the narrowest encoding that holds ``run`` (padding aside); None for digits alone and for mixed alphabets."""
    used = set(run.rstrip("="))
    if used <= set(DIGITS):
        return None
    return next((k for k, symbols in enumerate(_SETS) if used <= symbols), None)


def band_of(length: int) -> int:
    """Length bands grow by a quarter from 16 characters on; what is longer than the last one's start belongs to it."""
    return max(0, min(_BANDS, int(math.log(length / _SHORTEST, _RATIO)))) if length > 0 else 0


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_squared_tail(counts: np.ndarray, shares: np.ndarray) -> float:
    """p-value of ``counts`` in cells of the given shares.

    There are few symbols a cell here, so the tail is that of a scaled chi-squared law with the sum's exact
    mean and variance, by the cube-root approximation.
    """
    n, cells = counts.sum(), len(shares)
    x2 = float((counts * counts / shares).sum()) / n - n
    mean = cells - 1.0
    var = max(2.0 * (cells - 1) + float((1 / shares).sum() - cells * cells - 2 * cells + 2) / n, 1e-6)
    df = 2 * mean * mean / var
    return _normal_tail(((x2 / mean) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)) if x2 > 0 else -9.0)


def battery(run: str, encoding: int) -> tuple[float, float, float, float]:
    """p-values of uniformity over symbols and over stretches of the alphabet, of runs and of serial correlation.

    Each is the chance of a sequence as odd as this, if the symbols were drawn at random from the alphabet.
    Stretches hold about four expected symbols each.
    """
    place = _PLACES[encoding]
    v = np.array([place[c] for c in run.rstrip("=")], dtype=float)
    n, size = len(v), len(place)
    if n < 4:
        return 0.0, 0.0, 0.0, 0.0
    counts = np.bincount(v.astype(int), minlength=size)
    p_symbols = _chi_squared_tail(counts, np.full(size, 1 / size))
    edges = np.linspace(0, size, max(3, min(size, n // 4)) + 1).astype(int)[:-1]
    p_stretches = _chi_squared_tail(np.add.reduceat(counts, edges), np.diff(np.append(edges, size)) / size)
    high = v >= size / 2
    h = int(high.sum())
    changes = int((high[1:] != high[:-1]).sum())
    # each neighbouring pair of independent symbols changes sides with chance 2q(1-q)
    q = np.arange(size) >= size / 2
    q = float(q.mean())
    chance = 2 * q * (1 - q)
    spread = (n - 1) * chance * (1 - chance) + 2 * (n - 2) * (q * (1 - q) - chance * chance)
    p_runs = 2 * _normal_tail(abs(changes - (n - 1) * chance) / math.sqrt(max(spread, 1e-9)))
    d = v - (size - 1) / 2
    r = float(d[1:] @ d[:-1]) / ((size * size - 1) / 12 * math.sqrt(n - 1))
    p_serial = 2 * _normal_tail(abs(r))
    if h in (0, n):
        p_runs = min(p_runs, 2.0 ** (1 - n))
    return p_symbols, p_stretches, p_runs, p_serial


def irregularity(ps: tuple[float, ...]) -> float:
    """Fisher's sum, as its logarithm: small for what looks random."""
    return math.log(1e-3 - 2 * sum(math.log(max(p, 1e-300)) for p in ps))


def batteries(codes: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """``battery`` of many strings of an alphabet of ``size`` symbols: a row each. ``codes`` are the strings' places in it, behind one another."""
    n, rows = lengths.astype(float), len(lengths)
    first = np.cumsum(lengths) - lengths
    counts = np.bincount(np.repeat(np.arange(rows) * size, lengths) + codes, minlength=rows * size).reshape(rows, size)
    symbols = _chi_squared_z((counts * counts).sum(axis=1) * size / n - n, n, np.full(rows, size), np.full(rows, size * size))
    p_symbols = _normal_tails(symbols)
    p_stretches = p_symbols.copy()
    some = np.flatnonzero(lengths // 4 < size)
    if len(some):
        cells = np.maximum(3, lengths[some] // 4)
        edges, weights = _stretches(size)
        upto = np.concatenate([np.zeros((len(some), 1), np.int64), np.cumsum(counts[some], axis=1)], axis=1)
        inside = np.diff(np.take_along_axis(upto, edges[cells], axis=1), axis=1)
        x2 = (inside * inside * weights[cells]).sum(axis=1) / n[some] - n[some]
        p_stretches[some] = _normal_tails(_chi_squared_z(x2, n[some], cells, weights.sum(axis=1)[cells]))
    high = codes >= size / 2
    h = counts[:, (size + 1) // 2 :].sum(axis=1)
    change = np.concatenate([[False], high[1:] != high[:-1]])
    change[first] = False
    q = 1 - (size + 1) // 2 / size
    chance = 2 * q * (1 - q)
    spread = (n - 1) * chance * (1 - chance) + 2 * (n - 2) * (q * (1 - q) - chance * chance)
    off = np.abs(np.add.reduceat(change, first, dtype=np.int64) - (n - 1) * chance)
    p_runs = 2 * _normal_tails(off / np.sqrt(np.maximum(spread, 1e-9)))
    one_side = (h == 0) | (h == lengths)
    p_runs[one_side] = np.minimum(p_runs[one_side], 2.0 ** (1 - n[one_side]))
    d = 2 * codes.astype(np.int16) - np.int16(size - 1)
    pairs = np.concatenate([np.zeros(1, np.int16), d[1:] * d[:-1]])
    pairs[first] = 0
    r = np.add.reduceat(pairs, first, dtype=np.int64) / 4 / ((size * size - 1) / 12 * np.sqrt(n - 1))
    return np.stack([p_symbols, p_stretches, p_runs, 2 * _normal_tails(np.abs(r))], axis=1)


def _normal_tails(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.fromiter(map(math.erfc, (z / math.sqrt(2)).tolist()), float, len(z))


def _chi_squared_z(x2: np.ndarray, n: np.ndarray, cells: np.ndarray, inverse_shares: np.ndarray) -> np.ndarray:
    mean = cells - 1.0
    var = np.maximum(2.0 * mean + (inverse_shares - cells * cells - 2 * cells + 2) / n, 1e-6)
    scale = 2 / (9 * (2 * mean * mean / var))
    return np.where(x2 > 0, (np.cbrt(np.maximum(x2, 0) / mean) - (1 - scale)) / np.sqrt(scale), -9.0)


@lru_cache(maxsize=None)
def _stretches(size: int) -> tuple[np.ndarray, np.ndarray]:
    """By number of stretches: where they begin and end in the alphabet, and the inverses of their shares; 0 for those beyond the number."""
    edges, weights = np.full((size + 1, size + 1), size), np.zeros((size + 1, size))
    for cells in range(3, size + 1):
        edges[cells, : cells + 1] = np.linspace(0, size, cells + 1).astype(int)
        weights[cells, :cells] = size / np.diff(edges[cells, : cells + 1])
    return edges, weights


_LETTER = np.zeros(256, bool)
_LETTER[[ord(c) for c in UPPER + LOWER]] = True
_TURNS = [pow(31, k, 2000) for k in range(2000)]  # powers of 31 modulo 2000 come round within 2,000
_AHEAD, _BACK = np.array(_TURNS), np.array([pow(x, -1, 2000) for x in _TURNS])
#: Lengths of ordinary strings, in turn: all bands come up alike often.
_LENGTHS = np.array([int(_SHORTEST * _RATIO ** ((k * 7 % (_BANDS * 10)) / 10 + 0.05)) for k in range(_BANDS * 10)])
_LENGTH_BANDS = np.array([band_of(int(n)) for n in _LENGTHS])


class Words:
    """The words (two letters and more) of texts in UTF-8, behind one another, as places in the lower-case alphabet.

    ``piece`` makes of them, for an encoding, names in the shapes that people write: in one case, in camel case,
    with numbers, with separators; for hex the letters are taken modulo the alphabet.
    """

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        letter = _LETTER[data]
        at = np.flatnonzero(np.diff(letter, prepend=False, append=False))
        starts, ends = at[::2], at[1::2]
        long = ends - starts > 1
        letter[starts[~long]] = False
        starts, self.length = starts[long], (ends - starts)[long]
        self.letters = (data[letter] | 32) - 97
        stop = np.cumsum([len(t) + 1 for t in texts])
        self.last = np.searchsorted(starts, stop)  # where each text's words end
        self.first = np.concatenate([[0], self.last[:-1]])
        counts = self.last - self.first
        k = np.arange(len(starts)) - np.repeat(self.first, counts)
        self.k = k
        # number of a word: 31 times that of the word before it in the text, 7 for each letter and k, modulo 2,000
        so_far = np.concatenate([[0], np.cumsum(_BACK[k % 2000] * (7 * self.length + k) % 2000)])
        number = (so_far[1:] - np.repeat(so_far[self.first], counts)) % 2000 * _AHEAD[k % 2000] % 2000
        self.numbered = np.flatnonzero(k % 3 == 0)
        number = number[self.numbered]
        self.digits = 1 + (number > 9) + (number > 99) + (number > 999)
        self.places = [number // 10 ** np.maximum(self.digits - 1 - i, 0) % 10 for i in range(4)]

    def pieces(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """(places in the encoding's alphabet, lengths of the words' pieces)."""
        if name.startswith("hex"):
            return (self.letters + 1) % 16, self.length
        if name in ("lower", "upper"):
            return self.letters, self.length
        separated = name.startswith("base64")
        size = self.length + separated
        size[self.numbered] += self.digits
        begin = np.cumsum(size) - size
        own = np.cumsum(self.length) - self.length
        out = np.empty(size.sum(), np.uint8)
        if name == "base32":
            letters, zero = self.letters, 26
        elif name.startswith("base36"):
            letters, zero = self.letters + np.uint8(10), 0
        else:
            letters, zero = self.letters + np.uint8(26), 52
            letters[own[self.k % 2 == 1] if separated else own] -= np.uint8(26)
        out[np.arange(len(letters)) + np.repeat(begin - own, self.length)] = letters
        after = begin[self.numbered] + self.length[self.numbered]
        for i, place in enumerate(self.places):
            has = self.digits > i
            out[after[has] + i] = zero + (place[has] % 6 if name == "base32" else place[has])
        if separated:
            out[begin + size - 1] = 62 + self.k % 2
        return out, size

    def ordinary(self, encoding: int, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, band, length, places) of the strings of an encoding: neighbouring words of a text joined and cut to the next length.

        ``turns``: where in the order of lengths each text begins. All texts go on by a string at a time.
        """
        codes, size = self.pieces(ENCODINGS[encoding][0])
        end = np.cumsum(size)
        begin = end - size
        text = np.flatnonzero(self.first < self.last)
        word, turn, found = self.first[text], turns[text] + encoding, []
        while len(text):
            turn = (turn + 1) % len(_LENGTHS)
            upto = np.searchsorted(end, begin[word] + _LENGTHS[turn])
            fits = upto < self.last[text]
            text, turn, upto = text[fits], turn[fits], upto[fits]
            found.append((text, turn, begin[word[fits]]))
            more = upto + 1 < self.last[text]
            text, turn, word = text[more], turn[more], upto[more] + 1
        text, turn, at = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        order = np.argsort(at)
        text, turn, at = text[order], turn[order], at[order]
        length = _LENGTHS[turn]
        inside = np.zeros(len(codes) + 1, np.int8)
        inside[at] += 1
        inside[at + length] -= 1
        return text, _LENGTH_BANDS[turn], length, codes[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]


def strings_of(texts: list[bytes], turns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, stratum, irregularity) of all ordinary strings of the texts. A stratum is encoding * (bands) + length band."""
    words, out = Words(texts), []
    for e, (name, alphabet) in enumerate(ENCODINGS):
        text, band, length, codes = words.ordinary(e, turns)
        if not len(text):
            continue
        t = np.log(1e-3 - 2 * np.log(np.maximum(batteries(codes, length, len(alphabet)), 1e-300)).sum(axis=1))
        held = slice(None)
        if name.startswith("hex"):  # digits alone are numbers
            held = np.maximum.reduceat(codes, np.cumsum(length) - length) > 9
        out.append((text[held], e * (_BANDS + 1) + band[held], t[held]))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))


def learn(docs: DataFrame) -> dict[tuple[int, int], tuple[float, float, int]]:
    """(encoding, length band): mean, deviation and number of ordinary strings' irregularity, from all texts.

    Equal texts count once; texts of over a million bytes are taken in parts of that size. What a text's strings give is a few hundred bytes, shuffled by the text's hash; tasks then
    send sums for each stratum, of which there are a few hundred. Sums are of whole numbers, so no order changes them.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, seen = {}, 0, set()
        for b in batches:
            for text in b["text"]:
                data = text.encode("utf-8", "surrogatepass")
                for at in range(0, len(data), _CHUNK):
                    part = data[at : at + _CHUNK]
                    if (key := hashlib.md5(part).digest()) not in seen:
                        seen.add(key)
                        held[key] = part
                        size += len(part)
                    if size >= _CHUNK:
                        yield given(held)
                        held, size = {}, 0
            if len(seen) > 500_000:
                seen = set(held)
        if held:
            yield given(held)

    def given(held: dict[bytes, bytes]) -> pd.DataFrame:
        text, stratum, t = strings_of(list(held.values()), np.array([int.from_bytes(k[:2]) for k in held]))
        order = np.argsort(text, kind="stable")
        cuts = np.searchsorted(text[order], np.arange(len(held) + 1)).tolist()
        strata, fixed = stratum[order].astype(np.uint8).tobytes(), np.rint(t[order] * _UNIT).astype(np.int32).tobytes()
        rows = [(k, strata[i:j], fixed[4 * i : 4 * j]) for k, i, j in zip(held, cuts[:-1], cuts[1:]) if i < j]
        return pd.DataFrame(rows, columns=["text", "strata", "t"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((3, len(ENCODINGS) * (_BANDS + 1)), np.int64)
        for b in batches:
            stratum = np.frombuffer(b"".join(b["strata"]), np.uint8)
            t = np.frombuffer(b"".join(b["t"]), np.int32).astype(float)
            for row, x in enumerate((None, t, np.rint(t * t / _UNIT))):
                sums[row] += np.bincount(stratum, x, sums.shape[1]).astype(np.int64)
        some = np.flatnonzero(sums[0])
        yield pd.DataFrame({"stratum": some, "n": sums[0][some], "s": sums[1][some], "ss": sums[2][some]})

    texts = docs.select("text").filter("text IS NOT NULL").mapInPandas(each, "text binary, strata binary, t binary").dropDuplicates(["text"])
    rows = texts.select("strata", "t").mapInPandas(add, "stratum int, n long, s long, ss long").groupBy("stratum").sum("n", "s", "ss").collect()
    out = {}
    for stratum, n, s, ss in rows:
        mean = s / n / _UNIT
        out[divmod(stratum, _BANDS + 1)] = (mean, math.sqrt(max(ss / n / _UNIT - mean * mean, 1e-6) * n / max(n - 1, 1)), n)
    return out


class Scanner:
    """Candidates with their p-values, given what ordinary strings look like."""

    def __init__(self, known: dict[tuple[int, int], tuple[float, float, int]], least_known: int = 100, not_random: float = 1e-3):
        self.known = known
        self.least_known, self.not_random = least_known, not_random

    def p_bin(self, run: str) -> tuple[int, int, int] | None:
        """(encoding, band, bin of -log10 p), or None where it can be no secret.

        A stratum with fewer than ``least_known`` ordinary strings discovers nothing.
        """
        e = encoding_of(run)
        if e is None:
            return None
        band = band_of(len(run.rstrip("=")))
        mean, deviation, n = self.known.get((e, band), (0.0, 1.0, 0))
        if n < self.least_known:
            return None
        ps = battery(run, e)
        p = _normal_tail((mean - irregularity(ps)) / deviation)
        if min(ps) < self.not_random:
            p = 1.0  # counts among the tests made, and cannot be discovered
        return e, band, min(400, int(-math.log10(max(p, 1e-40)) / _BIN))

    def candidates(self, text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, tuple[int, int, int]]]:
        """(start, end, p_bin) of the runs that touch no base span."""
        starts = [s for _, s, _ in base]
        ends = np.maximum.accumulate([e for *_, e in base]).tolist() if base else []
        for m in RUN.finditer(text):
            k = bisect_left(starts, m.end())  # spans that start before the run ends
            if k and ends[k - 1] > m.start():
                continue
            if (found := self.p_bin(m.group())) is not None:
                yield m.start(), m.end(), found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed: assign, access, hex."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: x[1])  # stable, so kinds stay in order


def step_up(counts: dict[tuple[int, int, int], int], rate: float) -> dict[tuple[int, int], int]:
    """(encoding, band): the least bin of -log10 p that is discovered, for distinct runs counted by (encoding, band, bin).

    Benjamini and Hochberg in each stratum: the largest p with p * runs <= rate * runs of p or less. Bins
    stand for their largest p.
    """
    strata: dict[tuple[int, int], Counter] = {}
    for (e, band, k), n in counts.items():
        strata.setdefault((e, band), Counter())[k] += n
    out = {}
    for stratum, bins in strata.items():
        total, so_far = sum(bins.values()), 0
        for k in sorted(bins, reverse=True):
            so_far += bins[k]
            if 10 ** (-k * _BIN) * total <= rate * so_far:
                out[stratum] = k
    return out


def find(docs: DataFrame, rate: float = 0.01, into: str = "secrets") -> DataFrame:
    """``docs`` with a struct column ``into``: n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end, by start; ``random`` is the kind of what the tests add, outside base spans.
    Of the distinct runs added in a stratum a share of ``rate`` is expected to be ordinary strings. Null
    text is empty; long texts are read whole; repeated rows get the same spans, and a run counts once
    however often it occurs. An empty table gives no rows. Where a column is called ``into``, the new one gets
    an underscore.
    """
    spark = docs.sparkSession
    scanner = broadcast_value(spark, Scanner(learn(docs)))

    def tested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = scanner()
        for b in batches:
            out = {}
            for t in b["text"]:
                for s, e, found in get.candidates(t, base_spans(t)):
                    run = hashlib.md5(t[s:e].encode()).hexdigest()
                    out[run] = (run, *found)
            yield pd.DataFrame(list(out.values()), columns=["run", "encoding", "band", "bin"])

    runs = docs.select("text").filter("text IS NOT NULL").mapInPandas(tested, "run string, encoding int, band int, bin int")
    counted = runs.dropDuplicates(["run"]).groupBy("encoding", "band", "bin").count().collect()  # as many rows as there are bins
    least = broadcast_value(spark, step_up({(r[0], r[1], r[2]): r[3] for r in counted}, rate))

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def run(texts: pd.Series) -> pd.DataFrame:
        get, bounds, out = scanner(), least(), []
        for t in texts:
            t = t or ""
            base = base_spans(t)
            digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
            more = [("random", s, e) for s, e, (enc, band, k) in get.candidates(t, base) if k >= bounds.get((enc, band), 1 << 30)]
            spans = sorted(base + more, key=lambda x: x[1])
            kinds = Counter(k for k, *_ in base)
            out.append((kinds["assign"], kinds["access"], kinds["hex"], digest, ",".join(f"{k}:{s}:{e}" for k, s, e in spans)))
        return pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.withColumn(fresh(docs, into), run(F.col("text")))
