"""Personal data: base patterns, and candidates judged by gradient-boosted trees.

Base kinds (email, ip, card, phone) are fixed patterns with fixed checks. High-recall
generators propose further, overlapping candidates; boosted trees score each by its
form and the words before it, and a threshold for each kind, calibrated on texts the
trees have not seen, selects what is added. Added kinds are ``secret`` and ``number``.
Base spans always stay. Added spans do not overlap each other; one may reach beyond a
base span, so that no part of a secret is left over.

The tables carry no labels. The trees learn from generated texts, in which it is known
what was planted: secrets and personal numbers in many forms, with and without a name
before them, among values that only look alike. No rule restates the labels.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import broadcast_value, fresh

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("secret", "number")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Searches start only where a run of digits does; a later start in the same run can't match either.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern, in time linear in the text: a local part ends at an @."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, passes its check) of each match of a base pattern."""
    for a, b in _emails(text):
        yield "email", a, b, True
    for m in _IP.finditer(text):
        yield "ip", m.start(), m.end(), all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0]) if m.end() - m.start() <= 40 else ""
        yield "card", m.start(), m.end(), 13 <= len(digits) <= 19 and luhn(digits)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield "phone", m.start(), m.end(), 9 <= len(_DIGITS.sub("", m[0])) <= 15


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind as listed, then start; code points, end exclusive."""
    return [(k, a, b) for k, a, b, ok in _matches(text or "") if ok]


_ASSIGNED = re.compile(r"""(?i)(?:token|secret|passw(?:or)?d|pwd|auth|bearer|credentials?|key)\b["']?(?:\s{0,3}[:=]{1,2}\s{0,3}|\s)["']?([^\s"']{6,}+)""")
_RUN = re.compile(r"[A-Za-z0-9_+/=-]{12,}+")
_CHAIN = re.compile(r"[0-9](?:[ .()/-]{0,2}+[0-9])++")
_WORDS = re.compile(r"[A-Za-z]+")
#: What a word before a value says about it.
_CONTEXT = {
    w: k
    for k, ws in {
        "secret": "token secret password passwd pwd auth bearer key apikey credential credentials authorization login",
        "number": "call tel telephone phone mobile cell fax ssn security passport account acct iban licence contact ring",
        "public": "isbn page pages version commit sha md5 checksum build revision vol volume issue section chapter total about population price order figure table id ref year line file image row",
    }.items()
    for w in ws.split()
}


def candidates(text: str) -> list[tuple[str, int, int]]:
    """High-recall proposals, which may overlap; each (kind, start, end). Values are whole, whatever their length."""
    found = {("secret", *m.span(1)) for m in _ASSIGNED.finditer(text)}
    for m in _RUN.finditer(text):
        value = m[0]
        # capitals alone are a shouted word, unless a name stands before them
        if any(c.isdigit() for c in value) or sum(map(str.isupper, value)) >= 8 and any(map(str.islower, value)):
            found.add(("secret", *m.span()))
    for m in _CHAIN.finditer(text):
        a, b = m.span()
        if a and text[a - 1].isalnum() or b < len(text) and text[b].isalnum():
            if not (a and text[a - 1].isalnum()):
                b = a + len(m[0].rstrip("0123456789").rstrip(" .()/-"))  # without the group that runs into a word
            else:
                continue
        if sum(map(str.isdigit, text[a:b])) >= 7:
            found.add(("number", a, b))
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


_RUNS = re.compile(r"[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]+")
_VOWELS = "aeiouAEIOU"
_HEX = frozenset(string.hexdigits)
N_FEATURES = 19


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Form of the value and what stands before it."""
    value = text[start:end]
    counts = Counter(value)
    n = len(value)
    runs = _RUNS.findall(value)
    digit_runs = [len(x) for x in runs if x[0] in string.digits]
    digits, upper, lower = sum(digit_runs), sum(len(x) for x in runs if "A" <= x[0] <= "Z"), sum(len(x) for x in runs if "a" <= x[0] <= "z")
    before = text[max(0, start - 32) : start]
    near = [_CONTEXT.get(w.lower()) for w in _WORDS.findall(before)[-3:]]
    return [
        float(kind == "secret"),
        float(n),
        math.log2(n) - sum(c * math.log2(c) for c in counts.values() if c > 1) / n,  # entropy
        digits / n,
        upper / n,
        lower / n,
        (n - digits - upper - lower) / n,
        float(digits),
        (len(runs) - 1) / n,
        sum(counts.get(v, 0) for v in _VOWELS) / n,
        float(len(digit_runs)),
        float(max(digit_runs, default=0)),
        float(min(digit_runs, default=0)),
        float(near.count("secret")),
        float(near.count("number")),
        float(near.count("public")),
        float(before.rstrip(" \"'")[-1:] in ("=", ":")),
        float(_HEX.issuperset(counts)),
        float(value.count(".") + value.count("/")),
    ]


def labelled_texts(n: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Texts with the spans that were planted as personal, from a generator with a seed."""
    r = random.Random(seed)
    hex_, base32, base62 = "0123456789abcdef", string.ascii_uppercase + "234567", string.ascii_letters + string.digits

    def word(lo: int = 2, hi: int = 12) -> str:
        return "".join(r.choice(("aeiou", "bcdfghlmnprstvw")[k % 2 ^ (r.random() < 0.2)]) for k in range(r.randint(lo, hi)))

    def shouted() -> str:
        return "".join(r.choice("sch rz tz st nd ng th fl pr br ck".split()) + r.choice("aeiou") + r.choice(["", "r", "n", "rt", "ch"]) for _ in range(r.randint(4, 7))).upper()

    def prose(lo: int, hi: int) -> str:
        return " ".join(word().capitalize() if r.random() < 0.1 else word() for _ in range(r.randint(lo, hi)))

    def made(alphabet: str, lo: int, hi: int) -> str:
        return "".join(r.choice(alphabet) for _ in range(r.randint(lo, hi) * (8 if r.random() < 0.05 else 1)))

    def shaped(shape: str) -> str:
        return "".join(r.choice("0123456789") if c == "9" else c for c in shape)

    def value() -> str:
        return r.choice([
            lambda: made(hex_, 16, 64), lambda: made(base62, 12, 64), lambda: made(base32, 16, 32), lambda: made(base62 + "-_", 16, 48),
            lambda: made(base62 + "!#$%&*+/?@", 10, 24),
        ])()

    def named_secret() -> tuple[str, str]:
        name = r.choice("token secret password passwd api_key apikey api-key key access_key auth_token Authorization pwd".split())
        quote = r.choice(["", "", '"', "'"])
        return f"{name}{r.choice(['=', ' = ', ': ', ':', ' := '])}{quote}", value()

    def bare_secret() -> tuple[str, str]:
        return "", r.choice(["AKIA", "ASIA", "ghp_", "sk_live_", "xoxb-", "AIza", "", ""]) + r.choice([lambda: made(base32, 16, 16), lambda: made(base62, 20, 48)])()

    def personal_number() -> tuple[str, str]:
        name = r.choice(["call", "tel", "tel.", "phone", "phone:", "mobile", "fax", "SSN", "ssn:", "passport", "account", "acct", "contact"])
        return f"{name} ", shaped(r.choice(["(999) 999-9999", "999-999-9999", "999.999.9999", "999-99-9999", "099 9999 9999", "99999 999999", "9999999999", "99 99 99 99 99", "9999 9999 9999"]))

    def plain_assigned() -> tuple[str, str]:
        said = r.choice([word(6, 12), f"{word(3, 8)}_{word(3, 8)}", f"{word(3, 6)}/{word(4, 8)}.html", f"{word(4, 9)}-{word(2, 6)}", word(6, 9).capitalize() + "."])
        return f"{r.choice('token secret password key auth'.split())}{r.choice([' = ', ': ', '=', ' '])}", said

    def plain_name() -> tuple[str, str]:
        w = [word(3, 9) for _ in range(r.randint(2, 4))]
        return r.choice(["file ", "see ", "image ", ""]), r.choice(["_".join(w) + str(r.randint(1, 99)), "".join(x.capitalize() for x in w) + str(r.randint(1, 2100)), "-".join(w) + f"-{r.randint(1, 2100)}", f"IMG_{shaped('20991231_999999')}", "/".join(w) + f"/{r.randint(1, 9999)}", shouted(), "=" * r.randint(12, 40) + "1"])

    def public_hash() -> tuple[str, str]:
        return f"{r.choice(['commit', 'sha', 'md5', 'checksum', 'build', 'revision', 'id'])}{r.choice([' ', ': '])}", made(hex_, 12, 40)

    def plain_number() -> tuple[str, str]:
        name = r.choice(["", "", "", "isbn ", "page ", "version ", "about ", "total ", "population ", "price ", "order ", "vol. ", "year ", "in "])
        return name, shaped(r.choice(["2099-19-19", "19/09/2099 19:99", "1999-1999-2099", "9.99999999", "9 999 999", "99.999.999", "999-9-99-999999-9", "9.9.9.99.9.9.9", "9999999", "99999999", "99 99 99 99", "1999 2099 2099", "9999.99 9999.99", "99/99 99/99", "20991231", "20991231999999", "0.999999999"]))

    makers = [(named_secret, 1), (bare_secret, 1), (personal_number, 1), (plain_assigned, 0), (plain_name, 0), (public_hash, 0), (plain_number, 0), (plain_number, 0)]
    for k in range(n):
        maker, y = makers[k % len(makers)]
        name, said = maker()
        lead = prose(2, 12) + r.choice([" ", " ", "\n", ". ", ", "]) + name
        yield lead + said + r.choice(['" ', " ", "\n", ". ", ", "]) + prose(1, 8), [(len(lead), len(lead) + len(said))] if y else []


def labelled_candidates(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of the candidates in generated texts: 1 if planted. One that holds a part of a planted span alone is left out."""
    xs, ys = [], []
    for text, truth in labelled_texts(n, seed):
        for k, a, b in candidates(text):
            over = max((min(b, e) - max(a, s) for s, e in truth), default=0)
            whole = any(min(b, e) - max(a, s) >= 0.8 * (max(b, e) - min(a, s)) for s, e in truth)
            if whole or over <= 0:
                xs.append(features(text, k, a, b))
                ys.append(float(whole))
    return np.array(xs).reshape(-1, N_FEATURES), np.array(ys)


class BoostedTrees:
    """Gradient boosting of depth-2 trees on the logistic loss, with cuts at quantiles.

    A tree is a row of ``splits`` (feature and cut of the root, of its left and of its right child) and four leaves.
    """

    def __init__(self, rounds: int = 120, rate: float = 0.3):
        self.rounds, self.rate, self.start = rounds, rate, -5.0
        self.splits: list[tuple[int, float, int, float, int, float]] = []
        self.leaves: list[list[float]] = []
        self.thresholds = dict.fromkeys(MORE_KINDS, 0.5)

    @staticmethod
    def _split(x: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[float, int, float]:
        """(gain, feature, cut) of the best split; gain 0 sends all rows left."""
        best = (0.0, 0, math.inf)
        whole = grad.sum() ** 2 / (hess.sum() + 1)
        for f in range(x.shape[1]):
            cuts = np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 25)))
            place = np.searchsorted(cuts, x[:, f])
            g, h = np.cumsum(np.bincount(place, grad, len(cuts) + 1))[:-1], np.cumsum(np.bincount(place, hess, len(cuts) + 1))[:-1]
            gain = g**2 / (h + 1) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1) - whole
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), f, float(cuts[k]))
        return best

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = math.log(rate / (1 - rate))
        z = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            grad, hess = y - p, p * (1 - p)
            gain, f, cut = self._split(x, grad, hess)
            if not gain:
                break
            right = x[:, f] > cut
            split = [f, cut]
            for side in (~right, right):
                _, f2, cut2 = self._split(x[side], grad[side], hess[side])
                split += [f2, cut2]
            leaf = self._leaf(np.array([split]), x)[0]
            g, h = np.bincount(leaf, grad, 4), np.bincount(leaf, hess, 4)
            self.splits.append(tuple(split))
            self.leaves.append((self.rate * g / (h + 1)).tolist())
            z += np.array(self.leaves[-1])[leaf]
        return self

    @staticmethod
    def _leaf(splits: np.ndarray, x: np.ndarray) -> np.ndarray:
        """(trees, rows): the leaf of each row in each tree."""
        at = np.arange(len(x))
        out = np.empty((len(splits), len(x)), np.int64)
        for k, (f, cut, fl, cl, fr, cr) in enumerate(splits):
            right = x[:, int(f)] > cut
            out[k] = 2 * right + (x[at, np.where(right, int(fr), int(fl))] > np.where(right, cr, cl))
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        if self.splits:
            for leaf, values in zip(self._leaf(np.array(self.splits), x), self.leaves):
                z += np.array(values)[leaf]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float = 0.99) -> BoostedTrees:
        """For each kind the lowest threshold, 0.5 at least, above which candidates not seen in training are right at ``precision``."""
        p = self.scores(x)
        for kind, own in (("secret", x[:, 0] == 1), ("number", x[:, 0] == 0)):
            levels = [t for t in np.linspace(0.5, 0.98, 25) if not (chosen := own & (p >= t)).any() or y[chosen].mean() >= precision]
            self.thresholds[kind] = float(levels[0]) if levels else 0.98
        return self


@cache
def trained(texts: int = 4000) -> BoostedTrees:
    """Trees fitted on generated texts and calibrated on a third as many others."""
    return BoostedTrees().fit(*labelled_candidates(texts, 1)).calibrate(*labelled_candidates(texts // 3, 2))


Found = list[tuple[str, int, int]]


def _selected(base: Found, scored: list[tuple[float, str, int, int]]) -> Found:
    """The best of overlapping candidates, without those inside base spans that touch; by kind, then start."""
    merged: list[list[int]] = []
    for _, a, b in sorted(base, key=lambda x: x[1]):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    from_, to = [m[0] for m in merged], [m[1] for m in merged]
    starts: list[int] = []
    ends: list[int] = []
    added: Found = []
    for _, k, a, b in sorted(scored, key=lambda x: (-x[0], x[2], -x[3], x[1])):
        i = bisect_right(from_, a) - 1
        if i >= 0 and b <= to[i]:
            continue
        j = bisect_left(starts, a)
        if (j and ends[j - 1] > a) or (j < len(starts) and starts[j] < b):
            continue
        starts.insert(j, a)
        ends.insert(j, b)
        added.append((k, a, b))
    return sorted(added, key=lambda x: (MORE_KINDS.index(x[0]), x[1]))


def spans_of(texts: list[str | None], model: BoostedTrees) -> list[tuple[Found, Found]]:
    """(base spans, added spans) of each text; all candidates are scored together."""
    proposed = [(i, *c) for i, t in enumerate(texts) if t for c in candidates(t)]
    x = np.array([features(texts[i], k, a, b) for i, k, a, b in proposed]).reshape(-1, N_FEATURES)
    chosen: dict[int, list[tuple[float, str, int, int]]] = {}
    for (i, k, a, b), p in zip(proposed, model.scores(x).tolist()):
        if p >= model.thresholds[k]:
            chosen.setdefault(i, []).append((p, k, a, b))
    out = []
    for i, t in enumerate(texts):
        base = base_spans(t)
        out.append((base, _selected(base, chosen[i]) if i in chosen else []))
    return out


def spans(text: str | None, model: BoostedTrees) -> tuple[Found, Found]:
    return spans_of([text], model)[0]


def _replaced(text: str | None, found: Found) -> str | None:
    if text is None or not found:
        return text
    out, end = [], 0
    for k, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        if a >= end:
            out += [text[end:a], f"<{k.upper()}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def redacted(text: str | None, model: BoostedTrees) -> str | None:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans are merged under the first's kind."""
    base, added = spans(text, model)
    return _replaced(text, base + added)


def _joined(found: Found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame, into: str = "pii") -> DataFrame:
    """``docs`` with a struct column ``into``: counts by base kind, base_sha256 and all spans.

    Null text counts as empty: no spans, the hash of an empty string. Repeated rows are
    treated alike; an empty table gives no rows. Other columns pass through; where one is
    called ``into``, the new column's name gets an underscore.
    """
    model = broadcast_value(docs.sparkSession, trained())

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for base, added in spans_of(list(texts), model()):
            n = Counter(k for k, _, _ in base)
            out.append((*(n[k] for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added)))
        return pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.withColumn(fresh(docs, into), run(F.col("text")))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind, as ``<EMAIL>``; null texts and other columns stay, an empty table stays empty."""
    model = broadcast_value(docs.sparkSession, trained())

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        held = list(texts)
        return pd.Series([_replaced(t, base + added) for t, (base, added) in zip(held, spans_of(held, model()))], dtype=object)

    return docs.withColumn("text", run(F.col("text")))
