"""Quality rules as a short-circuit cascade.

Each rule rejects a text by one of its measures. A bounded sample gives each
rule's cost (seconds) and selectivity (share rejected); the cascade then runs
the rules by rejection per cost, the highest first, and a text leaves it at its
first rejection. The order changes the work, never the verdict.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import fresh, hashed_sample

_SHOUTED = re.compile(r"[A-Z]{2,}!!")


class Measures:
    """The measures of one text, each computed once and only when asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        # bytes.split() splits at exactly x20 and x09-x0D
        return self.text.encode("utf-8", "surrogatepass").split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        t = self.text
        return len(t) - sum(t.count(c) for c in " \t\n\x0b\x0c\r")

    @cached_property
    def n_symbols(self) -> int:
        t = self.text
        return sum(t.count(c) for c in "#*$%&|<>")

    @cached_property
    def n_dup_lines(self) -> int:
        lines = [x for x in self.text.split("\n") if x.encode("utf-8", "surrogatepass").split()]
        return len(lines) - len(set(lines))

    @cached_property
    def n_lines(self) -> int:
        return sum(1 for x in self.text.split("\n") if x.encode("utf-8", "surrogatepass").split())

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        seen = Counter(windows)
        if len(seen) == len(windows):
            return 0
        covered, end = 0, 0  # end: first position not yet counted
        for i, x in enumerate(windows):
            if seen[x] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
        return covered

    @cached_property
    def n_shouted(self) -> int:
        return len(_SHOUTED.findall(self.text))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


#: Base rules of the contract, then those of the method. Thresholds stand well outside prose.
RULES = (
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("repeats", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
    Rule("symbols", lambda m: 100 * m.n_symbols > 10 * m.word_chars),
    Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 20 * m.n_words),
    Rule("dup_lines", lambda m: m.n_dup_lines >= 3 and 2 * m.n_dup_lines > m.n_lines),
    Rule("shouting", lambda m: 4 * m.n_shouted > m.n_words),
)


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> tuple[Rule, ...]:
    """``rules`` by estimated rejection per second, from about ``sample_rows`` rows chosen by a hash of the text.

    Tasks measure the sample; only a few numbers a rule reach the driver.
    """

    def timed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for b in batches:
            for t in b["text"]:
                for k, r in enumerate(rules):
                    m, began = Measures(t), time.perf_counter()
                    hit = r.rejects(m)
                    out.append((k, time.perf_counter() - began, int(hit)))
        yield pd.DataFrame(out, columns=["rule", "s", "hit"])

    sample = hashed_sample(docs.select("text"), sample_rows, "text")
    seen = {
        r["rule"]: (r["s"], r["hit"])
        for r in sample.mapInPandas(timed, "rule int, s double, hit int").groupBy("rule").agg(F.sum("s").alias("s"), F.sum("hit").alias("hit")).collect()
    }
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: (-seen[k][1] / max(seen[k][0], 1e-9) if k in seen else 0, k)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, into: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``into`` (kept, rejected_by, n_rules_run): the cascade alone.

    Null text counts as empty (and has too few words); ties between rules go by
    their place in ``rules``. Repeated rows are judged alike; an empty table gives no
    rows. Other columns pass through; where one is called ``into``, the new column's
    name gets an underscore.
    """
    cascade = ordered(docs, rules, sample_rows)

    @F.pandas_udf("kept boolean, rejected_by string, n_rules_run int")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            m, by, n = Measures(t), None, 0
            for r in cascade:
                n += 1
                if r.rejects(m):
                    by = r.name
                    break
            out.append((by is None, by, n))
        return pd.DataFrame(out, columns=["kept", "rejected_by", "n_rules_run"])

    return docs.withColumn(fresh(docs, into), run(F.col("text")))


def measure_and_judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, into: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``into``: the base measures, base_failed and the cascade's verdict.

    One pass: measures that a rule has asked for are not computed again. Awkward rows
    and names are treated as in ``judge``.
    """
    cascade = ordered(docs, rules, sample_rows)
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            m = Measures(t)
            kept = not any(r.rejects(m) for r in cascade)
            failed = m.n_words < 50 or 100 * m.n_repeat_words > 50 * m.n_words
            out.append((m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, kept and not failed))
        return pd.DataFrame(out, columns=columns)

    return docs.withColumn(fresh(docs, into), run(F.col("text")))
