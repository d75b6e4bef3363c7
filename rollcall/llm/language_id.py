"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's lower-cased UTF-8 bytes give hashed 3- and 4-byte subwords; their
embeddings are averaged and a linear layer with softmax predicts the language.
Both are trained together by stochastic gradient descent in numpy, on a bounded
sample of labelled rows. A temperature fitted on held-back rows of that sample
calibrates the probability, and the rejection threshold is read from the same
rows. At prediction time embedding and output layer are folded into one table,
which gives the same scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import broadcast_value, fresh, stratified_sample

UNKNOWN = "und"


def subwords(text: str, buckets: int) -> np.ndarray:
    """Hashed 3- and 4-byte subwords of the whole text, one bucket number each."""
    a = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(a) < 4:
        a = np.pad(a, (0, 4 - len(a)))
    three = a[:-2] * np.uint32(0x9E3779B1) ^ a[1:-1] * np.uint32(0x85EBCA77) ^ a[2:] * np.uint32(0xC2B2AE3D)
    four = three[:-1] * np.uint32(0x27D4EB2F) ^ a[3:] * np.uint32(0x165667B1)
    both = np.concatenate([three, four])
    return ((both ^ (both >> np.uint32(15))) % np.uint32(buckets)).astype(np.int32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # buckets x labels: embedding times output layer
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(label, calibrated probability, rejected)."""
        if not self.labels or not has_letter(text):
            return UNKNOWN, 0.0, True
        z = (self.table[subwords(text, len(self.table))].mean(0, dtype=np.float64) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.labels[best], float(p[best]), bool(p[best] < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], buckets: int, dims: int = 8, epochs: int = 6, rate: float = 0.5, least_threshold: float = 0.4) -> LanguageModel:
    """``rows``: (buckets, their shares, label) of each labelled text."""
    labels = sorted({r[2] for r in rows})
    if not labels:
        return LanguageModel([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(11)
    order = rng.permutation(len(rows))
    held = max(1, len(rows) // 5) if len(rows) >= 20 else 0
    kept, back = order[held:], order[:held]
    embedding = rng.normal(0, 0.1, (buckets, dims))
    output, bias = rng.normal(0, 0.3, (dims, len(labels))), np.zeros(len(labels))
    at = {x: i for i, x in enumerate(labels)}
    step = 0
    for _ in range(epochs):
        for r in rng.permutation(kept):
            ids, share, label = rows[r]
            hidden = share @ embedding[ids]
            p = _softmax(hidden @ output + bias)
            p[at[label]] -= 1
            lr = rate / (1 + step / (2 * len(rows) + 1))
            back_hidden = output @ p
            output -= lr * np.outer(hidden, p)
            bias -= 0.1 * lr * p
            # scaled by the number of subwords: an average spreads one step over all of them
            embedding[ids] -= lr * 20 * share[:, None] * back_hidden
            step += 1
    table = embedding @ output
    temperature, threshold = 1.0, least_threshold
    if len(back):
        z = np.array([rows[r][1] @ table[rows[r][0]] + bias for r in back])
        y = np.array([at[rows[r][2]] for r in back])
        grid = np.geomspace(0.05, 5, 40)
        loss = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        best, right = _softmax(z / temperature).max(1), z.argmax(1) == y
        # reject below the level up to which held-back rows are wrong more often than right
        for level in np.linspace(0.3, 0.9, 25):
            low = best < level
            if low.sum() >= 5 and right[low].mean() < 0.5:
                threshold = max(threshold, float(level))
    return LanguageModel(labels, table.astype(np.float32), bias, temperature, threshold)


def train(docs: DataFrame, eligible: Column, sample_rows: int = 2000, buckets: int = 1 << 16) -> LanguageModel:
    """Fit on about ``sample_rows`` of the rows of ``docs`` with a language and ``eligible``, every language among them, chosen by a hash of the row.

    Only subword shares of that sample reach the driver.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, lang in zip(b["text"], b["lang"]):
                ids, n = np.unique(subwords(text, buckets), return_counts=True)
                out.append((ids.astype(np.int32).tobytes(), (n / n.sum()).astype(np.float32).tobytes(), lang))
            yield pd.DataFrame(out, columns=["ids", "share", "lang"])

    usable = eligible & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")
    chosen = stratified_sample(docs.filter(usable).select("doc_id", "text", "lang"), sample_rows, "lang", "doc_id", "text")
    found = chosen.mapInPandas(counted, "ids binary, share binary, lang string")
    rows = [(np.frombuffer(r[0], np.int32), np.frombuffer(r[1], np.float32), r[2]) for r in found.toLocalIterator()]
    return fit(sorted(rows, key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes())), buckets)


def predictor(model: LanguageModel, spark):
    """A pandas UDF: text -> struct(lang_pred, score, rejected). The model's size is fixed by its bucket count."""
    get = broadcast_value(spark, model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([get().predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return predict


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows to learn from: crc32 of the id as text, modulo 3, is not 1 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 != 1


def identify(docs: DataFrame, sample_rows: int = 2000, into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into`` (lang_pred, score, rejected).

    Null text or one without a letter: ``und``, score 0, rejected. No labelled
    rows at all: every text is ``und``. Repeated rows are predicted alike; an empty
    table gives no rows. Other columns pass through; where one is called ``into``, the
    new column's name gets an underscore.
    """
    model = train(docs, learnable(), sample_rows)
    return docs.withColumn(fresh(docs, into), predictor(model, docs.sparkSession)(F.col("text")))


def keep_identified(docs: DataFrame, sample_rows: int = 2000) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with the same columns; texts without a letter go, an empty table stays empty."""
    model = train(docs, learnable(), sample_rows)
    return docs.filter(~predictor(model, docs.sparkSession)(F.col("text"))["rejected"])


