"""Packing along a space-filling curve.

Each document's token ids give a hashed vector, projected to three dimensions; the
point's place on a Hilbert curve is its key. Documents are range-sorted by key, and
neighbours along the curve are laid end to end into sequences of 2048 ids, cut
wherever a sequence is full. What is left at the end of a range is cut at powers of
two, so no sequence is padded.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import cut

END_ID = 1
SPECIAL = {"<|endoftext|>": 50256}
DIMS, BITS = 3, 10
RANGE_IDS = 1 << 23  # ids of a range, about: a task reads 16 MB, however large the table


def vocabulary_path() -> str:
    """The ranks of the 50,257-id byte-level vocabulary; the same vocabulary as byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


_encoders: dict[str, object] = {}


def encoder(path: str, pat: str):
    """The encoder of a rank file, made once in each worker. Its ids equal those of the `tokenizers` file of the same vocabulary."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("packing", pat_str=pat, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encoders[path]


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows, dims), by the transpose method: undo excess turns, then Gray-code."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(turned, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(17).standard_normal((1 << 16, DIMS)).astype(np.float32)


def tokenized(docs: DataFrame, path: str, pat: str) -> DataFrame:
    """doc_id, n (ids), ids (little-endian unsigned 16-bit), key, and a row number that is fixed once the result is written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, plane = encoder(path, pat), _projection()
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            ids = [np.array([*enc.encode(t or "", allowed_special="all", disallowed_special=()), END_ID], np.uint16) for t in b["text"]]
            means = np.array([plane[i].mean(0) for i in ids]).reshape(len(ids), DIMS)
            points = ((0.5 + 0.5 * np.tanh(4 * means)) * ((1 << BITS) - 1)).astype(np.int64)
            yield pd.DataFrame(
                {"doc_id": b["doc_id"].astype("Int64"), "n": [len(i) for i in ids], "ids": [i.astype("<u2").tobytes() for i in ids], "key": hilbert_key(points), "row": range(row, row + len(ids))}
            )
            row += len(ids)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n long, ids binary, key long, row long")


def _rooms(left: int, size: int) -> int:
    """The length of the next sequence when ``left`` ids remain: full, or the largest power of two."""
    return size if left >= size else 1 << (left.bit_length() - 1)


def pack(docs: DataFrame, size: int = 2048, path: str | None = None, pat: str | None = None, partitions: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``size`` is a power of two. Each id of each document lies in exactly one piece.
    Null text counts as empty: the end id alone. Equal keys (copies) are split by
    row number, so one text in a third of all rows still spreads over tasks.
    Repeated rows are packed as often as they occur; an empty table gives no rows.
    """
    spark = docs.sparkSession
    stored = cut(tokenized(docs, path or vocabulary_path(), pat or pattern()), "tokens")
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(stored.agg(F.sum("n")).first()[0] or 0) // RANGE_IDS))
    ranged = stored.repartitionByRange(n, "key", "row").sortWithinPartitions("key", "row")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence, held, waiting = TaskContext.get().partitionId() << 40, [], 0

        def lay(all_: bool) -> list[tuple]:
            """Full sequences out of ``held``; at the end of the range all the rest."""
            nonlocal sequence, waiting
            out = []
            while waiting >= size or (all_ and waiting):
                room, offset = _rooms(waiting, size), 0
                waiting -= room
                while offset < room:
                    doc, ids, start = held[0]
                    take = min(len(ids) - start, room - offset)
                    piece = ids[start : start + take].astype("<u4").tobytes()
                    out.append((doc, start, take, zlib.crc32(piece), len(ids), sequence, offset, piece))
                    offset += take
                    if start + take == len(ids):
                        held.pop(0)
                    else:
                        held[0] = (doc, ids, start + take)
                sequence += 1
            return out

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b["doc_id"], b["ids"]):
                ids = np.frombuffer(ids, "<u2")
                held.append((None if pd.isna(doc) else int(doc), ids, 0))
                waiting += len(ids)
                if waiting >= 64 * size:
                    rows += lay(False)
            yield frame(rows + lay(False))
        yield frame(lay(True))

    return ranged.select("doc_id", "ids").mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
