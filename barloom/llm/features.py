"""Hashed n-gram features of texts, and bounded samples of labelled texts, for the linear models."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: ASCII letters lower-cased, other ASCII but digits to spaces; bytes of other characters stay.
PLAIN = bytes(ord(chr(b).lower()) if b >= 128 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


class Remembered(dict):
    """Computes a value for a key when first asked; forgets all beyond ``cap`` keys, so memory stays bounded."""

    def __init__(self, make, cap: int = 400_000):
        super().__init__()
        self.make, self.cap = make, cap

    def __missing__(self, key):
        if len(self) >= self.cap:
            self.clear()
        value = self[key] = self.make(key)
        return value


word_hash = Remembered(xxhash.xxh64_intdigest)


def gram(parts: list[np.ndarray], kind: int, bits: int) -> np.ndarray:
    """Feature ids of n-grams whose i-th words have the hashes ``parts[i]``; ``kind`` separates families."""
    h = np.full(len(parts[0]), (kind * 0x632BE59BD9B4E019 + 1) & (2**64 - 1), np.uint64)
    for i, p in enumerate(parts):
        h = (h ^ p) * _ODD[i % 4]
        h ^= h >> np.uint64(29)
    return ((h * _ODD[3]) >> np.uint64(64 - bits)).astype(np.int32)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """(y, text, n, doc_id): at most ``rows / 2`` labelled texts of either class, picked by a hash of doc_id; n: rows of the class.

    ``learn`` says which doc_ids may be learned from. The picks are at most ``rows``
    ids, so they are broadcast; each class is limited on the map side. Of rows with
    one doc_id the least text counts, which is settled before the shuffle.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & learn).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picks = known.where("y = 0").orderBy(*order).limit(rows // 2).unionByName(known.where("y = 1").orderBy(*order).limit(rows // 2))
    sizes = known.groupBy("y").agg(F.count("*").alias("n"))
    picks = picks.join(F.broadcast(sizes), "y")  # two rows
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(F.broadcast(picks), "doc_id")
    return found.groupBy("y", "n", "doc_id").agg(F.min("text").alias("text"))


class Sparse:
    """Rows of feature ids, one after another."""

    def __init__(self):
        self.ids, self.y, self.n, self.key = [], [], {0: 0, 1: 0}, []

    def add(self, ids: np.ndarray, y: int, n: int, key: int) -> None:
        self.ids.append(ids)
        self.y.append(y)
        self.key.append(key)
        self.n[y] = n

    def shuffled(self, seed: int) -> list[int]:
        """A fixed order that does not depend on how the rows arrived."""
        by_key = sorted(range(len(self.y)), key=lambda i: (xxhash.xxh64_intdigest(str(self.key[i]), seed), self.key[i], len(self.ids[i])))
        return by_key

    def prior_shift(self) -> float:
        """What to add to a log-odds learned on this sample, so that it fits the classes' true shares."""
        have = [max(1, self.y.count(k)) for k in (0, 1)]
        return float(np.log(max(1, self.n[1]) / max(1, self.n[0])) - np.log(have[1] / have[0]))
