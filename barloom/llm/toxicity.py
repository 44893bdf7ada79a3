"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from barloom.llm.common import stored
from barloom.llm.features import PLAIN, Remembered, Sparse, gram, labelled_sample

BITS = 18
SAMPLE_ROWS = 12_000  # most labelled rows that are fitted
ALPHA, BETA, L1, L2, PASSES = 0.3, 1.0, 4.0, 1.0, 6


def beginnings(word: bytes) -> bytes:
    """Hashes of a word and of its first four, five and six bytes, so that inflected forms meet."""
    return b"".join(xxhash.xxh64_digest(part) for part in (word, word[:4], word[:5], word[:6]))


word_beginnings = Remembered(beginnings)


def features(text: bytes) -> np.ndarray:
    """Ids (repeats included) of words and their beginnings, pairs of neighbours, and pairs with one word skipped."""
    words = text.translate(PLAIN).split()
    h = np.frombuffer(b"".join(map(word_beginnings.__getitem__, words)), np.uint64).reshape(-1, 4).T
    w = h[0]
    found = [gram([w], 1, BITS), gram([w[:-1], w[1:]], 2, BITS), gram([w[:-2], w[2:]], 3, BITS)]
    return np.concatenate(found + [gram([h[i]], 3 + i, BITS) for i in (1, 2, 3)])


@dataclass(frozen=True)
class Model:
    """The non-zero weights, by feature id; a text's log-odds are the bias and the weights of its distinct features."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pd.Series) -> np.ndarray:
        dense = np.zeros(1 << BITS, np.float32)
        dense[self.ids] = self.weights
        out = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            if text:
                ids = features(text)
                out[i] += dense[np.unique(ids[dense[ids] != 0])].sum()
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def ftrl(rows: Sparse, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights by FTRL-proximal: rates per coordinate, L1 keeps a weight at zero until its gradients add up."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(at: np.ndarray) -> np.ndarray:
        pull = L1 * (at != bias)
        return np.where(np.abs(z[at]) <= pull, 0.0, -(z[at] - np.sign(z[at]) * pull) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for turn in range(passes):
        for r in rows.shuffled(turn):
            at = np.append(rows.ids[r], bias)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - rows.y[r]
            old = n[at]
            n[at] = old + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(old)) / ALPHA * w
    w = weights(np.arange(bias + 1))
    at = np.flatnonzero(w[:bias])
    return at.astype(np.int32), w[at], float(w[bias])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``sample_rows`` labelled documents; features are made where the rows are, the fit is one bounded task.

    Without rows of both classes the model is the share of label 1 (0.5 without any).
    """

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["ids"] = [np.unique(features(t)) for t in b["text"]]
            yield b[["y", "n", "doc_id", "ids"]]

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = Sparse()
        for b in batches:
            for y, n, key, ids in zip(b["y"], b["n"], b["doc_id"], b["ids"]):
                rows.add(np.asarray(ids, np.int32), int(y), int(n), int(key))
        if len(set(rows.y)) == 2:
            at, w, bias = ftrl(rows)
            yield pd.DataFrame({"ids": [at], "weights": [w], "bias": [bias + rows.prior_shift()]})
        else:
            yield pd.DataFrame({"ids": [[]], "weights": [[]], "bias": [0.0 if not rows.y else 4.0 * (2 * rows.y[0] - 1)]})

    # written out, so that tables are read and features made in parallel and only the bounded sample goes to one task
    sample = stored(labelled_sample(docs, labels, label, learn, sample_rows).mapInPandas(featured, "y int, n long, doc_id long, ids array<int>"))
    row = sample.coalesce(1).mapInPandas(fitted, "ids array<int>, weights array<double>, bias double").first()
    if row is None:
        return Model(np.empty(0, np.int32), np.empty(0), 0.0)
    return Model(np.array(row["ids"], np.int32), np.array(row["weights"]), row["bias"])


def score(text: Column, model: Model, spark) -> Column:
    """Probability of label 1 for every text; null counts as empty. The broadcast model has at most 2^18 weights."""
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts))

    return scored(text.cast("binary"))


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs`` (doc_id, text).

    ``held_out`` is a condition on doc_id; those rows are never learned from. Null
    and empty texts get the score of a text without features. A row without doc_id
    is not held out and not learned from. Labels other than 0 and 1 are ignored;
    a doc_id with both labels counts once for each, and of repeated rows the least text.
    """
    model = fit(docs, labels, ~held_out, sample_rows=sample_rows)
    scored = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), score(F.col("text"), model, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
