"""Quality: naive Bayes support vectors over hashed n-gram indicators."""

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
from barloom.llm.features import PLAIN, Remembered, Sparse, gram, labelled_sample, word_hash

BITS = 18
SAMPLE_ROWS = 12_000  # most labelled rows that are fitted
COST, PASSES, SMOOTH = 1.0, 60, 1.0
TOLERANCE = 0.05  # descent ends when no dual variable is further than this from its optimum condition


def shape(word: bytes) -> int:
    """What a word looks like: its case, its length class, and the last marks on it."""
    core = word.rstrip(bytes(b for b in range(33, 127) if not chr(b).isalnum()))
    marks = word[len(core) :]
    text = core.decode("utf-8", "replace")
    case = "n" if not text else "d" if text.isdigit() else "U" if len(text) > 1 and text.isupper() else "T" if text[0].isupper() else "l" if text.islower() else "m"
    size = min(len(text).bit_length(), 6)
    return xxhash.xxh64_intdigest(f"{case}{size}{'+' if len(marks) > 2 else marks.decode()}{bool(core.translate(PLAIN).count(b' '))}")


word_shape = Remembered(shape)


def features(text: bytes) -> np.ndarray:
    """Distinct ids: words and pairs of words; runs of one to three shapes, where a repeated word has its own shape."""
    words = text.split()
    if not words:
        return np.empty(0, np.int32)
    h = np.fromiter(map(word_hash.__getitem__, words), np.uint64, len(words))
    s = np.fromiter(map(word_shape.__getitem__, words), np.uint64, len(words))
    s[1:][h[1:] == h[:-1]] = 1
    found = [gram([h], 1, BITS), gram([h[:-1], h[1:]], 2, BITS), gram([s], 3, BITS), gram([s[:-1], s[1:]], 4, BITS), gram([s[:-2], s[1:-1], s[2:]], 5, BITS)]
    return np.unique(np.concatenate(found))


@dataclass(frozen=True)
class Model:
    """``weights``: SVM weight times log-count ratio; ``ratios``: for the norm; margin to log-odds: ``slope``, ``shift``."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, ids: np.ndarray) -> float:
        if not len(ids):
            return self.bias
        return float(self.weights[ids].sum() / np.sqrt(max(self.squares[ids].sum(), 1e-12)) + self.bias)

    def scores(self, texts: pd.Series) -> np.ndarray:
        margins = np.array([self.margin(features(t) if t else np.empty(0, np.int32)) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def descend(rows: Sparse, ratio: np.ndarray, order: list[int]) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; rows have unit norm, a constant 1 is the bias feature."""
    w, bias, dual = np.zeros(len(ratio)), 0.0, np.zeros(len(rows.y))
    values = []
    for ids in rows.ids:
        v = ratio[ids]
        values.append(v / max(np.sqrt((v * v).sum()), 1e-6))
    for turn in range(PASSES):
        worst = 0.0
        for r in order if turn % 2 == 0 else order[::-1]:
            y, ids, v = 2 * rows.y[r] - 1, rows.ids[r], values[r]
            gradient = y * (w[ids] @ v + bias) - 1
            # what a move could gain: none below at 0, none above at COST
            worst = max(worst, -gradient if dual[r] < COST else 0.0, gradient if dual[r] > 0 else 0.0)
            new = min(max(dual[r] - gradient / 2.0, 0.0), COST)
            if new != dual[r]:
                move, dual[r] = (new - dual[r]) * y, new
                w[ids] += move * v
                bias += move
        if worst < TOLERANCE:
            break
    return w, bias


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of log-odds over margins, by Newton steps; the target shares are pulled in from 0 and 1."""
    up, down = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g, q = p - goal, p * (1 - p) + 1e-9
        grad = np.array([g @ margins + 1e-3 * a, g.sum()])
        hess = np.array([[q @ (margins * margins) + 1e-3, q @ margins], [q @ margins, q.sum()]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fitted(rows: Sparse) -> Model:
    order = rows.shuffled(0)
    count = np.full((2, 1 << BITS), SMOOTH)
    for ids, y in zip(rows.ids, rows.y):
        count[y, ids] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    w, bias = descend(rows, ratio, order)
    model = Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), bias, 1.0, 0.0)
    slope, shift = calibrate(np.array([model.margin(i) for i in rows.ids]), np.array(rows.y))
    return Model(model.weights, model.squares, bias, slope, shift + rows.prior_shift())


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``sample_rows`` labelled documents; features are made where the rows are, the fit is one bounded task.

    Without rows of both classes every text gets the score of the only class (0.5 without any).
    """

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["ids"] = [features(t) for t in b["text"]]
            yield b[["y", "n", "doc_id", "ids"]]

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = Sparse()
        for b in batches:
            for y, n, key, ids in zip(b["y"], b["n"], b["doc_id"], b["ids"]):
                rows.add(np.asarray(ids, np.int32), int(y), int(n), int(key))
        if len(set(rows.y)) == 2:
            m = fitted(rows)
        else:
            zero = np.zeros(1 << BITS, np.float32)
            m = Model(zero, zero, 0.0, 1.0, 0.0 if not rows.y else 4.0 * (2 * rows.y[0] - 1))
        yield pd.DataFrame({"weights": [m.weights.tobytes()], "squares": [m.squares.tobytes()], "bias": [m.bias], "slope": [m.slope], "shift": [m.shift]})

    # written out, so that tables are read and features made in parallel and only the bounded sample goes to one task
    sample = stored(labelled_sample(docs, labels, label, learn, sample_rows).mapInPandas(featured, "y int, n long, doc_id long, ids array<int>"))
    row = sample.coalesce(1).mapInPandas(one, "weights binary, squares binary, bias double, slope double, shift double").first()
    if row is None:
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, 1.0, 0.0)
    return Model(np.frombuffer(row["weights"], np.float32), np.frombuffer(row["squares"], np.float32), row["bias"], row["slope"], row["shift"])


def score(text: Column, model: Model, spark) -> Column:
    """Probability of label 1 for every text; null counts as empty. The broadcast model is 2 MB."""
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts))

    return scored(text.cast("binary"))


def quality(docs: DataFrame, labels: DataFrame, held_out: Column, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs`` (doc_id, text).

    ``held_out`` is a condition on doc_id; those rows are never learned from. Null
    and empty texts get the score of a text without features. A row without doc_id
    is not held out and not learned from. Labels other than 0 and 1 are ignored;
    a doc_id with both labels counts once for each, and of repeated rows the least text.
    """
    model = fit(docs, labels, ~held_out, sample_rows=sample_rows)
    scored = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), score(F.col("text"), model, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
