"""Language ID: normalised TF-IDF n-gram vectors against several clustered centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from barloom.llm.common import small_side, stored, unused
from barloom.llm.features import PLAIN

DIMS_BITS = 13
SAMPLE_PER_LANGUAGE, CENTROIDS, ROUNDS = 1_000, 6, 8  # most rows that are clustered per language
UNKNOWN = "und"
LETTER = r"\p{L}"
#: Digits are no letters: they are spaces here too.
LETTERS = bytes(32 if chr(b).isdigit() and b < 128 else PLAIN[b] for b in range(256))


def counts(text: bytes) -> np.ndarray:
    """Counts of hashed runs of two and three bytes of the words, a space at either end of each."""
    raw = np.frombuffer(b" " + b" ".join(text.translate(LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(1 << DIMS_BITS, np.float32)
    two = raw[:-1] << np.uint32(8) | raw[1:]
    three = two[:-1] << np.uint32(8) | raw[2:]
    at = np.concatenate([(two * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIMS_BITS), (three * np.uint32(0x85EBCA6B)) >> np.uint32(32 - DIMS_BITS)])
    return np.bincount(at, minlength=1 << DIMS_BITS).astype(np.float32)


def vectors(texts, idf: np.ndarray) -> np.ndarray:
    """One row per text: root of the count times idf, of length 1; zero without n-grams."""
    out = np.zeros((len(texts), len(idf)), np.float32)
    for row, text in zip(out, texts):
        if text:
            c = counts(text)
            at = np.flatnonzero(c)
            row[at] = np.sqrt(c[at]) * idf[at]
            row /= max(np.sqrt(row @ row), 1e-12)
    return out


def clustered(x: np.ndarray, wanted: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids by spherical k-means, started from far rows; and each row's cosine to its nearest."""
    centres = [x.mean(0)]
    centres[0] /= max(np.sqrt(centres[0] @ centres[0]), 1e-12)
    first = x[(x @ centres[0]).argmax()]
    centres = [first]
    for _ in range(min(wanted, len(x)) - 1):
        far = np.argsort((x @ np.array(centres).T).max(1), kind="stable")
        centres.append(x[far[len(far) // 4]])  # far, but no outlier
    centres = np.array(centres)
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(1)
        for k in range(len(centres)):
            if (near == k).any():
                mean = x[near == k].mean(0)
                centres[k] = mean / max(np.sqrt(mean @ mean), 1e-12)
    return centres, (x @ centres.T).max(1)


@dataclass(frozen=True)
class Model:
    """idf, centroids row by row with their languages, and the least cosine that each language accepts."""

    idf: np.ndarray
    names: list
    centroids: np.ndarray
    least: np.ndarray

    def predict(self, texts) -> tuple[list, np.ndarray, np.ndarray]:
        names, best, accepted = [], np.zeros(len(texts)), np.zeros(len(texts), bool)
        for i in range(0, len(texts), 256):
            cosines = vectors(texts[i : i + 256], self.idf) @ self.centroids.T
            at = cosines.argmax(1)
            best[i : i + 256] = np.clip(cosines[np.arange(len(at)), at], 0, 1)
            accepted[i : i + 256] = best[i : i + 256] >= self.least[at]
            names += [self.names[k] for k in at]
        return names, best, accepted


def fit(docs: DataFrame, learn: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Learn from ``docs`` (doc_id, text, lang) where ``learn`` holds, lang is not null and the text has a letter; None without such rows.

    Document frequencies count all these rows. Each language is clustered in a task
    of its own from at most ``per_language`` rows, picked by a hash of doc_id: only
    about twice as many are shuffled, whatever the size of the language. The driver gets the centroids, a few per language.
    """
    known = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").where(learn & F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    known = known.select("doc_id", "lang", F.col("text").cast("binary").alias("text"))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(1 << DIMS_BITS, np.int64), 0
        for b in batches:
            for t in b["text"]:
                df += counts(t) > 0
                n += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"at": np.append(at, -1), "n": np.append(df[at], n)})

    rows = known.select("text").mapInPandas(frequencies, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # one row per dimension
    rows = rows.set_index("at")["n"]
    total = int(rows.get(-1, 0))
    if total == 0:
        return None
    df = np.zeros(1 << DIMS_BITS)
    df[[i for i in rows.index if i >= 0]] = [rows[i] for i in rows.index if i >= 0]
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        x = vectors(list(pdf.sort_values("doc_id")["text"]), idf)
        x = x[(x * x).sum(1) > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "centroid": [], "least": []})
        centres, cosine = clustered(x)
        least = float(np.quantile(cosine, 0.001)) / 4
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [c.tolist() for c in centres], "least": least})

    # a share of each language that holds about twice the wanted rows goes on, so a large language costs its task no more
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    sizes = known.groupBy("lang").agg(F.count("*").alias("_n"))
    near = known.join(small_side(stored(sizes)), "lang").where(place < F.lit(2.0 * per_language * (1 << 40)) / F.col("_n"))
    picked = Window.partitionBy("lang").orderBy(place, "doc_id")
    sample = near.withColumn("_rank", F.row_number().over(picked)).where(F.col("_rank") <= per_language).drop("_rank", "_n")
    found = sample.groupBy("lang").applyInPandas(cluster, "lang string, centroid array<float>, least double").toPandas()
    if not len(found):
        return None
    found["key"] = [(r.lang, tuple(r.centroid)) for r in found.itertuples()]
    found = found.sort_values("key")
    return Model(idf, list(found["lang"]), np.array(list(found["centroid"]), np.float32), found["least"].to_numpy())


def identify(docs: DataFrame, held_out: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[DataFrame, str]:
    """``docs`` (doc_id, text, lang) with one more column, and its name (new to ``docs``): struct(held_out, lang_pred, score, accepted).

    ``lang_pred`` is the language of the nearest centroid and ``score`` its cosine;
    a text that is null or has no letter is ``und`` with score 0 and not accepted.
    ``accepted`` is false as well where the cosine is under a quarter of what all but
    a thousandth of the learned rows of that language reach. Held-out rows and
    rows without doc_id or lang are not learned from. If nothing can be learned,
    all rows are ``und``.
    """
    model = fit(docs, ~held_out, per_language)
    has_letter = F.coalesce(F.col("text").rlike(LETTER), F.lit(False))
    held = F.coalesce(held_out, F.lit(False)).alias("held_out")
    found = unused("language", docs)
    none = [F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted")]
    if model is None:
        return docs.withColumn(found, F.struct(held, *none)), found
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang_pred string, score double, accepted boolean")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        names, best, accepted = shared.value.predict(list(texts))
        return pd.DataFrame({"lang_pred": names, "score": best, "accepted": accepted})

    guess = docs.withColumn(found, predicted(F.col("text").cast("binary")))
    fields = [F.col(found)[c].alias(c) for c in ("lang_pred", "score", "accepted")]
    return guess.withColumn(found, F.when(has_letter, F.struct(held, *fields)).otherwise(F.struct(held, *none))), found
