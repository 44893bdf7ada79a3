"""Toxicity, quality and language against plain restatements: weights, optimum conditions and scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import language, quality, toxicity
from barloom.llm.common import fold
from barloom.llm.features import Sparse, labelled_sample
from tests.llm.helpers import docs_frame

LABELS = "doc_id long, toxic int, quality int"


def learned(docs, labels, label, modulus, out, features):
    """Rows that may be learned from, all of them, by doc_id."""
    import zlib

    rows = Sparse()
    n = {k: sum(1 for d, y in labels.items() if y == k and zlib.crc32(str(d).encode()) % modulus != out) for k in (0, 1)}
    for d, y in labels.items():
        if zlib.crc32(str(d).encode()) % modulus != out and d in docs:
            rows.add(np.unique(features((docs[d] or "").encode())), y, n[y], d)
    return rows


def plain_ftrl(rows, order):
    """Per-coordinate FTRL-proximal over dictionaries."""
    z, n = {}, {}

    def weight(k):
        pull = 0 if k is None else toxicity.L1
        if abs(z.get(k, 0.0)) <= pull:
            return 0.0
        return -(z[k] - math.copysign(pull, z[k])) / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    for turn in range(toxicity.PASSES):
        for r in order(turn):
            at = [*rows.ids[r].tolist(), None]
            w = {k: weight(k) for k in at}
            g = 1 / (1 + math.exp(-min(35, max(-35, sum(w.values()))))) - rows.y[r]
            for k in at:
                old = n.get(k, 0.0)
                n[k] = old + g * g
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n[k]) - math.sqrt(old)) / toxicity.ALPHA * w[k]
    return {k: weight(k) for k in z}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    mild, harsh = [f"kind{i}" for i in range(40)], [f"vile{i}" for i in range(40)]
    docs, labels = {}, {}
    for i in range(400):
        y = rng.random() < 0.4
        docs[i] = " ".join(rng.choice(harsh if y and rng.random() < 0.2 else mild) for _ in range(rng.randint(0, 60)))
        if i % 3:
            labels[i] = int(y)
    docs[7] = None
    return docs, labels


def frames(spark, corpus, label):
    docs, labels = corpus
    return docs_frame(spark, list(docs.items())), spark.createDataFrame([(d, y if label == "toxic" else None, y if label == "quality" else None) for d, y in labels.items()], LABELS)


def test_toxicity_equals_plain_ftrl(spark, corpus):
    docs, labels = corpus
    rows = learned(docs, labels, "toxic", 5, 0, toxicity.features)
    want = plain_ftrl(rows, rows.shuffled)
    at, w, bias = toxicity.ftrl(rows)
    assert {int(k): v for k, v in zip(at, w)} == pytest.approx({k: v for k, v in want.items() if k is not None and v})
    assert bias == pytest.approx(want[None])
    bias += rows.prior_shift()
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(*frames(spark, corpus, "toxic"), fold("doc_id", 5) == 0).collect()}
    for d, t in docs.items():
        odds = bias + sum(want.get(k, 0.0) for k in set(toxicity.features((t or "").encode()).tolist()))
        assert got[d] == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-5)


def test_descent_meets_the_optimum_of_the_hinge_loss():
    rng = np.random.default_rng(2)
    rows = Sparse()
    for i in range(200):
        y = i % 2
        rows.add(np.unique(np.append(rng.integers(10, 60, 6), [1] if y != (i % 17 == 0) else [2])).astype(np.int32), y, 100, i)
    ratio = rng.normal(size=1 << quality.BITS)
    ratio[[1, 2]] = 2, -2
    x = np.zeros((200, 61))
    for i, ids in enumerate(rows.ids):
        x[i, ids] = ratio[ids] / np.sqrt((ratio[ids] ** 2).sum())
        x[i, 60] = 1
    y = 2 * np.array(rows.y) - 1
    # the dual over all pairs of rows, to convergence
    q = (x * y[:, None]) @ (x * y[:, None]).T
    dual = np.zeros(200)
    for _ in range(4000):
        for i in range(200):
            dual[i] = min(max(dual[i] - (q[i] @ dual - 1) / q[i, i], 0), quality.COST)
    gradient = q @ dual - 1
    assert (gradient[dual == 0] > -1e-6).all() and (gradient[dual == quality.COST] < 1e-6).all()
    assert np.abs(gradient[(dual > 0) & (dual < quality.COST)]).max() < 1e-6
    best = dual.sum() - dual @ q @ dual / 2

    def primal(w):
        return w @ w / 2 + quality.COST * np.maximum(0, 1 - y * (x @ w)).sum()

    assert primal(x.T @ (dual * y)) == pytest.approx(best, rel=1e-6)
    w, bias = quality.descend(rows, ratio, rows.shuffled(0))
    assert best - 1e-6 <= primal(np.append(w[:60], bias)) <= best * 1.02


def test_quality_equals_its_plain_margins(spark, corpus):
    docs, labels = corpus
    rows = learned(docs, labels, "quality", 3, 1, quality.features)
    count = {0: {}, 1: {}}
    for ids, y in zip(rows.ids, rows.y):
        for k in ids.tolist():
            count[y][k] = count[y].get(k, 0) + 1
    total = {y: sum(c.values()) + quality.SMOOTH * (1 << quality.BITS) for y, c in count.items()}

    def ratio(k):
        return math.log((count[1].get(k, 0) + quality.SMOOTH) / total[1]) - math.log((count[0].get(k, 0) + quality.SMOOTH) / total[0])

    model = quality.fitted(rows)
    w, bias = quality.descend(rows, np.array([ratio(k) for k in range(1 << quality.BITS)]), rows.shuffled(0))
    got = {r["doc_id"]: r["score"] for r in quality.quality(*frames(spark, corpus, "quality"), fold("doc_id", 3) == 1).collect()}
    for d, t in docs.items():
        ids = quality.features((t or "").encode()).tolist()
        norm = math.sqrt(sum(ratio(k) ** 2 for k in ids)) if ids else 1
        margin = bias + sum(w[k] * ratio(k) for k in ids) / max(norm, 1e-6)
        assert got[d] == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.shift))), abs=1e-4)


def test_language_equals_plain_centroids(spark):
    rng = random.Random(3)
    words = {"en": "the of and words that this were".split(), "fr": "les mots et de la nous été".split(), "xx": "ñu ma 日本 語".split()}
    docs = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 20))), lang) for i, lang in enumerate(rng.choice(["en", "fr", "xx"]) for _ in range(150))]
    frame = docs_frame(spark, docs)
    held = fold("doc_id", 4) == 2
    model = language.fit(frame, ~held)
    import zlib

    known = [(t, lang) for i, t, lang in docs if zlib.crc32(str(i).encode()) % 4 != 2]

    def grams(text):
        raw = (" " + " ".join(text.split()) + " ").encode()
        out = {}
        for k, mix in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
            for i in range(len(raw) - k + 1):
                at = (int.from_bytes(raw[i : i + k], "big") * mix % 2**32) >> (32 - language.DIMS_BITS)
                out[at] = out.get(at, 0) + 1
        return out

    df = {}
    for t, _ in known:
        for k in grams(t):
            df[k] = df.get(k, 0) + 1

    def vector(text):
        v = {k: math.sqrt(n) * (math.log((1 + len(known)) / (1 + df.get(k, 0))) + 1) for k, n in grams(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {k: x / norm for k, x in v.items()}

    assert sorted(set(model.names)) == ["en", "fr", "xx"] and len(model.names) == 3 * language.CENTROIDS
    # every centroid is the unit mean of rows of its language
    for name, c in zip(model.names, model.centroids):
        near = [vector(t) for t, lang in known if lang == name]
        near = [v for v in near if max(range(len(model.names)), key=lambda k: (model.names[k] == name) * (2 + sum(x * model.centroids[k][i] for i, x in v.items()))) == model.names.index(name) + [i for i, n in enumerate(model.names) if n == name].index(next(i for i in range(len(model.names)) if model.centroids[i] is c or np.array_equal(model.centroids[i], c)))]
        mean = np.zeros(1 << language.DIMS_BITS)
        for v in near:
            for i, x in v.items():
                mean[i] += x
        assert mean @ c / np.sqrt(mean @ mean) > 0.97
    found, name = language.identify(frame, held)
    for r in found.collect():
        v = vector(r["text"])
        cosine = [sum(x * c[i] for i, x in v.items()) for c in model.centroids]
        assert r[name]["score"] == pytest.approx(max(cosine), abs=1e-4)
        assert max(s for s, n in zip(cosine, model.names) if n == r[name]["lang_pred"]) == pytest.approx(max(cosine), abs=1e-5)


def test_a_language_of_few_texts_with_letters_is_learned(spark):
    rows = [(i, "1 2 3", "no") for i in range(6000)] + [(10_000 + i, f"ord og bokstaver {i}", "no") for i in range(20)] + [(20_000 + i, f"words and letters {i}", "en") for i in range(20)]
    model = language.fit(docs_frame(spark, rows), F.lit(True), per_language=50)
    assert set(model.names) == {"no", "en"}


def test_repeated_ids_stay_within_the_bound(spark):
    docs = docs_frame(spark, [(i % 6, f"text {i}") for i in range(600)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], LABELS)
    rows = labelled_sample(docs, labels, "toxic", F.lit(True), 4).collect()
    assert sorted(r["y"] for r in rows) == [0, 0, 1, 1] and len({r["doc_id"] for r in rows}) == 4
    assert all(bytes(r["text"]).decode() == min(f"text {i}" for i in range(r["doc_id"], 600, 6)) for r in rows)
