"""Toxicity, quality and language: held-out accuracy, and defined results on odd rows."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from barloom.llm import language, quality, toxicity
from barloom.llm.common import fold
from barloom.llm.features import Sparse
from tests.llm.helpers import auc, docs_frame

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n "), (4, "123 456"), (5, "!!!"), (6, "word " * 60_000), (None, "no id at all"), (7, "same"), (7, "same")]
LABELS = "doc_id long, toxic int, quality int"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("op,label,folds,out,least", [(toxicity.toxicity, "toxic", 5, 0, 0.9), (quality.quality, "quality", 3, 1, 0.97)])
def test_held_out_rows_are_told_apart(tables, op, label, folds, out, least):
    docs, labels = tables
    got = op(docs, labels, fold("doc_id", folds) == out).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.5)).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert auc(held["score"], held[label]) > least
    assert (held["predicted"] == held[label]).mean() > 0.93
    want = duckdb.connect().sql(f"select doc_id from read_parquet('{SF}/documents.parquet')").df()["doc_id"]
    import zlib

    assert {d for d in want if zlib.crc32(str(d).encode()) % folds == out} == set(got[got["held_out"]]["doc_id"])


def test_held_out_labels_are_never_learned(tables):
    docs, labels = tables
    held = fold("doc_id", 5) == 0
    flipped = labels.withColumn("toxic", (labels["toxic"] != held.cast("int")).cast("int"))
    a = toxicity.toxicity(docs, labels, held).toPandas().set_index("doc_id")["score"]
    b = toxicity.toxicity(docs, flipped, held).toPandas().set_index("doc_id")["score"]
    assert (a == b.reindex(a.index)).all()


@pytest.mark.parametrize("op", [toxicity.toxicity, quality.quality])
def test_odd_rows_are_scored(spark, op):
    docs = docs_frame(spark, ODD + [(100 + i, f"good text {i} of words") for i in range(40)] + [(200 + i, f"vile scum {i} !!") for i in range(40)])
    labels = spark.createDataFrame([(100 + i, 0, 1) for i in range(40)] + [(200 + i, 1, 0) for i in range(40)] + [(1, None, None), (2, 1, 1), (None, 1, 1), (999, 0, 0), (100, 0, 1), (4, 7, 7)], LABELS)
    got = op(docs, labels, fold("doc_id", 3) == 1).toPandas()
    assert len(got) == len(ODD) + 80 and got["score"].between(0, 1).all() and got["held_out"].notna().all()
    assert op(docs.where("false"), labels, fold("doc_id", 3) == 1).count() == 0
    none = op(docs, labels.where("false"), fold("doc_id", 3) == 1).toPandas()
    assert (none["score"] == 0.5).all() and (none["predicted"] == 1).all()
    one = op(docs, labels.where("doc_id between 100 and 139"), fold("doc_id", 3) == 1).toPandas()
    assert one["predicted"].nunique() == 1


def test_ftrl_keeps_few_weights():
    rng = np.random.default_rng(1)
    rows = Sparse()
    for i in range(600):
        y = i % 2
        ids = rng.choice(np.arange(100, 5000), 40, replace=False)
        rows.add(np.unique(np.append(ids, [7] if y else [8])).astype(np.int32), y, 300, i)
    at, w, _ = toxicity.ftrl(rows)
    weight = dict(zip(at, w))
    assert weight[7] > 0.5 and weight.get(8, 0) <= 0 and len(at) < 2500
    assert max(weight, key=lambda k: abs(weight[k])) in (7, 8)


def test_language_on_held_out_rows(tables):
    docs, _ = tables
    found, name = language.identify(docs.select("doc_id", "text", "lang"), fold("doc_id", 4) == 2)
    got = found.select("doc_id", "lang", f"{name}.*").toPandas()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert got["score"].between(0, 1).all() and got["accepted"].mean() > 0.995


def test_language_of_odd_rows(spark):
    known = [(100 + i, f"the words and of this {i} that were", "en") for i in range(30)] + [(200 + i, f"les mots et de la {i} que nous", "fr") for i in range(30)]
    docs = docs_frame(spark, [*ODD, *known, (300, "unlabelled the words", None), (301, "日本語の文章です", None)]).withColumnsRenamed({"size": "language", "place": "_guess"})
    got, name = language.identify(docs, fold("doc_id", 4) == 2)
    assert got.columns == [*docs.columns, name] and name not in docs.columns
    rows = {r["doc_id"]: r[name] for r in got.collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 and not rows[i]["accepted"] for i in (1, 2, 3, 4, 5))
    assert rows[300]["lang_pred"] == "en" and rows[6]["lang_pred"] in ("en", "fr") and rows[301]["lang_pred"] in ("en", "fr")
    assert got.count() == len(ODD) + 62
    found, name = language.identify(docs_frame(spark, ODD), fold("doc_id", 4) == 2)
    nothing = found.select(f"{name}.*").toPandas()
    assert (nothing["lang_pred"] == "und").all() and not nothing["accepted"].any()
    assert language.identify(docs_frame(spark, []), fold("doc_id", 4) == 2)[0].count() == 0


def test_noise_is_rejected():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["the", "of", "and", "words", "that"], 30)).encode() for _ in range(50)]
    x = language.vectors(texts, np.ones(1 << language.DIMS_BITS, np.float32))
    centres, near = language.clustered(x)
    model = language.Model(np.ones(1 << language.DIMS_BITS, np.float32), ["en"] * len(centres), centres, np.full(len(centres), np.quantile(near, 0.001) / 4))
    names, best, accepted = model.predict([texts[0], "жщюйбъэ цфгшз".encode(), b"zzzzqqqq"])
    assert list(accepted) == [True, False, False] and names[0] == "en" and best[0] > best[1]
    assert pd.Series(best).between(0, 1).all()
