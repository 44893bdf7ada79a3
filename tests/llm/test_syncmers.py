import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import syncmers
from tests.llm.helpers import docs_frame


def h64(*values):
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & (2**64 - 1)).to_bytes(8, "little"), seed)
    return seed - 2**64 if seed >= 2**63 else seed


def plain_anchors(text):
    p = [h64(x) for x in re.findall(r"[^\x20\x09-\x0D]{1,4}", text)]
    s = [h64(x, p[i + 1] if i + 1 < len(p) else None) for i, x in enumerate(p)]
    if not s:
        return []
    if len(s) < 5:
        return [(h64(*s), 0)]
    return [(h64(s[i], s[i + 2], s[i + 3]), i) for i in range(len(s) - 4) if min(s[i : i + 4]) in (s[i], s[i + 3])]


def plain_sketch(text):
    return sorted({(h & (2**64 - 1)) >> 32 for h, _ in plain_anchors(text)})[:64]


def plain_near(a, b):
    u = sorted({*a, *b})[:64]
    return 1.0 if not u else len(set(a) & set(b) & set(u)) / len(u)


TEXTS = ["", " ", "a", "That it.", "of the of the", "one two three four five six seven", "ä" * 33, "日本語テスト " * 9, "same " * 500, "🙂🙂🙂🙂🙂🙂🙂🙂🙂 x"]


@pytest.mark.parametrize("text", TEXTS)
def test_anchors_are_closed_syncmers(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(syncmers.anchors(F.col("t")).alias("a"), syncmers.sketch(F.col("t")).alias("s")).first()
    assert [(x["hash"], x["at"]) for x in row["a"]] == plain_anchors(text)
    assert list(row["s"]) == plain_sketch(text)


def test_anchors_need_no_context(spark):
    passage = " ".join(f"word{i} stands" for i in range(60))
    alone = {h for h, _ in plain_anchors(passage)}
    framed = {h for h, _ in plain_anchors("something else before " + passage + " and after it")}
    assert alone <= framed and len(alone) > 20


@pytest.mark.parametrize("bucket", [2000, 7])
def test_whole_table_matches_plain_version(spark, sf_dir, monkeypatch, bucket):
    monkeypatch.setattr(syncmers, "BUCKET_ROWS", bucket)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    ids = sorted(text)
    nxt = dict(zip(ids, ids[1:] + ids[:1]))
    got = {r["doc_id"]: r for r in syncmers.fingerprints(df).collect()}
    assert sorted(got) == ids
    for d in ids:
        t, m = text[d], len(text[d]) // 2
        edited = t[: len(t) - m] + text[nxt[d]][:m]
        own, other, follow = plain_sketch(t), plain_sketch(edited), plain_sketch(text[nxt[d]])
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == "".join(f"{x:08x}" for x in own) and r["edited_fingerprint"] == "".join(f"{x:08x}" for x in other)
        assert r["near_edited"] == plain_near(own, other) and r["near_next"] == plain_near(own, follow)


def test_edges(spark):
    rows = [(3, None), (1, "first one"), (2, ""), (2, ""), (None, "no id"), (9, "w " * 200_000)]
    got = syncmers.fingerprints(docs_frame(spark, rows)).toPandas()
    assert len(got) == len(rows) and got["near_edited"].between(0, 1).all() and got["near_next"].between(0, 1).all()
    assert (got[got["n_chars"] == 0]["fingerprint"] == "").all()
    one = syncmers.fingerprints(docs_frame(spark, [(1, "a b c d e f g h")])).first()
    assert one["near_next"] == 1.0  # its own next
    assert syncmers.fingerprints(docs_frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = syncmers.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
