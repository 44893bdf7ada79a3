"""The near-duplicate stage against the exact similarity of all pairs."""

import random

import corpus_pipeline
from tests.llm.helpers import docs_frame, smallest_reachable


def plain_sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def plain_kept(docs):
    """Smallest id of each group that pairs of a similarity of 0.8 or more connect."""
    ids = sorted(docs)
    s = plain_sets(docs[i] for i in ids)
    near = [(i, j) for i in range(len(ids)) for j in range(i) if s[i] == s[j] or s[i] & s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])]
    return sorted({ids[k] for k in smallest_reachable(len(ids), near)})


def test_edited_copies_go(spark):
    rng = random.Random(4)
    docs = {}
    for i in range(400):
        words = rng.choice(list(docs.values())).split() if docs and rng.random() < 0.5 else [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(3, 200))]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 99)}"
        docs[i] = " ".join(words)
    kept = corpus_pipeline.dedup_near(spark, docs_frame(spark, list(docs.items())), None)
    assert sorted(r["doc_id"] for r in kept.collect()) == plain_kept(docs)


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.dedup_near(spark, df, sf_dir)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == plain_kept({r["doc_id"]: r["text"] for r in df.collect()})


def test_one_row_of_a_group_stays(spark):
    rows = [(5, None), (3, ""), (7, "a b c d"), (7, "A b  c d"), (7, "other words here"), (None, "a b c d"), (None, "alone"), (None, "alone")]
    got = corpus_pipeline.dedup_near(spark, docs_frame(spark, rows), None).collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "").lower().split()) for r in got) == [("3", []), ("7", ["a", "b", "c", "d"]), ("7", ["other", "words", "here"]), ("None", ["alone"])]
    assert corpus_pipeline.dedup_near(spark, docs_frame(spark, []), None).count() == 0
