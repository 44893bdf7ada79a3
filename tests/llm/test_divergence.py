"""Source divergence against a dense restatement in plain whole numbers."""

import random
import re
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import divergence, queries
from tests.llm.helpers import docs_frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(rows, least=10, top=10):
    """All groups, all kept terms, all pairs; rows: (text, lang, source)."""
    out, counts, docs = [], {}, {}
    for text, lang, source in rows:
        found = plain_terms(text)
        counts.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(found)
        docs.setdefault(lang or "", Counter()).update(set(found))
    for lang, groups in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def told(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_whole_table(spark, sf_dir):
    rows = [(r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = queries.op12_source_divergence(spark, sf_dir)
    assert told(df) == plain(rows)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert told(df) == sorted(con.sql(f"select lang, source, part, item, value, rank from ({divergence.SQL})").fetchall())


def test_random_copies_nulls_and_ties(spark, monkeypatch):
    rng = random.Random(3)
    pool = ["Alpha beta", "beta Γάμμα gamma", "", None, "1 2 3", "alpha alpha ALPHA", "日本語 テキスト beta", "É é e\u0301 x_y`z{w", "only here"]
    rows = [(rng.choice(pool), rng.choice([None, "", "en", "日本"]), rng.choice([None, "", "a", "b", "Z", "é", "\U0001f600", "\uffee"])) for _ in range(600)]
    rows += [("rare", "en", "a"), (None, "void", "a"), ("7", "void", "b"), ("few", "void", "c")]
    frame = docs_frame(spark, [(i, t, lang, s) for i, (t, lang, s) in enumerate(rows)])
    assert told(divergence.divergence(frame)) == plain(rows)
    monkeypatch.setattr(divergence, "BUCKET_ROWS", 5)
    assert told(divergence.divergence(frame, least_docs=2, top=2)) == plain(rows, 2, 2)


def test_empty_table(spark):
    assert divergence.divergence(docs_frame(spark, [])).count() == 0


def test_many_holders_are_cut_into_portions(monkeypatch):
    import pandas as pd

    rng = random.Random(2)
    rows = [(t, f"s{i:02d}", rng.randint(2, 10**9), 1 + i) for t in range(9) for i in range(25) if rng.random() < 0.8]
    frame = pd.DataFrame(rows, columns=["term", "source", "p", "base"])
    whole = divergence.shared_terms(("en", 0), frame)
    monkeypatch.setattr(divergence, "PAIRS", 40)
    cut = divergence.shared_terms(("en", 0), frame)
    key = ["one", "two"]
    assert whole.sort_values(key).values.tolist() == cut.sort_values(key).values.tolist()
    want = Counter()
    for t, s, p, b in rows:
        for u, o, q, c in rows:
            if t == u and s < o:
                want[s, o] += (p - q) ** 2 // (p + q) - (p - c) ** 2 // (p + c) - (b - q) ** 2 // (b + q) + (b - c) ** 2 // (b + c)
    assert {(a, b): v for _, a, b, v in whole.values.tolist()} == dict(want)


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=200))
def test_terms_in_portions(text):
    part, divergence.PART = divergence.PART, 5
    try:
        got = [w.decode() for words in divergence.terms(text.encode()) for w in words]
    finally:
        divergence.PART = part
    assert got == plain_terms(text)


def test_texts_are_tokenized_once(spark):
    rows = [(i, "one text of many", "en", f"s{i % 3}") for i in range(500)] + [(1000, "one text of many", "de", "s0")]
    found = divergence.collapsed(docs_frame(spark, rows)).collect()
    assert sorted((r["lang"], sorted((h["source"], h["n"]) for h in r["held"])) for r in found) == [
        ("de", [("s0", 1)]), ("en", [("s0", 167), ("s1", 167), ("s2", 166)]),
    ]
