"""Hard negatives against all pairs in plain whole numbers."""

import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from barloom.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, id string, codes string, anchor string, dims int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "i", "c", "a", 0) for r in rows], SCHEMA)


def plain(rows, anchor):
    """rows: (vec_id, embedding, label); each different row once."""
    fit = set()
    for i, x, y in rows:
        if i is not None and x and y is not None and all(v is not None and math.isfinite(v) for v in x):
            fit.add((i, tuple(math.floor(256 * float(np.float32(v))) for v in x), y))
    out = []
    for a in fit:
        if not anchor(a[0]):
            continue
        scored = sorted((-sum(p * q for p, q in zip(a[1], b[1])), b[0], b[2]) for b in fit if b != a and len(b[1]) == len(a[1]))
        for score, positive, _ in [s for s in scored if s[2] == a[2]][:5]:
            found = [(n, -s) for s, n, y in scored if y != a[2] and 30 * -score <= 100 * -s <= 90 * -score][:10]
            out += [(a[0], positive, k, n, -score, s) for k, (n, s) in enumerate(found, 1)]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_whole_table(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    got = told(queries.op13_hard_negatives(spark, sf_dir))
    assert got and got == sorted(con.sql(f"select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ({negatives.SQL})").fetchall())
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got == plain(rows, lambda i: i % 100 == 0)


def test_ties_nulls_and_small_blocks(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0, rng.random()]) for _ in range(rng.choice([4, 4, 4, 3]))], rng.choice([0, 1, 1, None])) for i in range(160)]
    rows += [(200, None, 1), (201, [], 1), (202, [1.0, None, 0.0, 0.0], 1), (203, [float("nan"), 1.0, 1.0, 1.0], 0), (204, [float("inf"), 1.0, 1.0, 1.0], 0), (None, [1.0] * 4, 1)]
    rows += rows[:20] + [(5, [0.5, 0.5, 0.5, 0.5], 1), (205, [1e30, 0.0, 0.0, 0.0], 1)]
    kept = [r for r in rows if r[0] != 205]  # its scores would not fit a long: it takes no part
    df = frame(spark, rows)
    for block_rows, anchor_rows in ((1000, 1000), (17, 9)):
        got = told(negatives.hard_negatives(df, F.col("vec_id") % 3 == 0, None, block_rows, anchor_rows))
        assert got == plain(kept, lambda i: i % 3 == 0)


def test_scan_rules_out_most_rows_without_losing_one():
    rng = np.random.default_rng(4)
    codes = np.rint(rng.normal(0, 60, (5000, 64)) * np.geomspace(4, 0.05, 64)).astype(np.int64)
    block = negatives.Block(codes, np.arange(5000), np.zeros(5000, np.int64))
    seen = []

    def watched(rule):
        def narrowed(at, low, high):
            seen.append(len(at))
            score = codes[block.ids[at]] @ anchor
            assert (low <= score).all() and (score <= high).all()
            return rule(at, low, high)

        return narrowed

    for anchor in codes[:5]:
        at, score = block.scan(anchor, np.arange(5000), watched(negatives.best(5)))
        want = np.argsort(-(codes @ anchor), kind="stable")[:5]
        assert at[negatives.ranked(block.ids[at], score, 5)].tolist() == want.tolist()
    assert np.mean(seen) < 2500


def test_hot_label_and_empty_tables(spark):
    same = [(i, [1.0, 0.5], 3) for i in range(300)]
    assert told(negatives.hard_negatives(frame(spark, same), F.col("vec_id") == 0)) == []
    more = [*same, (900, [0.5, 0.25], 4)]
    assert told(negatives.hard_negatives(frame(spark, more), F.col("vec_id") == 0)) == [(0, i, 1, 900, 256 * 256 + 128 * 128, 256 * 128 + 128 * 64) for i in range(1, 6)]
    assert told(negatives.hard_negatives(frame(spark, []), F.col("vec_id") == 0)) == []
