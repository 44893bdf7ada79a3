import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import simhash
from barloom.llm.common import components
from tests.llm.helpers import docs_frame, smallest_reachable, unsigned


def plain_simhash(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = [None, "", " \t\n\r\x0b\x0c ", "one", "Two words", "a b c", "A B C", "a  b\tc", "ÄÖ äö x y", "x " * 2000, " a b c d", "w" * 300_000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_is_the_contracts(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(simhash.hex64(simhash.fingerprint(F.col("t")))).first()[0]
    assert got == f"{plain_simhash(text):016x}"


def test_near_duplicates_of_whole_table_match_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(text)
    fp = np.array([plain_simhash(text[i]) for i in ids], np.uint64)
    pairs = np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2)
    want = smallest_reachable(len(ids), pairs)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f"{int(f):016x}", ids[w]) for d, f, w in zip(ids, fp, want)}


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n // 4, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n // 4, dtype=np.uint64)
    out = rng.choice(base, n)
    for _ in range(4):
        out ^= np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    hot = np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, n // 2).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n // 2).astype(np.uint64))
    return np.unique(np.concatenate([out, hot]))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_tree_meets_every_near_pair_in_one_shard_with_a_home(radius):
    fp = clustered(6000, radius)
    tree = simhash.Tree.grown(fp[::3], 64, radius)
    assert tree.leaves > 16
    at, leaf, home = tree.routes(fp, radius)
    assert np.array_equal(np.sort(at[home]), np.arange(len(fp)))
    where = [{} for _ in range(len(fp))]
    for a, k, h in zip(at, leaf, home):
        where[a][k] = h
    near = np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius, 1))
    assert len(near) > 100
    for i, j in near:
        assert any(where[i][k] or where[j][k] for k in where[i].keys() & where[j].keys())


def test_shard_search_equals_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 20_000)  # so that the local splits are used
    fp = clustered(3000, 9)
    home = np.random.default_rng(1).random(len(fp)) < 0.7
    near = np.argwhere((np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2) & (home[:, None] | home[None, :]))
    assert list(simhash.linked(fp, home, 2)) == smallest_reachable(len(fp), near)


def test_hot_shard_is_dealt_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK_ROWS", 100)
    monkeypatch.setattr(simhash, "LEAF_ROWS", 200)
    fp = clustered(1500, 4)
    prints = spark.createDataFrame([(int(f), i) for i, f in enumerate(fp.view(np.int64))], "fp long, node long")
    got = {r["node"]: r["component"] for r in components(simhash.near_links(prints)).collect()}
    want = smallest_reachable(len(fp), np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2))
    assert [got.get(i, i) for i in range(len(fp))] == want


def test_edge_rows(spark):
    rows = [(5, None), (3, ""), (7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, "alone in class"), (9, "other words here")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs_frame(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (7, 7), (7, 7), (None, 7), (None, None), (9, 9)], key=str)
    kept = simhash.deduplicated(docs_frame(spark, rows))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([3, 7, 9, None, None], key=str)
    assert kept.columns == docs_frame(spark, rows).columns
    empty = docs_frame(spark, [])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicated(empty).count() == 0


@pytest.mark.parametrize("shape", ["path", "star", "mixed"])
def test_components(spark, shape):
    rng = np.random.default_rng(2)
    n = 300
    links = {"path": [(i, i + 1) for i in range(n - 1)], "star": [(n - 1, i) for i in range(n - 1)], "mixed": [tuple(x) for x in rng.integers(0, n, (170, 2)).tolist()]}[shape]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = smallest_reachable(n, links)
    assert all(want[k] == v for k, v in got.items())
    assert {i for i in range(n) if want[i] != i or want.count(i) > 1} <= set(got)


def test_hex_of_negative(spark):
    row = spark.createDataFrame([(-1,), (0,)], "x long").select(simhash.hex64(F.col("x"))).collect()
    assert [r[0] for r in row] == ["f" * 16, "0" * 16]
    assert unsigned([-1])[0] == 2**64 - 1
