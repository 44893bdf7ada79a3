"""Search for many probes against all pairs."""

import numpy as np
import pytest

from barloom.operators import memory


def brute(store, probes, k):
    out = {}
    for i, q in probes:
        if q is None or not any(q):
            continue
        near = sorted((1 - np.dot(q, x) / np.sqrt(np.dot(q, q) * np.dot(x, x)), j) for j, x in store if x is not None and any(x))
        out[i] = near[:k]
    return out


def check(spark, store, probes, k):
    schema = "id long, embedding array<double>"
    placed, regions = memory.pivot_store(spark.createDataFrame(store, schema))
    found, reads = memory.similar_batch(placed, regions, spark.createDataFrame(probes, schema), k)
    want = brute(store, probes, k)
    got = {}
    for r in found.orderBy("probe", "rank").collect():
        got.setdefault(r["probe"], []).append((r["distance"], r["id"]))
    assert set(got) == {i for i in want if want[i]}
    for i, near in got.items():
        assert [d for d, _ in near] == pytest.approx([d for d, _ in want[i]], abs=1e-12)
    return reads.collect(), {i: [j for _, j in n] for i, n in got.items()}, {i: [j for _, j in n] for i, n in want.items()}


def test_clusters_are_pruned(spark, monkeypatch):
    monkeypatch.setattr(memory, "REGION_ROWS", 50)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 4
    store = [(i, (centres[i % 20] + rng.normal(size=16) * 0.2).tolist()) for i in range(1500)]
    probes = [(i, (centres[i % 20] + rng.normal(size=16) * 0.2).tolist()) for i in range(40)]
    reads, got, want = check(spark, store, probes, 5)
    assert got == want
    share = np.mean([r["regions_read"] / r["regions"] for r in reads])
    assert len(reads) == 40 and reads[0]["regions"] > 15 and share < 0.25


def test_a_hot_region_is_dealt_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(memory, "REGION_ROWS", 40)
    rng = np.random.default_rng(4)
    store = [(i, [1.0, 0.0, 0.0] if i % 2 else rng.normal(size=3).tolist()) for i in range(400)]
    placed, regions = memory.pivot_store(spark.createDataFrame(store, "id long, embedding array<double>"))
    assert regions.chunks.max() >= 4
    assert placed.groupBy("region", "chunk").count().agg({"count": "max"}).first()[0] < 100
    reads, got, want = check(spark, store, [(1, [1.0, 0.0, 0.0]), (2, [-1.0, 0.2, 0.1])], 7)
    assert got == want  # ties go by id


def test_odd_rows_and_small_stores(spark):
    store = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [0.0, 2.0]), (6, [float("nan"), 1.0])]
    reads, got, want = check(spark, [r for r in store if r[0] not in (4, 6)], [(9, [1.0, 1.0]), (10, [0.0, 0.0]), (11, None)], 5)
    assert got == want == {9: [1, 5]} and [r["probe"] for r in reads] == [9]
    placed, _ = memory.pivot_store(spark.createDataFrame(store, "id long, embedding array<double>"))
    assert sorted(r["id"] for r in placed.collect()) == [1, 5]
    none, regions = memory.pivot_store(spark.createDataFrame([], "id long, embedding array<double>"))
    found, reads = memory.similar_batch(none, regions, spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>"))
    assert found.count() == 0 and reads.first()["regions"] == 0


def test_many_probes_are_dealt_and_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(memory, "REGION_ROWS", 50)
    monkeypatch.setattr(memory, "PROBE_ROWS", 16)
    monkeypatch.setattr(memory, "PROBE_BLOCK", 3)
    rng = np.random.default_rng(5)
    store = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    reads, got, want = check(spark, store, [(i, rng.normal(size=4).tolist()) for i in range(70)], 5)
    assert len(reads) == 70 and got == want
