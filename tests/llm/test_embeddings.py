import numpy as np
import pytest

from barloom.llm import embeddings
from tests.llm.helpers import smallest_reachable


def brute(vectors, threshold=0.9):
    """(n_links, component by place) with cosine in double precision."""
    unit = np.array([v / np.sqrt((v * v).sum()) for v in vectors])
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    return near.sum(1), smallest_reachable(len(vectors), np.argwhere(near))


def planted(n, dims, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, dims))
    near = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, dims)) * rng.choice([0.05, 0.3, 0.45, 0.5, 2], (n, 1))
    near[: n // 10] = near[0] + rng.normal(size=(n // 10, dims)) * 0.02  # a large group
    near[n // 10 : n // 8] = near[n // 10]  # equal ones
    return near.astype(np.float32)


@pytest.mark.parametrize("dims,block", [(64, 8192), (64, 150), (3, 100), (1500, 200)])
def test_links_and_components_match_all_pairs(spark, dims, block):
    v = planted(700, dims, dims)
    links, comp = brute(v.astype(np.float64))
    assert links.max() > 60 and (links == 0).sum() > 0 or dims == 3
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, block_rows=block).collect()}
    assert [got[i]["n_links"] for i in range(len(v))] == list(links)
    assert [got[i]["component_id"] for i in range(len(v))] == comp
    assert all(got[i]["kept"] == (comp[i] == i) for i in range(len(v)))


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = sorted(df.collect(), key=lambda r: r["vec_id"])
    links, comp = brute([np.array(r["embedding"], np.float64) for r in rows])
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    assert [(got[r["vec_id"]]["n_links"], got[r["vec_id"]]["component_id"]) for r in rows] == [(n, rows[c]["vec_id"]) for n, c in zip(links, comp)]


def test_bound_never_loses_a_pair_at_the_threshold():
    rng = np.random.default_rng(0)
    for dims in (2, 64, 2000):
        a = rng.normal(size=(300, dims))
        a /= np.sqrt((a * a).sum(1, keepdims=True))
        b = rng.normal(size=a.shape)
        b -= (a * b).sum(1, keepdims=True) * a
        b /= np.sqrt((b * b).sum(1, keepdims=True))
        c = 0.9 * a + np.sqrt(1 - 0.81) * b  # cosine 0.9 but for rounding
        x, y = embeddings.Vectors(a, np.arange(300), np.ones(300)), embeddings.Vectors(c, np.arange(300), np.ones(300))
        found = {(int(x.node[i]), int(y.node[j])) for s, *_ in x.tiles for t, *_ in y.tiles for i, j in zip(*embeddings.tile_pairs(x, y, s, t, 0.9 - 1e-9))}
        assert {(i, i) for i in range(300)} <= found


def test_edge_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, nan]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1e-30, 1e-33]), (11, [-0.0, -5.0]), (12, [0.0, -5.0])]
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "vec_id long, embedding array<double>, node string, vector string")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in embeddings.near_duplicates(df).collect())
    alone = [(str(i), 0, str(i), True) for i in (3, 4, 5, 6, 7, 8, 9)]
    assert got == sorted([*alone, ("1", 2, "1", True), ("2", 2, "1", False), ("2", 2, "1", False), ("10", 2, "1", False), ("11", 1, "11", True), ("12", 1, "11", False), ("None", 0, "None", False)])
    assert embeddings.near_duplicates(df.where("false")).count() == 0
