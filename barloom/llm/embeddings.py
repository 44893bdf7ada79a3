"""Embedding near-duplicates: int8 tile products, error bounds per vector, full precision where a pair may pass.

Vectors are dealt into blocks of bounded size; a task gets two blocks and
compares them tile by tile. All pairs of blocks are covered: no index decides
what is found. Tiles whose angular bounds exclude the threshold are skipped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import components, join_labels, stored

THRESHOLD = 0.9
BLOCK_ROWS, TILE_ROWS, PIVOTS = 8_192, 512, 32
EXACT_DIMS = 1_024  # 127 * 127 * 1024 is below 2^24, so a float32 product of int8 values is exact


class Vectors:
    """Unit vectors of one block in tile order, their int8 codes, and the error of each code."""

    def __init__(self, rows: np.ndarray, node: np.ndarray, weight: np.ndarray):
        scaled = rows / np.abs(rows).max(1, keepdims=True)
        self.norm = np.sqrt((scaled * scaled).sum(1))
        unit = scaled / self.norm[:, None]
        pivots = unit[:: max(1, len(unit) // PIVOTS)][:PIVOTS]
        order = np.argsort((unit.astype(np.float32) @ pivots.astype(np.float32).T).argmax(1), kind="stable")
        self.scaled, self.norm, unit = scaled[order], self.norm[order], unit[order]
        self.node, self.weight = node[order], weight[order]
        self.step = np.abs(unit).max(1) / 127.0
        codes = np.rint(unit / self.step[:, None]).astype(np.int8)
        self.error = np.sqrt(((unit - codes * self.step[:, None]) ** 2).sum(1)) + 1e-9
        self.codes = codes.astype(np.float32)
        self.tiles = []
        for i in range(0, len(unit), TILE_ROWS):
            part = unit[i : i + TILE_ROWS]
            mean = part.sum(0)
            size = np.sqrt((mean * mean).sum())
            if size == 0:
                mean, spread = part[0], np.pi
            else:
                mean = mean / size
                spread = np.arccos(np.clip((part @ mean).min(), -1, 1))
            self.tiles.append((slice(i, i + len(part)), mean, spread))


def tile_pairs(a: Vectors, b: Vectors, s: slice, t: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two tiles at or above the threshold, by their place in ``a`` and ``b``.

    With unit vectors u = c + e (c: code times step), |u.v - c.d| <= |e| + (1 + |e|)|f|;
    a pair below the threshold by more than that is out, any other is computed in double precision.
    """
    p, q = a.codes[s], b.codes[t]
    if p.shape[1] <= EXACT_DIMS:
        dot = p @ q.T
    else:
        dot = sum(p[:, k : k + EXACT_DIMS].astype(np.float64) @ q[:, k : k + EXACT_DIMS].T for k in range(0, p.shape[1], EXACT_DIMS))
    dot *= b.step[t].astype(dot.dtype)
    worst = b.error[t].max()
    least = (threshold - a.error[s] - (1 + a.error[s]) * worst - 1e-5) / a.step[s]
    i, j = np.nonzero(dot >= least.astype(dot.dtype)[:, None])
    i, j = i + s.start, j + t.start
    good = np.empty(len(i), bool)
    for k in range(0, len(i), 65_536):
        x, y = i[k : k + 65_536], j[k : k + 65_536]
        good[k : k + 65_536] = np.einsum("ij,ij->i", a.scaled[x], b.scaled[y]) / (a.norm[x] * b.norm[y]) >= threshold
    return i[good], j[good]


def compare(a: Vectors, b: Vectors | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links found, a node of its class) for all vectors with links, within ``a`` or between ``a`` and ``b``."""
    same = b is None
    b = a if same else b
    size, reach = len(a.node), np.arccos(threshold) + 1e-6
    links = np.zeros(size if same else size + len(b.node), np.int64)
    labels, shift = np.arange(len(links)), 0 if same else size
    for m, (s, mean, spread) in enumerate(a.tiles):
        for t, other, width in b.tiles[m if same else 0 :]:
            if np.arccos(np.clip(mean @ other, -1, 1)) - spread - width > reach:
                continue
            i, j = tile_pairs(a, b, s, t, threshold)
            if same and s == t:
                i, j = i[i < j], j[i < j]
            links += np.bincount(i, b.weight[j], len(links)).astype(np.int64) + np.bincount(j + shift, a.weight[i], len(links)).astype(np.int64)
            labels = join_labels(labels, i, j + shift)
    node = a.node if same else np.concatenate([a.node, b.node])
    at = np.flatnonzero(links)
    return node[at], links[at], node[labels[at]]


def near_links(vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, links, other) for distinct ``vectors`` (node, copies, vector): partial counts and connecting links."""
    blocks = max(1, -(-vectors.count() // block_rows))
    dealt = (
        vectors.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"))
        .withColumn("_with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select(
            F.size("vector").alias("dims"), F.least("block", "_with").alias("one"), F.greatest("block", "_with").alias("two"),
            "block", "node", "copies", "vector",
        )
    )

    def search(key: tuple, rows: pa.Table) -> pa.Table:
        dims, one, two = (k.as_py() for k in key)
        rows = rows.combine_chunks()
        flat = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        block, node, copies = (rows[c].to_numpy() for c in ("block", "node", "copies"))
        sides = [Vectors(flat[block == k], node[block == k], copies[block == k]) for k in {one, two} if (block == k).any()]
        if not sides or (one != two and len(sides) < 2):
            found = (np.empty(0, np.int64),) * 3
        else:
            found = compare(sides[0], sides[1] if one != two else None, threshold)
        return pa.table({"node": found[0].astype(np.int64), "links": found[1].astype(np.int64), "other": found[2].astype(np.int64)})

    return dealt.groupBy("dims", "one", "two").applyInArrow(search, "node long, links long, other long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``rows`` (vec_id, embedding).

    Links join vectors of equal length with cosine >= ``threshold`` in double
    precision; equal vectors are one class whose members are all linked. A vector
    that is null, empty, zero or holds a null or non-finite component has no link
    and is its own component. A row without vec_id is returned without component
    and counts for nobody; a repeated row counts once.
    """
    wide = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fit = F.size("vector") > 0
    fit &= F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    wide = stored(wide.select("vec_id", F.when(F.coalesce(fit, F.lit(False)) & F.col("vec_id").isNotNull(), F.transform("vector", lambda x: x + 0.0)).alias("vector")))
    members = wide.where("vector is not null").distinct()
    classes = stored(members.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    found = stored(near_links(classes.select("node", "copies", "vector"), threshold, block_rows))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    heads = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    classes = (
        classes.join(links, "node", "left").join(heads, "node", "left")
        .select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    linked = wide.join(classes, "vector", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return linked.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
