"""SimHash near-duplicates: word-shingle fingerprints linked through a vantage-point tree.

The tree is built from a bounded sample and only decides where work goes, never
what is found: a fingerprint has one home shard, and visits every other shard
whose region its ball overlaps by the triangle bounds. Within a shard the same
splits go on, down to blocks that are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from barloom.llm.common import components, join_labels, stored

SHINGLE, RADIUS = 3, 2
SAMPLE, MAX_LEAVES, LEAF_ROWS, CHUNK_ROWS = 16_384, 2_048, 2_048, 32_768
BLOCK = 1 << 21  # fingerprint pairs compared at a time


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the XXH64 (seed 42) of all word shingles; 0 without words.

    A-Z are lower-cased; words are split at ASCII white space, shingles joined by
    one space, repeats counted; fewer words than a shingle make one shingle.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) > shingle else [words]
    raw = b"".join([digest(g, 42) for g in map(b" ".join, grams)])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64)
    whole = len(bits) // 255 * 255
    ones = bits[whole:].sum(0, dtype=np.int64)
    if whole:
        ones += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(bits)).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """SimHash of a string column as a long; null and empty texts give 0."""

    @pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return hashed(text.cast("binary"))


def hex64(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def vantage(points: np.ndarray, radius: int, tries: int = 8) -> tuple[np.uint64, int, float]:
    """Pivot and threshold that keep both sides large and few points within ``radius`` of the border."""
    best = (points[0], 0, 9.0)
    for p in points[:: max(1, len(points) // tries)][:tries]:
        d = distance(points, p)
        at = np.bincount(d, minlength=65).cumsum() / len(points)
        for mu in range(64):
            if 0.25 <= at[mu] <= 0.75:
                border = at[min(64, mu + radius)] - at[max(0, mu - radius)]
                cost = border + abs(at[mu] - 0.5)
                if cost < best[2]:
                    best = (p, mu, cost)
    return best


@dataclass
class Tree:
    """Inner nodes: pivot, threshold and the next node on either side; leaf k is written as -k - 1."""

    pivots: list
    limits: list
    inner: list
    outer: list
    leaves: int

    @classmethod
    def grown(cls, sample: np.ndarray, leaves: int, radius: int) -> Tree:
        tree = cls([], [], [], [], 0)

        def grow(points: np.ndarray, wanted: int) -> int:
            pivot, mu, cost = vantage(points, radius) if wanted > 1 and len(points) >= 8 else (None, 0, 9.0)
            if cost >= 1.4:
                tree.leaves += 1
                return -tree.leaves
            d, node = distance(points, pivot), len(tree.pivots)
            for part, value in ((tree.pivots, pivot), (tree.limits, mu), (tree.inner, 0), (tree.outer, 0)):
                part.append(value)
            tree.inner[node] = grow(points[d <= mu], wanted // 2)
            tree.outer[node] = grow(points[d > mu], wanted - wanted // 2)
            return node

        grow(sample, leaves)
        return tree

    def routes(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the point, leaf, whether the leaf is its home), each home once."""
        out, todo = [], [(0 if self.pivots else -1, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node < 0:
                out.append((at, np.full(len(at), -node - 1, np.int32), home))
                continue
            d, mu = distance(points[at], self.pivots[node]), self.limits[node]
            # a home point goes to its side; near the border it visits the outer side, where such a pair is found once
            inside = np.where(home, d <= mu, d - radius <= mu)
            outside = np.where(home, d > mu - radius, d + radius > mu)
            todo.append((self.inner[node], at[inside], home[inside]))
            todo.append((self.outer[node], at[outside], (home & (d > mu))[outside]))
        return tuple(np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out) if out else ((), (), ())))


def linked(points: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """Class labels of the points of one shard: pairs of which one at least is at home are linked."""
    labels = np.arange(len(points))
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        h, v = todo.pop()
        if not len(h):
            continue
        both = np.concatenate([h, v])
        work = len(h) * len(both)
        if work > 4 * BLOCK:
            pivot, mu, cost = vantage(points[h[:2048]], radius)
            d, e = distance(points[h], pivot), distance(points[v], pivot)
            inner, outer = h[d <= mu], h[d > mu]
            v_in, v_out = v[e - radius <= mu], np.concatenate([v[e + radius > mu], inner[d[d <= mu] > mu - radius]])
            if cost < 9 and len(inner) * (len(inner) + len(v_in)) + len(outer) * (len(outer) + len(v_out)) < 0.8 * work:
                todo += [(inner, v_in), (outer, v_out)]
                continue
        step = max(1, BLOCK // len(both))
        for i in range(0, len(h), step):
            rows, cols = np.nonzero(np.bitwise_count(points[h[i : i + step], None] ^ points[both][None, :]) <= radius)
            labels = join_labels(labels, h[i + rows], both[cols])
    return labels


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links that connect the nodes of ``prints`` (fp, node; fp distinct) as all pairs within ``radius`` would.

    A shard returns each linked node with one node of its class, never the pairs,
    so a group of any size stays linear. Shards above CHUNK_ROWS home rows are
    dealt over several tasks, each comparing its part with all the others.
    """
    total = prints.count()
    picked = prints.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = Tree.grown(picked, min(MAX_LEAVES, max(1, total // LEAF_ROWS)), radius) if len(picked) else Tree([], [], [], [], 1)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, leaf, home = tree.routes(b["fp"].to_numpy(np.int64).view(np.uint64), radius)
            for i in range(0, len(at), 200_000):
                part = slice(i, i + 200_000)
                yield pd.DataFrame({"leaf": leaf[part], "fp": b["fp"].to_numpy()[at[part]], "node": b["node"].to_numpy()[at[part]], "home": home[part]})

    routed = prints.mapInPandas(route, "leaf int, fp long, node long, home boolean")
    held = routed.where("home").groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks"))
    if total > CHUNK_ROWS:
        chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        routed = (
            routed.join(F.broadcast(held), "leaf")  # at most MAX_LEAVES rows
            .withColumn("_own", F.when(F.col("home"), chunk))
            .withColumn("chunk", F.explode(F.sequence(F.coalesce("_own", F.lit(0)), F.col("chunks") - 1)))
            .withColumn("home", F.col("home") & (F.col("chunk") == F.col("_own")))
        )
    else:
        routed = routed.withColumn("chunk", F.lit(0))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        node, labels = pdf["node"].to_numpy(), linked(pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["home"].to_numpy(bool), radius)
        at = np.flatnonzero(labels != np.arange(len(labels)))
        return pd.DataFrame({"a": node[at], "b": node[labels[at]]})

    return routed.select("leaf", "chunk", "fp", "node", "home").groupBy("leaf", "chunk").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs`` (doc_id, text).

    Equal fingerprints share a class; classes within ``radius`` bits are linked;
    the component is named by its smallest doc_id. A null or blank text has
    fingerprint zero and is linked like any other. A row without doc_id keeps its
    fingerprint and takes the component of its class; a class without any doc_id
    has a null component and no links. Repeated rows are returned as often.
    """
    prints = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text"), shingle).alias("fp")))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    named = stored(classes.where("node is not null"))
    found = components(near_links(named, radius))
    heads = (
        classes.join(found, "node", "left")
        .select("fp", F.coalesce("component", "node").alias("component_id"))
    )
    return prints.join(heads, "fp").select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents of ``docs`` that name their component; of rows with that id one stays, rows without id stay all."""
    heads = near_duplicates(docs, shingle, radius).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(heads, "doc_id", "left_semi")
    return kept.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))
