"""Near-duplicates at a given share of common five-word shingles: fingerprints find the pairs, exact Jaccard similarity decides.

SimHash fingerprints of the shingles go through the vantage-point tree at the
radius it can prune; pairs at the least similarity differ in some ten of 64 bits, where
no such tree prunes, so bands of MinHash values propose the others (a pair at the least similarity
shares no band about once in 300 000). Texts of a band's bucket are compared with its
first one; what a bucket then still holds in several classes is dealt into chunks,
and a task compares two chunks on an index of their shingles. Tasks return one link
per text, never pairs, and a set of shingles is sent once per chunk pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import simhash
from barloom.llm.common import components, join_labels, stored

SHINGLE, SIMILAR, RADIUS = 5, 0.8, 2
BANDS, ROWS = 24, 4
CHUNK_ROWS = 4_096
_FACTORS, _SHIFTS = (np.array([[xxhash.xxh64_intdigest(f"{kind}{i}") | 1] for i in range(BANDS * ROWS)], np.uint64) for kind in ("factor", "shift"))


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; words as in ``simhash``, fewer than a shingle make one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) > shingle else [words]
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(g, 42) for g in map(b" ".join, grams)]), ">u8").astype(np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """A key for each band of smallest hashes; a text without words has those of its empty set."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(found), 1024):
        least = np.minimum(least, (_FACTORS * found[i : i + 1024] + _SHIFTS).min(1))
    return [int.from_bytes(xxhash.xxh64_digest(b.tobytes(), k), "big", signed=True) for k, b in enumerate(least.reshape(BANDS, ROWS))]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of distinct values; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def classes(sets: list[np.ndarray], labels: np.ndarray, side: np.ndarray, same: bool, least: float) -> np.ndarray:
    """Labels after all similar pairs of sets are joined: of any two, or (not ``same``) of one of ``side`` and one that is not.

    An index from shingles to sets gives the common shingles of one set with all others at once.
    """
    sizes = np.array([len(s) for s in sets])
    token, of = np.unique(np.concatenate(sets), return_inverse=True) if len(sets) else (np.empty(0), np.empty(0, np.int64))
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(of, kind="stable")
    held, start = owner[order], np.r_[0, np.cumsum(np.bincount(of, minlength=len(token)))]
    ends = np.cumsum(sizes)
    for i in np.flatnonzero(side):
        mine = of[ends[i] - sizes[i] : ends[i]]
        many = start[mine + 1] - start[mine]
        at = np.repeat(start[mine] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()) if len(mine) else np.empty(0, np.int64)
        both = np.bincount(held[at], minlength=len(sets))
        union = sizes + sizes[i] - both
        near = np.where(union > 0, both / np.maximum(union, 1), 1.0) >= least
        near &= labels != labels[i]
        if not same:
            near &= ~side
        js = np.flatnonzero(near)
        if len(js):
            labels = join_labels(labels, np.full(len(js), i), js)
    return labels


def compare(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """(a, b) links of a group of one bucket: rows (node, part, one, two, chunk, s) of two chunks, or of one."""
    if pdf["part"].nunique() < 2:
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    first = np.unique(pdf["part"].to_numpy(), return_index=True, return_inverse=True)
    labels = first[1][first[2]]
    same = pdf["one"].iloc[0] == pdf["two"].iloc[0]
    found = classes([np.asarray(s, np.int64) for s in pdf["s"]], labels.copy(), (pdf["chunk"] == pdf["one"]).to_numpy(), bool(same), least)
    at = np.flatnonzero(found != labels)
    node = pdf["node"].to_numpy()
    return pd.DataFrame({"a": node[at], "b": node[found[at]]})


def near_links(texts: DataFrame, least: float = SIMILAR, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(a, b) links that connect the nodes of ``texts`` (node, text; equal texts have one node) as all similar pairs would."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingles(t) for t in b["text"]]
            keys = np.array([bands(s) for s in found], np.int64).reshape(-1)
            yield pd.DataFrame({"node": np.repeat(b["node"].to_numpy(), BANDS), "n": np.repeat([len(s) for s in found], BANDS), "key": keys})

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            near = [similarity(x, y) >= least for x, y in zip(b["s"], b["t"])]
            yield b.loc[near, ["a", "b"]]

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "s": [shingles(t).view(np.int64) for t in b["text"]]})

    raw = texts.select("node", F.col("text").cast("binary").alias("text"))
    prints = stored(texts.select("node", simhash.fingerprint(F.col("text"), SHINGLE).alias("fp")))
    alike = prints.groupBy("fp").agg(F.min("node").alias("node"))
    routed = simhash.near_links(alike, RADIUS).unionByName(prints.join(alike.withColumnRenamed("node", "b"), "fp").select(F.col("node").alias("a"), "b"))
    keys = stored(raw.mapInPandas(keyed, "node long, n int, key long"))
    heads = keys.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"), F.max("node").alias("last")).where("first.node < last")
    heads = stored(heads.select("key", F.col("first.node").alias("head"), F.col("first.n").alias("head_n")))
    met = stored(keys.join(heads, "key").select("key", "node", "head", F.least("n", "head_n").alias("low"), F.greatest("n", "head_n").alias("high")).distinct())
    routed = stored(routed.where("a != b").distinct())
    asked = met.select("node").unionByName(routed.select(F.explode(F.array("a", "b")).alias("node"))).distinct()  # also holds the heads
    held = stored(raw.join(asked, "node", "left_semi").dropDuplicates(["node"]).mapInPandas(sets, "node long, s array<long>"))

    # sets whose sizes differ by more cannot be similar; so a long first one is never sent to short ones
    pairs = met.where((F.col("node") != F.col("head")) & (F.col("low") >= least * F.col("high") - 1)).select(F.col("node").alias("a"), F.col("head").alias("b"))
    pairs = pairs.unionByName(routed).distinct()
    both = pairs.join(held.withColumnRenamed("node", "a"), "a").join(held.select(F.col("node").alias("b"), F.col("s").alias("t")), "b")
    near = stored(both.select("a", "b", "s", "t").mapInPandas(measured, "a long, b long"))

    part = met.join(stored(components(near)), "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    split = part.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
    rest = stored(part.join(split.where("low < high").select("key", "chunks"), "key"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = rest.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.join(held, "node").select("key", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "chunk", "node", "part", "s")
    return near.unionByName(dealt.groupBy("key", "one", "two").applyInPandas(lambda pdf: compare(pdf, least), "a long, b long"))


def deduplicated(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """One row of each group of near-duplicates of ``docs`` (doc_id, text): the one with the least doc_id (rows without come last), then text hash.

    A group is what similar pairs connect; null texts count as empty, and texts
    without words are alike. Repeated rows leave one; other columns come along, whatever their names.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    wide = docs.toDF(*names).withColumn("_node", F.xxhash64(F.coalesce(text, F.lit(""))))
    texts = wide.select(F.col("_node").alias("node"), F.coalesce(text, F.lit("")).alias("text"))
    found = components(near_links(texts, least))
    rows = wide.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("_node").alias("node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "node")).alias("first")
    heads = rows.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(first)
    heads = heads.select(F.col("first.doc_id").alias("_id"), F.col("first.node").alias("_head"))
    kept = wide.join(heads, (F.col("_node") == F.col("_head")) & F.col(doc_id).cast("long").eqNullSafe(F.col("_id")), "left_semi")
    return kept.dropDuplicates([doc_id, "_node"]).select(*names).toDF(*docs.columns)
