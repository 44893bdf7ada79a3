"""Hard negatives by a vertical scan: dimensions are read in each anchor's order of magnitude, bounds shrink the candidates.

After some dimensions, the rest of a score lies between sums of the remaining
smallest and largest contributions of the block. A row stays a candidate only
while these bounds leave it a place among the best (positives) or in a score
window (negatives). Rows and anchors are dealt into blocks of bounded size and
every pair of blocks is one task; what a task returns per anchor is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import small_side, stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # hundredths of the positive's score that a negative's score lies between
BLOCK_ROWS, ANCHOR_ROWS = 16_384, 4_096
STEP = 8  # dimensions between two looks at the bounds
WIDEST = 1 << 31  # a row's largest code times the square root of its length stays below this, so that no score leaves a long


def fit(rows: DataFrame, anchor: Column, label: Column) -> DataFrame:
    """(id, label, anchor, dims, codes) of the rows of ``rows`` (vec_id, embedding, label) that take part, each different row once."""
    wide = rows.select(
        F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.col("embedding").cast("array<double>").alias("x"),
    )
    whole = F.size("x") > 0
    whole &= F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    narrow = F.array_max(F.transform("x", lambda v: F.abs(v))) * SCALE + 1 < WIDEST / F.sqrt(F.size("x"))
    known = wide.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(whole, F.lit(False))).where(narrow)
    return known.select("id", "label", "anchor", F.size("x").alias("dims"), F.transform("x", lambda v: F.floor(v * SCALE)).alias("codes")).distinct()


class Block:
    """Rows of one block by columns, with the least and largest code of each dimension."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        order = np.lexsort((labels, ids))
        self.columns, self.ids, self.labels = np.ascontiguousarray(codes[order].T), ids[order], labels[order]
        self.low, self.high = self.columns.min(1), self.columns.max(1)

    def scan(self, anchor: np.ndarray, at: np.ndarray, narrowed: Callable) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the candidates ``at`` that ``narrowed(at, low, high)`` never rules out.

        ``low`` and ``high`` bound the scores; ``narrowed`` gives the mask of the rows that stay.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        one, two = anchor * self.low, anchor * self.high
        least, most = (np.append(np.cumsum(f(one, two)[order][::-1])[::-1], 0) for f in (np.minimum, np.maximum))
        score = np.zeros(len(at), np.int64)
        for k in range(0, len(order), STEP):
            for d in order[k : k + STEP]:
                if anchor[d]:
                    score += anchor[d] * (self.columns[d] if len(at) == len(self.ids) else self.columns[d][at])
            rest = min(k + STEP, len(order))
            stay = narrowed(at, score + least[rest], score + most[rest])
            if not stay.all():
                at, score = at[stay], score[stay]
            if not len(at):
                break
        return at, score


def best(count: int) -> Callable:
    """Rows whose upper bound reaches the ``count``-th largest lower bound."""

    def narrowed(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if len(low) <= count:
            return np.ones(len(low), bool)
        return high >= np.partition(low, len(low) - count)[len(low) - count]

    return narrowed


def within(windows: list[tuple[int, int]], count: int) -> Callable:
    """Rows that may still be among the ``count`` best of some window (least, largest score)."""

    def narrowed(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(low), bool)
        for least, most in windows:
            open_ = (high >= least) & (low <= most)
            sure = low[(low >= least) & (high <= most)]
            if len(sure) > count:  # so many lie within for sure: a row below the last of them is out
                open_ &= high >= np.partition(sure, len(sure) - count)[len(sure) - count]
            stay |= open_
        return stay

    return narrowed


def ranked(ids: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` by score, then id."""
    return np.lexsort((ids, -scores))[:count]


def block_of(rows: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = rows.combine_chunks()
    codes = rows["codes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
    return codes, rows["id"].to_numpy(), rows["label"].to_numpy()


def find_positives(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """The POSITIVES best rows of one block that share an anchor's label, for each anchor of one block."""
    out: list[list] = [[], [], [], []]
    if anchors.num_rows and rows.num_rows:
        dims = key[0].as_py()
        block = Block(*block_of(rows, dims))
        for code, id_, label in zip(*block_of(anchors, dims)):
            own = (block.ids == id_) & (block.labels == label)
            own[own] = (block.columns[:, own] == code[:, None]).all(0)
            at, score = block.scan(code, np.flatnonzero((block.labels == label) & ~own), best(POSITIVES))
            take = ranked(block.ids[at], score, POSITIVES)
            for values, more in zip(out, ([id_] * len(take), [label] * len(take), block.ids[at[take]].tolist(), score[take].tolist())):
                values += more
    return pa.table(dict(zip(("id", "label", "other", "score"), (pa.array(v, pa.int64()) for v in out))))


def find_negatives(key: tuple, anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """For each anchor and positive of one block, the NEGATIVES best rows of one block with another label and a score in the window."""
    out: list[list] = [[], [], [], [], []]
    if anchors.num_rows and rows.num_rows:
        dims = key[0].as_py()
        block, told = Block(*block_of(rows, dims)), anchors.combine_chunks()["positives"].to_pylist()
        for (code, id_, label), positives in zip(zip(*block_of(anchors, dims)), told):
            windows = [(-(-LOW * p["score"] // 100), HIGH * p["score"] // 100) for p in positives]
            at, score = block.scan(code, np.flatnonzero(block.labels != label), within([w for w in windows if w[0] <= w[1]], NEGATIVES))
            for p, (least, most) in zip(positives, windows):
                fits = np.flatnonzero((score >= least) & (score <= most))
                take = fits[ranked(block.ids[at[fits]], score[fits], NEGATIVES)]
                for values, more in zip(out, ([id_] * len(take), [p["id"]] * len(take), [p["score"]] * len(take), block.ids[at[take]].tolist(), score[take].tolist())):
                    values += more
    return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"), (pa.array(v, pa.int64()) for v in out))))


def met(anchors: DataFrame, rows: DataFrame, search: Callable, schema: str, block_rows: int, anchor_rows: int) -> DataFrame:
    """``search`` for every block of ``anchors`` with every block of ``rows``; vectors of unequal length do not meet."""
    row_blocks, anchor_blocks = (max(1, -(-df.count() // most)) for df, most in ((rows, block_rows), (anchors, anchor_rows)))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64("id", "codes"), F.lit(blocks)).cast("int").alias(own)
        return df.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    keys = ("dims", "anchor_block", "row_block")
    left = dealt(anchors, "anchor_block", anchor_blocks, "row_block", row_blocks)
    right = dealt(rows.select("id", "label", "dims", "codes"), "row_block", row_blocks, "anchor_block", anchor_blocks)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema)


def hard_negatives(rows: DataFrame, anchor: Column, label: Column | None = None, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (vec_id, embedding, label).

    ``anchor`` says which rows are anchors, ``label`` (default: the column) gives
    the label. Rows with a null id, label, vector or component or a non-finite
    component take no part; neither do those whose codes are so large that a score might
    leave a long. Rows that equal in id, label and vector count once; a positive is any
    other row. An anchor without positives, and a pair whose window is empty, give no row.
    Ties go to the smaller vec_id.
    """
    held = stored(fit(rows, anchor, F.col("label") if label is None else label))
    anchors = held.where("anchor").select("id", "label", "dims", "codes")
    found = met(anchors, held, find_positives, "id long, label long, other long, score long", block_rows, anchor_rows)
    first = Window.partitionBy("id", "label").orderBy(F.desc("score"), "other")
    found = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= POSITIVES)
    found = found.groupBy("id", "label").agg(F.collect_list(F.struct(F.col("other").alias("id"), "score")).alias("positives"))  # POSITIVES at most
    asked = stored(anchors.join(found, ["id", "label"]))
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    pairs = met(asked, held, find_negatives, schema, block_rows, anchor_rows)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranks = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    return ranks.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor, a.label = b.label AS same, b.id AS other,
         CAST(list_sum(list_transform(range(1, len(a.c) + 1), lambda i: a.c[i] * b.c[i])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.id <> b.id AND len(a.c) = len(b.c) WHERE a.id % 100 = 0
), p AS (
  SELECT anchor, other AS positive, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5
)
SELECT p.anchor AS anchor_id, p.positive AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.other)
QUALIFY row_number() OVER w <= 10
"""
