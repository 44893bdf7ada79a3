"""Mixing sources to target weights by hash thresholds: histograms per source and hash bucket, no sort, no Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import WORD, numbered, small_side, stored

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
HASH_BITS, LEVEL_BITS = 60, 12


def size_of(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column) -> Column:
    """60 bits of the md5 of the id as text (null: of the empty text): the same on every run and for every copy of a row."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), place(F.col("doc_id")).alias("place"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of ``sizes`` (source, size).

    Sources in code-point order, null last, take the weights in turn and share
    ``share`` times all sizes; a source gets ``most`` times its size at most, and
    what is over goes to the others by weight. Only sums reach the driver.
    """
    totals = stored(numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source"))
    turn = F.array(*[F.lit(w) for w in weights])
    totals = totals.select("source", "source_size", turn[(F.col("number") % len(weights)).cast("int")].alias("weight"))
    budget = share * (totals.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        capped = F.lit(level) * F.col("weight") > most * F.col("source_size")
        s = totals.agg(
            F.sum(F.when(capped, most * F.col("source_size"))).alias("given"), F.sum(F.when(~capped, F.col("weight"))).alias("open"),
            F.count(F.when(capped, 1)).alias("full"),
        ).first()
        if s["open"] is None or s["full"] == full:
            break
        level, full = (budget - (s["given"] or 0)) / s["open"], s["full"]
    target = F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return totals.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, below): a document is taken ``whole`` times, and once more if its place is under ``below``.

    ``sizes``: (source, size, place). Per source, word counts are summed by hash
    bucket; the bucket in which the running sum passes the budget is split again,
    until it holds a single place. That place is taken if this comes nearer to the
    budget. Thresholds of growing budgets are nested, so a smaller mix is part of
    a larger one.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = stored(goals.select("source", "source_size", "target", whole.alias("whole")).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))
    edge = goals.select("source", "budget")
    shift, inside = HASH_BITS, sizes.select("source", "size", "place")
    while True:
        shift -= LEVEL_BITS
        bucket = F.shiftrightunsigned("place", shift)
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.min("place").alias("lo"), F.max("place").alias("hi"))
        running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("size").over(running)).withColumnRenamed("source", "_source")
        # the first bucket that passes the budget; without one, everything is taken
        passed = (
            edge.select("source", "budget").join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("upto") > F.col("budget")))
            .groupBy("source", "budget").agg(F.min_by(F.struct("bucket", "size", "lo", "hi", "upto"), "bucket").alias("b"))
            .select("source", (F.col("budget") - F.col("b.upto") + F.col("b.size")).alias("budget"), "b.bucket", "b.size", "b.lo", "b.hi")
        )
        edge = stored(passed)
        if shift == 0 or edge.where("lo < hi").isEmpty():
            break
        part = edge.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"))
        inside = inside.join(part, F.col("source").eqNullSafe(F.col("_source")) & (bucket == F.col("_bucket")), "left_semi")
    near = F.when(F.col("size") - F.col("budget") <= F.col("budget"), F.col("lo") + 1).otherwise(F.col("lo"))
    edge = edge.select(F.col("source").alias("_source"), near.alias("below"))
    return (
        goals.join(edge, F.col("source").eqNullSafe(F.col("_source")), "left")
        .select("source", "source_size", "target", "whole", F.coalesce("below", F.when(F.col("budget") > 0, F.lit(1 << HASH_BITS)).otherwise(F.lit(0))).alias("below"))
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of ``docs`` (doc_id, text, source).

    ``taken`` counts the words the mix takes of a document, repeats counted: whole
    copies, ``most`` at most. A null source is a source of its own; null and blank
    texts have size 0; rows with one doc_id are taken together. Reruns agree.
    """
    sizes = stored(sized(docs))
    bounds = stored(thresholds(sizes, targets(sizes, weights, share, most)).withColumnRenamed("source", "_source"))
    return sizes.join(small_side(bounds), F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"),
    )


def copies() -> Column:
    return F.col("whole") + (F.col("place") < F.col("below")).cast("long")


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its columns. Texts are not shuffled while the sources fit a broadcast."""
    sizes = stored(sized(docs))
    bounds = stored(thresholds(sizes, targets(sizes, weights, share, most)).select(F.col("source").alias("_source"), "whole", "below"))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    wide = docs.toDF(*names)
    source, doc_id = names[docs.columns.index("source")], names[docs.columns.index("doc_id")]
    held = wide.withColumn("place", place(F.col(doc_id))).join(small_side(bounds), F.col(source).cast("string").eqNullSafe(F.col("_source")))
    return held.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies().cast("int")))).select(*names).toDF(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS place
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s
), o AS (
  SELECT *, coalesce(sum(2 * source_size) OVER p, 0) AS given, sum(weight) OVER r AS open
  FROM w WINDOW p AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                r AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), l AS (
  SELECT (1.5 * (SELECT sum(source_size) FROM s) - given) / open AS level, 2.0 * source_size / weight AS cap FROM o
), f AS (
  SELECT arg_min(level, cap) AS level FROM l WHERE level <= cap
), t AS (
  SELECT source, source_size, CASE WHEN level * weight > 2 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE level * weight END AS target
  FROM w, f
), g AS (
  SELECT source, place, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY place) AS upto FROM d GROUP BY source, place
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), x AS (
  SELECT g.source, g.place, b.source_size, b.target, b.whole, g.size, g.upto, b.target - b.whole * b.source_size AS budget
  FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source
)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, x.source_size, x.target,
       CAST(d.size * (x.whole + CASE WHEN x.budget > 0 AND (x.upto <= x.budget OR (x.upto - x.size <= x.budget AND x.upto - x.budget <= x.budget - (x.upto - x.size)))
                                     THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.place = x.place
"""
