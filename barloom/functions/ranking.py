"""Exact ranks and row splits over whole tables without a single-task sort."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import cut_lineage

LEAST_RANGES = 16


def cut_points(df: DataFrame, *values: str, ranges: int | None = None) -> dict[str, tuple[list[float], list[float]]]:
    """Cut points of each column and, of them, the heavy values (those that fill a range by themselves), from one pass."""
    ranges = ranges or max(LEAST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / ranges for i in range(1, ranges)]
    found = df.agg(*[F.percentile_approx(v, probs, 1000).alias(v) for v in values]).first()
    cuts = {v: [float(c) for c in (found[v] or [])] for v in values}
    return {v: (sorted(set(c)), sorted({x for x in c if c.count(x) > 1})) for v, c in cuts.items()}


def _doubles(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(x) for x in values]) if values else F.array().cast("array<double>")


def slots(df: DataFrame, value: str, cuts: tuple[list[float], list[float]]) -> DataFrame:
    """Add ``_slot``, which rises with ``value``: twice the range, and one more for a heavy value, which is the last of its range."""
    edges, heavy = cuts
    v, step = F.col(value).cast("double"), max(1, math.isqrt(len(edges)))

    def below(some: Column) -> Column:
        return F.size(F.filter(some, lambda e: e < v))

    # whole steps of edges below the value are counted by their last one, so that a row is compared with about 2 sqrt(edges) of them
    steps = below(_doubles(edges[step - 1 :: step]))
    rest = below(F.slice(_doubles(edges), steps * step + 1, F.lit(step)))
    return df.withColumn("_slot", 2 * (steps * step + rest) + F.array_contains(_doubles(heavy), v).cast("int"))


def slot_offsets(slotted: DataFrame, by: Sequence[str], weight: Column) -> DataFrame:
    """(*by, _slot, _off, _in, _all): rows before the slot, in it, and in all; at most two rows a range and group."""
    sums = slotted.groupBy(*by, "_slot").agg(F.sum(weight).alias("_in"))
    w = Window.partitionBy(*by)
    before = w.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, "_slot", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_off"), "_in", F.sum("_in").over(w).alias("_all"))


def row_ranks(df: DataFrame, value: str, by: Sequence[str] = (), cuts: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """Rows of ``df`` with a ``value``, their average ``rank`` within ``by`` and the number ``total`` of rows that are ranked there.

    One exchange: rows are dealt by range and ranked inside, offsets come from
    counts. All rows of a heavy value have one rank, which the counts give, so they are not
    moved at all.
    """
    rows = df.where(F.col(value).isNotNull())
    rows = slots(rows, value, cuts or cut_points(rows, value)[value])
    told = rows.join(F.broadcast(slot_offsets(rows, by, F.lit(1))), [*by, "_slot"])
    heavy = told.where("_slot % 2 = 1").withColumn("rank", F.col("_off") + (F.col("_in") + 1) / 2.0)
    inside = Window.partitionBy(*by, "_slot").orderBy(value)
    ties = F.count("*").over(inside.rangeBetween(0, 0))
    light = told.where("_slot % 2 = 0").withColumn("rank", F.col("_off") + F.rank().over(inside) + (ties - 1) / 2.0)
    return light.unionByName(heavy).select(*df.columns, "rank", F.col("_all").alias("total"))


def value_ranks(counts: DataFrame, value: str, n: str, by: Sequence[str] = (), cuts: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """``counts`` (one row per *by and value, standing for ``n`` rows) with the average ``rank`` of each value; one exchange, besides that of the counts."""
    ranged = slots(counts, value, cuts or cut_points(counts, value)[value])
    inside = Window.partitionBy(*by, "_slot").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("_cum", F.sum(n).over(inside))
        .join(F.broadcast(slot_offsets(ranged, by, F.col(n))), [*by, "_slot"])
        .withColumn("rank", F.col("_off") + F.col("_cum") - (F.col(n) - 1) / 2.0)
        .select(*counts.columns, "rank")
    )


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), extra: dict[str, Column] | None = None, weight: str | None = None) -> DataFrame:
    """(*by, value, n, rank, *extra): distinct values with count and average rank.

    Ties collapse to one row first (map-side), then ranks are a running count:
    totals per value range give each range its offset, the running count inside a
    range gives the rest. ``extra`` adds aggregates per distinct value, ``weight``
    is how many rows a row stands for.
    """
    aggs = [(F.sum(weight) if weight else F.count("*")).alias("n")] + [c.alias(name) for name, c in (extra or {}).items()]
    rows = df.where(F.col(value).isNotNull())
    counts = rows.groupBy(*by, value).agg(*aggs)
    return value_ranks(counts, value, "n", by, cut_points(rows, value)[value]).select(*by, value, "n", "rank", *(extra or {}))


def with_median(counts: DataFrame, by: Sequence[str], value: str, n: str, out: str = "median") -> DataFrame:
    """Add the median of ``value`` within ``by``, a row standing for ``n`` values; NULL values and n = 0 do not count.

    The window sorts and spills, where an exact median aggregate keeps every
    distinct value of a key in memory.
    """
    live = F.when(F.col(value).isNotNull(), F.col(n)).otherwise(0)
    w = Window.partitionBy(*by)
    upto = F.sum(live).over(w.orderBy(F.col(value).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0))
    marked = counts.select("*", upto.alias("_upto"), F.sum(live).over(w).alias("_all"))
    low = F.min(F.when(F.col("_upto") > F.floor((F.col("_all") - 1) / 2), F.col(value))).over(w)
    high = F.min(F.when(F.col("_upto") > F.floor(F.col("_all") / 2), F.col(value))).over(w)
    return marked.select("*", F.when(F.col("_all") > 0, (low + high) / 2).alias(out)).drop("_upto", "_all")


def positional_split(df: DataFrame, train_share: float = 0.8, order: str = "date", tie: str = "symbol") -> DataFrame:
    """Add ``is_train``: exactly the first ``floor(share * n)`` rows by (order, tie).

    Row counts per date decide every date but the one the boundary falls on. That
    date's rows are dealt by ranges of ``tie``; counts per range decide all but one range,
    whose rows alone are numbered.
    """
    counts = df.groupBy(order).agg(F.count("*").alias("_n"))
    cum = counts.withColumn("_cum", F.sum("_n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))  # a row per date
    cum = cum.withColumn("_quota", F.floor(F.sum("_n").over(Window.partitionBy()) * F.lit(train_share)))
    edge = cum.where("_cum > _quota").orderBy(order).select(order, (F.col("_quota") - F.col("_cum") + F.col("_n")).alias("room")).first()
    if edge is None:
        return df.withColumn("is_train", F.lit(True))
    day, room = F.lit(edge[order]), edge["room"]
    sure = df.where(F.col(order) != day).withColumn("is_train", F.col(order) < day)
    rows = df.where(F.col(order) == day)
    if room == 0:
        return sure.unionByName(rows.withColumn("is_train", F.lit(False)))
    rows = cut_lineage(rows.repartitionByRange(tie)).withColumn("_part", F.spark_partition_id())
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per range
    parts = parts.select("_part", (room - F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_room"), "_n")
    told = rows.join(F.broadcast(parts), "_part")
    whole = told.where("_room <= 0 or _room >= _n").withColumn("is_train", F.col("_room") > 0)
    split = told.where("_room > 0 and _room < _n").withColumn("is_train", F.row_number().over(Window.partitionBy("_part").orderBy(tie)) <= F.col("_room"))
    return sure.unionByName(whole.unionByName(split).drop("_part", "_room", "_n"))
