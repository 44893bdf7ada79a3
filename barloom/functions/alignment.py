"""Point-in-time alignment: as-of joins built from one union and one window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import dealt


@dataclass(frozen=True)
class Facts:
    """One dated table to look up as of the probe dates.

    ``seq`` orders facts of the same day. ``back_fill`` gives probes before the
    first fact that first fact; ``not_before_first_probe`` ignores facts older
    than the first probe of the series.
    """

    df: DataFrame
    cols: list[str]
    time: str = "date"
    seq: Column | None = None
    back_fill: bool = False
    not_before_first_probe: bool = False


def asof_many(probes: DataFrame, tables: list[Facts], by: str = "symbol", probe_time: str = "date", tasks: int | None = None) -> DataFrame:
    """Attach to every probe the latest row of each fact table with ``time <= probe_time``.

    Facts and probes are stacked, facts first on equal times, and the last fact of
    each table seen so far is carried along: one shuffle on ``by`` and one sort for
    all tables, instead of a range join per table. ``tasks`` is how many tasks they
    are dealt to, for large tables (:func:`series_tasks`).
    """
    types = [f.df.select(F.struct(*f.cols).alias("s")).schema["s"].dataType for f in tables]
    probe = F.struct(*[F.col(c) for c in probes.columns])
    probe_type = probes.select(probe.alias("p")).schema["p"].dataType

    def stack(df: DataFrame, time: str, kind: int, seq: Column, payload: Column | None) -> DataFrame:
        facts = [(payload if kind == i else F.lit(None).cast(t)).alias(f"_f{i}") for i, t in enumerate(types)]
        return df.select(
            F.col(by).alias("_by"),
            F.col(time).cast("date").alias("_t"),
            F.lit(kind).alias("_kind"),
            seq.cast("long").alias("_seq"),
            (probe if kind == len(types) else F.lit(None).cast(probe_type)).alias("_probe"),
            *facts,
        )

    both = stack(probes, probe_time, len(tables), F.lit(0), None)
    for i, f in enumerate(tables):
        both = both.unionByName(stack(f.df, f.time, i, f.seq if f.seq is not None else F.lit(0), F.struct(*f.cols)))
    both = dealt(both, tasks, "_by")
    is_probe = F.col("_kind") == len(tables)
    if any(f.not_before_first_probe for f in tables):
        both = both.withColumn("_first", F.min(F.when(is_probe, F.col("_t"))).over(Window.partitionBy("_by")))
    w = Window.partitionBy("_by").orderBy("_t", "_kind", "_seq")
    hits = []
    for i, f in enumerate(tables):
        fact = F.when(F.col("_t") >= F.col("_first"), F.col(f"_f{i}")) if f.not_before_first_probe else F.col(f"_f{i}")
        hit = F.last(fact, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        if f.back_fill:
            # only probes ahead of every fact get here, so the series' first fact is the next one
            hit = F.coalesce(hit, F.first(fact, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        hits.append(hit.alias(f"_h{i}"))
    found = both.select("_kind", "_probe", *hits).where(is_probe)
    return found.select("_probe.*", *[F.col(f"_h{i}.{c}").alias(c) for i, f in enumerate(tables) for c in f.cols])


def asof_backward(
    probes: DataFrame,
    facts: DataFrame,
    cols: list[str],
    *,
    by: str = "symbol",
    probe_time: str = "date",
    fact_time: str = "date",
    fact_seq: Column | None = None,
    back_fill: bool = False,
    not_before_first_probe: bool = False,
) -> DataFrame:
    """:func:`asof_many` for a single fact table."""
    return asof_many(probes, [Facts(facts, cols, fact_time, fact_seq, back_fill, not_before_first_probe)], by, probe_time)


def fill_on_calendar(small: DataFrame, calendar: DataFrame, key: str, value: str) -> DataFrame:
    """Forward-fill index series on the union calendar from each series' first date.

    ``small`` is calendar-sized per key (benchmarks, sectors). The calendar is one
    array of days, which each key unrolls from its own start, so no cross join and
    no numbering is needed.
    """
    days = calendar.agg(F.array_sort(F.collect_set("date")).alias("d")).scalar()
    starts = small.groupBy(key).agg(F.min("date").alias("_lo")).withColumn("_days", days)
    grid = starts.select(key, F.explode(F.filter("_days", lambda d: d >= F.col("_lo"))).alias("date"))
    w = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    held = grid.join(small.select(key, "date", value), [key, "date"], "left")
    return held.select(key, "date", F.last(value, ignorenulls=True).over(w).alias(value))
