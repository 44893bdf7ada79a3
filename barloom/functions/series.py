"""Row-offset window expressions over per-symbol, date-ordered series.

Every helper returns a Column over the same ``(symbol, date)`` window, so a
``select`` that uses many of them is planned with one exchange and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import ratio

# Largest exponent of e that a restart block of the exponential mean may reach; doubles end near e^709.
EWM_REACH = 600.0
# Rows of a series table that a task sorts; tables for fewer tasks than LEAST_TASKS are dealt as Spark decides.
TASK_ROWS, LEAST_TASKS = 100_000, 16


def series(key: str = "symbol", order: str = "date"):
    return Window.partitionBy(key).orderBy(order)


def series_tasks(rows: int) -> int | None:
    """Tasks to deal ``rows`` rows to, so that what a task sorts does not grow with the table; None where Spark's own choice does."""
    tasks = -(-rows // TASK_ROWS)
    return tasks if tasks > LEAST_TASKS else None


def dealt(df: DataFrame, tasks: int | None, key: str = "symbol") -> DataFrame:
    """``df`` dealt by ``key`` to ``tasks``, which every window over ``key`` reuses; as it is without a number."""
    return df.repartition(tasks, key) if tasks else df


def trailing(n: int, key: str = "symbol", order: str = "date"):
    return series(key, order).rowsBetween(-(n - 1), 0)


def pct_change(c: str, n: int, w=None) -> Column:
    w = w or series()
    return ratio(F.col(c), F.lag(c, n).over(w)) - 1


def forward_return(c: str, n: int, w=None) -> Column:
    w = w or series()
    return ratio(F.lead(c, n).over(w), F.col(c)) - 1


def log_return(c: str, w=None) -> Column:
    w = w or series()
    return F.ln(ratio(F.col(c), F.lag(c, 1).over(w)))


def rolling(agg, c, n: int, min_periods: int | None = None, key: str = "symbol", order: str = "date") -> Column:
    """``agg`` over the last n rows, NULL until ``min_periods`` values are present."""
    c = F.col(c) if isinstance(c, str) else c
    w = trailing(n, key, order)
    return F.when(F.count(c).over(w) >= (n if min_periods is None else min_periods), agg(c).over(w))


def sma(c, n: int, min_periods: int | None = None, **kw) -> Column:
    return rolling(F.avg, c, n, min_periods, **kw)


def running_sum(src: str, key: str = "symbol", order: str = "date") -> list[Column]:
    """``_cs`` and ``_cn``: sum and count of ``src`` so far, the base of :func:`prefix_mean`."""
    upto = series(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return [F.sum(src).over(upto).alias("_cs"), F.count(src).over(upto).alias("_cn")]


def prefix_mean(n: int, key: str = "symbol", order: str = "date") -> Column:
    """Moving average over n rows as a difference of running sums; NULL until n values are present.

    Constant work per row, where a sliding frame adds up n values for every row.
    """
    w = series(key, order)
    have = F.col("_cn") - F.coalesce(F.lag("_cn", n).over(w), F.lit(0))
    total = F.col("_cs") - F.coalesce(F.lag("_cs", n).over(w), F.lit(0.0))
    return F.when(have >= n, total / n)


def rolling_std(c, n: int, **kw) -> Column:
    return rolling(F.stddev_samp, c, n, **kw)


def with_row_index(df: DataFrame, key: str = "symbol", order: str = "date") -> DataFrame:
    """0-based row number ``_rn`` within the series, as :func:`with_ewm` needs it."""
    return df.withColumn("_rn", F.row_number().over(series(key, order)) - 1)


def ewm_block(alphas: Iterable[float]) -> int:
    """Rows per restart block: the most for which every power of 1 - alpha stays a normal double."""
    return min([max(1, int(EWM_REACH / -math.log1p(-a))) for a in alphas if a < 1], default=1 << 20)


def with_ewm(df: DataFrame, specs: dict[str, tuple[str, float]], key: str = "symbol", order: str = "date", block: int | None = None) -> DataFrame:
    """Exponential means ``e_i = a*x_i + (1-a)*e_{i-1}``, seeded with the first value.

    ``specs`` maps output name -> (input column, alpha), 0 < alpha <= 1. Inputs may
    have leading NULLs only. With b = 1-a the recursion unrolls to
    ``b^i * sum(t_j)``, ``t_j = a*x_j*b^-j``: one running sum, no Python. The sum
    restarts every ``block`` rows (by default as many as the alphas allow). The
    values at the block ends, one per block, are folded by the same recursion, so
    nothing old is dropped whatever the length or alpha. Needs the column of
    :func:`with_row_index`; all specs share two window nodes.
    """
    for out, (_, alpha) in specs.items():
        if not 0 < alpha <= 1:
            raise ValueError(f"{out}: alpha must be above 0 and at most 1")
    size = block or ewm_block(a for _, a in specs.values())
    kept = df.columns
    rows = Window.partitionBy(key, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key).orderBy("_blk", order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.select("*", F.floor(F.col("_rn") / size).cast("int").alias("_blk"), (F.col("_rn") % size).alias("_off"))

    def power(alpha: float, exponent: Column) -> Column:
        return F.pow(F.lit(1.0 - alpha), exponent)

    sums, local = [], []
    for out, (src, alpha) in specs.items():
        term = F.col(src) if alpha == 1 else F.col(src) * alpha * power(alpha, -F.col("_off"))
        sums.append(F.sum(term).over(rows).alias(f"_t_{out}"))
        sums.append(F.first(F.when(F.col(src).isNotNull(), F.struct(F.col("_off").alias("o"), F.col(src).alias("x"))), True).over(rows).alias(f"_s_{out}"))
        # where a series starts, its first value weighs 1, not alpha
        seed = F.col(f"_s_{out}.x") * (1.0 - alpha) * power(alpha, F.col("_off") - F.col(f"_s_{out}.o"))
        local += [(F.col(f"_t_{out}") * power(alpha, F.col("_off"))).alias(f"_l_{out}"), seed.alias(f"_e_{out}")]
    summed = df.select("*", *sums).select(*kept, "_blk", "_off", *local)
    ends = F.struct(*[F.col(f"_{x}_{out}").alias(f"{x}_{out}") for out in specs for x in ("l", "e")])
    ended = summed.select("*", F.collect_list(F.when(F.col("_off") == size - 1, ends)).over(whole).alias("_ends"))

    def carried(out: str, alpha: float) -> Column:
        """The mean at the end of the block before; NULL if no value came up to there."""

        def fold(mean: Column, end: Column) -> Column:
            started = F.coalesce(mean * (1.0 - alpha) ** size, end[f"e_{out}"])
            return F.coalesce(end[f"l_{out}"] + started, mean)

        return F.aggregate(F.slice("_ends", F.lit(1), F.col("_blk")), F.lit(None).cast("double"), fold)

    final = []
    for out, (src, alpha) in specs.items():
        before = F.when(F.col("_blk") > 0, carried(out, alpha))
        mean = F.col(f"_l_{out}") + F.coalesce(before * power(alpha, F.col("_off") + 1), F.col(f"_e_{out}"))
        final.append((F.col(src) if alpha == 1 else F.when(F.col(src).isNotNull(), mean)).alias(out))
    return ended.select(*kept, *final)


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)
