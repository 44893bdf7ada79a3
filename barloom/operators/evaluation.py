"""Classifier and ranking metrics, walk-forward splits and the top-k back-test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import finite, py_round, ratio
from barloom.functions.ranking import average_rank, cut_points, row_ranks, value_ranks

# --- fixed values -----------------------------------------------------------
TOP_K = 5
FORWARD_DAYS = 5
MIN_TRAIN_YEARS, TEST_YEARS = 2, 1
MIN_TRAIN_ROWS, MIN_TEST_ROWS = 200, 50
MIN_IC_ROWS = 10
PASS_AUC, GATE_AUC = 0.51, 0.50
# ----------------------------------------------------------------------------


def _grouped(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by) if by else df.groupBy()


def accuracy(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _grouped(scored, by).agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("acc"))


def roc_auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve from average ranks of the score; 0.5 with a single class."""
    ranks = average_rank(scored, "proba", by, {"pos": F.sum("label")})
    g = _grouped(ranks, by).agg(
        F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").cast("double").alias("p"), F.sum("n").cast("double").alias("t")
    )
    auc = ratio(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("t") - F.col("p")))
    return g.select(*by, F.coalesce(auc, F.lit(0.5)).alias("auc"))


def rank_ic(scored: DataFrame, by: Sequence[str] = (), min_rows: int = 0) -> DataFrame:
    """Spearman correlation of score and forward return; 0 when undefined or too few rows.

    Returns are ranked row by row, in one exchange. Rows of one score then collapse, so
    that scores are ranked once each and nothing is joined back. Both rankings
    have the mean (n + 1) / 2, from which the moments are taken.
    """
    valid = scored.where(F.col("fwd_ret").isNotNull() & F.col("proba").isNotNull()).select(*by, "proba", "fwd_ret")
    cuts = cut_points(valid, "proba", "fwd_ret")
    off = F.col("rank") - (F.col("total") + 1) / 2.0
    per_score = row_ranks(valid, "fwd_ret", by, cuts["fwd_ret"]).groupBy(*by, "proba").agg(
        F.count("*").alias("n"), F.first("total").alias("total"), F.sum(off).alias("f"), F.sum(off * off).alias("ff")
    )
    ranked = value_ranks(per_score, "proba", "n", by, cuts["proba"])
    g = _grouped(ranked, by).agg(
        F.sum("n").alias("n"), F.sum(off * F.col("f")).alias("pf"), F.sum(F.col("n") * off * off).alias("pp"), F.sum("ff").alias("ff")
    )
    ic = F.when(F.col("n") > min_rows, finite(ratio(F.col("pf"), F.sqrt(F.col("pp") * F.col("ff")))))
    return g.select(*by, F.coalesce(ic, F.lit(0.0)).alias("ic"))


def top_per_date(scored: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k best scores of every date, ties by symbol."""
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("proba"), "symbol"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def precision_at_top(scored: DataFrame, k: int = TOP_K) -> DataFrame:
    """Mean over dates (with at least two rows) of the positive share among the k best."""
    top = top_per_date(scored, k)
    day = top.groupBy("date").agg(F.avg("label").alias("p"), F.count("*").alias("n")).where(F.col("n") >= 2)
    return day.agg(F.coalesce(F.avg("p"), F.lit(0.0)).alias("p_at_k"))


def topk_backtest(scored: DataFrame, market: DataFrame, k: int = TOP_K) -> DataFrame:
    """Compounded mean forward return of the daily top k against the market's first-to-last return.

    Growth is summed as ``log_strategy``, which holds where the product leaves the
    range of doubles (``strategy`` is infinite then); a day that loses everything
    makes ``strategy`` -1. The market series ends before the last scored date,
    which is exclusive.
    """
    valid = scored.where(F.col("fwd_ret").isNotNull())
    day = top_per_date(valid, k).groupBy("date").agg(F.avg("fwd_ret").alias("r"))
    growth = F.lit(1.0) + F.col("r") / FORWARD_DAYS
    logs = day.agg(F.sum(F.ln(growth)).alias("log_strategy"), F.min(growth).alias("worst"), F.count("*").alias("n_days"))
    strategy = logs.withColumn("strategy", F.when(F.col("worst") <= 0, -1.0).otherwise(F.expm1("log_strategy")))
    span = scored.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    bench = market.where((F.col("date") >= lo) & (F.col("date") < hi)).agg(
        F.min_by("close", "date").alias("a"), F.max_by("close", "date").alias("b")
    )
    total = bench.select(F.coalesce(ratio("b", "a") - 1, F.lit(0.0)).alias("m")).scalar()
    return strategy.select("n_days", "log_strategy", "strategy", total.alias("benchmark")).withColumn("alpha", F.col("strategy") - F.col("benchmark"))


def profile(panel: DataFrame) -> DataFrame:
    """Rows, symbols, date range, years covered and positive rate."""
    return panel.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("symbol").alias("n_symbols"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.avg("label").alias("pos_rate"),
    ).withColumn("years", F.datediff("max_date", "min_date") / 365.25)


def walk_forward_splits(panel: DataFrame) -> DataFrame:
    """(split, test_start, test_end, n_train, n_test) of the expanding-window splits.

    Boundaries and sizes come from per-date row counts, never from the rows.
    """
    days = panel.groupBy("date").agg(F.count("*").alias("n"))
    span = days.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    enough = F.datediff("hi", "lo") / 365.25 >= MIN_TRAIN_YEARS + TEST_YEARS
    first = F.add_months("lo", 12 * MIN_TRAIN_YEARS)
    starts = span.where(enough).select("hi", first.alias("s0")).select(
        "hi", F.explode(F.transform(F.sequence(F.lit(0), F.year("hi") - F.year("s0")), lambda k: F.add_months(F.col("s0"), k * 12 * TEST_YEARS))).alias("test_start")
    )
    splits = starts.withColumn("test_end", F.add_months("test_start", 12 * TEST_YEARS)).where(F.col("test_end") <= F.col("hi"))
    # a handful of splits, each kept with the days up to its end
    sized = (
        days.withColumn("_s", splits.agg(F.collect_list(F.struct("test_start", "test_end"))).scalar())
        .select("date", "n", F.explode("_s").alias("s"))
        .groupBy("s.test_start", "s.test_end")
        .agg(
            F.sum(F.when(F.col("date") < F.col("s.test_start"), F.col("n")).otherwise(0)).alias("n_train"),
            F.sum(F.when((F.col("date") >= F.col("s.test_start")) & (F.col("date") < F.col("s.test_end")), F.col("n")).otherwise(0)).alias("n_test"),
        )
    )
    return sized.where((F.col("n_train") >= MIN_TRAIN_ROWS) & (F.col("n_test") >= MIN_TEST_ROWS)).select(
        F.concat_ws("-", F.year("test_start"), F.year("test_end")).alias("split"), "test_start", "test_end", "n_train", "n_test"
    )


def tag_splits(panel: DataFrame, splits: DataFrame) -> DataFrame:
    """Test rows with the split they belong to (test years do not overlap).

    The split list is a handful of rows, kept as one array value.
    """
    lst = splits.agg(F.collect_list(F.struct("split", "test_start", "test_end"))).scalar()
    hit = F.filter(F.col("_s"), lambda s: (F.col("date") >= s["test_start"]) & (F.col("date") < s["test_end"]))
    tagged = panel.withColumn("_s", lst).withColumn("split", F.get(hit, F.lit(0))["split"])
    return tagged.where(F.col("split").isNotNull()).drop("_s")


def split_metrics(scored: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, auc, ic, n_train, n_test) rounded as reported; single-class splits give 0.5 and 0.

    ``splits`` (split, n_train) is the handful of splits the rows are tagged with.
    """
    classes = scored.groupBy("split").agg(F.count("*").alias("n_test"), F.count_distinct("label").alias("k"))
    out = classes.join(splits.select("split", "n_train"), "split", "left")
    out = out.join(roc_auc(scored, ["split"]), "split", "left").join(rank_ic(scored, ["split"], MIN_IC_ROWS), "split", "left")
    one = F.col("k") < 2
    return out.select(
        "split",
        F.when(one, 0.5).otherwise(py_round("auc", 4)).alias("auc"),
        F.when(one, 0.0).otherwise(py_round(F.coalesce("ic", F.lit(0.0)), 4)).alias("ic"),
        "n_train",
        "n_test",
    )


def summarise_splits(metrics: DataFrame) -> DataFrame:
    """Mean, population std, min and max of both metrics, positive splits and the verdict."""
    aggs: list[Column] = []
    for m in ("auc", "ic"):
        aggs += [F.avg(m).alias(f"mean_{m}"), F.stddev_pop(m).alias(f"std_{m}"), F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}")]
    s = metrics.agg(*aggs, F.count_if(F.col("ic") > 0).alias("positive_ic"), F.count("*").alias("n_splits"))
    verdict = (
        F.when(F.col("n_splits") == 0, "NO_SPLITS")
        .when((F.col("mean_auc") >= PASS_AUC) & (F.col("mean_ic") > 0), "PASS")
        .when(F.col("mean_ic") > 0, "MARGINAL")
        .otherwise("FAIL")
    )
    return s.withColumn("verdict", verdict)


def quality_gate(acc: DataFrame, auc: DataFrame, ic: DataFrame) -> DataFrame:
    """One row (auc, ic, acc, usable): usable with AUC of at least 0.5 and non-negative IC."""
    one = acc.select(acc["acc"], auc.select("auc").scalar().alias("auc"), ic.select("ic").scalar().alias("ic"))
    usable = (F.col("auc") >= GATE_AUC) & (F.col("ic") >= 0)
    return one.select(py_round("auc", 4).alias("auc"), py_round("ic", 4).alias("ic"), py_round("acc", 4).alias("acc"), usable.alias("usable"))
