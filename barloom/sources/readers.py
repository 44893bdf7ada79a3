"""Typed readers: one mapping step from loosely named inputs to fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.numeric import finite, to_double

AGENT_LOG_SCHEMA = T.StructType(
    [
        T.StructField("agent", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)
POSITION = T.StructType(
    [
        T.StructField("entry_price", T.DoubleType()),
        T.StructField("shares", T.DoubleType()),
        T.StructField("entry_date", T.StringType()),
    ]
)
PORTFOLIO_STATE_SCHEMA = T.StructType(
    [
        T.StructField("positions", T.MapType(T.StringType(), POSITION)),
        T.StructField("equity", T.DoubleType()),
        T.StructField("starting_equity", T.DoubleType()),
        T.StructField("last_update", T.StringType()),
    ]
)
DEFAULT_EQUITY = 100_000.0
FUNDAMENTAL_METRICS = [
    # --- fixed values: metric names of the fundamentals table ---
    "pe_ratio", "forward_pe", "eps_ttm", "revenue_growth", "profit_margin", "debt_to_equity",
    "free_cash_flow", "market_cap", "sector", "52w_high", "52w_low", "current_price",
]


def read_bars(bars: DataFrame, symbols: DataFrame | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """History of the requested symbols and dates; missing closes are dropped.

    Both predicates are plain filters on the table's own columns, so partition
    pruning and parquet pushdown apply; the symbol list is a semi join.
    """
    out = bars.where(F.col("close").isNotNull())
    if since:
        out = out.where(F.col("date") >= F.lit(since).cast("date"))
    if until:
        out = out.where(F.col("date") <= F.lit(until).cast("date"))
    if symbols is not None:
        out = out.join(symbols.select("symbol"), "symbol", "left_semi")
    return out


def bars_from_wide(wide: DataFrame, field: str = "close", date: str = "date") -> DataFrame:
    """One column per symbol -> long (symbol, date, field); all-missing symbols vanish."""
    names = [c for c in wide.columns if c != date]
    return wide.unpivot(date, names, "symbol", field).where(F.col(field).isNotNull())


def trailing_bars(bars: DataFrame, asof: str, days: int) -> DataFrame:
    """Bars of the last ``days`` calendar days up to ``asof``."""
    end = F.lit(asof).cast("date")
    return bars.where(F.col("close").isNotNull() & (F.col("date") <= end) & (F.col("date") > F.date_sub(end, days)))


def _pick(df: DataFrame, *needles: str) -> str | None:
    """First column whose normalised name contains one of the needles."""
    for c in df.columns:
        name = c.lower().replace(" ", "_")
        if any(n in name for n in needles):
            return c
    return None


def read_earnings(raw: DataFrame, date: str = "report_date") -> DataFrame:
    """(symbol, report_date, actual, estimate, surprise): names normalised, unusable rows dropped."""
    actual, estimate = _pick(raw, "reported", "actual"), _pick(raw, "estimate")
    rows = raw.select(
        "symbol",
        F.col(date).cast("date").alias("report_date"),
        to_double(F.col(f"`{actual}`").cast("string")).alias("actual"),
        to_double(F.col(f"`{estimate}`").cast("string")).alias("estimate"),
    ).dropna()
    return rows.withColumn("surprise", F.try_divide(F.col("actual") - F.col("estimate"), F.abs("estimate")))


def read_insider_tx(raw: DataFrame) -> DataFrame:
    """(symbol, tx_date, text, insider, value text): first matching column per role.

    A role without a matching column has no column in the result: what reads it
    then goes without that filter, instead of taking every row for missing.
    """
    named = {
        "tx_date": _pick(raw, "date"),
        "text": _pick(raw, "transaction", "text"),
        "insider": _pick(raw, "insider", "name"),
        "value": _pick(raw, "value"),
    }
    cols: list[Column] = [F.col("symbol")]
    for out, src in named.items():
        if src:
            text = F.col(f"`{src}`").cast("string")
            cols.append((text.try_cast("date") if out == "tx_date" else text).alias(out))
    return raw.select(*cols)


def nearest_expiries(options: DataFrame, n: int = 2) -> DataFrame:
    """Contracts of the ``n`` nearest expiries per (symbol, snapshot).

    Expiries are ranked on their distinct list, not on the contracts, so a hot
    symbol never sorts all its rows in one task.
    """
    w = Window.partitionBy("symbol", "snapshot_date").orderBy("expiry")
    keep = (
        options.select("symbol", "snapshot_date", "expiry")
        .distinct()
        .withColumn("expiry_rank", F.dense_rank().over(w))
        .where(F.col("expiry_rank") <= n)
    )
    return options.join(keep, ["symbol", "snapshot_date", "expiry"])


def recent_news(news: DataFrame, asof: str, days: int = 3) -> DataFrame:
    end = F.lit(asof).cast("date")
    return news.where((F.col("published") >= F.date_sub(end, days)) & (F.col("published") <= end))


def read_fundamentals(raw: DataFrame) -> DataFrame:
    """The twelve named metrics, absent ones NULL, sector defaulting to ``Unknown``."""
    have = set(raw.columns)
    cols = [F.col("symbol")]
    for m in FUNDAMENTAL_METRICS:
        if m == "sector":
            value = F.coalesce(F.col("sector") if m in have else F.lit(None).cast("string"), F.lit("Unknown"))
        else:
            value = finite(F.col(f"`{m}`").cast("double")) if m in have else F.lit(None).cast("double")
        cols.append(value.alias(m))
    return raw.select(*cols)


def read_agent_log(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON arrays whose path names their run date (the last date in it counts); corrupt files yield no entries.

    ``seq`` is the position inside the file: files are not split, and the id
    generated within one partition follows read order.
    """
    entries = (
        spark.read.schema(AGENT_LOG_SCHEMA)
        .option("multiLine", True)
        .option("mode", "DROPMALFORMED")
        .json(path)
        .select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("seq"))
    )
    return entries.select(
        F.regexp_extract("_file", r".*(\d{4}-\d{2}-\d{2})", 1).try_cast("date").alias("run_date"),
        "seq",
        "agent",
        "data",
        "reasoning",
        F.col("timestamp").alias("ts"),
    ).where(F.col("agent").isNotNull())


def list_log_dates(log: DataFrame) -> DataFrame:
    return log.select("run_date").distinct().orderBy(F.desc("run_date"))


def read_portfolio_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(positions, account): map of positions exploded, equity defaults applied."""
    state = spark.read.schema(PORTFOLIO_STATE_SCHEMA).option("multiLine", True).json(path)
    return explode_state(state)


def explode_state(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    account = state.select(
        F.coalesce("equity", F.lit(DEFAULT_EQUITY)).alias("equity"),
        F.coalesce("starting_equity", F.lit(DEFAULT_EQUITY)).alias("starting_equity"),
        "last_update",
    )
    positions = state.select(F.explode("positions").alias("symbol", "p")).select("symbol", "p.*")
    return positions, account
