"""Research inputs derived from the warehouse star schema.

Instruments are suppliers: each one's daily bar is the volume-weighted price of
its line items, so the number of series grows with the data while a series stays
calendar-sized. All aggregation is plain groupBy (partial before the shuffle),
money is added as whole cents so the result does not depend on row order.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.series import dealt, forward_return, series_tasks
from barloom.sources.dims import WATCHLIST

MONEY = "decimal(18,2)"
CENTS, RATE_UNITS = 100, 10_000

BARS_ASOF = "2001-11-04"
EVENTS_ASOF = "2024-01-31"


def _date(c: str) -> Column:
    return F.col(c).cast("date")


def _units(c: str, scale: int) -> Column:
    """Non-negative fixed-point number as an integer of 1/scale: adds exactly, stays in codegen."""
    return F.floor(F.col(c) * float(scale) + 0.5)


def _scaled(c: Column, scale: int) -> Column:
    return c.cast("double") / float(scale)


class Tables:
    """Lazy views over one directory of warehouse tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    # -- price history ------------------------------------------------------
    def _trades(self, since: str | None = None, *extra: str) -> DataFrame:
        """(l_suppkey, date, cents, qty, *extra) per line item."""
        rows = self.raw("lineitem")
        if since:
            # on the raw column, so the filter reaches the parquet scan
            rows = rows.where(F.col("l_shipdate") >= F.lit(since).cast("timestamp_ntz"))
        return rows.select(
            "l_suppkey", _date("l_shipdate").alias("date"), _units("l_extendedprice", CENTS).alias("cents"), F.col("l_quantity").alias("qty"), *extra
        )

    def _placed(self, *extra: str, since: str | None = None) -> DataFrame:
        """Trades with the sector of their supplier.

        Joined ahead of the aggregation: while suppliers fit a broadcast, trades
        collapse to (sector, date) on the map side; beyond that it is a shuffled
        join whose hot suppliers AQE splits.
        """
        return self._trades(since, *extra).join(self.places, F.col("l_suppkey") == F.col("s_suppkey"))

    @staticmethod
    def _bar() -> list[Column]:
        return [(_scaled(F.sum("cents"), CENTS) / F.sum("qty")).alias("close"), F.sum("qty").alias("volume")]

    def bars(self, since: str | None = None) -> DataFrame:
        """(symbol, date, close, volume) per supplier."""
        return (
            self._trades(since)
            .groupBy("l_suppkey", "date")
            .agg(*self._bar())
            .select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), "date", "close", "volume")
        )

    @cached_property
    def series_tasks(self) -> int | None:
        """Tasks for tables by symbol, none of which has more rows than there are line items; these are counted from the files' footers."""
        return series_tasks(self.raw("lineitem").count())

    def series(self) -> DataFrame:
        """The bars, dealt by symbol for windows over whole series."""
        return dealt(self.bars(), self.series_tasks)

    @cached_property
    def places(self) -> DataFrame:
        """(suppkey, sector, nation): nation and region are fixed-size dimensions."""
        return (
            self.raw("supplier")
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", F.col("r_name").alias("sector"), F.col("n_name").alias("nation"))
        )

    def dims(self) -> DataFrame:
        """(symbol, sector, nation)."""
        return self.places.select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), "sector", "nation")

    def market(self) -> DataFrame:
        """(date, close, volume) of everything traded."""
        return self._trades().groupBy("date").agg(*self._bar())

    def sector_bars(self) -> DataFrame:
        """(sector, date, close, volume)."""
        return self._placed().groupBy("sector", "date").agg(*self._bar())

    def indices(self, since: str | None = None) -> DataFrame:
        """(index, date, close): every sector and the market ``MKT``, in one pass."""
        rolled = self._placed(since=since).rollup("date", "sector").agg(F.grouping("sector").alias("_all"), *self._bar())
        return rolled.where(F.col("date").isNotNull()).select(
            F.when(F.col("_all") == 1, "MKT").otherwise(F.col("sector")).alias("index"), "date", "close"
        )

    def screen_bars(self, since: str | None = None) -> DataFrame:
        """Bars of suppliers and baskets, read from ``since`` on: the sparse and the dense series of a screen."""
        return self.baskets(since).unionByName(self.bars(since))

    def baskets(self, since: str | None = None) -> DataFrame:
        """(symbol, date, close, volume) of ten dense baskets: sector x line status."""
        return self._placed("l_linestatus", since=since).groupBy(F.concat_ws("-", "sector", "l_linestatus").alias("symbol"), "date").agg(*self._bar())

    # -- macro --------------------------------------------------------------
    def vix(self, since: str | None = None) -> DataFrame:
        """(date, close) fear gauge."""
        rows = self.raw("lineitem").where("l_linestatus = 'O' and l_returnflag = 'R'")
        if since:
            rows = rows.where(F.col("l_shipdate") >= F.lit(since).cast("timestamp_ntz"))
        return rows.groupBy(_date("l_shipdate").alias("date")).agg(
            (_scaled(F.sum(_units("l_discount", RATE_UNITS)), RATE_UNITS) / F.count("*") * 400).alias("close")
        )

    def macro(self) -> DataFrame:
        """(symbol, date, close) for VIX, TNX, IRX, HYG, LQD; one scan, one groupBy."""
        rows = self.raw("lineitem")
        fear = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")

        def price(flag: str) -> Column:
            on = F.col("l_returnflag") == flag
            return F.try_divide(
                _scaled(F.sum(F.when(on, _units("l_extendedprice", CENTS))), CENTS), F.sum(F.when(on, F.col("l_quantity")))
            )

        def rate(c: str, on: Column | None = None) -> Column:
            units = _units(c, RATE_UNITS)
            return _scaled(F.sum(units if on is None else F.when(on, units)), RATE_UNITS)

        day = rows.groupBy(_date("l_shipdate").alias("date")).agg(
            (F.try_divide(rate("l_discount", fear), F.count_if(fear)) * 400).alias("VIX"),
            (rate("l_tax") / F.count("*") * 100).alias("TNX"),
            (rate("l_discount") / F.count("*") * 80).alias("IRX"),
            price("A").alias("HYG"),
            price("N").alias("LQD"),
        )
        return day.unpivot("date", ["VIX", "TNX", "IRX", "HYG", "LQD"], "symbol", "close").where("close is not null")

    # -- side tables --------------------------------------------------------
    def earnings(self) -> DataFrame:
        """Raw (symbol, report_date, reported_eps, eps_estimate) as text, one per supplier and month."""
        month = F.date_trunc("month", F.col("l_shipdate")).cast("date")
        per_month = (
            self.raw("lineitem")
            .groupBy("l_suppkey", month.alias("month"))
            .agg(
                F.max(_date("l_shipdate")).alias("report_date"),
                (_scaled(F.sum(_units("l_extendedprice", CENTS)), CENTS) / F.count("*")).alias("actual"),
            )
        )
        prev = F.lag("actual").over(Window.partitionBy("l_suppkey").orderBy("month"))
        return dealt(per_month, self.series_tasks, "l_suppkey").select(
            F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
            "report_date",
            F.col("actual").alias("Reported EPS"),
            prev.alias("EPS Estimate"),
        )

    def insider_tx(self) -> DataFrame:
        """Raw (symbol, Start Date, Transaction, Insider, Value) with text values."""
        kind = F.col("event_type")
        return self.raw("events").select(
            F.concat(F.lit("S"), F.col("user_id")).alias("symbol"),
            F.date_sub(_date("ts"), (F.col("event_id") % 120).cast("int")).alias("Start Date"),
            F.when(kind == "purchase", "Purchase")
            .when(kind == "signup", "Stock Acquisition")
            .when(kind == "view", "Sale")
            .when(kind == "click", "Disposal")
            .alias("Transaction"),
            F.concat(F.lit("I"), F.col("event_id") % 40).alias("Insider"),
            F.when(F.col("event_id") % 50 == 0, F.lit("n/a"))
            .otherwise((F.col("value").cast(MONEY) * 100).cast("string"))
            .alias("Value"),
        )

    def options(self) -> DataFrame:
        """(symbol, snapshot_date, expiry, side, open_interest, volume, iv)."""
        return self.raw("lineitem").select(
            F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"),
            F.date_trunc("year", F.col("l_shipdate")).cast("date").alias("snapshot_date"),
            F.date_trunc("month", F.col("l_shipdate")).cast("date").alias("expiry"),
            F.when(F.col("l_linestatus") == "O", "C").otherwise("P").alias("side"),
            F.col("l_quantity").alias("open_interest"),
            F.when(F.col("l_linenumber") != 5, (F.col("l_linenumber") * 3).cast("double")).alias("volume"),
            _scaled(_units("l_discount", RATE_UNITS) * 5, RATE_UNITS).alias("iv"),
        )

    def interest(self) -> DataFrame:
        """(symbol, week, interest): weekly activity count."""
        return (
            self.raw("lineitem")
            .groupBy("l_suppkey", F.date_trunc("week", F.col("l_shipdate")).cast("date").alias("week"))
            .agg(F.count("*").cast("double").alias("interest"))
            .select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), "week", "interest")
        )

    def news(self) -> DataFrame:
        """(symbol, published, seq, headline, summary, source)."""
        return self.raw("documents").select(
            F.concat_ws("-", "lang", "source").alias("symbol"),
            F.date_sub(F.lit(EVENTS_ASOF).cast("date"), (F.col("doc_id") % 30).cast("int")).alias("published"),
            F.col("doc_id").alias("seq"),
            F.element_at(F.split("text", "\n", 2), 1).alias("headline"),
            F.col("text").alias("summary"),
            "source",
        )

    def scored_news(self) -> DataFrame:
        """(symbol, seq, headline, label, score): quality/toxic labels stand in for a classifier."""
        label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "positive").when(
            (F.col("quality") == 0) & (F.col("toxic") == 1), "negative"
        )
        return (
            self.raw("documents")
            .join(self.raw("labels"), "doc_id")
            .select(
                F.concat_ws("-", "lang", "source").alias("symbol"),
                F.col("doc_id").alias("seq"),
                F.element_at(F.split("text", "\n", 2), 1).alias("headline"),
                F.coalesce(label, F.lit("neutral")).alias("label"),
                (F.lit(0.5) + (F.col("n_chars") % 50) / 100.0).alias("score"),
            )
        )

    def fundamentals(self) -> DataFrame:
        """(symbol, roe, profit_margin, revenue_growth, pe, pb)."""
        size = F.col("p_size")
        return self.raw("part").select(
            F.concat(F.lit("S"), F.col("p_partkey")).alias("symbol"),
            F.when(size % 11 != 0, (size - 10) / 100.0).alias("roe"),
            ((size - 15) / 150.0).alias("profit_margin"),
            F.when(size % 5 != 0, (F.col("p_partkey") % 41 - 10) / 100.0).alias("revenue_growth"),
            F.when(size % 7 != 0, F.col("p_retailprice") / 40.0).alias("pe"),
            (size / 5.0).alias("pb"),
        )

    def quotes(self) -> DataFrame:
        """All named metrics of a quote page per part, with gaps and values that are no number, and one the reader does not know."""
        size, price, key = F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey")
        return self.raw("part").select(
            F.concat(F.lit("S"), key).alias("symbol"),
            F.when(size % 7 != 0, price / 40.0).alias("pe_ratio"),
            (price / 44.0).alias("forward_pe"),
            F.when(size % 9 != 0, (key % 50 - 5) / 10.0).alias("eps_ttm"),
            F.when(size % 5 != 0, (key % 41 - 10) / 100.0).alias("revenue_growth"),
            ((size - 15) / 150.0).alias("profit_margin"),
            F.when(size % 13 == 0, F.lit(float("nan"))).otherwise(size / 10.0).alias("debt_to_equity"),
            (price * 1000.0 - key * 10.0).alias("free_cash_flow"),
            (price * 1e6).alias("market_cap"),
            F.when(size % 4 != 0, F.col("p_brand")).alias("sector"),
            (price * 1.25).alias("52w_high"),
            (price * 0.75).alias("52w_low"),
            F.when(size % 17 == 0, F.lit(float("inf"))).otherwise(price).alias("current_price"),
            size.alias("beta"),
        )

    # -- portfolio ----------------------------------------------------------
    def scored_panel(self) -> DataFrame:
        """(date, symbol, proba, pred, label, fwd_ret): a fixed score column to evaluate."""
        base = self.series().select("symbol", "date", "volume", forward_return("close", 5).alias("fwd_ret"))
        proba = (F.col("volume") % 97) / 97.0
        return base.select(
            "date",
            "symbol",
            proba.alias("proba"),
            F.when(proba >= 0.5, 1).otherwise(0).alias("pred"),
            F.when(F.col("fwd_ret") > 0, 1).otherwise(0).alias("label"),
            "fwd_ret",
        )

    def weights_raw(self) -> DataFrame:
        """(run_date, symbol, weight text) proposals, with unknown names and unusable text."""
        slot = (F.col("user_id") % 20).cast("int")
        names = F.array(*[F.lit(s) for s in WATCHLIST])
        symbol = F.when(slot < len(WATCHLIST), F.get(names, slot)).otherwise(F.concat(F.lit("UNK"), slot))
        day = (
            self.raw("events")
            .groupBy(_date("ts").alias("run_date"), symbol.alias("symbol"))
            .agg(F.sum(F.col("value").cast(MONEY)).alias("v"), F.count("*").alias("n"))
        )
        totals = day.groupBy("run_date").agg(F.sum("v").alias("total"))
        share = F.col("v").cast("double") * 3 / F.col("total").cast("double")
        return day.join(totals, "run_date").select(
            "run_date",
            "symbol",
            F.when(F.col("n") % 17 == 0, "nan")
            .when(F.col("n") % 19 == 0, "abc")
            .otherwise(share.cast("decimal(10,6)").cast("string"))
            .alias("weight"),
        )

    def positions(self) -> DataFrame:
        """(symbol, entry_price, current_price, shares, entry_date): first and last bar per symbol."""
        first = F.min_by(F.struct("close", "date"), "date")
        last = F.max_by(F.struct("close", "volume"), "date")
        return (
            self.bars()
            .groupBy("symbol")
            .agg(first.alias("f"), last.alias("l"))
            .select(
                "symbol",
                F.col("f.close").alias("entry_price"),
                F.col("l.close").alias("current_price"),
                F.col("l.volume").alias("shares"),
                F.col("f.date").alias("entry_date"),
            )
        )

    def holdings(self) -> DataFrame:
        """(portfolio, symbol, value)."""
        return self._accounts("c_custkey % 2 = 0").select("portfolio", "symbol", F.col("v").cast("double").alias("value"))

    def targets(self) -> DataFrame:
        """(portfolio, symbol, weight)."""
        part = self._accounts("c_custkey % 2 = 1")
        total = part.groupBy("portfolio").agg(F.sum("v").alias("total"))
        return part.join(total, "portfolio").select(
            "portfolio", "symbol", (F.col("v").cast("double") / F.col("total").cast("double")).alias("weight")
        )

    def _accounts(self, keep: str) -> DataFrame:
        return (
            self.raw("customer")
            .where(keep)
            .groupBy(F.col("c_mktsegment").alias("portfolio"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("symbol"))
            .agg(F.sum(F.abs(F.col("c_acctbal").cast(MONEY))).alias("v"))
        )

    # -- logs, memory, answers ----------------------------------------------
    def agent_log(self) -> DataFrame:
        """(desk, run_date, seq, agent, data JSON text, ts): one weekly log per desk."""
        kind = F.col("event_type")
        agent = (
            F.when(kind == "view", "News-Sentiment")
            .when(kind == "click", "Technical-Forecaster")
            .when(kind == "purchase", "Fundamentals")
            .when((kind == "signup") & (F.col("event_id") % 3 == 0), "Risk-Style")
            .when((kind == "signup") & (F.col("event_id") % 3 == 1), "Portfolio-Decision")
            .when(kind == "signup", "Risk-Management")
            .otherwise("Pipeline-Error")
        )
        e = F.col("event_id")
        name = F.get(F.array(*[F.lit(s) for s in WATCHLIST]), (e % 15).cast("int"))
        data = F.to_json(
            F.struct(
                F.when(kind.isin("view", "click", "purchase", "error"), name).alias("ticker"),
                F.when(kind == "view", (e % 201 - 100) / 100.0).alias("sentiment_score"),
                F.when(kind == "click", F.get(F.array(F.lit("up"), F.lit("down"), F.lit("sideways")), (e % 3).cast("int"))).alias("direction"),
                F.when(kind == "purchase", (e % 101).cast("int")).alias("health_score"),
                F.when(agent == "Risk-Style", F.lit("aggressive")).alias("style"),
                F.when(agent == "Portfolio-Decision", F.create_map(name, (e % 30) / 100.0, F.lit("XYZ"), (e % 7) / 100.0)).alias("weights"),
            )
        )
        return self.raw("events").select(
            F.concat(F.lit("D"), F.col("user_id")).alias("desk"),
            F.date_trunc("week", F.col("ts")).cast("date").alias("run_date"),
            e.alias("seq"),
            agent.alias("agent"),
            data.alias("data"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        )

    def decisions(self) -> DataFrame:
        """(id, embedding, style, pnl_pct)."""
        return self.raw("embeddings").select(
            F.col("vec_id").alias("id"),
            F.col("embedding").cast("array<double>").alias("embedding"),
            F.get(F.array(F.lit("aggressive"), F.lit("balanced"), F.lit("conservative")), (F.col("vec_id") % 3).cast("int")).alias("style"),
            ((F.col("label") - 4) / 4.0).cast("double").alias("pnl_pct"),
        )

    def responses(self) -> DataFrame:
        """(conv_id, turn, raw): answers as bare JSON, fenced JSON, prose around JSON, or prose."""
        body = F.to_json(
            F.struct(
                ((F.col("conv_id") % 21 - 10) / 10.0).alias("sentiment_score"),
                F.col("text").alias("key_theme"),
                F.concat(F.lit(""), F.col("conv_id") % 140).alias("health_score"),
                F.get(F.array(F.lit("up"), F.lit("down"), F.lit("sideways")), (F.col("conv_id") % 3).cast("int")).alias("direction"),
                ((F.col("conv_id") % 11) / 10.0).alias("confidence"),
                F.col("role").alias("reasoning"),
                F.get(F.array(F.lit("Aggressive"), F.lit("conservative"), F.lit("wild")), (F.col("conv_id") % 3).cast("int")).alias("style"),
                F.create_map(F.lit("AAPL"), (F.col("conv_id") % 7) / 10.0, F.lit("MSFT"), F.lit(0.25)).alias("weights"),
                F.col("role").alias("rationale"),
            )
        )
        raw = (
            F.when(F.col("turn") % 4 == 0, body)
            .when(F.col("turn") % 4 == 1, F.concat(F.lit("Sure.\n```json\n"), body, F.lit("\n```\nDone.")))
            .when(F.col("turn") % 4 == 2, F.concat(F.lit("The answer is "), body, F.lit(" as asked.")))
            .otherwise(F.col("text"))
        )
        return self.raw("conversations").select("conv_id", "turn", raw.alias("raw"))
