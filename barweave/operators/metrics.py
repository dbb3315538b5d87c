"""Performance aggregates over trades and the daily equity curve.

Trade tables are unbounded and only ever aggregated with map-side combined
functions.  Equity curves hold one row per calendar date, so ordered windows over
them are bounded by the calendar.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions import windows as W
from barweave.functions.ranks import exact_quantiles

ROOT = math.sqrt(252.0)


def acct_window():
    return Window.partitionBy("acct").orderBy("date")


def win_rate(r: Column) -> Column:
    return F.avg(F.when(r > 0, 1.0).otherwise(0.0))


def profit_factor(p: Column) -> Column:
    """Null when there are no losses (a portable stand-in for infinity)."""
    return W.safe_div(F.sum(F.when(p > 0, p).otherwise(0.0)), F.nullif(F.sum(F.when(p < 0, -p).otherwise(0.0)), F.lit(0.0)))


def trade_stats(trades: DataFrame, keys: list[str] = ()) -> DataFrame:
    r, d = F.col("ret"), F.col("holding_days")
    hit = ((F.col("signal") == "Bullish") & (r > 0)) | ((F.col("signal") == "Bearish") & (r < 0))
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"), win_rate(r).alias("win_rate"), F.avg(r).alias("avg_return"),
        profit_factor(F.col("pnl")).alias("profit_factor"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("accuracy"),
        # holding days are few distinct integers, and the exact median keeps value counts only
        F.round(F.avg(d), 1).alias("hold_mean"), F.median(d).alias("hold_median"), F.min(d).alias("hold_min"), F.max(d).alias("hold_max"))


def trade_ratios(trades: DataFrame, hold: int = 5) -> DataFrame:
    r = F.col("ret")
    k = math.sqrt(252.0 / hold)
    g = trades.agg(F.avg(r).alias("m"), F.stddev_samp(r).alias("s"), F.sqrt(F.avg(F.when(r < 0, r * r))).alias("d"), F.count(r).alias("n"))
    return g.select(
        F.when(F.col("n") >= 2, F.coalesce(W.safe_div("m", F.nullif(F.col("s"), F.lit(0.0))) * k, F.lit(0.0))).otherwise(0.0).alias("sharpe"),
        F.when(F.col("n") >= 2, W.safe_div("m", F.nullif(F.col("d"), F.lit(0.0))) * k).otherwise(0.0).alias("sortino"))


def equity_returns(equity: DataFrame) -> DataFrame:
    return equity.withColumn("r", W.pct_change("equity", 1, "acct"))


def equity_sharpe(equity: DataFrame, ddof: int = 0, min_n: int = 10) -> DataFrame:
    sd = F.stddev_samp("r") if ddof else F.stddev_pop("r")
    g = equity_returns(equity).agg(F.count("r").alias("n"), F.avg("r").alias("m"), sd.alias("s"))
    ok = (F.col("n") >= min_n) & (F.col("s") > 0)
    return g.select("n", F.when(ok, W.safe_div("m", F.nullif(F.col("s"), F.lit(0.0))) * ROOT).otherwise(0.0).alias("equity_sharpe"))


def drawdowns(equity: DataFrame, x: str = "equity") -> DataFrame:
    peak = F.max(x).over(W.expanding("acct"))
    return equity.withColumn("peak", peak).withColumn("dd", (F.col(x) - F.col("peak")) / F.col("peak"))


def max_drawdown(equity: DataFrame) -> DataFrame:
    """From the curve itself and from its compounded returns."""
    r = equity_returns(equity).withColumn("growth", F.exp(F.sum(F.log1p(F.coalesce("r", F.lit(0.0)))).over(W.expanding("acct"))))
    a = drawdowns(equity).agg(F.min("dd").alias("max_drawdown"))
    b = drawdowns(r, "growth").agg(F.min("dd").alias("max_drawdown_returns"))
    return one_row(a, b)


def one_row(*frames: DataFrame) -> DataFrame:
    """Glue single-row frames side by side."""
    keyed = [f.withColumn("_one", F.lit(1)) for f in frames]
    return reduce(lambda a, b: a.join(F.broadcast(b), "_one"), keyed).drop("_one")


def drawdown_spells(equity: DataFrame) -> DataFrame:
    """Depth and calendar length of each spell below the peak; an open last spell
    counts."""
    dd = drawdowns(equity)
    below = F.col("dd") < 0
    isl = F.sum(F.when(below, 0).otherwise(1)).over(W.expanding("acct"))
    s = dd.withColumn("_isl", isl).where(below).groupBy("_isl").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.min("dd").alias("depth"))
    return s.select("start", "end", "depth", F.datediff("end", "start").alias("days"))


def spell_summary(equity: DataFrame) -> DataFrame:
    return drawdown_spells(equity).agg(
        F.coalesce(F.max("days"), F.lit(0)).alias("max_duration"), F.coalesce(F.avg("depth"), F.lit(0.0)).alias("avg_drawdown"),
        F.coalesce(F.avg("days"), F.lit(0.0)).alias("avg_duration"))


def growth(equity: DataFrame, initial: float = 100_000.0) -> DataFrame:
    g = equity.agg(
        F.min_by("equity", "date").alias("e0"), F.max_by("equity", "date").alias("e1"), F.datediff(F.max("date"), F.min("date")).alias("days"))
    m = drawdowns(equity).agg(F.abs(F.min("dd")).alias("mdd"))
    j = one_row(g, m)
    yr = 365.25 / F.nullif(F.col("days"), F.lit(0))
    ann = F.pow(F.col("e1") / initial, yr) - 1
    return j.select(
        (F.pow(F.col("e1") / F.col("e0"), yr) - 1).alias("cagr"), ann.alias("annual_return"),
        W.safe_div(ann, F.nullif(F.col("mdd"), F.lit(0.0))).alias("calmar"))


def turnover(trades: DataFrame, capital: float = 100_000.0, cost_bps: float = 10.0) -> DataFrame:
    """Entry plus exit notional per day over capital.  Both legs go through one
    aggregate as exploded (date, notional) pairs."""
    legs = trades.select(F.explode(F.array("entry_date", "exit_date")).alias("date"), "position_size")
    daily = legs.groupBy("date").agg(F.sum("position_size").alias("v"))
    g = daily.agg((F.avg(F.abs("v")) / capital).alias("avg_daily"))
    return g.select("avg_daily", (F.col("avg_daily") * 252).alias("annualised"), (F.col("avg_daily") * 252 * cost_bps).alias("drag_bps"))


def corrected_turnover(trades: DataFrame, equity: DataFrame, years: float) -> DataFrame:
    """Entry and exit weights against the equity of their own dates.  Trades reduce
    to per-day notionals before they meet the curve."""
    legs = trades.where("position_size > 0").select(
        "entry_date", "exit_date", F.col("position_size").alias("pe"), F.abs(F.col("position_size") * (1 + F.col("ret"))).alias("px"))
    eq = F.broadcast(equity.where("equity > 0").select("date", "equity"))
    # both dates of a trade must have equity, so days pair up before they are summed
    pairs = legs.groupBy("entry_date", "exit_date").agg(F.sum("pe").alias("pe"), F.sum("px").alias("px"), F.count(F.lit(1)).alias("n"))
    j = pairs.join(eq.select(F.col("date").alias("entry_date"), F.col("equity").alias("ee")), "entry_date")
    j = j.join(eq.select(F.col("date").alias("exit_date"), F.col("equity").alias("xe")), "exit_date")
    t = j.agg(F.sum((F.col("pe") / F.col("ee") + F.col("px") / F.col("xe")) / 2).alias("_t"), F.sum("n").alias("n_matched"))
    allt = trades.agg(F.count(F.lit(1)).alias("_n"), F.avg(F.abs("position_size")).alias("_p"))
    ave = equity.agg(F.avg("equity").alias("avg_equity"))
    return one_row(t, allt, ave).select(
        (F.col("_t") / years).alias("annualised"), (F.col("_t") / years / 252).alias("avg_daily"), "n_matched", "avg_equity",
        (F.col("_n") * 2).alias("position_changes"), (F.col("_n") / years * F.col("_p") / F.col("avg_equity")).alias("size_based"))


def benchmark_metrics(equity: DataFrame, market: DataFrame, rf: float = 0.04, min_n: int = 20) -> DataFrame:
    """Beta, annual alpha, Treynor and information ratio against a market series
    carried onto the equity dates."""
    e = equity_returns(equity).select("acct", "date", "r").where("r is not null")
    j = e.join(F.broadcast(market.select("date", "m")), "date", "left")
    both = W.by_key("acct")
    m = F.coalesce(
        F.last("m", ignorenulls=True).over(both.rowsBetween(Window.unboundedPreceding, 0)),
        F.first("m", ignorenulls=True).over(both.rowsBetween(0, Window.unboundedFollowing)), F.lit(0.0))
    g = j.withColumn("mm", m).agg(
        F.count("r").alias("n"), F.avg("r").alias("ar"), F.avg("mm").alias("am"), F.var_samp("mm").alias("v"),
        F.covar_samp("r", "mm").alias("c"), F.stddev_samp(F.col("r") - F.col("mm")).alias("te"))
    ok = (F.col("n") >= min_n) & (F.col("v") > 1e-12)
    beta = F.when(ok, W.safe_div("c", F.nullif(F.col("v"), F.lit(0.0))))
    alpha = (F.col("ar") - beta * F.col("am")) * 252
    return g.select(
        beta.alias("beta"), alpha.alias("alpha"), W.safe_div(F.col("ar") * 252 - rf, F.nullif(beta, F.lit(0.0))).alias("treynor"),
        W.safe_div(alpha, F.nullif(F.col("te") * ROOT, F.lit(0.0))).alias("information_ratio"))


def all_metrics(trades: DataFrame, equity: DataFrame, market: DataFrame) -> DataFrame:
    return one_row(trade_stats(trades), trade_ratios(trades), equity_sharpe(equity).drop("n"), max_drawdown(equity).select("max_drawdown"),
                   spell_summary(equity), growth(equity), turnover(trades).select(F.col("annualised").alias("turnover")), benchmark_metrics(equity, market))


def yearly_returns(equity: DataFrame) -> DataFrame:
    y = equity.groupBy(F.year("date").alias("year")).agg(F.min_by("equity", "date").alias("e0"), F.max_by("equity", "date").alias("e1"))
    return y.select("year", (F.col("e1") / F.col("e0") - 1).alias("ret"))


def monthly_returns(equity: DataFrame) -> DataFrame:
    m = equity.groupBy("acct", F.trunc("date", "month").alias("date")).agg(F.max_by("equity", "date").alias("equity"))
    return equity_returns(m).where("r is not null")


def monthly_summary(equity: DataFrame) -> DataFrame:
    """Mean, deviation, bias-corrected skew and counts of outlier months."""
    m = monthly_returns(equity)
    s = m.agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.skewness("r").alias("_g"), F.count("r").alias("n"))
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("_g") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    out = one_row(m.select("r"), s).agg(
        F.count_if((F.abs((F.col("r") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))) >= 3) | (F.abs("r") >= 0.10)).alias("outliers"))
    return one_row(s.select("mean", "std", skew.alias("skew"), "n"), out)


def curve_series(equity: DataFrame, n: int = 252, short: int = 60) -> DataFrame:
    """Curve rebased to 100k, rolling Sharpe (population) and a shorter rolling
    Sharpe (sample, half the window is enough)."""
    e = equity_returns(equity)
    first = F.first("equity").over(W.expanding("acct"))

    def sharpe(k, m, ddof):
        sd = F.nullif(W.roll_std("r", k, m, "acct", "date", ddof), F.lit(0.0))
        return W.safe_div(W.roll_mean("r", k, m, "acct"), sd) * ROOT

    return e.withColumns({"curve": F.round(F.col("equity") / first * 100_000.0, 4), "sharpe_252": sharpe(n, n, 0), "sharpe_60": sharpe(short, short // 2, 1)})


def sharpe_by_regime(equity: DataFrame, regimes: DataFrame) -> DataFrame:
    r = equity_returns(equity).where("r is not null").join(F.broadcast(regimes.select("date", "regime")), "date", "left").fillna("Sideways", subset=["regime"])
    g = r.groupBy("regime").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.count("r").alias("n"))
    return g.select("regime", "n", (W.safe_div("m", F.nullif(F.col("s"), F.lit(0.0))) * ROOT).alias("sharpe"))


def regime_signal_rollup(trades: DataFrame) -> DataFrame:
    """Trade table by regime and signal with subtotals; 'ALL' marks a subtotal."""
    g = trades.rollup("regime", "signal").agg(
        F.count(F.lit(1)).alias("n"), win_rate(F.col("ret")).alias("win_rate"), F.avg("pnl").alias("avg_pnl"),
        profit_factor(F.col("pnl")).alias("profit_factor"), F.count_if(F.col("direction") > 0).alias("longs"), F.count_if(F.col("direction") < 0).alias("shorts"))
    return g.fillna("ALL", subset=["regime", "signal"])


def score_bins(trades: DataFrame, x: str, bins: int = 5) -> DataFrame:
    """Attribution by quantile bin of the score, exact edges, right-closed bins.
    Edges are one row."""
    probs = {f"_q{i}": i / bins for i in range(1, bins)}
    edges = exact_quantiles(trades.select(x), [], x, probs)
    j = trades.withColumn("_one", F.lit(1)).join(F.broadcast(edges.withColumn("_one", F.lit(1))), "_one")
    b = reduce(lambda a, q: a + F.when(F.col(x) > F.col(q), 1).otherwise(0), probs, F.lit(1))
    return j.withColumn("bin", b).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ret").alias("avg_return"), win_rate(F.col("ret")).alias("win_rate"), profit_factor(F.col("pnl")).alias("profit_factor"))


def signal_counts(signals: DataFrame, classes=("Bullish", "Bearish", "Neutral")) -> DataFrame:
    return signals.groupBy("date").pivot("signal", list(classes)).agg(F.count(F.lit(1))).fillna(0)


def dashboard_summary(trades: DataFrame, equity: DataFrame) -> DataFrame:
    t = trades.agg(F.count(F.lit(1)).alias("n_trades"), win_rate(F.col("ret")).alias("win_rate"), F.sum("pnl").alias("total_pnl"))
    e = equity.agg(F.max_by("equity", "date").alias("final_equity"), F.max("equity").alias("peak_equity"))
    return one_row(t, e)


def sanity_gates(trades: DataFrame, book: DataFrame, strict=True) -> DataFrame:
    lim = {"trades": 30, "tickers": 5, "flat": 0.8} if strict else {"trades": 5, "tickers": 2, "flat": 0.95}
    t = trades.agg(F.count(F.lit(1)).alias("n_trades"), F.count_distinct("ticker").alias("n_tickers"), F.count_if(F.col("direction") < 0).alias("n_shorts"))
    b = book.agg(F.max("n_positions").alias("max_positions"), F.avg(F.when(F.col("n_positions") == 0, 1.0).otherwise(0.0)).alias("flat_share"))
    j = one_row(t, b)
    return j.withColumns({"enough_trades": F.col("n_trades") >= lim["trades"], "enough_tickers": F.col("n_tickers") >= lim["tickers"], "invested": F.col("flat_share") <= lim["flat"]})


def signal_funnel(bars: DataFrame, signals: DataFrame, entries: DataFrame) -> DataFrame:
    a = bars.agg(F.count_distinct("ticker").alias("with_data"))
    b = signals.agg(F.count_distinct("ticker").alias("with_signals"), F.count_distinct(F.when(F.col("signal") != "Neutral", F.col("ticker"))).alias("non_neutral"))
    c = entries.groupBy("date").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("entries_mean"), F.max("n").alias("entries_max"))
    return one_row(a, b, c)


def option_report(priced: DataFrame) -> DataFrame:
    """Options at entry by regime: mean call cost, hedge cost and stock vs call profit."""
    return priced.groupBy("regime").agg(
        F.count(F.lit(1)).alias("n"), F.avg("atm_call").alias("avg_call"), F.sum("put_hedge").alias("hedge_cost"),
        F.sum(F.col("exit_price") - F.col("entry_price")).alias("stock_pnl"),
        F.sum(F.greatest(F.col("exit_price") - F.col("entry_price"), F.lit(0.0)) - F.col("atm_call")).alias("call_pnl"))
