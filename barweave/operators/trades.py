"""Trades and equity as set-based jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions import windows as W
from barweave.operators.selection import top_n


def blotter(signals: DataFrame, hold: int = 5, delay: int = 0) -> DataFrame:
    """Signal at a row, entry at the open ``1 + delay`` rows later, exit at the close
    ``hold`` rows after entry; signals too close to the end are dropped."""
    d = 1 + delay
    out = signals.withColumns({
        "entry_date": W.lead("date", d), "entry_price": W.lead("open", d),
        "exit_date": W.lead("date", d + hold), "exit_price": W.lead("close", d + hold),
    })
    out = out.where((F.col("signal") != "Neutral") & F.col("exit_price").isNotNull())
    out = out.withColumn("dir", F.when(F.col("signal") == "Bullish", 1).otherwise(-1))
    return out.withColumn("ret", F.col("dir") * (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price"))


def slip(price: Column, direction: Column, bps: float, entry: bool) -> Column:
    """Worse price on both legs: buys pay up, sells receive less."""
    worse = F.when(direction > 0, bps / 1e4).otherwise(-bps / 1e4)
    return price * (1 + worse) if entry else price * (1 - worse)


def with_slippage(trades: DataFrame, bps: float = 5.0) -> DataFrame:
    d = F.col("dir")
    out = trades.withColumns({"entry_fill": slip(F.col("entry_price"), d, bps, True), "exit_fill": slip(F.col("exit_price"), d, bps, False)})
    return out.withColumn("net_ret", d * (F.col("exit_fill") - F.col("entry_fill")) / F.col("entry_fill"))


def leg_cost(size: Column, commission=2.0, spread=2.0, slippage=1.0) -> Column:
    return F.when(size > 0, size * (commission + spread + slippage) / 10_000.0).otherwise(0.0)


def impact_cost(size: Column, price: Column, adv: Column, k_bps: float = 10.0) -> Column:
    """k * sqrt(shares / ADV) basis points of notional."""
    rel = W.safe_div(W.safe_div(size, F.nullif(price, F.lit(0.0))), F.nullif(adv, F.lit(0.0)))
    return F.coalesce(F.when((size > 0) & (adv > 0), size * k_bps * F.sqrt(rel) / 10_000.0), F.lit(0.0))


def trade_costs(trades: DataFrame, size: float = 10_000.0) -> DataFrame:
    s = F.lit(size)
    return trades.withColumns({
        "leg": leg_cost(s), "round_trip": 2 * leg_cost(s), "impact": impact_cost(s, F.col("entry_price"), F.col("adv"))
    }).withColumn("total_cost", F.col("round_trip") + F.col("impact"))


def barrier_exit(trades: DataFrame, bars_ahead: DataFrame, stop: float, take: float, keys: list[str]) -> DataFrame:
    """First bar inside (entry, exit] whose range holds the stop or the target; the
    stop wins on one bar.

    Outcomes depend only on (ticker, entry, exit, side), so trades collapse to those
    first, map-side; their few days are then looked up by an equi-join.
    """
    lot = trades.groupBy("ticker", "entry_date", "exit_date", "dir").agg(
        F.count(F.lit(1)).alias("n_trades"), F.sum("position_size").alias("notional"), F.max("entry_price").alias("entry_price"))
    lot = lot.withColumns({
        "stop_price": F.col("entry_price") * (1 - F.col("dir") * stop), "take_price": F.col("entry_price") * (1 + F.col("dir") * take)})
    days = lot.withColumn("date", F.explode(F.sequence(F.date_add("entry_date", 1), F.col("exit_date"))))
    hit = days.join(bars_ahead.select("ticker", "date", "low", "high", "close"), ["ticker", "date"], "left")
    s_hit = (F.col("low") <= F.col("stop_price")) & (F.col("stop_price") <= F.col("high"))
    t_hit = (F.col("low") <= F.col("take_price")) & (F.col("take_price") <= F.col("high"))
    event = F.when(s_hit, F.struct(F.col("date"), F.lit("stop_loss").alias("reason"), F.col("stop_price").alias("price"))).when(
        t_hit, F.struct(F.col("date"), F.lit("take_profit").alias("reason"), F.col("take_price").alias("price")))
    seen = F.when(F.col("close").isNotNull(), F.struct("date", "close"))
    g = hit.withColumns({"_e": event, "_s": seen}).groupBy(*keys, "n_trades", "notional", "entry_price").agg(F.min("_e").alias("e"), F.max("_s").alias("s"))
    return g.select(
        *keys, "n_trades", "notional", "entry_price",
        F.coalesce("e.date", "s.date").alias("out_date"),
        F.coalesce("e.price", "s.close").alias("out_price"),
        F.when(F.col("e").isNotNull(), F.col("e.reason")).otherwise("time").alias("reason"),
    )


def overlay_stops(book: DataFrame, hold: int, stop: float, take: float) -> DataFrame:
    """Stops over a fixed-hold blotter.  The rows ahead are known positions, so a
    chain of leads replaces the range join.  ``book`` still has every bar row."""
    up = F.col("dir") > 0
    stop_px = F.when(up, F.col("entry_price") * (1 - stop)).otherwise(F.col("entry_price") * (1 + stop))
    take_px = F.when(up, F.col("entry_price") * (1 + take)).otherwise(F.col("entry_price") * (1 - take))
    out = book.withColumns({"stop_px": stop_px, "take_px": take_px})
    ev = []
    for k in range(2, hold + 2):
        lo, hi = F.col(f"_lo{k}"), F.col(f"_hi{k}")
        ev.append(F.when((lo <= F.col("stop_px")) & (F.col("stop_px") <= hi), F.struct(F.col(f"_d{k}").alias("d"), F.lit("stop_loss").alias("why"), F.col("stop_px").alias("px")))
                  .when((lo <= F.col("take_px")) & (F.col("take_px") <= hi), F.struct(F.col(f"_d{k}").alias("d"), F.lit("take_profit").alias("why"), F.col("take_px").alias("px"))))
    out = out.withColumn("_ev", F.coalesce(*ev))
    out = out.withColumns({
        "exit_reason": F.coalesce("_ev.why", F.lit("time")), "out_date": F.coalesce("_ev.d", "exit_date"), "out_price": F.coalesce("_ev.px", "exit_price")})
    return out.withColumn("out_ret", F.col("dir") * (F.col("out_price") - F.col("entry_price")) / F.col("entry_price"))


def bars_ahead(signals: DataFrame, hold: int) -> DataFrame:
    cols = {}
    for k in range(2, hold + 2):
        cols |= {f"_lo{k}": W.lead("low", k), f"_hi{k}": W.lead("high", k), f"_d{k}": W.lead("date", k)}
    return signals.withColumns(cols)


#: Trades a task of the daily holdings takes on average.
TASK_TRADES = 500_000


def holdings(trade_log: DataFrame, keys=("ticker", "date", "direction")) -> DataFrame:
    """Daily holdings: each trade counts on every date from entry to exit.

    Trades collapse to (ticker, entry, exit, side) first; a hold spans a few days, so the
    interval join is then an explode of those days.  Both steps are dealt into parts whose number follows
    the trades, so a task's tables stay of one size; the days of a ticker are in one part and
    are added up there.
    """
    log = trade_log.select("ticker", "entry_date", "exit_date", "direction", "position_size")
    parts = max(log.sparkSession.sparkContext.defaultParallelism, -(-log.count() // TASK_TRADES))
    hold = ["ticker", "entry_date", "exit_date", "direction"]
    lots = log.repartition(parts, *hold).groupBy(*hold).agg(F.sum("position_size").alias("_v"), F.count(F.lit(1)).alias("_n"))
    days = lots.repartition(parts, "ticker").withColumn("date", F.explode(F.sequence("entry_date", "exit_date")))
    return days.groupBy(*keys).agg(F.sum("_v").alias("value"), F.sum("_n").alias("n_lots"), F.sum(F.col("_v") * F.col("direction")).alias("net"), F.sum(F.when(F.col("direction") < 0, F.col("_v")).otherwise(0.0)).alias("short"))


def daily_book(trade_log: DataFrame, equity: DataFrame, borrow_bps: float = 50.0) -> DataFrame:
    """Realised profit, equity, names held, exposures and borrow cost per date."""
    # both sides of a name are one row by now, so names are counted without a set of them
    h = holdings(trade_log, ("ticker", "date")).groupBy("date").agg(
        F.count(F.lit(1)).alias("n_positions"), F.sum("value").alias("_g"), F.sum("net").alias("_n"), F.sum("short").alias("_s"))
    j = equity.join(h, "date", "left")
    return j.select(
        "date", "pnl", "equity", F.coalesce("n_positions", F.lit(0)).alias("n_positions"),
        F.coalesce(F.col("_g") / F.col("equity"), F.lit(0.0)).alias("gross"), F.coalesce(F.col("_n") / F.col("equity"), F.lit(0.0)).alias("net"),
        F.coalesce(F.col("_s") * (borrow_bps / 10_000.0 / 252.0), F.lit(0.0)).alias("borrow_cost"))


def top_k_daily(scored: DataFrame, x: str, fwd: str, k: int = 5, min_k: int = 1) -> DataFrame:
    """Mean forward return of the top k positive scores; too few names is cash (0)."""
    ok = scored.where(F.col(x).isNotNull() & F.col(fwd).isNotNull())
    days = ok.select("date").distinct()
    top = top_n(ok.where(F.col(x) > 0), k, [F.desc(x), F.col("ticker")], out="_r")
    g = top.groupBy("date").agg(F.avg(fwd).alias("_m"), F.count(F.lit(1)).alias("n_held"))
    j = days.join(g, "date", "left")
    invested = F.coalesce(F.col("n_held") >= min_k, F.lit(False))
    return j.select("date", F.coalesce("n_held", F.lit(0)).alias("n_held"), invested.alias("invested"), F.when(invested, F.col("_m")).otherwise(0.0).alias("ret"))


def diagnostics(trade_log: DataFrame, cost_bps: float = 5.0) -> DataFrame:
    cost = F.col("position_size") * (2 * cost_bps / 10_000.0)
    long, short = F.col("direction") > 0, F.col("direction") < 0
    return trade_log.agg(
        F.avg(F.when(long, F.col("pnl"))).alias("avg_long"), F.avg(F.when(short, F.col("pnl"))).alias("avg_short"),
        F.avg(cost / (F.abs("pnl") + 1e-8)).alias("cost_share"), F.avg(F.when(short, 1.0).otherwise(0.0)).alias("short_frac"),
        F.sum(F.when(long, F.col("pnl")).otherwise(0.0)).alias("long_pnl"), F.sum(F.when(short, F.col("pnl")).otherwise(0.0)).alias("short_pnl"), F.sum(cost).alias("costs"))


def pnl_decomposition(trade_log: DataFrame, cost_bps: float = 5.0) -> DataFrame:
    """Cumulative long, short and cost contributions by exit date."""
    daily = trade_log.groupBy(F.col("exit_date").alias("date")).agg(
        F.sum(F.when(F.col("direction") > 0, F.col("pnl")).otherwise(0.0)).alias("_l"),
        F.sum(F.when(F.col("direction") < 0, F.col("pnl")).otherwise(0.0)).alias("_s"),
        F.sum(-F.col("position_size") * (2 * cost_bps / 10_000.0)).alias("_c")).withColumn("acct", F.lit(1))
    w = Window.partitionBy("acct").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per date
    return daily.select("date", F.sum("_l").over(w).alias("long_pnl"), F.sum("_s").over(w).alias("short_pnl"), F.sum("_c").over(w).alias("cost_drag"))


def no_trade_band(target: DataFrame, current: DataFrame, band: float = 0.015, drift: float = 0.05) -> DataFrame:
    """Names whose weight moves beyond the band, and whether the date's total such
    drift justifies a rebalance.  Books are bounded by their slots."""
    j = target.join(current, ["ticker", "date"])
    j = j.withColumn("diff", F.round(F.abs(F.abs("target_weight") - F.abs("current_weight")), 9))
    w = Window.partitionBy("date")
    tot = F.sum(F.when(F.col("diff") > band, F.col("diff")).otherwise(0.0)).over(w)
    return j.withColumns({"outside": F.col("diff") > band, "total_drift": tot}).withColumn("rebalance", F.col("total_drift") > drift)
