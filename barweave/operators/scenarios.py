"""Scenario sweeps: a scenario is a column, so one job covers the whole grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions import windows as W
from barweave.operators import metrics as M


def grid_columns(params: dict[str, list]) -> Column:
    """Every combination of the parameters as one array of structs."""
    names = list(params)

    def build(i: int, chosen: dict) -> list:
        if i == len(names):
            return [F.struct(*[F.lit(v).alias(n) for n, v in chosen.items()])]
        return [s for v in params[names[i]] for s in build(i + 1, {**chosen, names[i]: v})]

    return F.array(*build(0, {}))


def with_grid(df: DataFrame, params: dict[str, list], keep: str | None = None) -> DataFrame:
    """Each row under every scenario that passes the constraint."""
    out = df.withColumn("_g", F.explode(grid_columns(params))).select(*df.columns, "_g.*")
    return out.where(keep) if keep else out


def cost_sensitivity(trades: DataFrame, slippage: list[float], commission: list[float]) -> DataFrame:
    """Net results per (slippage, commission).  Trades are aggregated once: the net
    moments follow from gross sums, and only the grid is exploded."""
    g = trades.agg(F.count("ret").alias("n"), F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"), F.sum("pnl").alias("_p"), F.sum("position_size").alias("_v"))
    x = with_grid(g, {"slippage_bps": slippage, "commission_bps": commission})
    cost = 2 * (F.col("slippage_bps") + F.col("commission_bps")) / 10_000.0
    return x.select("slippage_bps", "commission_bps", "n", (F.col("_m") - cost).alias("net_return"),
                    W.safe_div(F.col("_m") - cost, F.nullif(F.col("_s"), F.lit(0.0))).alias("net_ratio"), (F.col("_p") - F.col("_v") * cost).alias("net_pnl"))


def holding_sweep(signals: DataFrame, holds: list[int]) -> DataFrame:
    """Mean trade return per holding period; all leads share one window pass."""
    entry = W.lead("open", 1)
    d = F.when(F.col("signal") == "Bullish", 1).when(F.col("signal") == "Bearish", -1)
    s = signals.withColumn("_e", entry).withColumns({f"_x{h}": W.lead("close", 1 + h) for h in holds})
    aggs = [F.struct(F.lit(h).alias("hold"), F.count(d * F.col(f"_x{h}")).alias("n"), F.avg(d * (F.col(f"_x{h}") - F.col("_e")) / F.col("_e")).alias("avg_return"),
                     M.win_rate(F.when(F.col(f"_x{h}").isNotNull() & d.isNotNull(), d * (F.col(f"_x{h}") - F.col("_e")))).alias("_w")).alias(f"h{h}") for h in holds]
    out = s.where(d.isNotNull()).agg(*aggs).select(F.explode(F.array(*[f"h{h}" for h in holds])).alias("s")).select("s.*")
    return out.drop("_w")


def threshold_sweep(signals: DataFrame, x: str, fwd: str, cuts: list[float]) -> DataFrame:
    """Fired rows and signed mean forward return per threshold, in one pass."""
    f = F.col(x)
    aggs = []
    for i, c in enumerate(cuts):
        hit = F.when((F.abs(f) > c) & F.col(fwd).isNotNull(), F.signum(f) * F.col(fwd))
        aggs.append(F.struct(F.lit(c).alias("threshold"), F.count(hit).alias("n"), F.avg(hit).alias("avg_return")).alias(f"c{i}"))
    return signals.agg(*aggs).select(F.explode(F.array(*[f"c{i}" for i in range(len(cuts))])).alias("s")).select("s.*")


def top_k_sweep(scored: DataFrame, x: str, fwd: str, ks: list[int]) -> DataFrame:
    """Mean daily return of the top k for each k, ranking each date once to max k."""
    ok = scored.where((F.col(x) > 0) & F.col(fwd).isNotNull())
    rn = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(x), "ticker"))
    top = ok.withColumn("_r", rn).where(F.col("_r") <= max(ks))
    daily = top.groupBy("date").agg(*[F.avg(F.when(F.col("_r") <= k, F.col(fwd))).alias(f"k{k}") for k in ks])
    cells = [F.struct(F.lit(k).alias("top_k"), F.count(f"k{k}").alias("n_days"), F.avg(f"k{k}").alias("mean_ret"),
                      (W.safe_div(F.avg(f"k{k}"), F.nullif(F.stddev_samp(f"k{k}"), F.lit(0.0))) * M.ROOT).alias("sharpe")).alias(f"s{k}") for k in ks]
    return daily.agg(*cells).select(F.explode(F.array(*[f"s{k}" for k in ks])).alias("s")).select("s.*")


def smoothing_sweep(scored: DataFrame, x: str, fwd: str, spans: list[int]) -> DataFrame:
    """IC of the score under several smoothing spans, one pass of ewm columns."""
    from barweave.functions.mathx import corr_of

    s = reduce(lambda d, k: W.add_ewm(d, x, k, min(3, k), f"_s{k}"), spans, scored)
    cells = [F.struct(F.lit(k).alias("span"), F.count(F.col(f"_s{k}") + F.col(fwd)).alias("n"), corr_of(f"_s{k}", fwd).alias("ic")).alias(f"c{k}") for k in spans]
    return s.agg(*cells).select(F.explode(F.array(*[f"c{k}" for k in spans])).alias("s")).select("s.*")


def pick_configs(results: DataFrame, constraints: list[Column], by: str, n: int) -> DataFrame:
    ok = reduce(lambda d, c: d.where(c), constraints, results)
    return ok.orderBy(F.desc(by), *[c for c in results.columns if c != by]).limit(n)


def period_comparison(equity: DataFrame, cut: str, min_ratio: float = 0.5) -> DataFrame:
    """In-sample against out-of-sample Sharpe and return, with a verdict per period."""
    r = M.equity_returns(equity).where("r is not null")
    p = F.when(F.col("date") < F.lit(cut).cast("date"), "in_sample").otherwise("out_of_sample")
    g = r.groupBy(p.alias("period")).agg(F.count("r").alias("n"), (W.safe_div(F.avg("r"), F.nullif(F.stddev_pop("r"), F.lit(0.0))) * M.ROOT).alias("sharpe"), (F.exp(F.sum(F.log1p("r"))) - 1).alias("total"))
    base = F.max(F.when(F.col("period") == "in_sample", F.col("sharpe"))).over(Window.partitionBy(F.lit(1)))  # two rows
    return g.withColumn("passed", F.col("sharpe") >= min_ratio * base)
