"""Value at risk, betas, diversification, attribution and resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions import windows as W
from barweave.functions.mathx import Z
from barweave.operators.cross_section import normal_equations, solve_normal
from barweave.operators.metrics import ROOT, equity_returns
from barweave.session import cut_lineage

# Date series (equity, market) hold one row per calendar date; exact percentiles of
# them are calendar-bounded.


def historical_var(r: str, conf: float, min_n: int = 5) -> Column:
    return F.when(F.count(r) >= min_n, -F.percentile(r, F.lit(1.0 - conf)))


def parametric_var(r: str, conf: float, min_n: int = 5) -> Column:
    z = Z[round(1.0 - conf, 4)]
    sd = F.stddev_samp(r)
    return F.when(F.count(r) >= min_n, F.when(sd > 0, -(F.avg(r) + z * sd)).otherwise(F.greatest(-F.avg(r), F.lit(0.0))))


def var_report(rets: DataFrame, r: str = "r", confs=(0.95, 0.99)) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("conf"), historical_var(r, c).alias("hist_var"), parametric_var(r, c).alias("param_var")).alias(f"c{i}") for i, c in enumerate(confs)]
    g = rets.agg(*cells)
    v = g.select(F.explode(F.array(*[f"c{i}" for i in range(len(confs))])).alias("s")).select("s.*")
    return v


def with_cvar(rets: DataFrame, report: DataFrame, r: str = "r") -> DataFrame:
    """Expected shortfall: mean loss at or beyond the historical VaR."""
    j = rets.select(r, F.lit(1).alias("_k")).join(F.broadcast(report.withColumn("_k", F.lit(1))), "_k")
    c = j.where(F.col(r) <= -F.col("hist_var")).groupBy("conf").agg((-F.avg(r)).alias("cvar"))
    return report.join(F.broadcast(c), "conf", "left")


def rolling_var(rets: DataFrame, conf: float = 0.95, n: int = 252, key="acct") -> DataFrame:
    """Rolling VaR and shortfall with a breach flag against the previous row's VaR."""
    w = W.rows(n, key)
    out = rets.withColumn("var", -W.roll_quantile("r", 1.0 - conf, n, None, key))
    frame = F.collect_list("r").over(w)
    tail = F.filter(frame, lambda v: v <= -F.col("var"))
    out = out.withColumn("_tail", F.when(F.col("var").isNotNull(), tail))
    mean = F.try_divide(F.aggregate("_tail", F.lit(0.0), lambda a, v: a + v), F.nullif(F.size("_tail").cast("double"), F.lit(0.0)))
    out = out.withColumn("cvar", -mean).drop("_tail")
    return out.withColumn("breach", F.coalesce(F.col("r") < -W.lag("var", 1, key), F.lit(False)))


def portfolio_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    return returns.join(weights, "ticker").groupBy("date").agg(F.sum(F.col("weight") * F.col("r")).alias("r"), F.count(F.lit(1)).alias("n_names"))


def coverage(returns: DataFrame, weights: DataFrame) -> DataFrame:
    have = returns.select("ticker").distinct().withColumn("has", F.lit(1))
    return weights.join(have, "ticker", "left").agg(
        F.count(F.lit(1)).alias("n_weights"), F.count("has").alias("n_covered"), F.sum(F.when(F.col("has").isNull(), F.abs("weight")).otherwise(0.0)).alias("missing_weight"))


def hash_draw(n: Column, *seed) -> Column:
    """Deterministic uniform index in [0, n): replays give the same draws, so a lost
    executor changes nothing."""
    return F.pmod(F.xxhash64(*seed), n)


def resampled_var(port: DataFrame, draws: int = 20_000, confs=(0.95, 0.99), seed: int = 42) -> DataFrame:
    """VaR from a date bootstrap.  Draws are generated rows joined to the indexed
    dates; work grows with draws, and the series with the calendar."""
    spark = port.sparkSession
    idx = port.where("r is not null").select("r", (F.row_number().over(Window.orderBy("date")) - 1).alias("i"))
    n = idx.agg(F.count(F.lit(1)).alias("n"))
    d = spark.range(draws).withColumn("_k", F.lit(1)).join(F.broadcast(n.withColumn("_k", F.lit(1))), "_k")
    d = d.select(hash_draw(F.col("n"), F.lit(seed), F.col("id")).alias("i"))
    return var_report(d.join(F.broadcast(idx), "i"), "r", confs).drop("param_var")


def full_beta(rm: DataFrame, min_n: int = 30) -> DataFrame:
    ok = rm.where(F.col("r").isNotNull() & F.col("m").isNotNull())
    return ok.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("r", "m").alias("c"), F.var_pop("m").alias("v")).where(F.col("n") >= min_n).select(
        "ticker", "n", W.safe_div("c", F.nullif(F.col("v"), F.lit(0.0))).alias("beta"))


def diversification(basket_rets: DataFrame, weights: DataFrame, n: int = 60) -> DataFrame:
    """Weighted mean volatility over portfolio volatility, rolling over n dates.

    w'Cov w is the variance of the weighted return itself when the names share
    dates, so no pairwise covariance is formed.
    """
    j = basket_rets.join(F.broadcast(weights), "ticker")
    vol = j.withColumn("_v", W.roll_std("r", n, ddof=0))
    g = vol.groupBy("date").agg(F.sum(F.col("weight") * F.col("_v")).alias("wv"), F.sum(F.col("weight") * F.col("r")).alias("pr"), F.count("_v").alias("n_names"))
    g = g.withColumn("acct", F.lit(1)).withColumn("pv", W.roll_std("pr", n, None, "acct"))
    return g.select("date", "n_names", "wv", "pv", W.safe_div("wv", F.nullif(F.col("pv"), F.lit(0.0))).alias("ratio")).where("ratio is not null")


def diversification_by_date(returns: DataFrame, book: DataFrame, n: int = 60) -> DataFrame:
    """Diversification ratio of each date's own book over the last ``n`` calendar dates.

    The numerator is the sum of |weight| times the name's deviation (population), the
    denominator the deviation (sample) that this book's return would have had, which is
    the root of w'Cov w.  Only days on which every active name has a return count; half
    of ``n`` must be left, and two names.  ``book`` (date, ticker, weight) has few names a
    date; each meets its ``n`` days by index, so no pairs of names or dates are formed.
    """
    cal = returns.select("date").distinct()
    cal = cal.withColumn("idx", F.row_number().over(Window.orderBy("date")))  # one row per calendar date
    r = returns.where(F.col("r").isNotNull()).join(F.broadcast(cal), "date").select("ticker", "idx", "r")
    held = book.where(F.abs("weight") > 1e-6).join(F.broadcast(cal), "date").where(F.col("idx") >= n // 2)
    days = F.explode(F.sequence(F.greatest(F.col("idx") - (n - 1), F.lit(1)), F.col("idx"))).alias("idx")
    x = held.select("date", "ticker", "weight", days).join(r, ["ticker", "idx"])
    names = x.groupBy("date").agg(F.count_distinct("ticker").alias("n_names")).where("n_names >= 2")
    per_day = x.groupBy("date", "idx").agg(F.count(F.lit(1)).alias("_c"), F.sum(F.col("weight") * F.col("r")).alias("pr"))
    whole = per_day.join(names, "date").where(F.col("_c") == F.col("n_names")).select("date", "idx", "pr", "n_names")
    port = whole.groupBy("date", "n_names").agg(F.count(F.lit(1)).alias("n_days"), F.stddev_samp("pr").alias("pv")).where(F.col("n_days") >= n // 2)
    vols = x.join(whole.select("date", "idx"), ["date", "idx"]).groupBy("date", "ticker", "weight").agg(F.stddev_pop("r").alias("_v"))
    wv = vols.groupBy("date").agg(F.sum(F.abs("weight") * F.col("_v")).alias("wv"))
    out = port.join(wv, "date").select("date", "n_names", "n_days", W.safe_div("wv", F.nullif(F.col("pv"), F.lit(0.0))).alias("ratio"))
    return out.where("ratio is not null")


def factor_regression(series: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Multi-factor OLS with t-statistics and R squared from one pass of sums."""
    k = len(xs) + 1
    eq = normal_equations(series.withColumn("_all", F.lit(1)), ["_all"], [F.lit(1.0)] + [F.col(x) for x in xs], F.col(y))
    names = ["alpha", *xs]

    @F.pandas_udf("array<struct<factor:string,coef:double,t_stat:double,r2:double,n:long>>")
    def summary(n: pd.Series, yy: pd.Series, sy: pd.Series, xtx: pd.Series, xty: pd.Series) -> pd.Series:
        out = []
        for n_, yy_, sy_, a, b in zip(n, yy, sy, xtx, xty):
            m = np.zeros((k, k))
            m[np.triu_indices(k)] = np.asarray(a, float)
            m = m + m.T - np.diag(np.diag(m))
            b = np.asarray(b, float)
            inv = np.linalg.pinv(m)
            beta = inv @ b
            rss = max(yy_ - beta @ b, 0.0)
            tss = yy_ - sy_ * sy_ / n_
            se = np.sqrt(np.maximum(np.diag(inv) * rss / max(n_ - k, 1), 0.0))
            r2 = 1 - rss / tss if tss > 0 else None
            out.append([{"factor": f, "coef": float(c), "t_stat": float(c / s) if s > 0 else None, "r2": r2, "n": int(n_)} for f, c, s in zip(names, beta, se)])
        return pd.Series(out)

    return eq.select(F.explode(summary("n", "yy", "sy", "xtx", "xty")).alias("s")).select("s.*")


def rolling_factor_betas(series: DataFrame, y: str, xs: list[str], n: int = 252) -> DataFrame:
    """Rolling multi-factor coefficients: windowed covariances, which are centred in each frame, then one
    small solve per date.  The series has one row per date."""
    w = W.rows(n, "acct")
    k = len(xs)
    s = series.withColumns({"_n": F.count(y).over(w), "_my": F.avg(y).over(w), **{f"_m{i}": F.avg(x).over(w) for i, x in enumerate(xs)}})
    tri = F.array(*[F.covar_pop(xs[i], xs[j]).over(w) for i in range(k) for j in range(i, k)])
    rhs = F.array(*[F.covar_pop(x, y).over(w) for x in xs])
    s = s.withColumns({"xtx": tri, "xty": rhs}).where(F.col("_n") >= n)
    out = solve_normal(s, k, origin=True)
    alpha = F.col("_my") - sum((F.col("coef")[i] * F.col(f"_m{i}") for i in range(k)), F.lit(0.0))
    return out.select("date", *[F.col("coef")[i].alias(f"beta_{x}") for i, x in enumerate(xs)], alpha.alias("alpha"))


def frontier(moments: DataFrame, means: DataFrame, n_candidates: int = 500, cap: float = 0.4, rf: float = 0.0, seed: int = 7) -> DataFrame:
    """Random long-only candidates over a small basket, scored from its moments.

    ``moments`` has one row per ordered pair (a, b, cov) including a = b; the basket
    bounds it.  Weights are normalised exponential draws from a hash.
    """
    spark = moments.sparkSession
    # names of the basket as one array, so candidates explode it instead of crossing
    names = means.agg(F.array_sort(F.collect_list("ticker")).alias("names")).withColumn("_k", F.lit(1))
    c = spark.range(n_candidates).withColumnRenamed("id", "cand").withColumn("_k", F.lit(1)).join(F.broadcast(names), "_k")
    c = c.select("cand", F.explode("names").alias("ticker"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "cand", "ticker"), F.lit(1_000_003)) + 1) / 1_000_004.0
    w = Window.partitionBy("cand")
    c = c.withColumn("_e", -F.ln(u)).withColumn("w", F.col("_e") / F.sum("_e").over(w))
    c = c.withColumn("_mx", F.max("w").over(w)).where(F.col("_mx") <= cap).select("cand", "ticker", "w")
    mu = c.join(F.broadcast(means), "ticker").groupBy("cand").agg(F.sum(F.col("w") * F.col("mu")).alias("ret"))
    left = c.select("cand", F.col("ticker").alias("a"), F.col("w").alias("wa")).join(F.broadcast(moments), "a")
    var = left.join(c.select("cand", F.col("ticker").alias("b"), F.col("w").alias("wb")), ["cand", "b"]).groupBy("cand").agg(F.sum(F.col("wa") * F.col("wb") * F.col("cov")).alias("var"))
    f = mu.join(var, "cand").withColumns({"ann_ret": F.col("ret") * 252, "ann_vol": F.sqrt(F.greatest("var", F.lit(0.0))) * ROOT})
    f = f.withColumn("sharpe", W.safe_div(F.col("ann_ret") - rf, F.nullif(F.col("ann_vol"), F.lit(0.0))))
    best = f.agg(F.max_by("cand", "sharpe").alias("b"), F.min_by("cand", "ann_vol").alias("v"))
    pick = best.select(F.explode(F.array(F.struct(F.lit("best_sharpe").alias("kind"), F.col("b").alias("cand")), F.struct(F.lit("min_var").alias("kind"), F.col("v").alias("cand")))).alias("s")).select("s.*")
    j = F.broadcast(pick).join(f.select("cand", "ann_ret", "ann_vol", "sharpe"), "cand").join(c, "cand")
    return j.select("kind", "ticker", "w", "ann_ret", "ann_vol", "sharpe")


def bootstrap_paths(rets: DataFrame, reps: int, block: int = 1, seed: int = 11) -> DataFrame:
    """``reps`` resampled paths as (rep, pos, r): block starts come from a hash of
    (rep, block number), positions inside a block follow on, wrapping around."""
    spark = rets.sparkSession
    idx = rets.where("r is not null").select("r", (F.row_number().over(Window.orderBy("date")) - 1).alias("i"))
    n = idx.agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.lit(1))
    # every repetition explodes its own positions; only (rep) rows are joined to n
    d = spark.range(reps).withColumnRenamed("id", "rep").withColumn("_k", F.lit(1)).join(F.broadcast(n), "_k")
    d = d.repartition("rep").select("rep", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("pos"))
    start = hash_draw(F.col("n"), F.lit(seed), F.col("rep"), F.floor(F.col("pos") / block))
    d = d.withColumn("i", F.pmod(start + F.col("pos") % block, F.col("n")))
    return d.join(F.broadcast(idx), "i").select("rep", "pos", "r")


def bootstrap_metrics(paths: DataFrame) -> DataFrame:
    w = Window.partitionBy("rep").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    g = paths.withColumn("_l", F.sum(F.log1p("r")).over(w))
    g = g.withColumn("_dd", F.exp(F.col("_l") - F.greatest(F.max("_l").over(w), F.lit(0.0))) - 1)
    a = g.groupBy("rep").agg(
        F.avg("r").alias("m"), F.stddev_pop("r").alias("s"), F.sqrt(F.avg(F.when(F.col("r") < 0, F.col("r") * F.col("r")))).alias("d"),
        F.min("_dd").alias("mdd"), F.sum(F.log1p("r")).alias("lg"), F.count("r").alias("n"))
    ann = F.exp(F.col("lg") * 252 / F.col("n")) - 1
    return a.select(
        "rep", F.coalesce(W.safe_div("m", F.nullif(F.col("s"), F.lit(0.0))) * ROOT, F.lit(0.0)).alias("sharpe"),
        F.coalesce(W.safe_div("m", F.nullif(F.col("d"), F.lit(0.0))) * ROOT, F.lit(0.0)).alias("sortino"),
        F.coalesce(W.safe_div(ann, F.nullif(F.abs("mdd"), F.lit(0.0))), F.lit(0.0)).alias("calmar"), "mdd", (F.exp("lg") - 1).alias("total"))


def confidence_intervals(metrics: DataFrame, cols=("sharpe", "sortino", "calmar"), lo=0.025, hi=0.975) -> DataFrame:
    """Percentile intervals; one value per repetition."""
    cells = [F.struct(F.lit(c).alias("metric"), F.percentile(c, F.lit(lo)).alias("low"), F.median(c).alias("mid"), F.percentile(c, F.lit(hi)).alias("high")).alias(c) for c in cols]
    return metrics.agg(*cells).select(F.explode(F.array(*cols)).alias("s")).select("s.*")


#: Distinct returns of a block, and blocks of a block of blocks.
FAN = 2048


def split_total(k: int, weights: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How ``k`` draws with replacement fall on ``weights``: an exact multinomial.

    A binary tree over the weights is walked from the top; each node gives its left half a binomial
    share of what it got, with the left half's part of its weight, and the right half the rest.
    """
    levels = [np.asarray(weights, dtype=np.float64)]
    while len(levels[-1]) > 1:
        w = levels[-1]
        w = np.append(w, 0.0) if len(w) % 2 else w
        levels[-1] = w
        levels.append(w[::2] + w[1::2])
    counts = np.array([k], dtype=np.int64)
    for total, below in zip(levels[:0:-1], levels[-2::-1]):
        part = np.divide(below[::2], total[: len(below) // 2], out=np.zeros(len(below) // 2), where=total[: len(below) // 2] > 0)
        left = rng.binomial(counts[: len(below) // 2], np.minimum(part, 1.0))
        counts = np.column_stack([left, counts[: len(below) // 2] - left]).ravel()
    return counts[: len(weights)]


def trade_outcomes(trades: DataFrame, reps: int = 200, seed: int = 5, fan: int = FAN) -> DataFrame:
    """Bootstrap of the trade log: log of the compounded return and Sharpe per repetition.

    Trades with one return are exchangeable, so the log collapses to counts per
    distinct return (map-side), and a repetition of as many draws as there are trades is a
    multinomial over them.  It is drawn from the top: the total is split over blocks of blocks,
    each part over blocks, each of those over returns (``split_total``), every split with its own
    seed from repetition and place, so a retry repeats it.  Only sums leave a block.
    """
    counts = cut_lineage(trades.where("ret is not null").groupBy("ret").agg(F.count(F.lit(1)).alias("c")))
    n_blocks = max(1, -(-counts.count() // fan))
    block = F.pmod(F.xxhash64("ret"), F.lit(n_blocks))
    blocks = cut_lineage(counts.groupBy(block.alias("block")).agg(F.sum("c").alias("w"), F.array_sort(F.collect_list(F.struct("ret", "c"))).alias("cells")))
    tops = blocks.groupBy(F.floor(F.col("block") / fan).alias("top")).agg(F.sum("w").alias("w"), F.array_sort(F.collect_list(F.struct(F.col("block").alias("id"), "w"))).alias("cells"))
    root = tops.agg(F.sum("w").alias("k"), F.array_sort(F.collect_list(F.struct(F.col("top").alias("id"), "w"))).alias("cells"))
    generator = lambda key: np.random.Generator(np.random.Philox(int(key) & 0xFFFFFFFFFFFFFFFF))

    @F.pandas_udf("array<struct<id:long,k:long>>")
    def share(key: pd.Series, k: pd.Series, cells: pd.Series) -> pd.Series:
        out = []
        for q, n, c in zip(key, k, cells):
            got = split_total(n, np.array([x["w"] for x in c], dtype=float), generator(q))
            out.append([{"id": int(x["id"]), "k": int(g)} for x, g in zip(c, got) if g])
        return pd.Series(out)

    @F.pandas_udf("array<struct<rep:long,n:long,lg:double,s1:double,s2:double>>")
    def tally(place: pd.Series, drawn: pd.Series, cells: pd.Series) -> pd.Series:
        out = []
        for b, ds, c in zip(place, drawn, cells):
            r, w = np.array([x["ret"] for x in c]), np.array([x["c"] for x in c], dtype=float)
            with np.errstate(divide="ignore"):
                lg = np.log1p(r)
            parts = []
            for d in ds:
                k = split_total(d["k"], w, generator(d["key"]))
                hit = k > 0
                parts.append({"rep": d["rep"], "n": int(k.sum()), "lg": float(k[hit] @ lg[hit]), "s1": float(k @ r), "s2": float(k @ (r * r))})
            out.append(parts)
        return pd.Series(out)

    key = lambda level, place: F.xxhash64(F.lit(seed), F.lit(level), "rep", place)
    spread = trades.sparkSession.range(reps).withColumnRenamed("id", "rep").crossJoin(F.broadcast(root)).where("k is not null")  # one row
    spread = spread.select("rep", F.explode(share(key(0, F.lit(0)), "k", "cells")).alias("s")).select("rep", F.col("s.id").alias("top"), "s.k")
    spread = spread.join(tops.select("top", "cells"), "top").select("rep", F.explode(share(key(1, F.col("top")), "k", "cells")).alias("s")).select("rep", F.col("s.id").alias("block"), "s.k")
    # a block meets all its repetitions at once
    asked = spread.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("rep", "k", key(2, F.col("block")).alias("key")))).alias("drawn"))
    parts = blocks.join(asked, "block").select(F.explode(tally("block", "drawn", "cells")).alias("s")).select("s.*")
    g = parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("n", "lg", "s1", "s2")])
    mean = F.col("s1") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)))
    return g.select("rep", "n", "lg", F.when(sd > 1e-12, mean / F.nullif(sd, F.lit(0.0)) * ROOT).otherwise(0.0).alias("sharpe"))


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Log of the compounded return, so that a long log does not overflow."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("reps"), F.percentile("lg", F.lit(0.05)).alias("log_p05"), F.median("lg").alias("log_p50"),
        F.percentile("lg", F.lit(0.95)).alias("log_p95"), F.avg(F.when(F.col("lg") < 0, 1.0).otherwise(0.0)).alias("prob_loss"), F.median("sharpe").alias("sharpe_p50"))


def equity_return_series(equity: DataFrame) -> DataFrame:
    return equity_returns(equity).where("r is not null")
