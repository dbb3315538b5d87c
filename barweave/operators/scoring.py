"""Scores, thresholds and signal labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.functions import windows as W
from barweave.functions.mathx import clip, round_half_up
from barweave.operators import features as T
from barweave.functions.ranks import rank_together
from barweave.operators.cross_section import classify
from barweave.session import written


def linear(weights: dict[str, float], intercept: float = 0.0, default: float = 0.0) -> Column:
    """Weighted sum of columns; zero weights are left out, so unused feature
    windows are pruned from the plan."""
    return reduce(
        lambda a, kv: a + F.coalesce(F.col(kv[0]), F.lit(default)) * kv[1],
        [kv for kv in weights.items() if kv[1] != 0.0],
        F.lit(float(intercept)),
    )


def linear_score(df: DataFrame, weights: dict[str, float], intercept=0.0, scale=1.0, direction=1.0) -> DataFrame:
    return df.withColumn("score", linear(weights, intercept) * scale * direction)


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row of column means and population deviations (0 becomes 1)."""
    return df.agg(
        *[F.avg(c).alias(f"_mu_{c}") for c in cols],
        *[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"_sd_{c}") for c in cols],
    )


def standardised_score(df: DataFrame, scaler: DataFrame, weights: dict[str, float], intercept=0.0) -> DataFrame:
    """Linear score on (x - mean) / scale; the scaler is a single row."""
    one = F.lit(1)
    j = df.withColumn("_k", one).join(F.broadcast(scaler.withColumn("_k", one)), "_k").drop("_k")
    z = {c: (F.col(c) - F.col(f"_mu_{c}")) / F.col(f"_sd_{c}") for c in weights}
    return j.withColumn("score", reduce(lambda a, kv: a + F.coalesce(z[kv[0]], F.lit(0.0)) * kv[1], weights.items(), F.lit(intercept)))


def regime_score(df: DataFrame, sets: dict[str, dict[str, float]], default: dict[str, float]) -> DataFrame:
    """Weights chosen by the row's regime, a default set for the rest."""
    out = None
    for label, weights in sets.items():
        cond = F.col("regime") == label
        out = F.when(cond, linear(weights)) if out is None else out.when(cond, linear(weights))
    return df.withColumn("score", out.otherwise(linear(default)))


def rule_score(df: DataFrame) -> DataFrame:
    """Trend times confidence plus sentiment times impact terms, 4 decimals."""
    s = F.col("trend_score") * F.col("conf_mult")
    for k in ("regional", "global", "social"):
        s = s + F.coalesce(F.col(f"{k}_sentiment") * F.col(f"{k}_impact"), F.lit(0.0))
    return df.withColumn("adjusted_score", round_half_up(s, 4))


def direction(x: Column, cut: float = 0.1) -> Column:
    return F.when(x >= cut, "Bullish").when(x <= -cut, "Bearish").otherwise("Neutral")


def ten_scale(x: Column) -> Column:
    return round_half_up(1.0 + (x + 1.0) / 2.0 * 9.0, 2)


def cost_threshold(vol_pct: Column, base=0.5, commission=10.0, spread=5.0, slippage=5.0, hold=5) -> Column:
    """Least |score| worth trading: base plus round-trip cost per day held plus a
    widening in high-volatility regimes.  Row-wise, so no look-ahead."""
    per_day = (commission + spread + slippage) * 2.0 / 10_000.0 / max(1, hold)
    widen = F.greatest((F.coalesce(vol_pct, F.lit(0.5)) - 0.5) * 0.2, F.lit(0.0))
    return F.greatest(F.lit(float(base)), base + per_day * 100.0 + widen)


def signal_frame(scored: DataFrame, x: str = "trend_score", span: int = 5, base: float = 0.3, **costs) -> DataFrame:
    """Smoothed score, causal cost-aware thresholds, label and numeric confidence."""
    s = T.smooth(scored.withColumn("adjusted_score", F.col(x)), "adjusted_score", span)
    s = s.withColumn("bull_threshold", cost_threshold(F.col("vol_percentile"), base, **costs))
    s = s.withColumn("bear_threshold", -F.col("bull_threshold"))
    return s.withColumns({
        "signal": classify(F.col("smoothed_score"), F.col("bull_threshold"), F.col("bear_threshold")),
        "confidence_numeric": clip(F.abs(clip(F.col("adjusted_score"), -1.0, 1.0)), 0.3, 0.95),
    })


def member_score(p: Column, kind: str) -> Column:
    """Model output on a common sign: classifiers 2p-1, short classifiers -(2p-1)."""
    return {"classifier": 2.0 * p - 1.0, "short_classifier": -(2.0 * p - 1.0)}.get(kind, p)


def ensemble(df: DataFrame, members: dict[str, tuple[str, float]], mode: str = "rank") -> DataFrame:
    """Weighted mean of member predictions after per-date ranking (missing 0.5),
    expanding z-scores, or clipping."""
    total = sum(max(0.0, w) for _, w in members.values())
    out, terms = df.withColumns({f"_m_{c}": F.round(member_score(F.col(c), kind), 10) for c, (kind, _) in members.items()}), []
    if mode == "rank":
        out = rank_together(written(out, "members"), ["date"], {f"_n_{c}": f"_m_{c}" for c in members})
    for c, (_, w) in members.items():
        if mode == "rank":
            v = F.coalesce(F.col(f"_n_{c}"), F.lit(0.5))
        elif mode == "zscore":
            out = T.expanding_zscore(out, f"_m_{c}", f"_n_{c}")
            v = F.col(f"_n_{c}")
        else:
            v = clip(F.col(f"_m_{c}"), -1.0, 1.0)
        terms.append(v * (max(0.0, w) / total if total > 1e-12 else 1.0 / len(members)))
    return out.withColumn("ensemble_score", reduce(lambda a, b: a + b, terms)).drop(*[f"_{p}_{c}" for p in "mn" for c in members])


def composite(df: DataFrame, quant: str, news: str) -> DataFrame:
    """0.6 quant + 0.4 news, both and the result kept in [-1, 1]."""
    q = clip(F.col(quant), -1.0, 1.0)
    comp = clip(0.6 * q + 0.4 * F.coalesce(F.col(news), F.lit(0.0)), -1.0, 1.0)
    return df.withColumn("composite", round_half_up(comp, 4)).withColumns({
        "direction": direction(F.col("composite")), "signal_score": ten_scale(comp)})


def threshold_efficiency(signals: DataFrame, cost_bps: float = 0.0, static: float = 0.5) -> DataFrame:
    a = signals.agg(
        F.count_if(F.col("signal") != "Neutral").alias("fired_dynamic"),
        F.count_if(F.abs("smoothed_score") > static).alias("fired_static"),
        F.avg(F.col("bull_threshold") - static).alias("tightening"),
    )
    avoided = F.greatest(F.col("fired_static") - F.col("fired_dynamic"), F.lit(0))
    return a.withColumn("saving_bps", avoided * F.lit(cost_bps))


def market_sentiment(df: DataFrame, news: str) -> DataFrame:
    return df.groupBy("date").agg(round_half_up(F.avg(F.coalesce(F.col(news), F.lit(0.0))), 4).alias("market_sentiment"))


def score_percentile(rets: DataFrame) -> DataFrame:
    """Volatility percentile input of the thresholds."""
    d = rets.withColumn("_v", F.round("vol_20", 10))
    return W.add_pct_rank(d, {"vol_percentile": ("_v", 252, 20)}).drop("_v")
