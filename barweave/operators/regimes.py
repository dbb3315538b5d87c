"""Regime labels, spells and regime lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions import windows as W
from barweave.functions.mathx import lookup
from barweave.operators.features import moving_averages

# Any regime label to the canonical four.
CANONICAL_REGIME = {
    "bull_trend": "Bull", "Bull": "Bull", "bear_trend": "Bear", "Bear": "Bear",
    "sideways": "Sideways", "Sideways": "Sideways", "high_vol": "HighVol", "HighVol": "HighVol",
    "Crisis": "Bear",
}
# Position scale and threshold multiplier per regime.
POSITION_SCALE = {"Bull": 1.0, "Sideways": 0.8, "Bear": 0.6, "Crisis": 0.3}
SIGMA_MULT = {"Bull": 1.0, "Sideways": 1.1, "Bear": 1.25, "Crisis": 1.5}


def name_regime(rets: DataFrame) -> DataFrame:
    """Per-name trend and volatility regime and their product score."""
    out = moving_averages(rets, 10, 40).withColumn("vol_20", W.ann_vol("r", 20, 10))
    out = W.add_pct_rank(out.withColumn("_v", F.round("vol_20", 10)), {"vol_pct": ("_v", 252, 20)}).drop("_v")
    c, f, s = F.col("close"), F.col("ma_50"), F.col("ma_200")
    bull, bear = (c > f) & (c > s) & (f > s), (c < f) & (c < s) & (f < s)
    sign = F.when(bull, 1.0).when(bear, -1.0).otherwise(0.0)
    mult = F.when(F.col("vol_pct") < 0.33, 1.0).when(F.col("vol_pct") > 0.67, 0.0).otherwise(0.5)
    return out.withColumns({
        "trend_regime": F.when(bull, "bull_trend").when(bear, "bear_trend").otherwise("sideways"),
        "volatility_regime": F.when(F.col("vol_pct") < 0.33, "low_vol").when(F.col("vol_pct") > 0.67, "high_vol").otherwise("normal_vol"),
        "regime_score": sign * mult,
    })


def market_index(market: DataFrame) -> DataFrame:
    """Price index compounded from the market return (one row per date)."""
    w = W.expanding("mkt")
    return market.withColumn("close", 100.0 * F.exp(F.sum(F.log1p("m")).over(w)))


def market_regime(index: DataFrame, vix: str = "vix", crisis: float = 30.0, unknown_vix: float = 15.0) -> DataFrame:
    """Unknown averages are Sideways; a volatility index at or above ``crisis`` is
    Crisis; then price and 50-row average on the same side of the 200-row one.
    Without an index column, 20-row realised volatility in percent stands in."""
    out = index.withColumns({
        "sma_50": W.roll_mean("close", 50, None, "mkt"),
        "sma_200": W.roll_mean("close", 200, None, "mkt"),
    })
    level = F.col(vix) if vix in index.columns else W.ann_vol("m", 20, None, "mkt") * 100
    out = out.withColumn("vol_level", F.coalesce(level, F.lit(unknown_vix)))
    c, f, s = F.col("close"), F.col("sma_50"), F.col("sma_200")
    label = (
        F.when(s.isNull() | f.isNull(), "Sideways")
        .when(F.col("vol_level") >= crisis, "Crisis")
        .when((c > s) & (f > s), "Bull")
        .when((c < s) & (f < s), "Bear")
        .otherwise("Sideways")
    )
    return out.withColumn("regime", label)


def market_regime_vol_first(index: DataFrame, ratio: float = 1.5) -> DataFrame:
    """HighVol when vol20 exceeds ``ratio`` times its 200-row mean, else the side of
    the 200-row average, else Normal."""
    out = index.withColumns({"sma_200": W.roll_mean("close", 200, None, "mkt"), "vol_20": W.roll_std("m", 20, None, "mkt")})
    out = out.withColumn("vol_mean", W.roll_mean("vol_20", 200, None, "mkt"))
    label = (
        F.when(F.col("vol_20") > ratio * F.col("vol_mean"), "HighVol")
        .when(F.col("close") > F.col("sma_200"), "Bull")
        .when(F.col("close") < F.col("sma_200"), "Bear")
        .otherwise("Normal")
    )
    return out.withColumn("regime", label)


def canonical(label: Column) -> Column:
    return lookup(label, CANONICAL_REGIME, "Sideways")


def spell_counter(regimes: DataFrame, state: str = "Crisis", key: str = "mkt") -> DataFrame:
    """Consecutive days inside ``state`` (0 outside) and whether a spell starts."""
    w = Window.partitionBy(key).orderBy("date")
    inside = F.col("regime") == state
    out = regimes.withColumn("_isl", F.sum(F.when(inside, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # numbers the rows of an island; the island's opening row is the day outside
    n = F.count_if(inside).over(Window.partitionBy(key, "_isl").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("day_in_state", F.when(inside, n).otherwise(0))
    return out.withColumn("entered", F.col("day_in_state") == 1).drop("_isl")


def regime_lookup(df: DataFrame, table: dict, out: str, override: dict | None = None, default: float = 1.0, cap: float | None = None) -> DataFrame:
    """Scale by regime with overrides, a default and an optional cap."""
    v = lookup(F.col("regime"), {**table, **(override or {})}, default)
    return df.withColumn(out, F.least(v, F.lit(cap)) if cap is not None else v)


def regime_score_std(scored: DataFrame, x: str, min_n: int = 10, fallback: float = 0.1) -> DataFrame:
    g = scored.groupBy("regime").agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"))
    return g.select("regime", "n", F.when((F.col("n") >= min_n) & (F.col("sd") > 0), F.col("sd")).otherwise(fallback).alias("score_std"))
