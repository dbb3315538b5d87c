"""Per-ticker features.  All functions add columns to a bar panel.

Every window is partitioned by ticker and ordered by date, so on the bucketed
panel none of them shuffles, and consecutive ones share one sort.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.functions import windows as W
from barweave.functions.mathx import lookup, sigmoid
from barweave.sources.bars import align_ffill

SQRT252 = math.sqrt(252)


def returns(bars: DataFrame, horizons=(1, 5, 10, 20, 60)) -> DataFrame:
    return bars.withColumns({f"ret_{k}d": W.pct_change("close", k) for k in horizons})


def long_momentum(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"mom_3m": W.pct_change("close", 63), "mom_6m": W.pct_change("close", 126)})


def momentum_change(bars: DataFrame) -> DataFrame:
    out = returns(bars, (5, 20))
    return out.withColumns({
        "mom_accel": F.col("ret_5d") - F.col("ret_20d"),
        "ret_5d_change": F.col("ret_5d") - W.lag("ret_5d", 5),
    })


def average_frames(min_fast=1, min_slow=1, fast=50, slow=200) -> dict:
    return {"ma_50": ("mean", "close", fast, min_fast), "ma_200": ("mean", "close", slow, min_slow)}


def moving_averages(bars: DataFrame, min_fast=1, min_slow=1, fast=50, slow=200) -> DataFrame:
    return W.add_frames(bars, average_frames(min_fast, min_slow, fast, slow))


def ma_crossover(with_ma: DataFrame) -> DataFrame:
    """+1 when the fast average is above the slow one, else -1 (null compares as -1)."""
    return with_ma.withColumn("ma_cross", F.when(F.col("ma_50") > F.col("ma_200"), 1).otherwise(-1))


def trend_features(bars: DataFrame) -> DataFrame:
    """Returns, 3/6-month momentum, averages and crossover; the first row of each
    ticker is dropped and missing core values become 0."""
    out = ma_crossover(moving_averages(long_momentum(returns(bars, (1,)))))
    out = out.where(F.col("ret_1d").isNotNull())
    return out.fillna(0.0, subset=["mom_3m", "mom_6m"])


def trend_score(feats: DataFrame) -> DataFrame:
    """Fixed weights 0.3, 0.25, 0.025 and 0.2, each times 10."""
    return feats.withColumn(
        "trend_score",
        3.0 * F.col("mom_3m") + 2.5 * F.col("mom_6m") + 0.25 * F.col("ma_cross") + 2.0 * F.col("ret_1d"),
    )


def trend_probability(feats: DataFrame) -> DataFrame:
    """Sigmoid of the score on the latest row of each ticker, with a 0.6/0.4 class."""
    latest = feats.groupBy("ticker").agg(F.max_by(F.struct("date", "trend_score"), "date").alias("x")).select("ticker", "x.*")
    p = sigmoid(F.col("trend_score"))
    return latest.withColumn("prob", p).withColumn(
        "trend", F.when(p > 0.6, "Bullish").when(p < 0.4, "Bearish").otherwise("Neutral")
    )


def vol_frames() -> dict:
    """Volatilities of ``r``, the volatility of one and the jump flag."""
    return {
        **{f"vol_{n}d": ("std", "r", n, n) for n in (5, 10, 20, 60)},
        "vol_of_vol_20": ("std", "vol_20d", 20, 20),
        "jump": lambda k: np.where((k["vol_20d"] != 0.0) & (np.abs(k["r"]) > 2.0 * k["vol_20d"]), 1.0, 0.0),
    }


def vol_term_structure(rets: DataFrame) -> DataFrame:
    return W.add_frames(rets, vol_frames())


def volatility_state(rets: DataFrame) -> DataFrame:
    """Annualised volatility, spike against 1.5x its 60-row median, 252-row
    percentile and the sign of the 5-row change."""
    out = rets.withColumn("vol_20", W.ann_vol("r", 20, 10))
    return out.withColumns({
        "vol_spike": F.when(F.col("vol_20") > 1.5 * W.roll_quantile("vol_20", 0.5, 60, 20), 1.0).otherwise(0.0),
        "vol_trend": F.signum(F.col("vol_20") - W.lag("vol_20", 5)),
    })


def rolling_pct_ranks(rets: DataFrame) -> DataFrame:
    """Rank of the current 20-row return in 63 rows and of volatility in 252
    rows.  Volatility is ranked at 10 decimals: equal frames may differ in the last
    bit."""
    out = rets.withColumns({"ret_20d": W.pct_change("close", 20), "vol_20": W.ann_vol("r", 20, 10)})
    out = out.withColumn("_v", F.round("vol_20", 10))
    return W.add_pct_rank(out, {"mom_rank_63": ("ret_20d", 63, 20), "vol_percentile": ("_v", 252, 20)}).drop("_v")


def trailing_zscores(bars: DataFrame) -> DataFrame:
    """252-row z-scores (at least 60 values) of the liquidity and volatility inputs."""
    z = {"volume_mean_z": ".vm", "volume_spike_z": ".spike", "dollar_volume_z": ".dv", "turnover_z": ".turn", "vol_20_z": ".v20"}
    inputs = {
        ".vm": ("mean", "volume", 20, 5), ".dv": lambda k: k["close"] * k["volume"], ".v20": ("std", "r", 20, 20),
        ".spike": lambda k: W.ratio(k["volume"], k[".vm"]), ".dv20": ("mean", ".dv", 20, 5), ".dv252": ("mean", ".dv", 252, 60),
        ".turn": lambda k: W.ratio(k[".dv20"], k[".dv252"]),
    }
    return W.add_frames(bars.select("ticker", "date", "close", "volume", "r"), inputs | {k: ("z", v, 252, 60) for k, v in z.items()}).select("ticker", "date", *z)


def lagged_zscore(df: DataFrame, x: str, out: str, n: int = 252, m: int = 60) -> DataFrame:
    """Trailing z-score known the row before; 0 until there is one."""
    z = df.withColumn("_z", W.roll_zscore(x, n, m))
    return z.withColumn(out, F.coalesce(W.lag("_z"), F.lit(0.0))).drop("_z")


def volume_frames() -> dict:
    return {
        "dollar_volume": lambda k: k["close"] * k["volume"],
        "volume_ma20": ("mean", "volume", 20, 20),
        ".ma5": ("mean", "volume", 5, 5),
        ".dv20": ("mean", "dollar_volume", 20, 5),
        ".dv252": ("mean", "dollar_volume", 252, 60),
        "relative_volume": lambda k: W.ratio(k["volume"], k["volume_ma20"]),
        "volume_z20": ("z", "volume", 20, 20),
        "volume_trend": lambda k: W.ratio(k[".ma5"], k["volume_ma20"]),
        "turnover_ratio": lambda k: W.ratio(k[".dv20"], k[".dv252"]),
    }


def volume_features(bars: DataFrame) -> DataFrame:
    return W.add_frames(bars, volume_frames())


def rsi_frames(n: int = 14) -> dict:
    return {
        ".before": ("lag", "close", 1, 0),
        ".up": lambda k: np.maximum(k["close"] - k[".before"], 0.0),
        ".down": lambda k: np.maximum(k[".before"] - k["close"], 0.0),
        ".gain": ("mean", ".up", n, n),
        ".loss": ("mean", ".down", n, n),
        "rsi_14": lambda k: 100 - 100 / (1 + W.ratio(k[".gain"], k[".loss"])),
    }


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Simple-mean RSI; a frame without losses has no RSI (null)."""
    return W.add_frames(bars, rsi_frames(n))


def bollinger_frames(n: int = 20, k: float = 2.0) -> dict:
    return {
        ".mid": ("mean", "close", n, n),
        ".sd": ("std", "close", n, n),
        "bb_position": lambda v: W.ratio(v["close"] - (v[".mid"] - k * v[".sd"]), 2 * k * v[".sd"]),
    }


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    return W.add_frames(bars, bollinger_frames(n, k))


def range_frames() -> dict:
    far = lambda x: lambda k: W.ratio(k["close"] - k[x], k[x])
    return {
        ".high": ("max", "close", 20, 10), ".low": ("min", "close", 20, 10), ".year": ("max", "close", 252, 126),
        "dist_high_20": far(".high"), "dist_low_20": far(".low"), "dist_high_252": far(".year"),
    }


def range_distance(bars: DataFrame) -> DataFrame:
    return W.add_frames(bars, range_frames())


def gap_frames() -> dict:
    return {
        ".last_close": ("lag", "close", 1, 0),
        "overnight_gap": lambda k: W.ratio(k["open"], k[".last_close"]) - 1,
        "intraday": lambda k: W.ratio(k["close"], k["open"]) - 1,
    }


def gaps(bars: DataFrame) -> DataFrame:
    return bars.withColumns({
        "overnight_gap": W.safe_div(F.col("open"), W.lag("close")) - 1,
        "intraday": W.safe_div("close", "open") - 1,
    })


def forward_labels(bars: DataFrame, h: int = 5) -> DataFrame:
    fwd = W.safe_div(W.lead("close", h), "close") - 1
    out = bars.withColumn("fwd", fwd)
    return out.withColumns({
        "direction": F.signum("fwd"),
        "label": F.when(F.col("fwd") > 0, 1).when(F.col("fwd").isNotNull(), 0),
    })


def with_market(rets: DataFrame, market: DataFrame) -> DataFrame:
    """Date-keyed market return on every bar (calendar-bounded broadcast)."""
    return rets.join(F.broadcast(market.select("date", "m")), "date", "left")


def correlation_frames(n: int = 20) -> dict:
    return {"market_corr": ("corr", ("r", "m"), n, n)}


def market_correlation(rm: DataFrame, n: int = 20) -> DataFrame:
    return W.add_frames(rm, correlation_frames(n))


def market_vol_spike(market: DataFrame, ddof: int = 1) -> DataFrame:
    """Market volatility ratio 5/60, known the row before.  The market series is
    one row per date under a constant key."""
    ratio = W.safe_div(W.ann_vol("m", 5, None, "mkt", "date", ddof), F.nullif(W.ann_vol("m", 60, None, "mkt", "date", ddof), F.lit(0.0)))
    out = market.withColumns({"vol_5": W.ann_vol("m", 5, None, "mkt", "date", ddof), "_ratio": ratio})
    return out.withColumn("vol_spike", W.lag("_ratio", 1, "mkt")).drop("_ratio")


def capm(rm: DataFrame, n: int = 60, zwin: int = 252) -> DataFrame:
    """``capm_parts`` and the z-score of its alpha in the last ``zwin`` rows."""
    return W.add_frames(rm, capm_frames(n) | {"capm_alpha": ("z", "capm_alpha_raw", zwin, min(60, zwin // 2))})


def capm_frames(n: int = 60) -> dict:
    """Beta, raw alpha and residual volatility of ``r`` on ``m``; missing returns count as 0."""
    return {
        ".s": lambda k: np.nan_to_num(k["r"]), ".m": lambda k: np.nan_to_num(k["m"]), ".cov": ("cov", (".s", ".m"), n, n),
        ".sd_s": ("pop_std", ".s", n, n), ".sd_m": ("std", ".m", n, n), ".mean_s": ("mean", ".s", n, n), ".mean_m": ("mean", ".m", n, n),
        "capm_beta": lambda k: np.where(k[".sd_m"] ** 2 <= 1e-12, 0.0, np.clip(W.ratio(k[".cov"], k[".sd_m"] ** 2), 0.0, 5.0)),
        "capm_alpha_raw": lambda k: k[".mean_s"] - k["capm_beta"] * k[".mean_m"],
        "capm_residual_vol": lambda k: np.sqrt(np.maximum(
            k[".sd_s"] ** 2 + k["capm_beta"] ** 2 * k[".sd_m"] ** 2 * ((n - 1) / n) - 2 * k["capm_beta"] * k[".cov"] * ((n - 1) / n), 0.0)),
    }


def capm_parts(rm: DataFrame, n: int = 60) -> DataFrame:
    """Rolling beta (0..5), raw alpha and residual volatility in closed form.
    Missing returns count as 0, as the two series are aligned that way."""
    return W.add_frames(rm, capm_frames(n))


def vix_style_zscores(market: DataFrame, vol_col: str = "vix", long_col: str = "vix_long") -> DataFrame:
    """Population z of a volatility index over 252 rows, lagged; and of its lagged
    ratio to a longer-dated one, lagged again."""
    out = market.withColumns({
        "_z": W.roll_zscore(vol_col, 252, None, "mkt", "date", 0),
        "_ratio": W.lag(W.safe_div(vol_col, F.nullif(F.col(long_col), F.lit(0.0))), 1, "mkt"),
    })
    out = out.withColumn("_tz", W.roll_zscore("_ratio", 252, 60, "mkt", "date", 0))
    return out.withColumns({"vix_z": W.lag("_z", 1, "mkt"), "vix_term_z": W.lag("_tz", 1, "mkt")}).drop("_z", "_ratio", "_tz")


def smooth(scored: DataFrame, x: str, span: int, out: str = "smoothed_score") -> DataFrame:
    return W.add_ewm(scored, x, span, min(3, span), out)


# Confidence label to position multiplier.
CONFIDENCE_MULT = {"High": 1.0, "Medium": 0.6, "Low": 0.3}


def confidence_label(vol, low: float = 0.20, high: float = 0.40) -> Column:
    return F.when(F.col(vol) < low, "High").when(F.col(vol) <= high, "Medium").otherwise("Low")


def confidence_mult(vol, low: float = 0.20, high: float = 0.40) -> Column:
    return lookup(confidence_label(vol, low, high), CONFIDENCE_MULT)


def confidence(rets: DataFrame, low: float = 0.20, high: float = 0.40) -> DataFrame:
    out = rets.withColumn("vol_20", W.ann_vol("r", 20))
    return out.withColumns({"confidence": confidence_label("vol_20", low, high), "conf_mult": confidence_mult("vol_20", low, high)})


def abnormal_moves(rets: DataFrame) -> DataFrame:
    """Abnormal return in units of 20-row volatility, volume ratio, event flag and
    impact score."""
    out = rets.withColumns({
        "volatility": W.roll_std("r", 20),
        "volume_ratio": W.safe_div("volume", F.nullif(W.roll_mean("volume", 20), F.lit(0.0))),
    }).withColumn("abnormal", W.safe_div(F.abs("r"), F.nullif(F.col("volatility"), F.lit(0.0))))
    flag = (F.coalesce(F.col("abnormal"), F.lit(0.0)) > 2.0) | (F.coalesce(F.col("volume_ratio"), F.lit(0.0)) > 2.0)
    ln = F.when(F.col("volume_ratio").isNotNull(), F.ln(F.greatest(F.col("volume_ratio"), F.lit(0.01))))
    return out.withColumns({
        "is_event": flag,
        "impact": F.coalesce(F.col("abnormal"), F.lit(0.0)) + F.coalesce(ln, F.lit(0.0)),
    })


def stock_vol_regime(rets: DataFrame) -> DataFrame:
    ratio = W.safe_div(W.roll_std("r", 20), F.nullif(W.roll_std("r", 252), F.lit(0.0)))
    return vol_ratio_flag(rets, ratio)


def vol_ratio_flag(rets: DataFrame, ratio: Column) -> DataFrame:
    out = rets.withColumn("vol_regime_ratio", ratio)
    return out.withColumn("high_vol_regime", F.when(F.col("vol_regime_ratio") > 1.2, 1.0).otherwise(0.0))


def price_shape(rets: DataFrame) -> DataFrame:
    out = rets.withColumn("_rel", W.safe_div("volume", F.nullif(W.roll_mean("volume", 20), F.lit(0.0))))
    return out.withColumns({
        "price_z20": W.roll_zscore("close", 20),
        "streak_5": W.roll_sum(F.signum("r"), 5),
        "pv_divergence": W.pct_change("close", 5) * (1.0 - F.col("_rel")),
    }).drop("_rel")


def momentum_rank(bars: DataFrame) -> DataFrame:
    """Six-month momentum skipping the last 21 rows, ranked in its own 252 rows."""
    out = bars.withColumn("mom_6m", W.pct_change("close", 126))
    out = out.withColumn("cs_mom", W.lag("mom_6m", 21))
    return W.add_pct_rank(out, {"mom_rank_252": ("cs_mom", 252, 60)})


def vol_target_factor(vol, target=0.15, floor=0.05, cap=3.0):
    return F.least(target / F.greatest(vol, F.lit(floor)), F.lit(cap))


def vol_target(rets: DataFrame, n: int = 20, target=0.15, floor=0.05, cap=3.0) -> DataFrame:
    out = rets.withColumn("rvol", W.roll_std("r", n, 1, ddof=0) * SQRT252)
    factor = vol_target_factor(F.col("rvol"), target, floor, cap)
    return out.withColumn("scale", F.when(F.col("rvol").isNotNull(), factor))


def market_vol_scalar(market: DataFrame) -> DataFrame:
    """min(1, long-run vol / vol20), 1 until known."""
    out = market.withColumn("vol_20", W.ann_vol("m", 20, None, "mkt"))
    out = out.withColumn("_long", W.roll_mean("vol_20", 252, None, "mkt"))
    s = F.least(F.lit(1.0), W.safe_div("_long", F.nullif(F.col("vol_20"), F.lit(0.0))))
    return out.withColumn("vol_scalar", F.when(F.col("_long").isNotNull() & (F.col("vol_20") > 0), s).otherwise(1.0)).drop("_long")


def expanding_zscore(df: DataFrame, x: str, out: str, m: int = 20, floor: float = 1e-8) -> DataFrame:
    w = W.expanding()
    z = (F.col(x) - F.avg(x).over(w)) / F.greatest(F.stddev_samp(x).over(w), F.lit(floor))
    return df.withColumn(out, F.when((F.count(x).over(w) >= m) & F.col(x).isNotNull(), z))


def log_return_vol(bars: DataFrame, n: int = 30, out: str = "iv_proxy") -> DataFrame:
    b = bars.withColumn("lr", F.ln(W.safe_div(F.col("close"), W.lag("close"))))
    return b.withColumn(out, W.ann_vol("lr", n, max(2, n // 2)))


def lognormal_params(bars: DataFrame, n: int = 252, m: int | None = None) -> DataFrame:
    """Annualised drift and volatility of log returns over n rows."""
    b = bars.withColumn("lr", F.ln(W.safe_div(F.col("close"), W.lag("close"))))
    b = b.withColumns({"sigma": W.ann_vol("lr", n - 1, m), "_mean": W.roll_mean("lr", n - 1, m)})
    return b.withColumn("mu", F.col("_mean") * 252 + 0.5 * F.col("sigma") * F.col("sigma")).drop("_mean")


def feature_matrix(bars: DataFrame, market: DataFrame, h: int = 5, only: list[str] | None = None, before: list[str] = (), carry: list[str] = ()) -> DataFrame:
    """Per-ticker part of the training matrix.  Rows without the required
    features are dropped; features that are only unknown early are 0.

    Lags come from windows over the bucketed bars, all other frames from one pass over each ticker's rows.
    With ``only`` these columns (and ticker and date) are returned, and nothing is made that they do not rest on; ``carry`` are
    columns of ``bars`` that go along then, and ``before`` columns whose value in the ticker's row before comes, too
    (``_before_...``), with its date (``_date_before``, days since 1970).
    """
    f = forward_labels(long_momentum(returns(bars)), h).withColumn("r", F.col("ret_1d"))
    frames = average_frames() | vol_frames() | {".vol_252": ("std", "r", 252, 252), "_vol_ratio": lambda k: W.ratio(k["vol_20d"], k[".vol_252"])}
    frames |= volume_frames() | rsi_frames() | bollinger_frames() | range_frames() | gap_frames() | correlation_frames()
    need = ["ret_20d", "mom_3m", "vol_20d", "fwd"]
    rests = {"ma_cross": ["ma_50", "ma_200"], "trend_score": ["ma_50", "ma_200", "mom_3m", "mom_6m", "ret_1d"], "vol_regime_ratio": ["_vol_ratio"], "high_vol_regime": ["_vol_ratio"]}
    zero = ["mom_6m", "vol_60d", "vol_of_vol_20", "relative_volume", "volume_z20", "market_corr", "rsi_14", "bb_position"]
    if before:
        frames |= {"where known": lambda k: np.logical_and.reduce([~np.isnan(k[c]) for c in need]), "_date_before": ("lag", "date", 1, 0)}
        frames |= {f"_before_{c}": ("lag", c, 1, 0) for c in before}
    extra = [*carry, *(["_date_before", *[f"_before_{c}" for c in before]] if before else [])]
    wanted = None if only is None else [*need, *only, *[x for c in only for x in rests.get(c, [])], *extra]
    if wanted is None or "m" in W.frames_for(frames, wanted)[1]:
        f = with_market(f, market)
    f = W.add_frames(f, frames, out=wanted)
    if wanted is None or "ma_50" in wanted:
        f = ma_crossover(f)
    if wanted is None or "trend_score" in wanted:
        f = trend_score(f)
    if wanted is None or "_vol_ratio" in wanted:
        f = vol_ratio_flag(f, F.col("_vol_ratio")).drop("_vol_ratio")
    for c in need:
        f = f.where(F.col(c).isNotNull())
    f = f.fillna(0.0, subset=[c for c in zero if c in f.columns])
    for c in before:
        if c in zero:
            f = f.withColumn(f"_before_{c}", F.when(F.col("_date_before").isNotNull(), F.coalesce(F.col(f"_before_{c}"), F.lit(0.0))))
    return f if only is None else f.select("ticker", "date", *only, *extra)


FEATURE_COLUMNS = ["trend_score", "ret_5d", "ret_20d", "mom_3m", "mom_6m", "vol_20d", "vol_60d", "relative_volume",
                   "volume_z20", "rsi_14", "bb_position", "dist_high_20", "dist_low_20", "overnight_gap", "intraday", "market_corr"]


def fill_on_calendar(df: DataFrame, col: str) -> DataFrame:
    return align_ffill(df, [col], backfill=True)
