"""Per-ticker feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.functions import windows as W
from barweave.operators import features as X
from barweave.plans.catalog import query
from barweave.plans.sqlbase import MARKET, PRICES, RET, lagx, roll, win, zs
from barweave.sources import tables as S

K = "ticker:i date:d "


def bars(spark, d):
    return S.panel(spark, d)


def rets(spark, d):
    return S.with_returns(S.panel(spark, d))


def bars_with(spark, d, ranks=None):
    """The bars with their sector (null if unknown) and the columns of ``ranks`` (by ticker and date); the bars do not move."""
    b = bars(spark, d).join(S.beside_panel(spark, d, S.sectors(spark, d).select("ticker", "sector")), "ticker", "left")
    return b if ranks is None else b.join(S.beside_panel(spark, d, ranks), ["ticker", "date"], "left")


def chg(k):
    return f"close/{lagx('close', k)} - 1"


@query("pct_change_returns", "C1", K + "ret_1d:f ret_5d:f ret_10d:f ret_20d:f ret_60d:f", f"""
WITH {PRICES} SELECT ticker, date, {', '.join(f'{chg(k)} AS ret_{k}d' for k in (1, 5, 10, 20, 60))} FROM prices""")
def pct_change_returns(spark, d):
    return X.returns(bars(spark, d))


@query("long_momentum", "C2", K + "mom_3m:f mom_6m:f", f"""
WITH {PRICES} SELECT ticker, date, {chg(63)} AS mom_3m, {chg(126)} AS mom_6m FROM prices""")
def long_momentum(spark, d):
    return X.long_momentum(bars(spark, d))


@query("momentum_change", "C3", K + "mom_accel:f ret_5d_change:f", f"""
WITH {PRICES}, a AS (SELECT ticker, date, {chg(5)} AS r5, {chg(20)} AS r20 FROM prices)
SELECT ticker, date, r5 - r20 AS mom_accel, r5 - {lagx('r5', 5)} AS ret_5d_change FROM a""")
def momentum_change(spark, d):
    return X.momentum_change(bars(spark, d))


@query("moving_averages", "C4", K + "ma_50:f ma_200:f ma_50w:f ma_200w:f", f"""
WITH {PRICES} SELECT ticker, date, {roll('avg', 'close', 50, 1)} AS ma_50, {roll('avg', 'close', 200, 1)} AS ma_200,
 {roll('avg', 'close', 50, 10)} AS ma_50w, {roll('avg', 'close', 200, 40)} AS ma_200w FROM prices""")
def moving_averages(spark, d):
    return X.moving_averages(bars(spark, d)).withColumns(
        {"ma_50w": W.roll_mean("close", 50, 10), "ma_200w": W.roll_mean("close", 200, 40)})


CROSS = f"""ma AS (SELECT *, {roll('avg', 'close', 50, 1)} AS ma_50, {roll('avg', 'close', 200, 1)} AS ma_200 FROM prices)"""


@query("ma_crossover", "C5", K + "ma_cross:i", f"""
WITH {PRICES}, {CROSS} SELECT ticker, date, CASE WHEN ma_50 > ma_200 THEN 1 ELSE -1 END AS ma_cross FROM ma""")
def ma_crossover(spark, d):
    return X.ma_crossover(X.moving_averages(bars(spark, d)))


TREND = PRICES + f""", {CROSS},
tf0 AS (SELECT *, {chg(1)} AS ret_1d, {chg(63)} AS m3, {chg(126)} AS m6 FROM ma),
tf AS (SELECT *, coalesce(m3, 0) AS mom_3m, coalesce(m6, 0) AS mom_6m, CASE WHEN ma_50 > ma_200 THEN 1 ELSE -1 END AS ma_cross
  FROM tf0 WHERE ret_1d IS NOT NULL),
ts AS (SELECT *, 3.0*mom_3m + 2.5*mom_6m + 0.25*ma_cross + 2.0*ret_1d AS trend_score FROM tf)"""


def trend(spark, d):
    return X.trend_score(X.trend_features(bars(spark, d)))


@query("trend_features", "C6", K + "ret_1d:f mom_3m:f mom_6m:f ma_50:f ma_200:f ma_cross:i", f"WITH {TREND} SELECT * FROM tf")
def trend_features(spark, d):
    return X.trend_features(bars(spark, d))


@query("volatility_term_structure", "C7", K + "vol_5d:f vol_10d:f vol_20d:f vol_60d:f vol_of_vol_20:f jump:f", f"""
WITH {RET}, v AS (SELECT ticker, date, r, {', '.join(f"{roll('stddev_samp', 'r', n)} AS vol_{n}d" for n in (5, 10, 20, 60))} FROM ret)
SELECT *, {roll('stddev_samp', 'vol_20d', 20)} AS vol_of_vol_20, CASE WHEN abs(r) > 2*nullif(vol_20d, 0) THEN 1.0 ELSE 0.0 END AS jump FROM v""")
def volatility_term_structure(spark, d):
    return X.vol_term_structure(rets(spark, d))


V20 = f"v0 AS (SELECT *, {roll('stddev_samp', 'r', 20, 10)} AS s20 FROM ret), v AS (SELECT *, s20 * sqrt(252) AS vol_20 FROM v0)"


@query("volatility_state", "C8", K + "vol_20:f vol_spike:f vol_trend:f", f"""
WITH {RET}, {V20}, m AS (SELECT *, {roll('quantile_cont({}, 0.5)', 'vol_20', 60, 20)} AS med FROM v)
SELECT ticker, date, vol_20, CASE WHEN vol_20 > 1.5*med THEN 1.0 ELSE 0.0 END AS vol_spike, sign(vol_20 - {lagx('vol_20', 5)}) AS vol_trend FROM m""")
def volatility_state(spark, d):
    return X.volatility_state(rets(spark, d))


def pr(x, n, m):
    lst = f"list({x}) FILTER ({x} IS NOT NULL) OVER {win(n)}"
    return f"""CASE WHEN {x} IS NOT NULL AND len({lst}) >= {m} THEN
 (len(list_filter({lst}, lambda e: e < {x})) + 0.5*len(list_filter({lst}, lambda e: e = {x})) + 0.5) / len({lst}) END"""


@query("rolling_percentile_rank", "C9", K + "mom_rank_63:f vol_percentile:f", f"""
WITH {RET}, {V20}, a AS (SELECT *, {chg(20)} AS ret_20d FROM v)
SELECT ticker, date, {pr('ret_20d', 63, 20)} AS mom_rank_63, {pr('round(vol_20, 10)', 252, 20)} AS vol_percentile FROM a""")
def rolling_percentile_rank(spark, d):
    return X.rolling_pct_ranks(rets(spark, d))


ZIN = f"""z0 AS (SELECT *, {roll('avg', 'volume', 20, 5)} AS vm, close*volume AS dv, {roll('stddev_samp', 'r', 20)} AS v20 FROM ret),
z1 AS (SELECT *, volume/vm AS spike, ({roll('avg', 'dv', 20, 5)}) / ({roll('avg', 'dv', 252, 60)}) AS turn FROM z0)"""


@query("trailing_zscores", "C10", K + "volume_mean_z:f volume_spike_z:f dollar_volume_z:f turnover_z:f vol_20_z:f", f"""
WITH {RET}, {ZIN} SELECT ticker, date, {zs('vm', 252, 60)} AS volume_mean_z, {zs('spike', 252, 60)} AS volume_spike_z,
 {zs('dv', 252, 60)} AS dollar_volume_z, {zs('turn', 252, 60)} AS turnover_z, {zs('v20', 252, 60)} AS vol_20_z FROM z1""")
def trailing_zscores(spark, d):
    return X.trailing_zscores(rets(spark, d))


@query("lagged_zscore", "C11", K + "gap_z:f", f"""
WITH {PRICES}, g AS (SELECT ticker, date, open/{lagx('close')} - 1 AS gap FROM prices), z AS (SELECT *, {zs('gap', 252, 60)} AS z FROM g)
SELECT ticker, date, coalesce({lagx('z')}, 0) AS gap_z FROM z""")
def lagged_zscore(spark, d):
    return X.lagged_zscore(X.gaps(bars(spark, d)), "overnight_gap", "gap_z")


@query("volume_features", "C12", K + "dollar_volume:f volume_ma20:f relative_volume:f volume_z20:f volume_trend:f turnover_ratio:f", f"""
WITH {PRICES}, a AS (SELECT *, close*volume AS dollar_volume, {roll('avg', 'volume', 20)} AS volume_ma20 FROM prices)
SELECT ticker, date, dollar_volume, volume_ma20, volume/volume_ma20 AS relative_volume, {zs('volume', 20, 20)} AS volume_z20,
 ({roll('avg', 'volume', 5)}) / volume_ma20 AS volume_trend,
 ({roll('avg', 'dollar_volume', 20, 5)}) / ({roll('avg', 'dollar_volume', 252, 60)}) AS turnover_ratio FROM a""")
def volume_features(spark, d):
    return X.volume_features(bars(spark, d))


RSI = f"""d0 AS (SELECT *, close - {lagx('close')} AS dlt FROM prices),
d1 AS (SELECT *, CASE WHEN dlt IS NOT NULL THEN greatest(dlt, 0) END AS up, CASE WHEN dlt IS NOT NULL THEN greatest(-dlt, 0) END AS dn FROM d0),
rsi AS (SELECT *, 100 - 100/(1 + ({roll('avg', 'up', 14)}) / nullif({roll('avg', 'dn', 14)}, 0)) AS rsi_14 FROM d1)"""


@query("rsi_14", "C13", K + "rsi_14:f", f"WITH {PRICES}, {RSI} SELECT ticker, date, rsi_14 FROM rsi")
def rsi_14(spark, d):
    return X.rsi(bars(spark, d))


@query("bollinger_position", "C14", K + "bb_position:f", f"""
WITH {PRICES}, a AS (SELECT *, {roll('avg', 'close', 20)} AS mid, {roll('stddev_samp', 'close', 20)} AS sd FROM prices)
SELECT ticker, date, (close - (mid - 2*sd)) / nullif(4*sd, 0) AS bb_position FROM a""")
def bollinger_position(spark, d):
    return X.bollinger(bars(spark, d))


@query("range_distance", "C15", K + "dist_high_20:f dist_low_20:f dist_high_252:f", f"""
WITH {PRICES}, a AS (SELECT *, {roll('max', 'close', 20, 10)} AS h, {roll('min', 'close', 20, 10)} AS l, {roll('max', 'close', 252, 126)} AS y FROM prices)
SELECT ticker, date, (close - h)/h AS dist_high_20, (close - l)/l AS dist_low_20, (close - y)/y AS dist_high_252 FROM a""")
def range_distance(spark, d):
    return X.range_distance(bars(spark, d))


@query("overnight_intraday", "C16", K + "overnight_gap:f intraday:f", f"""
WITH {PRICES} SELECT ticker, date, open/{lagx('close')} - 1 AS overnight_gap, close/open - 1 AS intraday FROM prices""")
def overnight_intraday(spark, d):
    return X.gaps(bars(spark, d))


@query("forward_labels", "C17", K + "fwd:f direction:f label:i", f"""
WITH {PRICES}, a AS (SELECT ticker, date, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date)/close - 1 AS fwd FROM prices)
SELECT *, sign(fwd) AS direction, CASE WHEN fwd > 0 THEN 1 WHEN fwd IS NOT NULL THEN 0 END AS label FROM a""")
def forward_labels(spark, d):
    return X.forward_labels(bars(spark, d))


RM = MARKET + ", rm AS (SELECT ret.*, market.m FROM ret LEFT JOIN market USING (date))"


def rm(spark, d):
    r = rets(spark, d)
    return X.with_market(r, S.market(bars(spark, d)))


@query("market_correlation", "C18", K + "market_corr:f", f"""
WITH {RM}, c AS (SELECT *, CASE WHEN count(r + m) OVER {win(20)} >= 20 AND stddev_pop(r) OVER {win(20)} > 0 AND stddev_pop(m) OVER {win(20)} > 0
  THEN corr(r, m) OVER {win(20)} END AS market_corr FROM rm) SELECT ticker, date, market_corr FROM c""")
def market_correlation(spark, d):
    return X.market_correlation(rm(spark, d))


def mv(n, dd="stddev_samp"):
    return f"({roll(dd, 'm', n, n, 'mkt')}) * sqrt(252)"


@query("market_series", "C19", "date:d m:f n_names:i vol_5:f vol_spike:f", f"""
WITH {MARKET}, a AS (SELECT *, {mv(5)} AS vol_5, {mv(60)} AS vol_60 FROM market)
SELECT date, m, n_names, vol_5, lag(vol_5 / nullif(vol_60, 0)) OVER (ORDER BY date) AS vol_spike FROM a""")
def market_series(spark, d):
    return X.market_vol_spike(S.market(bars(spark, d)))


CAPM = RM + f""", c0 AS (SELECT *, coalesce(r, 0) AS sr, coalesce(m, 0) AS mr FROM rm),
c1 AS (SELECT *, count(*) OVER {win(60)} AS n60, var_samp(mr) OVER {win(60)} AS vm, covar_samp(sr, mr) OVER {win(60)} AS cv,
  var_pop(sr) OVER {win(60)} AS vs, avg(sr) OVER {win(60)} AS a_s, avg(mr) OVER {win(60)} AS a_m FROM c0),
c2 AS (SELECT *, CASE WHEN n60 >= 60 THEN CASE WHEN vm <= 1e-12 THEN 0.0 ELSE least(greatest(cv/vm, 0), 5) END END AS capm_beta FROM c1),
c3 AS (SELECT *, a_s - capm_beta*a_m AS araw,
  CASE WHEN capm_beta IS NOT NULL THEN sqrt(greatest(vs + capm_beta*capm_beta*vm*59/60 - 2*capm_beta*cv*59/60, 0)) END AS capm_residual_vol FROM c2)"""


@query("capm_rolling", "C20", K + "capm_beta:f capm_alpha:f capm_residual_vol:f", f"""
WITH {CAPM} SELECT ticker, date, capm_beta, {zs('araw', 252, 60)} AS capm_alpha, capm_residual_vol FROM c3""")
def capm_rolling(spark, d):
    return X.capm(rm(spark, d))


@query("vix_style_zscores", "C21", "date:d vix_z:f vix_term_z:f", f"""
WITH {MARKET}, v AS (SELECT *, ({mv(20)})*100 AS vix, ({mv(60)})*100 AS vix_long FROM market),
a AS (SELECT *, {zs('vix', 252, 252, 0, 'mkt')} AS z, lag(vix / nullif(vix_long, 0)) OVER (ORDER BY date) AS ratio FROM v),
b AS (SELECT *, {zs('ratio', 252, 60, 0, 'mkt')} AS tz FROM a)
SELECT date, lag(z) OVER (ORDER BY date) AS vix_z, lag(tz) OVER (ORDER BY date) AS vix_term_z FROM b""")
def vix_style_zscores(spark, d):
    m = S.market(bars(spark, d)).withColumns({"vix": W.ann_vol("m", 20, None, "mkt") * 100, "vix_long": W.ann_vol("m", 60, None, "mkt") * 100})
    return X.vix_style_zscores(m)


def ewm_sql(src, x, span, m):
    """Direct definition: weighted mean over all earlier rows by row distance."""
    dec = 1 - 2 / (span + 1)
    return f"""e0 AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM {src}),
ew AS (SELECT a.ticker, a.date, CASE WHEN count(b.{x}) >= {m} THEN sum(b.{x} * pow({dec!r}, a.rn - b.rn)) / sum(pow({dec!r}, a.rn - b.rn)) END AS ew
  FROM e0 a JOIN e0 b ON a.ticker = b.ticker AND b.rn <= a.rn WHERE b.{x} IS NOT NULL GROUP BY a.ticker, a.date)"""


@query("ema_smoothing", "C22", K + "smoothed_score:f", f"""
WITH {TREND}, {ewm_sql('ts', 'trend_score', 5, 3)} SELECT ticker, date, ew AS smoothed_score FROM ew""")
def ema_smoothing(spark, d):
    return X.smooth(trend(spark, d), "trend_score", 5)


@query("trend_score", "C23", K + "trend_score:f", f"WITH {TREND} SELECT ticker, date, trend_score FROM ts")
def trend_score(spark, d):
    return trend(spark, d)


@query("trend_probability", "C24", K + "prob:f trend:s", f"""
WITH {TREND}, l AS (SELECT ticker, max(date) AS date, arg_max(1/(1 + exp(-trend_score)), date) AS prob FROM ts GROUP BY ticker)
SELECT *, CASE WHEN prob > 0.6 THEN 'Bullish' WHEN prob < 0.4 THEN 'Bearish' ELSE 'Neutral' END AS trend FROM l""")
def trend_probability(spark, d):
    return X.trend_probability(trend(spark, d))


@query("confidence_labels", "C25", K + "confidence:s conf_mult:f", f"""
WITH {RET}, v0 AS (SELECT *, {roll('stddev_samp', 'r', 20)} AS s20 FROM ret), v AS (SELECT *, s20*sqrt(252) AS vol FROM v0),
c AS (SELECT *, CASE WHEN vol < 0.75 THEN 'High' WHEN vol <= 0.95 THEN 'Medium' ELSE 'Low' END AS confidence FROM v)
SELECT ticker, date, confidence, CASE confidence WHEN 'High' THEN 1.0 WHEN 'Medium' THEN 0.6 ELSE 0.3 END AS conf_mult FROM c""")
def confidence_labels(spark, d):
    return X.confidence(rets(spark, d), 0.75, 0.95)


@query("abnormal_moves", "C26", K + "abnormal:f volume_ratio:f is_event:b impact:f", f"""
WITH {RET}, a AS (SELECT *, {roll('stddev_samp', 'r', 20)} AS v, volume/({roll('avg', 'volume', 20)}) AS volume_ratio FROM ret),
b AS (SELECT *, abs(r)/nullif(v, 0) AS abnormal FROM a)
SELECT ticker, date, abnormal, volume_ratio, coalesce(abnormal, 0) > 2 OR coalesce(volume_ratio, 0) > 2 AS is_event,
 coalesce(abnormal, 0) + coalesce(ln(CASE WHEN volume_ratio IS NOT NULL THEN greatest(volume_ratio, 0.01) END), 0) AS impact FROM b""")
def abnormal_moves(spark, d):
    return X.abnormal_moves(rets(spark, d))


@query("stock_vol_regime", "C27", K + "vol_regime_ratio:f high_vol_regime:f", f"""
WITH {RET}, a AS (SELECT *, ({roll('stddev_samp', 'r', 20)}) / nullif({roll('stddev_samp', 'r', 252)}, 0) AS q FROM ret)
SELECT ticker, date, q AS vol_regime_ratio, CASE WHEN q > 1.2 THEN 1.0 ELSE 0.0 END AS high_vol_regime FROM a""")
def stock_vol_regime(spark, d):
    return X.stock_vol_regime(rets(spark, d))


@query("price_shape", "C28", K + "price_z20:f streak_5:f pv_divergence:f", f"""
WITH {RET} SELECT ticker, date, {zs('close', 20, 20)} AS price_z20, {roll('sum', 'sign(r)', 5)} AS streak_5,
 ({chg(5)}) * (1 - volume/({roll('avg', 'volume', 20)})) AS pv_divergence FROM ret""")
def price_shape(spark, d):
    return X.price_shape(rets(spark, d))


@query("momentum_rank_252", "C29", K + "cs_mom:f mom_rank_252:f", f"""
WITH {PRICES}, a AS (SELECT *, {chg(126)} AS m6 FROM prices), b AS (SELECT *, {lagx('m6', 21)} AS cs_mom FROM a)
SELECT ticker, date, cs_mom, {pr('cs_mom', 252, 60)} AS mom_rank_252 FROM b""")
def momentum_rank_252(spark, d):
    return X.momentum_rank(bars(spark, d))


@query("vol_target_scale", "C30", K + "rvol:f scale:f", f"""
WITH {RET}, a AS (SELECT *, stddev_pop(r) OVER {win(20)} * sqrt(252) AS rvol FROM ret)
SELECT ticker, date, rvol, CASE WHEN rvol IS NOT NULL THEN least(0.15/greatest(rvol, 0.05), 3.0) END AS scale FROM a""")
def vol_target_scale(spark, d):
    return X.vol_target(rets(spark, d))


@query("market_vol_scalar", "C31", "date:d vol_20:f vol_scalar:f", f"""
WITH {MARKET}, a AS (SELECT *, {mv(20)} AS vol_20 FROM market), b AS (SELECT *, {roll('avg', 'vol_20', 252, 252, 'mkt')} AS lr FROM a)
SELECT date, vol_20, CASE WHEN lr IS NOT NULL AND vol_20 > 0 THEN least(1.0, lr/vol_20) ELSE 1.0 END AS vol_scalar FROM b""")
def market_vol_scalar(spark, d):
    return X.market_vol_scalar(S.market(bars(spark, d)))


@query("expanding_zscore", "C32", K + "score_z:f", f"""
WITH {TREND} SELECT ticker, date, CASE WHEN count(trend_score) OVER w >= 20 THEN
 (trend_score - avg(trend_score) OVER w) / greatest(stddev_samp(trend_score) OVER w, 1e-8) END AS score_z FROM ts
WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def expanding_zscore(spark, d):
    return X.expanding_zscore(trend(spark, d), "trend_score", "score_z")


@query("log_return_vol_proxy", "C33", K + "iv_proxy:f", f"""
WITH {PRICES}, a AS (SELECT *, ln(close/{lagx('close')}) AS lr FROM prices)
SELECT ticker, date, ({roll('stddev_samp', 'lr', 30, 15)}) * sqrt(252) AS iv_proxy FROM a""")
def log_return_vol_proxy(spark, d):
    return X.log_return_vol(bars(spark, d))


LOGN = f"""l0 AS (SELECT *, ln(close/{lagx('close')}) AS lr FROM prices),
l1 AS (SELECT *, ({roll('stddev_samp', 'lr', 251)}) * sqrt(252) AS sigma, {roll('avg', 'lr', 251)} AS am FROM l0),
logn AS (SELECT *, am*252 + 0.5*sigma*sigma AS mu FROM l1)"""


@query("lognormal_params", "C34", K + "mu:f sigma:f", f"WITH {PRICES}, {LOGN} SELECT ticker, date, mu, sigma FROM logn")
def lognormal_params(spark, d):
    return X.lognormal_params(bars(spark, d))


FM = RM + f""",
f1 AS (SELECT *, {', '.join(f'{chg(k)} AS ret_{k}d' for k in (1, 5, 10, 20, 60))}, {chg(63)} AS mom_3m, {chg(126)} AS mom_6m,
  {roll('avg', 'close', 50, 1)} AS ma_50, {roll('avg', 'close', 200, 1)} AS ma_200,
  {', '.join(f"{roll('stddev_samp', 'r', n)} AS vol_{n}d" for n in (5, 20, 60))},
  {roll('avg', 'volume', 20)} AS vma, {zs('volume', 20, 20)} AS volume_z20, close - {lagx('close')} AS dlt,
  {roll('avg', 'close', 20)} AS mid, {roll('stddev_samp', 'close', 20)} AS sd, {roll('max', 'close', 20, 10)} AS h20, {roll('min', 'close', 20, 10)} AS l20,
  open/{lagx('close')} - 1 AS overnight_gap, close/open - 1 AS intraday, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date)/close - 1 AS fwd,
  CASE WHEN count(r + m) OVER {win(20)} >= 20 AND stddev_pop(r) OVER {win(20)} > 0 AND stddev_pop(m) OVER {win(20)} > 0 THEN corr(r, m) OVER {win(20)} END AS mc FROM rm),
f2 AS (SELECT *, CASE WHEN dlt IS NOT NULL THEN greatest(dlt, 0) END AS up, CASE WHEN dlt IS NOT NULL THEN greatest(-dlt, 0) END AS dn FROM f1),
fm AS (SELECT ticker, date, close, volume, r, fwd, 3.0*mom_3m + 2.5*mom_6m + 0.25*(CASE WHEN ma_50 > ma_200 THEN 1 ELSE -1 END) + 2.0*ret_1d AS trend_score,
  ret_5d, ret_20d, ret_60d, mom_3m, coalesce(mom_6m, 0) AS mom_6m, vol_20d, coalesce(vol_60d, 0) AS vol_60d, coalesce(volume/vma, 0) AS relative_volume,
  coalesce(volume_z20, 0) AS volume_z20, coalesce(100 - 100/(1 + ({roll('avg', 'up', 14)})/nullif({roll('avg', 'dn', 14)}, 0)), 0) AS rsi_14,
  coalesce((close - (mid - 2*sd))/nullif(4*sd, 0), 0) AS bb_position, (close - h20)/h20 AS dist_high_20, (close - l20)/l20 AS dist_low_20,
  overnight_gap, intraday, coalesce(mc, 0) AS market_corr FROM f2),
fmx AS (SELECT * FROM fm WHERE ret_20d IS NOT NULL AND mom_3m IS NOT NULL AND vol_20d IS NOT NULL AND fwd IS NOT NULL)"""


def matrix(spark, d, only=None):
    p = bars(spark, d)
    return X.feature_matrix(p, S.market(p), only=only)


@query("feature_matrix", "C35", K + " ".join(f"{c}:f" for c in X.FEATURE_COLUMNS) + " fwd:f", f"WITH {FM} SELECT * FROM fmx")
def feature_matrix(spark, d):
    return matrix(spark, d)
