"""Cross-section and regime queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.functions import windows as W
from barweave.operators import cross_section as X
from barweave.operators import features as T
from barweave.operators import joins
from barweave.operators import regimes as R
from barweave.plans.catalog import query
from barweave.plans.features import CAPM, FM, K, TREND, bars, bars_with, chg, matrix, pr, rets, rm, trend
from barweave.plans.sqlbase import MARKET, PRICES, RET, SECTORS, lagx, roll
from barweave.session import written
from barweave.sources import tables as S

SECTOR_NAMES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

# ret_20d and vol_20 with the sector of each name
X20 = RET + f""", {SECTORS},
x20 AS (SELECT ret.*, {chg(20)} AS ret_20d, {chg(60)} AS ret_60d, {roll('stddev_samp', 'r', 20)} AS vol_20, coalesce(sector, 'Other') AS sector
  FROM ret LEFT JOIN sectors USING (ticker))"""


def x20(spark, d):
    r = rets(spark, d).withColumns({"ret_20d": W.pct_change("close", 20), "ret_60d": W.pct_change("close", 60), "vol_20": W.roll_std("r", 20)})
    return joins.attach_dimension(r, S.sectors(spark, d), "ticker", {"sector": "Other"})


def zd(x, dd="stddev_samp"):
    sd = f"{dd}({x}) OVER (PARTITION BY date)"
    return f"({x} - avg({x}) OVER (PARTITION BY date)) / CASE WHEN {sd} > 1e-12 THEN {sd} END"


def callag(src, cols, fill=None, suffix="_lag"):
    """SQL calendar lag of ``src``: join on the previous calendar date."""
    pick = ", ".join(f"{f'coalesce(b.{c}, {fill})' if fill is not None else f'b.{c}'} AS {c}{suffix}" for c in cols)
    return f"""cal AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM {src})),
ci AS (SELECT s.*, idx FROM {src} s JOIN cal USING (date)),
cl AS (SELECT a.ticker, a.date, {pick} FROM ci a LEFT JOIN ci b ON a.ticker = b.ticker AND b.idx = a.idx - 1)"""


@query("cross_section_zscore", "D1", K + "ret_20d_z:f ret_20d_z0:f", f"""
WITH {X20} SELECT ticker, date, {zd('ret_20d')} AS ret_20d_z, {zd('ret_20d', 'stddev_pop')} AS ret_20d_z0 FROM x20""")
def cross_section_zscore(spark, d):
    return X.cs_zscore(X.cs_zscore(x20(spark, d), ["ret_20d"], 1), ["ret_20d"], 0, "_z0")


@query("cross_section_zscore_fill", "D2", K + "ret_20d_z:f vol_20_z:f", f"""
WITH {X20} SELECT ticker, date, coalesce({zd('ret_20d', 'stddev_pop')}, 0) AS ret_20d_z, coalesce({zd('vol_20', 'stddev_pop')}, 0) AS vol_20_z FROM x20""")
def cross_section_zscore_fill(spark, d):
    return X.cs_zscore(x20(spark, d), ["ret_20d", "vol_20"], 0, "_z", 0.0)


NUM = ["open", "high", "low", "close", "volume"]


@query("cross_section_zscore_all", "D3", K + " ".join(f"{c}_cs_z:f" for c in NUM), f"""
WITH {PRICES} SELECT ticker, date, {', '.join(f"({c} - avg({c}) OVER d) / CASE WHEN stddev_samp({c}) OVER d > 1e-12 THEN stddev_samp({c}) OVER d ELSE 1 END AS {c}_cs_z" for c in NUM)}
FROM prices WINDOW d AS (PARTITION BY date)""")
def cross_section_zscore_all(spark, d):
    return X.cs_zscore_all(bars(spark, d))


@query("zscore_then_calendar_lag", "D4", K + "overnight_gap_zl:f intraday_zl:f", f"""
WITH {PRICES}, g AS (SELECT ticker, date, open/{lagx('close')} - 1 AS og, close/open - 1 AS idr FROM prices),
z AS (SELECT ticker, date, {zd('og')} AS og, {zd('idr')} AS idr FROM g), {callag('z', ['og', 'idr'], 0)}
SELECT ticker, date, og_lag AS overnight_gap_zl, idr_lag AS intraday_zl FROM cl""")
def zscore_then_calendar_lag(spark, d):
    return X.zscore_then_lag(T.gaps(bars(spark, d)), ["overnight_gap", "intraday"])


@query("calendar_lag", "D5", K + "close_lag:f volume_lag:f", f"WITH {PRICES}, {callag('prices', ['close', 'volume'])} SELECT * FROM cl")
def calendar_lag(spark, d):
    return X.calendar_lag(bars(spark, d), ["close", "volume"])


def prank(x, part="date"):
    """Average-tie percentile rank in SQL."""
    return f"""CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part}, {x} IS NULL ORDER BY {x}) +
 (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {part}) END"""


@query("rank_then_row_lag", "D6", K + "mom_rank:f", f"""
WITH {X20}, k AS (SELECT ticker, date, {prank('ret_20d')} AS rk FROM x20) SELECT ticker, date, {lagx('rk')} AS mom_rank FROM k""")
def rank_then_row_lag(spark, d):
    return X.rank_then_row_lag(x20(spark, d), "ret_20d", "mom_rank")


@query("cross_section_rank", "D7", K + "ret_20d_rank:f volume_rank:f", f"""
WITH {X20} SELECT ticker, date, {prank('ret_20d')} AS ret_20d_rank, {prank('volume')} AS volume_rank FROM x20""")
def cross_section_rank(spark, d):
    return X.cs_rank(X.cs_rank(x20(spark, d), "ret_20d", "ret_20d_rank"), "volume", "volume_rank")


SREL = f"""sr AS (SELECT ticker, date, ret_20d - median(ret_20d) OVER (PARTITION BY date, sector) AS a,
  ret_60d - median(ret_60d) OVER (PARTITION BY date, sector) AS b FROM x20),
srz AS (SELECT ticker, date, {zd('a')} AS a, {zd('b')} AS b FROM sr), {callag('srz', ['a', 'b'], 0)}"""


@query("sector_relative_momentum", "D8", K + "sector_relative_20d:f sector_relative_60d:f", f"""
WITH {X20}, {SREL} SELECT ticker, date, a_lag AS sector_relative_20d, b_lag AS sector_relative_60d FROM cl""")
def sector_relative_momentum(spark, d):
    out = X.sector_relative(x20(spark, d), ["ret_20d", "ret_60d"])
    return out.withColumnsRenamed({"ret_20d_rel_zl": "sector_relative_20d", "ret_60d_rel_zl": "sector_relative_60d"})


@query("volatility_rank_no_benchmark", "D9", K + "vol_rank:f", f"""
WITH {X20}, v AS (SELECT * FROM x20 WHERE vol_20 IS NOT NULL AND ticker NOT IN (SELECT ticker FROM sectors WHERE nation = 'FRANCE')),
k AS (SELECT ticker, date, {prank('vol_20')} AS rk FROM v) SELECT ticker, date, {lagx('rk')} AS vol_rank FROM k""")
def volatility_rank_no_benchmark(spark, d):
    bench = S.sectors(spark, d).where("nation = 'FRANCE'")
    return X.vol_rank_feature(rets(spark, d), bench)


@query("inject_panel_columns", "D10", K + "trend_score:f mom_rank:f", f"""
WITH {TREND}, k AS (SELECT ticker, date, {prank('ret_1d')} AS rk FROM tf WHERE abs(ret_1d) > 0.02)
SELECT ts.ticker, ts.date, trend_score, coalesce(rk, 0) AS mom_rank FROM ts LEFT JOIN k USING (ticker, date)""")
def inject_panel_columns(spark, d):
    t = trend(spark, d)
    k = X.cs_rank(t.where("abs(ret_1d) > 0.02").select("ticker", "date", "ret_1d"), "ret_1d", "mom_rank")
    return joins.left_fill(t, k, ["ticker", "date"], {"mom_rank": 0.0})


@query("market_breadth", "D11", "date:d above_fast:f above_slow:f up:i down:i adv_decline:f", f"""
WITH {PRICES}, cal AS (SELECT DISTINCT date FROM prices), tk AS (SELECT ticker, min(date) AS f FROM prices GROUP BY ticker),
g AS (SELECT tk.ticker, cal.date, last_value(p.close IGNORE NULLS) OVER (PARTITION BY tk.ticker ORDER BY cal.date) AS close
  FROM tk JOIN cal ON cal.date >= tk.f LEFT JOIN prices p ON p.ticker = tk.ticker AND p.date = cal.date),
a AS (SELECT *, {roll('avg', 'close', 50, 10)} AS f, {roll('avg', 'close', 200, 40)} AS s, {lagx('close')} AS p FROM g)
SELECT date, count(*) FILTER (close > f) / nullif(count(f), 0)::DOUBLE AS above_fast, count(*) FILTER (close > s) / nullif(count(s), 0)::DOUBLE AS above_slow,
 count(*) FILTER (close > p) AS up, count(*) FILTER (close < p) AS down, count(*) FILTER (close > p) / (count(*) FILTER (close < p) + 1)::DOUBLE AS adv_decline
FROM a GROUP BY date""")
def market_breadth(spark, d):
    return X.breadth(bars(spark, d))


SA = X20 + ", sa AS (SELECT date, sector, avg(ret_20d) AS mom, avg(vol_20) AS vol FROM x20 GROUP BY date, sector)"


@query("sector_aggregates", "D12", "date:d sector:s mom:f vol:f", f"WITH {SA} SELECT * FROM sa")
def sector_aggregates(spark, d):
    return X.sector_aggregates(x20(spark, d), {"mom": "ret_20d", "vol": "vol_20"})


@query("sector_aggregates_wide", "D12", "date:d africa:f america:f asia:f europe:f middle_east:f", f"""
WITH {SA} SELECT date, max(mom) FILTER (sector = 'AFRICA') AS africa, max(mom) FILTER (sector = 'AMERICA') AS america,
 max(mom) FILTER (sector = 'ASIA') AS asia, max(mom) FILTER (sector = 'EUROPE') AS europe, max(mom) FILTER (sector = 'MIDDLE EAST') AS middle_east FROM sa GROUP BY date""")
def sector_aggregates_wide(spark, d):
    a = X.sector_aggregates(x20(spark, d), {"mom": "ret_20d", "vol": "vol_20"})
    return X.sector_wide(a, "mom", SECTOR_NAMES).withColumnsRenamed({s: s.lower().replace(" ", "_") for s in SECTOR_NAMES})


@query("sector_adjusted_score", "D13", K + "adjusted_score:f signal:s", f"""
WITH {SA}, a AS (SELECT ticker, date, ret_20d*10 + 0.1*coalesce(mom, 0) - 0.05*coalesce(vol, 0) AS adjusted_score FROM x20 JOIN sa USING (date, sector) WHERE ret_20d IS NOT NULL)
SELECT *, CASE WHEN adjusted_score > 0.5 THEN 'Bullish' WHEN adjusted_score < -0.5 THEN 'Bearish' ELSE 'Neutral' END AS signal FROM a""")
def sector_adjusted_score(spark, d):
    x = x20(spark, d)
    agg = X.sector_aggregates(x, {"mom": "ret_20d", "vol": "vol_20"})
    scored = x.where("ret_20d is not null").withColumn("score", F.col("ret_20d") * 10)
    return X.sector_adjusted(scored, agg, {"mom": 0.1, "vol": -0.05})


MV = f"""mk0 AS (SELECT *, ({roll('stddev_samp', 'm', 5, 5, 'mkt')})*sqrt(252) AS v5, ({roll('stddev_samp', 'm', 60, 60, 'mkt')})*sqrt(252) AS v60 FROM market),
mk AS (SELECT *, lag(v5/nullif(v60, 0)) OVER (ORDER BY date) AS vol_spike FROM mk0)"""


@query("macro_attach", "D14", K + "close:f vol_spike:f", f"""
WITH {MARKET}, {MV} SELECT ticker, prices.date, close, coalesce(vol_spike, 0) AS vol_spike FROM prices LEFT JOIN mk USING (date)""")
def macro_attach(spark, d):
    p = bars(spark, d)
    return X.attach_macro(p, T.market_vol_spike(S.market(p)), ["vol_spike"])


BENCH = """mi AS (SELECT *, 100*exp(sum(ln(1 + m)) OVER (ORDER BY date)) AS close FROM market),
bench AS (SELECT date, lead(close, 5) OVER (ORDER BY date)/close - 1 AS bench_fwd FROM mi)"""


def benchmark(spark, d, market=None):
    i = R.market_index(S.market(bars(spark, d)) if market is None else market)
    return i.withColumn("bench_fwd", W.safe_div(W.lead("close", 5, "mkt"), "close") - 1).select("date", "bench_fwd")


@query("excess_forward_return", "D15", K + "fwd:f excess:f", f"""
WITH {MARKET}, {BENCH}, l AS (SELECT ticker, date, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date)/close - 1 AS fwd FROM prices)
SELECT ticker, l.date, fwd, fwd - coalesce(bench_fwd, 0) AS excess FROM l LEFT JOIN bench USING (date)""")
def excess_forward_return(spark, d):
    return X.excess_forward(T.forward_labels(bars(spark, d)), benchmark(spark, d))


@query("score_dispersion", "D16", "date:d score_std:f score_range:f n:i flat:b", f"""
WITH {TREND}, a AS (SELECT date, stddev_pop(trend_score) AS score_std, max(trend_score) - min(trend_score) AS score_range, count(trend_score) AS n FROM ts GROUP BY date)
SELECT *, score_std < 1e-6 OR score_range < 1e-6 AS flat FROM a""")
def score_dispersion(spark, d):
    return X.dispersion(trend(spark, d), "trend_score")


@query("training_panel", "D17", K + "trend_score:f ret_20d_rel_zl:f vol_rank:f rsi_14_zl:f bb_position_zl:f overnight_gap_zl:f vol_spike:f excess:f mom_6m:f", f"""
WITH {FM}, {SECTORS}, {MV}, {BENCH},
a AS (SELECT fmx.*, sector FROM fmx LEFT JOIN sectors USING (ticker)),
b AS (SELECT *, ret_20d - median(ret_20d) OVER (PARTITION BY date, sector) AS rel, {prank('vol_20d')} AS vrk FROM a),
c AS (SELECT *, {lagx('vrk')} AS vol_rank, {zd('rel')} AS relz, {zd('rsi_14')} AS rz, {zd('bb_position')} AS bz, {zd('overnight_gap')} AS oz FROM b),
{callag('c', ['relz', 'rz', 'bz', 'oz'], 0)}
SELECT c.ticker, c.date, trend_score, relz_lag AS ret_20d_rel_zl, vol_rank, rz_lag AS rsi_14_zl, bz_lag AS bb_position_zl, oz_lag AS overnight_gap_zl,
 coalesce(vol_spike, 0) AS vol_spike, fwd - coalesce(bench_fwd, 0) AS excess, 0.0 AS mom_6m
FROM c JOIN cl USING (ticker, date) LEFT JOIN mk USING (date) LEFT JOIN bench USING (date)""")
def training_panel(spark, d):
    market = written(S.market(bars(spark, d)), "market")  # a row per calendar date

    def matrix(columns, before=(), ranks=None):
        made = [] if ranks is None else [c for c in ranks.columns if c not in ("ticker", "date")]
        return T.feature_matrix(bars_with(spark, d, ranks), market, only=columns, before=[*before, *made], carry=["sector"])

    return X.training_panel(matrix, T.market_vol_spike(market), benchmark(spark, d, market), ["trend_score"], ablate=("mom_6m",))


def neutral_input(spark, d):
    c = rm(spark, d).withColumn("score", W.pct_change("close", 20) * 10)
    c = W.add_frames(c.select("ticker", "date", "close", "volume", "r", "m", "score"), T.capm_frames() | {"_adv": ("mean", "volume", 21, 5)})
    c = c.withColumn("size", F.ln(F.greatest(F.col("close") * F.col("_adv"), F.lit(1.0)))).where("score is not null")
    return joins.attach_dimension(c.select("ticker", "date", "score", "capm_beta", "size"), S.sectors(spark, d), "ticker", {"sector": "Other"})


NEUTRAL = f"""{CAPM}, {SECTORS},
nb AS (SELECT c3.ticker, c3.date, coalesce(sector, 'Other') AS sector, ({chg(20)})*10 AS score, coalesce(capm_beta, 0) AS capm_beta, ln(greatest(close*({roll('avg', 'volume', 21, 5)}), 1)) AS size0 FROM c3 LEFT JOIN sectors USING (ticker)),
nc AS (SELECT *, coalesce(size0, 0) AS size FROM nb WHERE score IS NOT NULL),
nd AS (SELECT *, score - avg(score) OVER g AS y, capm_beta - avg(capm_beta) OVER g AS u, size - avg(size) OVER g AS v FROM nc WINDOW g AS (PARTITION BY date, sector)),
ne AS (SELECT date, count(*) AS n, count(DISTINCT sector) AS s, sum(u*u) AS uu, sum(v*v) AS vv, sum(u*v) AS uv, sum(u*y) AS uy, sum(v*y) AS vy FROM nd GROUP BY date),
nf AS (SELECT date, CASE WHEN n < 10 OR n <= 1 + s THEN NULL WHEN uu <= 1e-12*vv THEN 0 WHEN vv <= 1e-12*uu THEN uy/uu ELSE (uy*vv - vy*uv)/(uu*vv - uv*uv) END AS b,
  CASE WHEN n < 10 OR n <= 1 + s THEN NULL WHEN uu <= 1e-12*vv THEN CASE WHEN vv > 0 THEN vy/vv ELSE 0 END WHEN vv <= 1e-12*uu THEN 0 ELSE (vy*uu - uy*uv)/(uu*vv - uv*uv) END AS c FROM ne),
ng AS (SELECT nd.*, CASE WHEN b IS NULL THEN score ELSE y - b*u - c*v END AS residual FROM nd JOIN nf USING (date))"""


@query("factor_neutral_scores", "D18", K + "score:f residual:f signal:s", f"""
WITH {NEUTRAL} SELECT ticker, date, score, residual, CASE WHEN residual > 0.5 THEN 'Bullish' WHEN residual < -0.5 THEN 'Bearish' ELSE 'Neutral' END AS signal FROM ng""")
def factor_neutral_scores(spark, d):
    return X.neutralise(neutral_input(spark, d), "score", ["capm_beta", "size"])


@query("single_factor_neutral", "D18", K + "residual:f", f"""
WITH {X20}, a AS (SELECT ticker, date, ret_20d*10 AS score, vol_20 FROM x20 WHERE ret_20d IS NOT NULL AND vol_20 IS NOT NULL)
SELECT ticker, date, score - avg(score) OVER d - coalesce(covar_pop(score, vol_20) OVER d / nullif(var_pop(vol_20) OVER d, 0), 0) * (vol_20 - avg(vol_20) OVER d) AS residual
FROM a WINDOW d AS (PARTITION BY date)""")
def single_factor_neutral(spark, d):
    a = x20(spark, d).where("ret_20d is not null and vol_20 is not null").withColumn("score", F.col("ret_20d") * 10)
    return X.neutralise_one(a, "score", "vol_20")


def cor(x, y):
    return f"CASE WHEN stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN corr({x}, {y}) END"


@query("exposure_diagnostics", "D19", "factor:s before:f after:f n_dates:i", f"""
WITH {NEUTRAL}, nh AS (SELECT date, {', '.join(f"{cor(f, y)} AS {y[0]}_{f}" for f in ('capm_beta', 'size') for y in ('score', 'residual'))} FROM ng GROUP BY date)
{' UNION ALL '.join(f"SELECT '{f}' AS factor, avg(s_{f}) AS before, avg(r_{f}) AS after, count(s_{f}) AS n_dates FROM nh" for f in ('capm_beta', 'size'))}""")
def exposure_diagnostics(spark, d):
    n = X.neutralise(neutral_input(spark, d), "score", ["capm_beta", "size"])
    return X.exposure_report(n, "score", ["capm_beta", "size"])


# --- regimes ---------------------------------------------------------------------

NR = f"""n0 AS (SELECT *, {roll('avg', 'close', 50, 10)} AS f, {roll('avg', 'close', 200, 40)} AS s, {roll('stddev_samp', 'r', 20, 10)} AS v0 FROM ret),
n1 AS (SELECT *, v0*sqrt(252) AS v FROM n0), n2 AS (SELECT *, {pr('round(v, 10)', 252, 20)} AS vp FROM n1)"""


@query("name_regimes", "E1", K + "trend_regime:s volatility_regime:s regime_score:f", f"""
WITH {RET}, {NR}, l AS (SELECT ticker, date, CASE WHEN close > f AND close > s AND f > s THEN 'bull_trend' WHEN close < f AND close < s AND f < s THEN 'bear_trend' ELSE 'sideways' END AS trend_regime,
 CASE WHEN vp < 0.33 THEN 'low_vol' WHEN vp > 0.67 THEN 'high_vol' ELSE 'normal_vol' END AS volatility_regime FROM n2)
SELECT *, CASE trend_regime WHEN 'bull_trend' THEN 1.0 WHEN 'bear_trend' THEN -1.0 ELSE 0.0 END * CASE volatility_regime WHEN 'low_vol' THEN 1.0 WHEN 'high_vol' THEN 0.0 ELSE 0.5 END AS regime_score FROM l""")
def name_regimes(spark, d):
    return R.name_regime(rets(spark, d))


# demo thresholds fit the derived market; the function defaults are the usual ones
REG = MARKET + f""", mi AS (SELECT *, 100*exp(sum(ln(1 + m)) OVER (ORDER BY date)) AS close FROM market),
rg0 AS (SELECT *, {roll('avg', 'close', 50, 50, 'mkt')} AS f, {roll('avg', 'close', 200, 200, 'mkt')} AS s,
  coalesce(({roll('stddev_samp', 'm', 20, 20, 'mkt')})*sqrt(252)*100, 15) AS vol_level FROM mi),
rg AS (SELECT *, CASE WHEN s IS NULL OR f IS NULL THEN 'Sideways' WHEN vol_level >= 20 THEN 'Crisis' WHEN close > s AND f > s THEN 'Bull'
  WHEN close < s AND f < s THEN 'Bear' ELSE 'Sideways' END AS regime FROM rg0)"""


def regimes(spark, d):
    return R.market_regime(R.market_index(S.market(bars(spark, d))), crisis=20.0)


@query("market_regimes", "E2", "date:d vol_level:f regime:s", f"WITH {REG} SELECT * FROM rg")
def market_regimes(spark, d):
    return regimes(spark, d)


@query("market_regimes_vol_first", "E3", "date:d regime:s", f"""
WITH {MARKET}, mi AS (SELECT *, 100*exp(sum(ln(1 + m)) OVER (ORDER BY date)) AS close FROM market),
a AS (SELECT *, {roll('avg', 'close', 200, 200, 'mkt')} AS s, {roll('stddev_samp', 'm', 20, 20, 'mkt')} AS v FROM mi),
b AS (SELECT *, {roll('avg', 'v', 200, 200, 'mkt')} AS vm FROM a)
SELECT date, CASE WHEN v > 1.2*vm THEN 'HighVol' WHEN close > s THEN 'Bull' WHEN close < s THEN 'Bear' ELSE 'Normal' END AS regime FROM b""")
def market_regimes_vol_first(spark, d):
    return R.market_regime_vol_first(R.market_index(S.market(bars(spark, d))), 1.2)


@query("regime_label_normalise", "E4", K + "trend_regime:s regime:s", f"""
WITH {RET}, {NR}, l AS (SELECT ticker, date, CASE WHEN vp > 0.67 THEN 'high_vol' WHEN close > f AND close > s AND f > s THEN 'bull_trend' WHEN close < f AND close < s AND f < s THEN 'bear_trend' ELSE 'unknown' END AS trend_regime FROM n2)
SELECT *, CASE trend_regime WHEN 'high_vol' THEN 'HighVol' WHEN 'bull_trend' THEN 'Bull' WHEN 'bear_trend' THEN 'Bear' ELSE 'Sideways' END AS regime FROM l""")
def regime_label_normalise(spark, d):
    n = R.name_regime(rets(spark, d))
    raw = F.when(F.col("vol_pct") > 0.67, "high_vol").when(F.col("trend_regime") != "sideways", F.col("trend_regime")).otherwise("unknown")
    return n.withColumn("trend_regime", raw).withColumn("regime", R.canonical(F.col("trend_regime")))


@query("regime_spell_counter", "E5", "date:d regime:s day_in_state:i entered:b", f"""
WITH {REG}, i AS (SELECT date, regime, sum(CASE WHEN regime = 'Bear' THEN 0 ELSE 1 END) OVER (ORDER BY date) AS isl FROM rg),
c AS (SELECT date, regime, CASE WHEN regime = 'Bear' THEN row_number() OVER (PARTITION BY isl, regime = 'Bear' ORDER BY date) ELSE 0 END AS day_in_state FROM i)
SELECT *, day_in_state = 1 AS entered FROM c""")
def regime_spell_counter(spark, d):
    return R.spell_counter(regimes(spark, d), "Bear")


@query("regime_lookups", "E6", "date:d regime:s scale:f sigma_mult:f aggressiveness:f", f"""
WITH {REG} SELECT date, regime, CASE regime WHEN 'Bull' THEN 1.0 WHEN 'Sideways' THEN 0.8 WHEN 'Bear' THEN 0.5 WHEN 'Crisis' THEN 0.3 ELSE 0.8 END AS scale,
 CASE regime WHEN 'Sideways' THEN 1.1 WHEN 'Bear' THEN 1.25 WHEN 'Crisis' THEN 1.5 ELSE 1.0 END AS sigma_mult,
 least(CASE regime WHEN 'Bear' THEN 40.0 ELSE 1.0 END, 20.0) AS aggressiveness FROM rg""")
def regime_lookups(spark, d):
    r = R.regime_lookup(regimes(spark, d), R.POSITION_SCALE, "scale", {"Bear": 0.5}, 0.8)
    r = R.regime_lookup(r, R.SIGMA_MULT, "sigma_mult")
    return R.regime_lookup(r, {"Bear": 40.0}, "aggressiveness", cap=20.0)


@query("regime_score_std", "E7", "regime:s n:i score_std:f", f"""
WITH {REG}, {TREND.split(PRICES)[1].lstrip(', ')}, a AS (SELECT regime, count(trend_score) AS n, stddev_samp(trend_score) AS sd FROM ts JOIN rg ON ts.date = rg.date GROUP BY regime)
SELECT regime, n, CASE WHEN n >= 10 AND sd > 0 THEN sd ELSE 0.1 END AS score_std FROM a""")
def regime_score_std(spark, d):
    j = joins.by_date(trend(spark, d).select("ticker", "date", "trend_score"), regimes(spark, d).select("date", "regime"))
    return R.regime_score_std(j, "trend_score")


@query("date_inner_join", "H1", "date:d m:f pnl:f", f"""
WITH {MARKET}, e AS (SELECT CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INTEGER) AS date, sum(l_extendedprice*(l_discount - l_tax)) AS pnl FROM lineitem GROUP BY 1)
SELECT date, m, pnl FROM market JOIN e USING (date)""")
def date_inner_join(spark, d):
    e = S.trades(spark, d).groupBy(F.col("exit_date").alias("date")).agg(F.sum("pnl").alias("pnl"))
    return joins.by_date(S.market(bars(spark, d)), e)


@query("date_full_outer_join", "H3", "date:d m:f score:f", f"""
WITH {MARKET}, s AS (SELECT CAST(ts AS DATE) - 8100 AS date, avg(value) AS score FROM events GROUP BY 1)
SELECT coalesce(market.date, s.date) AS date, m, score FROM market FULL JOIN s ON market.date = s.date""")
def date_full_outer_join(spark, d):
    s = S.ticks(spark, d).groupBy(F.date_sub(F.to_date("ts"), 8100).alias("date")).agg(F.avg("score").alias("score"))
    return joins.outer_by_date(S.market(bars(spark, d)), s)
