"""Model-fitting, validation, scenario, option, text and stateful queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.functions import windows as W
from barweave.operators import features as T
from barweave.operators import learning as L
from barweave.operators import options as O
from barweave.operators import scenarios as N
from barweave.operators import stateful as ST
from barweave.operators import text as P
from barweave.operators import cross_section as X
from barweave.operators import joins
from barweave.plans.catalog import query
from barweave.plans.cross import BENCH, benchmark, regimes
from barweave.plans.features import FM, K, LOGN, TREND, bars, ewm_sql, matrix, rets, trend
from barweave.plans.performance import ER, WR, eq, log, srank
from barweave.plans.select import BLOT, SCORED, SIG, blotter, scored, scored_fwd, signals
from barweave.plans.sqlbase import EQUITY, MARKET, NEWS, PRICES, RET, TRADES, lagx, roll, win
from barweave.session import written
from barweave.sources import tables as S

XS = ["ret_5d", "ret_20d", "mom_3m", "vol_20d", "volume_z20", "bb_position"]


def labelled(spark, d):
    return X.excess_forward(matrix(spark, d), benchmark(spark, d))


FMB = FM + ", " + BENCH + ", fx AS (SELECT fmx.*, fwd - coalesce(bench_fwd, 0) AS excess FROM fmx LEFT JOIN bench USING (date))"


@query("target_variants", "M1", K + "target_raw:f target_excess:f target_scaled:f", f"""
WITH {FMB} SELECT ticker, date, fwd AS target_raw, excess AS target_excess, fwd/nullif({roll('stddev_samp', 'fwd', 20)}, 0) AS target_scaled FROM fx""")
def target_variants(spark, d):
    return L.targets(labelled(spark, d))


@query("sample_weights", "M2", K + "sample_weight:f", f"""
WITH {FM} SELECT ticker, date, exp(-0.001*((SELECT max(date) FROM fmx) - date))*CASE WHEN abs(fwd) - 0.004 <= 0 THEN 0.25 ELSE 1 END AS sample_weight FROM fmx""")
def sample_weights(spark, d):
    return L.sample_weights(matrix(spark, d))


@query("effective_sample_size", "M3", "n:i rho_sum:f ess:i", f"""
WITH {MARKET}, l AS (SELECT m, {', '.join(f'lag(m, {k}) OVER (ORDER BY date) AS l{k}' for k in range(1, 21))} FROM market),
a AS (SELECT count(m) AS n, {' + '.join(f'abs(coalesce(corr(m, l{k}), 0))' for k in range(1, 21))} AS rho_sum FROM l)
SELECT n, rho_sum, greatest(1, CAST(round(n/(1 + 2*rho_sum)) AS BIGINT)) AS ess FROM a""")
def effective_sample_size(spark, d):
    return L.effective_sample_size(S.market(bars(spark, d)), "m")


@query("model_fits", "M4", "model:s feature:s weight:f")
def model_fits(spark, d):
    rows = written(matrix(spark, d, [*XS, "fwd", "label"]), "model-rows")  # read by the last date, the scaler and the fits
    return L.ml_fits(L.sample_weights(rows), XS, "fwd", "label", "sample_weight")


@query("ridge_weight_table", "M4", "feature:s n:i weight:f")
def ridge_weight_table(spark, d):
    m = L.sample_weights(matrix(spark, d)).withColumn("one", F.lit("all"))
    fit = L.fit_sums(L.date_sums(m, XS, "fwd", "sample_weight", ("one",)), len(XS) + 1, 10.0)
    return L.weight_table(fit, XS, ["one"])


@query("single_feature_regression", "M4", "n:i slope:f intercept:f", f"""
WITH {FM} SELECT count(*) AS n, regr_slope(fwd, ret_20d) AS slope, regr_intercept(fwd, ret_20d) AS intercept FROM fmx""")
def single_feature_regression(spark, d):
    m = matrix(spark, d).withColumn("one", F.lit("all"))
    fit = L.fit_sums(L.date_sums(m, ["ret_20d"], "fwd", None, ("one",)), 2, 0.0)
    return fit.select("n", F.col("coef")[1].alias("slope"), F.col("coef")[0].alias("intercept"))


@query("regime_ridge_fits", "M5", "regime:s n:i feature:s weight:f")
def regime_ridge_fits(spark, d):
    m = joins.by_date(matrix(spark, d), regimes(spark, d).select("date", "regime"), "left").fillna("Sideways", subset=["regime"])
    return L.weight_table(L.regime_fits(m, XS, "fwd"), XS, ["regime"])


EQW = """sp AS (SELECT min(date) AS a, (max(date) - min(date)) // 4 AS len FROM prices),
wd AS (SELECT w AS "window", a + CAST(w*len AS INTEGER) AS tr0, a + CAST(w*len + floor(len*0.7) AS INTEGER) - 1 AS tr1, a + CAST(w*len + floor(len*0.7) AS INTEGER) AS te0, a + CAST((w + 1)*len AS INTEGER) - 1 AS te1
  FROM sp, generate_series(0, 3) g(w))"""


@query("equal_window_splits", "M6", "window_no:i part:s first:d last:d n_dates:i n_rows:i", f"""
WITH {PRICES}, {EQW}, p AS (SELECT "window", 'train' AS part, tr0 AS lo, tr1 AS hi FROM wd UNION ALL SELECT "window", 'test', te0, te1 FROM wd)
SELECT "window" AS window_no, part, min(date) AS first, max(date) AS last, count(DISTINCT date) AS n_dates, count(*) AS n_rows FROM prices JOIN p ON date BETWEEN lo AND hi GROUP BY ALL""")
def equal_window_splits(spark, d):
    p = bars(spark, d)
    return L.split_counts(p, L.equal_windows(p)).withColumnRenamed("window", "window_no")


@query("rolling_window_splits", "M6", "window_no:i train_start:d train_end:d test_start:d test_end:d", f"""
WITH {PRICES}, s AS (SELECT min(date) AS a, max(date) AS b FROM prices), g AS (SELECT b, CAST(a + to_months(CAST(3*i AS INTEGER)) AS DATE) AS t0 FROM s, generate_series(0, 200) x(i)),
w AS (SELECT b, t0, CAST(t0 + INTERVAL 24 MONTH AS DATE) AS te0, CAST(CAST(t0 + INTERVAL 24 MONTH AS DATE) + INTERVAL 3 MONTH AS DATE) - 1 AS te1 FROM g)
SELECT row_number() OVER (ORDER BY t0) - 1 AS window_no, t0 AS train_start, te0 - 1 AS train_end, te0 AS test_start, te1 AS test_end FROM w WHERE te1 <= b""")
def rolling_window_splits(spark, d):
    return L.rolling_windows(bars(spark, d)).withColumnRenamed("window", "window_no")


FOLDS = """cal0 AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM fmx)), cn AS (SELECT count(*) // 6 AS s FROM cal0),
fd AS (SELECT date, idx, f AS fold, CASE WHEN idx BETWEEN f*s + 1 AND CASE WHEN f = 5 THEN 1000000000 ELSE f*s + s END THEN 'test' WHEN idx < f*s + 1 - 10 THEN 'train' END AS part FROM cal0, cn, generate_series(1, 5) g(f))"""


@query("walk_forward_folds", "M7", "fold:i part:s first:d last:d n_dates:i", f"""
WITH {FM}, {FOLDS} SELECT fold, part, min(date) AS first, max(date) AS last, count(*) AS n_dates FROM fd WHERE part IS NOT NULL GROUP BY fold, part""")
def walk_forward_folds(spark, d):
    return L.expanding_folds(matrix(spark, d)).groupBy("fold", "part").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("n_dates"))


@query("walk_forward_metrics", "M7", "fold:i alpha:f ic:f accuracy:f auc:f n:i")
def walk_forward_metrics(spark, d):
    return L.penalty_metrics(matrix(spark, d, [*XS, "fwd"]), XS, "fwd", (10.0,))


@query("walk_forward_single_feature", "M7", "fold:i n:i mse:f corr:f", f"""
WITH {FM}, {FOLDS}, t AS (SELECT fold, regr_slope(fwd, ret_20d) AS b, regr_intercept(fwd, ret_20d) AS a FROM fmx JOIN fd USING (date) WHERE part = 'train' GROUP BY fold),
o AS (SELECT fold, a + b*ret_20d AS p, fwd FROM fmx JOIN fd USING (date) JOIN t USING (fold) WHERE part = 'test')
SELECT fold, count(*) AS n, avg((p - fwd)*(p - fwd)) AS mse, corr(p, fwd) AS corr FROM o GROUP BY fold""")
def walk_forward_single_feature(spark, d):
    from barweave.functions.mathx import corr_of

    o = L.walk_forward(matrix(spark, d), ["ret_20d"], "fwd", (0.0,))
    return o.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("score") - F.col("fwd")) ** 2).alias("mse"), corr_of("score", "fwd").alias("corr"))


@query("walk_forward_chained", "M8", "n_days:i sharpe:f cagr:f ic:f", f"""
WITH {FM}, {FOLDS}, t AS (SELECT fold, regr_slope(fwd, ret_20d) AS b, regr_intercept(fwd, ret_20d) AS a FROM fmx JOIN fd USING (date) WHERE part = 'train' GROUP BY fold),
o AS (SELECT ticker, date, round(a + b*ret_20d, 10) AS p, fwd FROM fmx JOIN fd USING (date) JOIN t USING (fold) WHERE part = 'test' AND ret_20d IS NOT NULL AND fwd IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY p DESC, ticker) AS rn FROM o WHERE p > 0),
m AS (SELECT date, avg(fwd) AS m FROM r WHERE rn <= 10 GROUP BY date), d AS (SELECT date, coalesce(m, 0) AS ret FROM (SELECT DISTINCT date FROM o) LEFT JOIN m USING (date))
SELECT count(*) AS n_days, avg(ret)/nullif(stddev_samp(ret), 0)*sqrt(252) AS sharpe, exp(sum(ln(1 + ret))*252/count(*)) - 1 AS cagr, (SELECT corr(p, fwd) FROM o) AS ic FROM d""")
def walk_forward_chained(spark, d):
    o = L.walk_forward(matrix(spark, d), ["ret_20d"], "fwd", (0.0,)).where("fwd is not null")
    return L.chained_totals(o.withColumn("score", F.round("score", 10)))


@query("walk_forward_report", "M8", "fold:i n_days:i sharpe:f total:f ic:f leak_suspect:b rank:i")
def walk_forward_report(spark, d):
    return L.chained_report(L.walk_forward(matrix(spark, d, [*XS, "fwd"]), XS, "fwd"))


@query("feature_leakage_check", "M9", "n_rows:i missing:i diff_trend_score:i diff_rsi_14:i diff_bb_position:i diff_rsi_14_z:i diff_bb_position_z:i diff_trend_rank:i", f"""
WITH {PRICES} SELECT count(*) - count(DISTINCT ticker) AS n_rows, 0 AS missing, 0 AS diff_trend_score, 0 AS diff_rsi_14, 0 AS diff_bb_position, 0 AS diff_rsi_14_z, 0 AS diff_bb_position_z, 0 AS diff_trend_rank FROM prices WHERE date <= DATE '1998-12-31'""")
def feature_leakage_check(spark, d):
    def feats(p):
        t = T.trend_score(T.trend_features(p)).select("ticker", "date", "close", "trend_score")
        f = W.add_frames(t, T.rsi_frames() | T.bollinger_frames()).drop("close")
        z = X.cs_zscore(written(f, "features"), ["rsi_14", "bb_position"])
        return X.cs_rank(z, "trend_score", "trend_rank")

    p = bars(spark, d)
    # the first row of each ticker is dropped by the trend features
    return L.leakage_check(feats(p), feats(p.where("date <= date'1998-12-31'")), ["trend_score", "rsi_14", "bb_position", "rsi_14_z", "bb_position_z", "trend_rank"])


@query("blend_weight_grid", "M11", "w:f ic:f n:i rank:i", f"""
WITH {FM}, h AS (SELECT ret_20d AS a, -bb_position AS b, fwd FROM fmx WHERE date >= DATE '2000-01-01'),
g AS (SELECT w, round(w*a + (1 - w)*b, 10) AS bl, fwd FROM h, (SELECT i/10.0::DOUBLE AS w FROM generate_series(0, 10) x(i))),
k AS (SELECT w, {srank('bl', 'w')} AS rx, {srank('fwd', 'w')} AS ry FROM g), i AS (SELECT w, corr(rx, ry) AS ic, count(*) AS n FROM k GROUP BY w)
SELECT *, row_number() OVER (ORDER BY ic DESC, w) AS rank FROM i""")
def blend_weight_grid(spark, d):
    h = matrix(spark, d).where("date >= date'2000-01-01'").select(F.col("ret_20d").alias("a"), (-F.col("bb_position")).alias("b"), "fwd")
    return L.blend_grid(h, "a", "b", "fwd")


@query("ridge_penalty_search", "M12", "alpha:f mean_ic:f mean_auc:f folds:i rank:i")
def ridge_penalty_search(spark, d):
    return L.best_alpha(L.penalty_metrics(matrix(spark, d, [*XS, "fwd"]), XS, "fwd", (0.1, 10.0, 1000.0), 3))


@query("latent_factors_fixed", "M13", K + "factor_1:f factor_2:f factor_3:f")
def latent_factors_fixed(spark, d):
    return L.latent_factors_fixed(matrix(spark, d, [*XS, "fwd"]), XS, "1999-01-01")


@query("latent_factors_expanding", "M13", K + "factor_1:f factor_2:f factor_3:f")
def latent_factors_expanding(spark, d):
    return L.latent_factors_expanding(matrix(spark, d, [*XS, "fwd"]), XS)


@query("model_acceptance", "M14", "windows:i won:i old_mean:f new_mean:f ratio:f accept:b", f"""
WITH {FM}, {FOLDS}, o AS (SELECT fold, corr(ret_5d, fwd) AS a, corr(-bb_position, fwd) AS b FROM fmx JOIN fd USING (date) WHERE part = 'test' AND ret_5d IS NOT NULL GROUP BY fold),
g AS (SELECT count(*) AS windows, count(*) FILTER (b > a) AS won, avg(a) AS old_mean, avg(b) AS new_mean FROM o)
SELECT *, new_mean/nullif(old_mean, 0) AS ratio, windows > 0 AND won/windows >= 0.5 AND (old_mean <= 1e-6 OR new_mean >= 0.85*old_mean) AS accept FROM g""")
def model_acceptance(spark, d):
    from barweave.functions.mathx import corr_of

    m = matrix(spark, d)
    t = m.join(F.broadcast(L.expanding_folds(m).where("part = 'test'").select("date", "fold")), "date")
    ic = t.groupBy("fold").agg(corr_of("ret_5d", "fwd").alias("a"), corr_of(-F.col("bb_position"), "fwd").alias("b"))
    return L.accept_model(ic.select("fold", F.col("a").alias("ic")), ic.select("fold", F.col("b").alias("ic")), "ic")


# --- scenarios -------------------------------------------------------------------

GRID = {"span": [3, 5, 10], "hold": [3, 5, 10], "cut": [0.3, 0.5]}
GSQL = "(SELECT * FROM (VALUES (3), (5), (10)) a(span), (VALUES (3), (5), (10)) b(hold), (VALUES (0.3::DOUBLE), (0.5::DOUBLE)) c(cut) WHERE hold >= span)"


@query("parameter_grid", "N1", "sector:s span:i hold:i cut:f", f"SELECT r_name AS sector, g.* FROM region, {GSQL} g")
def parameter_grid(spark, d):
    return N.with_grid(S.table(spark, d, "region").select(F.col("r_name").alias("sector")), GRID, "hold >= span")


@query("cost_sensitivity", "N2", "slippage_bps:f commission_bps:f n:i net_return:f net_ratio:f net_pnl:f", f"""
WITH {TRADES} SELECT s AS slippage_bps, c AS commission_bps, count(*) AS n, avg(ret - 2*(s + c)/10000) AS net_return, avg(ret - 2*(s + c)/10000)/stddev_samp(ret - 2*(s + c)/10000) AS net_ratio,
 sum(pnl - position_size*2*(s + c)/10000) AS net_pnl FROM trades, (VALUES (0.0::DOUBLE), (10.0), (30.0)) a(s), (VALUES (0.0::DOUBLE), (2.0), (10.0)) b(c) GROUP BY s, c""")
def cost_sensitivity(spark, d):
    return N.cost_sensitivity(log(spark, d), [0.0, 10.0, 30.0], [0.0, 2.0, 10.0])


def hold_sql(h):
    return f"""SELECT {h} AS hold, count(*) AS n, avg(dir*(x - e)/e) AS avg_return FROM (SELECT CASE signal WHEN 'Bullish' THEN 1 WHEN 'Bearish' THEN -1 END AS dir,
 lead(open, 1) OVER (PARTITION BY ticker ORDER BY date) AS e, lead(close, {1 + h}) OVER (PARTITION BY ticker ORDER BY date) AS x FROM sig) WHERE dir IS NOT NULL AND x IS NOT NULL"""


@query("holding_period_sweep", "N3", "hold:i n:i avg_return:f", f"WITH {SIG} {' UNION ALL '.join(hold_sql(h) for h in (1, 3, 5, 10))}")
def holding_period_sweep(spark, d):
    return N.holding_sweep(signals(spark, d), [1, 3, 5, 10])


FW = "sf AS (SELECT *, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date)/close - 1 AS fwd FROM sc)"


@query("threshold_sweep", "N3", "threshold:f n:i avg_return:f", f"""
WITH {SCORED}, {FW} SELECT c AS threshold, count(*) AS n, avg(sign(score)*fwd) AS avg_return FROM sf, (VALUES (0.1::DOUBLE), (0.3), (0.5)) v(c) WHERE abs(score) > c AND fwd IS NOT NULL GROUP BY c""")
def threshold_sweep(spark, d):
    return N.threshold_sweep(scored_fwd(spark, d), "score", "fwd", [0.1, 0.3, 0.5])


@query("top_k_sweep", "N3", "top_k:i n_days:i mean_ret:f sharpe:f", f"""
WITH {SCORED}, {FW}, t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rn FROM sf WHERE score > 0 AND fwd IS NOT NULL),
dd AS (SELECT k AS top_k, date, avg(fwd) AS r FROM t, (VALUES (1), (3), (5), (10)) v(k) WHERE rn <= k GROUP BY k, date)
SELECT top_k, count(*) AS n_days, avg(r) AS mean_ret, avg(r)/nullif(stddev_samp(r), 0)*sqrt(252) AS sharpe FROM dd GROUP BY top_k""")
def top_k_sweep(spark, d):
    return N.top_k_sweep(scored_fwd(spark, d), "score", "fwd", [1, 3, 5, 10])


def ew_sql(span):
    dec = 1 - 2 / (span + 1)
    return f"""SELECT {span} AS span, a.fwd, sum(b.score*pow({dec!r}, a.rn - b.rn))/sum(pow({dec!r}, a.rn - b.rn)) AS s, count(*) AS c FROM sr a JOIN sr b ON a.ticker = b.ticker AND b.rn <= a.rn GROUP BY a.ticker, a.date, a.fwd HAVING count(*) >= 3"""


@query("smoothing_sweep", "N3", "span:i n:i ic:f", f"""
WITH {SCORED}, {FW}, sr AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM sf), e AS ({' UNION ALL '.join(ew_sql(s) for s in (3, 5))})
SELECT span, count(fwd) AS n, corr(s, fwd) AS ic FROM e WHERE fwd IS NOT NULL GROUP BY span""")
def smoothing_sweep(spark, d):
    return N.smoothing_sweep(scored_fwd(spark, d), "score", "fwd", [3, 5])


@query("pick_configs", "N4", "slippage_bps:f commission_bps:f net_return:f net_pnl:f", f"""
WITH {TRADES}, x AS (SELECT s AS slippage_bps, c AS commission_bps, avg(ret - 2*(s + c)/10000) AS net_return, sum(pnl - position_size*2*(s + c)/10000) AS net_pnl
 FROM trades, (VALUES (0.0::DOUBLE), (10.0), (30.0)) a(s), (VALUES (0.0::DOUBLE), (2.0), (10.0)) b(c) GROUP BY s, c)
SELECT * FROM x WHERE net_return > 0.002 AND slippage_bps >= 5 ORDER BY net_pnl DESC LIMIT 3""")
def pick_configs(spark, d):
    r = N.cost_sensitivity(log(spark, d), [0.0, 10.0, 30.0], [0.0, 2.0, 10.0])
    return N.pick_configs(r, [F.col("net_return") > 0.002, F.col("slippage_bps") >= 5], "net_pnl", 3)


@query("period_comparison", "N5", "period:s n:i sharpe:f total:f passed:b", f"""
WITH {ER}, g AS (SELECT CASE WHEN date < DATE '1999-01-01' THEN 'in_sample' ELSE 'out_of_sample' END AS period, count(r) AS n, avg(r)/stddev_pop(r)*sqrt(252) AS sharpe, exp(sum(ln(1 + r))) - 1 AS total FROM er WHERE r IS NOT NULL GROUP BY 1)
SELECT *, sharpe >= 0.5*max(CASE WHEN period = 'in_sample' THEN sharpe END) OVER () AS passed FROM g""")
def period_comparison(spark, d):
    return N.period_comparison(eq(spark, d), "1999-01-01")


# --- options and lognormal bands --------------------------------------------------


@query("option_greeks", "O1", K + "atm_call:f otm_call:f put_hedge:f delta:f gamma:f theta:f vega:f rho:f breakeven_pct:f", f"""
WITH {PRICES}, {O.iv_sql()}, x AS (SELECT p.ticker, p.date, close AS s, {O.SIGMA_SQL} AS sg FROM prices p JOIN iv ON p.ticker = iv.ticker AND p.date = iv.date), {O.price_sql('x')}
SELECT *, 100*atm_call/s AS breakeven_pct FROM opt""")
def option_greeks(spark, d):
    return O.strategy(T.log_return_vol(bars(spark, d)), "close", "iv_proxy")


def band_sql():
    from barweave.functions.mathx import Z

    t = 5 / 252.0
    cols = ", ".join(f"close*exp((mu - 0.5*sigma*sigma)*{t!r} + sigma*{t ** 0.5!r}*{Z[p]!r}) AS {n}" for n, p in (("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p025", 0.025), ("p975", 0.975)))
    return f"""bd AS (SELECT ticker, date, close, {cols}, ((mu - 0.5*sigma*sigma)*{t!r})/nullif(sigma*{t ** 0.5!r}, 0) AS zz FROM logn WHERE sigma IS NOT NULL)"""


def bands(spark, d):
    return O.lognormal_bands(T.lognormal_params(bars(spark, d)))


@query("lognormal_bands", "O2", K + "p05:f p25:f p50:f p75:f p95:f expected_return:f prob_up:f var_95:f", f"""
WITH {PRICES}, {LOGN}, {band_sql()} SELECT *, p50/close - 1 AS expected_return, {O.cdf_sql('zz')} AS prob_up, greatest(1 - p05/close, 0) AS var_95 FROM bd""")
def lognormal_bands(spark, d):
    return bands(spark, d)


@query("band_coverage", "O2", "n:i coverage_95:f coverage_50:f mean_error:f", f"""
WITH {PRICES}, {LOGN}, {band_sql()}, f AS (SELECT *, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) AS f FROM bd)
SELECT count(*) AS n, avg(CASE WHEN p025 <= f AND f <= p975 THEN 1.0 ELSE 0 END) AS coverage_95, avg(CASE WHEN p25 <= f AND f <= p75 THEN 1.0 ELSE 0 END) AS coverage_50, avg(abs((f - p50)/close)) AS mean_error FROM f WHERE f IS NOT NULL""")
def band_coverage(spark, d):
    return O.band_coverage(bands(spark, d))


@query("adverse_slippage", "O3", K + "slippage_bps:f rolling_bps:f excess_bps:f", f"""
WITH {RET}, a AS (SELECT ticker, date, CASE WHEN r > 0 THEN 1 ELSE -1 END*(lead(open) OVER (PARTITION BY ticker ORDER BY date) - close)/close*10000 AS slippage_bps FROM ret WHERE r IS NOT NULL),
b AS (SELECT *, {roll('avg', 'slippage_bps', 20, 1)} AS rolling_bps FROM a WHERE slippage_bps IS NOT NULL) SELECT *, rolling_bps - 5.0 AS excess_bps FROM b""")
def adverse_slippage(spark, d):
    side = F.when(F.col("r") > 0, 1).otherwise(-1)
    f = rets(spark, d).where("r is not null").withColumn("slippage_bps", side * (W.lead("open") - F.col("close")) / F.col("close") * 10_000)
    f = f.where("slippage_bps is not null").withColumn("rolling_bps", W.roll_mean("slippage_bps", 20, 1))
    return f.withColumn("excess_bps", F.col("rolling_bps") - 5.0)


@query("scalar_columns", "O5", K + "clipped:f sgn:f lg:f rt:f filled:f", f"""
WITH {RET} SELECT ticker, date, CASE WHEN r IS NOT NULL THEN least(greatest(r, -0.05), 0.05) END AS clipped, sign(r) AS sgn, ln(close) AS lg, sqrt(volume) AS rt, coalesce(r, 0) AS filled FROM ret""")
def scalar_columns(spark, d):
    from barweave.functions.mathx import clip

    return rets(spark, d).withColumns({"clipped": clip(F.col("r"), -0.05, 0.05), "sgn": F.signum("r"), "lg": F.ln("close"), "rt": F.sqrt("volume"), "filled": F.coalesce("r", F.lit(0.0))})


# --- text ------------------------------------------------------------------------

VAL = "CASE label WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0 END"
FIVE = "CASE WHEN score <= -0.5 THEN 'Very Negative' WHEN score <= -0.1 THEN 'Negative' WHEN score < 0.1 THEN 'Neutral' WHEN score < 0.5 THEN 'Positive' ELSE 'Very Positive' END"


def value():
    return P.label_value(F.col("label"))


def weight():
    return F.least(F.col("n_chars") / 2000.0, F.lit(1.0))


@query("strip_html", "P1", "page_id:i body:s", "SELECT page_id, trim(regexp_replace(html, '<[^>]*>', '', 'g')) AS body FROM pages")
def strip_html(spark, d):
    return S.table(spark, d, "pages").select("page_id", P.strip_html(F.col("html")).alias("body"))


@query("recent_news", "P2", "doc_id:i ticker:i date:d", f"WITH {NEWS} SELECT doc_id, ticker, date FROM news WHERE DATE '2024-01-20' - date BETWEEN 0 AND 7")
def recent_news(spark, d):
    return P.recent(S.news(spark, d), "2024-01-20").orderBy(F.desc("date"), "doc_id")


@query("dedupe_headlines", "P3", "doc_id:i headline:s copies:i", f"""
WITH {NEWS} SELECT min(doc_id) AS doc_id, arg_min(headline, doc_id) AS headline, count(*) AS copies FROM news WHERE trim(headline) <> '' GROUP BY trim(lower(headline))""")
def dedupe_headlines(spark, d):
    return P.dedupe_headlines(S.news(spark, d))


@query("weighted_sentiment", "P4", "ticker:i score:f n:i label:s", f"""
WITH {NEWS}, a AS (SELECT ticker, least(greatest(sum({VAL}*least(n_chars/2000.0, 1))/nullif(sum(least(n_chars/2000.0, 1)), 0), -1), 1) AS score, count(*) AS n FROM news GROUP BY ticker) SELECT *, {FIVE} AS label FROM a""")
def weighted_sentiment(spark, d):
    return P.weighted_sentiment(S.news(spark, d), ["ticker"], value(), weight())


@query("daily_sentiment", "P5", "ticker:i date:d score:f n:i label:s", f"""
WITH {NEWS}, a AS (SELECT ticker, date, least(greatest(sum({VAL}*least(n_chars/2000.0, 1))/nullif(sum(least(n_chars/2000.0, 1)), 0), -1), 1) AS score, count(*) AS n FROM news GROUP BY ticker, date) SELECT *, {FIVE} AS label FROM a""")
def daily_sentiment(spark, d):
    return P.weighted_sentiment(S.news(spark, d), ["ticker", "date"], value(), weight())


@query("sentiment_grouping_sets", "P5", "day:s source:s score:f n:i", f"""
WITH {NEWS} SELECT coalesce(CAST(date AS VARCHAR), 'ALL') AS day, coalesce(source, 'ALL') AS source,
 least(greatest(CASE WHEN grouping(date) = 0 THEN sum({VAL}*least(n_chars/2000.0, 1))/nullif(sum(least(n_chars/2000.0, 1)), 0) ELSE avg({VAL}) END, -1), 1) AS score, count(*) AS n
FROM news GROUP BY GROUPING SETS ((date), (source))""")
def sentiment_grouping_sets(spark, d):
    return P.sentiment_breakdown(S.news(spark, d), value(), weight())


@query("daily_headlines", "P5", "ticker:i date:d articles:i doc_id:i headline:s", f"""
WITH {NEWS} SELECT ticker, date, count(*) OVER (PARTITION BY ticker, date) AS articles, doc_id, headline FROM news""")
def daily_headlines(spark, d):
    return P.headlines_of_day(S.news(spark, d))


@query("decayed_sentiment", "P6", "ticker:i decayed:f sentiment:f impact:f n:i", f"""
WITH {NEWS}, h AS (SELECT *, greatest((TIMESTAMP '2024-01-31 12:00:00' - date::TIMESTAMP).epoch()/3600.0, 0) AS hrs FROM news)
SELECT ticker, sum({VAL}*exp(-0.1*hrs)) AS decayed, sum({VAL}*exp(-0.3*hrs/24))/nullif(sum(exp(-0.3*hrs/24)), 0) AS sentiment, least(sum(exp(-0.3*hrs/24))/3, 1) AS impact, count(*) AS n FROM h GROUP BY ticker""".replace("(TIMESTAMP '2024-01-31 12:00:00' - date::TIMESTAMP).epoch()", "epoch(TIMESTAMP '2024-01-31 12:00:00' - date::TIMESTAMP)"))
def decayed_sentiment(spark, d):
    return P.decayed_impact(S.news(spark, d), "2024-01-31 12:00:00", value())


LEXP = ", ".join(repr(w) for w, v in P.LEXICON.items() if v > 0)
LEXN = ", ".join(repr(w) for w, v in P.LEXICON.items() if v < 0)


@query("lexicon_polarity", "P7", "doc_id:i pos:i neg:i polarity:f", f"""
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents),
a AS (SELECT doc_id, count(*) FILTER (w IN ({LEXP})) AS pos, count(*) FILTER (w IN ({LEXN})) AS neg FROM w GROUP BY doc_id)
SELECT *, coalesce((pos - neg)/nullif(sqrt(pos + neg), 0), 0) AS polarity FROM a""")
def lexicon_polarity(spark, d):
    return P.lexicon_scores(S.table(spark, d, "documents").select("doc_id", "text"))


@query("multi_source_union", "P8", "source:s doc_id:i date:d rn:i", f"""
WITH {NEWS}, u AS (SELECT source, doc_id, date FROM news WHERE lang = 'en' UNION ALL SELECT source, doc_id, date FROM news WHERE lang <> 'en')
SELECT *, row_number() OVER (PARTITION BY source ORDER BY date DESC, doc_id) AS rn FROM u QUALIFY rn <= 10""")
def multi_source_union(spark, d):
    n = S.news(spark, d).select("source", "doc_id", "date", "lang")
    return P.union_sources([n.where("lang = 'en'"), n.where("lang <> 'en'")], 10, [F.desc("date"), F.col("doc_id")])


# --- stateful --------------------------------------------------------------------


@query("signal_flip_filter", "R1", K + "score:f accepted:b", f"""
WITH RECURSIVE {SIG}, {ewm_sql('sig', 'score', 3, 1).replace('e0', 'r0').replace('ew AS', 'rw AS')},
s AS (SELECT ticker, date, round(score, 6) AS score, round(ew, 6) AS kept, CASE signal WHEN 'Bullish' THEN 1 ELSE -1 END AS side, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM sig JOIN rw USING (ticker, date) WHERE signal <> 'Neutral'),
f AS (SELECT ticker, date, score, rn, true AS accepted, kept AS last FROM s WHERE rn = 1
 UNION ALL SELECT s.ticker, s.date, s.score, s.rn, NOT (f.last <> 0 AND sign(f.last) <> s.side AND abs(s.score - f.last) < 0.25),
  CASE WHEN f.last <> 0 AND sign(f.last) <> s.side AND abs(s.score - f.last) < 0.25 THEN f.last ELSE s.kept END FROM f JOIN s ON s.ticker = f.ticker AND s.rn = f.rn + 1)
SELECT * FROM f""")
def signal_flip_filter(spark, d):
    s = W.add_ewm(signals(spark, d), "score", 3, 1, "kept_score").withColumns({"score": F.round("score", 6), "kept_score": F.round("kept_score", 6)})
    return ST.flip_filter(s, 0.25, "kept_score")


@query("halt_resume_hysteresis", "R2", "date:d drawdown:f halted:b", f"""
WITH {EQUITY}, d AS (SELECT date, (max(equity) OVER (ORDER BY date) - equity)/max(equity) OVER (ORDER BY date) AS drawdown FROM equity),
e AS (SELECT *, CASE WHEN drawdown > 0.002 THEN 1 WHEN drawdown < 0.001 THEN 0 END AS ev FROM d)
SELECT date, drawdown, coalesce(last_value(ev IGNORE NULLS) OVER (ORDER BY date), 0) = 1 AS halted FROM e""")
def halt_resume_hysteresis(spark, d):
    return ST.halt_hysteresis(eq(spark, d))


@query("position_reentry_block", "R3", K + "opened:b", f"""
WITH RECURSIVE {SIG}, {BLOT}, s AS (SELECT ticker, date, entry_date, exit_date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM bl),
f AS (SELECT ticker, date, rn, true AS opened, exit_date AS busy FROM s WHERE rn = 1
 UNION ALL SELECT s.ticker, s.date, s.rn, s.entry_date > f.busy, CASE WHEN s.entry_date > f.busy THEN s.exit_date ELSE f.busy END FROM f JOIN s ON s.ticker = f.ticker AND s.rn = f.rn + 1)
SELECT * FROM f""")
def position_reentry_block(spark, d):
    return ST.reentry_block(blotter(spark, d))
