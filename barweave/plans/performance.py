"""Performance, predictive-power and risk queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barweave.functions import windows as W
from barweave.operators import ic as IC
from barweave.operators import metrics as M
from barweave.operators import options as O
from barweave.operators import risk as R
from barweave.operators import trades as TR
from barweave.operators import features as T
from barweave.plans.bars import GRID, sector_returns
from barweave.plans.catalog import query
from barweave.plans.cross import REG, prank, regimes
from barweave.plans.features import FM, K, RM, bars, matrix, rets, rm
from barweave.plans.select import BLOT, SCORED, SIG, blotter, scored, signals
from barweave.plans.sqlbase import EQUITY, MARKET, PRICES, RET, SECTORS, TRADES, roll, win
from barweave.sources import tables as S
from barweave.sources.bars import align_ffill

PF = "sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END)/nullif(sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END), 0)"
WR = "avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END)"


def log(spark, d, regime=False):
    return S.trades(spark, d, regime)


def eq(spark, d):
    return S.equity_curve(log(spark, d))


ER = EQUITY + ", er AS (SELECT *, equity/lag(equity) OVER (ORDER BY date) - 1 AS r FROM equity)"
TS_SPEC = "n_trades:i win_rate:f avg_return:f profit_factor:f accuracy:f hold_mean:f hold_median:f hold_min:i hold_max:i"
TS = f"""count(*) AS n_trades, {WR} AS win_rate, avg(ret) AS avg_return, {PF} AS profit_factor,
 avg(CASE WHEN (signal = 'Bullish' AND ret > 0) OR (signal = 'Bearish' AND ret < 0) THEN 1.0 ELSE 0 END) AS accuracy,
 round(avg(holding_days), 1) AS hold_mean, median(holding_days) AS hold_median, min(holding_days) AS hold_min, max(holding_days) AS hold_max"""


@query("trade_statistics", "J1", TS_SPEC, f"WITH {TRADES} SELECT {TS} FROM trades")
def trade_statistics(spark, d):
    return M.trade_stats(log(spark, d))


@query("trade_sharpe_sortino", "J2", "sharpe:f sortino:f", f"""
WITH {TRADES} SELECT avg(ret)/stddev_samp(ret)*sqrt(252/5.0) AS sharpe, avg(ret)/sqrt(avg(CASE WHEN ret < 0 THEN ret*ret END))*sqrt(252/5.0) AS sortino FROM trades""")
def trade_sharpe_sortino(spark, d):
    return M.trade_ratios(log(spark, d))


@query("equity_sharpe", "J3", "n:i equity_sharpe:f", f"WITH {ER} SELECT count(r) AS n, avg(r)/stddev_pop(r)*sqrt(252) AS equity_sharpe FROM er")
def equity_sharpe(spark, d):
    return M.equity_sharpe(eq(spark, d))


DD = "dd AS (SELECT *, (equity - max(equity) OVER (ORDER BY date))/max(equity) OVER (ORDER BY date) AS dd FROM equity)"


@query("max_drawdown", "J4", "max_drawdown:f max_drawdown_returns:f", f"""
WITH {ER}, {DD}, g AS (SELECT date, exp(sum(ln(1 + coalesce(r, 0))) OVER (ORDER BY date)) AS g FROM er),
gd AS (SELECT (g - max(g) OVER (ORDER BY date))/max(g) OVER (ORDER BY date) AS d FROM g)
SELECT (SELECT min(dd) FROM dd) AS max_drawdown, (SELECT min(d) FROM gd) AS max_drawdown_returns""")
def max_drawdown(spark, d):
    return M.max_drawdown(eq(spark, d))


SPELLS = DD + """, is0 AS (SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER (ORDER BY date) AS isl FROM dd),
spells AS (SELECT min(date) AS start, max(date) AS "end", min(dd) AS depth, max(date) - min(date) AS days FROM is0 WHERE dd < 0 GROUP BY isl)"""


@query("drawdown_spells", "J5", "start:d finish:d depth:f days:i", f'WITH {EQUITY}, {SPELLS} SELECT start, "end" AS finish, depth, days FROM spells')
def drawdown_spells(spark, d):
    return M.drawdown_spells(eq(spark, d)).withColumnRenamed("end", "finish")


GROWTH = """gr AS (SELECT arg_min(equity, date) AS e0, arg_max(equity, date) AS e1, max(date) - min(date) AS days FROM equity),
growth AS (SELECT pow(e1/e0, 365.25/days) - 1 AS cagr, pow(e1/100000, 365.25/days) - 1 AS annual_return,
 (pow(e1/100000, 365.25/days) - 1)/nullif((SELECT abs(min(dd)) FROM dd), 0) AS calmar FROM gr)"""


@query("growth_ratios", "J6", "cagr:f annual_return:f calmar:f", f"WITH {EQUITY}, {DD}, {GROWTH} SELECT * FROM growth")
def growth_ratios(spark, d):
    return M.growth(eq(spark, d))


TURN = """tn AS (SELECT avg(v)/100000 AS a FROM (SELECT date, sum(position_size) AS v FROM
 (SELECT entry_date AS date, position_size FROM trades UNION ALL SELECT exit_date, position_size FROM trades) GROUP BY date))"""


@query("turnover", "J7", "avg_daily:f annualised:f drag_bps:f", f"WITH {TRADES}, {TURN} SELECT a AS avg_daily, a*252 AS annualised, a*252*10 AS drag_bps FROM tn")
def turnover(spark, d):
    return M.turnover(log(spark, d))


@query("corrected_turnover", "J8", "annualised:f avg_daily:f n_matched:i avg_equity:f position_changes:i size_based:f", f"""
WITH {EQUITY}, j AS (SELECT (position_size/a.equity + abs(position_size*(1 + ret))/b.equity)/2 AS t FROM trades JOIN equity a ON a.date = entry_date AND a.equity > 0 JOIN equity b ON b.date = exit_date AND b.equity > 0 WHERE position_size > 0)
SELECT (SELECT sum(t)/7 FROM j) AS annualised, (SELECT sum(t)/7/252 FROM j) AS avg_daily, (SELECT count(*) FROM j) AS n_matched, (SELECT avg(equity) FROM equity) AS avg_equity,
 count(*)*2 AS position_changes, count(*)/7.0*avg(position_size)/(SELECT avg(equity) FROM equity) AS size_based FROM trades""")
def corrected_turnover(spark, d):
    return M.corrected_turnover(log(spark, d), eq(spark, d), 7.0)


BM = EQUITY + ", " + MARKET + """, er AS (SELECT *, equity/lag(equity) OVER (ORDER BY date) - 1 AS r FROM equity),
bj AS (SELECT er.date, er.r, market.m FROM er LEFT JOIN market ON er.date = market.date WHERE er.r IS NOT NULL),
bf AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (ORDER BY date), first_value(m IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS mm FROM bj),
bm0 AS (SELECT covar_samp(r, mm)/var_samp(mm) AS beta, avg(r) AS ar, avg(mm) AS am, stddev_samp(r - mm) AS te FROM bf),
bm AS (SELECT beta, (ar - beta*am)*252 AS alpha, (ar*252 - 0.04)/beta AS treynor, (ar - beta*am)*252/(te*sqrt(252)) AS information_ratio FROM bm0)"""


@query("benchmark_metrics", "J9", "beta:f alpha:f treynor:f information_ratio:f", f"WITH {BM} SELECT * FROM bm")
def benchmark_metrics(spark, d):
    return M.benchmark_metrics(eq(spark, d), S.market(bars(spark, d)))


@query("all_metrics", "J10", TS_SPEC + " sharpe:f sortino:f equity_sharpe:f max_drawdown:f max_duration:i avg_drawdown:f avg_duration:f cagr:f calmar:f turnover:f beta:f alpha:f treynor:f information_ratio:f", f"""
WITH {BM}, {SPELLS}, {GROWTH}, {TURN}, t AS (SELECT {TS}, avg(ret)/stddev_samp(ret)*sqrt(252/5.0) AS sharpe, avg(ret)/sqrt(avg(CASE WHEN ret < 0 THEN ret*ret END))*sqrt(252/5.0) AS sortino FROM trades),
s AS (SELECT avg(r)/stddev_pop(r)*sqrt(252) AS equity_sharpe FROM er), m AS (SELECT min(dd) AS max_drawdown FROM dd),
p AS (SELECT coalesce(max(days), 0) AS max_duration, coalesce(avg(depth), 0) AS avg_drawdown, coalesce(avg(days), 0) AS avg_duration FROM spells)
SELECT t.*, s.*, m.*, p.*, growth.cagr, growth.calmar, tn.a*252 AS turnover, bm.* FROM t, s, m, p, growth, tn, bm""")
def all_metrics(spark, d):
    return M.all_metrics(log(spark, d), eq(spark, d), S.market(bars(spark, d)))


@query("yearly_returns", "J11", "year:i ret:f", f"WITH {EQUITY} SELECT year(date) AS year, arg_max(equity, date)/arg_min(equity, date) - 1 AS ret FROM equity GROUP BY 1")
def yearly_returns(spark, d):
    return M.yearly_returns(eq(spark, d))


@query("monthly_return_summary", "J11", "mean:f std:f skew:f n:i outliers:i", f"""
WITH {EQUITY}, m0 AS (SELECT date_trunc('month', date) AS mo, arg_max(equity, date) AS e FROM equity GROUP BY 1), m AS (SELECT e/lag(e) OVER (ORDER BY mo) - 1 AS r FROM m0),
s AS (SELECT avg(r) AS mean, stddev_samp(r) AS std, skewness(r) AS skew, count(r) AS n FROM m)
SELECT s.*, (SELECT count(*) FROM m WHERE abs((r - mean)/std) >= 3 OR abs(r) >= 0.1) AS outliers FROM s""")
def monthly_return_summary(spark, d):
    return M.monthly_summary(eq(spark, d))


def rsh(k, m, dd):
    return f"({roll('avg', 'r', k, m, 'acct')})/nullif({roll(dd, 'r', k, m, 'acct')}, 0)*sqrt(252)"


@query("curve_and_rolling_sharpe", "J12", "date:d curve:f sharpe_252:f sharpe_60:f", f"""
WITH {ER}, a AS (SELECT *, 1 AS acct FROM er) SELECT date, round(equity/first_value(equity) OVER (ORDER BY date)*100000, 4) AS curve, {rsh(252, 252, 'stddev_pop')} AS sharpe_252, {rsh(60, 30, 'stddev_samp')} AS sharpe_60 FROM a""")
def curve_and_rolling_sharpe(spark, d):
    return M.curve_series(eq(spark, d))


@query("sharpe_by_regime", "J13", "regime:s n:i sharpe:f", f"""
WITH {REG}, {ER}, j AS (SELECT er.r, coalesce(regime, 'Sideways') AS regime FROM er LEFT JOIN rg ON er.date = rg.date WHERE er.r IS NOT NULL)
SELECT regime, count(*) AS n, avg(r)/nullif(stddev_samp(r), 0)*sqrt(252) AS sharpe FROM j GROUP BY regime""")
def sharpe_by_regime(spark, d):
    return M.sharpe_by_regime(eq(spark, d), regimes(spark, d))


@query("trade_stats_by_regime", "J13", "regime:s " + TS_SPEC, f"WITH {TRADES} SELECT regime, {TS} FROM trades GROUP BY regime")
def trade_stats_by_regime(spark, d):
    return M.trade_stats(log(spark, d, True), ["regime"])


@query("regime_signal_rollup", "J13", "regime:s signal:s n:i win_rate:f avg_pnl:f profit_factor:f longs:i shorts:i", f"""
WITH {TRADES} SELECT coalesce(regime, 'ALL') AS regime, coalesce(signal, 'ALL') AS signal, count(*) AS n, {WR} AS win_rate, avg(pnl) AS avg_pnl, {PF} AS profit_factor,
 count(*) FILTER (direction > 0) AS longs, count(*) FILTER (direction < 0) AS shorts FROM trades GROUP BY ROLLUP (regime, signal)""")
def regime_signal_rollup(spark, d):
    return M.regime_signal_rollup(log(spark, d, True))


@query("score_quantile_attribution", "J14", "bin:i n:i avg_return:f win_rate:f profit_factor:f", f"""
WITH {TRADES}, e AS (SELECT quantile_cont(adjusted_score, 0.2) AS a, quantile_cont(adjusted_score, 0.4) AS b, quantile_cont(adjusted_score, 0.6) AS c, quantile_cont(adjusted_score, 0.8) AS d FROM trades),
x AS (SELECT trades.*, 1 + (adjusted_score > a)::INT + (adjusted_score > b)::INT + (adjusted_score > c)::INT + (adjusted_score > d)::INT AS bin FROM trades, e)
SELECT bin, count(*) AS n, avg(ret) AS avg_return, {WR} AS win_rate, {PF} AS profit_factor FROM x GROUP BY bin""")
def score_quantile_attribution(spark, d):
    return M.score_bins(log(spark, d), "adjusted_score")


@query("signal_counts", "J15", "date:d bullish:i bearish:i neutral:i", f"""
WITH {SIG} SELECT date, count(*) FILTER (signal = 'Bullish') AS bullish, count(*) FILTER (signal = 'Bearish') AS bearish, count(*) FILTER (signal = 'Neutral') AS neutral FROM sig GROUP BY date""")
def signal_counts(spark, d):
    return M.signal_counts(signals(spark, d)).withColumnsRenamed({"Bullish": "bullish", "Bearish": "bearish", "Neutral": "neutral"})


@query("dashboard_summary", "J16", "n_trades:i win_rate:f total_pnl:f final_equity:f peak_equity:f", f"""
WITH {EQUITY} SELECT count(*) AS n_trades, {WR} AS win_rate, sum(pnl) AS total_pnl, (SELECT arg_max(equity, date) FROM equity) AS final_equity, (SELECT max(equity) FROM equity) AS peak_equity FROM trades""")
def dashboard_summary(spark, d):
    return M.dashboard_summary(log(spark, d), eq(spark, d))


@query("equity_series", "J16", "date:d equity:f", f"WITH {EQUITY} SELECT date, equity FROM equity")
def equity_series(spark, d):
    return eq(spark, d)


@query("option_report_by_regime", "J17", "regime:s n:i avg_call:f hedge_cost:f stock_pnl:f call_pnl:f", f"""
WITH {SIG}, {BLOT}, {O.iv_sql()}, x AS (SELECT bl.ticker, bl.date, bl.regime, entry_price, exit_price, entry_price AS s, {O.SIGMA_SQL} AS sg FROM bl JOIN iv ON bl.ticker = iv.ticker AND bl.date = iv.date WHERE signal = 'Bullish'),
{O.price_sql('x')} SELECT regime, count(*) AS n, avg(atm_call) AS avg_call, sum(put_hedge) AS hedge_cost, sum(exit_price - entry_price) AS stock_pnl,
 sum(greatest(exit_price - entry_price, 0) - atm_call) AS call_pnl FROM opt GROUP BY regime""")
def option_report_by_regime(spark, d):
    iv = T.log_return_vol(bars(spark, d)).select("ticker", "date", "iv_proxy")
    b = blotter(spark, d).where("signal = 'Bullish'").join(iv, ["ticker", "date"])
    return M.option_report(O.strategy(b, "entry_price", "iv_proxy"))


@query("sanity_gates", "J18", "n_trades:i n_tickers:i n_shorts:i max_positions:i flat_share:f enough_trades:b enough_tickers:b invested:b", f"""
WITH {EQUITY}, h AS (SELECT CAST(g AS DATE) AS date, count(DISTINCT ticker) AS n FROM trades, unnest(generate_series(entry_date, exit_date, INTERVAL 1 DAY)) u(g) GROUP BY 1),
b AS (SELECT max(coalesce(n, 0)) AS max_positions, avg(CASE WHEN coalesce(n, 0) = 0 THEN 1.0 ELSE 0 END) AS flat_share FROM equity LEFT JOIN h USING (date)),
t AS (SELECT count(*) AS n_trades, count(DISTINCT ticker) AS n_tickers, count(*) FILTER (direction < 0) AS n_shorts FROM trades)
SELECT *, n_trades >= 30 AS enough_trades, n_tickers >= 5 AS enough_tickers, flat_share <= 0.8 AS invested FROM t, b""")
def sanity_gates(spark, d):
    t = log(spark, d)
    return M.sanity_gates(t, TR.daily_book(t, S.equity_curve(t)))


@query("signal_funnel", "J19", "with_data:i with_signals:i non_neutral:i entries_mean:f entries_max:i", f"""
WITH {SIG}, {BLOT}, c AS (SELECT date, count(*) AS n FROM bl GROUP BY date)
SELECT (SELECT count(DISTINCT ticker) FROM prices) AS with_data, (SELECT count(DISTINCT ticker) FROM sig) AS with_signals, (SELECT count(DISTINCT ticker) FROM sig WHERE signal <> 'Neutral') AS non_neutral,
 avg(n) AS entries_mean, max(n) AS entries_max FROM c""")
def signal_funnel(spark, d):
    return M.signal_funnel(bars(spark, d), signals(spark, d), blotter(spark, d))


# --- predictive power ------------------------------------------------------------


def srank(x, part):
    """Average rank in SQL."""
    over = f"PARTITION BY {part}" if part else ""
    tie = f"PARTITION BY {part + ', ' if part else ''}{x}"
    return f"(rank() OVER ({over} ORDER BY {x}) + (count(*) OVER ({tie}) - 1)/2.0)"


@query("trade_ic", "K1", "ic:f rank_ic:f n:i", f"""
WITH {TRADES}, k AS (SELECT adjusted_score AS x, ret AS y, {srank('adjusted_score', '')} AS rx, {srank('ret', '')} AS ry FROM trades)
SELECT corr(x, y) AS ic, corr(rx, ry) AS rank_ic, count(*) AS n FROM k""")
def trade_ic(spark, d):
    return IC.trade_ic(log(spark, d), "adjusted_score", "ret")


LAGS = (1, 5, 10, 20)


def fwd_sql(src, lags=LAGS):
    return f"fw AS (SELECT *, {', '.join(f'lead(close, {k}) OVER (PARTITION BY ticker ORDER BY date)/close - 1 AS fwd_{k}' for k in lags)} FROM {src})"


def fwd_signals(spark, d, lags=LAGS):
    return IC.forward_columns(signals(spark, d), lags)


@query("pooled_ic_decay", "K2", "lag:i n:i ic:f", f"""
WITH {SIG}, {fwd_sql('sig')} {' UNION ALL '.join(f"SELECT {k} AS lag, count(fwd_{k}) AS n, corr(score, fwd_{k}) AS ic FROM fw WHERE fwd_{k} IS NOT NULL" for k in LAGS)}""")
def pooled_ic_decay(spark, d):
    return IC.ic_decay(fwd_signals(spark, d), "score", LAGS)


@query("pooled_ic_decay_non_neutral", "K2", "lag:i n:i ic:f", f"""
WITH {SIG}, {fwd_sql('sig')} {' UNION ALL '.join(f"SELECT {k} AS lag, count(fwd_{k}) AS n, corr(score, fwd_{k}) AS ic FROM fw WHERE fwd_{k} IS NOT NULL AND signal <> 'Neutral'" for k in LAGS)}""")
def pooled_ic_decay_non_neutral(spark, d):
    return IC.ic_decay(fwd_signals(spark, d), "score", LAGS, True)


# scores are ranked at 10 decimals: equal scores may differ in the last bit
RIC = f"""lp AS ({' UNION ALL '.join(f"SELECT {k} AS lag, round(score, 10) AS x, fwd_{k} AS y FROM fw WHERE fwd_{k} IS NOT NULL" for k in LAGS)}),
lr AS (SELECT lag, {srank('x', 'lag')} AS rx, {srank('y', 'lag')} AS ry FROM lp), ric AS (SELECT lag, corr(rx, ry) AS ic, count(*) AS n FROM lr GROUP BY lag)"""


def fwd_scored(spark, d, lags=LAGS):
    return IC.forward_columns(scored(spark, d), lags).withColumn("score", F.round("score", 10))


@query("pooled_rank_ic_decay", "K3", "lag:i n:i ic:f", f"WITH {SCORED}, {fwd_sql('sc')}, {RIC} SELECT * FROM ric")
def pooled_rank_ic_decay(spark, d):
    return IC.rank_ic_decay(fwd_scored(spark, d), "score", LAGS)


@query("best_ic_horizon", "K3", "lag:i ic:f", f"WITH {SCORED}, {fwd_sql('sc')}, {RIC} SELECT lag, ic FROM ric ORDER BY abs(ic) DESC, lag LIMIT 1")
def best_ic_horizon(spark, d):
    return IC.best_horizon(IC.rank_ic_decay(fwd_scored(spark, d), "score", LAGS))


FEATS = ["price_z20", "streak_5", "dist_high_252"]
FS = RET + f""", fs0 AS (SELECT ticker, date, close, (close - {roll('avg', 'close', 20)})/nullif({roll('stddev_samp', 'close', 20)}, 0) AS price_z20, {roll('sum', 'sign(r)', 5)} AS streak_5,
 {roll('max', 'close', 252, 126)} AS y FROM ret),
fs AS (SELECT ticker, date, close, lag(price_z20) OVER (PARTITION BY ticker ORDER BY date) AS price_z20, lag(streak_5) OVER (PARTITION BY ticker ORDER BY date) AS streak_5,
 lag((close - y)/y) OVER (PARTITION BY ticker ORDER BY date) AS dist_high_252 FROM fs0)"""


def feature_panel(spark, d):
    f = T.range_distance(T.price_shape(rets(spark, d)))
    lagged = f.select("ticker", "date", "close", *[W.lag(c).alias(c) for c in FEATS])
    return IC.forward_columns(lagged, LAGS)


def dic(x, k):
    m = f"{x} IS NOT NULL AND fwd_{k} IS NOT NULL"
    sx, sy = f"stddev_pop({x}) FILTER ({m})", f"stddev_pop(fwd_{k}) FILTER ({m})"
    return f"SELECT date, '{x}' AS feature, {k} AS lag, CASE WHEN count(*) FILTER ({m}) >= 4 AND {sx} >= 1e-12 AND {sy} >= 1e-12 THEN covar_pop({x}, fwd_{k}) FILTER ({m})/({sx}*{sy}) END AS ic FROM fw GROUP BY date"


DIC = f"dic AS ({' UNION ALL '.join(dic(x, k) for x in FEATS for k in LAGS)})"


@query("daily_feature_ic", "K4", "date:d feature:s lag:i ic:f", f"WITH {FS}, {fwd_sql('fs')}, {DIC} SELECT * FROM dic")
def daily_feature_ic(spark, d):
    return IC.daily_ic(feature_panel(spark, d), FEATS, LAGS)


@query("feature_ic_verdicts", "K4", "feature:s ic_lag1:f ic_lag5:f ic_lag10:f ic_lag20:f t_stat:f stable:b verdict:s", f"""
WITH {FS}, {fwd_sql('fs')}, {DIC}, mn AS (SELECT feature, {', '.join(f'avg(ic) FILTER (lag = {k}) AS ic_lag{k}' for k in LAGS)} FROM dic GROUP BY feature),
s AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY feature) AS n, avg(ic) OVER (PARTITION BY feature) AS mu FROM dic WHERE lag = 5 AND ic IS NOT NULL),
b AS (SELECT *, CASE WHEN i < (n % 4)*(n//4 + 1) THEN i//(n//4 + 1) ELSE (n % 4) + (i - (n % 4)*(n//4 + 1))//(n//4) END AS b FROM s),
bb AS (SELECT feature, b, avg(ic) AS m, any_value(mu) AS mu, any_value(n) AS n FROM b GROUP BY feature, b),
st AS (SELECT feature, any_value(n) >= 32 AND any_value(mu) <> 0 AND count(*) FILTER (sign(m) = sign(mu)) >= greatest(3, floor(0.75*count(*))) AS stable FROM bb GROUP BY feature),
t AS (SELECT feature, CASE WHEN count(*) >= 10 THEN avg(ic)/stddev_samp(ic)*sqrt(count(*)) END AS t_stat FROM s GROUP BY feature)
SELECT mn.*, t_stat, stable, CASE WHEN abs(coalesce(ic_lag5, 0)) > 0.02 AND coalesce(t_stat, 0) > 2 THEN 'ADD' WHEN abs(coalesce(ic_lag5, 0)) > 0.01 AND coalesce(t_stat, 0) > 1.5 THEN 'MAYBE' ELSE 'SKIP' END AS verdict
FROM mn LEFT JOIN st USING (feature) LEFT JOIN t USING (feature)""")
def feature_ic_verdicts(spark, d):
    return IC.ic_verdicts(IC.daily_ic(feature_panel(spark, d), FEATS, LAGS))


@query("daily_rank_ic_tracker", "K5", "date:d n:i ic_daily:f rolling_ic:f below_threshold:b", f"""
WITH {SCORED}, {fwd_sql('sc', (5,))}, a AS (SELECT date, round(score, 10) AS x, fwd_5 AS y FROM fw WHERE fwd_5 IS NOT NULL), k AS (SELECT date, {srank('x', 'date')} AS rx, {srank('y', 'date')} AS ry FROM a),
i AS (SELECT date, 1 AS acct, count(*) AS n, corr(rx, ry) AS ic_daily FROM k GROUP BY date HAVING count(*) >= 8), r AS (SELECT *, {roll('avg', 'ic_daily', 20, 10, 'acct')} AS rolling_ic FROM i)
SELECT *, coalesce(rolling_ic < 0, false) AS below_threshold FROM r""")
def daily_rank_ic_tracker(spark, d):
    return IC.daily_rank_ic(fwd_scored(spark, d, (5,)), "score", "fwd_5")


LAGS7 = (1, 2, 3, 5, 10, 20, 60)
F2 = ["dist_high_252", "streak_5"]


@query("feature_rank_ic_decay", "K6", "feature:s lag:i n:i ic:f best_lag:i short_horizon:b", f"""
WITH {FS}, {fwd_sql('fs', LAGS7)}, lp AS ({' UNION ALL '.join(f"SELECT '{x}' AS feature, {k} AS lag, {x} AS x, fwd_{k} AS y FROM fw WHERE fwd_{k} IS NOT NULL AND {x} IS NOT NULL" for x in F2 for k in LAGS7)}),
lr AS (SELECT feature, lag, {srank('x', 'feature, lag')} AS rx, {srank('y', 'feature, lag')} AS ry FROM lp), i AS (SELECT feature, lag, corr(rx, ry) AS ic, count(*) AS n FROM lr GROUP BY feature, lag),
b AS (SELECT feature, lag AS best_lag FROM i QUALIFY row_number() OVER (PARTITION BY feature ORDER BY abs(ic) DESC, lag) = 1)
SELECT i.*, best_lag, best_lag <= 5 AS short_horizon FROM i JOIN b USING (feature)""")
def feature_rank_ic_decay(spark, d):
    f = T.range_distance(T.price_shape(rets(spark, d)))
    lagged = f.select("ticker", "date", "close", *[W.lag(c).alias(c) for c in F2])
    return IC.feature_ic_decay(IC.forward_columns(lagged, LAGS7), F2, LAGS7)


FA = ["trend_score", "ret_20d", "mom_3m", "vol_20d", "rsi_14", "bb_position"]


@query("feature_stability", "K7", "feature:s var_mean:f var_std:f years:i rank:i", f"""
WITH {FM}, y AS ({' UNION ALL '.join(f"SELECT '{x}' AS feature, year(date) AS yr, avg({x}) AS m, stddev_pop({x}) AS s FROM fmx GROUP BY yr" for x in FA)}),
v AS (SELECT feature, var_pop(m) AS var_mean, var_pop(s) AS var_std, count(*) AS years FROM y GROUP BY feature)
SELECT *, row_number() OVER (ORDER BY var_mean + var_std, feature) AS rank FROM v""")
def feature_stability(spark, d):
    return IC.feature_stability(matrix(spark, d), FA)


@query("feature_correlations", "K8", "a:s b:s corr:f recommendation:s", f"""
WITH {FM}, p AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM fmx" for i, a in enumerate(FA) for b in FA[i + 1:])})
SELECT *, CASE WHEN abs(corr) <= 0.8 THEN 'keep' WHEN a IN ('bb_position') AND b IN ('bb_position') THEN 'protected' WHEN b IN ('bb_position') THEN concat('drop ', a) ELSE concat('drop ', b) END AS recommendation FROM p""")
def feature_correlations(spark, d):
    return IC.feature_correlations(matrix(spark, d), FA, ("bb_position",))


@query("low_redundancy_features", "K9", "feature:s kept:b variance:f", f"""
WITH RECURSIVE {FM}, kv AS ({' UNION ALL '.join(f"SELECT '{x}' AS f, var_samp({x}) AS v FROM fmx" for x in FA)}), ko AS (SELECT *, row_number() OVER (ORDER BY v DESC, f) AS rn FROM kv),
kc AS ({' UNION ALL '.join(f"SELECT '{x}' AS f, [{', '.join(f'abs(corr({x}, {y}))' for y in FA)}] AS r FROM fmx" for x in FA)}),
kw AS (SELECT CAST(0 AS BIGINT) AS rn, '' AS f, CAST([] AS BIGINT[]) AS kept, false AS ok
  UNION ALL SELECT rn, f, CASE WHEN ok THEN list_append(kept, pos) ELSE kept END, ok FROM (SELECT o.rn, o.f, w.kept, list_position({FA!r}, o.f) AS pos, len(list_filter(w.kept, lambda i: list_extract(c.r, i) > 0.5)) = 0 AS ok
    FROM kw w JOIN ko o ON o.rn = w.rn + 1 JOIN kc c ON c.f = o.f))
SELECT kv.f AS feature, ok AS kept, v AS variance FROM kw JOIN kv ON kv.f = kw.f""")
def low_redundancy_features(spark, d):
    return IC.low_redundancy(matrix(spark, d), FA)


FI = ["ret_20d", "mom_3m", "bb_position", "dist_high_20", "overnight_gap", "intraday"]


@query("ic_feature_selection", "K10", "feature:s ic:f threshold:f selected:b", f"""
WITH {FM}, lp AS ({' UNION ALL '.join(f"SELECT '{x}' AS feature, round({x}, 10) AS x, fwd AS y FROM fmx WHERE {x} IS NOT NULL" for x in FI)}),
k AS (SELECT feature, {srank('x', 'feature')} AS rx, {srank('y', 'feature')} AS ry FROM lp), i AS (SELECT feature, corr(rx, ry) AS ic FROM k GROUP BY feature),
t AS (SELECT CASE WHEN count(*) FILTER (abs(ic) > 0.02) >= 5 THEN 0.02 WHEN count(*) FILTER (abs(ic) > 0.01) >= 3 THEN 0.01 ELSE 0 END AS threshold FROM i)
SELECT feature, ic, threshold, abs(ic) > threshold OR threshold = 0 AS selected FROM i, t""")
def ic_feature_selection(spark, d):
    m = matrix(spark, d)
    return IC.select_by_ic(m.select("fwd", *[F.round(c, 10).alias(c) for c in FI]), FI, "fwd")


@query("metric_triple", "K11", "ic:f accuracy:f auc:f n:i", f"""
WITH {FM}, a AS (SELECT round(trend_score, 10) AS x, fwd AS y FROM fmx WHERE trend_score IS NOT NULL), k AS (SELECT *, {srank('x', '')} AS rx, {srank('y', '')} AS ry FROM a)
SELECT corr(rx, ry) AS ic, avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0 END) AS accuracy, count(*) AS n,
 (sum(rx) FILTER (y > 0) - count(*) FILTER (y > 0)*(count(*) FILTER (y > 0) + 1)/2.0)/(count(*) FILTER (y > 0)*count(*) FILTER (y <= 0)) AS auc FROM k""")
def metric_triple(spark, d):
    return IC.metric_triple(matrix(spark, d).select(F.round("trend_score", 10).alias("x"), "fwd"), "x", "fwd")


@query("ranking_stability", "K12", "ticker:i rank_autocorr:f decile_retention:f n:i", f"""
WITH {SCORED}, a AS (SELECT ticker, date, round(score, 10) AS x FROM sc), k AS (SELECT ticker, date, {prank('x')} AS rk FROM a),
d AS (SELECT *, least(ceil(round(rk*10, 9)), 10) AS dc, lag(rk) OVER w AS pk, lag(least(ceil(round(rk*10, 9)), 10)) OVER w AS pd FROM k WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, corr(rk, pk) AS rank_autocorr, avg(CASE WHEN pd IS NOT NULL THEN (dc = pd)::INT END) AS decile_retention, count(pk) AS n FROM d GROUP BY ticker""")
def ranking_stability(spark, d):
    return IC.ranking_stability(scored(spark, d).withColumn("score", F.round("score", 10)), "score")


# --- risk ------------------------------------------------------------------------


@query("historical_var", "L1", "conf:f hist_var:f", f"WITH {ER} SELECT 0.95 AS conf, -quantile_cont(r, 0.05) AS hist_var FROM er UNION ALL SELECT 0.99, -quantile_cont(r, 0.01) FROM er")
def historical_var(spark, d):
    return R.var_report(R.equity_return_series(eq(spark, d)))


@query("parametric_var", "L2", "conf:f param_var:f", f"""
WITH {ER} SELECT 0.95 AS conf, -(avg(r) - 1.6448536269514722*stddev_samp(r)) AS param_var FROM er UNION ALL SELECT 0.99, -(avg(r) - 2.3263478740408408*stddev_samp(r)) FROM er""")
def parametric_var(spark, d):
    return R.var_report(R.equity_return_series(eq(spark, d)))


@query("expected_shortfall", "L3", "conf:f hist_var:f cvar:f", f"""
WITH {ER}, v AS (SELECT 0.95 AS conf, -quantile_cont(r, 0.05) AS hist_var FROM er UNION ALL SELECT 0.99, -quantile_cont(r, 0.01) FROM er)
SELECT conf, any_value(hist_var) AS hist_var, -avg(r) FILTER (r <= -hist_var) AS cvar FROM v, er GROUP BY conf""")
def expected_shortfall(spark, d):
    r = R.equity_return_series(eq(spark, d))
    return R.with_cvar(r, R.var_report(r))


@query("rolling_var_breaches", "L3", "date:d var:f cvar:f breach:b", f"""
WITH {ER}, a AS (SELECT *, 1 AS acct, row_number() OVER (ORDER BY date) AS i FROM er WHERE r IS NOT NULL),
v AS (SELECT *, -({roll('quantile_cont({}, 0.05)', 'r', 252, 252, 'acct')}) AS var FROM a),
c AS (SELECT v.date, -avg(b.r) AS cvar FROM v JOIN a b ON b.i BETWEEN v.i - 251 AND v.i AND b.r <= -v.var GROUP BY v.date)
SELECT v.date, var, cvar, coalesce(r < -lag(var) OVER (ORDER BY v.date), false) AS breach FROM v LEFT JOIN c ON v.date = c.date""")
def rolling_var_breaches(spark, d):
    return R.rolling_var(R.equity_return_series(eq(spark, d)))


SECW = {"ASIA": 0.3, "EUROPE": 0.25, "AMERICA": 0.25, "AFRICA": 0.2, "OCEANIA": 0.1}


def sector_weights(spark, d):
    """Weights of the basket, with one name the returns do not cover."""
    w = F.create_map(*[x for k, v in SECW.items() for x in (F.lit(k), F.lit(v))])
    base = S.table(spark, d, "region").agg(F.count(F.lit(1)))
    return base.select(F.explode(w).alias("ticker", "weight"))


WSQL = f"ww AS (SELECT * FROM (VALUES {', '.join(f'({k!r}, {v}::DOUBLE)' for k, v in SECW.items())}) w(ticker, weight))"
SR = RET + f""", {SECTORS}, sr AS (SELECT sector AS ticker, date, avg(r) AS r FROM ret JOIN sectors USING (ticker) GROUP BY 1, 2),
sd AS (SELECT date FROM sr WHERE r IS NOT NULL GROUP BY date HAVING count(*) = (SELECT count(DISTINCT ticker) FROM sr WHERE r IS NOT NULL) ORDER BY date DESC LIMIT 252),
al AS (SELECT * FROM sr WHERE date IN (SELECT date FROM sd))"""


def aligned(spark, d):
    from barweave.sources.bars import aligned_returns

    return aligned_returns(sector_returns(spark, d), 252)


@query("portfolio_var", "L4", "conf:f hist_var:f param_var:f", f"""
WITH {SR}, {WSQL}, p AS (SELECT date, sum(weight*r) AS r FROM al JOIN ww USING (ticker) GROUP BY date)
SELECT 0.95 AS conf, -quantile_cont(r, 0.05) AS hist_var, -(avg(r) - 1.6448536269514722*stddev_samp(r)) AS param_var FROM p
UNION ALL SELECT 0.99, -quantile_cont(r, 0.01), -(avg(r) - 2.3263478740408408*stddev_samp(r)) FROM p""")
def portfolio_var(spark, d):
    return R.var_report(R.portfolio_returns(aligned(spark, d), sector_weights(spark, d)))


@query("portfolio_var_coverage", "L4", "n_weights:i n_covered:i missing_weight:f", f"""
WITH {SR}, {WSQL}, h AS (SELECT DISTINCT ticker, 1 AS has FROM al) SELECT count(*) AS n_weights, count(has) AS n_covered, sum(CASE WHEN has IS NULL THEN abs(weight) ELSE 0 END) AS missing_weight FROM ww LEFT JOIN h USING (ticker)""")
def portfolio_var_coverage(spark, d):
    return R.coverage(aligned(spark, d), sector_weights(spark, d))


@query("resampled_var", "L5", "conf:f hist_var:f")
def resampled_var(spark, d):
    return R.resampled_var(R.portfolio_returns(aligned(spark, d), sector_weights(spark, d)))


@query("ticker_betas", "L6", "ticker:i n:i beta:f", f"""
WITH {RM} SELECT ticker, count(*) AS n, covar_pop(r, m)/nullif(var_pop(m), 0) AS beta FROM rm WHERE r IS NOT NULL AND m IS NOT NULL GROUP BY ticker HAVING count(*) >= 30""")
def ticker_betas(spark, d):
    return R.full_beta(rm(spark, d))


@query("diversification_ratio", "L7", "date:d n_names:i ratio:f", f"""
WITH {SR}, {WSQL}, v AS (SELECT al.*, weight, {roll('stddev_pop', 'r', 60)} AS sv FROM al JOIN ww USING (ticker)),
g AS (SELECT date, 1 AS acct, sum(weight*sv) AS wv, sum(weight*r) AS pr, count(sv) AS n_names FROM v GROUP BY date), p AS (SELECT *, {roll('stddev_samp', 'pr', 60, 60, 'acct')} AS pv FROM g)
SELECT date, n_names, wv/nullif(pv, 0) AS ratio FROM p WHERE wv/nullif(pv, 0) IS NOT NULL""")
def diversification_ratio(spark, d):
    return R.diversification(aligned(spark, d), sector_weights(spark, d), 60)


@query("diversification_by_date", "L7", "date:d n_names:i n_days:i ratio:f", f"""
WITH {GRID}, {TRADES}, ret AS (SELECT ticker, date, f/lag(f) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM filled WHERE f IS NOT NULL), v AS (SELECT entry_date AS date, ticker, round(sum(position_size*direction), 4) AS v FROM trades GROUP BY 1, 2),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY date ORDER BY abs(v) DESC, ticker) <= 5),
bk AS (SELECT date, ticker, v/sum(abs(v)) OVER (PARTITION BY date) AS weight FROM b),
cx AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM ret)),
rr AS (SELECT ticker, idx, r FROM ret JOIN cx USING (date) WHERE r IS NOT NULL),
x AS (SELECT bk.date, bk.ticker, weight, rr.idx, r FROM bk JOIN cx ON cx.date = bk.date AND cx.idx >= 30 JOIN rr ON rr.ticker = bk.ticker AND rr.idx BETWEEN cx.idx - 59 AND cx.idx WHERE abs(weight) > 1e-6),
n AS (SELECT date, count(DISTINCT ticker) AS n_names FROM x GROUP BY date HAVING count(DISTINCT ticker) >= 2),
w AS (SELECT x.date, idx, n_names, sum(weight*r) AS pr FROM x JOIN n ON n.date = x.date GROUP BY x.date, idx, n_names HAVING count(*) = n_names),
p AS (SELECT date, n_names, count(*) AS n_days, stddev_samp(pr) AS pv FROM w GROUP BY date, n_names HAVING count(*) >= 30),
s AS (SELECT x.date, x.ticker, weight, stddev_pop(r) AS sd FROM x JOIN w ON w.date = x.date AND w.idx = x.idx GROUP BY 1, 2, 3)
SELECT p.date, n_names, n_days, sum(abs(weight)*sd)/nullif(any_value(pv), 0) AS ratio FROM p JOIN s ON s.date = p.date GROUP BY p.date, n_names, n_days HAVING any_value(pv) > 0""")
def diversification_by_date(spark, d):
    v = S.trades(spark, d).groupBy(F.col("entry_date").alias("date"), "ticker").agg(F.round(F.sum(F.col("position_size") * F.col("direction")), 4).alias("v"))
    rn = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(F.abs("v")), "ticker"))
    b = v.withColumn("_r", rn).where(F.col("_r") <= 5)
    book = b.select("date", "ticker", (F.col("v") / F.sum(F.abs("v")).over(Window.partitionBy("date"))).alias("weight"))
    aligned = align_ffill(bars(spark, d), ["close"]).withColumn("r", W.pct_change("close"))
    return R.diversification_by_date(aligned.select("ticker", "date", "r"), book, 60)


def factor_series(spark, d):
    """Equity returns with a market, a size and a momentum-like factor per date."""
    e = R.equity_return_series(eq(spark, d)).select("acct", "date", "r")
    f = rets(spark, d).withColumn("mom", W.pct_change("close", 20)).groupBy("date").agg(F.avg("r").alias("mkt_f"), F.stddev_samp("r").alias("disp_f"), F.avg("mom").alias("mom_f"))
    return e.join(F.broadcast(f), "date").where("mkt_f is not null and disp_f is not null and mom_f is not null")


XS = ["mkt_f", "disp_f", "mom_f"]


@query("factor_attribution", "L8", "factor:s coef:f t_stat:f r2:f n:i")
def factor_attribution(spark, d):
    return R.factor_regression(factor_series(spark, d), "r", XS)


W8 = "OVER (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
FB = f"""{EQUITY}, {RET.lstrip()}, fe AS (SELECT date, equity/lag(equity) OVER (ORDER BY date) - 1 AS r FROM equity),
fm0 AS (SELECT *, close/lag(close, 20) OVER (PARTITION BY ticker ORDER BY date) - 1 AS mom FROM ret),
ff AS (SELECT date, avg(r) AS x1, stddev_samp(r) AS x2, avg(mom) AS x3 FROM fm0 GROUP BY date),
fs AS (SELECT fe.date, fe.r AS y, x1, x2, x3 FROM fe JOIN ff USING (date) WHERE fe.r IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL),
fw AS (SELECT date, count(y) {W8} AS n, avg(y) {W8} AS my, {', '.join(f"avg(x{i}) {W8} AS m{i}, covar_pop(x{i}, y) {W8} AS b{i}" for i in (1, 2, 3))},
  {', '.join(f"covar_pop(x{i}, x{j}) {W8} AS a{i}{j}" for i in (1, 2, 3) for j in range(i, 4))} FROM fs),
fd AS (SELECT *, a11*(a22*a33 - a23*a23) - a12*(a12*a33 - a23*a13) + a13*(a12*a23 - a22*a13) AS det FROM fw WHERE n >= 252),
fc AS (SELECT *, (b1*(a22*a33 - a23*a23) - a12*(b2*a33 - a23*b3) + a13*(b2*a23 - a22*b3))/det AS c1, (a11*(b2*a33 - a23*b3) - b1*(a12*a33 - a23*a13) + a13*(a12*b3 - b2*a13))/det AS c2,
  (a11*(a22*b3 - b2*a23) - a12*(a12*b3 - b2*a13) + b1*(a12*a23 - a22*a13))/det AS c3 FROM fd)"""


@query("rolling_factor_betas", "L8", "date:d alpha:f " + " ".join(f"beta_{x}:f" for x in XS), f"""
WITH {FB} SELECT date, my - c1*m1 - c2*m2 - c3*m3 AS alpha, c1 AS beta_mkt_f, c2 AS beta_disp_f, c3 AS beta_mom_f FROM fc""")
def rolling_factor_betas(spark, d):
    return R.rolling_factor_betas(factor_series(spark, d), "r", XS)


@query("mean_variance_candidates", "L9", "kind:s ticker:s w:f ann_ret:f ann_vol:f sharpe:f")
def mean_variance_candidates(spark, d):
    from barweave.operators.joins import basket_moments

    a = aligned(spark, d)
    p = basket_moments(a, a.select("ticker"))
    full = p.select(F.col("ticker_a").alias("a"), F.col("ticker_b").alias("b"), "cov")
    full = full.unionByName(full.select(F.col("b").alias("a"), F.col("a").alias("b"), "cov"))
    full = full.unionByName(a.groupBy("ticker").agg(F.var_samp("r").alias("cov")).select(F.col("ticker").alias("a"), F.col("ticker").alias("b"), "cov"))
    return R.frontier(full, a.groupBy("ticker").agg(F.avg("r").alias("mu")), 500, 0.4)


@query("bootstrap_confidence", "L10", "metric:s low:f mid:f high:f")
def bootstrap_confidence(spark, d):
    return R.confidence_intervals(R.bootstrap_metrics(R.bootstrap_paths(R.equity_return_series(eq(spark, d)), 200)))


@query("block_bootstrap", "L10", "metric:s low:f mid:f high:f")
def block_bootstrap(spark, d):
    m = R.bootstrap_metrics(R.bootstrap_paths(R.equity_return_series(eq(spark, d)), 200, 21))
    return R.confidence_intervals(m, ("sharpe", "mdd", "total"), 0.05, 0.95)


@query("trade_bootstrap_outcomes", "L10", "reps:i log_p05:f log_p50:f log_p95:f prob_loss:f sharpe_p50:f")
def trade_bootstrap_outcomes(spark, d):
    return R.outcome_summary(R.trade_outcomes(log(spark, d), 200))
