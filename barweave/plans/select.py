"""Scoring, selection, join and trade-construction queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barweave.functions import windows as W
from barweave.operators import cross_section as X
from barweave.operators import features as T
from barweave.operators import joins
from barweave.operators import regimes as R
from barweave.operators import scoring as SC
from barweave.operators import selection as G
from barweave.operators import trades as TR
from barweave.plans.catalog import query
from barweave.plans.cross import REG, benchmark, prank, regimes
from barweave.plans.features import CAPM, FM, K, TREND, bars, ewm_sql, matrix, pr, rets, rm, trend
from barweave.plans.sqlbase import EQUITY, MARKET, PRICES, RET, SECTORS, TRADES, lagx, roll, win
from barweave.sources import bars as B
from barweave.session import written
from barweave.sources import tables as S

def rh(x, n):
    return f"(floor(({x})*1e{n} + 0.5)/1e{n})"


TT = TREND[len(PRICES):].lstrip(", \n")
SCORED = REG + f""", {TT}, sc0 AS (SELECT *, ({roll('stddev_samp', 'ret_1d', 20)})*sqrt(252) AS v20 FROM ts),
sc AS (SELECT sc0.ticker, sc0.date, sc0.open, sc0.high, sc0.low, sc0.close, sc0.volume, ret_1d AS r, trend_score AS score, v20 AS vol_20,
  mom_3m, mom_6m, ma_cross, coalesce(regime, 'Sideways') AS regime FROM sc0 LEFT JOIN rg ON sc0.date = rg.date)"""


def scored(spark, d):
    t = trend(spark, d).withColumnsRenamed({"ret_1d": "r", "trend_score": "score"}).withColumn("vol_20", W.ann_vol("r", 20))
    return joins.by_date(t, regimes(spark, d).select("date", "regime"), "left").fillna("Sideways", subset=["regime"])


WTS = {"trend_score": 0.6, "ret_20d": 1.5, "vol_20d": -2.0, "rsi_14": 0.01, "volume_z20": 0.0}


def lin(w, sql_default="0"):
    return " + ".join(f"coalesce({c}, {sql_default})*{v!r}" for c, v in w.items() if v)


@query("linear_score", "F1", K + "score:f", f"WITH {FM} SELECT ticker, date, (0.05 + {lin(WTS)})*0.5 AS score FROM fmx")
def linear_score(spark, d):
    return SC.linear_score(matrix(spark, d), WTS, 0.05, 0.5)


SW = {"ret_20d": 0.4, "mom_3m": 0.3, "vol_20d": -0.2}


@query("standardised_score", "F2", K + "score:f", f"""
WITH {FM}, s AS (SELECT {', '.join(f"avg({c}) AS mu_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS sd_{c}" for c in SW)} FROM fmx)
SELECT ticker, date, 0.1 + {' + '.join(f"coalesce(({c} - mu_{c})/sd_{c}, 0)*{w!r}" for c, w in SW.items())} AS score FROM fmx, s""")
def standardised_score(spark, d):
    m = matrix(spark, d)
    return SC.standardised_score(m, SC.fit_scaler(m, list(SW)), SW, 0.1)


BULL, BEAR, DFLT = {"mom_3m": 2.0, "r": 1.0}, {"mom_6m": -1.0, "vol_20": 0.1}, {"mom_3m": 0.5, "mom_6m": 0.5}


@query("regime_weighted_score", "F3", K + "regime:s score:f", f"""
WITH {SCORED} SELECT ticker, date, regime, CASE regime WHEN 'Bull' THEN {lin(BULL)} WHEN 'Bear' THEN {lin(BEAR)} ELSE {lin(DFLT)} END AS score FROM sc""")
def regime_weighted_score(spark, d):
    return SC.regime_score(scored(spark, d), {"Bull": BULL, "Bear": BEAR}, DFLT)


SENT = """snt AS (SELECT user_id AS ticker, CAST(ts AS DATE) - 9000 AS date,
  avg(value) FILTER (event_type = 'click')/100 AS regional_sentiment, avg(value) FILTER (event_type = 'view')/100 AS global_sentiment,
  avg(value) FILTER (event_type = 'purchase')/100 AS social_sentiment,
  least(count(*) FILTER (event_type = 'click')/3.0, 1) AS regional_impact, least(count(*) FILTER (event_type = 'view')/3.0, 1) AS global_impact,
  least(count(*) FILTER (event_type = 'purchase')/3.0, 1) AS social_impact FROM events GROUP BY 1, 2)"""


def sentiments(spark, d):
    t = S.ticks(spark, d).groupBy("ticker", F.date_sub(F.to_date("ts"), 9000).alias("date"))
    aggs = []
    for name, kind in (("regional", "click"), ("global", "view"), ("social", "purchase")):
        aggs += [(F.avg(F.when(F.col("side") == kind, F.col("score"))) / 100).alias(f"{name}_sentiment"),
                 F.least(F.count_if(F.col("side") == kind) / 3.0, F.lit(1.0)).alias(f"{name}_impact")]
    return t.agg(*aggs)


@query("rule_score", "F4", K + "adjusted_score:f", f"""
WITH {SCORED}, {SENT} SELECT sc.ticker, sc.date, {rh("""score*(CASE WHEN vol_20 < 0.75 THEN 1.0 WHEN vol_20 <= 0.95 THEN 0.6 ELSE 0.3 END)
 + coalesce(regional_sentiment*regional_impact, 0) + coalesce(global_sentiment*global_impact, 0) + coalesce(social_sentiment*social_impact, 0)""", 4)} AS adjusted_score
FROM sc LEFT JOIN snt ON sc.ticker = snt.ticker AND sc.date = snt.date""")
def rule_score(spark, d):
    t = T.confidence(trend(spark, d).withColumn("r", F.col("ret_1d")), 0.75, 0.95)
    return SC.rule_score(t.join(sentiments(spark, d), ["ticker", "date"], "left"))


@query("fixed_classification", "F5", K + "signal:s direction:s scaled:f", f"""
WITH {TREND} SELECT ticker, date, CASE WHEN trend_score > 0.5 THEN 'Bullish' WHEN trend_score < -0.5 THEN 'Bearish' ELSE 'Neutral' END AS signal,
 CASE WHEN trend_score >= 0.1 THEN 'Bullish' WHEN trend_score <= -0.1 THEN 'Bearish' ELSE 'Neutral' END AS direction,
 {rh("1 + (least(greatest(trend_score, -1), 1) + 1)/2*9", 2)} AS scaled FROM ts""")
def fixed_classification(spark, d):
    s = F.col("trend_score")
    return trend(spark, d).withColumns({"signal": X.classify(s, 0.5, -0.5), "direction": SC.direction(s),
                                        "scaled": SC.ten_scale(F.greatest(F.least(s, F.lit(1.0)), F.lit(-1.0)))})


THR = "greatest(0.3, 0.3 + (10.0 + 5.0 + 5.0)*2/10000/5*100 + greatest((coalesce(vp, 0.5) - 0.5)*0.2, 0))"
VP = f"vp0 AS (SELECT *, {pr('round(vol_20, 10)', 252, 20)} AS vp FROM sc)"


@query("cost_vol_threshold", "F6", K + "bull_threshold:f", f"WITH {SCORED}, {VP} SELECT ticker, date, {THR} AS bull_threshold FROM vp0")
def cost_vol_threshold(spark, d):
    s = SC.score_percentile(scored(spark, d))
    return s.withColumn("bull_threshold", SC.cost_threshold(F.col("vol_percentile"), 0.3))


SIG = SCORED + f""", {VP}, {ewm_sql('sc', 'score', 5, 3)},
sig AS (SELECT vp0.*, ew AS smoothed_score, {THR} AS bull_threshold,
  CASE WHEN ew > {THR} THEN 'Bullish' WHEN ew < -{THR} THEN 'Bearish' ELSE 'Neutral' END AS signal,
  least(greatest(abs(least(greatest(score, -1), 1)), 0.3), 0.95) AS confidence_numeric FROM vp0 JOIN ew USING (ticker, date))"""


def signals(spark, d):
    return SC.signal_frame(SC.score_percentile(scored(spark, d)), "score")


@query("signal_frame", "F7", K + "smoothed_score:f bull_threshold:f signal:s confidence_numeric:f", f"WITH {SIG} SELECT * FROM sig")
def signal_frame(spark, d):
    return signals(spark, d)


MEMBERS = {"score": ("regressor", 0.5), "p_up": ("classifier", 0.3), "p_down": ("short_classifier", 0.2)}
ENS_IN = """en AS (SELECT ticker, date, round(score, 10) AS a, round(2*(1/(1 + exp(-mom_3m))) - 1, 10) AS b,
  round(-(2*(1/(1 + exp(mom_6m))) - 1), 10) AS c FROM sc)"""


def members(spark, d):
    s = scored(spark, d)
    return s.withColumns({"p_up": 1 / (1 + F.exp(-F.col("mom_3m"))), "p_down": 1 / (1 + F.exp(F.col("mom_6m")))})


@query("ensemble_rank_score", "F8", K + "ensemble_score:f", f"""
WITH {SCORED}, {ENS_IN} SELECT ticker, date, 0.5*coalesce({prank('a')}, 0.5) + 0.3*coalesce({prank('b')}, 0.5) + 0.2*coalesce({prank('c')}, 0.5) AS ensemble_score FROM en""")
def ensemble_rank_score(spark, d):
    return SC.ensemble(members(spark, d).select("ticker", "date", *MEMBERS), MEMBERS, "rank")


@query("ensemble_zscore", "F8", K + "ensemble_score:f", f"""
WITH {SCORED}, {ENS_IN} SELECT ticker, date, {' + '.join(f"{w}*CASE WHEN count({c}) OVER w >= 20 THEN ({c} - avg({c}) OVER w)/greatest(stddev_samp({c}) OVER w, 1e-8) END" for c, w in (('a', 0.5), ('b', 0.3), ('c', 0.2)))} AS ensemble_score
FROM en WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def ensemble_zscore(spark, d):
    return SC.ensemble(members(spark, d), MEMBERS, "zscore")


NEWS_DAY = """nd AS (SELECT user_id AS ticker, CAST(ts AS DATE) - 9000 AS date, avg(value)/50 - 1 AS news FROM events GROUP BY 1, 2)"""


def news_day(spark, d):
    return S.ticks(spark, d).groupBy("ticker", F.date_sub(F.to_date("ts"), 9000).alias("date")).agg((F.avg("score") / 50 - 1).alias("news"))


COMP = SCORED + f""", {NEWS_DAY}, comp AS (SELECT sc.ticker, sc.date, news, {rh("least(greatest(0.6*least(greatest(score, -1), 1) + 0.4*coalesce(news, 0), -1), 1)", 4)} AS composite,
  {rh("1 + (least(greatest(0.6*least(greatest(score, -1), 1) + 0.4*coalesce(news, 0), -1), 1) + 1)/2*9", 2)} AS signal_score FROM sc LEFT JOIN nd ON sc.ticker = nd.ticker AND sc.date = nd.date)"""


def comp(spark, d):
    return SC.composite(scored(spark, d).join(news_day(spark, d), ["ticker", "date"], "left"), "score", "news")


@query("composite_top_bottom", "F9", K + "composite:f direction:s signal_score:f side:s rn:i", f"""
WITH {COMP}, c AS (SELECT *, CASE WHEN composite >= 0.1 THEN 'Bullish' WHEN composite <= -0.1 THEN 'Bearish' ELSE 'Neutral' END AS direction,
 row_number() OVER (PARTITION BY date ORDER BY composite DESC, ticker) AS up, row_number() OVER (PARTITION BY date ORDER BY composite, ticker DESC) AS dn FROM comp)
SELECT *, 'long' AS side, up AS rn FROM c WHERE up <= 5 UNION ALL SELECT *, 'short', dn FROM c WHERE dn <= 5""")
def composite_top_bottom(spark, d):
    c = comp(spark, d)
    t = G.top_n(c, 5, [F.desc("composite"), F.col("ticker")]).withColumn("side", F.lit("long"))
    b = G.top_n(c, 5, [F.asc("composite"), F.desc("ticker")]).withColumn("side", F.lit("short"))
    return t.unionByName(b)


@query("market_sentiment", "F9", "date:d market_sentiment:f", f"""
WITH {COMP} SELECT date, {rh("avg(coalesce(news, 0))", 4)} AS market_sentiment FROM comp GROUP BY date""")
def market_sentiment(spark, d):
    return SC.market_sentiment(comp(spark, d), "news")


@query("threshold_efficiency", "F10", "fired_dynamic:i fired_static:i tightening:f saving_bps:f", f"""
WITH {SIG}, a AS (SELECT count(*) FILTER (signal <> 'Neutral') AS fired_dynamic, count(*) FILTER (abs(smoothed_score) > 0.5) AS fired_static, avg(bull_threshold - 0.5) AS tightening FROM sig)
SELECT *, greatest(fired_static - fired_dynamic, 0)*40.0 AS saving_bps FROM a""")
def threshold_efficiency(spark, d):
    return SC.threshold_efficiency(signals(spark, d), 40.0)


# --- selection -------------------------------------------------------------------

ADV = """ad AS (SELECT ticker, avg(volume) AS adv, avg(volume*close) AS dollar_adv FROM
 (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM prices) WHERE rn <= 20 GROUP BY ticker)"""


@query("liquid_universe", "G1", "ticker:i adv:f dollar_adv:f", f"WITH {PRICES}, {ADV} SELECT * FROM ad WHERE adv >= 25 AND dollar_adv >= 2600")
def liquid_universe(spark, d):
    return G.liquid_universe(bars(spark, d), 20, 25, 2600)


@query("top_dollar_adv", "G2", "ticker:i dollar_adv:f", f"WITH {PRICES}, {ADV} SELECT ticker, dollar_adv FROM ad ORDER BY dollar_adv DESC, ticker LIMIT 25")
def top_dollar_adv(spark, d):
    return G.top_dollar_adv(bars(spark, d), 25)


@query("adv_fallback_chain", "G3", "ticker:i adv:f source:s", f"""
WITH {PRICES}, {ADV}, c AS (SELECT user_id AS ticker, CAST(count(*) AS DOUBLE) AS adv FROM events GROUP BY user_id HAVING count(*) > 60),
n AS (SELECT DISTINCT user_id AS ticker FROM events)
SELECT n.ticker, coalesce(c.adv, ad.adv, 1e6) AS adv, CASE WHEN c.adv IS NOT NULL THEN 'cache' WHEN ad.adv IS NOT NULL THEN 'computed' ELSE 'default' END AS source
FROM n LEFT JOIN c USING (ticker) LEFT JOIN ad USING (ticker)""")
def adv_fallback_chain(spark, d):
    per = S.ticks(spark, d).groupBy("ticker").agg(F.count(F.lit(1)).cast("double").alias("adv"))
    return G.adv_with_fallback(per.select("ticker"), per.where("adv > 60"), G.liquidity(bars(spark, d)), 1e6)


def topk(src, k, extra=""):
    return f"""tk0 AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rn FROM {src} WHERE score IS NOT NULL),
tk1 AS (SELECT *, score - least(min(score) OVER (PARTITION BY date), 0) AS a FROM tk0 WHERE rn <= {k}),
tk AS (SELECT *, CASE WHEN sum(a) OVER (PARTITION BY date) > 0 THEN a/nullif(sum(a) OVER (PARTITION BY date), 0) ELSE 1.0/count(*) OVER (PARTITION BY date) END AS weight FROM tk1)"""


@query("top_k_weights", "G4", K + "score:f rn:i weight:f", f"WITH {SCORED}, {topk('sc', 5)} SELECT ticker, date, score, rn, weight FROM tk")
def top_k_weights(spark, d):
    return G.top_k_weights(scored(spark, d), "score", 5)


@query("regime_top_k_weights", "G5", K + "regime:s exposure:f weight:f", f"""
WITH {SCORED}, {topk('sc', "CASE WHEN regime = 'Crisis' THEN 4 ELSE 10 END")}
SELECT ticker, date, regime, CASE WHEN regime = 'Crisis' THEN 0.25 ELSE 1.0 END AS exposure, weight*CASE WHEN regime = 'Crisis' THEN 0.25 ELSE 1.0 END AS weight FROM tk""")
def regime_top_k_weights(spark, d):
    return G.regime_top_k(scored(spark, d), "score")


RW = f"""rw0 AS (SELECT *, {prank('score')}*count(score) OVER (PARTITION BY date) AS rk, count(score) OVER (PARTITION BY date) AS n FROM sc),
rw1 AS (SELECT *, coalesce((rk - 1)/nullif(n - 1, 0), 0.5) AS rank_pct FROM rw0)"""


@query("rank_centred_weights", "G6", K + "rank_pct:f weight:f", f"""
WITH {SCORED}, {RW}, w AS (SELECT *, sum(abs(rank_pct - 0.5)) OVER (PARTITION BY date) AS g FROM rw1)
SELECT ticker, date, rank_pct, CASE WHEN g > 1e-12 THEN (rank_pct - 0.5)/nullif(g, 0) ELSE 0 END AS weight FROM w""")
def rank_centred_weights(spark, d):
    return G.rank_weights(scored(spark, d).select("ticker", "date", "score"), "score")


@query("rank_long_only_weights", "G6", K + "rank_pct:f weight:f", f"""
WITH {SCORED}, {RW}, w AS (SELECT *, sum(greatest(rank_pct - 0.5, 0)) OVER (PARTITION BY date) AS g FROM rw1)
SELECT ticker, date, rank_pct, CASE WHEN g > 1e-12 THEN greatest(rank_pct - 0.5, 0)/nullif(g, 0) ELSE 1.0/n END AS weight FROM w""")
def rank_long_only_weights(spark, d):
    return G.rank_weights(scored(spark, d).select("ticker", "date", "score"), "score", True)


@query("high_conviction", "G7", K + "rank_pct:f weight:f", f"""
WITH {SCORED}, {RW}, p AS (SELECT *, max(CASE WHEN rank_pct > 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY date) AS ap FROM rw1),
t AS (SELECT * FROM p WHERE ap = 0 OR rank_pct > 0.9 QUALIFY row_number() OVER (PARTITION BY date ORDER BY rank_pct DESC, score DESC, ticker) <= 5)
SELECT ticker, date, rank_pct, CASE WHEN sum(rank_pct) OVER d > 1e-12 THEN rank_pct/nullif(sum(rank_pct) OVER d, 0) ELSE 1.0/count(*) OVER d END AS weight FROM t WINDOW d AS (PARTITION BY date)""")
def high_conviction(spark, d):
    return G.high_conviction(G.rank_weights(scored(spark, d).select("ticker", "date", "score"), "score"), "rank_pct", "score", 0.9, 5)


PRIOR = """tc AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem GROUP BY 1, 2),
pc AS (SELECT ticker, date, sum(n) OVER (PARTITION BY ticker ORDER BY date) - n AS n_prior FROM tc)"""


@query("ranked_candidates", "G8", K + "signal:s adj:f hold:i prior:i priority:i", f"""
WITH {SIG}, {PRIOR}, s AS (SELECT *, {rh("score", 4)} AS adj FROM sig WHERE signal <> 'Neutral' AND (abs(score) >= 1e-9 OR abs(score) >= 0.3)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY date, signal ORDER BY abs(adj) DESC, ticker) <= 5),
j AS (SELECT b.*, coalesce(n_prior, 0) AS prior FROM b LEFT JOIN pc ON b.ticker = pc.ticker AND b.date = pc.date),
h AS (SELECT *, CASE WHEN abs(adj) >= 0.5 THEN 10 WHEN abs(adj) >= 0.3 THEN 5 WHEN signal = 'Bearish' THEN 3 ELSE 5 END AS h0 FROM j)
SELECT ticker, date, signal, adj, CASE WHEN regime IN ('Crisis', 'Bear') THEN least(h0, 3) ELSE h0 END AS hold, prior,
 row_number() OVER (PARTITION BY date ORDER BY abs(adj) - 0.002*prior DESC, ticker) AS priority FROM h""")
def ranked_candidates(spark, d):
    return G.ranked_candidates(signals(spark, d), G.prior_counts(S.trades(spark, d)))


@query("longs_and_shorts", "G9", K + "score:f side:s rn:i", f"""
WITH {SCORED}, s AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS up, row_number() OVER (PARTITION BY date ORDER BY score, ticker DESC) AS dn,
 count(*) OVER (PARTITION BY date) AS n FROM sc WHERE abs(score) >= 0.1)
SELECT ticker, date, score, 'long' AS side, up AS rn FROM s WHERE up <= 5 UNION ALL SELECT ticker, date, score, 'short', dn FROM s WHERE dn <= 5 AND up > 5 AND n >= 5""")
def longs_and_shorts(spark, d):
    return G.longs_and_shorts(scored(spark, d), "score", 5, 5, 0.1)


@query("daily_selection", "G10", K + "score:f signal:i rn:i", f"""
WITH {SCORED}, q AS (SELECT date, quantile_cont(score, 0.95) AS q FROM sc WHERE regime = 'Crisis' GROUP BY date),
a AS (SELECT sc.* FROM sc LEFT JOIN q USING (date) WHERE q IS NULL OR score > q),
b AS (SELECT *, coalesce(stddev_samp(score) OVER (PARTITION BY date), 0) AS sd FROM a), c AS (SELECT * FROM b WHERE abs(score) > 0.8*sd),
s AS (SELECT * FROM c WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) <= 5
 UNION ALL SELECT * FROM c WHERE score < 0 QUALIFY row_number() OVER (PARTITION BY date ORDER BY score, ticker) <= 5)
SELECT ticker, date, score, CASE WHEN score > 0 THEN 1 ELSE -1 END AS signal, row_number() OVER (PARTITION BY date ORDER BY abs(score) DESC, ticker) AS rn FROM s QUALIFY rn <= 8""")
def daily_selection(spark, d):
    return G.daily_selection(scored(spark, d), "score")


TW = """tw0 AS (SELECT *, stddev_pop(score) OVER (PARTITION BY date) AS sd FROM sc),
tw1 AS (SELECT * FROM tw0 WHERE abs(score) > CASE WHEN sd > 0 THEN 0.8*sd ELSE 0 END),
tw2 AS (SELECT * FROM tw1 WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) <= 10
  UNION ALL SELECT * FROM tw1 WHERE score < 0 QUALIFY row_number() OVER (PARTITION BY date ORDER BY score, ticker) <= 5),
tw3 AS (SELECT *, sign(score)*least(1.0/count(*) OVER (PARTITION BY date), 0.12) AS w FROM tw2),
tw4 AS (SELECT *, sum(greatest(w, 0)) OVER (PARTITION BY date) AS l, -sum(least(w, 0)) OVER (PARTITION BY date) AS s FROM tw3),
tw5 AS (SELECT *, w*CASE WHEN w > 0 AND l - s > 0.6 THEN greatest(least((0.6 + s)/l, 1), 0) WHEN w < 0 AND l - s < -0.6 THEN greatest(least((l + 0.6)/s, 1), 0) ELSE 1 END AS w2 FROM tw4),
tw AS (SELECT *, CASE WHEN sum(abs(w2)) OVER (PARTITION BY date) > 1 THEN w2/sum(abs(w2)) OVER (PARTITION BY date) ELSE w2 END AS target_weight FROM tw5)"""


def target(spark, d):
    return G.target_weights(written(scored(spark, d), "scores"), "score")


@query("target_weights", "G11", K + "score:f target_weight:f", f"WITH {SCORED}, {TW} SELECT ticker, date, score, target_weight FROM tw")
def target_weights(spark, d):
    return target(spark, d)


CARRY = """ci2 AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM prices)),
cb AS (SELECT tw.ticker, n.date, tw.target_weight AS current_weight FROM tw JOIN ci2 c ON tw.date = c.date JOIN ci2 n ON n.idx = c.idx + 1)"""
RECON = """rc AS (SELECT coalesce(t.ticker, c.ticker) AS ticker, coalesce(t.date, c.date) AS date, sign(target_weight) AS t, sign(current_weight) AS c
  FROM tw t FULL JOIN cb c ON t.ticker = c.ticker AND t.date = c.date),
acts AS (SELECT ticker, date, 'open' AS action FROM rc WHERE c IS NULL OR (t IS NOT NULL AND t <> c)
  UNION ALL SELECT ticker, date, 'close' FROM rc WHERE t IS NULL OR (c IS NOT NULL AND t <> c) UNION ALL SELECT ticker, date, 'hold' FROM rc WHERE t = c)"""


def book_and_current(spark, d):
    t = written(target(spark, d), "book")  # a date's slots; read by both sides of the comparison
    return t, G.carried_book(t, B.calendar(bars(spark, d)))


@query("reconcile_book", "G12", K + "action:s", f"WITH {SCORED}, {TW}, {CARRY}, {RECON} SELECT * FROM acts")
def reconcile_book(spark, d):
    return G.reconcile(*book_and_current(spark, d))


def book_with_limits(spark, d):
    t = target(spark, d)
    beta = T.capm_parts(rm(spark, d)).select("ticker", "date", F.col("capm_beta").alias("beta"))
    adv = bars(spark, d).withColumn("adv", W.roll_mean("volume", 20, 1)).select("ticker", "date", "adv")
    j = t.join(beta, ["ticker", "date"], "left").join(adv, ["ticker", "date"], "left").join(S.sectors(spark, d).select("ticker", "sector"), "ticker", "left")
    return j.fillna({"beta": 1.0, "sector": "Unknown"})


#: Limits of the demonstration; beta and the part of daily volume bind on these tables.
ON = {"max_positions": 10, "cap": 0.12, "max_beta": 0.5, "max_sector": 0.33, "max_adv_frac": 60.0, "equity": 1e6}


def opening_book(spark, d):
    """The target book of each date, held on the next, with that day's betas."""
    b = book_with_limits(spark, d)
    held = G.carried_book(b, B.calendar(bars(spark, d))).withColumnRenamed("current_weight", "weight")
    beta = T.capm_parts(rm(spark, d)).select("ticker", "date", F.col("capm_beta").alias("beta"))
    h = held.join(beta, ["ticker", "date"], "left").join(S.sectors(spark, d).select("ticker", "sector"), "ticker", "left")
    return b, h.fillna({"beta": 1.0, "sector": "Unknown"})


GREEDY = f"""{SCORED}, {CAPM[len(MARKET):].lstrip(", ")}, {SECTORS}, {TW},
av AS (SELECT ticker, date, close AS px, {roll('avg', 'volume', 20, 1)} AS adv FROM prices),
bk AS (SELECT tw.ticker, tw.date, tw.score, tw.target_weight, coalesce(capm_beta, 1.0) AS beta, coalesce(sector, 'Unknown') AS sector, adv, px,
  row_number() OVER (PARTITION BY tw.date ORDER BY tw.score DESC, tw.ticker) AS rn FROM tw LEFT JOIN c3 ON c3.ticker = tw.ticker AND c3.date = tw.date
  LEFT JOIN av ON av.ticker = tw.ticker AND av.date = tw.date LEFT JOIN sectors ON sectors.ticker = tw.ticker),
cd AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM prices)),
hd AS (SELECT tw.ticker, b.date, tw.target_weight AS w, coalesce(capm_beta, 1.0) AS beta, coalesce(sector, 'Unknown') AS sector FROM tw JOIN cd a ON a.date = tw.date JOIN cd b ON b.i = a.i + 1
  LEFT JOIN c3 ON c3.ticker = tw.ticker AND c3.date = b.date LEFT JOIN sectors ON sectors.ticker = tw.ticker)"""


@query("greedy_limits_on_holdings", "G13", K + "score:f reason:s weight:f round:i", f"""
WITH RECURSIVE {GREEDY},
ou AS (SELECT date, sector, sum(abs(w)) AS u FROM hd GROUP BY date, sector), ol AS (SELECT date, list({{'s': sector, 'u': u}}) AS used FROM ou GROUP BY date),
ob AS (SELECT date, sum(w*beta) AS b0 FROM hd GROUP BY date), bd AS (SELECT DISTINCT date FROM bk),
st AS (SELECT bd.date, coalesce(b0, 0.0) AS b0, coalesce(used, []) AS used FROM bd LEFT JOIN ob USING (date) LEFT JOIN ol USING (date)),
cn AS (SELECT bk.*, sign(score)*0.1 - coalesce(hd.w, 0) AS delta FROM bk LEFT JOIN hd ON hd.ticker = bk.ticker AND hd.date = bk.date),
wk AS (SELECT date, CAST(0 AS BIGINT) AS rn, b0 AS b, used AS u, 0 AS kept, '' AS reason FROM st
  UNION ALL SELECT date, rn, CASE WHEN reason = 'kept' THEN nb ELSE b END, CASE WHEN reason = 'kept' THEN list_filter(u, lambda x: x.s <> sector) || [{{'s': sector, 'u': nu}}] ELSE u END, kept + (reason = 'kept')::INT, reason
  FROM (SELECT *, CASE WHEN score = 0 THEN 'no_side' WHEN kept >= 10 THEN 'slots_full' WHEN nb > 0.5 THEN 'max_beta' WHEN nu > 0.33 THEN 'max_sector_exposure' WHEN 0.1*1e6/px > 60.0*adv THEN 'liquidity_adv' ELSE 'kept' END AS reason
    FROM (SELECT w.date, c.rn, w.b, w.u, w.kept, c.sector, c.score, c.px, c.adv, w.b + c.delta*c.beta AS nb,
      coalesce(list_sum(list_transform(list_filter(w.u, lambda x: x.s = c.sector), lambda x: x.u)), 0) + abs(c.delta) AS nu FROM wk w JOIN cn c ON c.date = w.date AND c.rn = w.rn + 1))),
fx AS (SELECT date, 0 AS turn, list({{'r': rn, 'm': 60.0*adv*px/1e6}}) AS k FROM wk JOIN cn USING (date, rn) WHERE reason = 'kept' GROUP BY date
  UNION ALL SELECT date, turn + 1, n FROM (SELECT date, turn, k, list_filter(k, lambda x: least(1.0/len(k), 0.12) <= x.m) AS n FROM fx WHERE len(k) > 0) WHERE len(n) < len(k)),
dr AS (SELECT date, turn, unnest(list_transform(k, lambda x: x.r)) AS rn FROM fx), lt AS (SELECT date, rn, max(turn) AS turn FROM dr GROUP BY date, rn), ends AS (SELECT date, max(turn) AS turn, arg_max(len(k), turn) AS n FROM fx GROUP BY date)
SELECT c.ticker, c.date, c.score, CASE WHEN wk.reason = 'kept' AND lt.turn < ends.turn THEN 'liquidity_adv_sizing' ELSE wk.reason END AS reason,
  CASE WHEN wk.reason = 'kept' AND lt.turn = ends.turn THEN sign(c.score)*least(1.0/ends.n, 0.12) ELSE 0.0 END AS weight,
  CASE WHEN wk.reason = 'kept' AND lt.turn < ends.turn THEN lt.turn + 1 ELSE 0 END AS round
FROM cn c JOIN wk ON wk.date = c.date AND wk.rn = c.rn LEFT JOIN lt ON lt.date = c.date AND lt.rn = c.rn LEFT JOIN ends ON ends.date = c.date""")
def greedy_limits_on_holdings(spark, d):
    b, held = opening_book(spark, d)
    return G.limits_on_holdings(b, held, **ON)


@query("greedy_factor_limits", "G13", K + "score:f reason:s weight:f", f"""
WITH RECURSIVE {GREEDY},
wk AS (SELECT DISTINCT date, CAST(0 AS BIGINT) AS rn, CAST(0 AS DOUBLE) AS b, CAST([] AS STRUCT(s VARCHAR, u DOUBLE)[]) AS u, 0 AS kept, '' AS reason FROM bk
  UNION ALL SELECT date, rn, CASE WHEN reason = 'kept' THEN nb ELSE b END, CASE WHEN reason = 'kept' THEN list_filter(u, lambda x: x.s <> sector) || [{{'s': sector, 'u': nu}}] ELSE u END, kept + (reason = 'kept')::INT, reason
  FROM (SELECT *, CASE WHEN kept >= 10 THEN 'slots_full' WHEN nb > 0.5 THEN 'max_beta' WHEN nu > 0.3 + 1e-12 THEN 'max_sector_exposure' WHEN 0.1*1e6/px > 50.0*adv THEN 'liquidity_adv' ELSE 'kept' END AS reason
    FROM (SELECT w.date, c.rn, w.b, w.u, w.kept, c.sector, c.px, c.adv, w.b + sign(c.score)*0.1*c.beta AS nb,
      coalesce(list_sum(list_transform(list_filter(w.u, lambda x: x.s = c.sector), lambda x: x.u)), 0) + 0.1 AS nu FROM wk w JOIN bk c ON c.date = w.date AND c.rn = w.rn + 1))),
kn AS (SELECT date, max(kept) AS n FROM wk GROUP BY date)
SELECT bk.ticker, bk.date, bk.score, reason, CASE WHEN reason = 'kept' THEN sign(bk.score)*least(1.0/n, 0.12) ELSE 0.0 END AS weight FROM bk JOIN wk USING (date, rn) JOIN kn USING (date)""")
def greedy_factor_limits(spark, d):
    b = book_with_limits(spark, d)
    return G.greedy_limits(b, max_positions=10, max_beta=0.5, max_sector=0.3, max_adv_frac=50.0)


@query("greedy_limits_carried", "G13", K + "score:f reason:s weight:f round:i")
def greedy_limits_carried(spark, d):
    return G.limits_carried(book_with_limits(spark, d).withColumn("account", F.lit(1)), **ON)


@query("single_name_and_adv_limits", "G13", K + "target_weight:f over_single:b over_adv:b", f"""
WITH {SCORED}, {TW}, av AS (SELECT ticker, date, {roll('avg', 'volume', 20, 1)} AS adv FROM prices)
SELECT tw.ticker, tw.date, target_weight, abs(target_weight) > 0.08 AS over_single, abs(target_weight)*1e6/close > 40*adv AS over_adv FROM tw JOIN av ON tw.ticker = av.ticker AND tw.date = av.date""")
def single_name_and_adv_limits(spark, d):
    adv = bars(spark, d).withColumn("adv", W.roll_mean("volume", 20, 1)).select("ticker", "date", "adv")
    return G.limit_flags(target(spark, d).join(adv, ["ticker", "date"]), 0.08, 40.0, 1e6)


@query("correlation_pruning", "G14", K + "score:f max_corr:f kept:b")
def correlation_pruning(spark, d):
    cands = G.top_n(scored(spark, d).select("ticker", "date", "score"), 8, [F.desc(F.abs("score")), F.col("ticker")])
    return G.prune_correlated(G.return_history(rets(spark, d), cands, 60), 0.7)


@query("drawdown_multiplier", "G15", "date:d drawdown:f multiplier:f", f"""
WITH {EQUITY}, p AS (SELECT *, (max(equity) OVER (ORDER BY date) - equity)/max(equity) OVER (ORDER BY date) AS drawdown FROM equity)
SELECT *, CASE WHEN drawdown < 0.05 THEN 1.0 WHEN drawdown < 0.10 THEN 0.8 WHEN drawdown < 0.15 THEN 0.6 ELSE 0.4 END AS multiplier FROM p""")
def drawdown_multiplier(spark, d):
    return G.drawdown_multiplier(S.equity_curve(S.trades(spark, d)))


@query("vol_scaled_book", "G16", K + "scaled_weight:f cut_weight:f", f"""
WITH {SCORED}, {TW}, v AS (SELECT *, round(target_weight*least(0.15/greatest(coalesce(vol_20, 0.15), 0.05), 3), 12) AS sv FROM tw),
w AS (SELECT *, CASE WHEN sum(abs(sv)) OVER (PARTITION BY date) > 0 THEN sv/nullif(sum(abs(sv)) OVER (PARTITION BY date), 0) ELSE 0 END AS scaled_weight FROM v)
SELECT ticker, date, scaled_weight, CASE WHEN vol_20 > 0.9 THEN scaled_weight*0.5 ELSE scaled_weight END AS cut_weight FROM w""")
def vol_scaled_book(spark, d):
    b = G.vol_scaled_weights(target(spark, d), "target_weight", "vol_20")
    return b.withColumn("cut_weight", G.kill_switch(F.col("scaled_weight"), F.col("vol_20"), 0.9, 0.5))


@query("position_sizes", "G17", K + "eq:f volw:f kelly:f composed:f", f"""
WITH {SCORED}, b AS (SELECT *, CASE regime WHEN 'Bull' THEN 1.0 WHEN 'Bear' THEN 0.6 WHEN 'Crisis' THEN 0.3 ELSE 0.8 END AS rs FROM sc)
SELECT ticker, date, greatest(least(greatest(1e5/10*rs, 0), 25000), 0) AS eq,
 greatest(least(CASE WHEN vol_20 IS NULL OR vol_20 <= 1e-8 THEN 1e4*rs ELSE least(15000/greatest(vol_20, 1e-3), 1e4*rs*3) END, 25000), 0) AS volw,
 greatest(least(greatest(1e5*least(greatest(((0.5 + score/10)*(0.02/0.015) - (0.5 - score/10))/(0.02/0.015), 0), 1)*0.5*rs, 5000), 25000), 0) AS kelly,
 coalesce(CASE WHEN score < 0 THEN 0 WHEN abs(1e5*score*0.15/vol_20*rs) < 1000 THEN 0 ELSE greatest(least(1e5*score*(0.15/vol_20)*rs, 12000), -12000) END, 0) AS composed FROM b""")
def position_sizes(spark, d):
    s = R.regime_lookup(scored(spark, d), R.POSITION_SCALE, "rs", default=0.8)
    e, rs, vol = F.lit(1e5), F.col("rs"), F.col("vol_20")
    return s.withColumns({
        "eq": G.size_equal(e, 10, rs), "volw": G.size_vol(e, 10, rs, vol),
        "kelly": G.size_kelly(e, 10, rs, 0.5 + F.col("score") / 10, F.lit(0.02), F.lit(0.015)),
        "composed": G.size_composed(e, F.col("score"), 0.15 / vol, rs, floor=0.01)})


@query("rolling_kelly_inputs", "G18", "date:d n_trades:i win_rate:f avg_win:f avg_loss:f", f"""
WITH {TRADES}, s AS (SELECT *, row_number() OVER (ORDER BY exit_date, order_id, line, part, position_size, ret) AS rn FROM trades),
w AS (SELECT exit_date, rn, count(*) OVER f AS n_trades, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) OVER f AS win_rate, coalesce(avg(CASE WHEN ret > 0 THEN ret END) OVER f, 0.02) AS avg_win,
 coalesce(avg(CASE WHEN ret < 0 THEN -ret END) OVER f, 0.015) AS avg_loss FROM s WINDOW f AS (ORDER BY rn ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT exit_date AS date, n_trades, win_rate, avg_win, avg_loss FROM w WHERE n_trades >= 20 QUALIFY row_number() OVER (PARTITION BY exit_date ORDER BY rn DESC) = 1""")
def rolling_kelly_inputs(spark, d):
    return G.rolling_kelly(S.trades(spark, d))


SCB = SCORED + f""", {CAPM[len(MARKET):].lstrip(', ')}, g0 AS (SELECT sc.*, capm_beta AS beta FROM sc JOIN c3 ON sc.ticker = c3.ticker AND sc.date = c3.date),
rsd AS (SELECT regime, CASE WHEN count(score) >= 10 AND stddev_samp(score) > 0 THEN stddev_samp(score) ELSE 0.1 END AS rs FROM sc GROUP BY regime)"""


@query("score_history_gates", "G19", K + "quantile_ok:b beta_ok:b strength_ok:b enter:b", f"""
WITH {SCB}, g1 AS (SELECT *, count(score) OVER (PARTITION BY ticker ORDER BY date) AS cnt, quantile_cont(score, 0.95) OVER {win(60)} AS cq, quantile_cont(score, 0.7) OVER {win(60)} AS bq,
 stddev_samp(score) OVER {win(60)} AS sd FROM g0),
g2 AS (SELECT g1.*, CASE WHEN cnt >= 20 THEN sd ELSE rs END AS s FROM g1 LEFT JOIN rsd ON g1.regime = rsd.regime),
g3 AS (SELECT *, NOT CASE WHEN regime = 'Crisis' AND cnt >= 30 THEN score < cq WHEN regime = 'Bear' AND cnt >= 30 THEN score < bq ELSE false END AS quantile_ok,
 NOT (regime = 'Crisis' AND coalesce(beta, 0) > 1) AS beta_ok, NOT coalesce(s > 1e-12 AND abs(score) < 1.0*s*CASE WHEN regime = 'Sideways' THEN 1.2 ELSE 1 END, false) AS strength_ok FROM g2)
SELECT *, quantile_ok AND beta_ok AND strength_ok AS enter FROM g3""")
def score_history_gates(spark, d):
    s = written(scored(spark, d).select("ticker", "date", "score", "regime"), "scores")  # read by the gates and the regimes' spread
    beta = T.capm_parts(rm(spark, d)).select("ticker", "date", F.col("capm_beta").alias("beta"))
    return G.score_gates(s.join(beta, ["ticker", "date"]), "score", R.regime_score_std(s, "score"))


@query("sector_exposure_flags", "G20", "date:d n:i top1:f top2:f sector_share:f signal:f beta:f flags:s", f"""
WITH {TRADES}, {SECTORS}, h AS (SELECT entry_date AS date, t.ticker, sector, sum(position_size) AS v, avg(adjusted_score) AS s FROM trades t JOIN sectors USING (ticker) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY v DESC, ticker) AS rn FROM h),
a AS (SELECT date, count(*) AS n, max(v)/sum(v) AS top1, sum(v) FILTER (rn <= 2)/sum(v) AS top2, count(*) FILTER (sector = 'ASIA')/count(*)::DOUBLE AS sector_share,
 sum(v*s)/sum(v) AS signal, sum(v*(1 + s))/sum(v) AS beta FROM k GROUP BY date)
SELECT *, concat_ws(',', CASE WHEN top1 > 0.25 THEN 'single' END, CASE WHEN n >= 2 AND top2 > 0.5 THEN 'top2' END, CASE WHEN sector_share >= 0.6 THEN 'sector' END) AS flags FROM a""")
def sector_exposure_flags(spark, d):
    t = S.trades(spark, d).groupBy(F.col("entry_date").alias("date"), "ticker").agg(F.sum("position_size").alias("value"), F.avg("adjusted_score").alias("score"))
    return G.exposure_flags(t.join(S.sectors(spark, d).select("ticker", "sector"), "ticker"))


@query("market_overview", "G21", "date:d n_names:i mean_score:f bullish:i bearish:i", f"""
WITH {SIG} SELECT date, count(*) AS n_names, avg(score) AS mean_score, count(*) FILTER (signal = 'Bullish') AS bullish, count(*) FILTER (signal = 'Bearish') AS bearish FROM sig GROUP BY date""")
def market_overview(spark, d):
    return signals(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("n_names"), F.avg("score").alias("mean_score"),
                                                 F.count_if(F.col("signal") == "Bullish").alias("bullish"), F.count_if(F.col("signal") == "Bearish").alias("bearish"))


@query("market_top_names", "G21", K + "signal:s score:f rn:i", f"""
WITH {SIG} SELECT ticker, date, signal, score, row_number() OVER (PARTITION BY date, signal ORDER BY round(abs(score), 6) DESC, ticker) AS rn
FROM sig WHERE signal <> 'Neutral' AND score IS NOT NULL QUALIFY rn <= 5""")
def market_top_names(spark, d):
    s = signals(spark, d).where("signal <> 'Neutral' and score is not null").withColumn("_a", F.round(F.abs("score"), 6))
    rn = F.row_number().over(Window.partitionBy("date", "signal").orderBy(F.desc("_a"), "ticker"))
    return s.withColumn("rn", rn).where(F.col("rn") <= 5).select("ticker", "date", "signal", "score", "rn")


@query("signal_search", "G21", "s_name:s ticker:i date:d score:f signal:s", f"""
WITH {SIG}, l AS (SELECT ticker, max(date) AS date, arg_max(score, date) AS score, arg_max(signal, date) AS signal FROM sig GROUP BY ticker)
SELECT s_name, l.* FROM l JOIN supplier ON s_suppkey = ticker WHERE upper(s_name) LIKE '%SUPPLIER%4%'""")
def signal_search(spark, d):
    s = S.table(spark, d, "supplier").where(F.upper("s_name").like("%SUPPLIER%4%")).select("s_name", F.col("s_suppkey").alias("ticker"))
    last = signals(spark, d).groupBy("ticker").agg(F.max("date").alias("date"), F.max_by(F.struct("score", "signal"), "date").alias("_l"))
    return last.join(s, "ticker").select("s_name", "ticker", "date", "_l.score", "_l.signal")


@query("ticker_search", "G21", "s_name:s ticker:i", "SELECT s_name, s_suppkey AS ticker FROM supplier WHERE upper(s_name) LIKE '%SUPPLIER%4%' ORDER BY s_suppkey")
def ticker_search(spark, d):
    s = S.table(spark, d, "supplier").where(F.upper("s_name").like("%SUPPLIER%4%"))
    return s.select("s_name", F.col("s_suppkey").alias("ticker")).orderBy("ticker")


@query("recent_price_history", "G21", K + "close:f", f"""
WITH {PRICES}, c AS (SELECT DISTINCT date FROM prices ORDER BY date DESC LIMIT 30) SELECT ticker, date, close FROM prices WHERE date IN (SELECT date FROM c)""")
def recent_price_history(spark, d):
    return G.last_n_dates(bars(spark, d), 30)


@query("planned_open_orders", "G22", K + "side:s notional:f total:f", f"""
WITH {SCORED}, {TW}, {CARRY}, {RECON}, o AS (SELECT tw.ticker, tw.date, target_weight, abs(target_weight*100000) AS notional FROM tw JOIN acts ON tw.ticker = acts.ticker AND tw.date = acts.date AND action = 'open')
SELECT ticker, date, CASE WHEN target_weight > 0 THEN 'buy' ELSE 'sell' END AS side, notional, sum(notional) OVER (PARTITION BY date) AS total FROM o WHERE notional >= 100""")
def planned_open_orders(spark, d):
    t, c = book_and_current(spark, d)
    return G.planned_orders(t, G.reconcile(t, c), 100_000.0)


# --- joins -----------------------------------------------------------------------

BASKET = "bk AS (SELECT ticker FROM ad ORDER BY dollar_adv DESC, ticker LIMIT 20)"


@query("basket_correlation", "H6", "ticker_a:i ticker_b:i n:i cov:f corr:f", f"""
WITH {RET}, {ADV}, {BASKET}, b AS (SELECT * FROM ret WHERE r IS NOT NULL AND ticker IN (SELECT ticker FROM bk))
SELECT a.ticker AS ticker_a, c.ticker AS ticker_b, count(*) AS n, covar_samp(a.r, c.r) AS cov, corr(a.r, c.r) AS corr FROM b a JOIN b c ON a.date = c.date AND a.ticker < c.ticker GROUP BY 1, 2 HAVING count(*) > 1""")
def basket_correlation(spark, d):
    return joins.basket_moments(rets(spark, d), G.top_dollar_adv(bars(spark, d), 20))


@query("daily_holdings", "H7", K + "direction:i value:f n_lots:i weight:f", f"""
WITH {EQUITY}, h AS (SELECT t.ticker, CAST(g AS DATE) AS date, direction, sum(position_size) AS value, count(*) AS n_lots
 FROM trades t, unnest(generate_series(entry_date, exit_date, INTERVAL 1 DAY)) u(g) GROUP BY ALL)
SELECT h.*, value/equity AS weight FROM h LEFT JOIN equity USING (date)""")
def daily_holdings(spark, d):
    t = S.trades(spark, d)
    e = S.equity_curve(t).select("date", "equity")
    return TR.holdings(t).join(F.broadcast(e), "date", "left").withColumn("weight", F.col("value") / F.col("equity"))


@query("barrier_range_join", "H8", "ticker:i entry_date:d exit_date:d dir:i n_trades:i out_date:d out_price:f reason:s", f"""
WITH {PRICES}, {TRADES}, l AS (SELECT t.ticker, entry_date, exit_date, direction AS dir, count(*) AS n_trades, any_value(close) AS ep FROM trades t JOIN prices p ON t.ticker = p.ticker AND t.entry_date = p.date GROUP BY ALL),
j AS (SELECT l.*, p.date, p.low, p.high, p.close, ep*(1 - dir*0.03) AS sp, ep*(1 + dir*0.04) AS tp FROM l LEFT JOIN prices p ON p.ticker = l.ticker AND p.date > entry_date AND p.date <= exit_date),
e AS (SELECT *, CASE WHEN low <= sp AND sp <= high THEN 'stop_loss' WHEN low <= tp AND tp <= high THEN 'take_profit' END AS why FROM j),
g AS (SELECT ticker, entry_date, exit_date, dir, n_trades, min(date) FILTER (why IS NOT NULL) AS ed, arg_min(why, date) FILTER (why IS NOT NULL) AS why,
 arg_min(CASE why WHEN 'stop_loss' THEN sp ELSE tp END, date) FILTER (why IS NOT NULL) AS px, max(date) AS ld, arg_max(close, date) AS lc FROM e GROUP BY 1, 2, 3, 4, 5)
SELECT *, coalesce(ed, ld) AS out_date, coalesce(px, lc) AS out_price, coalesce(why, 'time') AS reason FROM g""")
def barrier_range_join(spark, d):
    p = bars(spark, d)
    t = S.trades(spark, d).select("ticker", "entry_date", "exit_date", F.col("direction").alias("dir"), "position_size")
    px = p.select("ticker", F.col("date").alias("entry_date"), F.col("close").alias("entry_price"))
    return TR.barrier_exit(t.join(px, ["ticker", "entry_date"]), p, 0.03, 0.04, ["ticker", "entry_date", "exit_date", "dir"])


@query("scenario_grid_cross", "H10", K + "cost_bps:f net:f", f"""
WITH {RET} SELECT ticker, date, cost_bps, r - cost_bps/10000 AS net FROM ret, (VALUES (0.0), (5.0), (20.0)) g(cost_bps) WHERE r IS NOT NULL""")
def scenario_grid_cross(spark, d):
    grid = F.explode(F.array(*[F.lit(c) for c in (0.0, 5.0, 20.0)]))
    return rets(spark, d).where("r is not null").withColumn("cost_bps", grid).withColumn("net", F.col("r") - F.col("cost_bps") / 10_000)


# --- trades ----------------------------------------------------------------------

BLOT = f"""b0 AS (SELECT *, {lagx('date', -1)} AS entry_date, {lagx('open', -1)} AS entry_price, {lagx('date', -6)} AS exit_date, {lagx('close', -6)} AS exit_price FROM sig),
bl AS (SELECT *, CASE WHEN signal = 'Bullish' THEN 1 ELSE -1 END AS dir, CASE WHEN signal = 'Bullish' THEN 1 ELSE -1 END*(exit_price - entry_price)/entry_price AS ret FROM b0
  WHERE signal <> 'Neutral' AND exit_price IS NOT NULL)""".replace("lag(date, -1)", "lead(date, 1)").replace("lag(open, -1)", "lead(open, 1)").replace("lag(date, -6)", "lead(date, 6)").replace("lag(close, -6)", "lead(close, 6)")


def blotter(spark, d):
    return TR.blotter(signals(spark, d))


@query("fixed_hold_blotter", "I1", K + "signal:s entry_date:d exit_date:d entry_price:f exit_price:f ret:f", f"WITH {SIG}, {BLOT} SELECT * FROM bl")
def fixed_hold_blotter(spark, d):
    return blotter(spark, d)


@query("slippage_fills", "I2", K + "entry_fill:f exit_fill:f net_ret:f", f"""
WITH {SIG}, {BLOT}, f AS (SELECT *, entry_price*(1 + dir*0.0005) AS entry_fill, exit_price*(1 - dir*0.0005) AS exit_fill FROM bl)
SELECT *, dir*(exit_fill - entry_fill)/entry_fill AS net_ret FROM f""")
def slippage_fills(spark, d):
    return TR.with_slippage(blotter(spark, d))


@query("trade_costs", "I3", K + "round_trip:f impact:f total_cost:f", f"""
WITH {SIG}, {BLOT}, av AS (SELECT ticker, date, {roll('avg', 'volume', 20, 1)} AS adv FROM prices),
c AS (SELECT bl.ticker, bl.date, 2*10000*5/10000.0 AS round_trip, coalesce(10000*10*sqrt(10000/entry_price/adv)/10000, 0) AS impact FROM bl JOIN av ON bl.ticker = av.ticker AND bl.date = av.date)
SELECT *, round_trip + impact AS total_cost FROM c""")
def trade_costs(spark, d):
    adv = bars(spark, d).withColumn("adv", W.roll_mean("volume", 20, 1)).select("ticker", "date", "adv")
    return TR.trade_costs(blotter(spark, d).join(adv, ["ticker", "date"]))


@query("stop_overlay", "I4", K + "exit_reason:s out_date:d out_price:f out_ret:f", f"""
WITH {SIG}, {BLOT}, j AS (SELECT bl.ticker, bl.date, dir, entry_price, bl.exit_date, exit_price, entry_price*(1 - dir*0.03) AS sp, entry_price*(1 + dir*0.05) AS tp, p.date AS pd, p.low, p.high
 FROM bl LEFT JOIN prices p ON p.ticker = bl.ticker AND p.date > bl.entry_date AND p.date <= bl.exit_date),
e AS (SELECT *, CASE WHEN low <= sp AND sp <= high THEN 'stop_loss' WHEN low <= tp AND tp <= high THEN 'take_profit' END AS why FROM j),
g AS (SELECT ticker, date, any_value(dir) AS dir, any_value(entry_price) AS ep, coalesce(arg_min(why, pd) FILTER (why IS NOT NULL), 'time') AS exit_reason,
 coalesce(min(pd) FILTER (why IS NOT NULL), any_value(exit_date)) AS out_date, coalesce(arg_min(CASE why WHEN 'stop_loss' THEN sp ELSE tp END, pd) FILTER (why IS NOT NULL), any_value(exit_price)) AS out_price FROM e GROUP BY ticker, date)
SELECT *, dir*(out_price - ep)/ep AS out_ret FROM g""")
def stop_overlay(spark, d):
    return TR.overlay_stops(TR.blotter(TR.bars_ahead(signals(spark, d), 5)), 5, 0.03, 0.05)


@query("daily_equity_book", "I5", "date:d pnl:f equity:f n_positions:i gross:f net:f borrow_cost:f", f"""
WITH {EQUITY}, h AS (SELECT CAST(g AS DATE) AS date, count(DISTINCT ticker) AS n, sum(position_size) AS gs, sum(position_size*direction) AS ns, sum(CASE WHEN direction < 0 THEN position_size ELSE 0 END) AS ss
 FROM trades, unnest(generate_series(entry_date, exit_date, INTERVAL 1 DAY)) u(g) GROUP BY 1)
SELECT date, pnl, equity, coalesce(n, 0) AS n_positions, coalesce(gs/equity, 0) AS gross, coalesce(ns/equity, 0) AS net, coalesce(ss*50/10000/252, 0) AS borrow_cost FROM equity LEFT JOIN h USING (date)""")
def daily_equity_book(spark, d):
    t = S.trades(spark, d)
    return TR.daily_book(t, S.equity_curve(t))


TKD = f"""sf AS (SELECT *, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date)/close - 1 AS fwd FROM sc),
ok AS (SELECT * FROM sf WHERE score IS NOT NULL AND fwd IS NOT NULL),
tp AS (SELECT * FROM ok WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) <= 5),
td0 AS (SELECT d.date, count(tp.ticker) AS n_held, avg(fwd) AS m FROM (SELECT DISTINCT date FROM ok) d LEFT JOIN tp ON d.date = tp.date GROUP BY d.date),
td AS (SELECT date, n_held, n_held >= 3 AS invested, CASE WHEN n_held >= 3 THEN m ELSE 0 END AS ret FROM td0)"""


def scored_fwd(spark, d):
    return scored(spark, d).withColumn("fwd", W.safe_div(W.lead("close", 5), "close") - 1)


@query("top_k_daily_strategy", "I6", "date:d n_held:i invested:b ret:f", f"WITH {SCORED}, {TKD} SELECT * FROM td")
def top_k_daily_strategy(spark, d):
    return TR.top_k_daily(scored_fwd(spark, d), "score", "fwd", 5, 3)


@query("trade_diagnostics", "I7", "avg_long:f avg_short:f cost_share:f short_frac:f long_pnl:f short_pnl:f costs:f", f"""
WITH {TRADES} SELECT avg(pnl) FILTER (direction > 0) AS avg_long, avg(pnl) FILTER (direction < 0) AS avg_short, avg(position_size*0.001/(abs(pnl) + 1e-8)) AS cost_share,
 avg(CASE WHEN direction < 0 THEN 1.0 ELSE 0 END) AS short_frac, sum(CASE WHEN direction > 0 THEN pnl ELSE 0 END) AS long_pnl, sum(CASE WHEN direction < 0 THEN pnl ELSE 0 END) AS short_pnl, sum(position_size*0.001) AS costs FROM trades""")
def trade_diagnostics(spark, d):
    return TR.diagnostics(S.trades(spark, d))


@query("pnl_decomposition", "I7", "date:d long_pnl:f short_pnl:f cost_drag:f", f"""
WITH {TRADES}, a AS (SELECT exit_date AS date, sum(CASE WHEN direction > 0 THEN pnl ELSE 0 END) AS l, sum(CASE WHEN direction < 0 THEN pnl ELSE 0 END) AS s, sum(-position_size*0.001) AS c FROM trades GROUP BY 1)
SELECT date, sum(l) OVER w AS long_pnl, sum(s) OVER w AS short_pnl, sum(c) OVER w AS cost_drag FROM a WINDOW w AS (ORDER BY date)""")
def pnl_decomposition(spark, d):
    return TR.pnl_decomposition(S.trades(spark, d))


@query("no_trade_band", "I8", K + "diff:f outside:b total_drift:f rebalance:b", f"""
WITH {SCORED}, {TW}, {CARRY}, j AS (SELECT tw.ticker, tw.date, round(abs(abs(target_weight) - abs(current_weight)), 9) AS diff FROM tw JOIN cb ON tw.ticker = cb.ticker AND tw.date = cb.date),
t AS (SELECT *, diff > 0.015 AS outside, sum(CASE WHEN diff > 0.015 THEN diff ELSE 0 END) OVER (PARTITION BY date) AS total_drift FROM j)
SELECT *, total_drift > 0.05 AS rebalance FROM t""")
def no_trade_band(spark, d):
    return TR.no_trade_band(*book_and_current(spark, d))
