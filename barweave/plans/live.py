"""Streaming queries.  Each reads the event files as a stream to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.plans.catalog import query
from barweave.sources import tables as S
from barweave.streaming import streams as Q


def ticks(spark, d):
    return Q.event_stream(spark, d)


@query("stream_callback_totals", "Q1", "side:s n:i total:f", "SELECT event_type AS side, count(*) AS n, sum(value) AS total FROM events GROUP BY event_type")
def stream_callback_totals(spark, d):
    return Q.callback_totals(ticks(spark, d))


@query("stream_latest_signal", "Q2", "ticker:i n_rows:i last_score:f mean_score:f signal:s", """
WITH r AS (SELECT user_id AS ticker, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n_rows FROM events),
a AS (SELECT ticker, any_value(n_rows) AS n_rows, max(value) FILTER (rn = 1) AS last_score, avg(value) AS mean_score FROM r WHERE rn <= 20 AND n_rows >= 50 GROUP BY ticker)
SELECT *, CASE WHEN last_score > mean_score THEN 'Bullish' WHEN last_score < mean_score THEN 'Bearish' ELSE 'Neutral' END AS signal FROM a""")
def stream_latest_signal(spark, d):
    return Q.latest_signal(ticks(spark, d))


@query("stream_recent_snapshot", "Q3", "ticker:i event_id:i score:f rn:i", """
SELECT user_id AS ticker, event_id, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events QUALIFY rn <= 5""")
def stream_recent_snapshot(spark, d):
    return Q.recent_snapshot(ticks(spark, d))


@query("stream_poll_latest", "Q4", "ticker:i score:f side:s n:i", "SELECT user_id AS ticker, arg_max(value, ts) AS score, arg_max(event_type, ts) AS side, count(*) AS n FROM events GROUP BY user_id")
def stream_poll_latest(spark, d):
    return Q.latest_per_key(ticks(spark, d))


@query("stream_intent_dedupe", "Q5", "as_of:d ticker:i side:s", "SELECT DISTINCT CAST(ts AS DATE) AS as_of, user_id AS ticker, event_type AS side FROM events")
def stream_intent_dedupe(spark, d):
    return Q.idempotent_intents(ticks(spark, d))


@query("stream_tick_bars", "Q6", "start_us:i ticker:i open:f high:f low:f close:f ticks:i", """
SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start_us, user_id AS ticker, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS ticks FROM events GROUP BY 1, 2""")
def stream_tick_bars(spark, d):
    return Q.tick_bars(ticks(spark, d)).withColumn("start_us", F.unix_micros("start"))


@query("stream_sliding_stats", "Q7", "start_us:i ticker:i mean:f vol:f n:i alert:b", """
WITH w AS (SELECT time_bucket(INTERVAL 3 HOUR, ts) - to_hours(CAST(3*i AS INTEGER)) AS start, user_id AS ticker, value FROM events, generate_series(0, 1) g(i))
SELECT epoch_us(start) AS start_us, ticker, avg(value) AS mean, stddev_samp(value) AS vol, count(*) AS n, avg(value) > 20 AS alert FROM w GROUP BY start, ticker""")
def stream_sliding_stats(spark, d):
    return Q.sliding_stats(ticks(spark, d)).withColumn("start_us", F.unix_micros("start"))


@query("stream_sessions", "Q7", "ticker:i start_us:i finish_us:i n:i total:f", """
WITH g AS (SELECT user_id AS ticker, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS nw FROM events),
s AS (SELECT *, sum(nw) OVER (PARTITION BY ticker ORDER BY ts) AS sid FROM g),
a AS (SELECT ticker, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS finish, count(*) AS n, sum(value) AS total FROM s GROUP BY ticker, sid)
SELECT ticker, epoch_us(start) AS start_us, epoch_us(finish) AS finish_us, n, total FROM a WHERE finish <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark, d):
    return Q.activity_sessions(ticks(spark, d)).withColumns({"start_us": F.unix_micros("start"), "finish_us": F.unix_micros("finish")})


@query("stream_static_enrichment", "Q8", "event_id:i ticker:i score:f sector:s", """
SELECT event_id, user_id AS ticker, value AS score, coalesce(r_name, 'Other') AS sector FROM events LEFT JOIN supplier ON s_suppkey = user_id LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def stream_static_enrichment(spark, d):
    return Q.enrich(ticks(spark, d), S.sectors(spark, d).select("ticker", "sector"), "ticker")


@query("stream_fill_match", "Q8", "order_id:i fill_id:i ticker:i signal_price:f fill_price:f", """
WITH e AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
SELECT o.event_id AS order_id, f.event_id AS fill_id, f.user_id AS ticker, o.value AS signal_price, f.value AS fill_price FROM e o JOIN e f ON o.user_id = f.user_id AND o.k = f.k
 AND o.event_type = 'click' AND f.event_type = 'purchase' AND f.ts >= o.ts AND f.ts <= o.ts + INTERVAL 3 DAY""")
def stream_fill_match(spark, d):
    def side(kind):
        t = ticks(spark, d).withColumn("order_key", F.get_json_object("props", "$.k"))
        return t.where(F.col("side") == kind)

    return Q.match_fills(side("click"), side("purchase"))


@query("stream_order_status", "Q8", "order_id:i ticker:i signal_price:f fill_id:i fill_price:f fills:i status:s", """
WITH e AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events),
w AS (SELECT least(max(ts) FILTER (event_type = 'click'), max(ts) FILTER (event_type = 'purchase')) - INTERVAL 1 HOUR AS mark FROM events),
m AS (SELECT o.event_id AS order_id, any_value(o.user_id) AS ticker, any_value(o.value) AS signal_price, any_value(o.ts) AS ts, arg_min(f.event_id, (f.ts, f.event_id)) AS fill_id, arg_min(f.value, (f.ts, f.event_id)) AS fill_price, count(f.event_id) AS fills
  FROM e o LEFT JOIN e f ON o.user_id = f.user_id AND o.k = f.k AND f.event_type = 'purchase' AND f.ts >= o.ts AND f.ts <= o.ts + INTERVAL 3 DAY WHERE o.event_type = 'click' GROUP BY o.event_id)
SELECT order_id, ticker, signal_price, fill_id, fill_price, fills, CASE WHEN fills > 0 THEN 'filled' WHEN ts + INTERVAL 3 DAY < mark THEN 'expired' ELSE 'pending' END AS status FROM m, w""")
def stream_order_status(spark, d):
    def side(kind):
        t = ticks(spark, d).withColumn("order_key", F.get_json_object("props", "$.k"))
        return t.where(F.col("side") == kind)

    return Q.order_status(side("click"), side("purchase"))


@query("stream_kill_switch", "Q9", "ticker:i hour_us:i equity:f peak:f drawdown:f halted:i", """
WITH h AS (SELECT user_id AS ticker, date_trunc('hour', ts) AS hour, sum(CASE event_type WHEN 'purchase' THEN value WHEN 'error' THEN -value ELSE 0 END) AS pnl FROM events GROUP BY 1, 2),
e AS (SELECT *, round(1000 + sum(pnl) OVER (PARTITION BY ticker ORDER BY hour), 6) AS equity FROM h), p AS (SELECT *, greatest(1000, max(equity) OVER (PARTITION BY ticker ORDER BY hour)) AS peak FROM e),
d AS (SELECT *, (peak - equity)/peak AS drawdown FROM p)
SELECT ticker, epoch_us(hour) AS hour_us, equity, peak, drawdown, coalesce(last_value(CASE WHEN drawdown > 0.10 THEN 1 WHEN drawdown < 0.05 THEN 0 END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY hour), 0) AS halted FROM d""")
def stream_kill_switch(spark, d):
    return Q.kill_switch(ticks(spark, d)).withColumn("hour_us", F.unix_micros("hour"))
