"""Scans, sinks, cleaning and alignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.functions import windows as W
from barweave.operators import joins
from barweave.plans.catalog import query
from barweave.plans.sqlbase import PRICES, RET, SECTORS
from barweave.session import run_dir
from barweave.sources import bars as B
from barweave.sources import files
from barweave.sources import tables as S

OHLCV = "ticker:i date:d open:f high:f low:f close:f volume:f"


@query("load_panel", "A1", OHLCV, f"WITH {PRICES} SELECT * FROM prices")
def load_panel(spark, d):
    return S.panel(spark, d)


@query("slice_range", "A2", OHLCV, f"WITH {PRICES} SELECT * FROM prices WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'")
def slice_range(spark, d):
    return B.slice_range(S.panel(spark, d), "1998-01-01", "1999-12-31")


@query("range_coverage", "A2", "ticker:i first:d last:d has_overlap:b covers:b", f"""
WITH {PRICES} SELECT ticker, min(date) AS first, max(date) AS last,
 min(date) <= DATE '2001-11-20' AND max(date) >= DATE '1995-01-05' AS has_overlap,
 min(date) - DATE '1995-01-05' <= 5 AND DATE '2001-11-20' - max(date) <= 5 AS covers FROM prices GROUP BY ticker""")
def range_coverage(spark, d):
    return B.range_coverage(S.panel(spark, d), "1995-01-05", "2001-11-20")


@query("merge_history", "A3", OHLCV + " src:i", """
WITH l AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, round(100*(1 - l_discount + l_tax), 2) AS p, l_quantity AS q,
  row(l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS k,
  CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS src FROM lineitem),
b AS (SELECT ticker, date, src, arg_min(p,k) AS open, max(p) AS high, min(p) AS low, arg_max(p,k) AS close, sum(q) AS volume
  FROM l GROUP BY ticker, date, src)
SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY src DESC) = 1""")
def merge_history(spark, d):
    prints = S.lines(spark, d)
    old = S.bars_from_prints(prints.where("l_linestatus = 'F'"))
    new = S.bars_from_prints(prints.where("l_linestatus = 'O'"))
    return B.merge_history(old, new)


@query("upsert_history", "A3", OHLCV + " src:i", """
WITH l AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, round(100*(1 - l_discount + l_tax), 2) AS p, l_quantity AS q,
  row(l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS k,
  CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS src FROM lineitem),
b AS (SELECT ticker, date, src, arg_min(p,k) AS open, max(p) AS high, min(p) AS low, arg_max(p,k) AS close, sum(q) AS volume
  FROM l GROUP BY ticker, date, src)
SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY src DESC) = 1""")
def upsert_history(spark, d):
    """The same extension as ``merge_history``, kept as a table by year; loads touch only their years."""
    prints, path = S.lines(spark, d), run_dir(spark, "history")
    for src, status in ((0, "F"), (1, "O"), (1, "O")):
        new = S.bars_from_prints(prints.where(f"l_linestatus = '{status}'")).withColumns({"src": F.lit(src), "year": F.year("date")})
        files.upsert(new, path, ["ticker", "date", "year"], ["src"], "year")
    return spark.read.parquet(path)


@query("csv_table_scan", "A4", "ticker:i sector:s", f"""
WITH {SECTORS} SELECT ticker, upper(trim(sector)) AS sector FROM sectors""")
def csv_table_scan(spark, d):
    path = run_dir(spark, "csv")
    raw = S.sectors(spark, d).select(F.col("ticker").alias("Symbol"), F.concat(F.lit(" "), F.lower("sector"), F.lit(" ")).alias("Sector"))
    files.write_report(raw, path, "csv")
    return files.read_keyed_csv(spark, path, {"sector": "string"})


@query("report_sinks", "A5", "format:s n_rows:i total:f", """
WITH p AS (SELECT l_suppkey, sum(l_extendedprice*(l_discount - l_tax)) AS pnl FROM lineitem GROUP BY 1)
SELECT f AS format, count(*) AS n_rows, round(sum(pnl), 2) AS total FROM p, (VALUES ('csv'), ('json'), ('parquet')) v(f) GROUP BY f""")
def report_sinks(spark, d):
    rep = S.trades(spark, d).groupBy("ticker").agg(F.sum("pnl").alias("pnl"))
    out = []
    for fmt in ("csv", "json", "parquet"):
        path = run_dir(spark, fmt)
        files.write_report(rep, path, fmt)
        back = files.read_report(spark, path, fmt, rep.schema)
        out.append(back.agg(F.lit(fmt).alias("format"), F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("pnl"), 2).alias("total")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("append_dedupe", "A6", "ticker:i date:d score:f load_seq:i", """
SELECT user_id AS ticker, CAST(ts AS DATE) AS date, value AS score, event_id AS load_seq FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id DESC) = 1""")
def append_dedupe(spark, d):
    t = S.ticks(spark, d).select("ticker", F.to_date("ts").alias("date"), "score", F.col("event_id").alias("load_seq"), "side")
    history, batch = t.where("side <> 'purchase'").drop("side"), t.where("side = 'purchase'").drop("side")
    return B.append_dedupe(history, batch, ["ticker", "date"])


@query("append_dedupe_sink", "A6", "ticker:i date:d score:f load_seq:i", """
SELECT user_id AS ticker, CAST(ts AS DATE) AS date, value AS score, event_id AS load_seq FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id DESC) = 1""")
def append_dedupe_sink(spark, d):
    """Four loads, appended one after the other to a table by date; the last load of a key stays."""
    t = S.ticks(spark, d).select("ticker", F.to_date("ts").alias("date"), "score", F.col("event_id").alias("load_seq"), "side")
    path = run_dir(spark, "signals")
    for side in ("purchase", "click", "error", "view"):
        files.upsert(t.where(F.col("side") == side).drop("side"), path, ["ticker", "date"], ["load_seq"], "date")
    files.upsert(t.where(~F.col("side").isin("purchase", "click", "error", "view") | F.col("side").isNull()).drop("side"), path, ["ticker", "date"], ["load_seq"], "date")
    return spark.read.parquet(path)


@query("signal_payload_explode", "A7", "date:d ticker:i side:s score:f", """
SELECT CAST(ts AS DATE) AS date, user_id AS ticker, arg_max(event_type, event_id) AS side, arg_max(value, event_id) AS score
FROM events GROUP BY CAST(ts AS DATE), user_id""")
def signal_payload_explode(spark, d):
    t = S.ticks(spark, d)
    latest = t.groupBy(F.to_date("ts").alias("date"), "ticker").agg(
        F.max_by("side", "event_id").alias("side"), F.max_by("score", "event_id").alias("score")
    )
    return files.explode_payload(files.build_payload(latest, ["side", "score"]), {"side": "string", "score": "double"})


@query("jsonl_log_scan", "A8", "run_date:d ticker:i side:s qty:f", """
WITH t AS (SELECT CAST(ts AS DATE) AS run_date, user_id AS ticker, arg_max(event_type, event_id) AS side, sum(value) AS qty, max(ts) AS ts FROM events GROUP BY 1, 2)
SELECT run_date, ticker, side, qty FROM t QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) = 1""")
def jsonl_log_scan(spark, d):
    path = run_dir(spark, "jsonl")
    t = S.ticks(spark, d).groupBy(F.to_date("ts").alias("run_date"), "ticker").agg(
        F.max_by("side", "event_id").alias("side"), F.sum("score").alias("qty"), F.max("ts").alias("ts")
    )
    files.write_report(t, path, "json")
    log = spark.read.schema(t.schema).json(path)
    return files.latest_entries(log, "ticker", "ts")


@query("jsonl_log_quarantine", "A8", "ticker:i entries:i damaged:i qty:f", """
WITH g AS (SELECT user_id AS ticker, event_id % 7 = 0 AS bad, value FROM events)
SELECT ticker, count(*) FILTER (NOT bad) AS entries, count(*) FILTER (bad) AS damaged, sum(value) FILTER (NOT bad) AS qty FROM g GROUP BY ticker""")
def jsonl_log_quarantine(spark, d):
    """A log in which each seventh line was cut off: good entries, and the damaged lines by the ticker they still name."""
    path = run_dir(spark, "jsonl")
    line = F.to_json(F.struct("ticker", "event_id", "score"))
    cut = F.when(F.col("event_id") % 7 == 0, F.expr("substring(_l, 1, length(_l) - 3)")).otherwise(F.col("_l"))
    S.ticks(spark, d).select("event_id", line.alias("_l")).select(cut.alias("value")).write.text(path)
    good, broken = files.read_log(spark, path, T.StructType([T.StructField("ticker", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("score", T.DoubleType())]))
    named = broken.select(F.regexp_extract("line", r'"ticker":(\d+)', 1).try_cast("long").alias("ticker")).groupBy("ticker").agg(F.count(F.lit(1)).alias("damaged"))
    return good.groupBy("ticker").agg(F.count(F.lit(1)).alias("entries"), F.sum("score").alias("qty")).join(named, "ticker", "full").fillna(0, subset=["entries", "damaged"])


@query("coverage_freshness", "A9", "last_bar:d required:d fresh:b days_behind:i n_bars:i", f"""
WITH {PRICES} SELECT max(date) AS last_bar, DATE '2002-01-04' AS required, max(date) >= DATE '2002-01-04' AS fresh,
 greatest(DATE '2002-01-04' - max(date), 0) AS days_behind, count(*) AS n_bars FROM prices""")
def coverage_freshness(spark, d):
    return B.freshness(S.panel(spark, d), "2002-01-07")


@query("universe_snapshot", "A10", "ticker:i first:d last:d n_bars:i pre_bars:i", f"""
WITH {PRICES}, pre AS (SELECT ticker, count(*) AS pre_bars, min(date) AS f FROM prices WHERE date < DATE '1998-06-01' GROUP BY ticker)
SELECT ticker, min(date) AS first, max(date) AS last, count(*) AS n_bars, any_value(pre_bars) AS pre_bars
FROM prices JOIN pre USING (ticker) WHERE pre_bars >= 210 AND DATE '1998-06-01' - f >= 252 GROUP BY ticker""")
def universe_snapshot(spark, d):
    p = S.panel(spark, d)
    return B.universe_snapshot(p).join(B.with_enough_history(p, "1998-06-01"), "ticker")


RAW_BARS = """
rawbars AS (SELECT l_suppkey AS ticker, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS date,
  100*(1 - l_discount + l_tax) AS close, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity END AS volume,
  CAST(l_orderkey AS BIGINT) AS arrival FROM lineitem)"""


def raw_bars(spark, d):
    """Line items as an untidy text feed: odd header case, text numbers, bad cells."""
    li = S.table(spark, d, "lineitem")
    bad_date = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    return li.select(
        F.col("l_suppkey").alias(" Ticker"),
        bad_date.alias("Date "),
        (100 * (1 - F.col("l_discount") + F.col("l_tax"))).cast("string").alias("CLOSE"),
        F.when(F.col("l_returnflag") == "N", "--").otherwise(F.col("l_quantity").cast("string")).alias("Volume"),
        F.col("l_orderkey").alias("Arrival"),
    )


@query("basic_clean", "B1", "ticker:i date:d close:f volume:f arrival:i", f"WITH {RAW_BARS} SELECT * FROM rawbars WHERE date IS NOT NULL")
def basic_clean(spark, d):
    return B.basic_clean(raw_bars(spark, d))


@query("remove_duplicates", "B2", "ticker:i date:d close:f volume:f arrival:i", f"""
WITH {RAW_BARS} SELECT * FROM (SELECT DISTINCT * FROM rawbars WHERE date IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY arrival DESC, close DESC, volume DESC NULLS LAST) = 1""")
def remove_duplicates(spark, d):
    return B.remove_duplicates(B.basic_clean(raw_bars(spark, d)), "arrival")


@query("validate_ohlcv", "B3", "n_rows:i bad_date:i bad_open:i bad_high:i bad_low:i bad_close:i bad_volume:i crossed:i", f"""
WITH {PRICES}, t AS (SELECT date, open - 100 AS open, high, low, close, volume - 2 AS volume FROM prices)
SELECT count(*) AS n_rows, count(*) FILTER (date IS NULL) AS bad_date, count(*) FILTER (NOT open > 0) AS bad_open,
 count(*) FILTER (NOT high > 0) AS bad_high, count(*) FILTER (NOT low > 0) AS bad_low, count(*) FILTER (NOT close > 0) AS bad_close,
 count(*) FILTER (NOT volume >= 0) AS bad_volume, count(*) FILTER (high < low) AS crossed FROM t""")
def validate_ohlcv(spark, d):
    p = S.panel(spark, d)
    return B.validate_ohlcv(p.withColumn("open", F.col("open") - 100).withColumn("volume", F.col("volume") - 2))


@query("process_market_data", "B4", "ticker:i date:d Close:f Volume:f", f"""
WITH {RAW_BARS}, u AS (SELECT DISTINCT * FROM rawbars WHERE date IS NOT NULL),
l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY arrival DESC, close DESC, volume DESC NULLS LAST) = 1)
SELECT ticker, date, close AS "Close", volume AS "Volume" FROM l WHERE close > 0 AND volume >= 0""")
def process_market_data(spark, d):
    return B.process_market_data(raw_bars(spark, d))


@query("delisting_tag", "B5", "ticker:i date:d close:f delisted_date:d", f"""
WITH {PRICES}, t AS (SELECT *, max(date) OVER (PARTITION BY ticker) AS last FROM prices)
SELECT ticker, date, close, CASE WHEN last < DATE '2001-11-25' THEN last END AS delisted_date FROM t""")
def delisting_tag(spark, d):
    return B.tag_delisted(S.panel(spark, d), "2001-11-25")


GRID = PRICES + """,
cal AS (SELECT DISTINCT date FROM prices), tk AS (SELECT DISTINCT ticker FROM prices),
grid AS (SELECT tk.ticker, cal.date, p.close, p.volume FROM tk CROSS JOIN cal LEFT JOIN prices p ON p.ticker = tk.ticker AND p.date = cal.date),
filled AS (SELECT ticker, date, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS f,
  first_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b, close FROM grid)"""


@query("calendar_align_ffill", "B6", "ticker:i date:d close:f filled:b", f"""
WITH {GRID} SELECT ticker, date, f AS close, close IS NULL AS filled FROM filled WHERE f IS NOT NULL""")
def calendar_align_ffill(spark, d):
    return B.align_ffill(S.panel(spark, d), ["close"])


@query("calendar_align_bfill", "B6", "ticker:i date:d close:f filled:b", f"""
WITH {GRID} SELECT ticker, date, coalesce(f, b) AS close, close IS NULL AS filled FROM filled""")
def calendar_align_bfill(spark, d):
    return B.align_ffill(S.panel(spark, d), ["close"], backfill=True)


@query("continuous_contract", "B7", "nation:s date:d contract:i close:f volume:f", f"""
WITH {PRICES}, {SECTORS}, v AS (SELECT p.*, nation, sum(volume) OVER (PARTITION BY p.ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v
  FROM prices p JOIN sectors s ON s.ticker = p.ticker)
SELECT nation, date, ticker AS contract, close, volume FROM v
QUALIFY row_number() OVER (PARTITION BY nation, date ORDER BY v DESC, ticker) = 1""")
def continuous_contract(spark, d):
    p = S.panel(spark, d).join(S.sectors(spark, d), "ticker").withColumnRenamed("ticker", "contract_id")
    return B.continuous_contract(p, "nation", "contract_id")


TICKDAY = """
sig AS (SELECT user_id AS ticker, CAST(ts AS DATE) - 9000 AS date, max(value) AS score FROM events GROUP BY 1, 2)"""


def signal_days(spark, d):
    """Event scores per user and day, moved back onto the bar calendar."""
    return S.ticks(spark, d).groupBy("ticker", F.date_sub(F.to_date("ts"), 9000).alias("date")).agg(F.max("score").alias("score"))


@query("asof_lookup", "B8", "ticker:i date:d score:f asof_date:d close:f", f"""
WITH {PRICES}, {TICKDAY} SELECT s.ticker, s.date, s.score, p.date AS asof_date, p.close
FROM sig s ASOF LEFT JOIN prices p ON s.ticker = p.ticker AND s.date >= p.date""")
def asof_lookup(spark, d):
    return B.asof_lookup(signal_days(spark, d), S.panel(spark, d), ["close"])


@query("aligned_return_matrix", "B9", "ticker:s date:d r:f", f"""
WITH {RET}, {SECTORS}, s AS (SELECT sector AS ticker, date, avg(r) AS r FROM ret JOIN sectors USING (ticker) GROUP BY 1, 2),
n AS (SELECT count(DISTINCT ticker) AS n FROM s WHERE r IS NOT NULL),
d AS (SELECT date FROM s, n WHERE r IS NOT NULL GROUP BY date, n HAVING count(*) = n ORDER BY date DESC LIMIT 252)
SELECT ticker, date, r FROM s WHERE date IN (SELECT date FROM d)""")
def aligned_return_matrix(spark, d):
    return B.aligned_returns(sector_returns(spark, d), 252)


def sector_returns(spark, d):
    r = S.with_returns(S.panel(spark, d)).join(S.sectors(spark, d), "ticker")
    return r.groupBy(F.col("sector").alias("ticker"), "date").agg(F.avg("r").alias("r"))


@query("price_column_preference", "B10", "ticker:i date:d price:f", f"""
WITH {PRICES} SELECT ticker, date, coalesce(CASE WHEN volume > 25 THEN close * 0.98 END, close) AS price FROM prices""")
def price_column_preference(spark, d):
    adj = F.when(F.col("volume") > 25, F.col("close") * 0.98)
    return S.panel(spark, d).withColumn("price", B.price_column(adj, F.col("close")))


@query("latest_prior_snapshot", "B11", "ticker:i date:d close:f source:s", f"""
WITH {PRICES}, a AS (SELECT * FROM prices WHERE volume > 20), b AS (SELECT * FROM prices),
x AS (SELECT ticker, date, close, 'primary' AS source FROM a WHERE date = (SELECT max(date) FROM a WHERE date < DATE '1999-06-15')),
y AS (SELECT ticker, date, close, 'fallback' AS source FROM b WHERE date = (SELECT max(date) FROM b WHERE date < DATE '1999-06-15')
  AND ticker NOT IN (SELECT ticker FROM x))
SELECT * FROM x UNION ALL SELECT * FROM y""")
def latest_prior_snapshot(spark, d):
    p = S.panel(spark, d)
    return B.latest_snapshot(p.where("volume > 20"), "1999-06-15", p)


@query("asof_forward_rows", "H5", "ticker:i date:d score:f asof_date:d close:f close_fwd:f", f"""
WITH {PRICES}, f AS (SELECT *, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) AS close_fwd FROM prices), {TICKDAY}
SELECT s.ticker, s.date, s.score, p.date AS asof_date, p.close, p.close_fwd FROM sig s ASOF LEFT JOIN f p ON s.ticker = p.ticker AND s.date >= p.date""")
def asof_forward_rows(spark, d):
    p = S.panel(spark, d).withColumn("close_fwd", W.lead("close", 5))
    return B.asof_lookup(signal_days(spark, d), p, ["close", "close_fwd"])


@query("equi_join_fill", "H2", "ticker:i date:d close:f score:f", f"""
WITH {PRICES}, {TICKDAY} SELECT p.ticker, p.date, close, coalesce(score, 0) AS score FROM prices p LEFT JOIN sig s ON p.ticker = s.ticker AND p.date = s.date""")
def equi_join_fill(spark, d):
    return joins.left_fill(S.panel(spark, d), signal_days(spark, d), ["ticker", "date"], {"score": 0.0})


@query("broadcast_dimension", "H4", "ticker:i date:d close:f sector:s", f"""
WITH {PRICES}, {SECTORS} SELECT p.ticker, p.date, close, coalesce(CASE WHEN sector <> 'ASIA' THEN sector END, 'Other') AS sector
FROM prices p LEFT JOIN sectors s ON p.ticker = s.ticker""")
def broadcast_dimension(spark, d):
    dim = S.sectors(spark, d).where("sector <> 'ASIA'")
    return joins.attach_dimension(S.panel(spark, d), dim, "ticker", {"sector": "Other"})


@query("semi_anti_filters", "H9", "ticker:i date:d close:f", f"""
WITH {PRICES}, {SECTORS} SELECT ticker, date, close FROM prices WHERE ticker IN (SELECT user_id FROM events WHERE event_type = 'purchase')
 AND ticker NOT IN (SELECT ticker FROM sectors WHERE sector = 'EUROPE')""")
def semi_anti_filters(spark, d):
    keep = S.ticks(spark, d).where("side = 'purchase'")
    drop = S.sectors(spark, d).where("sector = 'EUROPE'")
    return joins.exclude(joins.restrict(S.panel(spark, d), keep, "ticker"), drop, "ticker")
