"""Shared WITH-clause pieces of the SQL twins (used for checking only)."""

PRICES = """
raw AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date,
  round(100*(1 - l_discount + l_tax), 2) AS p, l_quantity AS q, l_linestatus,
  row(l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS k FROM lineitem),
prices AS (SELECT ticker, date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low,
  arg_max(p, k) AS close, sum(q) AS volume FROM raw GROUP BY ticker, date)"""

RET = PRICES + """,
ret AS (SELECT *, close/lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM prices)"""

MARKET = RET + """,
market AS (SELECT 1 AS mkt, date, avg(r) AS m, count(r) AS n_names FROM ret GROUP BY date HAVING count(r) > 0)"""

SECTORS = """
sectors AS (SELECT s_suppkey AS ticker, r_name AS sector, n_name AS nation FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

TRADES = """
trades AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS ticker,
  CAST(l_shipdate AS DATE) AS entry_date, CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INTEGER) AS exit_date,
  CAST(l_shipdate AS DATE) - 1 AS signal_date, l_extendedprice AS position_size,
  l_discount - l_tax AS ret, l_extendedprice*(l_discount - l_tax) AS pnl,
  CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS direction, (l_quantity - 25.5)/25 AS adjusted_score,
  CASE WHEN (l_quantity - 25.5)/25 > 0 THEN 'Bullish' ELSE 'Bearish' END AS signal,
  l_linenumber AS holding_days,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Crisis' WHEN '2-HIGH' THEN 'Bear' WHEN '5-LOW' THEN 'Bull'
    ELSE 'Sideways' END AS regime
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

EQUITY = TRADES + """,
daily AS (SELECT exit_date AS date, round(sum(pnl), 4) AS pnl FROM trades GROUP BY exit_date),
equity AS (SELECT date, pnl, round(100000.0 + sum(pnl) OVER (ORDER BY date), 4) AS equity FROM daily)"""

NEWS = """
lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
news AS (SELECT d.doc_id, d.doc_id % 100 AS ticker, DATE '2024-01-01' + CAST(d.doc_id % 30 AS INTEGER) AS date,
  d.text AS headline, d.text, d.lang, d.source, d.n_chars,
  CASE WHEN quality = 1 THEN 'positive' WHEN toxic = 1 THEN 'negative' ELSE 'neutral' END AS label
  FROM documents d LEFT JOIN lab ON d.doc_id = lab.doc_id)"""


def win(n: int, key: str = "ticker") -> str:
    return f"(PARTITION BY {key} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, m: int | None = None, key: str = "ticker") -> str:
    """Rolling aggregate ``agg`` (a format string or function name) with min_periods."""
    m = n if m is None else m
    call = agg.format(x) if "{}" in agg else f"{agg}({x})"
    v = f"{call} OVER {win(n, key)}"
    return v if m <= 1 else f"CASE WHEN count({x}) OVER {win(n, key)} >= {m} THEN {v} END"


def zs(x: str, n: int, m: int, ddof: int = 1, key: str = "ticker") -> str:
    sd = "stddev_samp" if ddof else "stddev_pop"
    return f"(({x}) - {roll('avg', x, n, m, key)}) / nullif({roll(sd, x, n, m, key)}, 0)"


def lagx(x: str, k: int = 1, key: str = "ticker") -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY {key} ORDER BY date)"
