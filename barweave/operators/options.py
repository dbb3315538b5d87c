"""Option value and lognormal band columns, with the SQL text of the same formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.functions import windows as W
from barweave.functions.mathx import INV_SQRT_2PI, NORMAL_B, NORMAL_P, Z, norm_cdf, norm_pdf


def with_d_terms(df: DataFrame, s: Column, k: Column, t: float, r: float, vol: Column, tag: str = "") -> DataFrame:
    """Columns both normal values of the pricing formula rest on, each computed once: ``_d1``, then ``_c1``,
    ``_c2`` (distribution at d1 and d2) and ``_n1`` (density at d1), with ``tag`` behind the names."""
    root = t**0.5
    d = df.withColumn(f"_d1{tag}", (F.ln(s / k) + (r + 0.5 * vol * vol) * t) / (vol * root))
    d = d.withColumn(f"_d2{tag}", F.col(f"_d1{tag}") - vol * root)
    return d.withColumns({f"_c1{tag}": norm_cdf(F.col(f"_d1{tag}")), f"_c2{tag}": norm_cdf(F.col(f"_d2{tag}")), f"_n1{tag}": norm_pdf(F.col(f"_d1{tag}"))})


def price(s: Column, k: Column, t: float, r: float, vol: Column, kind: str = "call", tag: str = "") -> Column:
    """European option value over the columns of ``with_d_terms``; 0 without time or volatility."""
    c1, c2, df = F.col(f"_c1{tag}"), F.col(f"_c2{tag}"), F.exp(F.lit(-r * t))
    v = s * c1 - k * df * c2 if kind == "call" else k * df * (1 - c2) - s * (1 - c1)
    return F.when((vol > 0) & F.lit(t > 0), v).otherwise(0.0)


def greeks(s: Column, k: Column, t: float, r: float, vol: Column, kind: str = "call", tag: str = "") -> dict[str, Column]:
    """Delta, gamma, theta per day, vega and rho per 1 %, over the columns of ``with_d_terms``."""
    c1, c2, n1 = (F.col(f"_{x}{tag}") for x in ("c1", "c2", "n1"))
    root, df = t**0.5, F.exp(F.lit(-r * t))
    call = kind == "call"
    below = c2 if call else 1 - c2
    carry = r * k * df * below
    raw = {
        "delta": c1 if call else c1 - 1.0,
        "gamma": n1 / (s * vol * root),
        "theta": (-s * n1 * vol / (2 * root) + (-carry if call else carry)) / 365.0,
        "vega": s * root * n1 * 0.01,
        "rho": k * t * df * (below if call else -below) * 0.01,
    }
    return {n: F.when((vol > 0) & F.lit(t > 0), c).otherwise(0.0) for n, c in raw.items()}


def strategy(df: DataFrame, px: str, vol: str, days: int = 30, r: float = 0.04) -> DataFrame:
    """At-the-money and 5 % out-of-the-money calls, Greeks, break-even and put hedge
    per signal row; unknown volatility is 20 %."""
    t = days / 365.0
    s, v = F.col(px), F.col("sigma_used")
    d = df.withColumn("sigma_used", F.coalesce(F.nullif(F.col(vol), F.lit(0.0)), F.lit(0.20)))
    d = with_d_terms(with_d_terms(d, s, s, t, r, v), s, s * 1.05, t, r, v, "_out")
    d = d.withColumns({"atm_call": price(s, s, t, r, v), "otm_call": price(s, s * 1.05, t, r, v, tag="_out"), "put_hedge": price(s, s, t, r, v, "put"), **greeks(s, s, t, r, v)})
    return d.withColumn("breakeven_pct", 100.0 * F.col("atm_call") / s).drop(*[c for c in d.columns if c.startswith(("_d", "_c", "_n")) and c not in df.columns])


def lognormal_bands(params: DataFrame, h: int = 5, px: str = "close") -> DataFrame:
    """Price percentiles h rows ahead from drift and volatility, in closed form."""
    t = h / 252.0
    s, mu, sg = F.col(px), F.col("mu"), F.col("sigma")
    drift = (mu - 0.5 * sg * sg) * t
    step = sg * t**0.5
    band = {n: s * F.exp(drift + step * Z[p]) for n, p in (("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p025", 0.025), ("p975", 0.975))}
    out = params.where(sg.isNotNull()).withColumns(band)
    return out.withColumns({
        "expected_return": F.col("p50") / s - 1,
        "prob_up": norm_cdf(W.safe_div(drift, F.nullif(step, F.lit(0.0)))),
        "var_95": F.greatest(1 - F.col("p05") / s, F.lit(0.0)),
    })


def band_coverage(bands: DataFrame, h: int = 5, px: str = "close") -> DataFrame:
    """Share of realised prices inside the 95 % and 50 % bands and the mean error."""
    d = bands.withColumn("_f", W.lead(px, h)).where("_f is not null")
    f = F.col("_f")
    return d.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when((F.col("p025") <= f) & (f <= F.col("p975")), 1.0).otherwise(0.0)).alias("coverage_95"),
        F.avg(F.when((F.col("p25") <= f) & (f <= F.col("p75")), 1.0).otherwise(0.0)).alias("coverage_50"),
        F.avg(F.abs((f - F.col("p50")) / F.col(px))).alias("mean_error"))


# --- the same formulas as SQL text, for the query twins ---------------------------

SIGMA_SQL = "coalesce(nullif(iv_proxy, 0), 0.2)"


def cdf_sql(x: str) -> str:
    k = f"(1/(1 + {NORMAL_P!r}*abs({x})))"
    poly = "0"
    for b in reversed(NORMAL_B):
        poly = f"(({poly} + {b!r})*{k})"
    up = f"({INV_SQRT_2PI!r}*exp(-({x})*({x})/2)*{poly})"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {up} ELSE {up} END)"


def iv_sql() -> str:
    w = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
    return f"""iv0 AS (SELECT ticker, date, close, ln(close/lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS lr FROM prices),
iv AS (SELECT ticker, date, CASE WHEN count(lr) OVER {w} >= 15 THEN stddev_samp(lr) OVER {w} END*sqrt(252) AS iv_proxy FROM iv0)"""


def price_sql(src: str, days: int = 30, r: float = 0.04) -> str:
    """CTE ``opt`` over columns s (spot) and sg (volatility)."""
    t = days / 365.0
    root = t**0.5
    df = f"exp({-r * t!r})"
    n1 = f"({INV_SQRT_2PI!r}*exp(-d1*d1/2))"
    return f"""o0 AS (SELECT *, ({r} + 0.5*sg*sg)*{t!r}/(sg*{root!r}) AS d1, (ln(1/1.05::DOUBLE) + ({r} + 0.5*sg*sg)*{t!r})/(sg*{root!r}) AS e1 FROM {src}),
o1 AS (SELECT *, d1 - sg*{root!r} AS d2, e1 - sg*{root!r} AS e2 FROM o0),
opt AS (SELECT *, s*{cdf_sql('d1')} - s*{df}*{cdf_sql('d2')} AS atm_call, s*{cdf_sql('e1')} - s*1.05*{df}*{cdf_sql('e2')} AS otm_call,
 s*{df}*{cdf_sql('(-d2)')} - s*{cdf_sql('(-d1)')} AS put_hedge, {cdf_sql('d1')} AS delta, {n1}/(s*sg*{root!r}) AS gamma,
 (-s*{n1}*sg/(2*{root!r}) - {r}*s*{df}*{cdf_sql('d2')})/365 AS theta, s*{root!r}*{n1}*0.01 AS vega, s*{t!r}*{df}*{cdf_sql('d2')}*0.01 AS rho FROM o1)"""
