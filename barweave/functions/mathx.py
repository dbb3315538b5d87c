"""Scalar column formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun 26.2.17 normal CDF coefficients.
NORMAL_P = 0.2316419
NORMAL_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
INV_SQRT_2PI = 1.0 / math.sqrt(2.0 * math.pi)

# Standard normal quantiles.
Z = {0.01: -2.3263478740408408, 0.05: -1.6448536269514722, 0.25: -0.6744897501960817,
     0.5: 0.0, 0.75: 0.6744897501960817, 0.95: 1.6448536269514722,
     0.025: -1.9599639845400545, 0.975: 1.959963984540054}


def norm_pdf(x: Column) -> Column:
    return F.lit(INV_SQRT_2PI) * F.exp(-x * x / 2.0)


def norm_cdf(x: Column) -> Column:
    """Polynomial normal CDF, error below 7.5e-8, as one JVM expression."""
    a = F.abs(x)
    k = 1.0 / (1.0 + NORMAL_P * a)
    poly = F.lit(0.0)
    for b in reversed(NORMAL_B):
        poly = (poly + b) * k
    upper = norm_pdf(a) * poly
    return F.when(x >= 0, 1.0 - upper).otherwise(upper)


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Null stays null (``least``/``greatest`` alone would return the bound)."""
    y = x
    if lo is not None:
        y = F.greatest(y, F.lit(float(lo)))
    if hi is not None:
        y = F.least(y, F.lit(float(hi)))
    return F.when(x.isNotNull(), y)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def lookup(x: Column, mapping: dict, default=None) -> Column:
    """Literal map lookup with a default, as a CASE chain."""
    out = None
    for k, v in mapping.items():
        out = F.when(x == F.lit(k), F.lit(v)) if out is None else out.when(x == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default))


def corr_of(x, y, over=None) -> Column:
    """Pearson correlation over pairs with both values; null when either side is
    flat (the built-in ``corr`` divides by zero there)."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    parts = [
        F.covar_pop(x, y),
        F.stddev_pop(F.when(y.isNotNull(), x)),
        F.stddev_pop(F.when(x.isNotNull(), y)),
    ]
    if over is not None:
        parts = [p.over(over) for p in parts]
    return F.try_divide(parts[0], F.nullif(parts[1] * parts[2], F.lit(0.0)))


def round_half_up(x: Column, places: int) -> Column:
    """Rounding as plain double arithmetic, the same in any engine."""
    k = 10.0**places
    return F.floor(x * k + 0.5) / k
