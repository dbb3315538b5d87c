"""Query registry.

A query is declared once with an output spec such as ``"ticker:i date:d ret:f"``.
The same spec shapes the Spark result and the SQL twin: ``i`` 64-bit integer,
``f`` double rounded to 6 places (NaN becomes null, minus zero becomes zero),
``d`` ISO date text, ``s`` text, ``b`` 0/1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@dataclass(frozen=True)
class Query:
    name: str
    ops: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


# Added before rounding on both sides, so values that sit exactly half-way (1/128,
# say) cannot round apart because of a last-bit difference in summation order.
OFFSET = 3.7e-10

QUERIES: dict[str, Query] = {}


def _fields(spec: str) -> list[tuple[str, str]]:
    return [tuple(p.split(":")) for p in spec.split()]


def rounded(x: Column) -> Column:
    """Six places, halves away from zero, by double arithmetic as the twin's engine rounds.  (``F.round`` goes through a
    decimal text for every value; that stays for values beyond the digits of a double.)"""
    y = (x + OFFSET) * 1e6
    near = F.when(y < 0, F.ceil(y - 0.5)).otherwise(F.floor(y + 0.5)) / F.lit(1e6)
    return F.when(F.abs(y) < 1e15, near).otherwise(F.round(x + OFFSET, 6) + F.lit(0.0))


@F.arrow_udf(DoubleType())
def rounded_arrays(v: pa.Array) -> pa.Array:
    """The same for wide results, whose expressions together are too long to compile."""
    x = v.to_numpy(zero_copy_only=False).astype(float)
    y = (x + OFFSET) * 1e6
    with np.errstate(invalid="ignore"):
        near = np.trunc(y + np.copysign(0.5, y)) / 1e6 + 0.0
        return pa.array(np.where(np.abs(y) < 1e15, near, x), pa.float64(), from_pandas=True)


#: Results with more doubles than this are rounded as arrays.
WIDE = 12


def shape(df: DataFrame, spec: str) -> DataFrame:
    out = []
    wide = sum(kind == "f" for _, kind in _fields(spec)) > WIDE
    for name, kind in _fields(spec):
        x = F.col(name)
        if kind == "f":
            x = x.cast("double")
            x = rounded_arrays(x) if wide else F.when(~F.isnan(x), rounded(x))
        elif kind in ("i", "b"):
            x = x.cast("long")
        else:
            x = x.cast("string")
        out.append(x.alias(name))
    return df.select(*out)


def shape_sql(spec: str, sql: str) -> str:
    out = []
    for name, kind in _fields(spec):
        if kind == "f":
            x = f"CAST({name} AS DOUBLE)"
            x = f"CASE WHEN NOT isnan({x}) THEN round({x} + {OFFSET!r}, 6) + 0.0 END"
        elif kind in ("i", "b"):
            x = f"CAST({name} AS BIGINT)"
        else:
            x = f"CAST({name} AS VARCHAR)"
        out.append(f"{x} AS {name}")
    return f"SELECT {', '.join(out)} FROM (\n{sql.strip()}\n) AS q"


def query(name: str, ops: str, spec: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a plain descriptive name."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(
            name, ops, lambda spark, sf_dir: shape(fn(spark, sf_dir), spec), shape_sql(spec, sql) if sql else None
        )
        return fn

    return wrap
