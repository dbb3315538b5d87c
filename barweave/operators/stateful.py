"""Path-dependent rules per key.

A key's history is one row per calendar date, so its ordered array is bounded.  The
fold itself is a short Python loop inside an Arrow batch of many keys.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions import windows as W


def fold(df: DataFrame, key: str, order: str, cols: list[str], step: Callable, out: str, out_type: str) -> DataFrame:
    """Run ``step(list per column) -> list`` over each key's rows in order."""
    h = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("h"))

    @F.pandas_udf(f"array<{out_type}>")
    def run(h: pd.Series) -> pd.Series:
        return pd.Series([step(*[[e[c] for e in rows] for c in cols]) for rows in h])

    z = h.select(key, F.explode(F.arrays_zip(F.col("h"), run("h").alias("o"))).alias("x"))
    return z.select(key, F.col(f"x.h.{order}").alias(order), *[F.col(f"x.h.{c}").alias(c) for c in cols], F.col("x.o").alias(out))


def flip_filter(signals: DataFrame, threshold: float = 0.15, remember: str = "score") -> DataFrame:
    """Suppress a change of side unless the score is at least ``threshold`` from what was
    remembered of the last accepted row (its ``remember`` column, such as a smoothed
    score); state is per ticker and starts empty."""

    def step(score, kept, side):
        last, out = None, []
        for s, k, d in zip(score, kept, side):
            flip = last is not None and last != 0 and d != 0 and (1 if last > 0 else -1) != d
            ok = not (flip and abs(s - last) < threshold)
            if ok:
                last = s if k is None else k
            out.append(ok)
        return out

    d = F.when(F.col("signal") == "Bullish", 1).when(F.col("signal") == "Bearish", -1).otherwise(0)
    rows = signals.withColumns({"side": d, "_kept": F.col(remember)}).where("side <> 0")
    return fold(rows, "ticker", "date", ["score", "_kept", "side"], step, "accepted", "boolean").drop("_kept")


def reentry_block(blotter: DataFrame) -> DataFrame:
    """No new position in a name before its open one has exited."""

    def step(entry, exit_):
        busy, out = None, []
        for a, b in zip(entry, exit_):
            ok = busy is None or a > busy
            if ok:
                busy = b
            out.append(ok)
        return out

    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    b = blotter.select("ticker", "date", day(F.col("entry_date")).alias("entry_day"), day(F.col("exit_date")).alias("exit_day"))
    return fold(b, "ticker", "date", ["entry_day", "exit_day"], step, "opened", "boolean")


def halt_hysteresis(equity: DataFrame, halt: float = 0.002, resume: float = 0.001, key: str = "acct") -> DataFrame:
    """Halt when drawdown passes ``halt``; resume once it is back under ``resume``.
    The state is the last event, so a window is enough."""
    peak = F.max("equity").over(W.expanding(key))
    out = equity.withColumn("drawdown", (peak - F.col("equity")) / peak)
    event = F.when(F.col("drawdown") > halt, 1).when(F.col("drawdown") < resume, 0)
    state = F.last(event, ignorenulls=True).over(Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("halted", F.coalesce(state, F.lit(0)) == 1)
