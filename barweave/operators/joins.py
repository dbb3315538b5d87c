"""Join kinds used across the library."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def left_fill(left: DataFrame, right: DataFrame, keys: list[str], fills: dict) -> DataFrame:
    """Left join keeping every left row; listed right columns get a default."""
    return left.join(right.select(*keys, *fills), keys, "left").fillna(fills)


def attach_dimension(df: DataFrame, dim: DataFrame, key: str, fills: dict) -> DataFrame:
    """Dimension lookup with defaults.  No hint: the runtime size decides between
    a broadcast and a shuffle, since the dimension may grow with the data."""
    return left_fill(df, dim, [key], fills)


def restrict(df: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    return df.join(keep.select(key), key, "left_semi")


def exclude(df: DataFrame, drop: DataFrame, key: str) -> DataFrame:
    return df.join(drop.select(key), key, "left_anti")


def by_date(left: DataFrame, series: DataFrame, how: str = "inner") -> DataFrame:
    """Attach a date-keyed series.  One row per calendar day bounds the broadcast."""
    return left.join(F.broadcast(series), "date", how)


def outer_by_date(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two date series; the key is coalesced."""
    return a.join(b, "date", "full_outer")


def basket_moments(returns: DataFrame, basket: DataFrame, block: int = 64, days: int = 16) -> DataFrame:
    """Pairwise correlation and covariance inside a basket of any size.

    Names are cut into blocks and dates dealt into groups.  A task gets two blocks of
    one date group, turns them into dense columns and returns partial sums, so its
    memory depends on neither the basket nor the calendar; per-date pairs never exist
    as rows, and pairs use the dates both names traded on.  Returns are taken from each
    name's mean first, so the sums lose no digits.
    """
    ids = basket.select("ticker").distinct().select("ticker", (F.row_number().over(Window.orderBy("ticker")) - 1).alias("i"))
    n_blocks = -(-ids.count() // block)
    rows = returns.where(F.col("r").isNotNull()).join(ids, "ticker")
    means = rows.groupBy("i").agg(F.avg("r").alias("_mean"))
    rows = rows.join(means, "i").select("i", "date", (F.col("r") - F.col("_mean")).alias("r"), F.floor(F.col("i") / block).cast("int").alias("_b"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(max(n_blocks - 1, 0)))))
    dealt = rows.select(F.least("_b", "_o").alias("p"), F.greatest("_b", "_o").alias("q"), F.pmod(F.xxhash64("date"), F.lit(days)).alias("g"), "i", "date", "r")

    def partial(key, pdf):
        p, q, _ = (int(k) for k in key)
        at, _ = pd.factorize(pdf["date"])
        x = np.zeros((2, at.max() + 1, block))
        m = np.zeros_like(x)
        side = ((pdf["i"].to_numpy() // block) != p).astype(int)
        x[side, at, pdf["i"].to_numpy() % block] = pdf["r"].to_numpy()
        m[side, at, pdf["i"].to_numpy() % block] = 1.0
        u, v = 0, int(p != q)
        sums = m[u].T @ m[v], x[u].T @ m[v], m[u].T @ x[v], (x[u] ** 2).T @ m[v], m[u].T @ x[v] ** 2, x[u].T @ x[v]
        a, b = np.nonzero(sums[0])
        out = pd.DataFrame({"a": a + p * block, "b": b + q * block, **{c: s[a, b] for c, s in zip(("n", "sa", "sb", "qa", "qb", "ab"), sums, strict=True)}})
        return out[out["a"] < out["b"]]

    parts = dealt.groupBy("p", "q", "g").applyInPandas(partial, "a int, b int, n double, sa double, sb double, qa double, qb double, ab double")
    s = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "ab")]).where("n > 1")
    cov = (F.col("ab") - F.col("sa") * F.col("sb") / F.col("n")) / (F.col("n") - 1)
    va = (F.col("qa") - F.col("sa") * F.col("sa") / F.col("n")) / (F.col("n") - 1)
    vb = (F.col("qb") - F.col("sb") * F.col("sb") / F.col("n")) / (F.col("n") - 1)
    out = s.select("a", "b", F.col("n").cast("long").alias("n"), cov.alias("cov"), F.try_divide(cov, F.nullif(F.sqrt(va * vb), F.lit(0.0))).alias("corr"))
    ia, ib = ids.select(F.col("i").alias("a"), F.col("ticker").alias("ticker_a")), ids.select(F.col("i").alias("b"), F.col("ticker").alias("ticker_b"))
    return out.join(ia, "a").join(ib, "b").select("ticker_a", "ticker_b", "n", "cov", "corr")
