"""Cross-section operators: across tickers on one date.

A date may hold any number of tickers, so nothing here puts a date into one task:
moments come from map-side combined aggregates joined back as a calendar-bounded
table, ranks and medians from value-range ranking.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions import windows as W
from barweave.functions.mathx import corr_of
from barweave.functions.ranks import average_rank, exact_quantiles, medians, percent_ranks, rank_columns
from barweave.session import cut_lineage, written
from barweave.sources.bars import calendar


# A spread below this is rounding noise of equal values and counts as flat.
FLAT = 1e-12


def spread(sd: Column) -> Column:
    return F.when(sd > FLAT, sd)


def date_moments(df: DataFrame, cols: list[str], ddof: int = 1) -> DataFrame:
    """``_mean_<c>`` and ``_sd_<c>`` of each date."""
    m = packed_moments(df, cols, ddof)
    return m.select("date", *[F.col(s)[i].alias(f"{s}_{c}") for s in ("_mean", "_sd") for i, c in enumerate(cols)])


def packed_moments(df: DataFrame, cols: list[str], ddof: int | list[int] = 1) -> DataFrame:
    """``_mean`` and ``_sd`` (``ddof`` for all or each) of each date, arrays in the order of ``cols``, for any number of columns in one pass.

    A task adds up its rows per date for all columns at once (a row per date leaves it), each less the
    date's first value, so a flat date has no spread at all; a date's few rows are then put together.
    """
    k = len(cols)
    parts = ", ".join(f"{s} array<double>" for s in ("n", "mean", "dev"))

    def add_up(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        days, n, at, s, q = np.zeros(0, dtype=np.int64), *[np.zeros((0, k)) for _ in range(4)]
        for b in batches:
            if not b.num_rows:
                continue
            d = pc.cast(pc.cast(b.column(0), pa.int32()), pa.int64()).to_numpy()
            new = np.setdiff1d(d, days)
            if len(new):
                order = np.argsort(np.concatenate([days, new]))
                days = np.concatenate([days, new])[order]
                n, s, q = (np.concatenate([x, np.zeros((len(new), k))])[order] for x in (n, s, q))
                at = np.concatenate([at, np.full((len(new), k), np.nan)])[order]
            i = np.searchsorted(days, d)
            for c in range(k):
                x = b.column(c + 1).to_numpy(zero_copy_only=False).astype(float)
                ok = ~np.isnan(x)
                j, x = i[ok], x[ok]
                unseen = np.isnan(at[j, c])
                at[j[unseen][::-1], c] = x[unseen][::-1]
                x = x - at[j, c]
                n[:, c] += np.bincount(j, minlength=len(days))
                s[:, c] += np.bincount(j, x, minlength=len(days))
                q[:, c] += np.bincount(j, x * x, minlength=len(days))
        if len(days):
            with np.errstate(invalid="ignore", divide="ignore"):
                mean, dev = at + s / n, np.maximum(q - s * s / n, 0.0)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.nan_to_num(x).ravel()), k).cast(pa.list_(pa.float64())) for x in (n, mean, dev)]
            yield pa.RecordBatch.from_arrays([pa.array(days.astype(np.int32)).cast(pa.date32()), *lists], names=["date", "n", "mean", "dev"])

    def together(t):
        import pyarrow as pa

        n, mean, dev = (np.array(t.column(c).to_pylist(), dtype=float) for c in ("n", "mean", "dev"))
        size = n.sum(axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            first = mean[(n > 0).argmax(axis=0), np.arange(k)]
            centre = first + (n * (mean - first)).sum(axis=0) / size
            sd = np.sqrt((dev + n * (mean - centre) ** 2).sum(axis=0) / (size - np.asarray(ddof)))
        lists = [pa.array([pa.array(v, pa.float64(), from_pandas=True).to_pylist()], pa.list_(pa.float64())) for v in (centre, np.where(size > np.asarray(ddof), sd, np.nan))]
        return pa.Table.from_arrays([t.column("date").slice(0, 1), *lists], names=["date", "_mean", "_sd"])

    rows = df.select("date", *[F.col(c).cast("double").alias(c) for c in cols]).where(F.col("date").isNotNull())
    per_task = rows.mapInArrow(add_up, f"date date, {parts}")
    return per_task.groupBy("date").applyInArrow(together, "date date, _mean array<double>, _sd array<double>")


def cs_zscore(df: DataFrame, cols: list[str], ddof: int = 1, suffix: str = "_z", fill: float | None = None) -> DataFrame:
    """z-score of each column across the tickers of a date; flat dates give null
    (or ``fill``).  All columns share one aggregate and one join."""
    j = df.join(F.broadcast(date_moments(df, cols, ddof)), "date", "left")
    out = {}
    for c in cols:
        z = W.safe_div(F.col(c) - F.col(f"_mean_{c}"), spread(F.col(f"_sd_{c}")))
        out[c + suffix] = z if fill is None else F.coalesce(z, F.lit(fill))
    return j.withColumns(out).drop(*[f"_{p}_{c}" for p in ("mean", "sd") for c in cols])


def cs_zscore_all(df: DataFrame) -> DataFrame:
    """``<col>_cs_z`` for every double column; a flat date divides by 1."""
    cols = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    j = df.join(F.broadcast(date_moments(df, cols)), "date", "left")
    z = {}
    for c in cols:
        sd = F.coalesce(spread(F.col(f"_sd_{c}")), F.lit(1.0))
        z[f"{c}_cs_z"] = (F.col(c) - F.col(f"_mean_{c}")) / sd
    return j.withColumns(z).drop(*[f"_{p}_{c}" for p in ("mean", "sd") for c in cols])


def calendar_lag(df: DataFrame, cols: list[str], suffix: str = "_lag", fill: float | None = None) -> DataFrame:
    """Value on the previous date of the common calendar, null when the ticker had
    no row then.  The row lag is the only candidate, so no self join is needed:
    it counts when the previous row sits exactly one calendar step back."""
    j = df.join(F.broadcast(calendar(df)), "date")
    w = W.by_key()
    step = F.col("idx") - F.lag("idx").over(w) == 1
    out = {}
    for c in cols:
        v = F.when(step, F.lag(c).over(w))
        out[c + suffix] = v if fill is None else F.coalesce(v, F.lit(fill))
    return j.withColumns(out).drop("idx")


def zscore_then_lag(df: DataFrame, cols: list[str], ddof: int = 1) -> DataFrame:
    """Cross-section z-score, then one calendar step back, then 0 for unknown."""
    z = cs_zscore(df, cols, ddof, "_z")
    lagged = calendar_lag(z, [c + "_z" for c in cols], "l", 0.0)
    return lagged.drop(*[c + "_z" for c in cols])


def cs_rank(df: DataFrame, x: str, out: str) -> DataFrame:
    """Percentile rank across the tickers of a date, average ties."""
    return average_rank(df, ["date"], x, out, pct=True)


def rank_then_row_lag(df: DataFrame, x: str, out: str) -> DataFrame:
    """Cross-section rank known the ticker's own row before."""
    return cs_rank(df, x, "_rk").withColumn(out, W.lag("_rk")).drop("_rk")


def sector_relative(df: DataFrame, cols: list[str]) -> DataFrame:
    """Return minus the (date, sector) median, z-scored and lagged on the calendar."""
    return zscore_then_lag(minus_sector_median(df, cols), [f"{c}_rel" for c in cols])


def minus_sector_median(df: DataFrame, cols: list[str]) -> DataFrame:
    keys, out = ["date", "sector"], df
    meds = [exact_quantiles(df, keys, c, {f"_med_{c}": 0.5}) for c in cols]
    for m in meds:
        out = out.join(m, keys, "left")  # one row per date and sector
    return out.withColumns({f"{c}_rel": F.col(c) - F.col(f"_med_{c}") for c in cols}).drop(*[f"_med_{c}" for c in cols])


def vol_rank_feature(rets: DataFrame, exclude: DataFrame) -> DataFrame:
    """Lagged cross-section rank of 20-row volatility without benchmark names."""
    v = rets.join(exclude.select("ticker"), "ticker", "left_anti").withColumn("vol_20", W.roll_std("r", 20))
    return rank_then_row_lag(v.where(F.col("vol_20").isNotNull()), "vol_20", "vol_rank")


def breadth(bars: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """Share of names above their averages and the advance/decline ratio, on the
    forward-filled calendar.  The denominator is names with a valid average.

    A ticker is filled on the calendar and held against its averages as arrays, and a task adds up the dates of
    all its tickers: filled rows are never made, and a row per date leaves a task.
    """
    cal = written(calendar(bars), "calendar")

    def counts(k):
        at, close = k["idx"].astype(int), k["close"]
        known = np.maximum.accumulate(np.where(np.isnan(close), 0, np.arange(len(close))))
        x = np.repeat(close[known], np.diff([*at, int(k["_last"][0]) + 1]))
        f, s, p = W.frame_means(x, fast, 10), W.frame_means(x, slow, 40), np.concatenate([[np.nan], x[:-1]])
        return at[0], np.stack([x > f, ~np.isnan(f), x > s, ~np.isnan(s), x > p, x < p], axis=1)

    last = F.broadcast(cal.agg(F.max("idx").alias("_last")).withColumn("_k", F.lit(1)))
    grid = bars.select("ticker", "date", "close").join(F.broadcast(cal), "date").withColumn("_k", F.lit(1)).join(last, "_k").drop("_k")
    agg = W.added_up(grid, ["_af", "_nf", "_as", "_ns", "up", "down"], "idx", counts).join(F.broadcast(cal), "idx")
    return agg.select(
        "date",
        W.safe_div("_af", F.nullif(F.col("_nf"), F.lit(0.0))).alias("above_fast"),
        W.safe_div("_as", F.nullif(F.col("_ns"), F.lit(0.0))).alias("above_slow"),
        F.col("up").cast("long").alias("up"),
        F.col("down").cast("long").alias("down"),
        (F.col("up") / (F.col("down") + 1)).alias("adv_decline"),
    )


def sector_aggregates(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    return df.groupBy("date", "sector").agg(*[F.avg(c).alias(o) for o, c in cols.items()])


def sector_wide(agg: DataFrame, col: str, sectors: list[str]) -> DataFrame:
    return agg.groupBy("date").pivot("sector", sectors).agg(F.first(col))


def classify(x: Column, bull: float | Column, bear: float | Column) -> Column:
    return F.when(x > bull, "Bullish").when(x < bear, "Bearish").otherwise("Neutral")


def sector_adjusted(scored: DataFrame, agg: DataFrame, weights: dict[str, float], cut: float = 0.5) -> DataFrame:
    """Add weighted sector aggregates of the same date and reclassify."""
    j = scored.join(agg, ["date", "sector"], "left")
    adj = reduce(lambda a, kv: a + kv[1] * F.coalesce(F.col(kv[0]), F.lit(0.0)), weights.items(), F.col("score"))
    return j.withColumn("adjusted_score", adj).withColumn("signal", classify(F.col("adjusted_score"), cut, -cut))


def attach_macro(df: DataFrame, series: DataFrame, cols: list[str]) -> DataFrame:
    return df.join(F.broadcast(series.select("date", *cols)), "date", "left").fillna(0.0, subset=cols)


def excess_forward(labelled: DataFrame, benchmark: DataFrame) -> DataFrame:
    return labelled.join(F.broadcast(benchmark.select("date", "bench_fwd")), "date", "left").withColumn(
        "excess", F.col("fwd") - F.coalesce(F.col("bench_fwd"), F.lit(0.0))
    )


def dispersion(scored: DataFrame, x: str, eps: float = 1e-6) -> DataFrame:
    """Score spread per date and whether it is degenerate."""
    return scored.groupBy("date").agg(
        F.stddev_pop(x).alias("score_std"), (F.max(x) - F.min(x)).alias("score_range"), F.count(x).alias("n")
    ).withColumn("flat", (F.col("score_std") < eps) | (F.col("score_range") < eps))


def calendar_before(df: DataFrame) -> DataFrame:
    """The dates in use with the one before each (``_prev``, null for the first)."""
    return calendar(df).select("date", F.lag("date").over(Window.orderBy("date")).alias("_prev"))


def training_panel(matrix: Callable, macro: DataFrame, benchmark: DataFrame, keep: list[str], ablate=()) -> DataFrame:
    """Training panel: ``keep`` of the matrix, sector-relative momentum, lagged ranks and z-scores,
    macro series and excess label.  Ablated features become 0.

    ``matrix(columns, before=(), ranks=None)`` makes ticker, date, sector and ``columns`` anew for each reader, with the values of
    ``before`` (and the date, as days since 1970) in the ticker's row before, and those of ``ranks`` there.  Only the values
    to rank move between tasks; everything else that tickers share is a row per date, or per date and sector.
    """
    lagged = ["rsi_14", "bb_position", "overnight_gap"]
    narrow = written(matrix(["ret_20d", "vol_20d"]).fillna("Other", subset=["sector"]), "ranked-values")  # read by both sorts
    ranks = percent_ranks(rank_columns(narrow, ["ticker", "date"], {"_rank_vol": ("vol_20d", None)}), ["ticker", "date"], ["_rank_vol"])
    meds = written(medians(rank_columns(narrow, ["date"], {"_med": ("ret_20d", "sector")}), "_med", "_m").withColumnRenamed("_sub", "_own"), "medians")
    own = F.concat(F.lit("="), F.coalesce(F.col("sector"), F.lit("Other")))
    p = matrix(["ret_20d", *lagged]).withColumn("_own", own).join(F.broadcast(meds), ["date", "_own"], "left")
    moments = written(packed_moments(p.withColumn("ret_20d_rel", F.col("ret_20d") - F.col("_m")), ["ret_20d_rel", *lagged]), "moments")
    # the z-score of the date before, where that is the date of the ticker's own row before
    per = calendar_before(moments).join(moments.withColumnRenamed("date", "_prev"), "_prev", "left")
    j = matrix([c for c in dict.fromkeys([*keep, "fwd"]) if c not in ablate], ["ret_20d", *lagged], ranks).withColumn("_own", own)
    j = j.join(F.broadcast(per), "date", "left").join(F.broadcast(meds.withColumnRenamed("date", "_prev")), ["_prev", "_own"], "left")
    step_back = F.col("_date_before") == F.unix_date("_prev")
    value = {"ret_20d_rel": F.col("_before_ret_20d") - F.col("_m"), **{c: F.col(f"_before_{c}") for c in lagged}}
    z = {f"{c}_zl": F.coalesce(F.when(step_back, W.safe_div(v - F.col("_mean")[i], spread(F.col("_sd")[i]))), F.lit(0.0)) for i, (c, v) in enumerate(value.items())}
    j = j.withColumns(z | {"vol_rank": F.col("_before__rank_vol"), "sector": F.coalesce(F.col("sector"), F.lit("Other"))})
    j = excess_forward(attach_macro(j, macro, ["vol_spike"]), benchmark).withColumns({c: F.lit(0.0) for c in ablate})
    return j.select("ticker", "date", "sector", *dict.fromkeys([*keep, *ablate]), "fwd", "vol_rank", *z, "vol_spike", "excess")


# --- factor neutralisation -------------------------------------------------------


def normal_equations(df: DataFrame, keys: list[str], xs: list[Column], y: Column) -> DataFrame:
    """X'X, X'y and the row count per group, all map-side combined sums."""
    k = len(xs)
    aggs = [F.sum(xs[i] * xs[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.sum(x * y).alias(f"b{i}") for i, x in enumerate(xs)]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(y * y).alias("yy"), F.sum(y).alias("sy"), *aggs)
    tri = F.array(*[F.col(f"a{i}_{j}") for i in range(k) for j in range(i, k)])
    return g.select(*keys, "n", "yy", "sy", tri.alias("xtx"), F.array(*[F.col(f"b{i}") for i in range(k)]).alias("xty"))


def solve_normal(eq: DataFrame, k: int, ridge: float = 0.0, origin: bool = False) -> DataFrame:
    """Least-squares coefficients of each group's k-by-k system (one small row); the first
    column is the intercept unless the fit goes through the ``origin``."""

    @F.pandas_udf("array<double>")
    def solve(xtx: pd.Series, xty: pd.Series) -> pd.Series:
        iu = np.triu_indices(k)
        out = []
        for a, b in zip(xtx, xty):
            m = np.zeros((k, k))
            m[iu] = np.asarray(a, dtype=float)
            m = m + m.T - np.diag(np.diag(m)) + ridge * np.diag([float(origin)] + [1.0] * (k - 1))
            out.append(np.linalg.lstsq(m, np.asarray(b, dtype=float), rcond=1e-12)[0].tolist())
        return pd.Series(out)

    return eq.withColumn("coef", solve("xtx", "xty"))


def neutralise(df: DataFrame, score: str, factors: list[str], min_n: int = 10) -> DataFrame:
    """Per date: residual of the score on intercept, factors and a dummy for each sector of the date.
    Dates with too few names keep their score.

    The dummies are eliminated first: what they explain are the means within (date, sector), and the
    factors' part is the regression of what is left on what is left of the factors.  So any number of
    sectors does, no list of them is needed, and only sums of a date travel.
    """
    # read by the means within sectors, the sums and the result
    base = written(df.withColumns({f: F.coalesce(F.col(f), F.lit(0.0)) for f in factors}), "neutral-rows")
    cols = [score, *factors]
    within = base.groupBy("date", "sector").agg(F.count(F.lit(1)).alias("_names"), *[F.avg(c).alias(f"_m_{c}") for c in cols])
    size = within.groupBy("date").agg(F.sum("_names").alias("_all"), F.count(F.lit(1)).alias("_sectors"))
    base = base.join(within, ["date", "sector"]).withColumns({f"_d_{c}": F.col(c) - F.col(f"_m_{c}") for c in cols})
    k = len(factors)
    eq = normal_equations(base, ["date"], [F.col(f"_d_{f}") for f in factors], F.col(f"_d_{score}")).join(F.broadcast(size), "date")
    eq = eq.where((F.col("_all") >= min_n) & (F.col("_all") > k + F.col("_sectors") - 1))
    coef = solve_normal(eq, k, origin=True).select("date", "coef")
    out = base.join(F.broadcast(coef), "date", "left")
    fitted = reduce(lambda a, ix: a + F.col("coef")[ix[0]] * F.col(f"_d_{ix[1]}"), enumerate(factors), F.lit(0.0))
    res = F.when(F.col("coef").isNotNull(), F.col(f"_d_{score}") - fitted).otherwise(F.col(score))
    return out.withColumn("residual", res).withColumn("signal", classify(F.col("residual"), 0.5, -0.5)).drop("coef", "_names", *[f"_{x}_{c}" for x in "md" for c in cols])


def neutralise_one(df: DataFrame, score: str, factor: str) -> DataFrame:
    """Single-factor residual per date in closed form."""
    s = df.groupBy("date").agg(
        F.avg(score).alias("_ym"), F.avg(factor).alias("_xm"),
        F.covar_pop(score, factor).alias("_c"), F.var_pop(F.when(F.col(score).isNotNull(), F.col(factor))).alias("_v"),
    )
    slope = F.coalesce(W.safe_div("_c", F.nullif(F.col("_v"), F.lit(0.0))), F.lit(0.0))
    j = df.join(F.broadcast(s), "date")
    return j.withColumn("residual", F.col(score) - F.col("_ym") - slope * (F.col(factor) - F.col("_xm"))).drop("_ym", "_xm", "_c", "_v")


def exposure_report(neutral: DataFrame, score: str, factors: list[str]) -> DataFrame:
    """Mean per-date correlation of each factor with the score before and after."""
    per_date = neutral.groupBy("date").agg(
        *[corr_of(f, score).alias(f"b_{f}") for f in factors], *[corr_of(f, "residual").alias(f"a_{f}") for f in factors]
    )
    rows = F.explode(F.array(*[
        F.struct(F.lit(f).alias("factor"), F.col(f"b_{f}").alias("before"), F.col(f"a_{f}").alias("after")) for f in factors
    ]))
    return per_date.select("date", rows.alias("x")).select("date", "x.*").groupBy("factor").agg(
        F.avg("before").alias("before"), F.avg("after").alias("after"), F.count("before").alias("n_dates")
    )
