"""Predictive power: information coefficients and feature audits."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions import windows as W
from barweave.functions.mathx import corr_of
from barweave.functions.ranks import average_rank, exact_quantiles, rank_columns, spearman, value_positions
from barweave.operators.metrics import one_row
from barweave.session import cut_lineage


def forward_columns(bars: DataFrame, lags) -> DataFrame:
    return bars.withColumns({f"fwd_{k}": W.safe_div(W.lead("close", k), "close") - 1 for k in lags})


def trade_ic(trades: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and rank correlation over the whole trade log."""
    p = trades.agg(F.when(F.count(x) >= 3, F.coalesce(corr_of(x, y), F.lit(0.0))).otherwise(0.0).alias("ic"))
    s = spearman(trades, [], x, y, "rank_ic", 3).select(F.coalesce("rank_ic", F.lit(0.0)).alias("rank_ic"), "n")
    return one_row(p, s)


def ic_decay(df: DataFrame, x: str, lags, skip_neutral: bool = False, min_n: int = 10) -> DataFrame:
    """Pooled IC per lag, all lags in one aggregate."""
    d = df.where("signal <> 'Neutral'") if skip_neutral else df
    aggs = []
    for k in lags:
        y = F.col(f"fwd_{k}")
        n = F.count(F.when(F.col(x).isNotNull() & y.isNotNull(), 1))
        aggs.append(F.struct(F.lit(k).alias("lag"), n.alias("n"), F.when(n >= min_n, F.coalesce(corr_of(F.col(x), y), F.lit(0.0))).otherwise(0.0).alias("ic")).alias(f"l{k}"))
    return d.agg(*aggs).select(F.explode(F.array(*[f"l{k}" for k in lags])).alias("s")).select("s.*")


def long_pairs(df: DataFrame, xs: list[str], lags) -> DataFrame:
    cells = [F.struct(F.lit(x).alias("feature"), F.lit(k).alias("lag"), F.col(x).alias("x"), F.col(f"fwd_{k}").alias("y")) for x in xs for k in lags]
    narrow = cut_lineage(df.select(*xs, *[f"fwd_{k}" for k in lags]))
    return narrow.select(F.explode(F.array(*cells)).alias("s")).select("s.*")


def rank_ic_decay(df: DataFrame, x: str, lags) -> DataFrame:
    """Pooled rank IC per lag.  Lags are few but each holds every row, so ranks are
    by value range."""
    return spearman(long_pairs(df, [x], lags), ["lag"], "x", "y", "ic", 10).select("lag", F.coalesce("ic", F.lit(0.0)).alias("ic"), "n")


def best_horizon(decay: DataFrame) -> DataFrame:
    return decay.agg(F.max_by(F.struct("lag", "ic"), F.struct(F.abs("ic"), -F.col("lag"))).alias("s")).select("s.lag", "s.ic")


def daily_ic(df: DataFrame, xs: list[str], lags, min_n: int = 4) -> DataFrame:
    """Cross-section IC per date, feature and lag: one pass of combinable sums, then
    a small unpivot of one row per date."""
    aggs = []
    for x in xs:
        for k in lags:
            y = F.col(f"fwd_{k}")
            n = F.count(F.when(F.col(x).isNotNull() & y.isNotNull(), 1))
            ok = (n >= min_n) & (F.stddev_pop(F.when(y.isNotNull(), F.col(x))) >= 1e-12) & (F.stddev_pop(F.when(F.col(x).isNotNull(), y)) >= 1e-12)
            aggs.append(F.when(ok, corr_of(F.col(x), y)).alias(f"{x}|{k}"))
    cells = [F.struct(F.lit(x).alias("feature"), F.lit(k).alias("lag"), F.col(f"`{x}|{k}`").alias("ic")) for x in xs for k in lags]
    return df.groupBy("date").agg(*aggs).select("date", F.explode(F.array(*cells)).alias("s")).select("date", "s.*")


def ic_verdicts(ic: DataFrame, main_lag: int = 5, buckets: int = 4) -> DataFrame:
    """Mean IC per lag, t-statistic and sign stability on the main lag, verdict.

    Buckets are equal slices of the ordered dates, the first ones one longer when
    the count does not divide.  Series hold one value per date.
    """
    means = ic.groupBy("feature").pivot("lag").agg(F.avg("ic"))
    lag_cols = [c for c in means.columns if c != "feature"]
    means = means.select("feature", *[F.col(c).alias(f"ic_lag{c}") for c in lag_cols])
    s = ic.where((F.col("lag") == main_lag) & F.col("ic").isNotNull())
    w = Window.partitionBy("feature")
    s = s.withColumns({"_i": F.row_number().over(w.orderBy("date")) - 1, "_n": F.count(F.lit(1)).over(w), "_all": F.avg("ic").over(w)})
    base, extra = F.floor(F.col("_n") / buckets), F.col("_n") % buckets
    cut = extra * (base + 1)
    b = F.when(F.col("_i") < cut, F.floor(F.col("_i") / (base + 1))).otherwise(extra + F.floor(W.safe_div(F.col("_i") - cut, F.nullif(base, F.lit(0)))))
    by = s.withColumn("_b", b).groupBy("feature", "_b").agg(F.avg("ic").alias("_m"), F.first("_all").alias("_all"), F.first("_n").alias("_n"))
    st = by.groupBy("feature").agg(
        F.count_if(F.signum("_m") == F.signum("_all")).alias("_same"), F.count(F.lit(1)).alias("_k"), F.first("_all").alias("_all"), F.first("_n").alias("_n"))
    stable = (F.col("_n") >= buckets * 8) & (F.col("_all") != 0) & (F.col("_same") >= F.greatest(F.lit(3), F.floor(0.75 * F.col("_k"))))
    t = s.groupBy("feature").agg(F.avg("ic").alias("_mu"), F.stddev_samp("ic").alias("_sd"), F.count("ic").alias("_c"))
    tstat = F.when((F.col("_c") >= 10) & (F.col("_sd") >= 1e-12), F.col("_mu") / F.nullif(F.col("_sd"), F.lit(0.0)) * F.sqrt("_c"))
    out = means.join(st.select("feature", stable.alias("stable")), "feature", "left").join(t.select("feature", tstat.alias("t_stat")), "feature", "left")
    a, ts = F.abs(F.coalesce(F.col(f"ic_lag{main_lag}"), F.lit(0.0))), F.coalesce("t_stat", F.lit(0.0))
    return out.withColumn("verdict", F.when((a > 0.02) & (ts > 2.0), "ADD").when((a > 0.01) & (ts > 1.5), "MAYBE").otherwise("SKIP"))


def daily_rank_ic(df: DataFrame, x: str, y: str, min_n: int = 8, n: int = 20, m: int = 10, floor: float = 0.0) -> DataFrame:
    """Daily rank IC with a rolling mean and an alert flag."""
    s = spearman(df, ["date"], x, y, "ic_daily", min_n).where("ic_daily is not null").withColumn("acct", F.lit(1))
    s = s.withColumn("rolling_ic", W.roll_mean("ic_daily", n, m, "acct"))
    return s.withColumn("below_threshold", F.coalesce(F.col("rolling_ic") < floor, F.lit(False)))


def feature_ic_decay(df: DataFrame, xs: list[str], lags, short: int = 5) -> DataFrame:
    """Pooled rank IC per feature and lag, with a flag for features whose strongest
    lag is a short one."""
    ic = spearman(long_pairs(df, xs, lags), ["feature", "lag"], "x", "y", "ic", 10)
    best = ic.groupBy("feature").agg(F.max_by("lag", F.struct(F.abs("ic"), -F.col("lag"))).alias("best_lag"))
    return ic.join(F.broadcast(best), "feature").withColumn("short_horizon", F.col("best_lag") <= short)


def feature_stability(df: DataFrame, xs: list[str]) -> DataFrame:
    """Variance over years of a feature's yearly mean and deviation, and their rank."""
    y = df.groupBy(F.year("date").alias("year")).agg(*[F.struct(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).alias(x) for x in xs])
    long = y.select("year", F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(f"{x}.m").alias("m"), F.col(f"{x}.s").alias("s")) for x in xs])).alias("z")).select("year", "z.*")
    v = long.groupBy("feature").agg(F.var_pop("m").alias("var_mean"), F.var_pop("s").alias("var_std"), F.count(F.lit(1)).alias("years"))
    v = v.withColumn("instability", F.col("var_mean") + F.col("var_std"))
    return v.withColumn("rank", F.row_number().over(Window.orderBy("instability", "feature")))  # one row per feature


def feature_correlations(df: DataFrame, xs: list[str], protected=(), limit: float = 0.8) -> DataFrame:
    """All feature pairs in one aggregate, with the column a pair suggests dropping."""
    pairs = list(combinations(xs, 2))
    one = df.agg(*[corr_of(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]))
    p = one.select(rows.alias("s")).select("s.*")
    keep = F.lit(False) if not protected else F.col("b").isin(*protected)
    both = F.lit(False) if not protected else F.col("a").isin(*protected) & keep
    rec = F.when(F.abs("corr") <= limit, "keep").when(both, "protected").when(keep, F.concat(F.lit("drop "), F.col("a"))).otherwise(F.concat(F.lit("drop "), F.col("b")))
    return p.withColumn("recommendation", rec)


def low_redundancy(df: DataFrame, xs: list[str], limit: float = 0.5) -> DataFrame:
    """Features by falling variance, kept unless correlated with a kept one.  The
    driver sees only the C*C matrix of C named features."""
    spark = df.sparkSession
    corr = {frozenset((r["a"], r["b"])): abs(r["corr"] or 0.0) for r in feature_correlations(df, xs).collect()}
    var = df.agg(*[F.var_samp(x).alias(x) for x in xs]).first()
    kept: list[str] = []
    for x in sorted(xs, key=lambda c: (-(var[c] or 0.0), c)):
        if all(corr[frozenset((x, k))] <= limit for k in kept):
            kept.append(x)
    return spark.createDataFrame([(x, x in kept, float(var[x] or 0.0)) for x in xs], "feature string, kept boolean, variance double")


def select_by_ic(df: DataFrame, xs: list[str], y: str, strong=0.02, relaxed=0.01, min_strong=5, min_relaxed=3) -> DataFrame:
    """Features with |rank IC| above a threshold that relaxes when too few pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).alias("x"), F.col(y).alias("y")) for x in xs]))
    ic = spearman(cut_lineage(df.select(*xs, y)).select(cells.alias("s")).select("s.*"), ["feature"], "x", "y", "ic", 3)
    n = ic.agg(F.count_if(F.abs("ic") > strong).alias("_s"), F.count_if(F.abs("ic") > relaxed).alias("_r"))
    thr = F.when(F.col("_s") >= min_strong, strong).when(F.col("_r") >= min_relaxed, relaxed).otherwise(0.0)
    j = ic.withColumn("_k", F.lit(1)).join(F.broadcast(n.withColumn("_k", F.lit(1))), "_k")
    return j.select("feature", "ic", thr.alias("threshold"), ((F.abs("ic") > thr) | (thr == 0.0)).alias("selected"))


def metric_triple(df: DataFrame, score: str, y: str, keys: list[str] = ()) -> DataFrame:
    """Rank IC, share of equal signs and AUC.  The AUC is the rank sum of the up
    class, from counts per distinct score; nothing is ranked row by row."""
    keys = list(keys)
    ok = cut_lineage(df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).select(*keys, score, y))
    ic = spearman(ok, keys, score, y, "ic", 3)
    acc = ok.groupBy(*keys).agg(F.avg(F.when(F.signum(score) == F.signum(y), 1.0).otherwise(0.0)).alias("accuracy"))
    pos = value_positions(ok, keys, score)
    ups = ok.groupBy(*keys, score).agg(F.count_if(F.col(y) > 0).alias("_up"))
    r = pos.join(ups, [*keys, score]).groupBy(*keys).agg(
        F.sum(F.col("_up") * (F.col("_before") + (F.col("_c") + 1) / 2.0)).alias("_rs"), F.sum("_up").alias("_p"), F.max("_n").alias("_n"))
    p, n = F.col("_p").cast("double"), F.col("_n").cast("double")
    auc = W.safe_div(F.col("_rs") - p * (p + 1) / 2, F.nullif(p * (n - p), F.lit(0.0)))
    r = r.select(*keys, auc.alias("auc"))
    if keys:
        return ic.join(acc, keys).join(r, keys)
    return one_row(ic, acc, r)


def score_metrics(df: DataFrame, scores: list[str], y: str, key: str) -> DataFrame:
    """``metric_triple`` of several scores of the same rows, as rows (key, score, ic, accuracy, auc, n).

    ``df`` has ticker, date, the key and ``scores``.  The label is ranked once for all scores and a score once for both its
    rank correlation and its AUC, all in one sort; a row's places meet again by ticker, and a row per key is left.
    """
    ok = reduce(lambda d, c: d.where(F.col(c).isNotNull()), [*scores, y], df)
    columns = {f"c{i}": c for i, c in enumerate([y, *scores])}
    rows = ok.select("ticker", F.col("date").alias("_day"), F.col(key).alias("date"), *[F.col(c).cast("double").alias(n) for n, c in columns.items()])
    ranked = rank_columns(rows, ["ticker", "_day"], {n: (n, None) for n in columns})
    place = F.col("_first") + (F.col("_len") + 1) / 2.0
    # the middle place is (n+1)/2 exactly, so the centred sums need no first pass
    each = ranked.select("ticker", "_day", "date", "_name", "_x", (place - (F.col("_n") + 1) / 2.0).alias("_d"), "_n").repartition("ticker")
    of = lambda n, v: F.max(F.when(F.col("_name") == n, F.col(v))).alias(f"{v}{n}")
    each = each.groupBy("ticker", "_day", "date").agg(F.max("_n").alias("_n"), *[of(n, v) for n in columns for v in ("_x", "_d")])
    up, d = F.col("_xc0") > 0, lambda n: F.col(f"_d{n}")
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(up).cast("double").alias("_p"), F.sum(d("c0") * d("c0")).alias("_yy")]
    for n in list(columns)[1:]:
        sums += [
            F.sum(d(n) * d("c0")).alias(f"_xy{n}"), F.sum(d(n) * d(n)).alias(f"_xx{n}"), F.sum(F.when(up, d(n) + (F.col("_n") + 1) / 2.0)).alias(f"_rs{n}"),
            F.avg(F.when(F.signum(f"_x{n}") == F.signum("_xc0"), 1.0).otherwise(0.0)).alias(f"_acc{n}"),
        ]
    g = each.groupBy("date").agg(*sums)
    p, rest = F.col("_p"), F.col("n").cast("double") - F.col("_p")
    cells = [
        F.struct(
            F.lit(c).alias("score"), F.when(F.col("n") >= 3, F.try_divide(F.col(f"_xy{n}"), F.sqrt(F.col(f"_xx{n}") * F.col("_yy")))).alias("ic"),
            F.col(f"_acc{n}").alias("accuracy"), W.safe_div(F.coalesce(F.col(f"_rs{n}"), F.lit(0.0)) - p * (p + 1) / 2, F.nullif(p * rest, F.lit(0.0))).alias("auc"),
        )
        for n, c in list(columns.items())[1:]
    ]
    return g.select(F.col("date").alias(key), "n", F.explode(F.array(*cells)).alias("s")).select(key, "s.*", "n")


def ranking_stability(df: DataFrame, x: str) -> DataFrame:
    """Per ticker: autocorrelation of its cross-section rank and how often it stays
    in the same decile."""
    k = average_rank(df.where(F.col(x).isNotNull()), ["date"], x, "_rk", pct=True)
    dec = F.least(F.ceil(F.round(F.col("_rk") * 10, 9)), F.lit(10))
    k = k.withColumn("_d", dec).withColumns({"_pk": W.lag("_rk"), "_pd": W.lag("_d")})
    return k.groupBy("ticker").agg(corr_of("_rk", "_pk").alias("rank_autocorr"), F.avg(F.when(F.col("_pd").isNotNull(), F.when(F.col("_d") == F.col("_pd"), 1.0).otherwise(0.0))).alias("decile_retention"), F.count("_pk").alias("n"))
