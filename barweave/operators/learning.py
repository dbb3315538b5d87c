"""Targets, sample weights, model fits, splits and walk-forward validation.

Linear models are fitted from sums of products: one map-side combined pass over
the rows serves every fold and every ridge penalty at once.  Tree and logistic
models use MLlib.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions import windows as W
from barweave.functions.mathx import corr_of
from barweave.functions.ranks import spearman
from barweave.operators import ic as IC
from barweave.operators import metrics as M
from barweave.operators import trades as TR
from barweave.session import cut_lineage, written
from barweave.sources.bars import calendar


def targets(df: DataFrame, n: int = 20) -> DataFrame:
    """Raw, excess and volatility-scaled forward return."""
    sd = F.nullif(W.roll_std("fwd", n), F.lit(0.0))
    return df.withColumns({"target_raw": F.col("fwd"), "target_excess": F.col("excess"), "target_scaled": W.safe_div("fwd", sd)})


def sample_weights(df: DataFrame, decay: float = 0.001, cost: float = 0.004, low: float = 0.25) -> DataFrame:
    """exp(-decay * age in days), times ``low`` where the move does not cover costs."""
    last = df.agg(F.max("date").alias("_last")).withColumn("_k", F.lit(1))
    j = df.withColumn("_k", F.lit(1)).join(F.broadcast(last), "_k")
    w = F.exp(-decay * F.datediff("_last", "date")) * F.when(F.abs("fwd") - cost <= 0, low).otherwise(1.0)
    return j.withColumn("sample_weight", w).drop("_k", "_last")


def effective_sample_size(series: DataFrame, x: str, key: str = "mkt", lags: int = 20) -> DataFrame:
    """n / (1 + 2 * sum of |autocorrelation|) of a date series."""
    s = series.where(F.col(x).isNotNull())
    s = s.withColumns({f"_l{k}": W.lag(x, k, key) for k in range(1, lags + 1)})
    rho = reduce(lambda a, k: a + F.abs(F.coalesce(corr_of(x, f"_l{k}"), F.lit(0.0))), range(1, lags + 1), F.lit(0.0))
    g = s.groupBy(key).agg(F.count(x).alias("n"), rho.alias("rho_sum"))
    ess = F.greatest(F.lit(1), F.round(F.col("n") / (1.0 + 2.0 * F.col("rho_sum"))).cast("long"))
    return g.select(key, "n", "rho_sum", ess.alias("ess"))


# --- linear models from sums ------------------------------------------------------


def centred(df: DataFrame, xs: list[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with ``centre`` (the means of ``xs`` over all rows, joined as one row) and ``xs`` less those means:
    sums of their products keep the digits that large means would eat."""
    means = df.agg(F.array(*[F.avg(x).cast("double") for x in xs]).alias("centre")).withColumn("_k", F.lit(1))
    j = df.withColumn("_k", F.lit(1)).join(F.broadcast(means), "_k").drop("_k")
    return j, [F.col(x) - F.col("centre")[i] for i, x in enumerate(xs)]


def stored_rows(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """The columns a search reads, written once: folds, means, sums and tests each read them again, and
    would each build all features anew."""
    return written(df.select(*dict.fromkeys(["ticker", "date", *xs, y])), "model-rows")


def product_sums(df: DataFrame, xs: list[str], y: str, w: str | None = None, keys=("date",)) -> DataFrame:
    """Per key: ``labelled`` rows (with y), ``n`` (with all of ``xs``, too), ``centre`` of ``xs`` and y, and ``_products``: weighted sums of the
    products (upper triangle by rows) of 1, ``xs`` and y of these rows, less ``centre``, which is one for all keys.

    One pass over ``df``: a task adds its rows up in blocks, less a value of its own that keeps the digits that large
    means would eat, and only a row per key leaves it.
    """
    k = len(xs) + 2
    upper = np.triu_indices(k)
    schema = df.select(*keys).schema
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    body = "labelled double, n double, centre array<double>, _products array<double>"

    def add_up(batches):
        import pyarrow as pa

        seen, counts, sums, at = {}, np.zeros((0, 2)), np.zeros((0, len(upper[0]))), None
        for b in batches:
            z = np.stack([b.column(len(keys) + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(xs) + 2)], axis=1)
            labelled = np.nonzero(~np.isnan(z[:, len(xs)]))[0]
            if not len(labelled):
                continue
            mixed = np.zeros(len(labelled), dtype=np.int64)
            for i in range(len(keys)):
                d = b.column(i).take(pa.array(labelled)).dictionary_encode()
                mixed = mixed * (len(d.dictionary) + 1) + d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False)
            _, first, group = np.unique(mixed, return_index=True, return_inverse=True)
            found = [tuple(b.column(i)[int(labelled[f])].as_py() for i in range(len(keys))) for f in first]
            for g in found:
                if g not in seen:
                    seen[g] = len(seen)
            counts, sums = (np.concatenate([x, np.zeros((len(seen) - len(x), x.shape[1]))]) for x in (counts, sums))
            code = np.array([seen[g] for g in found])[group]
            counts[:, 0] += np.bincount(code, minlength=len(seen))
            z = z[labelled]
            ok = ~np.isnan(z).any(axis=1)
            if not ok.any():
                continue
            order = np.argsort(code[ok], kind="stable")
            z, code = z[ok][order], code[ok][order]
            if at is None:
                at = z[:, :-1].mean(axis=0)
            starts = np.nonzero(np.concatenate([[True], code[1:] != code[:-1]]))[0]
            here = code[starts]
            counts[here, 1] += np.diff([*starts, len(code)])
            one = np.concatenate([np.ones((len(z), 1)), z[:, :-1] - at], axis=1)
            heavy = one * z[:, -1:]
            if len(starts) * 8 > len(code):  # many keys: a product at a time for all of them
                lo = 0
                for i in range(k):
                    sums[here, lo : lo + k - i] += np.add.reduceat(heavy[:, i : i + 1] * one[:, i:], starts)
                    lo += k - i
            else:
                for i, lo, hi in zip(here, starts, [*starts[1:], len(code)]):
                    sums[i] += (heavy[lo:hi].T @ one[lo:hi])[upper]
        if seen:
            at = np.zeros(k - 1) if at is None else at
            names = [pa.array(v, t) for v, t in zip(zip(*seen), [f.type for f in pa_schema])]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())) for x in (np.tile(at, (len(seen), 1)), sums)]
            yield pa.RecordBatch.from_arrays([*names, pa.array(counts[:, 0]), pa.array(counts[:, 1]), *lists], names=[*keys, "labelled", "n", "centre", "_products"])

    def together(t):
        import pyarrow as pa

        n, centre, g = (np.array(t.column(c).to_pylist(), dtype=float) for c in ("n", "centre", "_products"))
        to = centre[int(n.argmax())]
        total = sum(moved_sums(x, at - to) for x, at in zip(g, centre))
        rest = [pa.array([v]) for v in (float(np.sum(t.column("labelled").to_numpy())), float(n.sum()), to.tolist(), total.tolist())]
        return pa.Table.from_arrays([*[t.column(c).slice(0, 1) for c in keys], *rest], names=[*keys, "labelled", "n", "centre", "_products"])

    from pyspark.sql.pandas.types import to_arrow_schema

    pa_schema = to_arrow_schema(schema)
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    rows = df.select(*keys, *[F.col(c).cast("double").alias(f"_z{i}") for i, c in enumerate([*xs, y])], weight.alias("_w"))
    per_task = rows.mapInArrow(add_up, f"{head}, {body}")
    per_key = written(per_task.groupBy(*keys).applyInArrow(together, f"{head}, {body}"), "sums")  # a row per key
    centre = per_key.agg(F.max_by("centre", F.struct("n", *keys)).alias("_to"))

    @F.pandas_udf("array<double>")
    def moved(g: pd.Series, at: pd.Series, to: pd.Series) -> pd.Series:
        return pd.Series([moved_sums(np.asarray(x, float), np.asarray(a, float) - np.asarray(t, float)).tolist() for x, a, t in zip(g, at, to)])

    j = per_key.withColumn("_k", F.lit(1)).join(F.broadcast(centre.withColumn("_k", F.lit(1))), "_k")
    return j.select(*keys, F.col("labelled").cast("long").alias("labelled"), F.col("n").cast("long").alias("n"), F.col("_to").alias("centre"), moved("_products", "centre", "_to").alias("_products"))


def square(g) -> np.ndarray:
    """The symmetric matrix of an upper triangle by rows."""
    k = int((np.sqrt(8 * len(g) + 1) - 1) / 2)
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = g
    return m + m.T - np.diag(np.diag(m))


def moved_sums(g: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Sums of products of 1 and columns, all but the 1 raised ``by``: the upper triangle again."""
    m = square(g)
    t = np.eye(len(m))
    t[1:, 0] = by
    return (t @ m @ t.T)[np.triu_indices(len(m))]


def split_sums(sums: DataFrame, k: int) -> DataFrame:
    """``_products`` of ``product_sums`` as the columns that ``fit_sums`` reads, for ``k`` columns with the intercept."""
    at = {p: i for i, p in enumerate(zip(*(x.tolist() for x in np.triu_indices(k + 1))))}
    named = {f"a{i}_{j}": at[i, j] for i in range(k) for j in range(i, k)} | {f"b{i}": at[i, k] for i in range(k)} | {"yy": at[k, k]}
    return sums.select(*[c for c in sums.columns if c != "_products"], *[F.col("_products")[i].alias(n) for n, i in named.items()])


def date_sums(df: DataFrame, xs: list[str], y: str, w: str | None = None, keys=("date",)) -> DataFrame:
    """Weighted X'X, X'y and sums per key, of columns less their ``centre``; one row per key (date, regime, ...)."""
    return split_sums(product_sums(df, xs, y, w, keys).where("n > 0").drop("labelled"), len(xs) + 1)


def sum_cols(k: int) -> list[str]:
    return ["n", "yy"] + [f"a{i}_{j}" for i in range(k) for j in range(i, k)] + [f"b{i}" for i in range(k)]


def fit_sums(sums: DataFrame, k: int, alpha: Column | float) -> DataFrame:
    """Standardised ridge per row of sums: ``coef`` on raw features (intercept first)
    and ``scaled`` on standardised ones.  Each row is one k-by-k system."""
    tri = F.array(*[F.col(f"a{i}_{j}") for i in range(k) for j in range(i, k)])
    rhs = F.array(*[F.col(f"b{i}") for i in range(k)])
    a = F.lit(float(alpha)) if isinstance(alpha, (int, float)) else alpha

    @F.pandas_udf("struct<coef:array<double>,scaled:array<double>>")
    def solve(xtx: pd.Series, xty: pd.Series, al: pd.Series, centre: pd.Series) -> pd.DataFrame:
        out = []
        for t, b, lam, at in zip(xtx, xty, al, centre):
            at = np.asarray(at, float)
            m = np.zeros((k, k))
            m[np.triu_indices(k)] = np.asarray(t, float)
            m = m + m.T - np.diag(np.diag(m))
            b = np.asarray(b, float)
            n, mu, ym = m[0, 0], m[0, 1:] / m[0, 0], b[0] / m[0, 0]
            cov = m[1:, 1:] / n - np.outer(mu, mu)
            sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
            sd[sd < 1e-12] = 1.0
            c = (b[1:] / n - mu * ym) / sd
            beta = np.linalg.solve(cov / np.outer(sd, sd) + (lam / n + 1e-12) * np.eye(k - 1), c)
            raw = beta / sd
            ym = ym + at[-1]
            out.append(([ym - float(raw @ (mu + at[:-1])), *raw.tolist()], [ym, *beta.tolist()]))
        return pd.DataFrame({"coef": [o[0] for o in out], "scaled": [o[1] for o in out]})

    return sums.withColumn("_f", solve(tri, rhs, a, F.col("centre"))).withColumns({"coef": F.col("_f.coef"), "scaled": F.col("_f.scaled")}).drop("_f")


def squared_errors(k: int) -> Column:
    """Squared errors of ``coef`` over the rows behind the sums of a row."""
    tri = F.array(*[F.col(f"a{i}_{j}") for i in range(k) for j in range(i, k)])
    rhs = F.array(*[F.col(f"b{i}") for i in range(k)])

    @F.pandas_udf("double")
    def errors(xtx: pd.Series, xty: pd.Series, yy: pd.Series, coef: pd.Series, centre: pd.Series) -> pd.Series:
        out = []
        for t, b, q, c, at in zip(xtx, xty, yy, coef, centre):
            c, at = np.asarray(c, float), np.asarray(at, float)
            u = np.array([c[0] + c[1:] @ at[:-1] - at[-1], *c[1:], -1.0])  # the error, in columns less their centre
            m = np.zeros((k + 1, k + 1))
            m[:k, :k] = square(t)
            m[:k, k] = m[k, :k] = b
            m[k, k] = q
            out.append(float(u @ m @ u))
        return pd.Series(out)

    return errors(tri, rhs, "yy", "coef", "centre")


def weight_table(fit: DataFrame, xs: list[str], keys: list[str], col: str = "scaled") -> DataFrame:
    names = F.array(*[F.lit(n) for n in ["intercept", *xs]])
    return fit.select(*keys, "n", F.explode(F.arrays_zip(names.alias("feature"), F.col(col).alias("weight"))).alias("s")).select(*keys, "n", "s.*")


def apply_coef(xs: list[str], coef: str = "coef") -> Column:
    return reduce(lambda a, ix: a + F.col(coef)[ix[0] + 1] * F.col(ix[1]), enumerate(xs), F.col(coef)[0])


def regime_fits(df: DataFrame, xs: list[str], y: str, alpha: float = 10.0, min_n: int = 30) -> DataFrame:
    return fit_sums(date_sums(df, xs, y, keys=("regime",)).where(F.col("n") >= min_n), len(xs) + 1, alpha)


def ml_fits(df: DataFrame, xs: list[str], y: str, label: str, weight: str, alpha: float = 10.0, trees: int = 10) -> DataFrame:
    """Ridge, logistic, boosted and forest fits with sample weights on standardised
    features, as rows (model, feature, weight).  Scores scale to 0.5 / std."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    spark = df.sparkSession
    ok = reduce(lambda d, c: d.where(F.col(c).isNotNull()), [*xs, y, label, weight], df)
    ok = written(ok.select(*dict.fromkeys([*xs, y, label, weight])), "fit-rows")  # read by the scaler and the fits
    data = VectorAssembler(inputCols=xs, outputCol="_raw").transform(ok)
    data = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(data).transform(data)
    data = data.select("features", F.col(y).alias("_y"), F.col(label).cast("double").alias("_l"), F.col(weight).alias("_w")).persist()
    total = data.agg(F.sum("_w")).first()[0]
    common = {"featuresCol": "features", "weightCol": "_w"}
    models = {
        "ridge": LinearRegression(labelCol="_y", elasticNetParam=0.0, regParam=alpha / total, standardization=False, solver="normal", **common),
        "logistic": LogisticRegression(labelCol="_l", regParam=1.0 / total, standardization=False, maxIter=50, **common),
        "boosted": GBTRegressor(labelCol="_y", maxIter=trees, maxDepth=3, seed=7, **common),
        "forest": RandomForestClassifier(labelCol="_l", numTrees=trees, maxDepth=4, seed=7, **common),
    }
    rows = []
    for name, est in models.items():
        m = est.fit(data)
        vec = m.coefficients if hasattr(m, "coefficients") else m.featureImportances
        rows += [(name, f, float(v)) for f, v in zip(xs, vec.toArray())]
        if name == "ridge":
            sd = m.transform(data).agg(F.stddev_samp("prediction")).first()[0] or 0.0
            rows.append((name, "score_scale", 0.5 / sd if sd > 0 else 1.0))
    data.unpersist()
    return spark.createDataFrame(rows, "model string, feature string, weight double")


# --- splits -----------------------------------------------------------------------


def equal_windows(df: DataFrame, n: int = 4, ratio: float = 0.7) -> DataFrame:
    """n equal calendar windows, each split into train and test by ``ratio``."""
    span = df.agg(F.min("date").alias("a"), F.datediff(F.max("date"), F.min("date")).alias("days"))
    w = span.select("a", F.floor(F.col("days") / n).cast("int").alias("len"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("window"))
    start = F.expr("date_add(a, window * len)")
    cut = F.expr(f"date_add(a, window * len + cast(floor(len * {ratio}) as int))")
    return w.select("window", start.alias("train_start"), F.date_sub(cut, 1).alias("train_end"), cut.alias("test_start"), F.expr("date_add(a, (window + 1) * len - 1)").alias("test_end"))


def rolling_windows(df: DataFrame, train_months: int = 24, test_months: int = 3, step_months: int = 3) -> DataFrame:
    span = df.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    starts = span.select("b", F.explode(F.sequence(F.col("a"), F.col("b"), F.expr(f"interval {step_months} months"))).alias("train_start"))
    w = starts.select("b", "train_start", F.add_months("train_start", train_months).alias("test_start"))
    w = w.withColumn("test_end", F.date_sub(F.add_months("test_start", test_months), 1)).where("test_end <= b")
    return w.select((F.row_number().over(Window.orderBy("train_start")) - 1).alias("window"), "train_start", F.date_sub("test_start", 1).alias("train_end"), "test_start", "test_end")


def tag_dates(df: DataFrame, splits: DataFrame) -> DataFrame:
    """(date, window, part) rows: the range join runs over calendar dates and a
    handful of windows, never over the panel."""
    parts = splits.select("window", F.explode(F.array(
        F.struct(F.lit("train").alias("part"), F.col("train_start").alias("lo"), F.col("train_end").alias("hi")),
        F.struct(F.lit("test").alias("part"), F.col("test_start").alias("lo"), F.col("test_end").alias("hi")))).alias("s")).select("window", "s.*")
    dates = df.select("date").distinct()
    return dates.join(F.broadcast(parts), (F.col("date") >= F.col("lo")) & (F.col("date") <= F.col("hi"))).select("date", "window", "part")


def split_counts(df: DataFrame, splits: DataFrame) -> DataFrame:
    per = df.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return tag_dates(df, splits).join(F.broadcast(per), "date").groupBy("window", "part").agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("n_dates"), F.sum("n").alias("n_rows"))


def expanding_folds(df: DataFrame, folds: int = 5, embargo: int = 5, purge: int = 5) -> DataFrame:
    """Expanding walk-forward tags by calendar index: dates fall into ``folds + 1``
    blocks; fold k tests block k and trains on everything before it less the embargo
    and label horizon."""
    cal = calendar(df).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    size = F.floor(F.col("_n") / (folds + 1))
    t = cal.select("date", "idx", size.alias("_s"), F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"))
    start = F.col("fold") * F.col("_s") + 1
    end = F.when(F.col("fold") == folds, F.lit(2**31)).otherwise(start + F.col("_s") - 1)
    part = F.when(F.col("idx").between(start, end), "test").when(F.col("idx") < start - embargo - purge, "train")
    return t.select("date", "idx", "fold", part.alias("part")).where("part is not null")


def walk_forward(df: DataFrame, xs: list[str], y: str, alphas=(10.0,), folds: int = 5) -> DataFrame:
    """Out-of-sample scores of every test row for each fold and ridge penalty.

    Rows are summed per date once; folds add up dates; penalties reuse the sums.
    """
    test = _scored_folds(df, xs, y, alphas, folds)
    each = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"_score_{i}").alias("score")) for i, a in enumerate(alphas)]))
    return test.select("ticker", "date", "fold", each.alias("s"), F.col(y).alias("fwd")).select("ticker", "date", "fold", "s.*", "fwd").where(F.col("score").isNotNull())


def _scored_folds(df: DataFrame, xs: list[str], y: str, alphas, folds: int) -> DataFrame:
    """Every test row with ``_score_<i>`` of each penalty."""
    df = stored_rows(df, xs, y)
    tags = expanding_folds(df, folds)
    k = len(xs) + 1
    sums = date_sums(df, xs, y)
    train = sums.join(F.broadcast(tags.where("part = 'train'").select("date", "fold")), "date").groupBy("fold").agg(F.first("centre").alias("centre"), *[F.sum(c).alias(c) for c in sum_cols(k)])
    grid = train.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(alphas) - 1))))
    grid = grid.withColumn("alpha", F.array(*[F.lit(float(a)) for a in alphas])[F.col("_i")])
    fit = fit_sums(grid, k, F.col("alpha")).groupBy("fold").agg(*[F.max(F.when(F.col("_i") == i, F.col("coef"))).alias(f"_coef_{i}") for i in range(len(alphas))])
    test = df.join(F.broadcast(tags.where("part = 'test'").select("date", "fold")), "date").join(F.broadcast(fit), "fold")
    return test.select("ticker", "date", "fold", y, *[apply_coef(xs, f"_coef_{i}").alias(f"_score_{i}") for i in range(len(alphas))])


def penalty_metrics(df: DataFrame, xs: list[str], y: str, alphas, folds: int = 5) -> DataFrame:
    """``fold_metrics`` of ``walk_forward``: a test row holds its scores under all penalties, and its label is ranked once."""
    test = _scored_folds(df, xs, y, alphas, folds)
    got = IC.score_metrics(test, [f"_score_{i}" for i in range(len(alphas))], y, "fold")
    alpha = F.array(*[F.lit(float(a)) for a in alphas])[F.substring("score", 8, 9).cast("int")]
    return got.select("fold", alpha.alias("alpha"), "ic", "accuracy", "auc", "n")


def fold_metrics(oos: DataFrame) -> DataFrame:
    return IC.metric_triple(oos, "score", "fwd", ["fold", "alpha"])


def best_alpha(metrics: DataFrame) -> DataFrame:
    g = metrics.groupBy("alpha").agg(F.avg("ic").alias("mean_ic"), F.avg("auc").alias("mean_auc"), F.count(F.lit(1)).alias("folds"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_ic"), "alpha")))  # one row per penalty


def chained_report(oos: DataFrame, k: int = 5, leak_ic: float = 0.3) -> DataFrame:
    """Per window: daily top-k returns chained, Sharpe, IC and a leakage flag."""
    oos = cut_lineage(oos)  # read by three branches
    # one test window per date, so scores of two windows never overlap
    daily = TR.top_k_daily(oos, "score", "fwd", k).join(F.broadcast(oos.select("date", "fold").distinct()), "date")
    g = daily.groupBy("fold").agg(F.count(F.lit(1)).alias("n_days"), F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"), F.sum(F.log1p("ret")).alias("_l"))
    ic = spearman(oos, ["fold"], "score", "fwd", "ic", 3).select("fold", "ic")
    j = g.join(ic, "fold")
    return j.select("fold", "n_days", (W.safe_div("_m", F.nullif(F.col("_s"), F.lit(0.0))) * M.ROOT).alias("sharpe"), (F.exp("_l") - 1).alias("total"), "ic",
                    (F.abs("ic") > leak_ic).alias("leak_suspect"), F.row_number().over(Window.orderBy(F.desc("ic"), "fold")).alias("rank"))


def chained_totals(oos: DataFrame, k: int = 10) -> DataFrame:
    """One row over all test windows in a chain: Sharpe and yearly growth of the daily top-k returns, and the
    correlation of scores and forward returns over all rows."""
    daily = TR.top_k_daily(oos, "score", "fwd", k)
    g = daily.agg(F.count(F.lit(1)).alias("n_days"), F.avg("ret").alias("_m"), F.stddev_samp("ret").alias("_s"), F.sum(F.log1p("ret")).alias("_l"))
    ic = oos.agg(corr_of("score", "fwd").alias("ic")).withColumn("_k", F.lit(1))
    j = g.withColumn("_k", F.lit(1)).join(F.broadcast(ic), "_k")  # single rows
    return j.select("n_days", (W.safe_div("_m", F.nullif(F.col("_s"), F.lit(0.0))) * M.ROOT).alias("sharpe"), (F.exp(F.col("_l") * 252.0 / F.col("n_days")) - 1).alias("cagr"), "ic")


def leakage_check(full: DataFrame, truncated: DataFrame, cols: list[str], tol: float = 1e-9) -> DataFrame:
    """Compare features computed on data cut at a date with the full run there: rows, rows the full run
    lacks, and differing values per column."""
    there = full.select("ticker", "date", *cols, F.lit(True).alias("_there"))
    j = truncated.select("ticker", "date", *[F.col(c).alias(f"_t_{c}") for c in cols]).join(there, ["ticker", "date"], "left")
    aggs = [F.count_if(F.col("_there").isNull()).alias("missing")]
    for c in cols:
        same = (F.abs(F.col(c) - F.col(f"_t_{c}")) <= tol) | (F.col(c).isNull() & F.col(f"_t_{c}").isNull())
        aggs.append(F.count_if(~F.coalesce(same, F.lit(False))).alias(f"diff_{c}"))
    return j.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)


def blend_grid(preds: DataFrame, a: str, b: str, y: str, steps: int = 10) -> DataFrame:
    """Rank IC of w*a + (1-w)*b over a weight grid, best first.  The grid explodes on
    rows; ranks per grid point are by value range."""
    ws = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    g = cut_lineage(preds.select(a, b, y)).select(a, b, y, F.explode(ws).alias("w")).withColumn("blend", F.round(F.col("w") * F.col(a) + (1 - F.col("w")) * F.col(b), 10))
    ic = spearman(g, ["w"], "blend", y, "ic", 3)
    return ic.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ic"), "w")))  # one row per grid point


def latent_factors_fixed(df: DataFrame, xs: list[str], train_end: str, k: int = 3) -> DataFrame:
    """Standardise and project on components fitted before ``train_end``."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ok = written(reduce(lambda d, c: d.where(F.col(c).isNotNull()), xs, df.select(*dict.fromkeys(["ticker", "date", *xs]))), "factor-rows")  # read by both fits and the result
    v = VectorAssembler(inputCols=xs, outputCol="_raw").transform(ok)
    tr = v.where(F.col("date") < F.lit(train_end).cast("date"))
    sc = StandardScaler(inputCol="_raw", outputCol="_std", withMean=True).fit(tr)
    pca = PCA(k=k, inputCol="_std", outputCol="_pc").fit(sc.transform(tr))
    out = pca.transform(sc.transform(v)).withColumn("_a", vector_to_array("_pc"))
    return out.select("ticker", "date", *[F.col("_a")[i].alias(f"factor_{i + 1}") for i in range(k)])


def latent_factors_expanding(df: DataFrame, xs: list[str], k: int = 3, min_rows: int = 100) -> DataFrame:
    """Components refitted every month on everything before it.

    Months reduce to sums of products, running totals over months give every refit's
    moments, and each month's small eigenproblem is one row.
    """
    p = len(xs)
    ok = reduce(lambda d, c: d.where(F.col(c).isNotNull()), xs, df).withColumn("month", F.trunc("date", "month"))
    ok, cx = centred(ok, xs)
    s = ok.groupBy("month").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(cx)],
                                *[F.sum(cx[i] * cx[j]).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p)])
    w = Window.partitionBy("_g").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)  # one row per month
    names = [c for c in s.columns if c != "month"]
    run = s.withColumn("_g", F.lit(1)).select("month", *[F.sum(c).over(w).alias(c) for c in names]).where(F.col("n") >= min_rows)

    @F.pandas_udf("struct<mu:array<double>,load:array<array<double>>>")
    def fit(n: pd.Series, sums: pd.Series, prods: pd.Series) -> pd.DataFrame:
        mus, loads = [], []
        for n_, s_, q_ in zip(n, sums, prods):
            mu = np.asarray(s_, float) / n_
            m = np.zeros((p, p))
            m[np.triu_indices(p)] = np.asarray(q_, float) / n_
            cov = m + m.T - np.diag(np.diag(m)) - np.outer(mu, mu)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-24))
            _, vec = np.linalg.eigh(cov / np.outer(sd, sd))
            vec = vec[:, ::-1][:, :k]
            vec = vec * np.sign(vec[np.abs(vec).argmax(axis=0), range(k)])
            mus.append(mu.tolist())
            loads.append((vec / sd[:, None]).T.tolist())
        return pd.DataFrame({"mu": mus, "load": loads})

    sums = F.array(*[F.col(f"s{i}") for i in range(p)])
    prods = F.array(*[F.col(f"q{i}_{j}") for i in range(p) for j in range(i, p)])
    model = run.withColumn("_f", fit("n", sums, prods)).select("month", "_f.mu", "_f.load")
    j = ok.join(F.broadcast(model), "month")  # one row per month
    facs = {f"factor_{c + 1}": reduce(lambda a, ix: a + (F.col(ix[1]) - F.col("centre")[ix[0]] - F.col("mu")[ix[0]]) * F.col("load")[c][ix[0]], enumerate(xs), F.lit(0.0)) for c in range(k)}
    return j.withColumns(facs).drop("centre")


def accept_model(old: DataFrame, new: DataFrame, metric: str, min_wins: float = 0.5, min_ratio: float = 0.85) -> DataFrame:
    """Accept a retrained model that is strictly better on a share of the windows, and whose mean metric keeps
    ``min_ratio`` of the old one's; a mean that is not positive sets no ratio."""
    j = old.select("fold", F.col(metric).alias("a")).join(new.select("fold", F.col(metric).alias("b")), "fold")
    g = j.agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("b") > F.col("a")).alias("won"), F.avg("a").alias("old_mean"), F.avg("b").alias("new_mean"))
    ratio = W.safe_div("new_mean", F.nullif(F.col("old_mean"), F.lit(0.0)))
    return g.withColumn("ratio", ratio).withColumn("accept", (F.col("windows") > 0) & (F.col("won") / F.col("windows") >= min_wins) & ((F.col("old_mean") <= 1e-6) | (F.col("new_mean") >= min_ratio * F.col("old_mean"))))


# --- model search -----------------------------------------------------------------

#: Parameter ranges of the boosted-tree search (fixed values), and of the ridge search.
TREE_RANGES = {"trees": [100, 200, 300], "depth": [2, 3, 4], "rate": [0.01, 0.05, 0.1], "subsample": [0.6, 0.8, 1.0]}
RIDGE_RANGE = [0.001, 0.01, 0.1, 1.0, 10.0]
BINS = 32
#: Rows that fits side by side may hold together; each keeps its own in memory or, beyond that, on disk.
ROWS_AT_ONCE = 20_000_000


def blocked_folds(df: DataFrame, folds: int = 3, embargo: int = 0) -> DataFrame:
    """(date, fold, part): the last ``folds`` of ``folds + 1`` equal blocks of dates are
    tested in turn, each on all dates before it less ``embargo``; what does not divide evenly comes first."""
    cal = calendar(df).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))  # one row per date
    size = F.floor(F.col("_n") / (folds + 1))
    t = cal.select("date", F.col("idx"), "_n", size.alias("_s"), F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"))
    start = F.col("_n") - (folds + 1 - F.col("fold")) * F.col("_s") + 1
    part = F.when(F.col("idx").between(start, start + F.col("_s") - 1), "test").when(F.col("idx") < start - embargo, "train")
    return t.select("date", "fold", part.alias("part")).where("part is not null and _s > 0")


def drawn_settings(ranges: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """``n`` different settings from the grid of ``ranges`` (all, if fewer), by a seeded draw."""
    sizes = [len(v) for v in ranges.values()]
    total = int(np.prod(sizes))
    picks = np.random.default_rng(seed).choice(total, size=min(n, total), replace=False)
    return [{k: v[int(i)] for (k, v), i in zip(ranges.items(), np.unravel_index(p, sizes))} for p in picks]


def binned(df: DataFrame, xs: list[str], y: str, fit_on: Column | None = None, bins: int = BINS) -> DataFrame:
    """ticker, date, ``fwd`` and a vector of bin numbers, written once for all fits that read it.

    Bins are quantiles of the rows ``fit_on`` picks (the earliest training block, so that no
    later row shapes them); nulls get a bin of their own.
    """
    from pyspark.ml.feature import Bucketizer, VectorAssembler

    ok = df.where(F.col(y).isNotNull()).select("ticker", "date", F.col(y).cast("double").alias("fwd"), *[F.coalesce(F.col(x).cast("double"), F.lit(float("nan"))).alias(x) for x in xs])
    probs = [i / bins for i in range(1, bins)]
    cuts = (ok if fit_on is None else ok.where(fit_on)).approxQuantile(xs, probs, 0.001)  # bins per feature
    edges = [[-float("inf"), *sorted({c for c in q}), float("inf")] for q in cuts]
    out = [f"_b{i}" for i in range(len(xs))]
    b = Bucketizer(splitsArray=edges, inputCols=xs, outputCols=out, handleInvalid="keep").transform(ok)
    # bins are ordered numbers, not categories
    b = b.select("ticker", "date", "fwd", *[F.col(c).alias(c, metadata={}) for c in out])
    return written(VectorAssembler(inputCols=out, outputCol="features").transform(b).select("ticker", "date", "fwd", "features"), "binned")


def tree_fit(train: DataFrame, setting: dict, seed: int = 42):
    """One boosted-tree regression on a ``binned`` table."""
    from pyspark.ml.regression import GBTRegressor

    gbt = GBTRegressor(labelCol="fwd", maxIter=setting["trees"], maxDepth=setting["depth"], stepSize=setting["rate"], subsamplingRate=setting["subsample"], maxBins=BINS + 2, seed=seed)
    return gbt.fit(train)


def r_squared(scored: DataFrame, score: str = "prediction", y: str = "fwd") -> float | None:
    """1 - squared errors over squared deviations from the tested rows' own mean; None where these do not vary."""
    m = scored.agg(F.avg(y)).first()[0]
    if m is None:
        return None
    e, t = scored.agg(F.sum((F.col(y) - F.col(score)) ** 2), F.sum((F.col(y) - m) ** 2)).first()
    return 1 - e / t if t > 0 else None


def fits_at_once(data: DataFrame, workers: int) -> int:
    """How many fits run side by side: small tables leave cores idle, a large one fills them alone."""
    return min(workers, max(1, ROWS_AT_ONCE // max(1, data.count())))


def side_by_side(jobs: list, workers: int) -> list:
    """Runs functions that start Spark jobs in a few driver threads; results in order."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    with ThreadPoolExecutor(max_workers=workers) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]]


def tree_search(df: DataFrame, xs: list[str], y: str, ranges: dict[str, list] = TREE_RANGES, draws: int = 10, folds: int = 3, seed: int = 42, workers: int = 4, dates: DataFrame | None = None) -> DataFrame:
    """Randomised search of boosted trees over blocked folds, as rows (setting, its values, fold, n, r2, mean_r2, rank).

    All fits read one binned table and run side by side as far as memory goes; the driver keeps one score
    per setting and fold.  Rank 1 has the highest mean; ties go to the earlier draw.
    With ``dates`` (a row for each date with a label) ``df`` is read twice, for its quantiles and its bins, and not written.
    """
    df = stored_rows(df, xs, y) if dates is None else df
    tags = written(blocked_folds(df.where(F.col(y).isNotNull()) if dates is None else dates, folds), "folds")
    first = tags.where("fold = 1 and part = 'train'").agg(F.max("date")).first()[0]
    data = binned(df, xs, y, F.col("date") <= F.lit(first))
    tagged = {(f, p): data.join(F.broadcast(tags.where((F.col("fold") == f) & (F.col("part") == p)).select("date")), "date") for f in range(1, folds + 1) for p in ("train", "test")}
    settings = drawn_settings(ranges, draws, seed)

    def job(i, f):
        def run():
            test = tree_fit(tagged[f, "train"], settings[i], seed).transform(tagged[f, "test"])
            return test.count(), r_squared(test)

        return run

    at = [(i, f) for i in range(len(settings)) for f in range(1, folds + 1)]
    scores = side_by_side([job(i, f) for i, f in at], fits_at_once(data, workers))
    rows = [(i, *[float(v) for v in settings[i].values()], f, n, r) for (i, f), (n, r) in zip(at, scores)]
    out = df.sparkSession.createDataFrame(rows, "setting int, " + ", ".join(f"{k} double" for k in ranges) + ", fold int, n long, r2 double")
    means = out.groupBy("setting").agg(F.avg("r2").alias("mean_r2"))
    ranked = means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("mean_r2"), "setting")))  # one row per setting
    return out.join(F.broadcast(ranked), "setting")


def ridge_search(df: DataFrame, xs: list[str], y: str, alphas=tuple(RIDGE_RANGE), folds: int = 3) -> DataFrame:
    """The same over ridge penalties: (alpha, fold, n, r2, mean_r2, rank), from one pass of sums per date.

    Training sums of a fold are those of its dates added up, and so are those of its tested rows, which give their squared
    errors under every penalty: rows are read once and none is kept.
    """
    sums = written(product_sums(df, xs, y), "date-sums")  # a row per date
    tags = blocked_folds(sums.where("labelled > 0"), folds)
    k = len(xs) + 1
    parts = split_sums(sums.where("n > 0").drop("labelled"), k).join(F.broadcast(tags), "date").groupBy("fold", "part").agg(F.first("centre").alias("centre"), *[F.sum(c).alias(c) for c in sum_cols(k)])
    parts = written(parts, "fold-sums")
    grid = parts.where("part = 'train'").withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    fit = fit_sums(grid, k, F.col("alpha")).select("fold", "alpha", "coef")
    test = parts.where("part = 'test'").join(F.broadcast(fit), "fold")
    g = test.withColumn("_e", squared_errors(k)).withColumn("_v", (F.col("yy") - F.col("b0") * F.col("b0") / F.col("n")) / F.col("n"))
    out = g.select("alpha", "fold", "n", (1 - W.safe_div(F.col("_e"), F.nullif(F.col("_v") * F.col("n"), F.lit(0.0)))).alias("r2"))
    mean = F.avg("r2").over(Window.partitionBy("alpha"))
    return out.withColumn("mean_r2", mean).withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc_nulls_last("mean_r2"), "alpha")))  # a row per penalty and fold


def tree_walk_forward(df: DataFrame, xs: list[str], y: str, setting: dict, folds: int = 3, embargo: int = 10, seed: int = 42, workers: int = 3, dates: DataFrame | None = None) -> DataFrame:
    """Out-of-sample scores of every tested row by boosted trees refitted for each blocked fold; ``dates`` as in ``tree_search``."""
    df = stored_rows(df, xs, y) if dates is None else df
    tags = written(blocked_folds(df.where(F.col(y).isNotNull()) if dates is None else dates, folds, embargo), "folds")
    first = tags.where("fold = 1 and part = 'train'").agg(F.max("date")).first()[0]
    data = binned(df, xs, y, F.col("date") <= F.lit(first))
    part = lambda f, p: data.join(F.broadcast(tags.where((F.col("fold") == f) & (F.col("part") == p)).select("date")), "date")
    models = side_by_side([lambda f=f: tree_fit(part(f, "train"), setting, seed) for f in range(1, folds + 1)], fits_at_once(data, workers))
    scored = [m.transform(part(f, "test")).select("ticker", "date", F.lit(f).alias("fold"), F.col("prediction").alias("score"), "fwd") for f, m in enumerate(models, 1)]
    return reduce(DataFrame.unionByName, scored)
