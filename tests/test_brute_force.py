"""Operators without a SQL twin, and the distributed helpers, against plain numpy."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.functions import ranks as K
from barweave.functions import windows as W
from barweave.operators import cross_section as X
from barweave.operators import ic as IC
from barweave.operators import joins
from barweave.operators import learning as L
from barweave.operators import risk as R
from barweave.operators import selection as G

D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def skewed(spark):
    """One date holds most rows and one value a third of them."""
    rng = random.Random(3)
    rows = [(day(0) if rng.random() < 0.7 else day(rng.randint(1, 3)), 7.0 if rng.random() < 0.34 else round(rng.gauss(0, 50), 1), rng.gauss(0, 1)) for _ in range(6000)]
    rows += [(day(1), None, 1.0)]
    pdf = pd.DataFrame(rows, columns=["date", "x", "y"])
    return spark.createDataFrame(rows, "date date, x double, y double"), pdf


def test_ranks_under_skew(skewed):
    df, pdf = skewed
    got = sorted((r.date, r.x, r.k) for r in K.average_rank(df, ["date"], "x", "k", pct=True).collect() if r.x is not None)
    pdf = pdf.dropna(subset=["x"])
    want = sorted(zip(pdf["date"], pdf["x"], pdf.groupby("date")["x"].rank(pct=True)))
    assert len(got) == len(want) and all(a[:2] == b[:2] and a[2] == pytest.approx(b[2]) for a, b in zip(got, want))


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_positions_do_not_depend_on_batches_or_ranges(spark, batch):
    # groups and their ends fall anywhere in batches and ranges; null keys are left out, weights add up
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c", None]) if i % 3 else "a", rng.randint(0, 40), rng.randint(1, 3)) for i in range(600)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, str(batch))
    try:
        df = spark.createDataFrame(rows, "g string, x int, w long")
        got = sorted((r.g, r.x, r._c, r._before, r._n) for r in K.value_positions(df, ["g"], "x", "w").collect())
    finally:
        spark.conf.set(size, before)
    want = []
    for g in "abc":
        mine = [(x, w) for k, x, w in rows if k == g]
        want += [(g, v, sum(w for x, w in mine if x == v), sum(w for x, w in mine if x < v), sum(w for _, w in mine)) for v in sorted({x for x, _ in mine})]
    assert got == want


def test_quantiles_under_skew(skewed):
    df, pdf = skewed
    got = {r.date: (r.a, r.b) for r in K.exact_quantiles(df, ["date"], "x", {"a": 0.5, "b": 0.95}).collect()}
    for d, g in pdf.groupby("date"):
        assert got[d] == (pytest.approx(g["x"].quantile(0.5)), pytest.approx(g["x"].quantile(0.95)))


def test_spearman_under_skew(skewed):
    df, pdf = skewed
    pdf = pdf.dropna()
    got = {r.date: r.ic for r in K.spearman(df, ["date"], "x", "y").collect()}
    for d, g in pdf.groupby("date"):
        assert got[d] == pytest.approx(np.corrcoef(g["x"].rank(), g["y"].rank())[0, 1])


def test_auc(skewed):
    df, pdf = skewed
    pdf = pdf.dropna()
    got = IC.metric_triple(df, "x", "y").first()
    up, dn = pdf[pdf["y"] > 0]["x"].to_numpy(), pdf[pdf["y"] <= 0]["x"].to_numpy()
    want = ((up[:, None] > dn).sum() + 0.5 * (up[:, None] == dn).sum()) / (len(up) * len(dn))
    assert got.auc == pytest.approx(want) and got.n == len(pdf)


@pytest.fixture(scope="module")
def cross(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3):
        n = 40 if i < 2 else 5
        for t in range(n):
            b, s, sec = rng.normal(), rng.normal(10, 2), "ABC"[t % 3]
            rows.append((t, day(i), float(2 * b + 0.3 * s + (sec == "B") + rng.normal()), float(b), float(s), sec))
    return spark.createDataFrame(rows, "ticker long, date date, score double, beta double, size double, sector string"), pd.DataFrame(rows, columns=["ticker", "date", "score", "beta", "size", "sector"])


def test_neutralise_equals_least_squares(cross):
    df, pdf = cross
    got = {(r.ticker, r.date): r.residual for r in X.neutralise(df, "score", ["beta", "size"]).collect()}
    for d, g in pdf.groupby("date"):
        if len(g) < 10:
            want = g["score"].to_numpy()  # too few names: left alone
        else:
            m = np.column_stack([np.ones(len(g)), g["beta"], g["size"], g["sector"] == "B", g["sector"] == "C"]).astype(float)
            want = g["score"] - m @ np.linalg.lstsq(m, g["score"], rcond=None)[0]
        assert [got[(t, d)] for t in g["ticker"]] == pytest.approx(list(want), abs=1e-8)


def test_exposures_vanish_after_neutralising(cross):
    df, _ = cross
    n = X.neutralise(df.where(F.col("date") < F.lit(day(2))), "score", ["beta", "size"])
    for r in X.exposure_report(n, "score", ["beta", "size"]).collect():
        assert abs(r.after) < 1e-8 < abs(r.before)


def test_factor_regression(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = 0.1 + x @ [0.5, -0.2] + 0.05 * rng.normal(size=300)
    df = spark.createDataFrame([(1, day(i), float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))], "acct int, date date, f1 double, f2 double, r double")
    got = {r.factor: r for r in R.factor_regression(df, "r", ["f1", "f2"]).collect()}
    m = np.column_stack([np.ones(300), x])
    beta = np.linalg.lstsq(m, y, rcond=None)[0]
    res = y - m @ beta
    se = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * (res @ res) / 297)
    assert [got[k].coef for k in ("alpha", "f1", "f2")] == pytest.approx(list(beta))
    assert [got[k].t_stat for k in ("alpha", "f1", "f2")] == pytest.approx(list(beta / se))
    assert got["f1"].r2 == pytest.approx(1 - (res @ res) / ((y - y.mean()) ** 2).sum())
    roll = R.rolling_factor_betas(df, "r", ["f1", "f2"], 100).orderBy("date").collect()
    assert len(roll) == 201 and roll[-1].beta_f1 == pytest.approx(np.linalg.lstsq(m[-100:], y[-100:], rcond=None)[0][1])


def test_ridge_and_walk_forward(spark):
    rng = np.random.default_rng(2)
    rows = [(t, day(i), float(a), float(b), float(0.5 * a + 0.1 * b + rng.normal() * 0.1)) for i in range(120) for t in range(5) for a, b in [rng.normal(size=2)]]
    df = spark.createDataFrame(rows, "ticker long, date date, a double, b double, fwd double")
    pdf = pd.DataFrame(rows, columns=["ticker", "date", "a", "b", "fwd"])
    fit = L.fit_sums(L.date_sums(df.withColumn("one", F.lit(1)), ["a", "b"], "fwd", None, ("one",)), 3, 10.0).first()
    z = (pdf[["a", "b"]] - pdf[["a", "b"]].mean()) / pdf[["a", "b"]].std(ddof=0)
    want = np.linalg.solve(z.T @ z + 10 * np.eye(2), z.T @ (pdf["fwd"] - pdf["fwd"].mean()))
    assert fit.scaled[1:] == pytest.approx(list(want))
    oos = L.walk_forward(df, ["a", "b"], "fwd", (0.0,), folds=3)
    tags = L.expanding_folds(df, 3).toPandas()
    # training ends at least embargo + label horizon before the test block
    for f, g in tags.groupby("fold"):
        assert g[g.part == "train"].idx.max() + 10 < g[g.part == "test"].idx.min()
    assert oos.count() == 5 * tags[tags.part == "test"].date.nunique()
    assert all(r.ic > 0.8 for r in L.fold_metrics(oos).collect())


def test_basket_moments(spark):
    rng = np.random.default_rng(4)
    rows = [(t, day(i), float(rng.normal())) for t in range(4) for i in range(60) if rng.random() > 0.2]
    df = spark.createDataFrame(rows, "ticker long, date date, r double")
    wide = pd.DataFrame(rows, columns=["t", "d", "r"]).pivot(index="d", columns="t", values="r")
    for r in joins.basket_moments(df, df.select("ticker")).collect():
        pair = wide[[r.ticker_a, r.ticker_b]].dropna()
        assert (r.n, r.corr, r.cov) == (len(pair), pytest.approx(pair.corr().iloc[0, 1]), pytest.approx(pair.cov().iloc[0, 1]))
    whole = sorted(map(tuple, joins.basket_moments(df, df.select("ticker")).collect()))
    cut = sorted(map(tuple, joins.basket_moments(df, df.select("ticker"), block=2, days=3).collect()))
    assert len(cut) == 6 and all(a[:3] == b[:3] and a[3:] == pytest.approx(b[3:]) for a, b in zip(whole, cut))


def test_exponential_mean_at_any_span(spark):
    rng = np.random.default_rng(9)
    values = [None if rng.random() < 0.1 else float(rng.normal()) for _ in range(600)]
    values[200:420] = [None] * 220
    df = spark.createDataFrame([(1, day(i), v) for i, v in enumerate(values)], "ticker long, date date, x double")
    for span in (1, 5, 20, 60, 120):
        want = pd.Series(values, dtype=float).ewm(span=span, adjust=True, min_periods=3).mean()
        got = [r.e for r in W.add_ewm(df, "x", span, 3, "e").orderBy("date").collect()]
        assert all(g is None if w != w else g == pytest.approx(w, rel=1e-9, abs=1e-12) for g, w in zip(got, want) if not (span == 1 and g is None))


def test_fits_keep_their_digits_at_large_means(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(1e6, 1.0, (400, 2))
    y = x @ [0.5, -2.0] + rng.normal(-3e6, 1.0, 400)
    rows = [(day(i % 20), float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "date date, x1 double, x2 double, y double").withColumn("one", F.lit(1))
    coef = L.fit_sums(L.date_sums(df, ["x1", "x2"], "y", None, ("one",)), 3, 0.0).first()["coef"]
    c = np.linalg.lstsq(x - x.mean(axis=0), y - y.mean(), rcond=None)[0]
    assert coef[1:] == pytest.approx(c, rel=1e-6) and coef[0] + coef[1] * 1e6 + coef[2] * 1e6 == pytest.approx(y.mean() - c @ (x.mean(axis=0) - 1e6), rel=1e-9)


def test_greedy_limits(spark):
    rows = [("A", D0, 1.0, 1.0, "X", 1e9, 10.0), ("B", D0, 0.9, 1.0, "X", 1e9, 10.0), ("C", D0, 0.8, 9.0, "Y", 1e9, 10.0), ("D", D0, 0.7, 1.0, "Y", 1.0, 10.0), ("E", D0, -0.5, 1.0, "Y", 1e9, 10.0)]
    df = spark.createDataFrame([(ord(r[0]), *r[1:]) for r in rows], "ticker long, date date, score double, beta double, sector string, adv double, close double")
    got = {chr(r.ticker): r.reason for r in G.greedy_limits(df, 10, 0.1, max_beta=0.5, max_sector=0.15, max_adv_frac=1.0, equity=1e6).collect()}
    assert got == {"A": "kept", "B": "max_sector_exposure", "C": "max_beta", "D": "liquidity_adv", "E": "kept"}


def test_prune_correlated(spark):
    rng = np.random.default_rng(6)
    a, c = rng.normal(size=60), rng.normal(size=60)
    days = list(range(60))
    rows = [(1, D0, 0.9, days, a.tolist()), (2, D0, 0.8, days, (a + 0.1 * c).tolist()), (3, D0, 0.7, days, c.tolist())]
    df = spark.createDataFrame(rows, "ticker long, date date, score double, days array<int>, rets array<double>")
    assert {r.ticker: r.kept for r in G.prune_correlated(df, 0.7).collect()} == {1: True, 2: False, 3: True}


def test_low_redundancy(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=200), rng.normal(size=200)
    df = spark.createDataFrame([(float(2 * x), float(2 * x + 0.01 * y), float(y)) for x, y in zip(a, b)], "p double, q double, s double")
    kept = {r.feature: r.kept for r in IC.low_redundancy(df, ["p", "q", "s"]).collect()}
    assert kept["s"] and kept["p"] != kept["q"]


def test_bootstraps(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(1, day(i), float(x)) for i, x in enumerate(rng.normal(0.001, 0.01, 250))], "acct int, date date, r double")
    paths = R.bootstrap_paths(df, 20, 5)
    assert paths.groupBy("rep").count().where("count <> 250").count() == 0
    for r in R.confidence_intervals(R.bootstrap_metrics(paths)).collect():
        assert r.low <= r.mid <= r.high
    again = R.bootstrap_paths(df, 20, 5)
    assert paths.agg(F.sum(F.col("r") * F.col("pos"))).first()[0] == pytest.approx(again.agg(F.sum(F.col("r") * F.col("pos"))).first()[0])
    t = spark.createDataFrame([(float(x),) for x in rng.normal(0.01, 0.02, 500).round(2)], "ret double")
    o = R.outcome_summary(R.trade_outcomes(t, 50)).first()
    assert o.log_p05 <= o.log_p50 <= o.log_p95 and o.reps == 50


def test_frontier_weights(spark):
    m = spark.createDataFrame([("A", "A", 0.04), ("B", "B", 0.01), ("A", "B", 0.0), ("B", "A", 0.0)], "a string, b string, cov double")
    mu = spark.createDataFrame([("A", 0.001), ("B", 0.001)], "ticker string, mu double")
    rows = R.frontier(m, mu, 300, 1.0).collect()
    for kind in ("best_sharpe", "min_var"):
        w = {r.ticker: r.w for r in rows if r.kind == kind}
        assert sum(w.values()) == pytest.approx(1.0) and w["B"] == pytest.approx(0.8, abs=0.05)


def test_return_history_of_candidates_only(spark):
    bars = [(t, day(i), None if i == 4 else float(t * i % 7)) for t in (1, 2) for i in range(t, 12)]
    df = spark.createDataFrame(bars, "ticker int, date date, r double")
    cands = spark.createDataFrame([(1, day(9), 0.5), (1, day(10), 0.4), (2, day(2), 0.1), (2, day(4), 0.2)], "ticker int, date date, score double")
    got = {(r.ticker, r.date): (r.score, r.days, r.rets) for r in G.return_history(df, cands, 6).collect()}
    assert len(got) == 4
    for t, d, s in cands.collect():
        last = [(x[1], x[2]) for x in bars if x[0] == t and x[1] <= d][-6:]
        want = [((x - dt.date(1970, 1, 1)).days, r) for x, r in last if r is not None]
        assert got[t, d] == (s, [w[0] for w in want], [w[1] for w in want])


def test_candidate_priority_multiplies_the_penalty_as_sql_does(spark, con):
    rows = [(i, day(0), "Bullish" if i % 2 else "Bearish", "Sideways", round(0.3 + i * 0.002, 4)) for i in range(300)]
    s = spark.createDataFrame(rows, "ticker int, date date, signal string, regime string, score double")
    counts = s.select("ticker", "date", F.col("ticker").cast("long").alias("n_prior"))
    got = {r.ticker: r.priority for r in G.ranked_candidates(s, counts, max_longs=300, max_shorts=300).collect()}
    sql = ", ".join(f"({i}, CAST({v!r} AS DOUBLE), CAST({i} AS HUGEINT))" for i, _, _, _, v in rows)
    want = dict(con.execute(f"SELECT t, row_number() OVER (ORDER BY abs(a) - 0.002*p DESC, t) FROM (VALUES {sql}) v(t, a, p)").fetchall())
    assert got == want
