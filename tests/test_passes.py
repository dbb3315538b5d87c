"""Passes that are run anew for the columns a reader needs, and what they leave on disk."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.operators import features as T
from barweave.operators import panel as P
from barweave.plans import panel as PP


def bars_and_market(spark, n=300):
    start = dt.date(2020, 1, 1)
    rng = np.random.default_rng(5)
    rows = []
    for t in (1, 2, 3):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        rows += [(t, start + dt.timedelta(i), float(c * rng.uniform(0.98, 1.02)), float(c * 1.03), float(c * 0.97), float(c), float(rng.integers(100, 900))) for i, c in enumerate(close)]
    b = spark.createDataFrame(rows, "ticker long, date date, open double, high double, low double, close double, volume double")
    return b, b.where("ticker = 2").select(F.lit(1).alias("mkt"), "date", (F.dayofmonth("date") / 1000.0).alias("m"))


def by_key(df):
    return {(r["ticker"], r["date"]): r for r in df.collect()}


@pytest.mark.parametrize("only", [["f_trend"], ["vol_of_vol_20", "direction"], ["capm_alpha", "is_high_vol_stock_regime"], ["rsi_14", "cs_momentum_raw", "mr_rsi_raw"], []])
def test_columns_alone_equal_the_whole_matrix(spark, only):
    b, market = bars_and_market(spark)
    whole = by_key(P.ticker_matrix(b, market))
    part = P.ticker_matrix(b, market, only=only)
    assert part.columns == ["ticker", "date", *only]
    part = by_key(part)
    assert part.keys() == whole.keys() and all(r[c] == whole[k][c] for k, r in part.items() for c in only)


def test_feature_columns_alone_equal_the_whole_matrix(spark):
    b, market = bars_and_market(spark)
    whole = by_key(T.feature_matrix(b, market))
    for only in (["trend_score", "fwd"], ["bb_position", "label", "high_vol_regime"], ["market_corr"]):
        part = by_key(T.feature_matrix(b, market, only=only))
        assert part.keys() == whole.keys() and all(r[c] == whole[k][c] for k, r in part.items() for c in only)


def test_the_panel_keeps_no_wide_rows(spark, sf, monkeypatch):
    """Rows by ticker and date go to disk with the values to rank alone."""
    kept, real = {}, P.written
    monkeypatch.setattr(P, "written", lambda df, label: kept.setdefault(label, df.columns) and real(df, label))
    PP.panel(spark, sf)
    assert [len(c) for c in kept.values() if "ticker" in c] == [7]
    kept.clear()
    PP.training_panel_step(spark, sf)
    assert not [c for c in kept.values() if "ticker" in c]  # no rank nor median is left on in this step


def test_breadth_counts_names_on_a_calendar_with_gaps(spark):
    """Against pandas; no row of the filled calendar is made by Spark."""
    import pandas as pd

    from barweave.operators import cross_section as X

    rng = np.random.default_rng(8)
    start = dt.date(2021, 1, 1)
    rows = [(t, start + dt.timedelta(i), None if rng.random() < 0.03 else float(rng.integers(90, 99))) for t in range(6) for i in range(30 * t, 260) if rng.random() < 0.3]
    df = spark.createDataFrame(rows, "ticker long, date date, close double")
    out = X.breadth(df)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    p = pd.DataFrame(rows, columns=["ticker", "date", "close"]).pivot(index="date", columns="ticker", values="close").astype(float)
    has = ~pd.DataFrame(rows, columns=["ticker", "date", "close"]).assign(x=1.0).pivot(index="date", columns="ticker", values="x").ffill().isna()
    p = p.sort_index().ffill()
    means = {}
    for t in p:
        x = p[t][has[t]]
        means[t] = (x, x.rolling(50, 1).mean().where(x.rolling(50, 1).count() >= 10), x.rolling(200, 1).mean().where(x.rolling(200, 1).count() >= 40), x.shift())
    got = {r["date"]: r for r in out.collect()}
    assert got.keys() == set(p.index)
    for d, r in got.items():
        at = [[v.get(d, np.nan) for v in m] for m in means.values()]
        assert r["up"] == sum(x > q for x, _, _, q in at) and r["down"] == sum(x < q for x, _, _, q in at)
        for name, i in (("above_fast", 1), ("above_slow", 2)):
            n = sum(not np.isnan(a[i]) for a in at)
            assert r[name] == (pytest.approx(sum(a[0] > a[i] for a in at) / n) if n else None)


def test_the_short_panel_keeps_no_wide_rows(spark, sf, monkeypatch):
    from barweave.operators import cross_section as X
    from barweave.plans import cross

    kept, real = {}, X.written
    monkeypatch.setattr(X, "written", lambda df, label: kept.setdefault(label, df.columns) and real(df, label))
    monkeypatch.setattr(X, "cut_lineage", lambda df: pytest.fail("all features of the rows are kept"))
    assert "excess" in cross.training_panel(spark, sf).columns
    assert [len(c) for c in kept.values() if "ticker" in c] == [5]
