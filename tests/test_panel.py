"""The many-column sort against pandas, and what the full panel switches off."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.functions import ranks as K
from barweave.operators import panel as P


def rows(seed, n, dates, values):
    rnd = random.Random(seed)
    pick = lambda: None if rnd.random() < 0.1 else rnd.choice([float(rnd.randint(-values, values)), -0.0])
    start = dt.date(2020, 1, 1)
    return [(i, start + dt.timedelta(rnd.randrange(dates)), rnd.choice(["a", "b", None]), pick(), pick()) for i in range(n)]


@pytest.mark.parametrize(("seed", "n", "dates", "values", "parts"), [(1, 600, 1, 3, 7), (2, 500, 9, 40, 5), (3, 400, 1, 0, 6), (4, 300, 50, 5, 40), (5, 40, 3, 2, 1)])
def test_ranks_and_medians_of_many_columns(spark, seed, n, dates, values, parts):
    """One hot value, one date, many dates: groups and ties that span several ranges."""
    data = rows(seed, n, dates, values)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(before, (str(parts), "false", "17"), strict=True):
            spark.conf.set(k, v)
        d = spark.createDataFrame(data, "ticker long, date date, sector string, x double, y double")
        ranked = K.rank_columns(d, ["ticker", "date"], {"x": ("x", None), "y": ("y", None), "m": ("x", "sector")})
        got = {r["ticker"]: (r["x"], r["y"]) for r in K.percent_ranks(ranked, ["ticker", "date"], ["x", "y"]).collect()}
        med = {(r["date"], r["_sub"]): r["med"] for r in K.medians(ranked, "m", "med").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    p = pd.DataFrame(data, columns=["ticker", "date", "sector", "x", "y"])
    want = p.groupby("date")[["x", "y"]].rank(pct=True)
    for i, x, y in zip(p["ticker"], want["x"], want["y"], strict=True):
        g = got.get(i, (None, None))
        for a, b in zip(g, (x, y), strict=True):
            assert (a is None) == pd.isna(b) and (a is None or a == pytest.approx(b, abs=1e-12))
    p["sub"] = ["" if s is None else f"={s}" for s in p["sector"]]
    for k, v in p.dropna(subset=["x"]).groupby(["date", "sub"])["x"].median().items():
        assert med.pop(k) == pytest.approx(v, abs=1e-12)
    assert not med


def test_a_range_counts_whatever_the_batches(spark):
    """Sorted rows cut into batches at any place give the same counts."""
    import pyarrow as pa

    class Context:
        @staticmethod
        def partitionId():
            return 3

    rnd = random.Random(6)
    data = sorted((rnd.choice("ab"), rnd.randint(0, 1), rnd.randint(0, 3) * 1.0) for _ in range(60))
    t = pa.RecordBatch.from_arrays([pa.array([r[i] for r in data]) for i in range(3)], names=["_name", "date", "_x"])
    work, results = K._count_in_range(["_name", "date"]), set()
    import pyspark

    real, pyspark.TaskContext = pyspark.TaskContext, type("T", (), {"get": staticmethod(lambda: Context)})
    try:
        for size in (1, 2, 7, 60):
            out = pa.Table.from_batches(list(work(t.slice(i, size) for i in range(0, 60, size))))
            results.add(str(out.to_pydict()))
    finally:
        pyspark.TaskContext = real
    assert len(results) == 1
    got = out.to_pylist()
    for r, (name, date, x) in zip(got, data, strict=True):
        same = [d for d in data if d[:2] == (name, date)]
        assert (r["_at"], r["_same"], r["_part"]) == (sum(d[2] < x for d in same), sum(d[2] == x for d in same), 3)
        assert r["_edge"] == ((name, date, x) in (data[0], data[-1]))


def test_short_tickers_and_odd_rows(spark):
    """Tickers under the least number of rows go; flat prices give 0, not an error; an empty panel stays empty."""
    start = dt.date(2020, 1, 1)
    bars = [(t, start + dt.timedelta(i), 10.0, 10.0, 10.0, 10.0 if t == 1 else 10.0 + (i * t) % 7, 100.0) for t, n in ((1, 120), (2, 120), (3, 60)) for i in range(n)]
    b = spark.createDataFrame(bars, "ticker long, date date, open double, high double, low double, close double, volume double")
    market = b.where("ticker = 2").select(F.lit(1).alias("mkt"), "date", (F.dayofmonth("date") / 1000.0).alias("m"))
    m = P.ticker_matrix(b, market, least_rows=100)
    assert {r[0] for r in m.select("ticker").distinct().collect()} <= {1, 2}
    days = market.select("date")
    macro = days.select("date", *[F.lit(None).cast("double").alias(c) for c in P.MACRO])
    sectors = spark.createDataFrame([(2, "x")], "ticker long, sector string")
    full = P.full_panel(m, sectors, macro, days.withColumn("regime", F.lit(None).cast("string")), days.withColumn("bench_fwd", F.lit(0.5)))
    got = full.collect()
    assert got and all(r["regime_label"] == "Normal" and r["sector"] == ("x" if r["ticker"] == 2 else "Other") for r in got)
    assert all(r["rolling_vol_20"] == 0.0 for r in got if r["ticker"] == 1 and sum(q["date"] == r["date"] for q in got) == 1)
    assert all(r["forward_return_excess"] == pytest.approx(r["forward_return"] - 0.5) for r in got)
    assert P.full_panel(m.limit(0), sectors, macro, days.withColumn("regime", F.lit("Bull")), days.withColumn("bench_fwd", F.lit(0.5))).count() == 0
    step = P.full_panel(m, sectors, macro, days.withColumn("regime", F.lit("Bull")), days.withColumn("bench_fwd", F.lit(0.5)), step=0, subset=["ret_5d", "vol_rank", "nothing"])
    assert step.columns == [*P.ALWAYS, "ret_5d", "vol_rank"] and {r["vol_rank"] for r in step.collect()} == {0.0}


def test_a_subset_makes_only_its_own_z_scores(spark, monkeypatch):
    start = dt.date(2020, 1, 1)
    bars = [(t, start + dt.timedelta(i), 10.0, 10.0, 10.0, 10.0 + (i * t) % 7, 100.0 + i % t) for t in (2, 3, 5) for i in range(120)]
    b = spark.createDataFrame(bars, "ticker long, date date, open double, high double, low double, close double, volume double")
    market = b.where("ticker = 2").select(F.lit(1).alias("mkt"), "date", (F.dayofmonth("date") / 1000.0).alias("m"))
    days = market.select("date")
    rest = (spark.createDataFrame([(2, "x")], "ticker long, sector string"), days.select("date", *[F.lit(0.5).alias(c) for c in P.MACRO]), days.withColumn("regime", F.lit("Bull")), days.withColumn("bench_fwd", F.lit(0.1)))
    matrix = P.ticker_matrix(b, market, least_rows=100)
    asked, real = [], P.packed_moments
    monkeypatch.setattr(P, "packed_moments", lambda df, cols, ddof: asked.append(cols) or real(df, cols, ddof))
    part = P.full_panel(matrix, *rest, subset=["vol_rank", "ret_20d_cs_z", "bb_position"])
    assert asked[0] == [*P.IN_PLACE, "vix_zscore", "vol_spike", "ret_20d"]
    key = lambda r: (r["ticker"], r["date"])
    assert sorted(part.collect(), key=key) == sorted(P.full_panel(matrix, *rest).select(*part.columns).collect(), key=key)
