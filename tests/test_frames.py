"""Frames, quantiles and date moments by running sums against plain sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.functions import windows as W
from barweave.operators import cross_section as X
from barweave.plans.catalog import OFFSET, rounded, rounded_arrays


def plain(a, b, n):
    out = []
    for i in range(len(a)):
        x, y = a[max(0, i - n + 1) : i + 1], b[max(0, i - n + 1) : i + 1]
        ok = ~(np.isnan(x) | np.isnan(y))
        x, y = x[ok], y[ok]
        if len(x):
            out.append((len(x), x.mean(), ((x - x.mean()) ** 2).sum(), y.mean(), ((y - y.mean()) ** 2).sum(), ((x - x.mean()) * (y - y.mean())).sum()))
        else:
            out.append((0, *[np.nan] * 5))
    return np.array(out).T


@pytest.mark.parametrize("n", [2, 20, 252])
@pytest.mark.parametrize("kind", ["walk", "steps", "far"])
def test_frame_moments(n, kind):
    rng = np.random.default_rng(5)
    a = {"walk": 1e5 + np.cumsum(rng.normal(size=700)), "steps": 100 + rng.integers(0, 2, 700) * 0.1, "far": np.where(np.arange(700) < 350, 1e7, 1e-3) + rng.normal(size=700) * 1e-4}[kind]
    a[rng.random(700) < 0.1] = np.nan
    b = rng.normal(size=700)
    for other in (None, b):
        got, want = W.frame_moments(a, n, other), plain(a, a if other is None else other, n)
        ok = want[0] > 0
        for g, w in zip(got, want):
            np.testing.assert_allclose(g[ok], w[ok], rtol=1e-7, atol=1e-8)


def test_flat_frames_have_no_spread():
    size, mean, dev, *_ = W.frame_moments(np.array([3.3] + [0.1] * 30), 20)
    assert (dev[20:] == 0.0).all() and (mean[20:] == 0.1).all() and dev[5] > 0


def test_quantiles_and_extremes():
    a = np.random.default_rng(2).normal(size=300)
    a[::7] = np.nan
    got = W.quantile_kernel(60, 1, 0.95, 0.7)(a)
    for i in range(1, 300):
        w = a[max(0, i - 59) : i + 1]
        np.testing.assert_allclose(got[:, i], np.nanquantile(w, [0.95, 0.7]), rtol=1e-12)
        assert W._extreme(a, 20, True)[i] == np.nanmax(a[max(0, i - 19) : i + 1])


def test_rows_left_out_do_not_count(spark):
    df = spark.range(40).select(F.lit(1).alias("ticker"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").cast("double").alias("x"))
    got = W.add_frames(df, {"where even": lambda k: k["x"] % 2 == 0, "m": ("mean", "x", 3, 3), "l": ("lag", "x", 1, 0)}).orderBy("date").collect()
    assert [r.x for r in got] == [2.0 * i for i in range(20)]
    assert got[1].m is None and got[2].m == 2.0 and got[5].l == 8.0


def test_keys_share_a_stream_of_batches(spark):
    """Keys that span batches, share one or have no name count on their own, and none gets a stream of its own."""
    rows = [(t, i, float(i * i % 11)) for t, n in ((1, 3), (2, 25), (3, 1), (None, 9), (4, 8)) for i in range(n)]
    df = spark.createDataFrame(rows[::-1], "ticker long, day int, x double").select("ticker", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).alias("date"), "day", "x")
    out = W.add_frames(df, {"where small": lambda k: k["x"] < 10.0, "m": ("mean", "x", 4, 1), "n": lambda k: np.full(len(k["x"]), float(len(k["x"])))})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for most in ("1", "7", "10000"):
            spark.conf.set(size, most)
            got = {(r.ticker, r.day): (r.m, r.n) for r in out.collect()}
            want = {}
            for t in (1, 2, 3, None, 4):
                mine = [(i, x) for k, i, x in rows if k == t and x < 10.0]
                for j, (i, _) in enumerate(mine):
                    want[t, i] = (pytest.approx(np.mean([x for _, x in mine[max(0, j - 3) : j + 1]])), float(len(mine)))
            assert got == want
    finally:
        spark.conf.set(size, before)


def test_date_moments_of_many_columns(spark):
    rows = spark.range(3000).select((F.col("id") % 7).alias("k"), F.rand(3).alias("a"), F.when(F.col("id") % 5 > 0, F.rand(4) + 1e6).alias("b"), F.lit(0.1).alias("c"))
    rows = rows.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("k").cast("int"))).repartition(5)
    want = {r.date: r for r in rows.groupBy("date").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("m", F.avg), ("s", F.stddev_samp)) for c in "abc"]).collect()}
    for r in X.date_moments(rows, ["a", "b", "c"]).collect():
        w = want[r.date]
        for c in "ab":
            assert r[f"_mean_{c}"] == pytest.approx(w[f"m_{c}"], rel=1e-12) and r[f"_sd_{c}"] == pytest.approx(w[f"s_{c}"], rel=1e-8)
        assert r["_sd_c"] < 1e-12


def test_rounding_forms_agree(spark):
    values = [0.1234565, -0.0078125, 1e12 + 0.3, -3.5e-7, 0.0, None, 123456.7890125, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(F.when(~F.isnan("x"), rounded(F.col("x"))).alias("a"), rounded_arrays(F.col("x")).alias("b"), F.when(~F.isnan("x"), F.round(F.col("x") + OFFSET, 6)).alias("c")).collect()
    assert all(r.a == r.b == r.c for r in got)


def test_rings_of_a_bucket_equal_those_of_its_tickers(spark, tmp_path):
    from barweave.streaming import streams as Q

    rows = spark.range(900).select(F.col("id").alias("event_id"), F.timestamp_seconds((F.col("id") * 7919) % 1000).alias("ts"), (F.col("id") % 11).alias("user_id"), F.lit("view").alias("event_type"), F.col("id").cast("double").alias("value"), F.lit("").alias("props"))
    rows = rows.withColumn("user_id", F.when(F.col("event_id") % 50 > 0, F.col("user_id")))
    for i in range(3):
        rows.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rings = Q.poll_update(Q.recent_rings(Q.event_stream(spark, str(tmp_path / "in"), "*.parquet", 1), 5, 4, 3), "rings", ["ticker", "salt"], str(tmp_path / "out"))
    got, want = {}, {}
    for r in rings.collect():
        n, items = got.get(r.ticker, (0, []))
        got[r.ticker] = n + r.n, sorted([*items, *zip(r.ts, r.score)], reverse=True)[:5]
    for r in rows.where("user_id is not null").withColumn("us", F.unix_micros("ts")).collect():
        n, items = want.get(r.user_id, (0, []))
        want[r.user_id] = n + 1, sorted([*items, (r.us, r.value)], reverse=True)[:5]
    assert got == want
