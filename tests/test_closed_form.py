"""Small cases with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barweave.functions import windows as W
from barweave.operators import features as T
from barweave.operators import metrics as M
from barweave.operators import regimes as R
from barweave.operators import scoring as SC
from barweave.operators import selection as G
from barweave.operators import stateful as ST
from barweave.operators import trades as TR
from barweave.sources import bars as B

D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def equity(spark, values):
    return spark.createDataFrame([(1, day(i), float(v)) for i, v in enumerate(values)], "acct int, date date, equity double")


def test_max_drawdown(spark):
    r = M.max_drawdown(equity(spark, [100, 120, 90, 95, 130])).first()
    assert r.max_drawdown == pytest.approx(-0.25) and r.max_drawdown_returns == pytest.approx(-0.25)


def test_drawdown_spells_count_an_open_one(spark):
    rows = M.drawdown_spells(equity(spark, [100, 90, 100, 110, 99, 105])).orderBy("start").collect()
    assert [(r.start, r.end, r.days) for r in rows] == [(day(1), day(1), 0), (day(4), day(5), 1)]


def test_trade_statistics(spark):
    t = spark.createDataFrame([(0.10, 10.0, "Bullish", 1), (-0.05, -5.0, "Bullish", 2), (0.0, 0.0, "Bullish", 3)], "ret double, pnl double, signal string, holding_days int")
    r = M.trade_stats(t).first()
    assert r.win_rate == pytest.approx(1 / 3) and r.profit_factor == pytest.approx(2.0) and r.hold_median == 2


@pytest.mark.parametrize("vol,want", [(0.05, 3.0), (0.01, 3.0), (0.40, 0.375), (0.06, 2.5)])
def test_vol_target_factor(spark, vol, want):
    assert spark.range(1).select(T.vol_target_factor(F.lit(vol)).alias("x")).first().x == pytest.approx(want)


def test_regime_exposure_path(spark):
    df = spark.createDataFrame([("Bull",), ("Sideways",), ("Bear",), ("Crisis",), ("?",)], "regime string")
    assert [r.s for r in R.regime_lookup(df, R.POSITION_SCALE, "s", default=0.8).collect()] == [1.0, 0.8, 0.6, 0.3, 0.8]


def test_cost_threshold(spark):
    v = spark.range(1).select(SC.cost_threshold(F.lit(0.5)).alias("a"), SC.cost_threshold(F.lit(1.0)).alias("b")).first()
    assert v.a == pytest.approx(0.58)
    assert v.b == pytest.approx(v.a + 0.1)


def test_top_k_ties_and_negative_scores(spark):
    s = spark.createDataFrame([("B", D0, 1.0), ("A", D0, 1.0), ("C", D0, 0.5), ("X", day(1), -3.0), ("Y", day(1), -1.0)], "ticker string, date date, score double")
    w = {(r.ticker, r.date): r.weight for r in G.top_k_weights(s, "score", 2).collect()}
    assert w == {("A", D0): 0.5, ("B", D0): 0.5, ("Y", day(1)): 1.0, ("X", day(1)): 0.0}


def test_slippage_fifty_bps(spark):
    r = spark.range(1).select(TR.slip(F.lit(100.0), F.lit(1), 50.0, True).alias("buy"), TR.slip(F.lit(100.0), F.lit(1), 50.0, False).alias("sell")).first()
    assert (r.buy, r.sell) == (pytest.approx(100.5), pytest.approx(99.5))


def test_kill_switch(spark):
    df = spark.createDataFrame([(1.0, 0.2), (1.0, 0.6), (1.0, None)], "w double, v double")
    assert [r.x for r in df.select(G.kill_switch(F.col("w"), F.col("v"), 0.5, 0.5).alias("x")).collect()] == [1.0, 0.5, 1.0]


def test_composed_size_caps_at_twelve_percent(spark):
    c = lambda w: G.size_composed(F.lit(1e5), F.lit(w), F.lit(1.0), F.lit(1.0))
    r = spark.range(1).select(c(0.5).alias("a"), c(0.05).alias("b"), c(-0.5).alias("c")).first()
    assert (r.a, r.b, r.c) == (pytest.approx(12_000), pytest.approx(5_000), 0.0)


def test_blotter_enters_after_signal(spark):
    p = spark.createDataFrame([("A", day(i), 10.0 + i, 10.0 + i, "Bullish") for i in range(10)], "ticker string, date date, open double, close double, signal string")
    rows = TR.blotter(p, hold=3).collect()
    assert len(rows) == 6 and all(r.entry_date > r.date and r.exit_price == r.entry_price + 3 for r in rows)


def test_universe_ignores_names_without_volume(spark):
    rows = [(t, day(i), 10.0, v) for t, v in (("A", 2e6), ("B", 1e5), ("C", None)) for i in range(5)]
    p = spark.createDataFrame(rows, "ticker string, date date, close double, volume double")
    assert [r.ticker for r in G.liquid_universe(p, 20, 1e6, 1e6).collect()] == ["A"]


def test_flip_filter_needs_a_large_move(spark):
    s = spark.createDataFrame([("A", day(i), v, "Bullish" if v > 0 else "Bearish") for i, v in enumerate([0.05, -0.05, -0.2, 0.0001])], "ticker string, date date, score double, signal string")
    assert [r.accepted for r in ST.flip_filter(s).orderBy("date").collect()] == [True, False, True, True]


def test_ffill_alignment_makes_only_result_rows(spark):
    p = spark.createDataFrame([("A", day(0), 1.0), ("B", day(1), 5.0), ("A", day(3), 2.0)], "ticker string, date date, close double")
    got = {(r.ticker, r.date): r.close for r in B.align_ffill(p, ["close"], backfill=True).collect()}
    assert got == {("A", day(0)): 1.0, ("A", day(1)): 1.0, ("A", day(3)): 2.0, ("B", day(0)): 5.0, ("B", day(1)): 5.0, ("B", day(3)): 5.0}


def test_ewm_equals_the_definition_over_blocks(spark):
    import pandas as pd

    xs = [None if i % 17 == 3 else (i * 37 % 101) / 10 for i in range(300)]
    df = spark.createDataFrame([("A", day(i), v) for i, v in enumerate(xs)], "ticker string, date date, x double")
    got = [r.e for r in W.add_ewm(df, "x", 5, 3, "e").orderBy("date").collect()]
    want = pd.Series(xs, dtype=float).ewm(span=5, min_periods=3).mean()
    assert all((g is None and w != w) or g == pytest.approx(w, abs=1e-9) for g, w in zip(got, want))


def test_pct_rank_equals_pandas(spark):
    import pandas as pd

    xs = [None if i % 11 == 5 else float(i * 7 % 13) for i in range(80)]
    df = spark.createDataFrame([("A", day(i), v) for i, v in enumerate(xs)], "ticker string, date date, x double")
    got = [r.k for r in W.add_pct_rank(df, {"k": ("x", 20, 5)}).orderBy("date").collect()]
    want = pd.Series(xs, dtype=float).rolling(20, min_periods=5).rank(pct=True)
    assert all((g is None and (w != w or xs[i] is None)) or g == pytest.approx(w) for i, (g, w) in enumerate(zip(got, want)))


def test_wide_frames_equal_pandas_and_leave_no_sliding_frame(spark):
    import pandas as pd

    from barweave.operators import features as T

    xs = [None if i % 11 == 5 else 1e9 if i == 3 else 100.37 if i > 150 else (i * 7 % 13) / 10 for i in range(220)]
    df = spark.createDataFrame([("A", day(i), v) for i, v in enumerate(xs)], "ticker string, date date, x double")
    frames = {s: (s, "x", 30, 10) for s in ("mean", "std", "z", "flat_z")}
    got = W.add_frames(df, frames).orderBy("date").collect()
    roll = pd.Series(xs, dtype=float).rolling(30, min_periods=10)
    mean, std = roll.apply(lambda v: v[~(v != v)].mean(), raw=True), roll.apply(lambda v: v[~(v != v)].std(ddof=1), raw=True)
    flat = range(180, 220)
    for i, g in enumerate(got):
        if mean[i] != mean[i]:
            assert g.mean is None and g.std is None and g.z is None
            continue
        assert g.mean == pytest.approx(mean[i])
        assert g.std == (0.0 if i in flat else pytest.approx(std[i]))
        assert g.z == (None if i in flat or xs[i] is None else pytest.approx((xs[i] - mean[i]) / std[i], abs=1e-6))
        assert g.flat_z == (None if xs[i] is None else 0.0 if i in flat else pytest.approx(g.z))
    bars = spark.createDataFrame([("A", day(0), 1.0, 2.0, 0.1)], "ticker string, date date, close double, volume double, r double")
    plan = T.trailing_zscores(bars)._jdf.queryExecution().optimizedPlan().toString()
    assert "-251" not in plan


def test_buckets_grow_with_the_prints():
    from barweave.sources.tables import BUCKET_ROWS, bucket_count

    assert bucket_count(600_000, 8) == 8
    assert bucket_count(216 * BUCKET_ROWS + 1, 12) == 217
