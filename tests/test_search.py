"""Model searches against single fits and plain formulas."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.operators import learning as L

XS = ["a", "b"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(82):
        for t in range(6):
            a, b = (float(x) for x in rng.standard_normal(2))
            rows.append((t, dt.date(2021, 1, 1) + dt.timedelta(i), a, None if rng.random() < 0.05 else b, (a > 0) * 1.0 + 0.1 * float(rng.standard_normal())))
    return spark.createDataFrame(rows, "ticker long, date date, a double, b double, y double").repartition(3).cache()


def test_blocks_are_those_of_the_definition(data):
    tags = {}
    for r in L.blocked_folds(data, 3, 2).collect():
        tags.setdefault((r["fold"], r["part"]), []).append((r["date"] - dt.date(2021, 1, 1)).days)
    # 82 dates: four blocks of 20, two dates over at the start
    for f, start in ((1, 22), (2, 42), (3, 62)):
        assert sorted(tags[f, "test"]) == list(range(start, start + 20)) and sorted(tags[f, "train"]) == list(range(start - 2))
    assert L.blocked_folds(data.limit(0), 3).count() == L.blocked_folds(data.where("date < '2021-01-04'"), 3).count() == 0


def test_draws_are_seeded_and_different():
    a, b = L.drawn_settings(L.TREE_RANGES, 10), L.drawn_settings(L.TREE_RANGES, 10)
    assert a == b and len({tuple(s.values()) for s in a}) == 10 and a != L.drawn_settings(L.TREE_RANGES, 10, 7)
    assert len(L.drawn_settings({"trees": [1, 2], "depth": [1]}, 10)) == 2
    assert all(s[k] in v for s in a for k, v in L.TREE_RANGES.items())


def test_search_scores_equal_single_fits(spark, data):
    ranges = {"trees": [2, 4], "depth": [1, 2], "rate": [0.5], "subsample": [1.0]}
    out = L.tree_search(data, XS, "y", ranges, draws=3).collect()
    assert len(out) == 9 and {r["rank"] for r in out} == {1, 2, 3}
    tags = L.blocked_folds(data, 3)
    last = tags.where("fold = 1 and part = 'train'").agg(F.max("date")).first()[0]
    table = L.binned(data, XS, "y", F.col("date") <= F.lit(last))
    for r in [out[0], out[-1]]:
        part = lambda p: table.join(tags.where((F.col("fold") == r["fold"]) & (F.col("part") == p)).select("date"), "date")  # noqa: B023, E731
        test = L.tree_fit(part("train"), {k: int(r[k]) if k in ("trees", "depth") else r[k] for k in ranges}).transform(part("test")).select("fwd", "prediction").toPandas()
        want = 1 - ((test.fwd - test.prediction) ** 2).sum() / ((test.fwd - test.fwd.mean()) ** 2).sum()
        assert r["r2"] == pytest.approx(want, abs=1e-9) and r["n"] == len(test)
    best = min(out, key=lambda r: r["rank"])
    assert best["mean_r2"] == max(r["mean_r2"] for r in out) > 0.5


def test_ridge_search_equals_numpy(data):
    got = {(r["alpha"], r["fold"]): r for r in L.ridge_search(data, ["a"], "y", (0.0, 50.0)).collect()}
    p = data.toPandas()
    days = (p["date"].map(lambda x: (x - dt.date(2021, 1, 1)).days)).to_numpy()
    for f, start in ((1, 22), (2, 42), (3, 62)):
        tr, te = p[days < start], p[(days >= start) & (days < start + 20)]
        for alpha in (0.0, 50.0):
            x, y = tr["a"].to_numpy(), tr["y"].to_numpy()
            z = (x - x.mean()) / x.std()
            beta = (z @ (y - y.mean())) / (len(x) + alpha) / x.std()
            pred = y.mean() + beta * (te["a"] - x.mean())
            want = 1 - ((te["y"] - pred) ** 2).sum() / ((te["y"] - te["y"].mean()) ** 2).sum()
            assert got[alpha, f]["r2"] == pytest.approx(want, abs=1e-8) and got[alpha, f]["n"] == len(te)
    assert {r["rank"] for r in got.values()} == {1, 2}


def test_walk_forward_scores_every_tested_row_once(data):
    out = L.tree_walk_forward(data, XS, "y", {"trees": 3, "depth": 2, "rate": 0.5, "subsample": 1.0}, embargo=2).toPandas()
    assert len(out) == 60 * 6 and not out.duplicated(["ticker", "date"]).any()
    assert np.corrcoef(out["score"], out["fwd"])[0, 1] > 0.8


def test_a_search_builds_its_features_once(spark, tmp_path):
    built = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def feature(i):
        built.add(1)
        return float(i * 7 % 13)

    rows = spark.range(400).select((F.col("id") % 4).alias("ticker"), F.expr("date_add(date'2024-01-01', cast(id div 4 as int))").alias("date"), feature("id").alias("x"), ((F.col("id") * 11 % 17) / 10.0).alias("y"))
    assert L.ridge_search(rows, ["x"], "y").count() == 15
    assert built.value == 400


def test_a_ridge_search_keeps_sums_alone(data, monkeypatch):
    """Rows are read once and none is written: folds, fits and errors come from a row of sums per date."""
    written, real = [], L.written
    monkeypatch.setattr(L, "written", lambda df, label: written.append(df.columns) or real(df, label))
    assert L.ridge_search(data, XS, "y", (1.0,)).count() == 3
    assert written and not [c for c in written if "ticker" in c]


def test_sums_are_those_of_numpy_for_any_keys_and_weights(spark):
    rng = np.random.default_rng(9)
    rows = [(("u", "v", None)[i % 3], i % 2, 1e6 + float(rng.standard_normal()), None if i % 17 == 0 else float(rng.standard_normal()), float(rng.standard_normal()), float(rng.uniform(0.5, 2))) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, h int, a double, b double, y double, w double").repartition(5)
    got = {(r["g"], r["h"]): r for r in L.date_sums(df, ["a", "b"], "y", "w", ("g", "h")).collect()}
    assert len(got) == 6
    for (g, h), r in got.items():
        z = np.array([[1.0, q[2] - r["centre"][0], q[3] - r["centre"][1], q[4] - r["centre"][2], q[5]] for q in rows if q[0] == g and q[1] == h and q[3] is not None])
        m = (z[:, :4] * z[:, 4:]).T @ z[:, :4]
        assert r["n"] == len(z) and r["yy"] == pytest.approx(m[3, 3]) and r["b2"] == pytest.approx(m[2, 3], abs=1e-6)
        assert all(r[f"a{i}_{j}"] == pytest.approx(m[i, j], rel=1e-6, abs=1e-6) for i in range(3) for j in range(i, 3))


def test_metrics_of_penalties_equal_those_of_each_score(data):
    """Ties, null rows and several folds; the label is ranked once, not once for each penalty."""
    tied = data.withColumn("a", F.round("a", 1)).withColumn("b", F.when(F.col("b").isNotNull(), F.lit(0.0))).withColumn("y", F.round("y", 1))
    alphas = (0.1, 10.0)
    want = {(r["fold"], r["alpha"]): r for r in L.fold_metrics(L.walk_forward(tied, XS, "y", alphas, 2)).collect()}
    got = {(r["fold"], r["alpha"]): r for r in L.penalty_metrics(tied, XS, "y", alphas, 2).collect()}
    assert got.keys() == want.keys() and len(got) == 4
    for k, r in got.items():
        assert r["n"] == want[k]["n"] and all(r[c] == pytest.approx(want[k][c], abs=1e-12) for c in ("ic", "accuracy", "auc"))


def test_the_registered_search_draws_from_the_whole_ranges(spark, sf, monkeypatch):
    from barweave.plans import panel as PP

    asked = []
    monkeypatch.setattr(PP, "panel", lambda *a, **k: None)
    monkeypatch.setattr(PP.L, "tree_search", lambda *a, **k: asked.append((a, k)))
    PP.panel_tree_search(spark, sf)
    (args, named), = asked
    assert len(args) == 3 and not {"ranges", "draws", "folds"} & named.keys()


def test_dates_given_leave_rows_unwritten_and_scores_the_same(data, monkeypatch):
    ranges, dates = {"trees": [2], "depth": [2], "rate": [0.5], "subsample": [1.0]}, data.where("y is not null").select("date").distinct()
    want = {r["fold"]: (r["n"], r["r2"]) for r in L.tree_search(data, XS, "y", ranges, draws=1).collect()}
    monkeypatch.setattr(L, "stored_rows", lambda *a: pytest.fail("rows are written"))
    assert {r["fold"]: (r["n"], pytest.approx(r["r2"])) for r in L.tree_search(data, XS, "y", ranges, draws=1, dates=dates).collect()} == want
    assert L.fits_at_once(data, 4) == 4
    monkeypatch.setattr(L, "ROWS_AT_ONCE", 600)
    assert L.fits_at_once(data, 4) == 1
