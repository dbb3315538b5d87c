"""Upserts that touch what changes, damaged logs, and resampling of a fixed size."""

import datetime as dt
import glob
import os

import numpy as np
import pytest
from pyspark.sql import types as T

from barweave.operators import risk
from barweave.sources import files

ROWS = "ticker long, date date, year int, close double, seq int"


def table(spark, *rows):
    return spark.createDataFrame([(t, dt.date(y, 1, d), y, c, s) for t, y, d, c, s in rows], ROWS)


def stamps(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/year=*/*.parquet")}


def load(spark, path, *rows):
    return files.upsert(table(spark, *rows), path, ["ticker", "date", "year"], ["seq"], "year")


def test_upsert_touches_only_what_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    read = lambda: sorted((r.ticker, r.date.year, r.date.day, r.close, r.seq) for r in spark.read.schema(ROWS).parquet(path).collect())
    first = [(1, 2020, 1, 1.0, 0), (1, 2020, 2, 2.0, 0), (2, 2021, 1, 3.0, 0), (2, 2022, 1, None, 0)]
    assert load(spark, path, *first, (1, 2020, 1, 0.5, -1)) == 3 and read() == sorted(first, key=lambda r: r[:3])
    before = stamps(path)
    # the same again, an older version, and nothing at all
    assert load(spark, path, *first) == load(spark, path, (1, 2020, 1, 9.0, -1)) == load(spark, path) == 0 and stamps(path) == before
    # a new key in one year, a newer and an equally new version in another
    assert load(spark, path, (3, 2021, 5, 7.0, 0), (2, 2022, 1, 4.0, 0), (2, 2021, 1, 3.0, 0)) == 2
    after = stamps(path)
    assert {f: s for f, s in after.items() if "2020" in f} == {f: s for f, s in before.items() if "2020" in f}
    assert read() == [(1, 2020, 1, 1.0, 0), (1, 2020, 2, 2.0, 0), (2, 2021, 1, 3.0, 0), (2, 2022, 1, 4.0, 0), (3, 2021, 5, 7.0, 0)]
    assert load(spark, path, (1, 2023, 1, 1.0, 5)) == 1 and len(read()) == 6
    with pytest.raises(TypeError):
        files.upsert(table(spark), path, ["ticker"], [T.LongType()], "year")


def test_damaged_lines_are_set_apart(spark, tmp_path):
    lines = ['{"a": 1, "b": "x"}', "", "   ", '{"a": 2', "no json", '{"a": "word"}', "[1, 2]", "null", '{"b": "y", "more": 5}', '  {"a": 3}', "{}", '{"a": 4, "b": "' + "z" * 100_000 + '"}']
    (tmp_path / "log").write_text("\n".join(lines))
    good, bad = files.read_log(spark, str(tmp_path / "log"), T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())]))
    assert sorted((r.a is None, r.a or 0, (r.b or "")[:1]) for r in good.collect()) == [(False, 1, "x"), (False, 3, ""), (False, 4, "z"), (True, 0, ""), (True, 0, "y")]
    assert sorted(r.line for r in bad.collect()) == sorted(['{"a": 2', "no json", '{"a": "word"}', "[1, 2]", "null"])


def test_splits_are_multinomial():
    rng, w = np.random.default_rng(1), np.array([1, 0, 5, 2, 2, 7, 3])
    draws = np.array([risk.split_total(50, w, rng) for _ in range(4000)])
    p = w / w.sum()
    assert (draws.sum(axis=1) == 50).all() and (draws[:, 1] == 0).all() and (draws >= 0).all()
    assert np.allclose(draws.mean(axis=0), 50 * p, atol=5 * np.sqrt(50 * p * (1 - p) / 4000) + 1e-12)
    cov = 50 * (np.diag(p) - np.outer(p, p))
    assert np.abs(np.cov(draws.T, ddof=0) - cov).max() < 0.8
    assert risk.split_total(9, np.array([4]), rng).tolist() == [9] and risk.split_total(0, w, rng).sum() == 0


@pytest.mark.parametrize("fan", [3, 2048])
def test_resampled_logs_have_the_size_of_the_log(spark, fan):
    rng = np.random.default_rng(2)
    rets = [*np.round(rng.normal(0.01, 0.05, 60), 3).tolist(), *[0.0] * 90, None]
    d = spark.createDataFrame([(r,) for r in rets], "ret double")
    out = risk.trade_outcomes(d, 300, 5, fan).toPandas()
    have = np.array([r for r in rets if r is not None])
    n = len(have)
    assert len(out) == 300 and (out["n"] == n).all()
    logs = np.log1p(have)
    assert abs(out["lg"].mean() - logs.sum()) < 5 * np.sqrt(n * logs.var() / 300)
    assert out["lg"].std() == pytest.approx(np.sqrt(n * logs.var()), rel=0.2)
    again = risk.trade_outcomes(d.repartition(7), 300, 5, fan).toPandas()
    assert np.allclose(out.sort_values("rep")["lg"], again.sort_values("rep")["lg"], atol=1e-12)
    assert risk.trade_outcomes(d.where("ret is null"), 5).count() == 0
    assert [(r.n, r.sharpe) for r in risk.trade_outcomes(d.where("ret = 0"), 2).collect()] == [(90, 0.0)] * 2
