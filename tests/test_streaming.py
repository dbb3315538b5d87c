"""Several micro-batches give what one batch gives."""

import os

import pytest

from barweave.sources import tables as S
from barweave.streaming import streams as Q


@pytest.fixture(scope="module")
def landing(spark, sf, tmp_path_factory):
    """Event files written one after the other, so they arrive in time order."""
    root = str(tmp_path_factory.mktemp("landing"))
    e = S.table(spark, sf, "events")
    for i, (a, b) in enumerate((("2024-01-01", "2024-01-10 07:25:13"), ("2024-01-10 07:25:13", "2024-01-20 18:50:01"), ("2024-01-20 18:50:01", "2024-03-01"))):
        part = e.where(f"ts >= '{a}' and ts < '{b}'").coalesce(1)
        part.write.parquet(f"{root}/tmp{i}")
        name = next(f for f in os.listdir(f"{root}/tmp{i}") if f.endswith(".parquet"))
        os.rename(f"{root}/tmp{i}/{name}", f"{root}/part-{i}.parquet")
    return root


CASES = {
    "totals": Q.callback_totals, "latest": lambda s: Q.latest_signal(s, 10, 5), "poll": Q.latest_per_key, "intents": Q.idempotent_intents,
    "bars": Q.tick_bars, "slide": Q.sliding_stats, "sessions": Q.activity_sessions, "kill": Q.kill_switch,
}


@pytest.mark.parametrize("name", CASES)
def test_batches_equal_one_batch(name, spark, sf, landing):
    def rows(stream):
        out = CASES[name](stream)
        cols = sorted(out.columns)
        return sorted(tuple(round(r[c], 6) if isinstance(r[c], float) else str(r[c]) for c in cols) for r in out.collect())

    one = rows(Q.event_stream(spark, sf))
    many = rows(Q.event_stream(spark, landing, "part-*.parquet", 1))
    assert one and one == many


@pytest.mark.parametrize("name", ["bars", "sessions", "kill"])
def test_a_restarted_job_goes_on(name, spark, sf, landing, tmp_path):
    """Two files, a stop, the third file: the same as all at once."""
    run = {"bars": Q.tick_bars, "sessions": Q.activity_sessions, "kill": Q.kill_switch}[name]
    feed, folder = tmp_path / "feed", str(tmp_path / "job")
    feed.mkdir()

    def rows(out):
        cols = sorted(out.columns)
        return sorted(tuple(round(r[c], 6) if isinstance(r[c], float) else str(r[c]) for c in cols) for r in out.collect())

    for i in (0, 1, 2):
        if i != 1:
            for k in (0, 1) if i == 0 else (2,):
                os.link(f"{landing}/part-{k}.parquet", feed / f"part-{k}.parquet")
            out = rows(run(Q.event_stream(spark, str(feed), "part-*.parquet", 1), folder=folder))
    assert out == rows(run(Q.event_stream(spark, sf)))


def test_an_hour_in_two_batches_is_one_row(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    for i, rows in enumerate([[(1, "2024-01-01 10:05:00", "purchase", 5.0)], [(2, "2024-01-01 10:45:00", "purchase", 6.0)], [(3, "2024-01-01 09:59:00", "error", 4.0)]]):
        d = spark.createDataFrame([(e, t, 1, k, v, None) for e, t, k, v in rows], schema.replace("ts timestamp", "ts string")).selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "value", "props")
        d.coalesce(1).write.parquet(str(tmp_path / f"t{i}"))
        name = next(f for f in os.listdir(tmp_path / f"t{i}") if f.endswith(".parquet"))
        os.rename(tmp_path / f"t{i}" / name, feed / f"part-{i}.parquet")
        os.utime(feed / f"part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    got = [(r.hour.hour, r.equity) for r in Q.kill_switch(Q.event_stream(spark, str(feed), "part-*.parquet", 1)).orderBy("hour").collect()]
    assert got == [(9, 996.0), (10, 1007.0)]


def outcomes(spark, feed, folder=None):
    def side(kind):
        return Q.event_stream(spark, str(feed), "part-*.parquet", 1).where(f"side = '{kind}'").selectExpr("*", "get_json_object(props, '$.k') as order_key")

    rows = Q.order_status(side("click"), side("purchase"), folder=folder).collect()
    return {r["order_id"]: (r["status"], r["fill_id"], r["fills"]) for r in rows}, len(rows)


def test_every_order_is_filled_expired_or_pending(spark, tmp_path):
    """Fills at and past the bound, two fills of one order, late files; a stop and a second run in the same folder."""
    feed = tmp_path / "feed"
    feed.mkdir()
    day = lambda d, h=12: f"2024-01-{d:02} {h:02}:00:00"
    order = lambda i, d, k, h=12: (i, day(d, h), 1, "click", 5.0, f'{{"k": "{k}"}}')
    fill = lambda i, d, k, h=12: (i, day(d, h), 1, "purchase", 6.0, f'{{"k": "{k}"}}')
    batches = [
        [order(1, 1, "a"), order(2, 1, "b"), order(3, 1, "c"), order(4, 2, "d"), fill(101, 1, "x")],
        [fill(102, 4, "a"), fill(103, 4, "b", 13), fill(104, 3, "d"), fill(105, 2, "d"), order(5, 4, "e")],
        [order(6, 20, "f"), fill(106, 20, "y"), fill(107, 6, "e")],
    ]
    schema = "event_id long, ts string, user_id long, event_type string, value double, props string"

    def arrive(i):
        spark.createDataFrame(batches[i], schema).selectExpr("event_id", "cast(ts as timestamp) as ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(str(tmp_path / f"t{i}"))
        name = next(f for f in os.listdir(tmp_path / f"t{i}") if f.endswith(".parquet"))
        os.rename(tmp_path / f"t{i}" / name, feed / f"part-{i}.parquet")
        os.utime(feed / f"part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))

    folder = str(tmp_path / "job")
    arrive(0)
    got, n = outcomes(spark, feed, folder)
    assert n == 4 and {s for s, _, _ in got.values()} == {"pending"}
    arrive(1)
    got, n = outcomes(spark, feed, folder)
    assert n == 5 and got[1] == ("filled", 102, 1) and got[4] == ("filled", 105, 2) and got[5] == ("pending", None, 0) and got[2][0] == got[3][0] == "pending"
    arrive(2)
    resumed, n = outcomes(spark, feed, folder)
    assert n == 6 and resumed == outcomes(spark, feed)[0]
    assert resumed == {1: ("filled", 102, 1), 2: ("expired", None, 0), 3: ("expired", None, 0), 4: ("filled", 105, 2), 5: ("filled", 107, 1), 6: ("pending", None, 0)}


@pytest.mark.parametrize("name", ["totals", "latest", "poll", "intents"])
def test_other_jobs_go_on_in_their_folder(name, spark, sf, landing, tmp_path):
    run = {"totals": Q.callback_totals, "latest": lambda s, **k: Q.latest_signal(s, 10, 5, **k), "poll": Q.latest_per_key, "intents": Q.idempotent_intents}[name]
    feed, folder = tmp_path / "feed", str(tmp_path / "job")
    feed.mkdir()
    rows = lambda out: sorted(str(tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in sorted(out.columns))) for r in out.collect())
    for parts in ((0, 1), (2,)):
        for k in parts:
            os.link(f"{landing}/part-{k}.parquet", feed / f"part-{k}.parquet")
        out = rows(run(Q.event_stream(spark, str(feed), "part-*.parquet", 1), folder=folder))
    assert out == rows(run(Q.event_stream(spark, sf)))


def test_a_poll_reads_its_table_of_record_and_new_batches_only(spark, sf, landing, tmp_path):
    """Outputs of batches that the table of record holds are read no more: without them, later polls say the same."""
    feed, folder = tmp_path / "feed", tmp_path / "job"
    feed.mkdir()
    rows = lambda out: sorted(str(r) for r in out.select("start", "ticker", "ticks", "close").collect())
    for k in (0, 1, 2):
        os.link(f"{landing}/part-{k}.parquet", feed / f"part-{k}.parquet")
        out = rows(Q.tick_bars(Q.event_stream(spark, str(feed), "part-*.parquet", 1), folder=str(folder)))
        for old in folder.glob("bars/batch=*"):
            old.rename(tmp_path / f"gone-{k}-{old.name}")
        assert rows(Q.tick_bars(Q.event_stream(spark, str(feed), "part-*.parquet", 1), folder=str(folder))) == out
    assert out == rows(Q.tick_bars(Q.event_stream(spark, sf)))


def test_batches_of_a_stopped_job_are_folded_in(spark, landing, tmp_path):
    """A job that stopped after its batches, before its table of record was written."""
    feed, folder = tmp_path / "feed", tmp_path / "job"
    feed.mkdir()
    for k in (0, 1, 2):
        os.link(f"{landing}/part-{k}.parquet", feed / f"part-{k}.parquet")
    run = lambda: sorted(str(r) for r in Q.latest_per_key(Q.event_stream(spark, str(feed), "part-*.parquet", 1), folder=str(folder)).collect())
    want = run()
    (folder / "poll-record").rename(tmp_path / "lost")
    assert run() == want
