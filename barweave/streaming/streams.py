"""Streams over tick and intent events.

Every query is an ordinary streaming plan; ``poll`` runs it over what is there
(``availableNow``) and returns the result table.  Sinks are versioned by batch id,
so a batch replayed after a failure overwrites its own output only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barweave.session import run_dir


def event_stream(spark: SparkSession, path: str, pattern: str = "events.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Tick stream from a folder of event files."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path).select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("ticker"), F.col("event_type").alias("side"), F.col("value").alias("score"), "props")


def _places(spark: SparkSession, label: str, folder: str | None) -> tuple[str, str]:
    """(output, checkpoint) of a stream.  With ``folder`` a restarted job goes on where it stopped;
    without, a run has its own and starts anew."""
    root = folder.rstrip("/") if folder else run_dir(spark, label)
    return f"{root}/{label}", f"{root}/{label}-checkpoint"


def _run(writer, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def on_batches(stream: DataFrame, callback: Callable[[DataFrame, int], None], label: str, mode: str = "append", folder: str | None = None) -> None:
    """Call back once per micro-batch."""
    _run(stream.writeStream.outputMode(mode).foreachBatch(callback), _places(stream.sparkSession, label, folder)[1])


def _found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in whatever store Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().toString() for f in found or []]


def poll_update(stream: DataFrame, label: str, keys: list[str], folder: str | None = None) -> DataFrame:
    """Run in update mode and read the newest version of each key.

    A batch writes only the keys it changed, under its number, so a replayed batch replaces
    its own output.  Each poll ends with a table of record: the last one with the batches
    after it folded in.  A later poll reads that and its own batches, however many came before; batches
    that a stopped job left behind are the next ones in number.
    """
    spark = stream.sparkSession
    out, checkpoint = _places(spark, label, folder)

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    _run(stream.writeStream.outputMode("update").foreachBatch(write), checkpoint)
    # a table counts once its success file is there; numbers are of equal width
    record = max(_found(spark, f"{out}-record/upto=*/_SUCCESS"), default=None)
    last = int(record.split("upto=")[-1].split("/")[0]) if record else -1
    new = []
    while _found(spark, f"{out}/batch={last + 1}/_SUCCESS"):
        last += 1
        new.append(spark.read.parquet(f"{out}/batch={last}").withColumn("_batch", F.lit(last)))
    if new or not record:
        old = [spark.read.parquet(record.removesuffix("/_SUCCESS")).withColumn("_batch", F.lit(-1))] if record else []
        rows = reduce(DataFrame.unionByName, old + new) if old + new else spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(-1))
        rest = [c for c in rows.columns if c not in (*keys, "_batch")]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_v")).select(*keys, "_v.*")
        record = f"{out}-record/upto={max(last, 0):012}/_SUCCESS"
        newest.write.mode("overwrite").parquet(record.removesuffix("/_SUCCESS"))
    return spark.read.schema(stream.schema).parquet(record.removesuffix("/_SUCCESS")).select(*keys, *[c for c in stream.columns if c not in keys])


def poll_append(stream: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    spark = stream.sparkSession
    out, checkpoint = _places(spark, label, folder)
    _run(stream.writeStream.outputMode("append").format("parquet").option("path", out), checkpoint)
    return spark.read.schema(stream.schema).parquet(out)


def callback_totals(stream: DataFrame, label: str = "callback", folder: str | None = None) -> DataFrame:
    """Bar source to callbacks: each batch leaves a small summary per side."""
    spark = stream.sparkSession
    folder = folder or run_dir(spark, label)
    out = _places(spark, label, folder)[0]

    def on_bars(df: DataFrame, batch: int) -> None:
        df.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total")).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    on_batches(stream, on_bars, label, folder=folder)
    return spark.read.parquet(out).groupBy("side").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def recent_rings(stream: DataFrame, n: int, salts: int = 8, buckets: int = 1024) -> DataFrame:
    """State per bucket of tickers: each ticker's count and its last n (ts, score) pairs seen.

    A call for every ticker would cost more than its rows, so a bucket's tickers are kept and brought up to date
    together; a hot ticker is spread over as many buckets as there are salts.  Rings are kept by time, so late or
    unordered rows land in their place; the last n of the union of a ticker's rings is exact.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState):
        held = state.get if state.exists else ([], [], [], [], [])
        kinds = (np.int64, np.int64, np.int64, np.int64, float)
        who, count, of, ts, val = (np.array(x, dtype=t) for x, t in zip(held, kinds))
        new = [(p["ticker"].to_numpy(np.int64), p["ts_us"].to_numpy(np.int64), p["score"].to_numpy(float)) for p in batches]
        came = np.concatenate([x[0] for x in new])
        who, at = np.unique(np.concatenate([who, came]), return_inverse=True)
        count = np.bincount(at, np.concatenate([count, np.ones(len(came), dtype=np.int64)])).astype(np.int64)
        of = np.concatenate([of, came])
        ts, val = np.concatenate([ts, *[x[1] for x in new]]), np.concatenate([val, *[x[2] for x in new]])
        order = np.lexsort((-ts, of))  # newest first; the earlier arrival first among equal times
        of = of[order]
        last = np.arange(len(of)) - np.searchsorted(of, of) < n
        of, ts, val = of[last], ts[order][last], val[order][last]
        state.update(tuple(x.tolist() for x in (who, count, of, ts, val)))
        changed = np.unique(came)
        lo, hi = np.searchsorted(of, changed), np.searchsorted(of, changed, side="right")
        yield pd.DataFrame({
            "ticker": changed, "salt": key[0], "n": count[np.searchsorted(who, changed)],
            "ts": [ts[i:j].tolist() for i, j in zip(lo, hi)], "score": [val[i:j].tolist() for i, j in zip(lo, hi)],
        })

    salt = F.pmod(F.xxhash64("event_id"), F.lit(salts))
    at = F.coalesce(F.unix_micros("ts"), F.lit(-(2**62)))  # rows without a time come last
    keyed = stream.where(F.col("ticker").isNotNull()).select(F.pmod(F.xxhash64("ticker") + salt, F.lit(buckets)).alias("salt"), "ticker", at.alias("ts_us"), "score")
    cols = "n long, ts array<long>, score array<double>"
    kept = "who array<long>, count array<long>, of array<long>, ts array<long>, score array<double>"
    return keyed.groupBy("salt").applyInPandasWithState(update, f"ticker long, salt long, {cols}", kept, "update", GroupStateTimeout.NoTimeout)


def latest_signal(stream: DataFrame, ring: int = 20, min_rows: int = 50, label: str = "latest", folder: str | None = None) -> DataFrame:
    """Latest score against its own recent mean, once a key has enough history."""
    rings = poll_update(recent_rings(stream, ring), label, ["ticker", "salt"], folder)
    n = rings.groupBy("ticker").agg(F.sum("n").alias("n_rows"))
    items = rings.select("ticker", F.explode(F.arrays_zip("ts", "score")).alias("e")).select("ticker", "e.ts", "e.score")
    w = Window.partitionBy("ticker").orderBy(F.desc("ts"))
    last = items.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= ring)
    g = last.groupBy("ticker").agg(F.max_by("score", "ts").alias("last_score"), F.avg("score").alias("mean_score"), F.max("ts").alias("ts_us"))
    j = g.join(n, "ticker").where(F.col("n_rows") >= min_rows)
    return j.withColumn("signal", F.when(F.col("last_score") > F.col("mean_score"), "Bullish").when(F.col("last_score") < F.col("mean_score"), "Bearish").otherwise("Neutral"))


def recent_snapshot(stream: DataFrame, n: int = 5, label: str = "publish", folder: str | None = None) -> DataFrame:
    """Publish everything to an append sink; the snapshot is the newest n per key."""
    t = poll_append(stream.select("ticker", "event_id", "ts", "score"), label, folder)
    return t.withColumn("rn", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("ts")))).where(F.col("rn") <= n)


def latest_per_key(stream: DataFrame, label: str = "poll", folder: str | None = None) -> DataFrame:
    """One-shot poll: newest row per key.  Partial aggregation runs before the
    shuffle, so a hot key costs one row per task."""
    agg = stream.groupBy("ticker").agg(F.max_by("score", "ts").alias("score"), F.max_by("side", "ts").alias("side"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
    return poll_update(agg, label, ["ticker"], folder)


def idempotent_intents(stream: DataFrame, delay: str = "1 day", label: str = "intents", folder: str | None = None) -> DataFrame:
    """Intents deduplicated on as-of date, ticker and side within the watermark."""
    ids = stream.withColumn("as_of", F.to_date("ts")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["as_of", "ticker", "side"])
    return poll_append(ids.select("as_of", "ticker", "side"), label, folder)


def tick_bars(stream: DataFrame, width: str = "6 hours", delay: str = "1 hour", label: str = "bars", folder: str | None = None) -> DataFrame:
    """Tumbling OHLCV bars; rows later than the watermark are dropped."""
    g = stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "ticker").agg(
        F.min_by("score", "ts").alias("open"), F.max("score").alias("high"), F.min("score").alias("low"), F.max_by("score", "ts").alias("close"), F.count(F.lit(1)).alias("ticks"))
    return poll_update(g.select(F.col("window.start").alias("start"), "ticker", "open", "high", "low", "close", "ticks"), label, ["start", "ticker"], folder)


def sliding_stats(stream: DataFrame, width: str = "6 hours", slide: str = "3 hours", delay: str = "1 hour", alert: float = 20.0, label: str = "slide", folder: str | None = None) -> DataFrame:
    """Sliding mean and deviation per key with an alert on the mean."""
    g = stream.withWatermark("ts", delay).groupBy(F.window("ts", width, slide), "ticker").agg(
        F.avg("score").alias("mean"), F.stddev_samp("score").alias("vol"), F.count(F.lit(1)).alias("n"))
    out = poll_update(g.select(F.col("window.start").alias("start"), "ticker", "mean", "vol", "n"), label, ["start", "ticker"], folder)
    return out.withColumn("alert", F.col("mean") > alert)


def activity_sessions(stream: DataFrame, gap: str = "2 hours", delay: str = "1 hour", label: str = "sessions", folder: str | None = None) -> DataFrame:
    """Sessions of activity per key, emitted once the watermark has passed them."""
    g = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))
    return poll_append(g.select("ticker", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "n", "total"), label, folder)


def enrich(stream: DataFrame, dim: DataFrame, key: str, label: str = "enrich", folder: str | None = None) -> DataFrame:
    """Stream-static left join; unknown keys become 'Other'."""
    cols = [c for c in dim.columns if c != key]
    return poll_append(stream.join(dim, key, "left").fillna("Other", subset=cols).select("event_id", key, "score", *cols), label, folder)


def match_fills(orders: DataFrame, fills: DataFrame, within: str = "3 days", delay: str = "1 hour", label: str = "fills", folder: str | None = None) -> DataFrame:
    """Orders matched to fills of the same order key inside a time bound."""
    o = orders.withWatermark("ts", delay).select(F.col("event_id").alias("order_id"), F.col("ticker").alias("o_ticker"), F.col("order_key").alias("o_key"), F.col("ts").alias("o_ts"), F.col("score").alias("signal_price"))
    f = fills.withWatermark("ts", delay).select(F.col("event_id").alias("fill_id"), F.col("ticker"), F.col("order_key"), F.col("ts").alias("f_ts"), F.col("score").alias("fill_price"))
    cond = (F.col("o_ticker") == F.col("ticker")) & (F.col("o_key") == F.col("order_key")) & (F.col("f_ts") >= F.col("o_ts")) & (F.col("f_ts") <= F.col("o_ts") + F.expr(f"interval {within}"))
    return poll_append(o.join(f, cond).select("order_id", "fill_id", "ticker", "signal_price", "fill_price"), label, folder)


def order_outcomes(orders: DataFrame, fills: DataFrame, within: str = "3 days", delay: str = "1 hour", label: str = "outcomes", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(orders that are decided, the orders seen): each decided order once, with its first fill or as expired.

    A stream-stream left outer join: an order leaves Spark's state with its fills, or without one
    when the watermark of both streams has passed its time bound.  The orders themselves are a
    second sink of the same run, so what is in neither outcome is still pending (``order_status``).
    """
    seen = poll_append(orders.select(F.col("event_id").alias("order_id"), "ticker", F.col("ts").alias("o_ts"), F.col("score").alias("signal_price")), f"{label}-orders", folder)
    o = orders.withWatermark("ts", delay).select(F.col("event_id").alias("order_id"), F.col("ticker").alias("o_ticker"), F.col("order_key").alias("o_key"), F.col("ts").alias("o_ts"), F.col("score").alias("signal_price"))
    f = fills.withWatermark("ts", delay).select(F.col("event_id").alias("fill_id"), "ticker", "order_key", F.col("ts").alias("f_ts"), F.col("score").alias("fill_price"))
    cond = (F.col("o_ticker") == F.col("ticker")) & (F.col("o_key") == F.col("order_key")) & (F.col("f_ts") >= F.col("o_ts")) & (F.col("f_ts") <= F.col("o_ts") + F.expr(f"interval {within}"))
    rows = poll_append(o.join(f, cond, "left_outer").select("order_id", F.col("o_ticker").alias("ticker"), "o_ts", "signal_price", "fill_id", "f_ts", "fill_price"), label, folder)
    first = F.min_by(F.struct("fill_id", "f_ts", "fill_price"), F.when(F.col("fill_id").isNotNull(), F.struct("f_ts", "fill_id")))
    decided = rows.groupBy("order_id").agg(F.first("ticker").alias("ticker"), F.first("signal_price").alias("signal_price"), first.alias("_f"), F.count("fill_id").alias("fills"))
    decided = decided.select("order_id", "ticker", "signal_price", "_f.*", "fills", F.when(F.col("fills") > 0, "filled").otherwise("expired").alias("status"))
    return decided, seen


def order_status(orders: DataFrame, fills: DataFrame, **how) -> DataFrame:
    """Every order seen once: filled (with its first fill and how many there are), expired or pending."""
    decided, seen = order_outcomes(orders, fills, **how)
    waiting = seen.join(decided.select("order_id"), "order_id", "left_anti")
    none = {"fill_id": "long", "f_ts": "timestamp", "fill_price": "double"}
    rest = waiting.select("order_id", "ticker", "signal_price", *[F.lit(None).cast(t).alias(c) for c, t in none.items()], F.lit(0).cast("long").alias("fills"), F.lit("pending").alias("status"))
    return decided.unionByName(rest)


def kill_switch(stream: DataFrame, initial: float = 1000.0, halt: float = 0.10, resume: float = 0.05, delay: str = "1 day", label: str = "kill", folder: str | None = None) -> DataFrame:
    """Running equity, peak, drawdown and halt state per account and hour.

    The stream keeps one profit sum per account and hour in Spark's own state, in event
    time: an hour that several batches share, or that arrives late, is one row all the
    same.  What follows from the order of hours is a window over those few rows.
    """
    pnl = F.when(F.col("side") == "purchase", F.col("score")).when(F.col("side") == "error", -F.col("score")).otherwise(0.0)
    hourly = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "ticker").agg(F.sum(pnl).alias("pnl"))
    s = poll_update(hourly.select("ticker", F.col("window.start").alias("hour"), "pnl"), label, ["ticker", "hour"], folder)
    w = Window.partitionBy("ticker").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("equity", F.round(F.lit(initial) + F.sum("pnl").over(w), 6))
    s = s.withColumn("peak", F.greatest(F.lit(initial), F.max("equity").over(w)))
    s = s.withColumn("drawdown", (F.col("peak") - F.col("equity")) / F.col("peak"))
    event = F.when(F.col("drawdown") > halt, 1).when(F.col("drawdown") < resume, 0)
    s = s.withColumn("halted", F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(0)))
    return s.select("ticker", "hour", "equity", "peak", "drawdown", "halted")
