"""Bar history: slicing, upserts, cleaning, validation and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.functions import windows as W


def slice_range(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Inclusive date slice; the filter reaches the scan."""
    return bars.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def range_coverage(bars: DataFrame, start: str, end: str, tolerance: int = 5) -> DataFrame:
    """Per ticker: does the stored history overlap [start, end], and does it cover
    it up to ``tolerance`` days at either end?"""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    span = bars.groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return span.select(
        "ticker",
        "first",
        "last",
        ((F.col("first") <= e) & (F.col("last") >= s)).alias("has_overlap"),
        ((F.datediff(F.col("first"), s) <= tolerance) & (F.datediff(e, F.col("last")) <= tolerance)).alias("covers"),
    )


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last arrival per key.  ``max_by`` combines map-side, so many copies of one
    key never meet in one task as rows."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def merge_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert an extension; the newer source wins per (ticker, date)."""
    both = old.withColumn("src", F.lit(0)).unionByName(new.withColumn("src", F.lit(1)))
    return keep_latest(both, ["ticker", "date"], [F.col("src")])


def append_dedupe(history: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Append a load and keep the last load per key (``load_seq`` orders loads)."""
    return keep_latest(history.unionByName(batch), keys, [F.col("load_seq")])


def previous_business_day(d: Column) -> Column:
    """The weekday strictly before ``d`` (weekday(): Monday is 0)."""
    back = F.when(F.weekday(d) == 0, 3).when(F.weekday(d) == 6, 2).otherwise(1)
    return F.date_sub(d, back)


def freshness(bars: DataFrame, as_of: str) -> DataFrame:
    """Newest stored bar against the last required business day."""
    need = previous_business_day(F.lit(as_of).cast("date"))
    return (
        bars.agg(F.max("date").alias("last_bar"), F.count(F.lit(1)).alias("n_bars"))
        .withColumn("required", need)
        .withColumn("fresh", F.col("last_bar") >= F.col("required"))
        .withColumn("days_behind", F.greatest(F.datediff("required", "last_bar"), F.lit(0)))
    )


def universe_snapshot(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("n_bars")
    )


def with_enough_history(bars: DataFrame, start: str, min_bars: int = 210, min_days: int = 252) -> DataFrame:
    """Tickers whose history before ``start`` is long enough to warm features up."""
    s = F.lit(start).cast("date")
    pre = bars.where(F.col("date") < s).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("pre_bars"), F.min("date").alias("pre_first")
    )
    return pre.where((F.col("pre_bars") >= min_bars) & (F.datediff(s, F.col("pre_first")) >= min_days))


BAR_NUMERICS = ("open", "high", "low", "close", "adj_close", "volume")


def basic_clean(df: DataFrame) -> DataFrame:
    """Lower/trim names, coerce date and numerics (bad text becomes null), drop
    rows without a date."""
    out = df.toDF(*[n.strip().lower().replace(" ", "_") for n in df.columns])
    cols = []
    for f in out.schema.fields:
        x = F.col(f.name)
        if f.name == "date" and isinstance(f.dataType, T.StringType):
            x = x.try_cast("date")
        elif f.name in BAR_NUMERICS and not isinstance(f.dataType, T.DoubleType):
            x = x.try_cast("double")
        cols.append(x.alias(f.name))
    return out.select(*cols).where(F.col("date").isNotNull())


def remove_duplicates(df: DataFrame, arrival: str) -> DataFrame:
    """Drop full-row copies, then keep the last arrival per (ticker, date)."""
    values = [c for c in df.columns if c != arrival]
    once = df.groupBy(*values).agg(F.max(arrival).alias(arrival))
    return keep_latest(once, ["ticker", "date"], [F.col(arrival), *[F.col(v) for v in values]])


def validate_ohlcv(df: DataFrame) -> DataFrame:
    """One row of violation counts in a single pass; the caller decides to raise."""
    bad = {f"bad_{c}": F.count_if(~(F.col(c) > 0) | F.col(c).isNull()) for c in ("open", "high", "low", "close")}
    missing = [c for c in ("date", "open", "high", "low", "close", "volume") if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("date").isNull()).alias("bad_date"),
        *[v.alias(k) for k, v in bad.items()],
        F.count_if(~(F.col("volume") >= 0) | F.col("volume").isNull()).alias("bad_volume"),
        F.count_if(F.col("high") < F.col("low")).alias("crossed"),
    )


CANONICAL = {"open": "Open", "high": "High", "low": "Low", "close": "Close", "adj_close": "AdjClose", "volume": "Volume"}


def process_market_data(df: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Clean, de-duplicate, keep valid bars and rename to the canonical names."""
    ok = basic_clean(df).transform(lambda d: remove_duplicates(d, arrival))
    prices = [c for c in ("open", "high", "low", "close") if c in ok.columns]
    for c in prices:
        ok = ok.where(F.col(c) > 0)
    ok = ok.where(F.col("volume") >= 0)
    return ok.select("ticker", "date", *[F.col(k).alias(v) for k, v in CANONICAL.items() if k in ok.columns])


def tag_delisted(bars: DataFrame, requested_end: str) -> DataFrame:
    """Last bar before the requested end marks the ticker as delisted that day."""
    last = F.max("date").over(Window.partitionBy("ticker"))
    return bars.withColumn("delisted_date", F.when(last < F.lit(requested_end).cast("date"), last))


def calendar(df: DataFrame) -> DataFrame:
    """Dates in use with a running index.  One row per calendar day, so a single
    ordered window (and a broadcast) is bounded whatever the data size."""
    return df.select("date").distinct().select(
        "date", F.row_number().over(Window.orderBy("date")).alias("idx")
    )


def on_calendar(bars: DataFrame) -> DataFrame:
    """Attach the calendar index of every bar."""
    return bars.join(F.broadcast(calendar(bars)), "date")


def align_ffill(bars: DataFrame, cols: list[str], backfill: bool = False) -> DataFrame:
    """Every ticker on every calendar date, carrying the last bar forward.

    Instead of crossing tickers with dates, each bar is stretched over the dates
    up to the ticker's next bar, so only result rows are ever made.
    """
    cal = calendar(bars).withColumn("_last", F.max("idx").over(Window.partitionBy(F.lit(1))))
    w = W.by_key()
    stretched = (
        bars.join(F.broadcast(cal), "date")
        .select("ticker", "idx", "_last", *cols, F.lead("idx").over(w).alias("_next"), F.row_number().over(w).alias("_rn"))
    )
    start = F.when((F.col("_rn") == 1) & F.lit(backfill), F.lit(1)).otherwise(F.col("idx"))
    end = F.coalesce(F.col("_next") - 1, F.col("_last"))
    grid = stretched.select("ticker", F.explode(F.sequence(start, end)).alias("idx"), F.col("idx").alias("_src"), *cols)
    return grid.join(F.broadcast(cal.drop("_last")), "idx").select("ticker", "date", *cols, (F.col("idx") != F.col("_src")).alias("filled"))


def continuous_contract(bars: DataFrame, root: str, contract: str, n: int = 5) -> DataFrame:
    """Per root and date take the contract with the largest n-row rolling volume
    (first contract on ties); prices are not back-adjusted."""
    vol = W.roll_sum("volume", n, 1, key=contract)
    rest = ["open", "high", "low", "close", "volume"]
    pick = F.max_by(F.struct(F.col(contract).alias("contract"), *rest), F.struct("_v", -F.col(contract)))
    return (
        bars.withColumn("_v", vol)
        .groupBy(root, "date")
        .agg(pick.alias("b"))
        .select(root, "date", "b.*")
    )


def asof_lookup(left: DataFrame, right: DataFrame, cols: list[str], key: str = "ticker") -> DataFrame:
    """Latest ``right`` row at or before each ``left`` row: union, then carry
    forward inside the key (bounded by the calendar)."""
    l = left.withColumn("_side", F.lit(1))
    r = right.select(key, "date", F.struct(F.col("date").alias("asof_date"), *cols).alias("_hit")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(key).orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_at", F.last("_hit", ignorenulls=True).over(w))
    return both.where(F.col("_side") == 1).select(*left.columns, F.col("_at.asof_date").alias("asof_date"), *[F.col(f"_at.{c}").alias(c) for c in cols])


def aligned_returns(returns: DataFrame, lookback: int) -> DataFrame:
    """Returns on the last ``lookback`` dates on which every ticker has one."""
    n = returns.where(F.col("r").isNotNull()).agg(F.count_distinct("ticker").alias("n_all"))
    full = (
        returns.where(F.col("r").isNotNull())
        .groupBy("date")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(n), F.col("n") == F.col("n_all"))
        .select("date")
        .orderBy(F.col("date").desc())
        .limit(lookback)
    )
    return returns.join(F.broadcast(full), "date").select("ticker", "date", "r")


def price_column(adj: Column, close: Column) -> Column:
    return F.coalesce(adj, close)


def latest_snapshot(df: DataFrame, as_of: str, fallback: DataFrame | None = None) -> DataFrame:
    """Rows of the newest date strictly before ``as_of``; keys the first store
    lacks come from the second, tagged by source."""

    def newest(d: DataFrame, tag: str) -> DataFrame:
        before = d.where(F.col("date") < F.lit(as_of).cast("date"))
        top = before.agg(F.max("date").alias("date"))
        return before.join(F.broadcast(top), "date").withColumn("source", F.lit(tag))

    first = newest(df, "primary")
    if fallback is None:
        return first
    return first.unionByName(newest(fallback, "fallback").join(first.select("ticker"), "ticker", "left_anti"))
