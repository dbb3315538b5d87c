"""Raw tables and the frames derived from them.

The bar panel, trades, equity curve, news and event frames are all derived by
Spark from the given tables, so every query grows with its input.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barweave.functions import windows as W
from barweave.session import shared_dir

_PANELS: dict[tuple[str, str], str] = {}
_BUCKETS: dict[str, int] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as price prints: ticker, date, price p in cents, size q and a full-row
    order key (order and line number alone repeat)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("ticker"),
        F.to_date("l_shipdate").alias("date"),
        F.round(100 * (1 - F.col("l_discount") + F.col("l_tax")), 2).alias("p"),
        F.col("l_quantity").alias("q"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("k"),
        "l_linestatus",
    )


def bars_from_prints(prints: DataFrame) -> DataFrame:
    """OHLCV per (ticker, date).  Every aggregate combines map-side, so a ticker
    holding a third of the prints costs one partial row per task and day."""
    return prints.groupBy("ticker", "date").agg(
        F.min_by("p", "k").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "k").alias("close"),
        F.sum("q").alias("volume"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bar panel of a data folder.

    Built once per session and kept as a table bucketed and sorted by ticker in
    the shared folder, so per-ticker windows start without a shuffle and several
    branches of a plan share one scan of the raw lines.
    """
    app = spark.sparkContext.applicationId
    key = (app, sf_dir)
    name = _PANELS.get(key)
    if name is None:
        name = "bars_" + hashlib.md5(f"{app}|{sf_dir}".encode()).hexdigest()[:12]
        # the count comes from the footers of the files
        n = bucket_count(table(spark, sf_dir, "lineitem").count(), spark.sparkContext.defaultParallelism)
        _BUCKETS[name] = int(spark.conf.get("spark.barweave.panel.buckets", str(n)))
        write_panel(bars_from_prints(lines(spark, sf_dir)), name, f"{shared_dir(spark)}/{name}", _BUCKETS[name])
        _PANELS[key] = name
    return spark.table(name)


def beside_panel(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """``df`` dealt by ticker as the bar panel is, so that a join with the bars moves ``df`` alone."""
    panel(spark, sf_dir)
    return df.repartition(_BUCKETS[_PANELS[spark.sparkContext.applicationId, sf_dir]], "ticker")


#: Prints a bucket of the panel holds on average, so that tasks stay of one size whatever the data.
BUCKET_ROWS = 1_000_000


def bucket_count(prints: int, cores: int) -> int:
    return max(cores, -(-prints // BUCKET_ROWS))


def write_panel(bars: DataFrame, name: str, path: str, buckets: int | None = None) -> None:
    spark = bars.sparkSession
    n = buckets or int(spark.conf.get("spark.barweave.panel.buckets", str(spark.sparkContext.defaultParallelism)))
    (
        bars.repartition(n, "ticker")
        .write.mode("overwrite")
        .bucketBy(n, "ticker")
        .sortBy("ticker", "date")
        .option("path", path)
        .saveAsTable(name)
    )


def with_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("r", W.pct_change("close"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker -> sector.  Nation and region are fixed 25- and 5-row tables; the
    supplier side grows with the data and is never broadcast by hint."""
    return (
        table(spark, sf_dir, "supplier")
        .join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"), F.col("n_name").alias("nation"))
    )


def market(bars: DataFrame) -> DataFrame:
    """One row per date: mean ticker return.  Bounded by the calendar."""
    return (
        with_returns(bars)
        .groupBy("date")
        .agg(F.avg("r").alias("m"), F.count("r").alias("n_names"))
        .where(F.col("m").isNotNull())
        .select(F.lit(1).alias("mkt"), "date", "m", "n_names")
    )


# Order priority to regime label.
PRIORITY_REGIME = {"1-URGENT": "Crisis", "2-HIGH": "Bear", "3-MEDIUM": "Sideways",
                   "4-NOT SPECIFIED": "Sideways", "5-LOW": "Bull"}


def trades(spark: SparkSession, sf_dir: str, regime: bool = False) -> DataFrame:
    """Trade log.  Orders are joined only when the regime label is asked for."""
    li = table(spark, sf_dir, "lineitem")
    if regime:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
        li = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    score = (F.col("l_quantity") - 25.5) / 25
    ret = F.col("l_discount") - F.col("l_tax")
    out = li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("ticker"),
        F.to_date("l_shipdate").alias("entry_date"),
        F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber")).alias("exit_date"),
        F.date_add(F.to_date("l_shipdate"), -1).alias("signal_date"),
        F.col("l_extendedprice").alias("position_size"),
        ret.alias("ret"),
        (F.col("l_extendedprice") * ret).alias("pnl"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("direction"),
        score.alias("adjusted_score"),
        F.when(score > 0, "Bullish").otherwise("Bearish").alias("signal"),
        F.col("l_linenumber").alias("holding_days"),
        *([F.col("o_orderpriority")] if regime else []),
    )
    if regime:
        from barweave.functions.mathx import lookup

        out = out.withColumn("regime", lookup(F.col("o_orderpriority"), PRIORITY_REGIME, "Sideways"))
    return out


def equity_curve(trade_log: DataFrame, initial: float = 100_000.0) -> DataFrame:
    """Initial capital plus the running daily profit, one row per exit date; money is
    kept to four decimals."""
    daily = trade_log.groupBy("exit_date").agg(F.round(F.sum("pnl"), 4).alias("pnl"))
    # one row per calendar date: a single ordered series is bounded by the calendar
    w = Window.partitionBy("acct").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (
        daily.select(F.lit(1).alias("acct"), F.col("exit_date").alias("date"), "pnl")
        .withColumn("equity", F.round(F.lit(initial) + F.sum("pnl").over(w), 4))
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines with a label from the document labels (neutral when unlabelled)."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic")
    )
    return d.join(lab, "doc_id", "left").select(
        "doc_id",
        (F.col("doc_id") % 100).alias("ticker"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("date"),
        F.col("text").alias("headline"),
        "text",
        "lang",
        "source",
        "n_chars",
        F.when(F.col("quality") == 1, "positive")
        .when(F.col("toxic") == 1, "negative")
        .otherwise("neutral")
        .alias("label"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("ticker"), F.col("event_type").alias("side"), F.col("value").alias("score")
    )
