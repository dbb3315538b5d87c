"""Report sinks and small-format scans."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.session import written
from barweave.sources.bars import keep_latest


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    w = df.write.mode("errorifexists")
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


def read_report(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    r = spark.read.schema(schema)
    if fmt == "csv":
        r = r.option("header", True)
    return r.format(fmt).load(path)


def read_keyed_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """CSV keyed by ``ticker`` or ``symbol`` in any case; text is trimmed and
    upper-cased, values that do not parse are dropped."""
    raw = spark.read.option("header", True).csv(path)  # all text: no inference pass
    names = {n.strip().lower(): n for n in raw.columns}
    key = names.get("ticker") or names.get("symbol")
    if key is None:
        raise ValueError(f"no ticker or symbol column in {raw.columns}")
    cols = [F.upper(F.trim(F.col(key))).alias("ticker")]
    for c, t in columns.items():
        text = F.upper(F.trim(F.col(names[c])))
        cols.append((text if t == "string" else text.try_cast(t)).alias(c))
    out = raw.select(*cols).where(F.col("ticker") != "")
    for c in columns:
        out = out.where(F.col(c).isNotNull())
    return out


def build_payload(rows: DataFrame, fields: list[str], blocks: int = 64) -> DataFrame:
    """JSON documents per date: ``{"<ticker>": {...}, ...}``.

    A day is dealt to ``blocks`` documents by a hash of the ticker, whatever its size.
    """
    block = F.pmod(F.xxhash64("ticker"), F.lit(blocks))
    entry = F.struct(F.col("ticker").cast("string").alias("key"), F.struct(*fields).alias("value"))
    return rows.groupBy("date", block.alias("block")).agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("signals")
    )


def explode_payload(payload: DataFrame, fields: dict[str, str]) -> DataFrame:
    value = T.StructType([T.StructField(k, T._parse_datatype_string(t)) for k, t in fields.items()])
    parsed = F.from_json("signals", T.MapType(T.StringType(), value))
    return payload.select("date", F.explode(parsed)).select(
        "date", F.col("key").try_cast("long").alias("ticker"), *[F.col(f"value.{k}").alias(k) for k in fields]
    )


def latest_entries(log: DataFrame, key: str, ts: str) -> DataFrame:
    """Newest log entry per key, as one combinable aggregate."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("e")).select(key, "e.*")


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(entries, damaged lines) of a JSON-lines log; blank lines are neither.

    A line that is no JSON, or holds a value that does not fit its column, is damaged as a whole and
    kept as text (``line``), so the two together are the log.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    with_line = T.StructType([*schema.fields, T.StructField("_line", T.StringType())])
    parsed = lines.select("value", F.from_json("value", with_line, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"}).alias("_e"))
    bad = F.col("_e._line").isNotNull() | F.col("_e").isNull() | ~F.trim("value").startswith("{")
    return parsed.where(~bad).select("_e.*").drop("_line"), parsed.where(bad).select(F.col("value").alias("line"))


def upsert(load: DataFrame, path: str, keys: list[str], order: list, part: str) -> int:
    """Merges a load into a Parquet table partitioned by ``part``; gives back how many partitions were written.

    The last row of a key by ``order`` wins, the load's where it is equal.  Only partitions in which some row is new or
    different are merged with their old rows and replaced (dynamic partition overwrite); files of
    the others are not touched, and a load that changes nothing writes nothing.  ``part`` is a
    function of the keys.  The merge is staged in the shared folder before anything is replaced.
    """
    spark = load.sparkSession
    columns = load.columns
    fresh = keep_latest(load, keys, [F.col(c) for c in _names(order)]).select(*columns)
    try:
        old = spark.read.schema(load.schema).parquet(path)
        old.head(1)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = None
    if old is None:
        staged = written(fresh, "upsert")
    else:
        rest = [c for c in columns if c not in keys]
        there = old.select(*keys, F.struct(*rest).alias("_old"), F.lit(True).alias("_is"))
        wins = F.coalesce(F.struct(*order) >= F.struct(*[F.col(f"_old.{c}") for c in _names(order)]), F.lit(True))
        news = fresh.join(there, keys, "left").where(F.col("_is").isNull() | (wins & ~F.struct(*rest).eqNullSafe(F.col("_old"))))
        # a load touches some partitions; their values are one small row each
        touched = written(news.select(*columns), "upsert-news")
        parts = touched.select(part).distinct()
        kept = old.join(parts, part, "left_semi").join(touched, keys, "left_anti")
        staged = written(kept.select(*columns).unionByName(touched), "upsert")
    n = staged.select(part).distinct().count()
    if n:
        staged.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    return n


def _names(order: list) -> list[str]:
    """Columns that an order is made of; they are plain names."""
    if not all(isinstance(c, str) for c in order):
        raise TypeError("order columns are given by name")
    return order
