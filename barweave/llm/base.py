"""Helpers shared by the operators: tables in the shared folder, a distributed row order and the query registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barweave.session import run_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class LlmQuery:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, LlmQuery] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` and, where SQL can say the same, its DuckDB twin."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = LlmQuery(fn, sql)
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch between the JVM and Python while a table is written: batches of whole texts stay small.
BATCH_ROWS = 1000


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts lineage,
    survives lost executors and fixes whatever is not the same on a second evaluation."""
    spark, size = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, before = run_dir(spark, label), spark.conf.get(size)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(size, str(BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(size, before)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows of a small table that is broadcast to look its values up; more are joined by a shuffle.
BROADCAST_ROWS = 50_000


def look_up(rows: DataFrame, values: DataFrame, key: str, salts: int = 64) -> DataFrame:
    """``rows`` joined with one row of ``values`` per ``key``.

    Up to a checked number of rows ``values`` is broadcast.  Beyond, it is repeated
    ``salts`` times and each row meets one copy, so a key with a third of the rows is
    spread over as many tasks, and a later sum per key combines before it is shuffled.
    """
    if values.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(values), key)
    copies = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).join(copies, [key, "_salt"]).drop("_salt")


#: Most rows of a list of keys (16 bytes each) that is broadcast to keep or drop rows; longer ones are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def row_keys(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with two 64-bit hashes ``__k1`` and ``__k2`` of ``columns`` that tell nulls apart: equal rows have equal keys."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return df.withColumns({"__k1": F.xxhash64(F.lit(1), *parts), "__k2": F.xxhash64(F.lit(2), *parts)})


def by_keys(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``rows`` with ``keys`` (all columns of ``keys``), which is a stored table."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, keys.columns, how)


def ordered(df: DataFrame, *keys: Column | str, label: str = "ordered") -> DataFrame:
    """``df`` with a column ``_row``: the place (from 0, no gaps) of each row in the order of ``keys``.

    Rows are dealt by ranges of the keys, sorted within each range and written once;
    only the number of rows of each range (as many numbers as there are partitions)
    is summed in one place.  No task holds more than its range, whatever the keys.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = stored(dealt, label)
    part = F.shiftrightunsigned("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        dealt.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn("_row", F.col("_start") + within)
        .drop("_part", "_start", "_at")
    )


def bounded_batches(batches, column: str, most_bytes: int = 2_000_000, most_rows: int = 2000):
    """Arrow batches cut into slices of about ``most_bytes`` of ``column`` (one value at
    least), so what a task derives from texts in memory does not follow their length."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > most_bytes or i - start >= most_rows):
                yield pa.RecordBatch.from_arrays([c.slice(start, i - start) for c in batch.columns], schema=batch.schema)
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield pa.RecordBatch.from_arrays([c.slice(start) for c in batch.columns], schema=batch.schema)
