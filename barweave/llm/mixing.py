"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source (map-side combined, so a source with a third of the
rows costs each task one partial row), targets are levelled against a cap of
``limit`` times the source's own size, and every document is taken
``floor(rate)`` times plus once more with the probability of the fraction, drawn
from a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.base import WORD, look_up, ordered, query, stored, table

WEIGHTS = (1, 2, 3)
LIMIT = 3
SEED = "mix-1"


def _draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the id alone: 52 bits of an MD5, the same on every run and engine."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """Per source its size, target and repetition rate, from rows of (source, size).

    Sources in code-point order (null last) get ``weights`` in turn and share the
    total; a target above ``limit`` times the source's size stops there and the
    excess goes to the others by weight.  The end of that resharing is a common
    level: sources sorted by ``limit * size / weight`` are full up to some place,
    and all behind it get ``level * weight``.  Both orders are dealt by ranges.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    named = ordered(totals, F.col("source").isNull(), F.col("source"), label="mix-sources").withColumn(
        "_weight", F.get(turn, (F.col("_row") % len(weights)).cast("int"))
    )
    most = F.lit(float(limit)) * F.col("source_size")
    named = named.drop("_row").withColumn("_full_at", most / F.col("_weight"))
    # level(s) if exactly the sources up to s were full; the true level is the first that s itself does not reach
    total, all_weights = named.agg(F.sum("source_size"), F.sum("_weight")).first()  # two numbers
    if total is None:
        return named.select("source", "source_size", F.lit(0.0).alias("target"), F.lit(0.0).alias("rate"))
    steps = named.groupBy("_full_at").agg(F.sum("source_size").alias("_size"), F.sum("_weight").alias("_w"))
    before = _sums_before(ordered(steps, "_full_at", label="mix-levels"))
    level = (F.lit(total) - F.lit(float(limit)) * F.col("_size_before")) / (F.lit(all_weights) - F.col("_w_before"))
    found = before.withColumn("_level", level).where("_full_at >= _level")
    level = found.agg(F.min_by("_level", "_row")).first()[0]  # one number
    target = F.least(most, F.lit(float(level or 0.0)) * F.col("_weight"))
    return (
        named.withColumn("target", F.coalesce(target, F.lit(0.0)))
        .withColumn(
            "rate",
            F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(limit)))).otherwise(0.0),
        )
        .select("source", "source_size", "target", "rate")
    )


def _sums_before(place: DataFrame, rows: int = 4096) -> DataFrame:
    """Sums of ``_size`` and ``_w`` over all earlier rows: running sums within blocks of
    ``rows`` rows, plus the totals of the blocks before (a table ``rows`` times smaller)."""
    blocks = place.withColumn("_block", F.floor(F.col("_row") / rows))
    per = blocks.groupBy("_block").agg(F.sum("_size").alias("_s"), F.sum("_w").alias("_v"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("_block", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0"), F.coalesce(F.sum("_v").over(earlier), F.lit(0.0)).alias("_v0"))
    within = Window.partitionBy("_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocks.join(base, "_block")
        .withColumn("_size_before", F.col("_s0") + F.coalesce(F.sum("_size").over(within), F.lit(0)))
        .withColumn("_w_before", F.col("_v0") + F.coalesce(F.sum("_w").over(within), F.lit(0.0)))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``rate`` and ``copies`` added.

    Size is the number of words (null text: 0).  A source of size 0 has rate 0, so
    its documents get no copies.  A null doc_id draws like an empty one; rows that
    share a doc_id share the draw.  Columns of ``docs`` with one of the added names
    are replaced.  An empty table gives an empty table.
    """
    own = [c for c in docs.columns if c.lower() not in {"size", "source_size", "target", "rate", "copies"}]
    sized = docs.select(*own).withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("_key")
    rates = stored(source_rates(sized.select("source", "size"), weights, limit).select(key, "source_size", "target", "rate"), "mix-rates")
    whole = F.floor("rate")
    extra = (_draw(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")
    return look_up(sized.withColumn("_key", key), rates, "_key").withColumn("copies", (whole + extra).cast("long")).drop("_key")


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Every document as many times as ``copies`` says, with only ``columns``."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM sized GROUP BY source
), steps AS (
  SELECT 3.0::DOUBLE * source_size / w AS full_at, sum(source_size)::DOUBLE AS s, sum(w) AS v FROM totals GROUP BY 1
), levels AS (
  SELECT full_at,
         ((SELECT sum(source_size) FROM totals)::DOUBLE
           - 3.0::DOUBLE * coalesce(sum(s) OVER (ORDER BY full_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / ((SELECT sum(w) FROM totals)
           - coalesce(sum(v) OVER (ORDER BY full_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM steps
), chosen AS (
  SELECT min_by(level, full_at) AS level FROM levels WHERE full_at >= level
), rates AS (
  SELECT source, source_size, coalesce(least(3.0::DOUBLE * source_size, level * w), 0) AS target FROM totals, chosen
), priced AS (
  SELECT s.doc_id, s.size, r.source_size, r.target,
         CASE WHEN r.source_size > 0 THEN least(r.target / r.source_size, 3.0::DOUBLE) ELSE 0 END AS rate,
         CAST('0x' || substr(md5(coalesce(CAST(s.doc_id AS VARCHAR), '') || ':{SEED}'), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM priced
"""


@query("op8_mix_sources", SQL)
def op8_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
