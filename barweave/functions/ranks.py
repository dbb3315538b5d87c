"""Exact ranks and quantiles of groups of any size.

A plain ``rank().over(partitionBy(date))`` puts a whole group into one task.
Here the work is spread by value range instead:

1. ties collapse first: ``groupBy(keys, x).count()`` is combined map-side, so a
   value held by a third of the rows is one row after it;
2. all (group, value) rows are dealt by ranges of their order, over all groups at once,
   and written once, each with the rows of its group before it in its range;
3. one row per range and group is added up and joined back.

Work follows the rows: small groups share a range, a large one spans several.  The
ranges only balance the work; wherever they are cut, the ranks are exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.mathx import corr_of
from barweave.session import written


def value_positions(df: DataFrame, keys: list[str], x: str, weight: str | None = None) -> DataFrame:
    """One row per (keys, distinct non-null x): ``_c`` copies (or their summed ``weight``), ``_before``
    rows of the group that are smaller and ``_n`` non-null rows of the group.  Groups with a null key are left out."""
    if not keys:
        return value_positions(df.withColumn("_g", F.lit(0)), ["_g"], x, weight).drop("_g")
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
    order = [*keys, x]
    dealt = counts.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", _part int, _at long"
    local = written(dealt.mapInArrow(_add_up_in_range(keys), schema), "positions")
    offsets = _offsets(local.groupBy("_part", *keys).agg(F.sum("_c").alias("_t")), keys)
    return local.join(offsets, ["_part", *keys]).select(*keys, x, "_c", (F.col("_off") + F.col("_at")).alias("_before"), "_n")


def _offsets(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Of ``spans`` (_part, keys, _t rows): ``_off`` rows of the group in earlier ranges and ``_n`` in all."""
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    return spans.select(
        "_part", *keys, (F.sum("_t").over(before) - F.col("_t")).alias("_off"), F.sum("_t").over(Window.partitionBy(*keys)).alias("_n")
    )


def _changes(column) -> np.ndarray:
    import pyarrow.compute as pc

    if len(column) < 2:
        return np.zeros(0, dtype=bool)
    same = pc.fill_null(pc.equal(column[1:], column[:-1]), False)
    both_null = pc.and_(pc.is_null(column[1:]), pc.is_null(column[:-1]))
    return pc.invert(pc.or_(same, both_null)).to_numpy(zero_copy_only=False)


def _add_up_in_range(keys: list[str]):
    """Adds to sorted rows their range and the copies (``_c``) of their group before them in it."""

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        group, carried = None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            c = b.column("_c").to_numpy(zero_copy_only=False)
            new = np.zeros(n, dtype=bool)
            new[1:] = np.logical_or.reduce([_changes(b.column(k)) for k in keys])
            if [b.column(k)[0] for k in keys] != group:
                carried = 0
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            before = np.cumsum(c) - c
            at = before - before[start] + np.where(start == 0, carried, 0)
            group, carried = [b.column(k)[n - 1] for k in keys], int(at[-1] + c[-1])
            extra = [pa.array(np.full(n, part, dtype=np.int32)), pa.array(at.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "_part", "_at"])

    return work


def average_rank(df: DataFrame, keys: list[str], x: str, out: str, pct: bool = False, size: str | None = None) -> DataFrame:
    """Attach the average-tie rank (1-based, or divided by the group size).
    Rows with a null value keep a null rank."""
    df = written(df, "ranked-rows")  # read by the ranking and the result
    pos = value_positions(df, keys, x)
    rank = F.col("_before") + (F.col("_c") + 1) / 2.0
    cols = [*keys, x, (rank / F.col("_n") if pct else rank).alias(out)]
    if size:
        cols.append(F.col("_n").alias(size))
    return df.join(pos.select(*cols), [*keys, x], "left").select(
        *df.columns, out, *([size] if size else [])
    )


def rank_together(df: DataFrame, keys: list[str], ranks: dict[str, str]) -> DataFrame:
    """Percentile ranks ``{out: column}`` of several columns in one pass; ``df`` is read once for it and once for the result."""
    sides = F.explode(F.array(*[F.struct(F.lit(o).alias("_side"), F.col(x).cast("double").alias("_x")) for o, x in ranks.items()]))
    pos = value_positions(df.select(*keys, sides.alias("_s")).select(*keys, "_s.*"), ["_side", *keys], "_x")
    pct = (F.col("_before") + (F.col("_c") + 1) / 2.0) / F.col("_n")
    out = df
    for o, x in ranks.items():
        out = out.join(pos.where(F.col("_side") == o).select(*keys, F.col("_x").alias(x), pct.alias(o)), [*keys, x], "left")
    return out.select(*df.columns, *ranks)


def exact_quantiles(df: DataFrame, keys: list[str], x: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with linearly interpolated quantiles ``{name: p}``."""
    pos = value_positions(df, keys, x)
    first, last = F.col("_before"), F.col("_before") + F.col("_c") - 1
    aggs: list[Column] = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        for side, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((first <= k) & (k <= last), F.col(x))).alias(f"_{name}_{side}"))
    got = pos.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs)
    picks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        frac = at - F.floor(at)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        picks.append((lo + (hi - lo) * frac).alias(name))
    return got.select(*keys, *picks)


def spearman(df: DataFrame, keys: list[str], x: str, y: str, out: str = "ic", min_n: int = 2) -> DataFrame:
    """Rank correlation per group over rows where both values are present.

    Equal pairs collapse first and are written once; both columns are then ranked in one pass.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    pairs = written(both.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_w")), "pairs")
    sides = F.explode(F.array(*[F.struct(F.lit(v).alias("_side"), F.col(v).alias("_x")) for v in (x, y)]))
    pos = value_positions(pairs.select(*keys, "_w", sides.alias("_s")).select(*keys, "_w", "_s.*"), ["_side", *keys], "_x", "_w")
    j = pairs
    for v, r in ((x, "_rx"), (y, "_ry")):
        p = pos.where(F.col("_side") == v)
        p = p.select(*keys, F.col("_x").alias(v), (F.col("_before") + (F.col("_c") + 1) / 2.0).alias(r), F.col("_n").alias(f"{r}_n"))
        j = j.join(p, [*keys, v])
    # the mean rank is (n+1)/2 exactly, so the centred sums need no first pass
    mid = (F.col("_rx_n") + 1) / 2.0
    dx, dy, w = F.col("_rx") - mid, F.col("_ry") - mid, F.col("_w")
    s = j.groupBy(*keys).agg(
        F.sum(w * dx * dy).alias("_xy"),
        F.sum(w * dx * dx).alias("_xx"),
        F.sum(w * dy * dy).alias("_yy"),
        F.sum(w).alias("n"),
    )
    return s.select(
        *keys,
        F.when(F.col("n") >= min_n, F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy")))).alias(out),
        "n",
    )


# --- many columns in one sort ----------------------------------------------------


def rank_columns(df: DataFrame, ids: list[str], specs: dict[str, tuple[str, str | None]]) -> DataFrame:
    """Places of several columns inside their groups from one range-partitioned sort.

    ``specs`` is ``{name: (column, sub)}``; a name's groups are the dates, or the
    values of ``sub`` on a date (null is a group too).  One row per non-null value: ``ids``,
    ``_name``, ``date``, ``_sub``, ``_x``, and ``_first`` (smaller rows of the group),
    ``_len`` (rows with the value) and ``_n`` (non-null rows of the group).

    All values are melted into (name, date, sub, value, ids) and dealt by ranges of it,
    so neither a date nor a value that a third of the rows share makes a task large.  Each range
    counts within its groups while it is written; groups that span several ranges get the
    sum of the ranges before (one row per range and group), values cut by the end of
    a range (two a range at most) their total.
    """
    sub = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) if c else F.lit("")
    parts = [
        F.struct(F.lit(i).alias("_name"), sub(s).alias("_sub"), (F.col(x).cast("double") + F.lit(0.0)).alias("_x"))
        for i, (x, s) in enumerate(specs.values())
    ]
    keys = ["date", "_name", "_sub"]  # dates first: most comparisons end there
    melted = df.select(*ids, *([] if "date" in ids else ["date"]), F.explode(F.array(*parts)).alias("_m")).select(*dict.fromkeys([*ids, "date"]), "_m.*")
    order = [*keys, "_x", *[i for i in ids if i != "date"]]
    dealt = melted.where(F.col("_x").isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + ", _part int, _at long, _same long, _edge boolean"
    local = written(dealt.mapInArrow(_count_in_range(keys), schema), "ranks")
    spans = local.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_t"))
    # a row per group, and one more for each range that ends within one: broadcast, so the rows do not move for it
    offsets = F.broadcast(written(_offsets(spans, keys), "offsets"))
    placed = local.join(offsets, ["_part", *keys]).withColumn("_first", F.col("_off") + F.col("_at"))
    # values at the ends of ranges: at most two per range
    cut = placed.where("_edge").groupBy(*keys, "_x").agg(F.min("_first").alias("_cut_first"), F.count(F.lit(1)).alias("_cut_len"), F.min("_part").alias("_p"), F.max("_part").alias("_q"))
    cut = cut.where("_p < _q").drop("_p", "_q")
    return placed.join(F.broadcast(cut), [*keys, "_x"], "left").select(
        *dict.fromkeys([*ids, "date"]), F.array(*[F.lit(n) for n in specs])[F.col("_name")].alias("_name"), "_sub", "_x",
        F.coalesce("_cut_first", "_first").alias("_first"), F.coalesce("_cut_len", "_same").alias("_len"), "_n",
    )


def _count_in_range(keys: list[str]):
    """Adds to sorted rows their range, the rows of their group before their value in it,
    the rows with their value in it and whether that value lies at an end of the range."""

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, carried, first_emitted = None, 0, True

        def ready(t, at, same, edge):
            n = len(t)
            extra = [pa.array(np.full(n, part, dtype=np.int32)), pa.array(at), pa.array(same), pa.array(edge)]
            t = t.combine_chunks()
            columns = [t.column(c).combine_chunks() for c in t.column_names]
            return pa.RecordBatch.from_arrays([*columns, *extra], names=[*t.column_names, "_part", "_at", "_same", "_edge"])

        def runs(t):
            """Per row its run's start, its group's start (-1: before the table) and the runs' starts."""
            new_group = np.concatenate([[False], np.logical_or.reduce([_changes(t.column(k).combine_chunks()) for k in keys])])
            new_run = new_group | np.concatenate([[False], _changes(t.column("_x").combine_chunks())])
            new_run[0] = True
            starts = np.nonzero(new_run)[0]
            group = np.maximum.accumulate(np.where(new_group, np.arange(len(t)), -1))
            return starts, group

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            starts, group = runs(t)
            sizes = np.diff([*starts, len(t)])
            # rows of the group before each run; the first group goes on from what was written
            at = np.where(group[starts] < 0, carried + starts, starts - group[starts])
            last = int(starts[-1])
            if last:
                closed = sizes[:-1]
                edge = np.zeros(len(closed), dtype=bool)
                edge[0] = first_emitted
                first_emitted = False
                yield ready(t.slice(0, last), np.repeat(at[:-1], closed), np.repeat(closed, closed), np.repeat(edge, closed))
            held, carried = t.slice(last), int(at[-1])
        if held is not None:
            n = len(held)
            yield ready(held, np.full(n, carried), np.full(n, n), np.ones(n, dtype=bool))

    return work


def percent_ranks(ranked: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    """``rank_columns`` back to one row per ``ids`` with average-tie percentile ranks."""
    pct = (F.col("_first") + (F.col("_len") + 1) / 2.0) / F.col("_n")
    each = ranked.where(F.col("_name").isin(*names)).select(*ids, "_name", pct.alias("_pct")).repartition(ids[0])
    return each.groupBy(*ids).agg(*[F.max(F.when(F.col("_name") == n, F.col("_pct"))).alias(n) for n in names])


def medians(ranked: DataFrame, name: str, out: str) -> DataFrame:
    """(date, _sub, out): the exact median of each group of ``rank_columns``."""
    holds = lambda k: (F.col("_first") <= k) & (k < F.col("_first") + F.col("_len"))
    at = (F.col("_n") - 1) / 2
    sides = [F.max(F.when(holds(f(at)), F.col("_x"))) for f in (F.floor, F.ceil)]
    return ranked.where(F.col("_name") == name).groupBy("date", "_sub").agg(((sides[0] + sides[1]) / 2).alias(out))
