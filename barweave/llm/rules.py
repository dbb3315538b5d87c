"""Quality rules: base statistics, and robust multivariate outliers within each language and source.

The minimum-covariance-determinant estimate of a group is the mean and covariance
of the share of its rows that lie closest together.  It is found here for all
groups at once by concentration steps: distances to the present estimate, the
group's cut-off quantile, then moments of the rows below it.  A step is two
map-side combined aggregates over narrow rows, so a group with a third of the
rows costs each task one partial sum, and no group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.llm.base import bounded_batches, look_up, query, stored, table
from barweave.llm.nearest import chi_square_cdf, chi_square_quantile

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Share of a group's rows on which location and scatter rest.
COVERAGE = 0.75
STEPS = 5
#: Rows' worth of trust that a group gives to its language's estimate, and a language to that of all rows.
STRENGTH = 50.0
#: Probability that a regular row is kept.
CONFIDENCE = 0.99995
#: Transformed statistics and the least standard deviation of a group, which only keeps scatters invertible.
FEATURES = (("log_words", 1e-3), ("log_word_chars", 1e-3), ("root_symbols", 1e-3), ("root_dup_lines", 1e-3), ("root_repeats", 1e-3))
#: Share of the rows up to whose length a longer text is taken to resolve more.
LONGEST = 0.99
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"


def text_stats(text: str | None) -> tuple[int, int, int, int, int, int]:
    """Words, code points in words, symbols, lines with a word, those equal to an earlier one, and words in
    8-word windows that come twice or more.  A null text has none of anything."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeats, n = 0, len(words)
    if n > WINDOW:
        code = np.fromiter(map(hash, words), dtype=np.int64, count=n)
        with np.errstate(over="ignore"):
            window = np.zeros(n - WINDOW + 1, dtype=np.int64)
            for k in range(WINDOW):
                window = window * np.int64(6364136223846793005) + code[k : n - WINDOW + 1 + k]
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        if same.any():
            twice = np.zeros(len(window), dtype=bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            covered = np.zeros(n + 1, dtype=np.int64)
            at = np.flatnonzero(twice)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + WINDOW, -1)
            repeats = int((covered.cumsum()[:n] > 0).sum())
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeats


STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def with_stats(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of ``docs`` and the base statistics of its whole texts."""
    slim = docs.select(*keys, "text")
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "text"):
            stats = list(zip(*map(text_stats, batch.column("text").to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *[pa.array(s, pa.int64()) for s in stats]], names=[*keys, *STATS])

    return slim.mapInArrow(work, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *[f"{s} long" for s in STATS]]))


def features() -> list[Column]:
    """The transformed statistics of ``FEATURES``, for rows with a word."""
    words, lines = F.col("n_words"), F.greatest(F.col("n_lines"), F.lit(1))
    return [
        F.log1p(words), F.log(F.col("word_chars") / words), F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / words),
    ]


def resolution() -> list[Column]:
    """Squares of what one word, one code point, one symbol, one line and one repeated window change in the
    statistics of a text of that length; texts beyond the lengths in ``_longest`` resolve no more than those."""
    words, lines = F.least("n_words", F.col("_longest")[0]), F.least(F.greatest(F.col("n_lines"), F.lit(1)), F.col("_longest")[1])
    one = F.lit(1.0)
    return [one / F.pow(F.col("n_words") + 1.0, 2), one / F.pow(F.col("word_chars").cast("double"), 2), one / words, one / lines, 2.0 * WINDOW / words]


def _estimates(moments: DataFrame, consistency: float) -> DataFrame:
    """Per group the location and the inverse scatter, from sums: at most one small row per group."""
    p = len(FEATURES)
    floor = np.array([s for _, s in FEATURES]) ** 2
    upper = [(i, j) for i in range(p) for j in range(i, p)]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                mean = np.array(r.s) / r.n
                cov = np.zeros((p, p))
                for v, (i, j) in zip(r.ss, upper, strict=True):
                    cov[i, j] = cov[j, i] = v / r.n
                cov = (cov - np.outer(mean, mean)) * consistency
                # spread below the floor is filled up, so a constant statistic does not make its first exception infinitely far
                cov[np.arange(p), np.arange(p)] += np.maximum(floor - np.diag(cov), 0.0)
                rows.append((r.group, r.n, (np.array(r.origin) + mean).tolist(), np.linalg.pinv(cov).ravel().tolist(), cov.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["group", "n", "centre", "inverse", "scatter"])

    return moments.mapInPandas(work, "group string, n long, centre array<double>, inverse array<double>, scatter array<double>")


def _distance(data: DataFrame, estimate: DataFrame) -> DataFrame:
    p = len(FEATURES)
    gap = [F.col("x")[i] - F.col("centre")[i] for i in range(p)]
    total = sum((gap[i] * gap[j] * F.col("inverse")[i * p + j] for i in range(p) for j in range(p)), F.lit(0.0))
    return look_up(data, estimate.select("group", "centre", "inverse"), "group").withColumn("d2", total).drop("centre", "inverse")


def robust_distances(rows: DataFrame, coverage: float = COVERAGE, steps: int = STEPS) -> DataFrame:
    """``rows`` (group, x: array of transformed statistics) with ``d2``: squared Mahalanobis distance to
    the minimum-covariance-determinant estimate of its group."""
    return _distance(rows, robust_estimates(rows, coverage, steps))


def robust_estimates(rows: DataFrame, coverage: float = COVERAGE, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant estimate of each group of ``rows`` (group, x): the rows it rests on,
    ``centre``, ``inverse`` and ``scatter``.

    Starts from the coordinate-wise medians and median deviations.  Sums are taken
    around the medians, so large means do not eat the digits of small spreads.
    """
    p = len(FEATURES)
    x = [F.col("x")[i] for i in range(p)]
    q = chi_square_quantile(coverage, p)
    consistency = coverage / chi_square_cdf(q, p + 2)
    median = rows.groupBy("group").agg(F.array(*[F.percentile_approx(v, 0.5, 10_000) for v in x]).alias("origin"))
    median = stored(median, "mcd-median")
    off = look_up(rows, median, "group")
    spread = off.groupBy("group").agg(F.array(*[F.percentile_approx(F.abs(v - F.col("origin")[i]), 0.5, 10_000) for i, v in enumerate(x)]).alias("mad"))
    floors = [s for _, s in FEATURES]
    variance = [F.greatest(F.col("mad")[i] * 1.4826, F.lit(floors[i])) for i in range(p)]
    start = spread.join(median, "group").select(
        "group", F.col("origin").alias("centre"),
        F.array(*[1 / (variance[i] * variance[i]) if i == j else F.lit(0.0) for i in range(p) for j in range(p)]).alias("inverse"),
    )
    estimate = stored(start, "mcd")

    for _ in range(steps):
        far = _distance(rows, estimate)
        cut = stored(far.groupBy("group").agg(F.percentile_approx("d2", coverage, 10_000).alias("cut")), "mcd-cut")
        near = look_up(look_up(far, cut, "group").where("d2 <= cut"), median, "group")
        gap = [v - F.col("origin")[i] for i, v in enumerate(x)]
        moments = near.groupBy("group").agg(
            F.count(F.lit(1)).alias("n"), F.array(*[F.sum(g) for g in gap]).alias("s"),
            F.array(*[F.sum(gap[i] * gap[j]) for i in range(p) for j in range(i, p)]).alias("ss"), F.first("origin").alias("origin"),
        )
        estimate = stored(_estimates(moments, consistency), "mcd")
    return estimate


def scaled_distances(rows: DataFrame) -> DataFrame:
    """``rows`` (x, n_words, resolution, centre, scatter) with ``d2`` instead of the last three.

    The scatter is the estimate's.  Where a text's own resolution is coarser than the
    spread, as where a statistic is constant, that is its variance.  A mean over few
    words varies by itself: the square of the median of its scaled deviations, over the number of words.
    """
    by_word = F.percentile_approx(F.abs(F.col("x")[1] - F.col("centre")[1]) * F.sqrt("n_words"), 0.5, 10_000)
    word = (rows.agg(by_word).first()[0] or 0.0) * 1.4826
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kept = [c for c in rows.columns if c not in ("resolution", "centre", "scatter")]
    p = len(FEATURES)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, least, centre, scatter = (np.array(b[c].tolist(), dtype=np.float64) for c in ("x", "resolution", "centre", "scatter"))
            least[:, 1] = np.maximum(least[:, 1], word * word / b["n_words"].to_numpy())
            cov, at = scatter.reshape(-1, p, p), np.arange(p)
            cov[:, at, at] = np.maximum(cov[:, at, at], least)
            gap = x - centre
            yield b[kept].assign(d2=np.einsum("ni,ni->n", gap, np.linalg.solve(cov, gap[:, :, None])[:, :, 0]))

    return rows.mapInPandas(work, ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], "d2 double"]))


def leaning(groups: DataFrame, estimates: DataFrame, strength: float) -> DataFrame:
    """Centre and scatter of each group (_own, _tongue), with ``strength`` rows like its language's,
    which has as many like the corpus'."""

    def at(level: str, key: Column, data: DataFrame) -> DataFrame:
        part = estimates.select(F.col("group").alias(f"_{level}"), *[F.col(c).alias(f"{level}_{c}") for c in ("n", "centre", "scatter")])
        return look_up(data.withColumn(f"_{level}", key), part, f"_{level}").drop(f"_{level}")

    joined = groups
    for level, key in (("a", F.lit("all")), ("t", F.col("_tongue")), ("o", F.col("_own"))):
        joined = at(level, key, joined)

    def lean(n: Column, own: Column, above: Column) -> Column:
        return F.zip_with(own, above, lambda x, y: (x * n + y * strength) / (n + F.lit(strength)))

    middle = joined.withColumns({c: lean(F.col("t_n"), F.col(f"t_{c}"), F.col(f"a_{c}")) for c in ("centre", "scatter")})
    return stored(middle.select("_own", *[lean(F.col("o_n"), F.col(f"o_{c}"), F.col(c)).alias(c) for c in ("centre", "scatter")]), "rule-groups")


def judge(docs: DataFrame, confidence: float = CONFIDENCE, coverage: float = COVERAGE, steps: int = STEPS, strength: float = STRENGTH) -> DataFrame:
    """doc_id, the base statistics, ``base_failed``, ``d2`` and ``kept`` of every document.

    A row that fails a base rule is not kept and takes no part in the estimates.  Null
    and empty texts have no words and fail.  Null languages and sources are groups of
    their own.  Every other row is judged: the estimate of a group leans on its language's, and that
    on the corpus', by how few rows it rests on.  Repeated rows are judged each.  An empty table gives an empty table.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    stats = with_stats(keyed, ["doc_id", "lang", "source"]).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    )
    stats = stored(stats, "rule-stats")
    regular = stats.where("not base_failed")
    lengths = regular.agg(F.array(*[F.percentile_approx(c, LONGEST, 10_000) for c in ("n_words", "n_lines")]).alias("_longest"))
    regular = regular.crossJoin(F.broadcast(lengths)).withColumns({"x": F.array(*features()), "resolution": F.array(*resolution())}).drop("_longest")
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    tongue = F.concat(F.lit("language "), name(F.col("lang")))
    regular = regular.withColumns({"_tongue": tongue, "_own": F.concat(F.lit("group "), name(F.col("lang")), F.lit("/"), name(F.col("source")))})
    regular = stored(regular, "rule-rows")
    # the three levels of every row at once
    levels = regular.select(F.explode(F.array(F.lit("all"), "_tongue", "_own")).alias("group"), "x")
    estimates = robust_estimates(levels, coverage, steps).select("group", "n", "centre", "scatter")
    judged = scaled_distances(look_up(regular, leaning(regular.select("_own", "_tongue").distinct(), estimates, strength), "_own")).drop("_own", "_tongue", "x")
    failed = stats.where("base_failed").withColumn("d2", F.lit(None).cast("double"))
    cut = chi_square_quantile(confidence, len(FEATURES))
    return judged.unionByName(failed).withColumn("kept", ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= cut))


@query("op7_quality_rules")
def op7_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
