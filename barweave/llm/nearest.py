"""Nearest neighbours by stable projections and kd-trees with a chi-square stop.

Vectors are projected on ``m`` Gaussian directions: the squared projected distance
of two vectors over their squared distance follows chi-square with ``m`` degrees.  The
directions are made orthogonal where the vectors are long enough, which keeps the mean and
narrows the spread, so the test errs on the safe side.
A kd-tree over projections of a bounded sample cuts the projected space into
cells, and every vector is written once, dealt and sorted by its cell.  Queries go to all
tasks in chunks of bounded size; rows stay where they are.  A first search over
the sample bounds each query's k-th distance.  Then every block of rows is put into a
kd-tree of its own: leaves beyond the radius at which the stopping test holds are
not opened, and the rows of the others are verified on the original vectors in
the order of their own projected distances, until the next one's passes the test for the
k-th distance found so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.base import ordered, query, stored, table
from barweave.session import run_dir

K = 10
#: Projected dimensions.
DIMENSIONS = 32
#: Probability with which a true neighbour is met before the search stops, for independent directions.
CONFIDENCE = 0.85
#: Rows of the sample on which the cells are fitted and first distances found (all rows are then indexed).
SAMPLE = 20_000
#: Rows of a block, and queries that are sent to all tasks at once.
BLOCK_ROWS = 8_000
CHUNK = 20_000
#: Most cells, and rows that a cell should hold at least.
CELLS = 1024
LEAF = 64
#: Rows that are verified before the test is made again.
STEP = 32
SEED = 7
#: Equal vectors may get projections that differ in the last bits.
SLACK = 1e-12


def chi_square_cdf(x: float, m: int) -> float:
    """By the series of the regularised incomplete gamma function."""
    a, h = m / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= h / n
        total += term
    return total * exp(-h + a * log(h) - lgamma(a))


def chi_square_quantile(p: float, m: int) -> float:
    """By bisection."""
    low, high = 1e-9, 10.0 * m + 200
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < p else (low, mid)
    return high


@dataclass(frozen=True)
class Tree:
    """A kd-tree of boxes around groups of rows: ``rows`` are the row numbers of each leaf."""

    low: np.ndarray
    high: np.ndarray
    rows: list[np.ndarray]

    @staticmethod
    def build(points: np.ndarray, leaf: int) -> Tree:
        """Cuts at the median of the widest dimension; equal points stay in one leaf."""
        done, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            p = points[rows]
            width = p.max(axis=0) - p.min(axis=0)
            d = int(width.argmax())
            if len(rows) <= leaf or width[d] == 0:
                done.append(rows)
                continue
            cut = np.median(p[:, d])
            under = p[:, d] < cut if cut > p[:, d].min() else p[:, d] <= cut
            todo += [rows[~under], rows[under]]
        return Tree(np.array([points[r].min(axis=0) for r in done]), np.array([points[r].max(axis=0) for r in done]), done)

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of a point from each box."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0.0)
        return np.einsum("ij,ij->i", gap, gap)


def projections(length: int, m: int) -> np.ndarray:
    """``m`` Gaussian directions, orthogonal and of the same mean square where ``m`` is at most ``length``."""
    g = np.random.default_rng(SEED).standard_normal((length, m))
    return np.linalg.qr(g)[0] * np.sqrt(length) if m <= length else g


class Search:
    """The ``k`` best rows found so far for each of some queries, and how many were verified."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, bounds: np.ndarray, k: int, stop: float):
        self.ids, self.vectors, self.projected, self.kth, self.k, self.stop = ids, vectors, projected, bounds.copy(), k, stop
        self.best = [(np.empty(0), np.empty(0, dtype=np.int64)) for _ in ids]
        self.verified = np.zeros(len(ids), dtype=np.int64)

    def block(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, leaf: int = LEAF) -> None:
        """Looks through a block of rows for all queries."""
        tree = Tree.build(projected, leaf)
        norms = np.einsum("ij,ij->i", projected, projected)
        for q, (p, v) in enumerate(zip(self.projected, self.vectors)):
            size = p @ p
            reach = self.stop * self.kth[q] + SLACK * size
            rows = np.concatenate([tree.rows[i] for i in np.nonzero(tree.distances(p) <= reach)[0]] or [np.empty(0, dtype=np.int64)])
            if not len(rows):
                continue
            apart = norms[rows] + size - 2 * (projected[rows] @ p)
            within = apart <= reach
            rows, apart = rows[within], apart[within]
            order = np.argsort(apart, kind="stable")
            for s in range(0, len(order), STEP):
                now = order[s : s + STEP]
                if apart[now[0]] > self.stop * self.kth[q] + SLACK * size:
                    break
                self.verify(q, v, ids[rows[now]], vectors[rows[now]])

    def verify(self, q: int, v: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        diff = vectors - v
        d = np.einsum("ij,ij->i", diff, diff)
        self.verified[q] += len(d)
        mine = (d <= self.kth[q]) & (ids != self.ids[q])
        if mine.any():
            d, i = np.concatenate([self.best[q][0], d[mine]]), np.concatenate([self.best[q][1], ids[mine]])
            first = np.lexsort((i, d))[: self.k]
            self.best[q] = d[first], i[first]
            if len(first) == self.k:
                self.kth[q] = min(self.kth[q], d[first[-1]])


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part: an id, and a vector without
    null, NaN or infinite components that is not zero, of the length most rows have (of equally
    frequent lengths the shortest)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))
    good = rows.where(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    )
    lengths = good.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    best = lengths.agg(F.max_by("n", F.struct("c", -F.col("n")))).first()[0]  # one number
    return good.where(F.size("embedding") == F.lit(best or 0))


FOUND = "query_id long, vec_id long, d2 double, verified long"


def scan(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, directions: np.ndarray, k: int, stop: float, block_rows: int) -> DataFrame:
    """(query_id, vec_id, d2, verified): each task's ``k`` best ``rows`` (vec_id, embedding) of every query.

    ``bounds`` are squared distances that the k-th cannot exceed.  A query's first row in a task
    tells how many rows the task verified for it; it has no vec_id where none was found.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(ids, vectors, vectors @ directions, bounds, k, stop)
        for b in batches:
            for at in range(0, b.num_rows, block_rows):
                part = b.slice(at, block_rows)
                x = np.array(part.column("embedding").flatten()).reshape(part.num_rows, -1)
                search.block(part.column("vec_id").to_numpy(), x, x @ directions)
        out = [(int(q), int(i), float(d), int(n) if r == 0 else 0) for q, (ds, near), n in zip(ids, search.best, search.verified) for r, (d, i) in enumerate(zip(ds, near))]
        out += [(int(q), None, None, int(n)) for q, (ds, _), n in zip(ids, search.best, search.verified) if n and not len(ds)]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds[c]) for c in range(4)], names=["query_id", "vec_id", "d2", "verified"])

    return rows.select("vec_id", "embedding").mapInArrow(work, FOUND)


def search(
    embeddings: DataFrame, is_query, k: int = K, dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE, sample: int = SAMPLE,
    block_rows: int = BLOCK_ROWS, chunk: int = CHUNK, cells: int = CELLS,
) -> DataFrame | None:
    """All that the tasks of ``nearest`` found (``FOUND``); None where no row takes part."""
    spark, rows = embeddings.sparkSession, usable(embeddings)
    hashed = rows.select("vec_id", "embedding", F.xxhash64("vec_id").alias("_h"))
    # the hash that follows the sample's: rows under it are the sample, the others are searched after it
    following = hashed.select("_h").orderBy("_h").limit(sample + 1).agg(F.max("_h").alias("h"), F.count(F.lit(1)).alias("n")).first()
    inside = F.lit(following["n"] <= sample) | (F.col("_h") < F.lit(following["h"]))
    picked = stored(hashed.where(inside).drop("_h"), "ann-sample")
    fitted = np.array([r[0] for r in picked.select("embedding").limit(sample).collect()])
    if not len(fitted):
        # no row, or one vec_id with more rows than the sample may hold
        fitted = np.array([r[0] for r in rows.select("embedding").limit(sample).collect()])
    if not len(fitted):
        return None
    directions = projections(fitted.shape[1], dimensions)
    n_cells = max(1, min(cells, -(-rows.count() // block_rows)))
    grid = Tree.build(fitted @ directions, max(1, -(-len(fitted) // n_cells)))
    stop = chi_square_quantile(confidence, dimensions)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, half = (grid.low + grid.high) / 2, (grid.high - grid.low) / 2
        for b in batches:
            p = np.array(b.column("embedding").flatten()).reshape(b.num_rows, -1) @ directions
            # the cell whose box is nearest; between boxes that hold the point, the one with the nearer centre
            cell = np.empty(len(p), dtype=np.int32)
            for i in range(0, len(p), 1000):
                gap = np.zeros((len(p[i : i + 1000]), len(centre)))
                for d in range(p.shape[1]):
                    off = np.abs(p[i : i + 1000, d, None] - centre[None, :, d])
                    gap += np.maximum(off - half[None, :, d], 0.0) ** 2 + 1e-9 * off**2
                cell[i : i + 1000] = gap.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(cell)], names=["vec_id", "embedding", "cell"])

    placed = hashed.where(~inside).drop("_h").mapInArrow(place, "vec_id long, embedding array<double>, cell int")
    # neighbouring rows lie in one block; the hash cuts cells of any size into ranges
    order = ["cell", F.xxhash64("vec_id")]
    placed = stored(placed.repartitionByRange(*order).sortWithinPartitions(*order), "ann-rows")
    one_each = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = stored(ordered(one_each, "vec_id", label="ann-order"), "ann-queries")
    size, folder = "spark.sql.execution.arrow.maxRecordsPerBatch", run_dir(spark, "ann-found")
    for n in range(-(-queries.count() // chunk)):
        taken = queries.where((F.col("_row") >= n * chunk) & (F.col("_row") < (n + 1) * chunk)).orderBy("vec_id").toArrow()  # ``chunk`` rows at most
        ids = np.asarray(taken.column("vec_id"))
        vectors = np.array(taken.column("embedding").to_pylist())
        first = stored(scan(picked, ids, vectors, np.full(len(ids), np.inf), directions, k, stop, block_rows), "ann-first")
        # the k-th distance in the sample bounds the true one; fewer than k rows there bound nothing
        best = first.where("vec_id is not null").withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "vec_id"))).where(F.col("_r") == k)
        known = {r["query_id"]: r["d2"] for r in best.select("query_id", "d2").collect()}
        bounds = np.array([known.get(int(i), np.inf) for i in ids])
        before = spark.conf.get(size)
        spark.conf.set(size, str(block_rows))
        try:
            scan(placed, ids, vectors, bounds, directions, k, stop, block_rows).write.parquet(f"{folder}/chunk={n}")
        finally:
            spark.conf.set(size, before)
        first.write.mode("append").parquet(f"{folder}/chunk={n}")
    return spark.read.schema(FOUND).parquet(f"{folder}/chunk=*") if not queries.isEmpty() else None


def nearest(embeddings: DataFrame, is_query, k: int = K, **how) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of each query by Euclidean distance.

    ``embeddings`` has vec_id and embedding; ``is_query`` is a condition on vec_id.
    Rows ``usable`` leaves out take no part.  Candidates are all rows with another
    vec_id; a vec_id that repeats is one query (its smallest vector) and one candidate
    per row.  Ties go to the smaller vec_id; fewer than ``k`` candidates give fewer
    rows, an empty table none.  Every row is indexed; only the cells and the first distances
    come from a sample (the rows with the smallest hashes of their ids).  Other columns are
    ignored whatever their names; ``how`` holds the parameters of ``search``.
    """
    found = search(embeddings, is_query, k, **how)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # at most k rows per query and task; Spark prunes a query's rows to k in each task before they are shuffled
    order = Window.partitionBy("query_id").orderBy("d2", "vec_id")
    best = found.where("vec_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", F.sqrt("d2").alias("score"))


@query("op10_nearest_vectors")
def op10_nearest_vectors(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
