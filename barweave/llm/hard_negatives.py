"""Hard negatives by slots between the positives' upper limits.

A negative of a positive is a row of another label whose score lies in a window
under the positive's own score.  The windows of an anchor overlap, so they are not
searched one by one: the distinct upper limits of its positives cut the scores into
disjoint slots, each row falls into one slot at most, and every task keeps the best
``k`` rows of each slot while it reads.  What is at or under a limit is the slot it
closes and all lower ones, so the merged slots, in descending order, answer every
window by a suffix; its lower limit only cuts that off.

Anchors are taken in chunks of bounded size that go to all tasks; rows stay where
they are and are read once per chunk and pass.  No list of scores is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.base import ordered, query, stored, table
from barweave.session import run_dir

POSITIVES = 5
K = 10
#: A negative's score is at least 30 and at most 90 hundredths of the positive's.
LOW, HIGH = 30, 90
#: Anchors of a chunk: with 64 components 10 MB, which is sent to all tasks.
CHUNK = 20_000
#: Cells of one score matrix in a task.
CELLS = 4_000_000
LEAST, MOST = -(2**63), 2**63 - 1


@dataclass
class Anchors:
    """A chunk of anchors of one vector length, with the slots they look for."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    #: Upper and lower limits (both inside) of each anchor's slots; empty slots have none between.
    high: np.ndarray
    low: np.ndarray


class Best:
    """The best ``k`` of each (anchor, slot) seen so far: highest scores, ties to the smaller id."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.slots, self.k = slots, k
        self.floor = np.full((anchors, slots), LEAST, dtype=np.int64)
        self.held = [np.empty(0, dtype=np.int64)] * 3

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        key, score, ids = (np.concatenate(x) for x in zip(self.held, (key, score, ids), strict=True))
        # ~score falls where score rises, for the least number too
        order = np.lexsort((ids, ~score, key))
        key, score, ids = key[order], score[order], ids[order]
        starts = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.empty(0, dtype=np.int64)
        rank = np.arange(len(key)) - np.repeat(starts, np.diff([*starts, len(key)]))
        full = rank == self.k - 1
        self.floor.reshape(-1)[key[full]] = score[full]
        self.held = [x[rank < self.k] for x in (key, score, ids)]


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, cut to 64 bits.

    Doubles are exact while no sum can reach 2^53; beyond, whole numbers of any size do the work.
    """
    most = lambda x: float(np.abs(x).max(initial=0.0))
    if most(a) * most(b) * max(1, a.shape[1]) < 2.0**53:
        return np.rint(a @ b.T).astype(np.int64)
    whole = [[int(x) for x in r] for r in b.tolist()]
    rows = ([int(x) for x in r] for r in a.tolist())
    return np.array([[min(max(sum(x * y for x, y in zip(r, o, strict=True)), LEAST), MOST) for o in whole] for r in rows], dtype=np.int64).reshape(len(a), len(b))


def slots_of(positive_scores: list[int], n: int, low: int, high: int) -> tuple[list[int], list[int]]:
    """Upper and lower limits of ``n`` slots, descending; unused ones are empty."""
    windows = [(-(-low * s // 100), high * s // 100) for s in positive_scores]
    windows = [w for w in windows if w[0] <= w[1]]
    uppers = sorted({h for _, h in windows}, reverse=True)
    least = min((a for a, _ in windows), default=0)
    lowers = [u + 1 for u in uppers[1:]] + [least] * bool(uppers)
    empty = n - len(uppers)
    return uppers + [LEAST] * empty, lowers + [MOST] * empty


def scan(rows: DataFrame, groups: list[Anchors], same_label: bool, k: int) -> DataFrame:
    """(anchor, slot, score, id): each task's best ``k`` rows of every slot of every anchor.

    ``rows`` has vec_id, code (of the label) and vector; an anchor's own vec_id is left out.
    """
    slots = max((g.high.shape[1] for g in groups), default=1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(g.ids), slots, k) for g in groups]
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy()
            for g, b in zip(groups, best, strict=True):
                part = batch.filter(pa.array(sizes == g.vectors.shape[1]))
                if not part.num_rows:
                    continue
                ids, codes = part.column("vec_id").to_numpy(), part.column("code").to_numpy()
                x = np.array(part.column("vector").flatten()).reshape(len(ids), -1)
                step = max(1, CELLS // len(g.ids))
                for r in range(0, len(ids), step):
                    at = slice(r, r + step)
                    scores = inner_products(g.vectors, x[at])
                    fits = (g.labels[:, None] == codes[None, at]) == same_label
                    fits &= g.ids[:, None] != ids[None, at]
                    keys, found = [], []
                    for s in range(slots):
                        i, j = np.nonzero(fits & (scores <= g.high[:, s, None]) & (scores >= np.maximum(g.low[:, s], b.floor[:, s])[:, None]))
                        keys.append(i * slots + s), found.append((scores[i, j], ids[at][j]))
                    b.add(np.concatenate(keys), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        for g, b in zip(groups, best, strict=True):
            key, score, ids = b.held
            yield pa.RecordBatch.from_arrays([pa.array(g.ids[key // slots]), pa.array((key % slots).astype(np.int32)), pa.array(score), pa.array(ids)], names=["anchor", "slot", "score", "id"])

    return rows.mapInArrow(work, "anchor long, slot int, score long, id long")


def first_ranks(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each anchor and slot over all tasks, with their rank."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor, positives: int = POSITIVES, k: int = K, low: int = LOW, high: int = HIGH, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``rows`` has vec_id, label and vector, an array of whole numbers as doubles;
    ``is_anchor`` is a condition on vec_id.  Rows with a null in one of the three, or a
    null, NaN or infinite component, take no part; zero vectors do, with scores of 0.
    Vectors of different lengths are not compared.  Higher scores come first, ties by
    smaller vec_id.  A vec_id that repeats is one anchor (its smallest label and
    vector) and a positive or negative for each of its rows, but never the anchor's own;
    a positive that comes twice gets its negatives twice.  A positive with a negative score
    has an empty window.  Scores beyond 64 bits count as the nearest 64-bit number.  Other
    columns are ignored whatever their names; an empty table, or one without anchors, gives no rows.
    """
    spark, out = rows.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    v = F.transform("vector", lambda x: x.cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64("label").alias("code"), F.col("label").isNotNull().alias("_known"), v.alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("_known") & F.col("vector").isNotNull()).drop("_known")
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    one_each = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("code", "vector")).alias("_a")).select("vec_id", "_a.*")
    anchors = stored(ordered(one_each, "vec_id", label="anchor-order"), "anchors")
    folder = run_dir(spark, "hard-negatives")
    for n in range(-(-anchors.count() // chunk)):
        mine_ = anchors.where((F.col("_row") >= n * chunk) & (F.col("_row") < (n + 1) * chunk)).drop("_row")
        taken = mine_.orderBy("vec_id").toArrow()  # at most ``chunk`` rows
        best = stored(first_ranks(scan(rows, chunk_of(taken, None, 1, low, high), True, positives), positives), "positives")
        scores: dict[int, list[int]] = {}
        for r in best.select("anchor", "score").toLocalIterator():  # ``positives`` a row of the chunk
            scores.setdefault(r["anchor"], []).append(r["score"])
        pools = first_ranks(scan(rows, chunk_of(taken, scores, positives, low, high), False, k), k)
        # all slots of an anchor in descending order: at most ``positives`` times ``k`` rows
        pool = pools.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("_down"), "id", "score"))).alias("_pool"))
        p = F.col("_p").cast("decimal(20,0)")
        inside = lambda x: (-x["_down"] * 100 >= p * low) & (-x["_down"] * 100 <= p * high)  # noqa: B023, E731
        each = best.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("_p")).join(pool, "anchor")
        each = each.select("anchor", "positive_id", "_p", F.posexplode(F.slice(F.filter("_pool", inside), 1, k)).alias("_at", "_n"))
        each.select(
            F.col("anchor").alias("anchor_id"), "positive_id", (F.col("_at") + 1).alias("rank"), F.col("_n.id").alias("negative_id"),
            F.col("_p").alias("positive_score"), F.col("_n.score").alias("negative_score"),
        ).write.parquet(f"{folder}/chunk={n}")
    if anchors.isEmpty():
        return spark.createDataFrame([], out)
    return spark.read.schema(out).parquet(f"{folder}/chunk=*")


def chunk_of(taken: pa.Table, scores: dict[int, list[int]] | None, slots: int, low: int, high: int) -> list[Anchors]:
    """Anchors by length of their vectors; without ``scores`` one slot holds all numbers."""
    ids, codes = (np.asarray(taken.column(c)) for c in ("vec_id", "code"))
    vectors = taken.column("vector").to_pylist()
    groups: dict[int, list[int]] = {}
    for i, x in enumerate(vectors):
        if scores is None or ids[i] in scores:
            groups.setdefault(len(x), []).append(i)
    out = []
    for dim, at in groups.items():
        if scores is None:
            limits = [([MOST], [LEAST])] * len(at)
        else:
            limits = [slots_of(scores[ids[i]], slots, low, high) for i in at]
        uppers, lowers = (np.array([x[s] for x in limits], dtype=np.int64) for s in (0, 1))
        out.append(Anchors(ids[at], codes[at], np.array([vectors[i] for i in at], dtype=float).reshape(len(at), dim), uppers, lowers))
    return out


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) QUALIFY row_number() OVER w <= 10"""


def floor_256(x):
    """floor(256 x) as a double; what has no fraction or is not finite stays as it is."""
    return F.when(~F.isnan(x) & (F.abs(x) < 2.0**52), F.floor(256 * x).cast("double")).otherwise(256 * x)


@query("op11_hard_negatives", SQL)
def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: floor_256(x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), whole.alias("vector"))
    return mine(rows, F.col("vec_id") % 100 == 0)
