"""Near-duplicate vectors of one label by E8 lattice hashing, with cosines verified.

A vector of unit length is projected on 16 Gaussian directions per table, and each
half of the projection is decoded to its nearest point of the E8 lattice; the two
points are its cell in that table.  It also probes the cells next to it: those
where one or both halves move by a shortest lattice vector, nearest first.  Two
vectors meet in a table when one of them lies in a cell that the other lies in or
probes, and a pair that meets is linked when its cosine, in double precision, is at
least the threshold.

Equal vectors of a label are one node from the start.  Cells where only one node
is seen go before any vector is moved.  Crowded cells are compared in blocks, so no
task holds more than two blocks whatever the size of a group, and no list of pairs
is written: a block gives back sums of links per node and the links of a spanning
forest.  A pair that meets in several tables or cells counts in the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.base import BROADCAST_ROWS, look_up, query, row_keys, stored, table
from barweave.llm.components import components

THRESHOLD = 0.98
#: Tables, probed cells per table, and the width of the lattice in deviations of a projection.  Two vectors with a
#: cosine of exactly 0.98 meet in a table with probability 0.76, so all tables miss them with probability 6e-7.
TABLES = 10
PROBES = 4
WIDTH = 1.6
#: Nodes of a block of a crowded cell.
BLOCK = 1024
SEED = 11


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            pairs.append(v)
    halves = [v for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.vstack([pairs, halves])


def _even_sum(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum."""
    r = np.rint(x)
    off = x - r
    odd = np.nonzero(r.sum(axis=1) % 2)[0]
    worst = np.abs(off[odd]).argmax(axis=1)
    r[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return r


def nearest_points(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which is the even-sum lattice and its copy moved by halves."""
    whole, half = _even_sum(x), _even_sum(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def cells(unit: np.ndarray, tables: int, probes: int, width: float) -> np.ndarray:
    """(rows, tables, 1 + probes) hashes of each row's own cell and of the cells it probes.

    A cell's hash is linear in its lattice coordinates, so a neighbour's is one addition away.
    """
    n, dim = unit.shape
    rng = np.random.default_rng([SEED, dim])
    directions = rng.standard_normal((dim, tables * 16)) / width
    factors = rng.integers(1, 2**63, size=(tables, 16), dtype=np.int64)
    steps = shortest_vectors()
    per_half = min(probes, 8)
    out = np.empty((n, tables, 1 + probes), dtype=np.int64)
    z = (unit @ directions).reshape(n, tables, 2, 8)
    with np.errstate(over="ignore"):
        for t in range(tables):
            own = np.zeros(n, dtype=np.int64)
            costs, moves = [], []
            for h in (0, 1):
                x, f = z[:, t, h], factors[t, 8 * h : 8 * h + 8]
                at = nearest_points(x)
                own += (np.rint(2 * at).astype(np.int64) * f).sum(axis=1)
                nearness = (x - at) @ steps.T
                first = np.argsort(-nearness, axis=1, kind="stable")[:, :per_half]
                # added squared distance of the neighbours over the own point's
                costs.append(np.hstack([np.zeros((n, 1)), 2 - 2 * np.take_along_axis(nearness, first, axis=1)]))
                hashes = (np.rint(2 * steps).astype(np.int64) * f).sum(axis=1)
                moves.append(np.hstack([np.zeros((n, 1), dtype=np.int64), hashes[first]]))
            cost = (costs[0][:, :, None] + costs[1][:, None, :]).reshape(n, -1)
            move = (moves[0][:, :, None] + moves[1][:, None, :]).reshape(n, -1)
            # the first of all is the own cell, at no cost
            order = np.argsort(cost, axis=1, kind="stable")[:, : 1 + probes]
            out[:, t] = own[:, None] + np.take_along_axis(move, order, axis=1)
    return out


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so that nothing overflows."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` places the smallest place it is joined with by the links ``left``-``right``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            return root


def compare(table_no: np.ndarray, block: np.ndarray, node: np.ndarray, copies: np.ndarray, role: np.ndarray, unit: np.ndarray, own: np.ndarray, seen: np.ndarray, threshold: float, step: int = 20_000):
    """Links of one block: (links per row, smallest row each is joined with).

    ``role`` is 0 for rows of the left side, 1 for the right side's that live in the cell
    and 2 for its visitors.  A pair counts if no earlier table or cell has it.
    """
    t, left, right = int(table_no[0]), np.nonzero(role == 0)[0], np.nonzero(role > 0)[0]
    sums = np.zeros(len(node), dtype=np.int64)
    a, b = np.nonzero(unit[left] @ unit[right].T >= threshold)
    a, b = left[a], right[b]
    apart = (node[a] != node[b]) & ((role[b] == 2) | (node[a] < node[b]))
    a, b = a[apart], b[apart]
    for s in range(0, len(a), step):
        i, j = a[s : s + step], b[s : s + step]
        earlier = (own[i, :t, None] == seen[j, :t]).any(axis=(1, 2)) | (own[j, :t, None] == seen[i, :t]).any(axis=(1, 2))
        # a visitor whose own cell the other visits as well: the smaller node's cell has the pair
        mutual = (role[j] == 2) & (own[j, t, None] == seen[i, t]).any(axis=1) & (node[i] > node[j])
        new = ~(earlier | mutual)
        np.add.at(sums, i[new], copies[j[new]])
        np.add.at(sums, j[new], copies[i[new]])
    return sums, forest(a, b, len(node))


def near_duplicates(
    embeddings: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, block: int = BLOCK
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label).

    Rows link when their labels are equal and not null and the cosine of their vectors
    is at least ``threshold``.  Vectors that are null, empty, zero or hold null, NaN or
    infinite components link with nothing, nor do vectors of different lengths.
    Repeated rows are vectors each: copies of one another, linked, with one component;
    a component's id is the smallest vec_id in it, so rows that repeat the smallest
    are all kept.  A null vec_id is counted as a link of others but names no component
    unless all of its vec_ids are null; then the id is null and the rows are kept.  Very
    long vectors are read whole; columns besides the three are ignored, whatever their names.
    An empty table gives an empty result.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"), "label")
    good = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.exists("embedding", lambda x: x != 0)
    good &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    keyed = row_keys(rows.where(good), "label", "embedding")
    classes = keyed.groupBy("__k1", "__k2").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low")
    )
    # a one-to-one hash of a row's place: nodes in random order keep chains of pointers short
    nodes = stored(classes.withColumn("node", F.xxhash64(F.monotonically_increasing_id())), "lattice-nodes")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("embedding").value_lengths().to_numpy()
            for dim in np.unique(sizes):
                part = b.filter(pa.array(sizes == dim))
                x = np.array(part.column("embedding").flatten()).reshape(-1, dim)
                found = cells(unit_rows(x), tables, probes, width)
                flat = lambda a, k: pa.array(list(a.reshape(len(a), k)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("node"), flat(found, tables * (1 + probes))], names=["node", "seen"])

    # own cell of each table first, then its probes; hashes of a table's cells mean nothing across labels and lengths
    seen = stored(nodes.select("node", "embedding").mapInArrow(place, "node long, seen array<long>"), "lattice-cells")
    vectors = stored(nodes.select("node", "label", "embedding", "copies").join(seen, "node"), "lattice-vectors")
    place_of = F.posexplode("seen").alias("_at", "_cell")
    entries = vectors.select("node", "label", F.size("embedding").alias("_dim"), place_of).select(
        "node",
        F.floor(F.col("_at") / (1 + probes)).cast("int").alias("t"),
        (F.col("_at") % (1 + probes) == 0).alias("lives"),
        F.xxhash64("label", "_dim", F.floor(F.col("_at") / (1 + probes)), "_cell").alias("cell"),
    )
    crowds = entries.groupBy("cell").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("lives").alias("_living"), F.min("node").alias("_a"), F.max("node").alias("_b")
    )
    crowds = stored(crowds.where("_a <> _b and _living > 0").select("cell", F.ceil(F.col("_n") / block).cast("int").alias("_rights"), F.ceil(F.col("_living") / block).cast("int").alias("_lefts")), "lattice-crowds")
    shared = look_up(entries, crowds, "cell")
    # a crowded cell is a grid of blocks: every living row in one row of it, every row in one column
    at_left = F.pmod(F.xxhash64("node", F.lit(1)), F.col("_lefts")).cast("int")
    at_right = F.pmod(F.xxhash64("node", F.lit(2)), F.col("_rights")).cast("int")
    as_left = shared.where("lives").select("cell", "t", "node", F.lit(0).alias("role"), at_left.alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_rights") - 1)).alias("_j"))
    role = F.when(F.col("lives"), 1).otherwise(2)
    as_right = shared.select("cell", "t", "node", role.alias("role"), at_right.alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_lefts") - 1)).alias("_i"))
    sides = as_left.unionByName(as_right)
    unit_key = ["cell", "_i", "_j", "label", "_dim"]
    met = sides.join(vectors, "node").withColumn("_dim", F.size("embedding"))
    ready = met.repartition("cell", "_i", "_j").sortWithinPartitions(*unit_key)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in whole_units(batches, unit_key):
            col = lambda c: unit.column(c).combine_chunks()  # noqa: B023, E731
            number = lambda c: col(c).to_numpy(zero_copy_only=False)
            dim, n = unit.column("_dim")[0].as_py(), len(unit)
            x = unit_rows(np.array(col("embedding").flatten()).reshape(n, dim))
            all_seen = np.array(col("seen").flatten()).reshape(n, tables, 1 + probes)
            node = number("node")
            sums, root = compare(number("t"), number("_i"), node, number("copies"), number("role"), x, all_seen[:, :, 0], all_seen, threshold)
            keep = np.nonzero((sums > 0) | (root != np.arange(n)))[0]
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(node[root[keep]]), pa.array(sums[keep])], names=["a", "b", "n"])

    columns = [*unit_key, "t", "node", "role", "copies", "embedding", "seen"]
    found = stored(ready.select(*columns).mapInArrow(work, "a long, b long, n long"), "lattice-links")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("_links"))
    joined = components(found.where("a <> b").select("a", "b"), "lattice-components")
    member = nodes.select("node", "__k1", "__k2", "low", "copies").join(links, "node", "left").join(joined, "node", "left")
    member = stored(member.where("copies > 1 or _links > 0").withColumn("root", F.coalesce("root", "node")), "lattice-members")
    lows = member.groupBy("root").agg(F.min("low").alias("component_id"))
    known = stored(member.join(lows, "root").select("__k1", "__k2", (F.col("copies") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"), "component_id"), "lattice-decided")
    every = row_keys(rows, "label", "embedding").select("vec_id", F.when(good, F.col("__k1")).alias("__k1"), F.when(good, F.col("__k2")).alias("__k2"))
    out = left_look_up(every, known, ["__k1", "__k2"])
    own = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )


def whole_units(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal ``keys`` together; ``batches`` come sorted by them.  Only an open unit is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        parts = [b.column(k).dictionary_encode().indices.to_numpy() if not pa.types.is_integer(b.column(k).type) else b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, dtype=bool)
        for p in parts:
            new[1:] |= p[1:] != p[:-1]
        first = tuple(b.column(k)[0].as_py() for k in keys)
        new[0] = first != last
        starts = [*np.nonzero(new)[0].tolist(), b.num_rows]
        if not new[0]:
            starts = [0, *starts]
        for s, e in zip(starts, starts[1:], strict=False):
            if new[s] and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
        last = tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def left_look_up(rows: DataFrame, values: DataFrame, keys: list[str], salts: int = 64) -> DataFrame:
    """``look_up`` that keeps rows without a match; ``values`` is a stored table with one row per key."""
    if values.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(values), keys, "left")
    copies = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    return rows.withColumn("_salt", salt).join(copies, [*keys, "_salt"], "left").drop("_salt")


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE list_dot_product(x, x) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.low AS component_id, e.vec_id = c.low AS kept FROM embeddings e
JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) c ON c.a = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = e.vec_id"""


@query("op13_near_duplicate_vectors", SQL)
def op13_near_duplicate_vectors(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
