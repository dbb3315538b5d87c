"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Documents with equal shingle sets are one node.  A node's signature, rotated to
``TREES`` starts, gives as many sorted orders; nodes that share the first
``DEPTH`` values of an order form a region of that tree.  Neighbours with the
longest common prefixes are compared first, which joins copies of one text into
classes with a number of comparisons linear in the nodes.  What is left are
regions with several classes: there every node outside the region's largest
class is compared with the nodes of other classes in blocks of bounded size, by signatures
and, where those agree enough, by full sets; only links that join classes leave a
block.  Regions of any size are met this way at the same depth, so which pairs are looked
at does not depend on how many rows there are.  The price is named: a region of n nodes
of which m lie outside its largest class costs n * m comparisons of signatures, in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.base import bounded_batches, by_keys, query, row_keys, stored, table
from barweave.llm.components import components

#: Words of a shingle.
SHINGLE = 5
THRESHOLD = 80
#: Signature values, orders, and values that neighbours must share.
VALUES, TREES, DEPTH = 128, 32, 4
#: Candidates of each node that are compared first.
FIRST = 3
#: Signature agreement below which a pair is not looked at: 5.8 standard deviations under that of a similarity of 0.8.
AGREEMENT = 76
#: Rows of a block of a region or class in one task.
BLOCK = 1024

_RANDOM = np.random.default_rng(20_24)
_A = (_RANDOM.integers(1, 2**63, VALUES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RANDOM.integers(0, 2**63, VALUES, dtype=np.uint64)
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text: ``size`` words with A-Z as a-z, or all if fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(h) - size + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total = _mix(total * _M[k % 4] + h[k : k + n])
    return np.unique(total)


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 bits of each of ``VALUES`` minima of random linear maps of the hashes."""
    low = np.full(VALUES, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[i : i + 2048, None] * _A + _B).min(axis=0))
    return (_mix(low) >> np.uint64(40)).astype(np.uint16)


def _shingled(docs: DataFrame, keys: list[str], size: int, full: bool) -> DataFrame:
    """``keys`` and the digest of each document's shingle set (null without words), with the set itself if
    ``full``, else with its size and signature."""
    slim = docs.select(*keys, "text")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name in keys]
    more = ["shingles"] if full else ["n_shingles", "signature"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "text"):
            sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
            raw = [s.tobytes() for s in sets]
            columns = [*[batch.column(k) for k in keys], pa.array([hashlib.blake2b(b, digest_size=16).digest() if b else None for b in raw], pa.binary())]
            if full:
                columns.append(pa.array(raw, pa.binary()))
            else:
                columns += [pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "digest", *more])

    return slim.mapInArrow(work, ", ".join([*kinds, "digest binary", "shingles binary" if full else "n_shingles long, signature binary"]))


def _tree_rows(nodes: DataFrame) -> DataFrame:
    """(tree, p1, p2, digest): the first and the next four values of each order of a node's signature."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = VALUES // TREES
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint16).reshape(n, VALUES)
            words = values.reshape(n, TREES, step).astype(">u2").view(">i8").reshape(n, TREES).astype(np.int64)
            digest = batch.column("digest").take(pa.array(np.repeat(np.arange(n), TREES)))
            columns = [pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), pa.array(words.ravel()), pa.array(np.roll(words, -1, axis=1).ravel()), digest]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "p1", "p2", "digest"])

    return nodes.select("digest", "signature").mapInArrow(work, "tree int, p1 long, p2 long, digest binary")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in sorted order those that share a region with the row before or behind, with the row before and
    the length of the common prefix.  The first and last row of a partition stay, as what is beyond is not seen."""
    held, first = None, True
    names = ["tree", "p1", "p2", "digest", "before", "common"]

    def out(t: pa.Table, keep: np.ndarray, same: np.ndarray):
        p2 = t["p2"].to_numpy().view(np.uint64)
        apart = np.zeros(len(p2), dtype=np.uint64)
        apart[1:] = p2[1:] ^ p2[:-1]
        common = 4 + sum((apart >> np.uint64(s) == 0).astype(np.int32) for s in (48, 32, 16, 0))
        d = t["digest"].combine_chunks()
        index = np.flatnonzero(keep)
        before = pa.array(np.maximum(index - 1, 0), mask=~same[index])
        cols = [t[c].combine_chunks().take(pa.array(index)) for c in names[:4]]
        yield pa.RecordBatch.from_arrays([*cols, d.take(before), pa.array(common[index], pa.int32())], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t])
        key = t["p1"].to_numpy(), t["tree"].to_numpy()
        same = np.zeros(len(t) + 1, dtype=bool)
        same[1:-1] = (key[0][1:] == key[0][:-1]) & (key[1][1:] == key[1][:-1])
        keep = same[:-1] | same[1:]
        if first:
            keep[0], first = True, False
        # the first held row was judged with its batch, all but for the row behind it; the last row waits
        if held is not None and len(held) == 2:
            keep[0] = False
        keep[-1] = False
        if keep.any():
            yield from out(t, keep, same[:-1])
        held = t.slice(max(0, len(t) - 2))
    if held is not None:
        same = np.zeros(len(held), dtype=bool)
        if len(held) == 2:
            a, b = held.to_pylist()
            same[1] = (a["tree"], a["p1"]) == (b["tree"], b["p1"])
        keep = np.zeros(len(held), dtype=bool)
        keep[-1] = True
        yield from out(held, keep, same)


def _sets_of(docs: DataFrame, size: int, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, shingles), one row per wanted digest.

    Full sets are larger than the texts, so they are not kept: the texts of the wanted
    nodes are found by their keys and shingled again.
    """
    keys = stored(wanted.join(nodes, "digest").select("text.*"), "forest-texts")
    texts = by_keys(row_keys(docs, "text"), keys, "left_semi")
    return stored(_shingled(texts, [], size, True).groupBy("digest").agg(F.first("shingles").alias("shingles")), "forest-sets")


def _linked(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if 100 * min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= THRESHOLD * (len(both) - inter)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that full sets confirm."""

    @F.arrow_udf("boolean")
    def linked(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([_linked(a, b) for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.bool_())

    at = lambda c, s: sets.select(F.col("digest").alias(c), F.col("shingles").alias(s))
    return pairs.join(at("a", "_x"), "a").join(at("b", "_y"), "b").where(linked("_x", "_y")).select("a", "b")


def _dealt(rows: DataFrame, key: str, size: Column, asked: DataFrame, asked_size: Column, columns: list[str]) -> DataFrame:
    """Rows and askers of each ``key`` in units of bounded size: (unit, key, left, right, *columns).

    A small key goes whole to one of many shared units.  A key with more than ``BLOCK``
    rows or askers is cut into blocks of rows and chunks of askers, and each block meets
    each chunk in a unit of its own.  ``left`` rows are met by ``right`` rows.
    """
    blocks, chunks = F.ceil(size / BLOCK).cast("int"), F.ceil(asked_size / BLOCK).cast("int")
    n = max(1, rows.sparkSession.sparkContext.defaultParallelism, int(rows.count() // (4 * BLOCK)))
    shared = F.concat_ws("-", F.lit("s"), F.pmod(F.xxhash64(key), F.lit(n)))
    unit = F.when((blocks <= 1) & (chunks <= 1), shared).otherwise(F.concat_ws("-", F.hex(key), "_block", "_chunk"))
    one = rows.withColumn("_block", F.pmod(F.xxhash64("digest"), blocks)).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.greatest(chunks, F.lit(1)) - 1)))
    two = asked.withColumn("_chunk", F.pmod(F.xxhash64("digest"), chunks)).withColumn("_block", F.explode(F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)) - 1)))
    side = lambda d, left: d.select(unit.alias("unit"), key, F.lit(left).alias("left"), *columns)
    return side(one, True).unionAll(side(two, False))


def _mixed(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` (region, digest, root) of regions with several classes, with the region's rows, its largest class
    and the rows of all others."""
    per = rows.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = per.groupBy("region").agg(
        F.sum("n").alias("_rows"), (F.sum("n") - F.max("n")).alias("_others"), F.max_by("root", F.struct("n", "root")).alias("_largest"), F.count(F.lit(1)).alias("_classes")
    )
    return stored(rows.join(stored(mixed.where("_classes > 1").drop("_classes"), label), "region"), label)


def _meet(rows: DataFrame, values: DataFrame, column: str, work, schema: str) -> DataFrame:
    """``work`` over units in which the rows outside a region's largest class meet its rows, with ``column`` of ``values``."""
    held = rows.join(values.select("digest", column), "digest")
    dealt = _dealt(held, "region", F.col("_rows"), held.where("root <> _largest"), F.col("_others"), ["digest", "root", column])
    return dealt.groupBy("unit").applyInPandas(work, schema)


def _regions_of(unit: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, pd.DataFrame]]:
    for region, g in unit.groupby("region", sort=False):
        left, right = g[g["left"]], g[~g["left"]]
        if len(left) and len(right):
            yield region, left, right


def _alike(unit: pd.DataFrame) -> pd.DataFrame:
    """(region, digest, root) of the nodes of a unit that agree enough with one of another class."""
    found = []
    for region, left, right in _regions_of(unit):
        values = np.frombuffer(b"".join(left["signature"]), dtype=np.uint16).reshape(len(left), VALUES)
        codes, names = pd.factorize(left["root"])
        own = pd.Index(names).get_indexer(right["root"])
        met = np.zeros(len(left), dtype=bool)
        for d, root, code, s in zip(right["digest"], right["root"], own, right["signature"], strict=True):
            near = ((values == np.frombuffer(s, dtype=np.uint16)).sum(axis=1) >= AGREEMENT) & (codes != code)
            if near.any():
                met |= near
                found.append((region, d, root))
        found += [(region, d, r) for d, r in zip(left["digest"][met], left["root"][met], strict=True)]
    return pd.DataFrame(found, columns=["region", "digest", "root"])


def _confirmed(unit: pd.DataFrame) -> pd.DataFrame:
    """(a, b): links of classes by full sets, no more than join what a unit's regions link."""
    found = []
    for _, left, right in _regions_of(unit):
        sets = [np.frombuffer(x, dtype=np.uint64) for x in left["shingles"]]
        length = np.array([len(s) for s in sets])
        # an inverted index of the block: one look-up gives the common shingles with all its sets
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), length)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        roots = left["root"].tolist()
        up: dict[bytes, bytes] = {}

        def top(c: bytes, up=up) -> bytes:
            while c in up:
                c = up[c]
            return c

        for own, x in zip(right["root"], right["shingles"], strict=True):
            s = np.frombuffer(x, dtype=np.uint64)
            start, end = np.searchsorted(every, s, "left"), np.searchsorted(every, s, "right")
            n = end - start
            at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
            inter = np.bincount(owner[at], minlength=len(sets))
            for i in np.flatnonzero(100 * inter >= THRESHOLD * (length + len(s) - inter)):
                a, b = top(own), top(roots[i])
                if a != b:
                    up[a] = b
                    found.append((own, roots[i]))
    return pd.DataFrame(found, columns=["a", "b"])


def _region_links(regions: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, roots: DataFrame) -> DataFrame:
    """(a, b): roots of classes with linked nodes, from regions (region, digest) with several classes.

    Signatures first find the nodes that may be linked with another class, at most one
    row per node and region; only their full sets are read.
    """
    rows = regions.join(roots, regions["digest"] == roots["node"], "left").select("region", "digest", F.coalesce("root", "digest").alias("root"))
    alike = _meet(_mixed(rows, "forest-mixed"), nodes, "signature", _alike, "region long, digest binary, root binary").distinct()
    alike = _mixed(stored(alike, "forest-alike"), "forest-alike")
    sets = _sets_of(docs, size, nodes, alike.select("digest").distinct())
    return _meet(alike, sets, "shingles", _confirmed, "a binary, b binary")


def classes(docs: DataFrame, keys: list[str], size: int = SHINGLE) -> DataFrame:
    """``keys`` of ``docs`` (keys, text) with n_shingles and ``root``: equal for all documents that links join,
    null for those without words."""
    read = stored(_shingled(row_keys(docs, "text"), [*keys, "__k1", "__k2"], size, False), "forest-docs")
    known = read.where("digest is not null").groupBy("digest")
    nodes = stored(known.agg(F.first("signature").alias("signature"), F.min(F.struct("__k1", "__k2")).alias("text")), "forest-nodes")
    order = ["tree", "p1", "p2", "digest"]
    rows = _tree_rows(nodes).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.mapInArrow(_neighbours, "tree int, p1 long, p2 long, digest binary, before binary, common int"), "forest-order")

    # neighbours with the longest common prefixes over all orders first
    pairs = rows.where("before is not null").groupBy(F.least("digest", "before").alias("a"), F.greatest("digest", "before").alias("b")).agg(F.sum("common").alias("common"))
    ends = stored(pairs, "forest-pairs")
    ends = ends.unionAll(ends.select(F.col("b").alias("a"), F.col("a").alias("b"), "common"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("common"), "b"))
    best = ends.withColumn("_rank", rank).where(F.col("_rank") <= FIRST)
    best = stored(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "forest-first")
    wanted = best.select(F.col("a").alias("digest")).unionAll(best.select("b")).distinct()
    roots = components(stored(_verified(best, _sets_of(docs, size, nodes, wanted)), "forest-links"), "forest-classes")

    # then what regions with several classes still hold
    regions = stored(rows.select("digest", F.xxhash64("tree", "p1").alias("region")), "forest-regions")
    links = _region_links(regions, nodes, docs, size, roots)
    further = components(stored(links, "forest-links"), "forest-joined").select(F.col("node").alias("root"), F.col("root").alias("_to"))
    roots = roots.select("node", "root").unionAll(further.join(roots, further["root"] == roots["node"], "left_anti").select("root", "root"))
    roots = stored(roots.join(further, "root", "left").select(F.col("node").alias("digest"), F.coalesce("_to", "root").alias("_root")), "forest-roots")

    return stored(read.select(*keys, "n_shingles", "digest").join(roots, "digest", "left").select(*keys, "n_shingles", F.coalesce("_root", "digest").alias("root")), "forest-placed")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document (doc_id, text).

    Two documents are linked when the Jaccard similarity of their sets of distinct
    word shingles is 0.8 or more; component_id is the smallest doc_id that links reach.
    Null and empty texts, and those of white space, have no shingles and no links.  Rows
    that repeat, or share a doc_id, are copies like others; of rows that share the
    smallest doc_id all are ``kept``.  A null doc_id counts as larger than any other.
    An empty table gives an empty table.  Texts are shingled whole, however long.  Only
    doc_id and text are read: other columns, of whatever name, change nothing.
    """
    placed = classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], size)
    least = stored(placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("_least")), "forest-least")
    out = placed.join(least, "root", "left").withColumn("component_id", F.coalesce("_least", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id (null last).

    Rows without words have no duplicates and stay.  Of equal rows one stays.
    """
    keyed = row_keys(docs, "doc_id", "text").withColumnsRenamed({"__k1": "__r1", "__k2": "__r2"})
    keys = ["__r1", "__r2"]
    placed = classes(keyed.select("doc_id", *keys, "text"), ["doc_id", *keys], size).where("root is not null")
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *keys)
    best = stored(placed.groupBy("root").agg(F.min(first).alias("first")), "forest-best")
    judged = placed.join(best, "root").select(*keys, ((F.col("first.__r1") == F.col("__r1")) & (F.col("first.__r2") == F.col("__r2"))).alias("best"))
    counted = stored(judged.groupBy(*keys).agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("n")), "forest-kept")
    gone, several = stored(counted.where("not best").select(*keys), "forest-gone"), stored(counted.where("best and n > 1").select(*keys), "forest-several")
    stay = by_keys(keyed, gone, "left_anti")
    return by_keys(stay, several, "left_anti").unionAll(by_keys(stay, several, "left_semi").dropDuplicates(keys)).select(*docs.columns)


@query("op1_near_duplicates")
def op1_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4)
