"""Ranked lexical search: accumulators of short lists inside document-at-a-time skipping.

Documents are read once; what they hold of the items' terms becomes small inverted
files (shards of some thousand documents, written to the shared folder).  Document
frequencies are summed over the shards, then each shard answers every item.  The
short posting lists of an item are added up term at a time into accumulators; the
accumulators become one more list, bounded by their largest sum.  That list and
the long ones are walked in document order: lists whose bounds together cannot
reach the item's tenth score so far offer no candidates, they are only looked into
at the candidates of the others, and a candidate goes as soon as what it has and
the bounds of what is left fall short.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.base import bounded_batches, query, stored, table
from barweave.session import run_dir

K = 10
#: Documents and postings of a shard.
SHARD_DOCS = 4096
SHARD_POSTINGS = 1_000_000
#: Shards that a task reads at once.
SHARDS_READ = 8
#: A list is short when it holds at most one in so many documents of its shard.
SHORT = 32
#: Documents of a step of the walk; bounds are looked at again after each.
STEP = 512
#: Bytes of item texts that are searched for at once; a longer item is alone.
ITEM_BYTES = 4_000_000
#: Letters A-Z become small, other ASCII but digits and letters separates, all other bytes belong to terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LAST = 2**63 - 1

INDEX = (
    "ids array<long>, lengths array<long>, terms array<int>, counts array<int>, places array<int>, tfs array<int>, n_docs long, n_terms long"
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Shard:
    """Postings of some documents, gathered and then sorted by term."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths, self.terms, self.places, self.tfs = array("q"), array("i"), array("i"), array("i")
        self.n_docs = self.n_terms = 0

    def add(self, doc_id: int | None, text: bytes, wanted: dict[bytes, int]) -> None:
        words = terms_of(text)
        if not words:
            return
        self.n_docs += 1
        self.n_terms += len(words)
        found = Counter(words)
        hits = found.keys() & wanted.keys()
        if hits:
            self.terms.extend(wanted[t] for t in hits)
            self.tfs.extend(found[t] for t in hits)
            self.places.extend([len(self.ids)] * len(hits))
            self.ids.append(doc_id)
            self.lengths.append(len(words))

    def record(self) -> pa.RecordBatch:
        terms = np.frombuffer(self.terms, dtype=np.int32) if self.terms else np.empty(0, dtype=np.int32)
        order = np.argsort(terms, kind="stable")
        each, counts = np.unique(terms, return_counts=True)
        take = lambda a: np.frombuffer(a, dtype=np.int32)[order] if a else order.astype(np.int32)
        lists = [pa.array(self.ids, pa.int64()), pa.array(self.lengths, pa.int64()), pa.array(each), pa.array(counts.astype(np.int32)), pa.array(take(self.places)), pa.array(take(self.tfs))]
        columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        names = ["ids", "lengths", "terms", "counts", "places", "tfs", "n_docs", "n_terms"]
        return pa.RecordBatch.from_arrays([*columns, pa.array([self.n_docs]), pa.array([self.n_terms])], names=names)


def index(docs: DataFrame, wanted: dict[bytes, int]) -> DataFrame:
    """Shards of ``docs`` (doc_id, text) over the ``wanted`` terms (numbered)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in bounded_batches(batches, "text"):
            texts = batch.column("text").cast(pa.binary())
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                shard.add(doc_id, text.as_py() or b"", wanted)
                if len(shard.ids) >= SHARD_DOCS or len(shard.terms) >= SHARD_POSTINGS:
                    yield shard.record()
                    shard = Shard()
        if shard.n_docs:
            yield shard.record()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, INDEX)


class Top:
    """Best ``k`` documents of an item: highest scores, ties to the smaller id, none last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.without = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        #: Least score that can still matter.
        self.least = 1

    def add(self, scores: np.ndarray, ids: np.ndarray, without: np.ndarray) -> None:
        scores, ids, without = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.without, without])
        first = np.lexsort((ids, without, -scores))[: self.k]
        self.scores, self.ids, self.without = scores[first], ids[first], without[first]
        if len(first) == self.k:
            self.least = int(self.scores[-1])


def walk(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, top: Top, ids: np.ndarray, without: np.ndarray, short: int = SHORT, step: int = STEP) -> int:
    """Adds the documents of a shard that reach ``top``; gives back how many were scored in full.

    ``lists`` are (places in ascending order, scores of the item there) of its terms.
    """
    if not lists:
        return 0
    few = [x for x in lists if len(x[0]) * short <= n_docs]
    many = [x for x in lists if len(x[0]) * short > n_docs]
    if few:
        # term at a time: the sums of the short lists are one list more
        where = np.concatenate([p for p, _ in few])
        at, which = np.unique(where, return_inverse=True)
        sums = np.zeros(len(at), dtype=np.int64)
        np.add.at(sums, which, np.concatenate([s for _, s in few]))
        many.append((at, sums))
    many.sort(key=lambda x: int(x[1].max()))
    bounds = np.array([int(s.max()) for _, s in many])
    under = np.cumsum(bounds)
    scored = 0
    for start in range(0, n_docs, step):
        # lists that cannot reach the least score together offer no candidates
        idle = int(np.searchsorted(under, top.least, side="left"))
        if idle == len(many):
            break
        parts = []
        for p, s in many[idle:]:
            a, b = np.searchsorted(p, (start, start + step))
            parts.append((p[a:b] - start, s[a:b]))
        sums, seen = np.zeros(step, dtype=np.int64), np.zeros(step, dtype=bool)
        for p, s in parts:
            sums[p] += s
            seen[p] = True
        at = np.nonzero(seen)[0]
        score = sums[at]
        for i in range(idle - 1, -1, -1):
            able = score + under[i] >= top.least
            at, score = at[able], score[able]
            if not len(at):
                break
            p, s = many[i]
            place = np.minimum(np.searchsorted(p, at + start), len(p) - 1)
            score = score + np.where(p[place] == at + start, s[place], 0)
        scored += len(at)
        able = score >= top.least
        if able.any():
            at, score = at[able] + start, score[able]
            top.add(score, ids[at], without[at])
    return scored


def weight(n: int, df: int) -> int:
    return floor(1000 * log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """What an occurrence count is worth in a document of a length, per unit of weight."""
    m = 25 + (75 * lengths * n) // total
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def answer(shards: DataFrame, items: list[tuple[int | None, Counter]], weights: dict[int, int], n: int, total: int, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): each task's best ``k`` documents of every item.

    ``items`` are (item_id, occurrences of each term number).
    """
    wanted = [(i, [(t, c * weights[t]) for t, c in terms.items() if weights.get(t)]) for i, terms in items]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [Top(k) for _ in wanted]
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r].values  # noqa: B023, E731
                ids = get("ids")
                without = ids.is_null().to_numpy(zero_copy_only=False)
                ids, lengths = ids.fill_null(LAST).to_numpy(), get("lengths").to_numpy()
                places, tfs = get("places").to_numpy(), get("tfs").to_numpy().astype(np.int64)
                ends = np.cumsum(get("counts").to_numpy())
                spans = {t: (a, b) for t, a, b in zip(get("terms").to_pylist(), [0, *ends.tolist()], ends.tolist(), strict=False)}
                worth = impacts(tfs, lengths[places], n, total)
                for (_, terms), top in zip(wanted, tops, strict=True):
                    spots = [(spans[t], w) for t, w in terms if t in spans]
                    walk([(places[a:b], w * worth[a:b]) for (a, b), w in spots], len(ids), top, ids, without)
        rows = [(q, i, None if w else d, s) for q, ((i, _), t) in enumerate(zip(wanted, tops, strict=True)) for d, s, w in zip(t.ids.tolist(), t.scores.tolist(), t.without.tolist(), strict=True)]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in range(4)], names=["item", "item_id", "doc_id", "score"])

    return shards.mapInArrow(work, "item int, item_id long, doc_id long, score long")


def chunks(items: DataFrame, most_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items in order of their ids, as many at once as ``most_bytes`` of text hold (one at least)."""
    held: list[tuple[int | None, bytes]] = []
    size = 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toLocalIterator():
        text = (r["text"] or "").encode("utf-8", "surrogatepass")
        if held and size + len(text) > most_bytes:
            yield held
            held, size = [], 0
        held.append((r["item_id"], text))
        size += len(text)
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = K, most_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score: the ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text).

    Terms are runs of digits, letters and characters outside ASCII, with only A-Z
    lower-cased; whole texts are read, of any length.  A null or empty text holds no
    term: such a document is in no count, such an item finds nothing.  Scores are whole
    numbers; equal ones rank by ascending doc_id, documents without an id last.  Every
    row of ``docs`` is a document, so a repeated row can be found twice, and every row of
    ``items`` a search of its own: a repeated item returns its rows as often.  Other columns are
    ignored whatever their names.  No document or no item gives no rows.
    """
    spark, out = docs.sparkSession, "item_id long, rank int, doc_id long, score long"
    folder, n_chunks = run_dir(spark, "search"), 0
    for at, chunk in enumerate(chunks(items, most_bytes)):
        numbers: dict[bytes, int] = {}
        asked = [(i, Counter(numbers.setdefault(t, len(numbers)) for t in terms_of(text))) for i, text in chunk]
        shards = stored(index(docs, numbers), "search-shards")
        n, total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        # one row per term of the chunk's items
        dfs = shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df")).collect()
        weights = {r["terms"]: weight(n, r["df"]) for r in dfs}
        size = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = spark.conf.get(size)
        spark.conf.set(size, str(SHARDS_READ))
        try:
            found = stored(answer(shards, asked, weights, n, max(total, 1), k), "search-found")
        finally:
            spark.conf.set(size, before)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best.select("item_id", "rank", "doc_id", "score").write.parquet(f"{folder}/chunk={at}")
        n_chunks += 1
    if not n_chunks:
        return spark.createDataFrame([], out)
    return spark.read.schema(out).parquet(f"{folder}/chunk=*")


SQL = """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+')) AS term FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), a AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
d AS (SELECT doc_id, 25 + (75 * n * big_n) // big_l AS m FROM n, a),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, a GROUP BY term, big_n),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+')) AS term FROM benchmark),
c AS (SELECT item_id, term, count(*) AS c FROM q GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM c JOIN w USING (term) JOIN tf USING (term) JOIN d USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER r AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW r AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER r <= 10"""


@query("op12_ranked_search", SQL)
def op12_ranked_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
