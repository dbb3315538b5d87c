"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Documents become term vectors: hashed words, word shapes, and how much of the
text repeats itself.  A singular value decomposition of a bounded sample of
labelled documents gives the latent space; the sample's vectors and labels are
broadcast (their size is bounded by the sample), and every document is compared
with all of them in blocks of exact cosine products.  The most similar ones vote
for their label with a weight that grows with similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm.base import bounded_batches, query, table

#: Labelled documents that are used (those with the smallest hashes of their ids).
SAMPLE = 4096
LATENT = 32
NEIGHBOURS = 15
#: Votes weigh similarity to this power.
SHARPNESS = 8.0
THRESHOLD = 0.7
WORDS, SHAPES = 512, 128
#: Weights of the three kinds of terms.
WORD_WEIGHT, SHAPE_WEIGHT, REPEAT_WEIGHT = 0.3, 1.0, 1.5
#: Distinct words that one Python worker remembers; all are forgotten when it is full.
REMEMBERED = 150_000
SYMBOLS = b"#*$%&|<>"


def _shape(word: bytes) -> int:
    """Kinds of characters in order, runs of a kind once: ``Word,`` is upper, lower, point."""
    kinds = []
    for c in word.decode("utf-8", "replace"):
        kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else "s" if c in "#*$%&|<>" else "!" if c == "!" else "."
        if not kinds or kinds[-1] != kind:
            kinds.append(kind)
    return zlib.crc32("".join(kinds).encode()) % SHAPES


class _Words(dict):
    """word -> hash (upper bits), word bucket and shape."""

    def __missing__(self, word: bytes) -> int:
        h = zlib.crc32(word) ^ (zlib.adler32(word[::-1]) << 15) & 0xFFFFFFFF
        code = (h << 24 | (h % WORDS) << 8 | _shape(word)) & 0x7FFFFFFFFFFFFFFF
        self[word] = code
        return code


_words = _Words()


def term_vectors(texts: list[str | None]) -> np.ndarray:
    """One row per text; a null text and one without words are rows of zeros."""
    out = np.zeros((len(texts), WORDS + SHAPES + 3), dtype=np.float32)
    if len(_words) > REMEMBERED:
        _words.clear()
    for row, text in zip(out, texts, strict=True):
        raw = (text or "").encode()
        words = raw.split()
        if not words:
            continue
        code = np.fromiter(map(_words.__getitem__, words), dtype=np.int64, count=len(words))
        tf = np.log1p(np.bincount((code >> 8) & (WORDS - 1), minlength=WORDS))
        shape = np.sqrt(np.bincount(code & 0xFF, minlength=SHAPES)[:SHAPES] / len(words))
        row[:WORDS] = tf * (WORD_WEIGHT / np.sqrt((tf * tf).sum()))
        row[WORDS : WORDS + SHAPES] = shape * SHAPE_WEIGHT
        lines = [x for x in raw.split(b"\n") if x.strip()]
        again = (code[1:] == code[:-1]).mean() if len(code) > 1 else 0.0
        if len(code) >= 4:
            four = code[:-3] * 31 + code[1:-2] * 961 + code[2:-1] * 29791 + code[3:] * 923521
            loops = 1 - len(np.unique(four)) / len(four)
        else:
            loops = 0.0
        row[-3:] = np.sqrt([again, loops, 1 - len(set(lines)) / len(lines)]) * REPEAT_WEIGHT
    return out


class Voter:
    """Labelled latent vectors; what is broadcast is the projection, the vectors and the labels."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, latent: int = LATENT, neighbours: int = NEIGHBOURS):
        _, _, right = np.linalg.svd(terms.astype(np.float64), full_matrices=False)
        self.to_latent = right[:latent].T.astype(np.float32)
        self.labels, self.neighbours = labels.astype(np.float32), min(neighbours, len(labels))
        self.vectors = self._unit(terms)

    def _unit(self, terms: np.ndarray) -> np.ndarray:
        v = terms @ self.to_latent
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, terms: np.ndarray) -> np.ndarray:
        near = self._unit(terms) @ self.vectors.T
        top = np.argpartition(-near, self.neighbours - 1, axis=1)[:, : self.neighbours]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 1e-3).astype(np.float64) ** SHARPNESS
        share = (weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1)
        return np.where(terms.any(axis=1), np.clip(share, 0.0, 1.0), 0.0)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: CRC-32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, latent: int = LATENT, neighbours: int = NEIGHBOURS) -> Voter | None:
    """A voter from at most ``sample`` labelled rows outside the held-out part; None without any.

    Labels other than 0 and 1 and those of null or unknown ids are left out; of several
    labels of an id the lower counts, of several texts the smallest.  Only term vectors
    (``sample`` rows of fixed length) come to the driver.
    """
    good = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = good.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "text"):
            vectors = [v.tobytes() for v in term_vectors(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(vectors, pa.binary())], names=["doc_id", "quality", "terms"])

    slim = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text")
    rows = slim.mapInArrow(work, "doc_id long, quality int, terms binary").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return None
    terms = np.frombuffer(b"".join(rows["terms"].to_pylist()), dtype=np.float32).reshape(rows.num_rows, -1)
    return Voter(terms, rows["quality"].to_numpy(), latent, neighbours)


def scorer(spark: SparkSession, voter: Voter | None):
    """A function from a text column to scores between 0 and 1.

    A null text and one without words score 0, as nothing speaks for them; without any
    labels (``voter`` None) every other text scores 0.5.
    """
    shared = spark.sparkContext.broadcast(voter)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], names=["text"])
        parts = []
        for part in bounded_batches([batch], "text"):
            terms = term_vectors(part.column("text").to_pylist())
            parts.append(np.where(terms.any(axis=1), 0.5, 0.0) if shared.value is None else shared.value.score(terms))
        return pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return score


def score_quality(docs: DataFrame, voter: Voter | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) added.

    Only ``text`` is looked at.  Columns of ``docs`` with an added name are replaced;
    rows, repeated ones too, stay.
    """
    score = scorer(docs.sparkSession, voter)
    return docs.withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more."""
    return docs.where(scorer(docs.sparkSession, fit(docs, labels))("text") >= threshold)


@query("op4_score_quality")
def op4_score_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
