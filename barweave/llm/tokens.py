"""Token counts by the whole-token shortcut.

The model's merges never cross the place before a word-start mark that follows
another character, nor a line end, because no vocabulary string does; both are
proved on the vocabulary before anything is counted.  So a text falls into
independent pre-tokens.  Which vocabulary strings encode alone as one token is
proved once by encoding each of them; a pre-token among them counts 1 without
any merging, and only the rest go through the library, each distinct one once
per batch of work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.base import bounded_batches, query, table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Distinct merged pre-tokens that one Python worker remembers; all are forgotten when it is full.
REMEMBERED = 300_000
MARK = "▁"


class PieceCounter:
    """Counts tokens as the model at ``path`` gives them, without begin or end tokens."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.remembered = remembered
        self.single = self._prove()
        self.known = dict(self.single)

    def _prove(self) -> dict[str, int]:
        """Words that are one token behind a word start.  Raises where the vocabulary
        does not allow texts to be cut at word starts and line ends."""
        m = self.model
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("vocabulary strings cross word starts or line ends")
        end = m.encode("\n", out_type=str)
        if m.encode("a b", out_type=str) != [f"{MARK}a", f"{MARK}b"] or end[:1] != [MARK] or m.encode("\n\n", out_type=str) != end + end[1:] or len(end) != 2:
            raise ValueError("the model changes white space")
        self.starts = np.array([m.id_to_piece(i).startswith(MARK) for i in range(m.get_piece_size())])
        self.line_end = m.encode("\n")[-1]
        words = [p[1:] for p in pieces if p[0] == MARK and len(p) > 1 and p[1] != MARK]
        return {"": 1} | {w: 1 for w, t in zip(words, m.encode(words, num_threads=1), strict=True) if len(t) == 1}

    def _merge(self, words: list[str]) -> dict[str, int]:
        """Token counts of distinct words.  One that begins with a line end has no word start of its own."""
        out = {}
        for join, own in ((" ", [w for w in words if w[:1] != "\n"]), ("", [w for w in words if w[:1] == "\n"])):
            for i in range(0, len(own), 1000):
                part = own[i : i + 1000]
                ids = np.array(self.model.encode(join.join(part)), dtype=np.int64)
                # each word ends where the next word start or line end stands
                at = np.flatnonzero(self.starts[ids] if join else ids == self.line_end)
                out.update(zip(part, np.diff(at, append=len(ids)).tolist(), strict=True))
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; a null or empty text has none."""
        if len(self.known) > self.remembered + len(self.single):
            self.known = dict(self.single)
        known = self.known
        cut: list[list[str] | None] = []
        missing: set[str] = set()
        for t in texts:
            # runs of spaces and written word-start marks merge among themselves: such texts are encoded whole
            if not t or t[0] == " " or t[-1] == " " or "  " in t or " \n" in t or MARK in t:
                cut.append(None)
            else:
                cut.append(words := t.replace("\n", " \n").split(" "))
                missing.update(set(words).difference(known))
        if missing:
            known.update(self._merge(list(missing)))
        whole = iter(self.model.encode([t or "" for t, words in zip(texts, cut, strict=True) if words is None], num_threads=1))
        return [len(next(whole)) if words is None else sum(map(known.__getitem__, words)) for words in cut]


@cache
def counter(path: str) -> PieceCounter:
    """One per Python worker."""
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every whole ``text``.

    ``path`` is the model file, which every executor must have.  Null and empty texts
    have 0 bytes and 0 tokens; strings that look like special tokens are ordinary
    text, as in the library.  Repeated rows are counted each; other columns of
    ``docs`` are not carried along.  An empty table gives an empty table.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in bounded_batches(batches, "text"):
            text = batch.column("text")
            n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array(count(text.to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


@query("op3_count_tokens")
def op3_count_tokens(spark, sf_dir):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
