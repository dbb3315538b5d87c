"""Tokenising and packing into sequences by bounded-space best fit.

A task reads its documents once: it turns them into token ids, cuts the longer
ones and places every piece in the open bin it fills best.  A fixed number of
bins is open; their free space is a bitset, so the best bin is one shift and one
lowest bit away, and when too many are open the fullest closes.  The
pieces in bins that tasks still have open at their end are packed again by their
lengths, the longest first, in rounds that join ever more tasks, until one group
is left.  Ids stay where they are; only the new places are joined back.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, compress, count, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.base import BROADCAST_ROWS, bounded_batches, query, stored, table

MODEL = "word_bpe_49k.json"
SIZE = 4096
END_ID = 1
#: Bins a task keeps open; more fill sequences better, in a few KB each.
OPEN_BINS = 256
#: Tasks whose last open bins are packed together in each further round.
FAN_IN = 64
#: Distinct words and parts of words whose ids one Python worker remembers; all are forgotten when it is full.
REMEMBERED = 1_200_000
#: ASCII separators that Python's split() takes for white space and the tokenizer does not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"


#: Words of printable ASCII and Latin letters whose small forms stay among them; how the splitter takes them apart.
PLAIN = re.compile(r"[!-~\u00c0-\u012f\u0131-\u017f]+")
LETTER = r"a-z\u00df-\u00f6\u00f8-\u017f"
PART = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|\n|[^{LETTER}0-9\n]+")
#: Stands between the ids of words: no id of 16 bits holds it, nor do two in a row.
BETWEEN = b"\xff" * 4
#: What the model file must say for words to be encoded on their own, and for plain words to be split as above.
NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers, equal to the library's.

    The model's normaliser and splitter never look across white space, so each
    distinct word is encoded once and its bytes are joined.  Plain words are split
    here and only their parts reach the library's merges, without the normaliser's
    cost; all other words take the library's whole path.  Where the model file is of
    another kind, or white space counts differently, whole texts do.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"\n": BETWEEN}
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = self.model.get_vocab()
        self.by_word = (
            (spec["normalizer"] or {}).get("normalizers") == NORMALISER
            and [(x["type"], x.get("pattern")) for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])] == [("Split", {"Regex": SPLITTER}), ("ByteLevel", None)]
            and spec["model"].get("end_of_word_suffix") == "</w>"
            and not any(c.isspace() for t in self.special for c in t)
            and max(vocabulary.values()) < 1 << 16
        )
        self.merges = Tokenizer(self.model.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.alphabet = _byte_letters() | {32: " "}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, parts: list[str]) -> None:
        """Ids of new parts; each ends with its only token that closes a word."""
        for i in range(0, len(parts), 2000):
            some = parts[i : i + 2000]
            joined = " ".join(some).encode().decode("latin-1").translate(self.alphabet)
            ids = np.array(self.merges.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            raw, cut = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cut) != len(some):
                raise ValueError("a part has no closing token")
            self.parts.update((p, raw[a:b]) for p, a, b in zip(some, [0, *cut], cut, strict=False))

    def _learn(self, words: set[str]) -> None:
        plain = list(filter(PLAIN.fullmatch, words))
        joined = "\n".join(plain)
        if any(t in joined for t in self.special):
            plain = [w for w in plain if not any(t in w for t in self.special)]
            joined = "\n".join(plain)
        if len(plain) < len(words):
            rest = list(words.difference(plain))
            self.known.update(zip(rest, self._encode(rest), strict=True))
        if plain:
            parts = PART.findall(joined.lower())
            self._merge(list(set(parts).difference(self.parts)))
            self.known.update(zip(plain, b"".join(map(self.parts.__getitem__, parts)).split(BETWEEN), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) + len(self.parts) > self.remembered:
            self.known, self.parts = {}, {"\n": BETWEEN}
        cut: list[list[str] | None] = []
        for t in texts:
            whole = t and (not self.by_word or any(c in t for c in NOT_SPACE))
            cut.append(None if whole else t.split() if t else [])
        words = [*chain.from_iterable(c for c in cut if c is not None)]
        ids = [*map(self.known.get, words)]
        if missing := set(compress(words, map(is_, ids, repeat(None)))):
            self._learn(missing)
            known = self.known
            for i in [*compress(count(), map(is_, ids, repeat(None)))]:
                ids[i] = known[words[i]]
        whole = iter(self._encode([t for t, c in zip(texts, cut, strict=True) if c is None]))
        out, at = [], 0
        for c in cut:
            if c is None:
                out.append(next(whole))
            else:
                out.append(b"".join(ids[at : at + len(c)]))
                at += len(c)
        return out


@cache
def encoder(path: str, remembered: int) -> WordEncoder:
    """One per Python worker, single-threaded like the task it works in."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path, remembered)


class Bins:
    """Bounded-space best fit: at most ``open_bins`` bins that still have room."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.most = size, open_bins
        self.free = 0  # bit f: some open bin has f free
        self.at: dict[int, list[int]] = {}
        self.count = self.made = 0
        self.items: dict[int, list] = {}

    def place(self, length: int, item=None) -> tuple[int, int]:
        """(bin, offset) for a piece of ``length``; ``item`` stands for it in ``left``."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            bins = self.at[room]
            b = bins.pop()
            if not bins:
                self.free ^= 1 << room
            self.count -= 1
        else:
            room, b = self.size, self.made
            self.made += 1
        left = room - length
        self.items.setdefault(b, []).append((self.size - room, length, item))
        if not left:
            del self.items[b]
        else:
            self.at.setdefault(left, []).append(b)
            self.free |= 1 << left
            self.count += 1
            if self.count > self.most:
                fullest = (self.free & -self.free).bit_length() - 1
                bins = self.at[fullest]
                del self.items[bins.pop()]
                if not bins:
                    self.free ^= 1 << fullest
                self.count -= 1
        return b, self.size - room

    def left(self) -> list[tuple[int, int, int, object]]:
        """(bin, offset, length, item) of the pieces in bins that still have room."""
        return [(b, *x) for b, items in self.items.items() for x in items]


PIECES = "doc_id long, piece int, start long, length long, ids binary, task long, bin long, offset long"


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, open_bins: int = OPEN_BINS, fan_in: int = FAN_IN, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids, sequence_id, offset.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone.
    Only documents longer than ``size`` are cut, into pieces of ``size`` and a rest.
    Pieces of a sequence are gapless from 0 and add up to ``size`` at most.  Repeated
    rows are packed each.  Other columns are not carried along.  An empty table gives
    an empty table.  ``remembered`` bounds the words a Python worker keeps (about 210
    bytes each); it changes speed only.  The order of packing follows the partitions of ``docs``, so the
    result is written once to the shared folder before it is used.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, bins, task = encoder(path, remembered).encode, Bins(size, open_bins), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids", "task", "bin", "offset"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in bounded_batches(batches, "text"):
            out = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                ids += end
                for k in range(0, len(ids), 4 * size):
                    part = ids[k : k + 4 * size]
                    b, offset = bins.place(len(part) // 4)
                    out.append((doc, k // (4 * size), k // 4, len(part) // 4, part, task, b, offset))
            yield rows(out)
        if left := bins.left():  # rows without a document: pieces in bins that are still open
            yield rows([(None, None, None, n, None, task, b, offset) for b, offset, n, _ in left])

    placed = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, PIECES), "packed")
    moves = _join_open_bins(placed.where("ids is null").select("task", "bin", "offset", "length"), size, open_bins, fan_in)
    pieces = placed.where("ids is not null").withColumn("ids_crc32", F.crc32("ids"))
    return (
        pieces.join(F.broadcast(moves) if moves.count() <= BROADCAST_ROWS else moves, ["task", "bin", "offset"], "left")
        .withColumn("sequence_id", F.coalesce("to_task", "task") * (1 << 40) + F.coalesce("to_bin", "bin"))
        .withColumn("offset", F.coalesce("to_offset", "offset"))
        .select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset")
    )


def _join_open_bins(left: DataFrame, size: int, open_bins: int, fan_in: int) -> DataFrame:
    """(task, bin, offset) -> (to_task, to_bin, to_offset): where the pieces in bins that tasks left open go.

    Each round packs the pieces of ``fan_in`` neighbours anew, the longest first, and
    hands on what its ``open_bins`` emptiest bins hold.  New bins belong to negative
    task numbers, one for each group of each round.
    """
    columns = ["task", "bin", "offset", "length", "to_task", "to_bin", "to_offset", "at", "open"]
    kinds = "task long, bin long, offset long, length long, to_task long, to_bin long, to_offset long, at long, open boolean"

    def packer(number: int):
        def work(rows):
            import pandas as pd

            at = int(rows["at"].iloc[0]) // fan_in
            bins, out = Bins(size, len(rows)), []
            rows = rows.sort_values(["length", "task", "bin", "offset"], ascending=[False, True, True, True])
            for task, b, offset, length in zip(*(rows[c].tolist() for c in columns[:4]), strict=True):
                out.append([task, b, offset, length, -((number << 20) + at + 1), *bins.place(length, len(out)), at, False])
            emptiest = {b for _, b in sorted(((f, b) for f, held in bins.at.items() for b in held), reverse=True)[:open_bins]}
            for b, _, _, i in bins.left():
                out[i][-1] = b in emptiest
            return pd.DataFrame(out, columns=columns)

        return work

    groups = (left.agg(F.max("task")).first()[0] or 0) + 1  # one number
    moves = left.select("task", "bin", "offset", F.col("task").alias("to_task"), F.col("bin").alias("to_bin"), F.col("offset").alias("to_offset"))
    left, number = left.withColumn("at", F.col("task")), 0
    while groups > 1:
        number, groups = number + 1, -(-groups // fan_in)
        packed = stored(left.groupBy(F.floor(F.col("at") / fan_in).alias("_group")).applyInPandas(packer(number), kinds), "bins")
        places = ["to_task", "to_bin", "to_offset"]
        step = packed.select(*[F.col(c).alias(f"to_{c}") for c in ("task", "bin", "offset")], *[F.col(c).alias(f"_{c}") for c in places])
        moves = stored(moves.join(step, places, "left").select("task", "bin", "offset", *[F.coalesce(f"_{c}", c).alias(c) for c in places]), "moves")
        left = packed.where("open").select(F.col("to_task").alias("task"), F.col("to_bin").alias("bin"), F.col("to_offset").alias("offset"), "length", "at")
    return moves


@query("op9_pack_sequences")
def op9_pack_sequences(spark, sf_dir):
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
