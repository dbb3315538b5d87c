import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from barweave.llm import packing, tokens

SF = "/root/testdata/sf0.001"
PIECE, WORD = public_tokenizers.path(tokens.MODEL), public_tokenizers.path(packing.MODEL)
ODD = [
    None, "", " ", "\n", " \n", "\n\n", " a", "a ", "a\n b", "a \nb", "▁x y", "a▁b", "x <s> </s> y", "😀 é ", "a\tb\r\nc", "\r\n x", "Ünḯ ﬁ　x", "a\n\n\nb c", "<0x0A> b", "\x00 \x01",
    "a<|endoftext|>b c <|startoftext|>", "it's I'LL 's' don't 'S '''s", "İstanbul ΣΑΣ ﬁ é ́a", "a\x1cb \x85 c　d e", "日本語 テキスト", "١٢٣ ²³½ ___", "ŸſŉŒ×÷ßẞ Àé123--'d", "word " * 30_000,
]


def noise(n=300):
    rnd = random.Random(5)
    return ["".join(rnd.choice("abcXYZ'sretmldv 019.,!#éıſ×ªº²<|>_-\n") for _ in range(60)) for _ in range(n)]


def test_counts_equal_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = ODD + noise()
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in tokens.count_tokens(d.selectExpr("*", "1 as n_tokens"), PIECE).collect()}
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 4096), repr(t)[:80]
    assert tokens.count_tokens(d.limit(0), PIECE).count() == 0


def test_counts_of_the_registered_query(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.op3_count_tokens(spark, SF).collect()}
    assert got == {i: len(model.encode(t)) for i, t in text.items()}


def test_counter_forgets_and_still_counts():
    few = tokens.PieceCounter(PIECE, remembered=3)
    many = tokens.PieceCounter(PIECE)
    assert [few.count([t])[0] for t in noise(50)] == many.count(noise(50))


def test_whole_tokens_are_proved():
    c = tokens.PieceCounter(PIECE)
    assert len(c.single) > 10_000 and all(len(c.model.encode(w)) == 1 for w in list(c.single)[1:500])


def test_ids_equal_the_library():
    model = Tokenizer.from_file(WORD)
    for remembered in (5, 10_000):
        e = packing.WordEncoder(WORD, remembered)
        assert e.by_word
        for t in ODD + noise():
            want = np.array(model.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes()
            assert e.encode([t]) == [want], repr(t)[:80]


def check_packing(rows, texts, size):
    model = Tokenizer.from_file(WORD)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and [r["start"] for r in parts] == [size * k for k in range(len(parts))]
        assert all(r["length"] == size for r in parts[:-1]) and sum(r["length"] for r in parts) == len(ids)
        for r in parts:
            want = ids[r["start"] : r["start"] + r["length"]].tobytes()
            assert bytes(r["ids"]) == want and r["ids_crc32"] == zlib.crc32(want)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence), -(-sum(r["length"] for r in rows) // size)


@pytest.mark.parametrize("partitions", [1, 9])
def test_packing_is_whole_and_tight(spark, partitions):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()} | {10_000 + i: t for i, t in enumerate(ODD)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(partitions)
    used, bound = check_packing(packing.pack(d, WORD).collect(), texts, 4096)
    assert used <= bound * 1.05 + 1


def test_many_tasks_join_their_open_bins(spark):
    texts = {i: "a b c d e f g" for i in range(300)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(60)
    used, bound = check_packing(packing.pack(d, WORD, size=64, open_bins=4, fan_in=3).collect(), texts, 64)
    assert (used, bound) == (38, 38)  # eight documents of eight tokens each


def test_bins_close_the_fullest():
    b = packing.Bins(10, 2)
    assert [b.place(n) for n in (3, 8, 5)] == [(0, 0), (1, 0), (0, 3)]
    assert [b.place(n) for n in (4, 6)] == [(2, 0), (2, 4)]
    assert b.place(9) == (3, 0) and len(b.left()) == 2 and (3, 9) not in b.left()
    assert packing.pack.__doc__ and packing.Bins(4, 1).place(4) == (0, 0)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0
