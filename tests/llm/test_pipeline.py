"""The pipeline's stages against plain versions, each on its own input."""

import numpy as np
import public_tokenizers
import pytest
from test_mixing import level
from test_near_dedup import brute
from test_tokens_packing import check_packing

import corpus_pipeline as C
from barweave.llm import mixing, packing, quality
from barweave.llm.base import stored, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [table(spark, SF, "documents")]
    for name, stage in C.STAGES:
        docs.append(stored(stage(spark, docs[-1], SF), f"test-{name}"))
    return docs


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in C.STAGES] == ["language", "quality", "near_duplicates", "mixing", "packing"]
    assert all(d.schema == steps[0].schema for d in steps[:-1])


def rows(d):
    return sorted(map(tuple, d.collect()))


def test_language_keeps_clean_documents(steps):
    assert rows(steps[1]) == rows(steps[0])


def test_quality_stage_is_its_score(spark, steps):
    voter = quality.fit(steps[1], table(spark, SF, "labels"))
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(steps[1], voter).collect()}
    assert {r["doc_id"] for r in steps[2].collect()} == {i for i, s in scores.items() if s >= quality.THRESHOLD}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in steps[2].collect()}
    assert np.mean([i in kept for i, q in labels.items() if q == 1]) > 0.95


def test_one_document_of_each_group_stays(steps):
    groups = brute({r["doc_id"]: r["text"] for r in steps[2].collect()}, 5)
    assert sorted(r["doc_id"] for r in steps[3].collect()) == sorted({root for _, root in groups.values()})


def test_mixing_repeats_by_rate(steps):
    before, after = steps[3].collect(), [r["doc_id"] for r in steps[4].collect()]
    size = {r["doc_id"]: len(r["text"].split()) for r in before}
    per = {}
    for r in before:
        per[r["source"]] = per.get(r["source"], 0) + size[r["doc_id"]]
    target = level(per)
    for r in before:
        rate = target[r["source"]] / per[r["source"]]
        assert int(rate) <= after.count(r["doc_id"]) <= int(rate) + 1
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(steps[3]).collect()}
    assert all(after.count(i) == n for i, n in copies.items())


def test_packing_holds_every_copy(steps):
    copies = {}
    for r in steps[4].collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    pieces = {}
    for r in steps[5].collect():
        pieces.setdefault((r["doc_id"], r["piece"]), []).append(r)
    assert all(len(p) == copies[i] for (i, _), p in pieces.items()) and {i for i, _ in pieces} == set(copies)
    once = packing.pack(steps[3], public_tokenizers.path(packing.MODEL))
    check_packing(once.collect(), {r["doc_id"]: r["text"] for r in steps[3].collect()}, packing.SIZE)


def test_odd_documents_pass_every_stage(spark, docs):
    d = docs((1, None, None, None), (1, None, None, None), (2, "", "en", "a"), (None, "some words of a text", "en", None), (3, "w " * 30_000, "en", "a"))
    for data in (d, d.limit(0)):
        out = data
        for _, stage in C.STAGES:
            out = stored(stage(spark, out, SF), "odd")
        assert {"doc_id", "piece", "sequence_id"} <= set(out.columns)
