import math
import random

import numpy as np
import pyarrow as pa
import pytest

from barweave.llm import near_dedup as N
from barweave.llm.components import components

SF = "/root/testdata/sf0.001"


def sets_of(texts, size):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    return out


def brute(texts, size):
    """Components by comparing all pairs."""
    sets, up = sets_of(texts, size), {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])):
                inter = len(sets[a] & sets[b])
                if 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
                    x, y = sorted((top(a), top(b)))
                    up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def family(rnd, words, edits, n):
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rnd.randint(0, edits)):
            copy[rnd.randrange(words)] = f"x{rnd.randrange(10**6)}"
        yield " ".join(copy)


def got(spark, texts, size):
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(d, size).collect()}


def test_registered_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = brute(texts, 4)
    rows = N.op1_near_duplicates(spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows) and len(rows) == len(texts)


@pytest.mark.parametrize("block", [N.BLOCK, 16])
def test_dense_families_and_fringes_equal_brute_force(spark, monkeypatch, block):
    # families whose members are near, at and under the threshold, and a passage that many share
    monkeypatch.setattr(N, "BLOCK", block)
    rnd = random.Random(11)
    texts = [t for words, edits, n in ((120, 3, 60), (120, 6, 80), (60, 1, 20), (200, 12, 60), (30, 2, 20)) for t in family(rnd, words, edits, n)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{rnd.randrange(10**6)}" for _ in range(k)) for k in range(5, 65)]
    texts += ["Same Words here again"] * 30 + ["same words HERE again"] * 5 + ["a b", "A B", "a b c", "a"] * 3
    rnd.shuffle(texts)
    texts = dict(enumerate(texts))
    result = got(spark, texts, 4)
    want = brute(texts, 4)
    assert {i: v[:2] for i, v in result.items()} == want


def test_odd_rows(spark):
    schema = "doc_id long, text string, n_shingles string, root int"
    rows = [(5, None, "x", 1), (6, "", "x", 1), (7, " \t\n", "x", 1), (3, "one two three four", "x", 1), (3, "one two three four", "x", 1), (None, "ONE two three four", "x", 1), (9, "w " * 40_000, "x", 1), (8, "é à ü", "x", 1)]
    out = N.near_duplicates(spark.createDataFrame(rows, schema), 4).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by == {5: [(0, 5, True)], 6: [(0, 6, True)], 7: [(0, 7, True)], 3: [(1, 3, True)] * 2, None: [(1, 3, False)], 9: [(1, 9, True)], 8: [(1, 8, True)]}
    assert N.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = [(4, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (None, "a B c d e f"), (7, ""), (7, ""), (8, None), (9, "other words of a text altogether"), (2, "third text with the same number too")]
    d = spark.createDataFrame([(*r, "keep") for r in rows], "doc_id long, text string, best string")
    out = sorted((r["doc_id"], r["text"] or "", r["best"]) for r in N.one_of_each(d).collect())
    assert out == [(2, "A b c d e f", "keep"), (2, "third text with the same number too", "keep"), (7, "", "keep"), (7, "", "keep"), (8, "", "keep"), (9, "other words of a text altogether", "keep")]
    assert N.one_of_each(d.limit(0)).columns == d.columns


def test_neighbours_of_sorted_rows_over_batches():
    rnd = random.Random(2)
    rows = sorted((rnd.randrange(3), rnd.randrange(30), rnd.randrange(3) << 48, bytes([rnd.randrange(256)]) * 16) for _ in range(200))
    table = pa.table({"tree": pa.array([r[0] for r in rows], pa.int32()), "p1": [r[1] for r in rows], "p2": [r[2] for r in rows], "digest": pa.array([r[3] for r in rows], pa.binary())})
    whole = None
    for size in (1, 2, 7, 200):
        out = [tuple(r.values()) for b in N._neighbours(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        whole = whole or out
        assert out == whole
    same = [rows[i][:2] == rows[i - 1][:2] for i in range(1, 200)]
    keep = [i for i in range(200) if i in (0, 199) or same[i - 1] or (i < 199 and same[i])]
    assert [o[:4] for o in whole] == [rows[i] for i in keep]
    assert [o[4] for o in whole] == [rows[i - 1][3] if i and same[i - 1] else None for i in keep]
    assert all(o[5] == 4 + (4 if rows[i][2] == rows[i - 1][2] else 0) for o, i in zip(whole, keep) if o[4])


def test_signature_agreement_estimates_similarity():
    a = np.unique(np.random.default_rng(1).integers(0, 2**63, 4000).astype(np.uint64))
    b = np.concatenate([a[:3600], np.random.default_rng(2).integers(0, 2**63, 400).astype(np.uint64)])
    agree = (N.signature(a) == N.signature(np.unique(b))).mean()
    assert abs(agree - 3600 / 4400) < 0.12


def test_pairs_at_the_threshold_are_missed_less_than_once_in_ten_million():
    agree = sum(math.comb(N.VALUES, k) * 0.8**k * 0.2 ** (N.VALUES - k) for k in range(N.AGREEMENT))
    apart = (1 - 0.8**N.DEPTH) ** N.TREES
    assert N.TREES * N.DEPTH <= N.VALUES and agree + apart < 1e-7


def test_one_link_into_a_crowd_is_found(spark):
    # 700 copies of one text with a word of their own each, and a text that only one of them is near enough to
    base = [f"b{i}" for i in range(100)]
    crowd = [" ".join([*base, *[f"c{i}x{k}" for k in range(9)]]) for i in range(700)]
    fringe = " ".join([*base[14:], *[f"c{350}x{k}" for k in range(9)]])
    texts = dict(enumerate([*crowd, fringe]))
    sets = sets_of(texts, 5)
    linked = [i for i in range(700) if 100 * len(sets[i] & sets[700]) >= 80 * len(sets[i] | sets[700])]
    assert linked == [350]
    assert {v[1] for v in got(spark, texts, 5).values()} == {0}


def test_components_of_a_star_a_path_and_a_ring(spark):
    rnd = random.Random(4)
    names = list(range(400))
    rnd.shuffle(names)
    links = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(200, 299)] + [(i, 300 + (i - 299) % 60) for i in range(300, 360)]
    d = spark.createDataFrame([(names[a], names[b]) for a, b in links], "a long, b long")
    groups = {}
    for r in components(d).collect():
        groups.setdefault(r["root"], set()).add(r["node"])
    want = [set(names[0:200]), set(names[200:300]), set(names[300:360])]
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))
    assert components(d.limit(0)).count() == 0
