import random

import numpy as np
import pytest

from barweave.llm import hard_negatives as N

ROWS = "vec_id long, label int, vector array<double>"


def brute(rows, is_anchor, positives, k, low, high):
    out = []
    for a in {r[0]: r for r in sorted(rows, key=lambda r: r[0], reverse=True) if is_anchor(r[0])}.values():
        score = lambda r: sum(int(x) * int(y) for x, y in zip(a[2], r[2], strict=True))  # noqa: B023, E731
        others = sorted(((-score(r), r[0], r[1]) for r in rows if r[0] != a[0] and len(r[2]) == len(a[2])))
        for p, pid, _ in [o for o in others if o[2] == a[1]][:positives]:
            fits = [o for o in others if o[2] != a[1] and low * -p <= 100 * -o[0] <= high * -p][:k]
            out += [(a[0], pid, i + 1, o[1], -p, -o[0]) for i, o in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "chunk", "size"), [(1, 1000, 30), (2, 3, 2), (3, 7, 10**9)])
def test_random_rows_equal_brute_force(spark, seed, chunk, size):
    """Small numbers give many ties; the largest sums are beyond exact doubles."""
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(0, 3), [float(rnd.randint(-size, size)) for _ in range(4)]) for i in range(400)]
    got = N.mine(spark.createDataFrame(rows, ROWS).repartition(5), "vec_id % 20 = 0", positives=4, k=6, chunk=chunk).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, lambda i: i % 20 == 0, 4, 6, 30, 90)


def test_slots_answer_all_windows():
    """Every window is a cut suffix of the slots: no row between its limits falls out of all slots."""
    rnd = random.Random(4)
    for _ in range(300):
        scores = [rnd.randint(-5, 300) for _ in range(rnd.randint(0, 5))]
        high, low = N.slots_of(scores, 5, 30, 90)
        assert all(low[i] > high[i + 1] for i in range(4) if high[i + 1] >= low[i + 1] and high[i] >= low[i])
        for s in range(-10, 300):
            wanted = any(30 * p <= 100 * s <= 90 * p for p in scores)
            inside = [i for i in range(5) if low[i] <= s <= high[i]]
            assert len(inside) <= 1 and (not wanted or inside)


def test_best_keeps_the_first_of_ties():
    b = N.Best(2, 1, 2)
    b.add(np.array([0, 0, 0, 1]), np.array([5, 5, 4, N.LEAST]), np.array([9, 3, 1, 1]))
    b.add(np.array([0, 0]), np.array([5, 5]), np.array([2, 8]))
    assert [x.tolist() for x in b.held] == [[0, 0, 1], [5, 5, N.LEAST], [2, 3, 1]]
    assert b.floor.tolist() == [[5], [N.LEAST]]


def test_query_equals_sql(spark, llm_con):
    got = N.op11_hard_negatives(spark, "/root/testdata/sf0.001").toPandas()
    want = llm_con.sql(N.SQL).df()[got.columns.tolist()]
    key = ["anchor_id", "positive_id", "rank"]
    assert len(got) and got.sort_values(key).to_numpy().tolist() == want.sort_values(key).to_numpy().tolist()


def test_odd_rows(spark):
    v = [3.0, 4.0]
    rows = [
        (0, 1, v), (1, 1, v), (1, 1, v), (2, 2, [1.0, 1.0]), (3, None, v), (4, 1, None), (5, 2, [float("nan"), 1.0]), (6, 2, [float("inf"), 1.0]), (7, 2, [None, 1.0]),
        (None, 2, v), (8, 2, [0.0, 0.0]), (9, 2, [1.0, 1.0, 1.0]), (20, 3, v), (20, 3, [1.0, 0.0]), (40, 5, [0.0] * 3000), (41, 5, [1.0] * 3000), (60, 6, []), (61, 6, []), (62, 7, []),
    ]
    d = spark.createDataFrame(rows, ROWS)
    got = sorted(tuple(r) for r in N.mine(d, "vec_id % 20 = 0").collect())
    # both rows of 1 are positives of 0 with 25; rows of 2 (7) and of 20 (25 and 3) are negatives: only 7 is within 7.5 to 22.5 not, so none fits
    assert got == [(60, 61, 1, 62, 0, 0)]
    got = sorted(tuple(r) for r in N.mine(d, "vec_id % 20 = 0", low=10, high=100).collect())
    assert got == [(0, 1, 1, 20, 25, 25)] * 2 + [(0, 1, 2, 2, 25, 7)] * 2 + [(0, 1, 3, 20, 25, 3)] * 2 + [(60, 61, 1, 62, 0, 0)]
    assert N.mine(d.limit(0), "vec_id % 20 = 0").count() == N.mine(d, "vec_id = 77").count() == 0
    assert N.mine(d.selectExpr("*", "1 as code", "2 as anchor", "3 as _row", "4 as score"), "vec_id % 20 = 0").count() == 1
