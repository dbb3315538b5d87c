import numpy as np
import pytest

from barweave.llm import lattice as L

VECTORS = "vec_id long, embedding array<double>, label int"


def brute(rows, threshold=0.98):
    """(n_links, component_id) per place of ``rows`` by comparing all pairs."""
    ok = [r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    n, links = len(rows), [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], dtype=float), np.array(rows[j][1], dtype=float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i].add(j), links[j].add(i)
    low = [None] * n
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low[i] = min(ids) if ids else None
    return sorted(((r[0], len(k), c, r[0] == c) for r, k, c in zip(rows, links, low, strict=True)), key=repr)


def found(spark, rows, **more):
    got = L.near_duplicates(spark.createDataFrame(rows, VECTORS), **more).collect()
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=repr)


def test_lattice_points_are_nearest():
    steps, rng = L.shortest_vectors(), np.random.default_rng(1)
    assert len(np.unique(steps, axis=0)) == 240 and ((steps**2).sum(axis=1) == 2).all()
    x = rng.standard_normal((300, 8)) * 3
    p = L.nearest_points(x)
    assert (p.sum(axis=1) % 2 == 0).all() and ((p * 2) % 1 == 0).all()
    assert all(len(set((r % 1).tolist())) == 1 for r in p)
    # no neighbouring point is nearer (for this lattice that decides it)
    assert (((x[:, None] - p[:, None] - steps) ** 2).sum(axis=2) >= ((x - p) ** 2).sum(axis=1)[:, None] - 1e-9).all()
    assert (((x - p) ** 2).sum(axis=1) <= 1 + 1e-9).all()


def test_own_cell_first_and_neighbours_by_distance():
    u = L.unit_rows(np.random.default_rng(2).standard_normal((50, 12)))
    seen = L.cells(u, 3, 4, 1.6)
    assert seen.shape == (50, 3, 5) and all(len(set(r.tolist())) == 5 for r in seen.reshape(-1, 5))
    assert (seen[:, :, 0] == L.cells(u, 3, 0, 1.6)[:, :, 0]).all()


def test_pairs_at_the_threshold_meet():
    """Of pairs at exactly the threshold nearly all share a cell or probe in some table."""
    rng = np.random.default_rng(3)
    u = L.unit_rows(rng.standard_normal((4000, 64)))
    h = rng.standard_normal(u.shape)
    h = L.unit_rows(h - (h * u).sum(axis=1, keepdims=True) * u)
    w = 0.98 * u + np.sqrt(1 - 0.98**2) * h
    a, b = (L.cells(x, L.TABLES, L.PROBES, L.WIDTH) for x in (u, w))
    met = (a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)
    assert 0.70 < met.mean() < 0.82 and met.any(axis=1).all()


@pytest.mark.parametrize("block", [8, 1024])
def test_families_copies_and_chains_equal_brute_force(spark, block):
    rng = np.random.default_rng(5)
    rows, at = [], 0
    for family, size in enumerate((90, 25, 7, 2, 1, 1)):
        centre = L.unit_rows(rng.standard_normal((1, 24)))[0]
        for _ in range(size):
            spread = rng.standard_normal(24) * rng.choice([0.002, 0.02, 0.03])
            rows.append((1000 - at, ((centre + spread) * rng.choice([0.1, 1.0, 30.0])).tolist(), family % 2))
            at += 1
    rows += [(2000 + i, rows[3][1], rows[3][2]) for i in range(40)]
    rows += [(3000, rows[0][1], None), (3001, rows[0][1], 7), (3002, rows[0][1], 7)]
    assert found(spark, rows, block=block) == brute(rows)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0, 0.0], 0), (4, [1.0, None, 2.0], 0), (5, [float("nan"), 1.0, 1.0], 0), (6, [float("inf"), 1.0, 1.0], 0),
        (7, v, None), (8, v, None), (9, v, 0), (9, v, 0), (10, [2.0, 4.0, 6.0], 0), (11, [1e300, 2e300, 3e300], 0), (12, [1e-300, 2e-300, 3e-300], 0),
        (13, [1.0, 2.0], 0), (14, [1.0, 2.0], 0), (None, v, 0), (None, [9.0, -1.0, 0.0], 3), (None, [9.0, -1.0, 0.0], 3), (None, None, None), (15, [-1.0, -2.0, -3.0], 0),
        (16, (np.arange(5000) % 7 - 3.0).tolist(), 1), (17, (np.arange(5000) % 7 - 3.0).tolist(), 1),
    ]
    got = {}
    for r in found(spark, rows):
        got.setdefault(r[0], []).append(r[1:])
    assert all(got[i] == [(0, i, True)] for i in (1, 2, 3, 4, 5, 6, 7, 8, 15))
    n = len([9, 9, 10, 11, 12, None]) - 1
    assert got[9] == [(n, 9, True)] * 2 and got[10] == got[11] == got[12] == [(n, 9, False)]
    assert got[13] == [(1, 13, True)] and got[14] == [(1, 13, False)] and got[16] == [(1, 16, True)] and got[17] == [(1, 16, False)]
    assert sorted(got[None], key=repr) == sorted([(n, 9, False), (1, None, True), (1, None, True), (0, None, True)], key=repr)
    d = spark.createDataFrame(rows, VECTORS)
    assert L.near_duplicates(d.limit(0)).count() == 0
    assert L.near_duplicates(d.selectExpr("*", "1 as node", "2 as n_links", "3 as cell", "4 as _salt")).count() == len(rows)
