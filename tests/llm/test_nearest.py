import numpy as np
from pyspark.sql import functions as F

from barweave.llm import nearest as A

SCHEMA = "vec_id long, embedding array<double>"


def brute(ids, vectors, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((vectors - vectors[ids.index(q)]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q]
        out[q] = [(ids[i], d[i]) for i in order[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_recall_of_the_registered_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, vectors = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], dtype=float)
    want = brute(ids, vectors, [i for i in ids if i % 100 == 0], 10)
    got = found(A.op10_nearest_vectors(spark, sf))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    print(f"recall: {recall(got, want):.3f}")
    assert recall(got, want) >= 0.95
    at = {i: v for i, v in zip(ids, vectors)}
    for q, near in got.items():
        assert np.allclose([s for _, s in near], [np.linalg.norm(at[q] - at[i]) for i, _ in near], atol=1e-12)
        assert near == sorted(near, key=lambda x: (x[1], x[0]))


def test_the_stop_spares_most_rows(spark):
    """Over all queries of the given table, at most a third of the rows is verified, both searches counted."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    per_query = A.search(rows, F.col("vec_id") % 100 == 0).groupBy("query_id").agg(F.sum("verified").alias("n")).toPandas()
    share = per_query["n"].mean() / rows.count()
    print(f"share of rows verified: {share:.3f}")
    assert len(per_query) == 20 and 0 < share < 1 / 3


def test_blocks_chunks_and_cells(spark):
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.standard_normal((600, 16)) + 4 * c for c in range(3)])
    vectors[200:700] = vectors[0]  # one vector very often
    ids = list(range(len(vectors)))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], SCHEMA)
    got = found(A.nearest(d, F.col("vec_id") % 20 == 0, sample=150, block_rows=90, chunk=17))
    want = brute(ids, vectors, ids[::20], 10)
    assert recall(got, want) >= 0.97
    assert got[0] == [(i, 0.0) for i in range(200, 210)] and [i for i, _ in got[220]] == [0, *range(200, 209)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, []), (9, [1.0, 3.0])]
    d = spark.createDataFrame([(*r, 1.5) for r in rows], SCHEMA + ", score double")
    got = found(A.nearest(d, F.col("vec_id") % 1 == 0))
    assert set(got) == {0, 1, 9}
    assert [i for i, _ in got[0]] == [1, 1, 9] and [i for i, _ in got[9]] == [1, 0, 1]
    assert len(got[1]) == 2 and got[0][0][1] == 0.0
    assert A.nearest(d.limit(0), F.col("vec_id") % 1 == 0).count() == 0


def test_chi_square():
    assert abs(A.chi_square_quantile(0.95, 8) - 15.507313) < 1e-5
    assert abs(A.chi_square_cdf(15.507313, 8) - 0.95) < 1e-7
