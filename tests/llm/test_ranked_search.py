import random
import re
from math import floor, log

import numpy as np
import pytest

from barweave.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    terms = lambda t: [x.translate(LOWER) for x in TERM.findall(t or "")]
    held = [(i, w) for i, t in docs if (w := terms(t))]
    n, total, out = len(held), sum(len(w) for _, w in held), []
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    for item, text in items:
        found = []
        for i, w in held:
            m = 100 - 75 + 75 * len(w) * n // total
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in terms(text) if t in w)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in R.search(d, spark.createDataFrame(items, "item_id long, text string"), **more).collect()), key=repr)


@pytest.mark.parametrize(("seed", "short", "step", "most"), [(1, 32, 512, 4_000_000), (2, 4, 16, 60), (3, 1, 7, 1)])
def test_random_texts_equal_brute_force(spark, monkeypatch, seed, short, step, most):
    monkeypatch.setattr(R, "SHARD_DOCS", 60)
    monkeypatch.setattr(R.walk, "__defaults__", (short, step))
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "é", "ß1", "日本", "A", "a", "İ"]
    odds = [1 / (i + 1) for i in range(len(words))]
    text = lambda n: "".join(w + rnd.choice([" ", "-", "\n", "_", "\x00"]) for w in rnd.choices(words, odds, k=n))
    docs = [(rnd.randint(0, 400), text(rnd.randint(0, 30))) for _ in range(500)]
    items = [(i, text(rnd.randint(0, 12))) for i in range(25)]
    assert found(spark, docs, items, most_bytes=most) == brute(docs, items)


def test_walk_skips_and_loses_nothing():
    """Long lists of little weight are not scored once the tenth score is out of their reach."""
    rng = np.random.default_rng(1)
    n = 20_000
    every, rare = np.arange(n), np.sort(rng.choice(n, 400, replace=False))
    lists = [(every, rng.integers(1, 50, n)), (every[::2], rng.integers(1, 30, n // 2)), (rare, rng.integers(500, 1000, 400)), (rare[::3], rng.integers(1, 900, 134))]
    total = np.zeros(n, dtype=np.int64)
    for p, s in lists:
        np.add.at(total, p, s)
    top = R.Top(10)
    scored = R.walk(lists, n, top, every, np.zeros(n, dtype=bool))
    order = np.lexsort((every, -total))[:10]
    assert top.ids.tolist() == order.tolist() and top.scores.tolist() == total[order].tolist()
    assert scored < n / 10


def test_query_equals_sql(spark, llm_con):
    got = R.op12_ranked_search(spark, "/root/testdata/sf0.001").toPandas()
    want = llm_con.sql(R.SQL).df()[got.columns.tolist()]
    key = ["item_id", "rank"]
    assert len(got) and got.sort_values(key).to_numpy().tolist() == want.sort_values(key).to_numpy().tolist()


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "?!"), (4, "apple pie"), (4, "apple pie"), (None, "apple pie"), (5, "Apple"), (6, "tea " * 200_000 + "apple"), (7, "milk"), (8, "x"), (9, "y")]
    items = [(1, "APPLE apple"), (1, "APPLE apple"), (2, None), (3, ""), (4, "nothing here"), (None, "pie"), (5, "tea " * 50_000)]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs[:3], items) == [] and found(spark, docs, items[2:4]) == []
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert R.search(d.limit(0), q).count() == R.search(d, q.limit(0)).count() == 0
    assert R.search(d.selectExpr("*", "1 as terms", "2 as score"), q.selectExpr("*", "'x' as doc_id")).count() == len(brute(docs, items))
