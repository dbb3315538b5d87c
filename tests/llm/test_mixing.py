from oracle import compare

from barweave.llm import mixing
from barweave.llm.base import ordered


def level(sizes, weights=(1, 2, 3), limit=3):
    """Targets by resharing the excess until none is above, as the rule is worded."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in full]
        left = total - sum(full.values())
        share = {s: left * w[s] / sum(w[r] for r in rest) for s in rest}
        over = {s: limit * sizes[s] for s in rest if share[s] > limit * sizes[s]}
        if not over:
            return full | share
        full |= over


def test_matches_sql(spark, llm_con):
    assert compare(mixing.op8_mix_sources(spark, "/root/testdata/sf0.001"), llm_con, mixing.SQL) is None


def test_targets_follow_the_worded_rule(spark, docs):
    rows, sizes = [], {"b": 10, "a": 2000, "ü": 300, None: 40, "c": 7, "z": 900, "Z": 1}
    for k, (s, n) in enumerate(sizes.items()):
        rows += [(100 * k + i, " ".join(["w"] * (n // 2 if i == 0 else n - n // 2)), "en", s) for i in range(2)]
    got = {r["source"]: r for r in mixing.mix(docs(*rows)).select("source", "source_size", "target", "rate").distinct().collect()}
    for s, t in level(sizes).items():
        assert got[s]["source_size"] == sizes[s]
        assert abs(got[s]["target"] - t) < 1e-6 and abs(got[s]["rate"] - t / sizes[s]) < 1e-9


def test_copies_follow_rates_and_repeat(spark, docs):
    d = docs(*[(i, "one two three", "en", "hot" if i % 3 else f"s{i % 5}") for i in range(3000)])
    first, again = (sorted(tuple(r) for r in mixing.mix(d).select("doc_id", "copies", "rate").collect()) for _ in range(2))
    assert first == again
    assert all(int(rate) <= copies <= int(rate) + 1 <= 4 for _, copies, rate in first)
    by_rate = {}
    for _, copies, rate in first:
        by_rate.setdefault(rate, []).append(copies)
    for rate, copies in by_rate.items():
        assert abs(sum(copies) / len(copies) - rate) < 4 * (0.25 / len(copies)) ** 0.5 + 1e-9


def test_odd_rows(spark, docs):
    d = docs((1, None, None, None), (1, None, None, None), (None, "a b", "en", "x"), (2, "", "en", "y"), (3, " \t\n", "en", "y"), (4, "w " * 5000, "en", ""))
    rows = mixing.mix(d).collect()
    assert len(rows) == 6 and sorted(r["size"] for r in rows) == [0, 0, 0, 0, 2, 5000]
    assert all(r["copies"] == 0 for r in rows if r["source"] in (None, "y"))
    assert mixing.mix(docs()).count() == 0 and mixing.mix(d.limit(2)).count() == 2
    clash = d.selectExpr("*", "'kept' as size", "7 as rate", "8 as _row")
    assert {r["_row"] for r in mixing.mix(clash).collect()} == {8}
    assert mixing.repeated(mixing.mix(d), d.columns).columns == d.columns


def test_order_numbers_rows_without_gaps(spark):
    d = spark.range(0, 5000, 1, 7).selectExpr("id % 13 as a", "id as b")
    rows = sorted((r["a"], r["b"], r["_row"]) for r in ordered(d, "a", "b").collect())
    assert [r[2] for r in rows] == list(range(5000))
