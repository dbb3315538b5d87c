import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.llm import nearest
from barweave.llm import rules as R

SF = "/root/testdata/sf0.01"


def plain_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered)


def test_statistics_of_the_registered_query(spark):
    rows = {r["doc_id"]: r for r in R.op7_quality_rules(spark, SF).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(rows) == set(docs)
    for i, t in docs.items():
        n, chars, symbols, _, dup, repeat = plain_stats(t)
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
        assert not (r["kept"] and r["base_failed"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [rows[i] for i, q in labels.items() if q == 1 and not rows[i]["base_failed"]]
    bad = [rows[i] for i, q in labels.items() if q == 0]
    assert all(r["kept"] for r in good) and np.mean([r["kept"] for r in bad]) < 0.1


def test_odd_texts():
    for t in [None, "", " \n\t", "a", "\n\na\n\na\n", "x y z　\x1c w", "a b c d e f g h " * 3, "q " * 20_000, "|<>&#*$%", "é\r\né\rb\x0bc"]:
        assert R.text_stats(t) == plain_stats(t), t


def brute_mcd(x, coverage, steps, consistency, floors):
    """Concentration steps on one group in memory."""
    origin = np.median(x, axis=0)
    sd = np.maximum(np.median(abs(x - origin), axis=0) * 1.4826, floors)
    centre, inverse = origin, np.diag(1 / sd**2)
    for _ in range(steps):
        d2 = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
        near = x[d2 <= np.sort(d2)[int(np.ceil(coverage * len(x))) - 1]]
        centre = near.mean(axis=0)
        cov = np.cov(near.T, ddof=0) * consistency
        cov[np.diag_indices(len(floors))] = np.maximum(np.diag(cov), floors**2)
        inverse = np.linalg.pinv(cov)
    return np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)


def test_distances_equal_steps_in_memory(spark):
    rng = np.random.default_rng(3)
    mix = rng.standard_normal((5, 5))
    groups = {"a": rng.standard_normal((301, 5)) @ mix + 1e6, "b": np.vstack([rng.standard_normal((200, 5)), rng.standard_normal((41, 5)) * 0.1 + 30])}
    rows = [(g, i, v.tolist()) for g, x in groups.items() for i, v in enumerate(x)]
    got = R.robust_distances(spark.createDataFrame(rows, "group string, i int, x array<double>")).collect()
    q = nearest.chi_square_quantile(R.COVERAGE, 5)
    consistency = R.COVERAGE / nearest.chi_square_cdf(q, 7)
    floors = np.array([s for _, s in R.FEATURES])
    for g, x in groups.items():
        want = brute_mcd(x, R.COVERAGE, R.STEPS, consistency, floors)
        mine = np.array([r["d2"] for r in sorted((r for r in got if r["group"] == g), key=lambda r: r["i"])])
        assert np.allclose(mine, want, rtol=2e-2)
    far = [r["d2"] for r in got if r["group"] == "b" and r["i"] >= 200]
    assert min(far) > 100  # a sixth of the rows lie elsewhere and do not mask each other


def at_share(values, share):
    """The smallest value with at least that share of all at or under it."""
    return np.sort(values, axis=0)[int(np.ceil(share * len(values))) - 1]


def plain_estimate(x):
    """(rows, centre, scatter) of a group by concentration steps in memory."""
    p, floors = x.shape[1], np.array([s for _, s in R.FEATURES])
    q = nearest.chi_square_quantile(R.COVERAGE, p)
    consistency = R.COVERAGE / nearest.chi_square_cdf(q, p + 2)
    centre = at_share(x, 0.5)
    inverse = np.diag(1 / np.maximum(at_share(abs(x - centre), 0.5) * 1.4826, floors) ** 2)
    for _ in range(R.STEPS):
        d2 = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
        near = x[d2 <= at_share(d2, R.COVERAGE)]
        centre, cov = near.mean(axis=0), np.cov(near.T, ddof=0).reshape(p, p) * consistency
        cov[np.diag_indices(p)] = np.maximum(np.diag(cov), floors**2)
        inverse = np.linalg.pinv(cov)
    return len(near), centre, cov


def plain_judge(rows):
    """doc_id -> (base_failed, d2) for (doc_id, text, lang, source) rows, all in memory."""
    stats = [plain_stats(t) for _, t, _, _ in rows]
    failed = [n < 20 or 100 * r > 30 * n for n, _, _, _, _, r in stats]
    good = [i for i, f in enumerate(failed) if not f]
    n, chars, symbols, lines, dup, rep = (np.array([stats[i][k] for i in good], dtype=float) for k in range(6))
    some = np.maximum(lines, 1)
    x = np.column_stack([np.log1p(n), np.log(chars / n), np.sqrt(symbols / n), np.sqrt(dup / some), np.sqrt(rep / n)])
    words, rows_ = np.minimum(n, at_share(n, R.LONGEST)), np.minimum(some, at_share(lines, R.LONGEST))
    least = np.column_stack([1 / (n + 1) ** 2, 1 / chars**2, 1 / words, 1 / rows_, 2 * R.WINDOW / words])

    def level(key):
        keys = [key(rows[i]) for i in good]
        return keys, {k: plain_estimate(x[[j for j, q in enumerate(keys) if q == k]]) for k in set(keys)}

    tongues, by_tongue = level(lambda r: r[2])
    groups, by_group = level(lambda r: (r[2], r[3]))
    every = plain_estimate(x)
    lean = lambda own, above: [(own[1] * own[0] + above[0] * R.STRENGTH) / (own[0] + R.STRENGTH), (own[2] * own[0] + above[1] * R.STRENGTH) / (own[0] + R.STRENGTH)]
    models = [lean(by_group[g], lean(by_tongue[t], every[1:])) for g, t in zip(groups, tongues, strict=True)]
    word = 1.4826 * at_share(np.array([abs(v[1] - m[0][1]) for v, m in zip(x, models, strict=True)]) * np.sqrt(n), 0.5)
    out = {rows[i][0]: (True, None) for i, f in enumerate(failed) if f}
    for j, i in enumerate(good):
        centre, cov = models[j][0], models[j][1].copy()
        low = least[j].copy()
        low[1] = max(low[1], word * word / n[j])
        cov[np.diag_indices(5)] = np.maximum(np.diag(cov), low)
        out[rows[i][0]] = (False, float((x[j] - centre) @ np.linalg.solve(cov, x[j] - centre)))
    return out


def test_odd_rows_and_small_groups(spark, docs):
    text = "some plain words that make a sentence of more than twenty words so that no base rule fails here at all today either"
    rows = [(i, text + f" number {i}", "en", "a") for i in range(60)] + [(100, text, "xx", None), (104, text, "xx", None), (101, None, None, None), (102, "", "en", "a"), (None, "w " * 30_000, "en", "b")]
    rows += [(103, " ".join("***" for _ in range(40)) + text, "en", "a")]
    out = R.judge(docs(*rows)).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["kept"] for i in range(60)) and by[100]["kept"]
    want = plain_judge([(r[0], r[1], r[2], r[3]) for r in rows])
    assert len(want) == len(rows)
    for i, (failed, d2) in want.items():
        assert by[i]["base_failed"] == failed and (d2 is None if failed else by[i]["d2"] == pytest.approx(d2, rel=1e-6))
    # a group of two rows is judged, too, by an estimate that leans on all rows
    assert by[100]["d2"] == pytest.approx(3.15999, rel=1e-3)
    assert not by[101]["kept"] and not by[102]["kept"] and not by[103]["kept"] and by[None]["base_failed"]
    assert R.judge(docs()).count() == 0


def test_look_up_beyond_the_bound_gives_the_same(spark, monkeypatch):
    from barweave.llm import base

    rows, values = spark.range(500).selectExpr("id", "id % 7 as k"), spark.range(5).selectExpr("id as k", "id * 10 as v")
    small = sorted(map(tuple, base.look_up(rows, values, "k").select("id", "v").collect()))
    monkeypatch.setattr(base, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, base.look_up(rows, values, "k").select("id", "v").collect())) == small
    assert rows.where(F.col("k") < 5).count() == len(small)


def word(i, k):
    return "ab" * (1 + k % 4) + f"{i % 90 + 10}x{k % 90 + 10}"


def varied(i):
    """A text of 30 to 500 words, seven in a line, without a repeat."""
    n = int(30 * 16 ** ((i * 0.618) % 1))
    return "\n".join(" ".join(word(i, k) + str(k // 90) for k in range(j, min(n, j + 7))) for j in range(0, n, 7))


def test_verdicts_equal_a_plain_version(spark, docs):
    """Two languages, several sources of different sizes, symbols, repeated lines and texts that fail."""
    rnd = np.random.default_rng(8)
    rows = []
    for i in range(260):
        text = varied(i)
        if i % 9 == 0:
            text += "\n" + text.split("\n")[0]
        if i % 7 == 0:
            text = text.replace(" ", " # ", int(rnd.integers(1, 6)))
        rows.append((i, "too short" if i % 41 == 0 else text, ["en", "de", None][int(i % 10 > 6) + int(i % 50 == 49)], "abc"[int(rnd.integers(3))]))
    got = {r["doc_id"]: r for r in R.judge(docs(*rows)).collect()}
    cut = nearest.chi_square_quantile(R.CONFIDENCE, 5)
    for i, (failed, d2) in plain_judge(rows).items():
        assert got[i]["base_failed"] == failed
        if not failed:
            assert got[i]["d2"] == pytest.approx(d2, rel=1e-5) and got[i]["kept"] == (d2 <= cut)


def test_estimated_spread_sets_the_scale(spark, docs):
    """Lines that nearly all repeat, in a text whose words and length are like any other's."""
    rows = [(i, varied(i), "en", "a") for i in range(200)]
    again = "\n".join(word(5, int(k)) + "0" for k in np.random.default_rng(1).integers(0, 4, 60))
    rows += [(1000, again, "en", "a"), (1001, varied(7) + "\n" + varied(7).split("\n")[0], "en", "a")]
    out = {r["doc_id"]: r for r in R.judge(docs(*rows)).collect()}
    assert not out[1000]["base_failed"] and out[1000]["n_dup_lines"] == 56 and not out[1000]["kept"]
    assert out[1001]["n_dup_lines"] == 1 and out[1001]["kept"], out[1001]
    assert np.mean([out[i]["kept"] for i in range(200)]) > 0.98


def test_small_groups_are_judged_like_large_ones(spark, docs):
    """A text of symbols in a language with few rows goes, whatever else arrives; its regular rows stay."""
    common = [(i, varied(i), "en", "a") for i in range(120)]
    few = [(500 + i, varied(i), "xx", None) for i in range(4)] + [(600, "#$% " * 3 + varied(3).replace(" ", "### "), "xx", None)]
    for rows in (common + few, common + few + [(700 + i, varied(i + 7), "xx", "b") for i in range(50)]):
        out = {r["doc_id"]: r for r in R.judge(docs(*rows)).collect()}
        assert all(r["d2"] is not None for r in out.values() if not r["base_failed"])
        assert not out[600]["base_failed"] and not out[600]["kept"] and all(out[500 + i]["kept"] for i in range(4))
    assert R.judge(docs()).count() == 0
