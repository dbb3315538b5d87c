import random

import numpy as np
from pyspark.sql import functions as F

from barweave.llm import language as L

SF = "/root/testdata/sf0.01"


def test_registered_query(spark):
    rows = L.op6_identify_languages(spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    declared = {r["page_id"]: r["l"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", F.regexp_extract("html", 'lang="(..)"', 1).alias("l")).collect()}
    docs, pages = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}, {r["page_id"]: r for r in rows if r["page_id"] is not None}
    assert set(docs) == set(truth) and set(pages) == set(declared) and len(rows) == len(truth) + len(declared)
    assert np.mean([docs[i]["lang"] == t for i, t in truth.items()]) > 0.99
    assert np.mean([pages[i]["lang"] == t for i, t in declared.items()]) > 0.99
    assert all(r["kept"] for r in docs.values())


def records(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, declared string, host string")


def by_hand(rows, model, strength=L.STRENGTH):
    """The same evidence, one record at a time."""
    k = len(model.languages)
    log = model.likelihoods([r[1] for r in rows])
    own = np.exp(log) / np.exp(log).sum(axis=1, keepdims=True)
    letters = np.array([bool(r[1]) and any(map(str.isalpha, r[1])) for r in rows])
    own[~letters] = 0
    tag = [(r[2] or "").split("-")[0].lower() for r in rows]
    tag = [t if t in model.languages or not t else "other" for t in tag]
    host = [r[3] or "" for r in rows]
    domain, suffix = [".".join(h.split(".")[-2:]) for h in host], [h.split(".")[-1] if "." in h else "" for h in host]
    whole = own.sum(axis=0)
    base = (whole + 1) / (whole + 1).sum()
    out = []
    for i in range(len(rows)):
        n = lambda names, i=i: np.maximum(sum((own[j] for j in range(len(rows)) if names[j] == names[i]), np.zeros(k)) - own[i], 0)
        prior = (n(domain) + strength * base) / (n(domain).sum() + strength)
        prior = (n(host) + strength * prior) / (n(host).sum() + strength)
        by_suffix = (n(suffix) + strength * base) / (n(suffix).sum() + strength) / base
        said = sum(own[j] for j in range(len(rows)) if tag[j] == tag[i]) + 0.5
        post = np.exp(log[i]) * prior * by_suffix * said / (whole + 0.5 * len(set(tag)))
        post /= post.sum()
        out.append((model.languages[int(post.argmax())], post.max(), letters[i] and post.max() >= 0.5))
    return out


def test_fusion_equals_one_at_a_time(spark):
    model = L.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = {"en": "the other thing that was with them", "fr": "une autre chose que les gens de la", "de": "und der andere mit den einen ist"}
    rows = [(i, texts[x], d, f"{s}.site.{x}") for i, (x, d, s) in enumerate([("en", "en-GB", "www")] * 5 + [("fr", "FR", "a"), ("fr", None, "b"), ("de", "de", "a"), ("de", "zz", "b")] * 15)]
    rows += [(150, "le", "fr", "a.site.fr"), (151, "le", "de", "a.site.de"), (152, "", "fr", "a.site.fr"), (153, None, None, None), (154, "12 --", "en", ""), (155, "ok", None, "plain"), (150, "le", "fr", "a.site.fr")]
    got = sorted((r["id"], r["lang"], round(r["confidence"], 9), r["kept"]) for r in L.identify(records(spark, rows), model, ["id"]).collect())
    want = sorted((r[0], lang, round(float(c), 9), bool(k)) for r, (lang, c, k) in zip(rows, by_hand(rows, model)))
    assert got == want
    kept = {g[0]: g[3] for g in got}
    assert not kept[152] and not kept[153] and not kept[154]
    # two letters say little: the declaration and the host decide
    assert [g[1] for g in got if g[0] in (150, 151)] == ["fr", "fr", "de"]


def test_page_evidence(spark):
    rows = [(1, "http://WWW.a.fr/x", '<!doctype html>\n<HTML class=x lang="fr-CA"><script>var a</script><p>Bonjour <b>vous</b>'), (2, None, None), (3, "x", "<p>no")]
    got = [tuple(r) for r in L.page_records(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert got[0][0] == 1 and got[0][1].split() == ["Bonjour", "vous"] and got[0][2:] == ("fr-CA", "www.a.fr")
    assert got[1][1] is None and got[1][3] == "" and got[2][2] == ""


def test_filter_keeps_columns_and_clean_rows(spark, docs):
    d = docs((1, "the first of these is english", "en", "a"), (1, "the first of these is english", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, "12 34", "fr", None), (None, "encore une phrase", "fr", "b"), (5, "wort " * 30_000, "de", "b"))
    d = d.withColumn("kept", F.lit("own"))
    out = L.in_a_language(d)
    assert out.columns == d.columns
    assert sorted((r["doc_id"] or -1, r["kept"]) for r in out.collect()) == [(-1, "own"), (1, "own"), (1, "own"), (5, "own")]
    assert L.in_a_language(d.limit(0)).count() == 0


def test_texts_in_no_learned_language_go(spark):
    rnd = random.Random(5)
    letters = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    strange = [letters(60), letters(1000), " ".join(letters(7) for _ in range(20)), "Сегодня утром мы пошли на рынок, чтобы купить свежие овощи", "今日は天気がいいので、公園で散歩をしました。", "Wczoraj wieczorem poszliśmy do kina, żeby zobaczyć nowy film polskiego reżysera"]
    rows = [(i, t, "en", "a") for i, t in enumerate(strange)]
    rows += [(100 + i, r["text"], r["lang"], r["source"]) for i, r in enumerate(docs.limit(100).collect())]
    # numbers and keys are in no language, so they do not speak against the words beside them
    rows += [(300, "token = 40d78a45c418324758e099eb7cb89bc0f5fa9f62 4734663219866878$$$ the other thing", "en", "a")]
    kept = {r["id"]: r["kept"] for r in L.identify(records(spark, rows), L.fit(docs), ["id"]).collect()}
    assert [i for i in kept if i < 100 and kept[i]] == []
    assert [i for i in kept if i >= 100 and not kept[i]] == []


def test_every_label_is_a_language(spark, docs):
    rnd = random.Random(7)
    words = {f"l{k:02}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)] for k in range(40)}
    text = lambda k: " ".join(rnd.choice(words[k]) for _ in range(30))
    rare = {"l38": 1, "l39": 2}
    rows = [(100 * j + i, text(k), k, f"s{j}") for j, k in enumerate(words) for i in range(rare.get(k, 6))]
    d = docs(*rows, (9000, text("l38"), None, None))
    model = L.fit(d)
    assert model.languages == sorted(words)
    got = {r["doc_id"]: r for r in L.identify(L.document_records(d), model, ["doc_id"]).collect()}
    assert all(got[i]["lang"] == k and got[i]["kept"] for i, _, k, _ in rows)
    # another text of the label with one row is told by its words alone
    assert got[9000]["text_lang"] == "l38"
    assert L.in_a_language(d).count() == len(rows) + 1
