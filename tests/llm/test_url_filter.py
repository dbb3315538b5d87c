import re

import pytest

from barweave.llm import url_filter as U

PAGES = "page_id long, url string, html string"


def brute(rows, rules, damping=U.DAMPING, share=U.SHARE, sweeps=400):
    out, hosts, edges = [], {}, {}
    for pid, url, page in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
        fit = [(len(r), r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
        rule, verdict = max(fit)[1:] if fit else (None, None)
        out.append([pid, host, path, rule, verdict])
        if host:
            n = hosts.setdefault(host, [0, 0, 0])
            n[0] += 1
            n[1] += verdict == "allow"
            n[2] += verdict == "block"
            for dst in re.findall(r'href="[a-z]+://([^/"]*)', page or ""):
                if dst != host:
                    edges[host, dst] = edges.get((host, dst), 0) + 1

    def rank(seed, edges):
        total = sum(seed.values())
        mass = dict(seed)
        outs = {}
        for (s, _), n in edges.items():
            outs[s] = outs.get(s, 0) + n
        for _ in range(sweeps if total else 0):
            new = {}
            for (s, d), n in edges.items():
                new[d] = new.get(d, 0) + damping * mass.get(s, 0) * n / outs[s]
            back = total - sum(new.values())
            for h, x in seed.items():
                new[h] = new.get(h, 0) + back * x / total
            mass = new
        return mass

    trust = rank({h: n[1] for h, n in hosts.items() if n[1]}, edges)
    distrust = rank({h: n[2] for h, n in hosts.items() if n[2]}, {(d, s): n for (s, d), n in edges.items()})
    for r in out:
        if r[4] is None:
            h = r[1]
            r[4] = "block" if h and distrust.get(h, 0) - trust.get(h, 0) > share * hosts[h][0] else "allow"
    return sorted(tuple(r) for r in out), trust, distrust


RULES = (("bad.com/", "block"), ("ok.bad.com/x", "allow"), ("good.org/", "allow"))


@pytest.mark.parametrize("fan", [U.FAN, 1])
def test_rules_and_propagation_equal_brute_force(spark, monkeypatch, fan):
    # with a fan of one, hosts with several links out are cut into parts
    monkeypatch.setattr(U, "FAN", fan)
    link = lambda *hs: "".join(f'<a href="http://{h}/p">x</a>' for h in hs)
    rows = [
        (1, "http://BAD.com/a?q#f", link("mid.net")), (2, "https://ok.bad.com/x/1", ""), (3, "https://ok.bad.com/y", ""),
        (4, "http://friend.net/1", link("bad.com", "bad.com")), (5, "http://friend.net/2", link("bad.com")), (6, "http://far.net/", link("friend.net")),
        (7, "http://good.org/", link("liked.net", "mid.net")), (8, "http://liked.net/z", link("bad.com")), (9, "http://mid.net/", None),
        (10, None, None), (11, "no scheme", link("bad.com")), (12, "ftp://notbad.com/", ""), (12, "ftp://notbad.com/", ""), (13, "x://?q", ""),
    ]
    rows += [(100 + i, f"http://bad.com/{i}", link("hub.net")) for i in range(20)] + [(200 + i, f"http://s{i}.net/", link("bad.com")) for i in range(5)]
    got = U.filter_urls(spark.createDataFrame(rows, PAGES), RULES, tolerance=1e-9).collect()
    want, trust, distrust = brute(rows, RULES)
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == want
    for r in got:
        assert abs(r["trust"] - trust.get(r["host"], 0)) < 1e-6 and abs(r["distrust"] - distrust.get(r["host"], 0)) < 1e-6
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}


def test_registered_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted(tuple(r) for r in U.op2_filter_urls(spark, sf).collect())
    assert got == brute(rows, U.RULES)[0]


def test_empty_table(spark):
    assert U.filter_urls(spark.createDataFrame([], PAGES)).count() == 0
    clash = spark.createDataFrame([(1, "http://a.b/c", "", "x")], PAGES + ", host string")
    assert U.filter_urls(clash).first()["host"] == "a.b"
