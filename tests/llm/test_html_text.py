import html
import random
import re

from barweave.llm import html_text as H

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def test_articles_of_the_registered_query(spark):
    """Against a plain reading of the one shape these pages have: everything in the article element."""
    got = {r["page_id"]: r for r in H.op5_extract_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"(?s)<article>(.*?)</article>", p["html"])[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        text = "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        r = got[p["page_id"]]
        assert (r["text"], r["url"], r["n_chars"]) == (text, p["url"], len(text))


def text_of(page):
    blocks = H.page_blocks(page)
    return [t for t, m in blocks if m] or [t for t, _ in blocks]


def test_markup():
    page = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body class="page nav-open">
    <header><h1>Site</h1></header><nav><ul><li><a>Home</a></ul></nav><div class="cookie-notice">Accept</div>
    <article class="post"><header><h1>Head &amp; line</h1></header><p>One<p>Two &amp;lt; <b>bold</b><br>on<div class="ad">Buy</div>
    <script>if (a < b) document.write("<p>x</p>")</script><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>
    <form><input value="v">Send</form><span class="share">Tell</span><pre>x
      y</pre><!-- <p>gone</p> --><section id="comments"><p>First!</p></section><p>A &lt; B &copy 1</article>
    <aside>Side</aside><footer>&copy; me</footer></body></html>"""
    assert text_of(page) == ["Head & line", "One", "Two &lt; bold on", "a", "b", "c", "d", "x y", "A < B © 1"]
    assert text_of("<div id=menu>m</div><div>a < b <span class=ad>buy</span> c</div><p title='x>y'>q</p>tail") == ["a < b c", "q", "tail"]
    assert text_of("<span class=ad><span>in</span>ner</span> outer") == ["outer"]
    assert text_of(None) == text_of("") == text_of("<p> &nbsp; </p>") == []
    assert text_of("<article><p>cut off in the mid") == ["cut off in the mid"]
    assert text_of("<p>x</p>" * 20_000) == ["x"] * 20_000


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_alignment_equals_dynamic_programming(monkeypatch):
    rnd = random.Random(3)
    for bits in (64_000_000, 30):
        monkeypatch.setattr(H._align, "__defaults__", (bits,))
        for _ in range(400):
            a, b = ([rnd.choice("abcdefgh"[:k]) for _ in range(rnd.randint(0, 14))] for k in (6, 8))
            shared = H.shared_lines(a, b)
            rest = iter(b)
            assert sum(shared) == lcs(a, b) and all(x in rest for x, s in zip(a, shared) if s)


def test_pages_without_an_article_lose_what_neighbours_share(spark):
    body = lambda *own: "<div>Our site</div><div>Welcome</div>" + "".join(f"<p>{x}</p>" for x in own) + "<div>All rights</div>"
    rows = [
        (1, "http://a.com/x/1", body("first", "story")), (2, "http://A.com/x/2?q", body("second")), (3, "http://a.com/y", body("third")),
        (4, "http://b.com/x/1", body("alone")), (5, None, body("nowhere")), (6, "http://c.com/", None), (7, "http://c.com/z", ""),
        (8, "http://d.com/1", "<article><p>Our site</p><p>mine</p></article>" + body()), (9, "http://d.com/2", "<main>Our site</main>"),
        (10, "http://e.com/1", body("twice")), (10, "http://e.com/1", body("twice")),
    ]
    d = spark.createDataFrame([(*r, "x") for r in rows], PAGES + ", text string")
    out = {}
    for r in H.extract_text(d).collect():
        out.setdefault(r["page_id"], []).append(r["text"])
    assert out == {
        1: ["first\nstory"], 2: ["second"], 3: ["third"], 4: ["Our site\nWelcome\nalone\nAll rights"], 5: ["Our site\nWelcome\nnowhere\nAll rights"],
        6: [""], 7: [""], 8: ["Our site\nmine"], 9: ["Our site"], 10: ["Our site\nWelcome\ntwice\nAll rights"] * 2,
    }
    assert H.extract_text(d.limit(0)).count() == 0


def test_marks_do_not_drop_articles():
    for wrap in ("div class='content-sidebar-wrap'", "div class='page has-sidebar'", "div id='main-menu-page'"):
        for inner in ("article", "main"):
            assert text_of(f"<{wrap}><div class=sidebar>No</div><{inner}><p>Story</p></{inner}></div><div class=sidebar>No</div>") == ["Story"]
    kept = "".join(f"<p class='{c}'>{c}</p>" for c in ("related-work", "search-results", "share-price"))
    page = f"<article>{kept}<div class='related'><article>Card</article></div><div class='x share'>Tell</div></article>"
    assert text_of(page) == ["related-work", "search-results", "share-price"]
    assert text_of("<nav><article>Menu</article></nav><div hidden><main>Off</main></div><p>on</p>") == ["on"]


def test_comments_and_teasers_go_as_articles_too():
    story = "<p>Story of the day</p>"
    one = ["Story of the day"]
    assert text_of(f"<article>{story}</article><div id=comments class=comments-area><article class=comment-body>First!</article></div>") == one
    assert text_of(f"<article>{story}</article><div class='related-posts'><article>Teaser</article></div>") == one
    assert text_of(f"<div>{story}</div><article class='comment'>First!</article>") == one
    assert text_of(f"<main>{story}<div class='comment-list'><p>First!</p></div><ul class=share-buttons><li>Tell</ul></main>") == one
    assert text_of(f"<article>{story}<section><article>Nested, so a comment<article>and its reply</article></article></section></article>") == one
    assert text_of(f"<article class='teaser'>No</article><article>{story}</article><article class='promo-card'>No</article>") == one
    assert text_of(f"<article class=shell><article>{story}</article></article>") == one
    assert text_of(f"<div class='sidebar'><article>Card</article></div><div class='sidebar'><main>{story}</main></div>") == one
    assert text_of(f"<main><h1>Head</h1><article>{story}<blockquote class=comments-on-law>said</blockquote></article></main>") == ["Head", *one, "said"]


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in H.extract_text(spark.createDataFrame(rows, PAGES)).collect()}


def test_copies_keep_their_text_and_find_the_next_page(spark):
    """Runs of exact and near copies, with and without an article, between pages of other content."""
    line = "line of the story that is long enough to matter here, number"
    words = lambda k: [f"{line.replace(' ', f' {k}')} {k}-{i}" for i in range(12)]
    story = lambda k: "".join(f"<p>{w}</p>" for w in words(k))
    frame = lambda body: f"<div>Our site</div><div>Welcome</div>{body}<div>All rights</div>"
    rows = [(i, f"http://a.com/{i:02}", frame(story("x"))) for i in range(5)] + [(5, "http://a.com/05", frame(story("x").replace("x-3", "x-99")))] + [(6, "http://a.com/06", frame(story("y")))]
    rows += [(10 + i, f"http://b.com/{i:02}", f"<article>{story('x')}<div>Follow us</div></article>") for i in range(4)]
    rows += [(20 + i, f"http://b.com/2{i}", f"<article>{story('uvw'[i])}<div>Follow us</div></article>") for i in range(3)]
    rows += [(30, "http://b.com/30", f"<article><div>Follow us</div>{story('x')}</article>")]
    out = extracted(spark, rows)
    text = lambda k: "\n".join(words(k))
    assert out[6] == text("y") and all(text("x") in out[i] for i in range(5)) and out[5].count("\n") in (11, 14)
    # the first page of a host has one neighbour, so its article loses nothing; those between two lose the shared line
    assert all(out[i] == text("x") + "\nFollow us" for i in range(10, 14))
    assert out[20] == text("u") and out[21] == text("v") and out[22] == text("w") + "\nFollow us"
    assert text("x") in out[30]


def test_every_page_equals_a_plain_reading_of_the_rule(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(150):
        body = "".join(f"<{(e := rnd.choice(['p', 'div']))}>{'w' * rnd.randint(1, 9)} {rnd.randint(0, 6)}</{e}>" for _ in range(rnd.randint(0, 9)))
        rows.append((i, rnd.choice([None, f"http://{rnd.choice('ab')}.org/{rnd.randint(0, 99)}"]), f"<article>{body}</article><p>x</p>" if rnd.random() < 0.6 else body))
    out = extracted(spark, rows)
    pages = {i: H.page_blocks(h) for i, _, h in rows}
    url = {i: u for i, u, _ in rows}
    host = lambda i: "" if url[i] is None else url[i].split("/")[2]
    place = lambda i: (host(i), "" if url[i] is None else url[i][12:], url[i] is not None, url[i] or "", i)
    look = lambda b: b and {"hashes": [t for t, k in b if k != H.TEXT], "sizes": [len(t) for t, k in b if k != H.TEXT], "marks": H.sketch([t for t, k in b if k])}
    kin = {i: (host(i), max(((len(t), t) for t, k in b if k), default=tuple(t for t, _ in b))) for i, b in pages.items()}
    firsts = sorted((min((j for j in pages if kin[j] == k), key=place) for k in {kin[i] for i, b in pages.items() if b}), key=place)
    cut = 0
    for i, b in pages.items():
        want = []
        if b:
            at = next(n for n, j in enumerate(firsts) if kin[j] == kin[i])
            sides = [look(pages[firsts[n]]) if 0 <= n < len(firsts) and host(firsts[n]) == host(i) else None for n in (at - 1, at + 1)]
            lines, article = [t for t, _ in b], any(k for _, k in b)
            want = H.own_lines(lines, [k for _, k in b], lines, H.template(look(pages[firsts[at]]), *sides))
            cut += len(want) < sum(k > 0 or not article for _, k in b)
        assert out[i] == "\n".join(want), i
    assert cut > 10


def test_the_nearest_page_decides_not_the_one_before(spark):
    """Two folders of a host with templates of their own: the first page of a folder is nearer to the next than to the one before."""
    page = lambda menu, k: f"<div>{menu}</div><p>story number {k} of this site</p>"
    rows = [(i, f"http://a.org/news/{i}", page("News menu", i)) for i in (1, 2)] + [(i, f"http://a.org/sport/{i}", page("Sport menu", i)) for i in (3, 4)]
    assert extracted(spark, rows) == {i: f"story number {i} of this site" for i in (1, 2, 3, 4)}


def test_blocks_of_the_order_and_moved_texts_change_nothing(spark, monkeypatch):
    rnd = random.Random(9)
    body = lambda: "".join(f"<{(e := rnd.choice(['p', 'div']))}>{'w' * rnd.randint(1, 9)} {rnd.randint(0, 6)}</{e}>" for _ in range(6))
    rows = [(i, f"http://{rnd.choice('ab')}.org/{rnd.choice('xy')}/{i}", f"<article>{body()}</article>" if i % 3 else body()) for i in range(80)]
    want = extracted(spark, rows)
    monkeypatch.setattr(H, "BLOCK", 3)
    monkeypatch.setattr(H, "BROADCAST_ROWS", 0)
    assert extracted(spark, rows) == want
