"""Main text of web pages by structure and nearest-URL page differencing.

Pages of one host that are next to each other in the order of their URLs share a
template.  Markup goes first: elements that say what they are (menus, footers,
adverts, forms, comments, teasers) are left out, and what lies in an article or main
element is set apart.  Then every page is differenced against the nearest pages of its
host that are no copies of it: text lines are aligned by longest common
subsequence, and shared lines, the template's, are deleted.  Where no markup tells an article,
one such page decides.  Inside an article, paragraphs, headings, items and
quotations are its text, and other lines go when both sides share them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from heapq import nsmallest
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.base import BROADCAST_ROWS, bounded_batches, look_up, ordered, query, stored, table
from barweave.llm.url_filter import url_parts

# Element names of HTML and what they mean here.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "title")
OUT = frozenset({"nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "head", "label", "input", "fieldset", "datalist", "audio", "video", *RAW})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
INLINE = frozenset({
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "nobr",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
})
MAIN = ("article", "main")
#: Elements whose text inside an article is the article's.
PROSE = frozenset({"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "caption", "figcaption", "blockquote", "pre"})
#: What a block is: outside of articles, text of one, or another line in one.
OUTSIDE, TEXT, OTHER = 0, 1, 2
#: Elements that end when their like begins, as their end tags may be left out.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in class, id or role that mark what does not belong to an article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|header|footer|masthead|related|recommended|pagination|pager|comments?|disqus|replies|widget|search|contentinfo|complementary)"
    r"(?:$|[\s_-])",
    re.IGNORECASE,
)
#: What these mark goes wherever it is, articles inside it and articles so marked too: a whole name, or one with an ending of lists and boxes.
_NAMES = r"comments?|repl(?:y|ies)|respond|related|recommended|teasers?|share|sharing|social|promo\w*|sponsor\w*|ads?|advert\w*|newsletter|subscribe|signup|cookies?|consent|disqus"
_ENDINGS = r"posts?|articles?|story|stories|news|lists?|links?|items?|buttons?|bars?|icons?|tools?|box|boxes|block|container|wrap|wrapper|area|section|thread|form|body|content|panel|module|cards?|entry|text|meta|author|count|widget"
STRONG_MARKS = re.compile(rf"(?:^|\s)(?:{_NAMES})(?:[_-]+(?:{_ENDINGS}))*(?:$|\s)", re.IGNORECASE)
#: A mark that is a whole name: no article opens it, only a main element does.
WHOLE_MARKS = re.compile(MARKS.pattern.replace(r"[\s_-]", r"\s"), re.IGNORECASE)
#: How an element is dropped: with all it holds, all but a main element, or all but an article or main element that it wraps.
HARD, WHOLE, SOFT = 1, 2, 3
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
RAW_END = {t: re.compile(rf"</{t}\s*[^>]*>", re.IGNORECASE) for t in RAW}


def _dropped(name: str, attributes: str, inside_main: bool) -> int:
    """0, ``HARD``, ``WHOLE`` or ``SOFT``."""
    # a header inside an article holds its heading
    if name in OUT:
        return 0 if name == "header" and inside_main else HARD
    if not attributes or name in ("html", "body"):
        return 0
    found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return HARD
    said = [found[k] for k in ("class", "id", "role") if found.get(k)]
    if any(STRONG_MARKS.search(x) for x in said):
        return HARD
    if name in MAIN:
        return 0
    if any(WHOLE_MARKS.search(x) for x in said):
        return WHOLE
    return SOFT if not inside_main and any(MARKS.search(x) for x in said) else 0


def page_blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, ``OUTSIDE``, ``TEXT`` or ``OTHER``) of each block outside dropped elements, in page order.

    The article is what lies in article or main elements.  An article within an article is
    how HTML writes a comment: its blocks go, unless the outer one has no text of its own.
    White space of a block is one space, references are decoded once, empty blocks are
    left out.  Tags that are never closed end with the page.
    """
    blocks: list[tuple[str, int, int]] = []
    if not page:
        return []
    # open elements that matter: (name, how it is dropped, main)
    stack: list[tuple[str, int, bool]] = []
    dropped = main = articles = 0
    buffer: list[str] = []

    def end_block():
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            # depth: 0 outside, else one more than the articles around it
            prose = main and any(s[0] in PROSE for s in stack[max(0, len(stack) - 4) :])
            blocks.append((text, 1 + articles if main else 0, TEXT if prose else OTHER if main else OUTSIDE))

    def pop(at: int):
        nonlocal dropped, main, articles
        for n, d, m in stack[at:]:
            dropped, main, articles = dropped - bool(d), main - m, articles - (m and n == "article")
        del stack[at:]

    pos, size = 0, len(page)
    while pos < size:
        lt = page.find("<", pos)
        if lt < 0:
            lt = size
        if lt > pos and not dropped:
            buffer.append(page[pos:lt])
        if lt == size:
            break
        tag = TOKEN.match(page, lt)
        if tag is None:  # a plain less-than sign
            if not dropped:
                buffer.append("<")
            pos = lt + 1
            continue
        pos = tag.end()
        if tag[2] is None:
            if tag[0].startswith("<![CDATA[") and not dropped:
                buffer.append(html.escape(tag[0][9:].removesuffix("]]>"), quote=False))
            continue
        name, closing = tag[2].lower(), tag[1] == "/"
        if name in INLINE:
            if name == "br" and not dropped:
                buffer.append(" ")
            if name in VOID:
                continue
            if closing:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name or stack[i][0] not in INLINE), -1)
                if at >= 0 and stack[at][0] == name:
                    pop(at)
            elif not tag[3].endswith("/"):
                # only inline elements that drop their text need remembering, and their like to match end tags
                d = _dropped(name, tag[3], main > 0)
                if d or any(s[0] == name for s in stack):
                    stack.append((name, d, False))
                    dropped += bool(d)
            continue
        if not dropped:
            end_block()
        if closing:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if at >= 0:
                pop(at)
            continue
        if name in RAW and not tag[3].endswith("/"):
            end = RAW_END[name].search(page, pos)
            pos = end.end() if end else size
            continue
        if name in VOID or tag[3].endswith("/"):
            continue
        if name in CLOSES:
            at = len(stack) - 1
            while at >= 0 and (stack[at][0] in INLINE and not stack[at][1]):
                at -= 1
            if at >= 0 and stack[at][0] in CLOSES[name]:
                pop(at)
        d, m = _dropped(name, tag[3], main > 0), name in MAIN
        if m and not d and dropped and not main and all(s[1] in ((0, SOFT) if name == "article" else (0, SOFT, WHOLE)) for s in stack):
            # what wraps the article is no menu or sidebar, whatever part of its name says so
            stack[:] = [(s[0], 0, s[2]) for s in stack]
            dropped = 0
        stack.append((name, d, m))
        dropped, main, articles = dropped + bool(d), main + m, articles + (name == "article")
    if not dropped:
        end_block()
    depths = [d for _, d, _ in blocks if d]
    deepest = max(2, min(depths)) if depths else 0
    return [(t, kind) for t, d, kind in blocks if d <= deepest]


def shared_lines(own: list, other: list) -> list[bool]:
    """Which lines of ``own`` lie on a longest common subsequence with ``other``.

    Common ends and lines that only one side has are set apart first, which keeps the
    length; the rest is aligned with bit rows, by halves where they would grow large.
    """
    out = [False] * len(own)
    theirs, mine = set(other), set(own)
    a = [(i, x) for i, x in enumerate(own) if x in theirs]
    b = [x for x in other if x in mine]
    start = 0
    while start < min(len(a), len(b)) and a[start][1] == b[start]:
        out[a[start][0]] = True
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end][1] == b[-1 - end]:
        out[a[-1 - end][0]] = True
        end += 1
    for i in _align(a[start : len(a) - end], b[start : len(b) - end]):
        out[i] = True
    return out


def _rows(lines: list[str], other: list[str]) -> Iterator[int]:
    """After each line a number whose zero bits are the places of ``other`` where the common length grows."""
    at: dict[str, int] = {}
    for j, x in enumerate(other):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(other)) - 1
    row = full
    for x in lines:
        hit = row & at.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _align(a: list[tuple[int, str]], b: list[str], most_bits: int = 64_000_000) -> list[int]:
    if not a or not b:
        return []
    lines = [x for _, x in a]
    if len(a) * len(b) > most_bits and len(a) > 1:
        half = len(a) // 2
        *_, head = _rows(lines[:half], b)
        *_, tail = _rows(lines[half:][::-1], b[::-1])
        # common length of the halves for each cut of b
        up = [0]
        for j in range(len(b)):
            up.append(up[-1] + (not head >> j & 1))
        down = [0]
        for j in range(len(b)):
            down.append(down[-1] + (not tail >> j & 1))
        cut = max(range(len(b) + 1), key=lambda j: up[j] + down[len(b) - j])
        return _align(a[:half], b[:cut], most_bits) + _align(a[half:], b[cut:], most_bits)
    rows = [(1 << len(b)) - 1, *_rows(lines, b)]
    found, j = [], len(b) - 1
    for i in range(len(a), 0, -1):
        # common length up to place j, with line i and without it
        below = (1 << (j + 1)) - 1
        count_now = (~rows[i] & below).bit_count()
        if count_now > (~rows[i - 1] & below).bit_count():
            # line i is matched: to the last like place of b that keeps the count
            j = next(k for k in range(j, -1, -1) if b[k] == lines[i - 1] and (~rows[i - 1] & ((1 << k) - 1)).bit_count() == count_now - 1)
            found.append(a[i - 1][0])
            j -= 1
        if j < 0:
            break
    return found


#: A neighbour with at least this part of a page's word triples is a copy of it and decides nothing.
COPY = 0.1
#: Least hashes of a page's word triples that stand for them.
SKETCH = 32


def sketch(lines: list[str]) -> list[int]:
    """The ``SKETCH`` least hashes of the word triples of the lines (of words, in lines of one or two)."""
    found = set()
    for line in lines:
        words = line.split()
        found.update(crc32(" ".join(words[i : i + 3]).encode()) - 2**31 for i in range(max(1, len(words) - 2)))
    return nsmallest(SKETCH, found)


def likeness(a: list[int], b: list[int]) -> float:
    """Similarity of two sets by their sketches; exact for sets that fit into them."""
    both = nsmallest(SKETCH, set(a) | set(b))
    return len(set(a) & set(b) & set(both)) / max(1, len(both))


def template(page: dict, before: dict | None, behind: dict | None) -> list[int]:
    """Hashes of the lines, in order, that a page's neighbours say are not its own.

    ``page`` and its neighbours have the ``hashes`` and ``sizes`` of their lines that may go and the ``marks`` of
    their articles, none without one.  A page without an article takes the lines of the page before it, or behind it; an
    article the lines that both sides share.  Copies of the page say nothing.
    """
    sides = [s for s in (before, behind) if s and not is_copy(page, s)]
    if not page["marks"]:
        return sides[0]["hashes"] if sides else []
    if len(sides) < 2:
        return []
    first, second = (s["hashes"] for s in sides)
    return [x for x, g in zip(first, shared_lines(first, second)) if g]


def is_copy(page: dict, other: dict) -> bool:
    """By word triples of articles, by characters of pages without one."""
    if page["marks"]:
        return likeness(page["marks"], other["marks"]) >= COPY
    found = shared_lines(page["hashes"], other["hashes"])
    return sum(n for n, g in zip(page["sizes"], found) if not g) < COPY * sum(page["sizes"])


def folders_shared(path: str, other: str) -> int:
    """How many leading folders two paths have in common."""
    n = 0
    for x, y in zip(path.split("/")[:-1], other.split("/")[:-1]):
        if x != y:
            break
        n += 1
    return n


def kept_lines(kinds: list[int], hashes: list[int], shared: list[int]) -> list[bool] | None:
    """Which lines are a page's text: its article or else all lines, without those that may go and lie on a longest
    common subsequence with ``shared``.  None where no line goes."""
    article = any(kinds)
    loose = [i for i, k in enumerate(kinds) if k == OTHER or not article]
    gone = {i for i, g in zip(loose, shared_lines([hashes[i] for i in loose], shared)) if g} if shared else ()
    return [bool(k or not article) and i not in gone for i, k in enumerate(kinds)] if gone else None


def own_lines(lines: list[str], kinds: list[int], hashes: list[int], shared: list[int]) -> list[str]:
    """The lines that ``kept_lines`` tells."""
    kept = kept_lines(kinds, hashes, shared) or [bool(k) or not any(kinds) for k in kinds]
    return [x for x, k in zip(lines, kept) if k]


#: Rows in order that are looked at together, with one more on either side.
BLOCK = 4096


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url and main text of every page (page_id, url, html).

    Blocks by markup first (``page_blocks``), then differencing.  Pages of a host whose
    longest article line is the same (without an article: whose lines are all the same) count as
    copies and stand for one; these, in order of path, url and page_id, are each
    other's neighbours, so no run of copies hides the next different page.  A neighbour that shares a
    tenth of an article's word triples, or most text of a page without one, is a copy, too, and decides nothing.
    A page without an article loses what it shares with the nearer neighbour: the one whose path has more
    leading folders in common, the one before it where they are as near, the other where one is a copy; an
    article loses lines outside its paragraphs, headings and items that both neighbours share; without
    neighbours nothing goes.  Every page is differenced so, by the hashes of its lines; texts do not move
    for it, unless many pages lose lines.  Null and empty html give an empty text; a null url has
    an empty host like other urls without one.  Repeated rows are pages each, with the same text.
    Very long pages are read whole; columns besides the three are ignored whatever their names.  An
    empty table gives an empty result.
    """
    host, path = url_parts(F.col("url"))
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "html"):
            found = [page_blocks(p) for p in batch.column("html").to_pylist()]
            lines = pa.array([[t for t, _ in b] for b in found], pa.list_(pa.string()))
            kinds = pa.array([[k for _, k in b] for b in found], pa.list_(pa.int8()))
            marks = pa.array([sketch([t for t, k in b if k]) for b in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), lines, kinds, marks], names=["page_id", "url", "lines", "kinds", "marks"])

    read = slim.mapInArrow(work, "page_id long, url string, lines array<string>, kinds array<byte>, marks array<int>")
    read = stored(read.withColumns({"_host": host, "_path": path, "_at": F.monotonically_increasing_id()}), "page-lines")
    hashes = F.transform("lines", lambda x: F.xxhash64(x))
    article = F.filter(F.arrays_zip("lines", "kinds"), lambda x: x["kinds"] > 0)
    longest = F.array_max(F.transform(article, lambda x: F.struct(F.length(x["lines"]).alias("n"), x["lines"].alias("t"))))
    kin = F.when(longest.isNotNull(), F.xxhash64(F.lit(1), longest)).otherwise(F.xxhash64(F.lit(2), "lines"))
    keyed = read.withColumn("_kin", F.xxhash64("_host", kin))
    # one page for each group of copies: the first in the order of URLs
    loose = F.transform(F.filter(F.arrays_zip("lines", "kinds"), lambda x: x["kinds"] != TEXT), lambda x: x["lines"])
    looks = F.struct(F.transform(loose, lambda x: F.xxhash64(x)).alias("hashes"), F.transform(loose, F.length).alias("sizes"), "marks")
    first = keyed.where(F.size("lines") > 0).groupBy("_kin").agg(F.min(F.struct("_host", "_path", "url", "page_id", looks.alias("page"))).alias("_f"))
    placed = ordered(first.select("_kin", "_f.*"), "_host", "_path", "url", "page_id", label="page-order")

    @F.arrow_udf("array<long>")
    def decide(here: pa.Array, before: pa.Array, behind: pa.Array) -> pa.Array:
        out = []
        for h, *sides in zip(*(x.to_pylist() for x in (here, before, behind)), strict=True):
            sides = [s if s and s["_host"] == h["_host"] else None for s in sides]
            if all(sides) and not h["page"]["marks"] and folders_shared(h["_path"], sides[1]["_path"]) > folders_shared(h["_path"], sides[0]["_path"]):
                sides.reverse()
            out.append(template(h["page"], *(s and s["page"] for s in sides)))
        return pa.array(out, pa.list_(pa.int64()))

    @F.arrow_udf("array<boolean>")
    def differ(kinds: pa.Array, mine: pa.Array, shared: pa.Array) -> pa.Array:
        each = zip(*(x.to_pylist() for x in (kinds, mine, shared)), strict=True)
        return pa.array([kept_lines(*p) for p in each], pa.list_(pa.bool_()))

    block = lambda step: F.floor((F.col("_row") + step) / BLOCK)
    beside = Window.partitionBy("_block").orderBy("_row")
    here = F.struct("_host", "_path", "page")
    met = placed.select("_kin", "_row", here.alias("here"), F.explode(F.array_distinct(F.array(block(-1), block(0), block(1)))).alias("_block"))
    met = met.withColumns({"before": F.lag("here").over(beside), "behind": F.lead("here").over(beside)}).where(F.col("_block") == block(0))
    templates = stored(met.select("_kin", decide("here", "before", "behind").alias("shared")), "page-templates").where(F.size("shared") > 0)
    numbers = keyed.where(F.size("lines") > 0).select("_at", "_kin", "kinds", hashes.alias("hashes"))
    masks = look_up(numbers, templates, "_kin", salts=8).select("_at", differ("kinds", "hashes", "shared").alias("keep"))
    masks = stored(masks, "page-masks").where(F.col("keep").isNotNull())
    if masks.count() <= BROADCAST_ROWS:
        looked = keyed.join(F.broadcast(masks), "_at", "left")
    else:  # texts with a mask move; those of paragraphs, headings and items alone have none
        loose_ = ~F.exists("kinds", lambda k: k > 0) | F.exists("kinds", lambda k: k == OTHER)
        looked = keyed.where(loose_).join(masks, "_at", "left").unionByName(keyed.where(~loose_).withColumn("keep", F.lit(None).cast("array<boolean>")))
    any_article = F.exists("kinds", lambda k: k > 0)
    kept = F.coalesce("keep", F.transform("kinds", lambda k: (k > 0) | ~any_article))
    text = F.array_join(F.transform(F.filter(F.arrays_zip("lines", kept.alias("kept")), lambda x: x["kept"]), lambda x: x["lines"]), "\n")
    return looked.select("page_id", "url", text.alias("text"))


@query("op5_extract_text")
def op5_extract_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
