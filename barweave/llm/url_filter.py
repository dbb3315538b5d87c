"""URL filter by rules and link-graph propagation, with DataFrame functions only.

Pages a rule fits get its verdict.  The others get that of their host: trust
starts at hosts with allowed pages and follows links, distrust starts at hosts
with blocked pages and follows links backwards, both as personalised PageRank
over host edges.  Mass is counted in pages, so the two can be compared with each
other and with the size of the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barweave.llm.base import LOWER, UPPER, query, stored, table

#: (rule, verdict); a rule is a host and the start of a path.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
#: Links out of one host that one task passes mass along.
FAN = 50_000
DAMPING = 0.85
TOLERANCE = 1e-4
SHARE = 0.5


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without ``://``."""
    shape = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, shape, k), F.lit(""))
    return lower_ascii(part(1)), part(2)


def match_rules(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, else nulls.

    ``rules`` is a short list that becomes part of the plan.  Of equally long rules
    that fit, the one with the longer host wins.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[0]), -r[0].find("/")))
    tests = []
    for rule, _ in ranked:
        domain, slash, rest = rule.partition("/")
        domain = domain.translate(str.maketrans(UPPER, LOWER))
        tests.append(((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest))
    pick = lambda k: F.coalesce(*[F.when(t, F.lit(r[k])) for t, r in zip(tests, ranked, strict=True)], F.lit(None).cast("string"))
    return pick(0), pick(1)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links): links between different hosts, from the ``href`` values of whole
    pages with ``host`` and ``html``.  Relative addresses stay on their host and make no edge."""
    href = r"""(?i)\shref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^\s"'>]+)"""
    target = F.explode(F.regexp_extract_all("html", F.lit(href), 1)).alias("_href")
    out = pages.select(F.col("host").alias("src"), target)
    dst = lower_ascii(F.regexp_extract("_href", r"//([^/?#]*)", 1))
    return (
        out.select("src", dst.alias("dst"))
        .where("src <> '' and dst <> '' and src <> dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("links"))
    )


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, label: str = "rank") -> DataFrame:
    """Personalised PageRank: (host, mass) from ``seeds`` (host, seed) along ``edges`` (src, dst, links).

    The mass of all hosts always adds up to that of the seeds; what a host without
    links out would pass on returns to the seeds.  Sweeps go on until less than
    ``tolerance`` of the total mass moves.  Each sweep is one join on the source and
    one map-side combined sum per target.  A host with more than ``FAN`` links out is
    cut into parts of about that many, and its mass is repeated once per part, so neither a hub
    that everyone links to nor one that links to everyone needs its rows in one task.
    """
    total = seeds.agg(F.sum("seed")).first()[0] or 0.0  # one number
    outs = stored(edges.groupBy("src").agg(F.sum("links").alias("_out"), F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("_parts")), f"{label}-outs")
    hubs = stored(outs.where("_parts > 1").select("src", "_parts"), f"{label}-hubs")  # at most one in FAN edges
    parts = F.coalesce("_parts", F.lit(1))

    def repeated(hosts: DataFrame) -> DataFrame:
        return hosts.join(hubs, "src", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")

    dealt = edges.join(hubs, "src", "left").withColumn("_part", F.pmod(F.xxhash64("dst"), parts).cast("int")).drop("_parts")
    share = dealt.join(repeated(outs.select("src", "_out")), ["src", "_part"]).select("src", "_part", "dst", (F.col("links") / F.col("_out")).alias("_share"))
    share = stored(share, f"{label}-edges")
    mass = stored(seeds.where("seed > 0").select("host", F.col("seed").cast("double").alias("mass")), label)
    if total == 0 or share.isEmpty():
        return mass
    start = mass.withColumnRenamed("mass", "seed")
    while True:
        sent = (
            share.join(repeated(mass.withColumnRenamed("host", "src")), ["src", "_part"])
            .groupBy(F.col("dst").alias("host"))
            .agg(F.sum(F.col("mass") * F.col("_share")).alias("_in"))
        )
        sent = stored(sent, label)
        back = total - damping * (sent.agg(F.sum("_in")).first()[0] or 0.0)  # restarts and dead ends
        moved = (
            sent.join(start, "host", "full")
            .select("host", (F.coalesce(F.col("_in") * damping, F.lit(0.0)) + F.coalesce(F.col("seed") * (back / total), F.lit(0.0))).alias("new"))
            .join(mass, "host", "full")
            .select("host", F.coalesce("new", F.lit(0.0)).alias("mass"), F.abs(F.coalesce("new", F.lit(0.0)) - F.coalesce("mass", F.lit(0.0))).alias("_moved"))
        )
        moved = stored(moved, label)
        mass = moved.drop("_moved")
        if moved.agg(F.sum("_moved")).first()[0] <= tolerance * total:
            return mass


def filter_urls(pages: DataFrame, rules=RULES, share: float = SHARE, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``pages`` (page_id, url, html) as page_id, host, path, rule, verdict, trust, distrust.

    A host's verdict is ``block`` when its distrust exceeds its trust by more than
    ``share`` of its pages (at least one page's worth for hosts only linked to), else
    ``allow``; so a host that neither seeds nor links reach is allowed.  Pages with a
    null url or one without ``://`` have an empty host: no rule fits, no host verdict
    reaches them, they are allowed.  Null html has no links; html is searched whole, however
    long.  Repeated rows count as often as they come.  Other columns, of whatever name, are not read.
    """
    host, path = url_parts(F.col("url"))
    placed = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    ruled = placed.withColumn("rule", rule).withColumn("_ruled", verdict)
    narrow = stored(ruled.drop("html"), "url-pages")
    hosts = stored(
        narrow.where("host <> ''").groupBy("host").agg(
            F.count(F.lit(1)).alias("pages"),
            F.count_if(F.col("_ruled") == "allow").alias("allowed"),
            F.count_if(F.col("_ruled") == "block").alias("blocked"),
        ),
        "url-hosts",
    )
    edges = stored(host_edges(placed), "url-edges")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    trust = propagate(hosts.select("host", F.col("allowed").alias("seed")), edges, damping, tolerance, "trust")
    distrust = propagate(hosts.select("host", F.col("blocked").alias("seed")), back, damping, tolerance, "distrust")
    judged = (
        hosts.select("host", "pages")
        .join(trust.withColumnRenamed("mass", "trust"), "host", "left")
        .join(distrust.withColumnRenamed("mass", "distrust"), "host", "left")
        .fillna(0.0, ["trust", "distrust"])
        .withColumn("_host_verdict", F.when(F.col("distrust") - F.col("trust") > share * F.col("pages"), "block").otherwise("allow"))
        .drop("pages")
    )
    return narrow.join(judged, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("_ruled", "_host_verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


@query("op2_filter_urls")
def op2_filter_urls(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
