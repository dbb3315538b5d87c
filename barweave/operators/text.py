"""News and sentiment roll-ups over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.mathx import clip

# Polarity of a few plain words.
LEXICON = {
    "good": 1.0, "great": 1.0, "excellent": 1.0, "gain": 1.0, "profit": 1.0, "strong": 1.0,
    "bad": -1.0, "poor": -1.0, "weak": -1.0, "loss": -1.0, "stupid": -1.0, "idiot": -1.0,
    "worthless": -1.0, "pathetic": -1.0, "disgusting": -1.0,
}


def strip_html(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "<[^>]*>", ""))


def recent(news: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    d = F.datediff(F.lit(as_of).cast("date"), F.col("date"))
    return news.where((d >= 0) & (d <= days))


def headline_key(x: Column, chars: int | None = None) -> Column:
    """What makes headlines the same: the whole trimmed text in small letters, or its first ``chars``."""
    key = F.trim(F.lower(x))
    return key if chars is None else F.substring(key, 1, chars)


def dedupe_headlines(news: DataFrame, order: str = "doc_id", chars: int | None = None) -> DataFrame:
    """First item per headline key, by a unique ``order`` column; empty headlines are dropped.

    Only (digest of the key, order) goes through the aggregate, combined map-side, so a
    headline copied a billion times is one row per task and texts never sit in its
    buffers; the winners then fetch their rows by the unique column.
    """
    full = news.where(F.trim("headline") != "")
    k = F.sha2(headline_key(F.col("headline"), chars), 256)
    first = full.groupBy(k.alias("_k")).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies")).drop("_k")
    return full.join(first, order)


def label_value(label: Column) -> Column:
    return F.when(F.lower(label) == "positive", 1.0).when(F.lower(label) == "negative", -1.0).otherwise(0.0)


def five_way(s: Column) -> Column:
    return F.when(s <= -0.5, "Very Negative").when(s <= -0.1, "Negative").when(s < 0.1, "Neutral").when(s < 0.5, "Positive").otherwise("Very Positive")


def weighted_sentiment(news: DataFrame, keys: list[str], value: Column, weight: Column) -> DataFrame:
    num, den = F.sum(value * weight), F.sum(weight)
    s = clip(F.when(den > 0, F.try_divide(num, F.nullif(den, F.lit(0.0)))).otherwise(0.0), -1.0, 1.0)
    return news.groupBy(*keys).agg(s.alias("score"), F.count(F.lit(1)).alias("n")).withColumn("label", five_way(F.col("score")))


def sentiment_breakdown(news: DataFrame, value: Column, weight: Column) -> DataFrame:
    """Scores by date (weighted) and by source (plain mean), each within -1 and 1, in one grouping-sets pass."""
    d = news.select("date", "source", value.alias("v"), weight.alias("w"))
    g = d.groupingSets([[F.col("date")], [F.col("source")]], F.col("date"), F.col("source"))
    weighted = F.try_divide(F.sum(F.col("v") * F.col("w")), F.nullif(F.sum("w"), F.lit(0.0)))
    score = clip(F.when(F.grouping("date") == 0, weighted).otherwise(F.avg("v")), -1.0, 1.0)
    return g.agg(score.alias("score"), F.count(F.lit(1)).alias("n")).select(
        F.coalesce(F.col("date").cast("string"), F.lit("ALL")).alias("day"), F.coalesce("source", F.lit("ALL")).alias("source"), "score", "n")


def headlines_of_day(news: DataFrame) -> DataFrame:
    """All headlines of each (ticker, date), one row each, with the number of articles of that day.

    Rows instead of one array per day, so a day with a third of all news is no single value.
    """
    articles = news.groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("articles"))
    return news.select("ticker", "date", "doc_id", "headline").join(articles, ["ticker", "date"])


def hours_since(ts: Column, ref: Column) -> Column:
    return F.greatest((ref.cast("timestamp").cast("double") - ts.cast("timestamp").cast("double")) / 3600.0, F.lit(0.0))


def time_decay(score: Column, hours: Column, rate: float) -> Column:
    return score * F.exp(-rate * hours)


def decayed_impact(news: DataFrame, as_of: str, value: Column, rate: float = 0.10, day_rate: float = 0.3, full: int = 3) -> DataFrame:
    """Hour-decayed sentiment, recency-weighted mean and impact (total weight over
    ``full`` items, at most 1) per ticker."""
    ref = F.lit(as_of).cast("timestamp")
    h = hours_since(F.col("date"), ref)
    w = F.exp(-day_rate * h / 24.0)
    d = news.withColumns({"_d": time_decay(value, h, rate), "_w": w, "_v": value})
    return d.groupBy("ticker").agg(
        F.sum("_d").alias("decayed"), F.try_divide(F.sum(F.col("_v") * F.col("_w")), F.nullif(F.sum("_w"), F.lit(0.0))).alias("sentiment"),
        F.least(F.sum("_w") / full, F.lit(1.0)).alias("impact"), F.count(F.lit(1)).alias("n"))


def lexicon_scores(docs: DataFrame, lexicon: dict[str, float] = LEXICON) -> DataFrame:
    """Polarity per document over its whole text: hits over the root of their number.

    The lexicon is a literal array, so matching is a filter of the split words and
    nothing is exploded or joined.
    """
    words = F.split(F.lower("text"), "[^a-z]+")
    pos = F.array(*[F.lit(w) for w, v in lexicon.items() if v > 0])
    neg = F.array(*[F.lit(w) for w, v in lexicon.items() if v < 0])
    d = docs.withColumn("_w", words)
    p, n = F.size(F.filter("_w", lambda w: F.array_contains(pos, w))), F.size(F.filter("_w", lambda w: F.array_contains(neg, w)))
    return d.withColumns({"pos": p, "neg": n}).withColumn(
        "polarity", F.coalesce((F.col("pos") - F.col("neg")) / F.nullif(F.sqrt((F.col("pos") + F.col("neg")).cast("double")), F.lit(0.0)), F.lit(0.0))).drop("_w")


def union_sources(frames: list[DataFrame], per_source: int, order: list[Column]) -> DataFrame:
    """Union of feeds, newest ``per_source`` items of each."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f)
    return u.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where(F.col("rn") <= per_source)
