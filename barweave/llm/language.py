"""Language identification by fusing evidence.

Four kinds of evidence are multiplied, each as a likelihood or prior per
language: the text (byte trigrams), the language the markup or metadata
declares, the suffix of the address, and what else the host publishes.  How far
declarations and suffixes can be trusted, and what hosts publish, is learned
from the corpus itself: the posteriors of the text alone are summed per
declaration, suffix, domain and host.  A host's prior falls back on its domain's
and that on the whole corpus', by how much each has been seen; a record's own
contribution is taken out of its host's sum.

Against the languages stands the hypothesis that a text is in none of them: every
trigram of letters is equally likely then.  Digits and signs belong to no language
and say nothing for or against it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.llm.base import bounded_batches, by_keys, look_up, query, row_keys, stored, table
from barweave.llm.url_filter import lower_ascii, url_parts

BUCKETS = 1 << 14
#: Documents a language's trigram table is fitted on.
SAMPLE = 500
#: Trigrams' worth of trust that a label gives to the trigrams of all labels.
SHARED = BUCKETS / 2
#: Neighbouring trigrams overlap, so each counts for this share of an independent observation.
INDEPENDENCE = 1 / 3
#: Records' worth of trust that a domain or host gives to the level above.
STRENGTH = 20.0
CONFIDENCE = 0.5
#: Share of records that are expected to be in no language that was learned.
UNLEARNED = 1e-3
#: Bytes of letters, and the blanks between words.
LETTERS = np.array([b >= 128 or chr(b).isalpha() or chr(b).isspace() for b in range(256)])


def _raw(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8)


def _codes(text: str) -> np.ndarray:
    raw = _raw(text).astype(np.uint32)
    return ((raw[:-2] * 0x9E3779B1 + raw[1:-1] * 0x85EBCA77 + raw[2:] * 0xC2B2AE3D) >> 18) % BUCKETS


@dataclass(frozen=True)
class TextModel:
    """Log-probabilities of trigram buckets: one column per language."""

    languages: list[str]
    table: np.ndarray

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the natural logarithms of its likelihoods, the best of them 0, and of that in none of the
        languages against the best one.  A text without a letter says nothing (zeros)."""
        out, none = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for i, text in enumerate(texts):
            if text and any(map(str.isalpha, text)):
                scores, letter = self.table[_codes(text)], LETTERS[_raw(text)]
                out[i] = scores.sum(axis=0, dtype=np.float64) * INDEPENDENCE
                best = scores[letter[:-2] & letter[1:-1] & letter[2:], out[i].argmax()]
                none[i] = -(best.sum(dtype=np.float64) + len(best) * np.log(BUCKETS)) * INDEPENDENCE
                out[i] -= out[i].max()
        return out, none

    def likelihoods(self, texts: list[str | None]) -> np.ndarray:
        """Natural logarithms up to a constant per text; a text without a letter says nothing (zeros)."""
        return self.evidence(texts)[0]


def fit(docs: DataFrame, sample: int = SAMPLE) -> TextModel:
    """Trigram tables from whole texts of at most ``sample`` documents per label in ``lang``
    (those with the smallest hashes of their ids).  Every label is a language; the fewer
    trigrams it has, the more its table is that of all labels.  Rows with a null label or
    text teach nothing.  Without any label there is one language, ``und``."""
    keyed = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    # about twice the sample of each label is ranked: the hashes under a bound that its count gives
    counts = stored(keyed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang-labels")
    names = sorted(r["lang"] for r in counts.select("lang").collect())
    if not names:
        return TextModel(["und"], np.zeros((BUCKETS, 1), dtype=np.float32))
    share = F.lit(2.0 * sample) / F.col("n")
    bound = F.when(share >= 1, F.lit(2**63 - 1)).otherwise((share * 2.0**64 - 2.0**63).cast("long"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    # ids first, so that the ranking moves no texts; then the few texts themselves
    few = look_up(keyed, counts.select("lang", bound.alias("_bound")), "lang").where(F.xxhash64("doc_id") <= F.col("_bound"))
    ids = few.withColumn("text", F.xxhash64("text")).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= sample)
    picked = keyed.withColumn("_h", F.xxhash64("text")).join(F.broadcast(ids.select("doc_id", "lang", F.col("text").alias("_h")).distinct()), ["doc_id", "lang", "_h"], "left_semi")
    picked = picked.groupBy("lang", "doc_id", "_h").agg(F.min("text").alias("text"))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for t in rows["text"]:
            total += np.bincount(_codes(t), minlength=BUCKETS)
        at = np.flatnonzero(total)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "places": [at.astype(np.int32).tobytes()], "counts": [total[at].tobytes()]})

    # only the trigrams that occur travel
    found = np.zeros((BUCKETS, len(names)))
    at = {n: i for i, n in enumerate(names)}
    for r in picked.groupBy("lang").applyInPandas(work, "lang string, places binary, counts binary").toLocalIterator():
        found[np.frombuffer(r["places"], dtype=np.int32), at[r["lang"]]] = np.frombuffer(r["counts"], dtype=np.int64)
    everywhere = found.sum(axis=1, keepdims=True) / max(found.sum(), 1)
    table_ = (found + 0.5 + SHARED * everywhere) / (found.sum(axis=0) + 0.5 * BUCKETS + SHARED)
    return TextModel(names, np.log(table_).astype(np.float32))


def primary_tag(declared: Column) -> Column:
    """``en`` of ``en-GB`` or ``EN_us``; null stays null."""
    return F.lower(F.regexp_extract(F.trim(declared), r"^([A-Za-z0-9]+)", 1))


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    """The last label of a host with several, else empty."""
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1)).otherwise("")


def identify(records: DataFrame, model: TextModel, keys: list[str], confidence: float = CONFIDENCE, strength: float = STRENGTH) -> DataFrame:
    """``keys`` of ``records`` (text, declared, host) with text_lang, lang, confidence and kept.

    ``lang`` has the highest posterior (of equal ones the first in alphabetical order),
    ``text_lang`` that by the text alone.  A record without a letter has only the other
    evidence for its ``lang``, and is not kept.  ``confidence`` is the posterior among the
    languages; a record with a letter is kept when its posterior reaches ``confidence``
    with the hypothesis of no learned language among the others.  Null declarations and hosts are values of their own that
    say what records like them say.  Repeated rows count and are judged each.
    """
    names, k = model.languages, len(model.languages)
    shared = records.sparkSession.sparkContext.broadcast(model)
    slim = records.select(*keys, F.coalesce(primary_tag(F.col("declared")), F.lit("")).alias("declared"), F.coalesce("host", F.lit("")).alias("host"), "text")
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    carried = [*keys, "declared", "host"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, "text"):
            log, none = shared.value.evidence(batch.column("text").to_pylist())
            # a single language is as likely as itself: letters are told apart by the text, not by zeros
            letters = [bool(t) and any(map(str.isalpha, t)) for t in batch.column("text").to_pylist()]
            columns = [*[batch.column(c) for c in carried], pa.array(letters), pa.array(list(log)), pa.array(none)]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, "letters", "log", "none"])

    read = stored(slim.mapInArrow(work, ", ".join([*[f"`{c}` {kinds[c]}" for c in carried], "letters boolean", "log array<double>", "none double"])), "lang-text")
    # languages that are no name here share one value, so the table of declarations is bounded
    declared = F.when(F.col("declared").isin(names) | (F.col("declared") == ""), F.col("declared")).otherwise("other")
    total = F.aggregate("log", F.lit(0.0), lambda a, x: a + F.exp(x))
    read = read.withColumns({"declared": declared, "domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host")), "own": F.transform("log", lambda x: F.exp(x) / total)})
    sums = [F.sum(F.when(F.col("letters"), F.col("own")[i]).otherwise(0.0)) for i in range(k)]

    def seen(by: list[str], name: str) -> DataFrame:
        return read.groupBy(*by).agg(F.array(*sums).alias(name))

    whole = np.array(read.agg(F.array(*[F.coalesce(s, F.lit(0.0)) for s in sums])).first()[0])  # one number per language
    base = (whole + 1) / (whole + 1).sum()
    declarations = {r["declared"]: r["n"] for r in seen(["declared"], "n").collect()}  # at most two more than languages
    everywhere = {d: (sum(n) + 0.5) / (whole.sum() + 0.5 * len(declarations)) for d, n in declarations.items()}
    table_ = {d: (np.array(n) + 0.5) / (whole + 0.5 * len(declarations)) for d, n in declarations.items()}
    joined = read
    for level in ("host", "domain", "suffix"):
        joined = look_up(joined, stored(seen([level], f"{level}_n"), f"lang-{level}"), level)
    names_array = np.array(names)

    def fuse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            log, own, host, domain, suffix = (np.array(b[c].tolist()) for c in ("log", "own", "host_n", "domain_n", "suffix_n"))
            own = own * b["letters"].to_numpy()[:, None]
            less = lambda n: np.maximum(n - own, 0.0)
            prior = (less(domain) + strength * base) / (less(domain).sum(axis=1, keepdims=True) + strength)
            prior = (less(host) + strength * prior) / (less(host).sum(axis=1, keepdims=True) + strength)
            # how much likelier the suffix makes a language than the corpus does
            by_suffix = (less(suffix) + strength * base) / (less(suffix).sum(axis=1, keepdims=True) + strength) / base
            said = np.stack([table_[d] for d in b["declared"]])
            score = log + np.log(prior) + np.log(by_suffix) + np.log(said)
            top = score.max(axis=1, keepdims=True)
            post = np.exp(score - top)
            # a text in no language is declared as any is, at any address
            none = b["none"].to_numpy() + np.log(UNLEARNED) + np.log([everywhere[d] for d in b["declared"]]) - top[:, 0]
            learned = 1 / (1 + np.exp(np.minimum(none - np.log(post.sum(axis=1)), 700.0)))
            post /= post.sum(axis=1, keepdims=True)
            out = b[keys].copy()
            out["text_lang"] = np.where(b["letters"], names_array[log.argmax(axis=1)], None)
            out["lang"], out["confidence"] = names_array[post.argmax(axis=1)], post.max(axis=1)
            out["kept"] = b["letters"].to_numpy() & (out["confidence"].to_numpy() * learned >= confidence)
            yield out

    fused = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "text_lang string, lang string, confidence double, kept boolean"])
    return joined.mapInPandas(fuse, fused)


TAGS = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"
HTML_LANG = r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?\s*([A-Za-z0-9_-]+)"


def page_records(pages: DataFrame) -> DataFrame:
    """page_id, text, declared and host of pages (page_id, url, html)."""
    host, _ = url_parts(F.col("url"))
    text = F.regexp_replace("html", TAGS, " ")
    return pages.select("page_id", text.alias("text"), F.regexp_extract("html", HTML_LANG, 1).alias("declared"), host.alias("host"))


def document_records(docs: DataFrame) -> DataFrame:
    """Documents with their declared language and source: a source without an address is a host without suffix."""
    return docs.withColumns({"declared": F.col("lang"), "host": lower_ascii(F.col("source"))})


def in_a_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source), with all their columns, whose language is identified.

    Rows with equal text, language and source are judged alike; those without a letter go.
    """
    keyed = row_keys(docs, "text", "lang", "source")
    records = document_records(keyed.select("__k1", "__k2", "text", "lang", "source"))
    judged = identify(records, fit(docs), ["__k1", "__k2"])
    gone = stored(judged.where("not kept").select("__k1", "__k2").distinct(), "lang-gone")
    return by_keys(keyed, gone, "left_anti").select(*docs.columns)


@query("op6_identify_languages")
def op6_identify_languages(spark, sf_dir):
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    one = document_records(docs.select("doc_id", "text", "lang", "source")).select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", "declared", "host")
    two = page_records(pages).select(F.lit(None).cast("long").alias("doc_id"), "page_id", "text", "declared", "host")
    return identify(one.unionByName(two), fit(docs), ["doc_id", "page_id"])
