"""Language ID: Bayesian fusion of text, declared language, address suffix and host.

For a page, ``P(lang | all)`` is taken as proportional to

    P(lang | host) * P(text | lang) ** TEMPER * P(declared | lang)

* **text**: a multinomial model of hashed character trigrams over the page's visible text,
  fitted on a bounded sample of labelled documents. Its log-likelihood is divided by the
  number of trigrams and multiplied by at most EVIDENCE (trigrams of a text aren't
  independent, so a long text mustn't drown everything else).
* **declared**: the ``lang`` attribute of ``<html>``, by its primary subtag. How far it can be
  trusted is counted: over all pages, how often each declaration meets each language of the
  text alone, with CLEAN pseudo-counts for a true declaration. No declaration says nothing.
* **address**: priors by host are counted from the text posteriors of all pages of a host and
  smoothed towards those of the address suffix, which are smoothed towards those of all
  pages, which are smoothed towards equal shares (SMOOTH pseudo-pages at each level). Each
  page's own part is taken out of the counts before they become its prior.

All counts are grouped sums of whole columns, combined before they are shuffled; a host with
a third of all pages is one row of sums, joined by a join that can be split.

A null or empty page has no text evidence: its text posterior is equal over the languages. A
null or unreadable address has the host and suffix ''. Pages are judged row by row, also
those that repeat an id; ties go to the first language by name. Other columns are ignored.
Without any labelled text there is no language to name: lang and text_lang are null and the
probability is 0. An empty table of pages gives an empty result. Texts are read whole.

Every language of the labels is learnt, from one scan; a model holds 128 KB a language, and more
than MOST_LANGS of them (256 MB) raise an error rather than leave some out.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contractlog.llm.common import Scratch, small_batches

#: Labelled documents of each language that the fit reads at most; languages that a broadcast model may hold.
SAMPLE, MOST_LANGS = 300, 2048
BUCKETS = 1 << 15
#: Trigrams that a text counts for at most; pseudo-pages of each level; pseudo-counts of true and of other declarations.
EVIDENCE, SMOOTH, CLEAN, OTHER = 40.0, 5.0, 8.0, 1.0

_HIDDEN = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[A-Za-z/!?][^>]*>")


def visible(page: str | None) -> str:
    """The text of a page without scripts, styles, comments and tags, its character references decoded.

    A ``<`` before anything but a letter, ``/``, ``!`` or ``?`` is text, as is one that a reference gives.
    """
    return html.unescape(_HIDDEN.sub(" ", page or ""))


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of code points, lower case, each run of other characters than letters one blank."""
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    c = np.frombuffer((" " + " ".join(low.split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.empty(0, np.int64)
    h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(31)
    return ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - 15)).astype(np.int64)


class Model:
    """log P(trigram | language), one row of BUCKETS numbers a language."""

    def __init__(self, langs: list[str], logs: np.ndarray | None):
        self.langs, self.logs = langs, logs

    def posterior(self, text: str) -> list[float]:
        at = trigrams(text)
        if not len(at):
            return [1 / len(self.langs)] * len(self.langs)
        ll = self.logs[:, at].mean(1) * min(EVIDENCE, len(at))
        p = np.exp(ll - ll.max())
        return (p / p.sum()).tolist()


def fit(texts: list[str], langs: list[str]) -> Model:
    names = sorted(set(langs))
    counts = np.full((len(names), BUCKETS), 0.5)
    for text, lang in zip(texts, langs):
        at = trigrams(text)
        if len(at):
            counts[names.index(lang)] += np.bincount(at, minlength=BUCKETS) / len(at) * 400
    return Model(names, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32) if names else None)


def train(docs: DataFrame, per_lang: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of at most per_lang documents of each language, the first by a hash of id.

    The ranks are cut off where the rows are read, so a language with a third of all rows
    sends per_lang rows from each task and no more.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"))
    count = rows.agg(F.approx_count_distinct("lang")).first()[0]
    if count > MOST_LANGS:
        raise ValueError(f"about {count} languages are labelled; a model holds {MOST_LANGS}")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = rows.withColumn("k", rank).where(F.col("k") <= per_lang).drop("k")  # per_lang rows a language
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(chosen.distinct()), (texts.lang == chosen.lang) & texts.id.eqNullSafe(chosen.id), "left_semi")
    found = sorted(joined.collect(), key=lambda r: (r.lang, str(r.id), r.text or ""))
    return fit([r.text or "" for r in found], [r.lang for r in found])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"\.([^.]+)\.?$", 1)


def declared_of(html: Column) -> Column:
    """The primary subtag of <html lang=...>, or an empty string."""
    tag = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b([^>]*)>", 1)
    return F.lower(F.regexp_extract(tag, r"""(?i)(?:^|\s)(?:xml:)?lang\s*=\s*["']?\s*([A-Za-z]{2,3})(?![A-Za-z])""", 1))


def _reader(model):
    def run(batches):
        for batch in batches:
            htmls = batch.column(batch.schema.get_field_index("html")).to_pylist()
            p = pa.array([model.value.posterior(visible(h)) for h in htmls], pa.list_(pa.float64()))
            kept = [n for n in batch.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), p], [*kept, "p"])

    return run


def identify(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, lang, probability, text_lang, declared, host, suffix."""
    small_batches(pages.sparkSession)
    langs = model.langs
    if not langs:
        host = host_of(F.col(url_col))
        none = F.lit(None).cast("string")
        return pages.select(
            F.col(id_col), none.alias("lang"), F.lit(0.0).alias("probability"), none.alias("text_lang"), declared_of(F.col(html_col)).alias("declared"), host.alias("host"), suffix_of(host).alias("suffix")
        )
    k = len(langs)
    sent = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(
        F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), declared_of(F.col(html_col)).alias("declared"), F.col(html_col).alias("html")
    ).withColumn("suffix", suffix_of(F.col("host")))
    known = f"id {dict(pages.dtypes)[id_col]}, host string, declared string, suffix string, p array<double>"
    seen = Scratch(pages.sparkSession, "lang").write(
        rows.select("id", "host", "declared", "suffix", "html").mapInArrow(_reader(sent), known), "text"
    )
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k)]
    vector = lambda: F.array(*(F.col(f"s{i}") for i in range(k)))
    hosts = seen.groupBy("host", "suffix").agg(*sums).select("host", "suffix", vector().alias("hs"))
    each = [F.sum(F.col("hs")[i]).alias(f"s{i}") for i in range(k)]
    suffixes = hosts.groupBy("suffix").agg(*each).select("suffix", vector().alias("ss"))
    total = suffixes.agg(*(F.coalesce(F.sum(F.col("ss")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(k))).select(vector().alias("gs"))
    said = seen.groupBy("declared").agg(*sums).select("declared", vector().alias("ds"))
    names = F.array(*(F.lit(x) for x in langs))
    met = (
        seen.join(hosts.select("host", "suffix", "hs"), ["host", "suffix"]).join(suffixes, "suffix").join(said, "declared").crossJoin(F.broadcast(total))
    )  # the last is one row
    # without the page itself: p is its own part of every sum
    less = lambda c: F.zip_with(c, "p", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    total_of = lambda c: F.aggregate(c, F.lit(0.0), lambda z, x: z + x)
    met = met.withColumn("g", less("gs")).withColumn("s", less("ss")).withColumn("h", less("hs")).withColumn("d", less("ds"))
    met = met.withColumn("gp", F.transform("g", lambda x: (x + SMOOTH / k) / (total_of("g") + SMOOTH)))
    met = met.withColumn("sp", F.zip_with("s", "gp", lambda x, q: (x + q * SMOOTH) / (total_of("s") + SMOOTH)))
    met = met.withColumn("hp", F.zip_with("h", "sp", lambda x, q: (x + q * SMOOTH) / (total_of("h") + SMOOTH)))
    # P(declared | lang): this declaration's share of the language's pages, with pseudo-counts
    own = F.transform(names, lambda x: F.when(x == F.col("declared"), F.lit(CLEAN)).otherwise(F.lit(OTHER)))
    share = F.zip_with(F.zip_with("d", own, lambda x, y: x + y), "g", lambda x, g: x / (g + F.lit(CLEAN + OTHER * k)))
    told = F.when(F.col("declared") == "", F.transform(names, lambda x: F.lit(1.0))).otherwise(share)
    met = met.withColumn("joint", F.zip_with(F.zip_with("hp", "p", lambda x, y: x * y), told, lambda x, y: x * y))
    met = met.withColumn("post", F.transform("joint", lambda x: x / total_of("joint")))
    top = F.array_max("post")
    first = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return met.select(
        F.col("id").alias(id_col), first(F.col("post")).alias("lang"), top.alias("probability"), first(F.col("p")).alias("text_lang"), "declared", "host", "suffix"
    )
