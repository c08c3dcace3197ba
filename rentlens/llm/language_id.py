"""Language identification of pages by fusing four kinds of evidence.

* Text: log-likelihoods of the page's visible text under character-trigram models.
  These are fitted on a bounded sample of labelled documents (``per_language`` of
  each language, the smallest hashes); their counts are hashed to ``CELLS`` cells.
  As characters are not independent, the sum is divided by ``TEMPER``.
* Declared markup language (``<html lang>``), address suffix (the host's last label)
  and path section (first path segment of two or three letters): likelihoods of the
  value given the language, from counts over all pages against the text's language,
  with additive smoothing, so a value that pages use carelessly weighs little.
* Host: a prior from the languages of the host's pages, smoothed towards its
  registered domain's (last two labels), and that towards all pages'.

All counts are grouped aggregations over all pages; a page's own text counts
towards its host's prior, as one page among them.  The posterior is the normalised
product.  Languages are those of the labelled documents; their number bounds the
row of a page.

Null or empty html has no text and no declared language; a null or odd URL has no
suffix, section or host: such evidence is neutral.  Without labelled documents
the language is the declared one.  Equal posteriors take the first language by
name.  Texts are read whole, however long.  Repeated rows are judged alike.  An empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentlens.llm.common import mapped, sliced, written

CELLS = 1 << 15
TEMPER = 3.0
#: Pages whose weight a parent's distribution has in a child's prior.
PARENT_WEIGHT = 4.0

_DROP = re.compile(r"<(script|style|nav|head|template)\b.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)|<[^>]*>?", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def visible_text(html: str | None) -> str:
    """Text outside tags, scripts, styles, the head, navigation and comments."""
    return entities.unescape(_DROP.sub(" ", html)) if html else ""


def declared_language(html: str | None) -> str | None:
    m = _LANG.search(html) if html else None
    return m.group(1).lower() if m else None


def cells(text: str) -> np.ndarray:
    """Hashed character trigrams of the lower-cased text; runs of anything but letters are one blank."""
    t = re.sub(r"[\W\d_]+", " ", text.lower())
    p = np.frombuffer(f" {t} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(p) < 3:
        return np.empty(0, np.int64)
    h = (p[:-2] * np.uint64(0x1000193) ^ p[1:-1]) * np.uint64(0x1000193) ^ p[2:]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64)


def text_models(docs: DataFrame, per_language: int) -> tuple[list[str], np.ndarray]:
    """Languages and, per language, the log-probability of each cell; from at most ``per_language`` documents of each."""
    t = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang <> '' and text <> ''")
    t = t.withColumn("h", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy("h")
    picks = t.select("lang", "h").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select("lang", "h")
    # as many rows as languages times ``per_language``: small enough to broadcast, and to fetch with their texts
    rows = t.join(F.broadcast(picks), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    names = sorted({r.lang for r in rows})
    counts = np.full((len(names), CELLS), 0.1)
    for r in sorted(rows, key=lambda r: (r.lang, r.h)):
        counts[names.index(r.lang)] += np.bincount(cells(r.text), minlength=CELLS)
    return names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def page_evidence(pages: DataFrame, names: list[str], logp: np.ndarray) -> DataFrame:
    """page_id, declared, suffix, section, host, domain, text (array: log-likelihood per language, best 0)."""
    held = pages.sparkSession.sparkContext.broadcast(logp)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        table = held.value
        for part in sliced(batch, rows=500, text="html"):
            texts, declared = [], []
            for html in part.column("html").to_pylist():
                c = cells(visible_text(html))
                ll = table[:, c].sum(axis=1, dtype=np.float64) / TEMPER if len(c) else np.zeros(len(names))
                texts.append((ll - ll.max(initial=-np.inf)).tolist() if len(names) else [])
                declared.append(declared_language(html))
            yield {"page_id": part.column("page_id"), "url": part.column("url"), "declared": declared, "text": texts}

    kind = dict(pages.dtypes)["page_id"]
    out = mapped(pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), run,
                 f"page_id {kind}, url string, declared string, text array<double>")
    url = F.coalesce(F.col("url"), F.lit(""))
    out = out.withColumn("host", F.lower(F.regexp_extract(url, r"://([^/?#:]*)", 1))).withColumn(
        "section", F.lower(F.regexp_extract(url, r"://[^/?#]*/([A-Za-z]{2,3})(?:[/?#]|$)", 1)))
    empty = lambda c: F.when(F.col(c) != "", F.col(c))
    return (out.withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1)).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
            .select("page_id", "declared", empty("suffix").alias("suffix"), empty("section").alias("section"),
                    empty("host").alias("host"), F.coalesce(empty("domain"), empty("host")).alias("domain"), "text"))


def language_id(pages: DataFrame, docs: DataFrame, per_language: int = 500) -> DataFrame:
    """page_id, lang, probability, declared, text_lang of every row of ``pages`` (page_id, url, html)."""
    names, logp = text_models(docs, per_language)
    if not names:
        named = page_evidence(pages, ["und"], np.zeros((1, CELLS), np.float32))
        return named.select("page_id", F.col("declared").alias("lang"), F.lit(None).cast("double").alias("probability"), "declared",
                            F.lit(None).cast("string").alias("text_lang"))
    n = len(names)
    seen = written(page_evidence(pages, names, logp).withColumn("row", F.monotonically_increasing_id()), "page-evidence")
    # the text's own posterior, rounded so that sums do not depend on their order
    total = F.aggregate("text", F.lit(0.0), lambda a, x: a + F.exp(x))
    seen = seen.withColumn("share", F.transform("text", lambda x: F.round(F.exp(x) / total * 1e6).cast("long")))
    sums = [F.sum(F.col("share")[i]).alias(f"s{i}") for i in range(n)]
    counts = F.array(*[F.col(f"s{i}") / 1e6 for i in range(n)])
    everywhere = [float(x or 0) / 1e6 for x in seen.agg(*sums).first()]
    whole = sum(everywhere) or 1.0
    root = F.array(*[F.lit((x + 1.0) / (whole + n)) for x in everywhere])

    def smoothed(own, parent):
        size = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, parent, lambda x, p: (x + PARENT_WEIGHT * p) / (size + PARENT_WEIGHT))

    domains = seen.where("domain is not null").groupBy("domain").agg(*sums).select("domain", smoothed(counts, root).alias("of_domain"))
    hosts = (seen.where("host is not null").groupBy("host", "domain").agg(*sums).select("host", "domain", counts.alias("c"))
             .join(domains, "domain").select("host", smoothed(F.col("c"), F.col("of_domain")).alias("prior")))
    out = seen.join(hosts, "host", "left").withColumn("belief", F.zip_with(
        "text", F.coalesce("prior", root), lambda x, p: x + F.log(p)))
    for kind in ("declared", "suffix", "section"):
        # how often the languages' pages show this value, against a language whose pages never do
        table = seen.where(F.col(kind).isNotNull()).groupBy(kind).agg(*sums).select(kind, counts.alias("c"))
        size = seen.where(F.col(kind).isNotNull()).agg(F.countDistinct(kind), *sums).first()
        values = float(size[0] or 0) + 1
        given = F.array(*[F.lit(float(x or 0) / 1e6) for x in size[1:]])
        table = table.select(kind, F.zip_with("c", given, lambda c, g: F.log((c + 0.5) / (g + 0.5 * values))).alias("e"))
        out = out.join(table, kind, "left").withColumn("belief", F.when(F.col("e").isNull(), F.col("belief")).otherwise(
            F.zip_with("belief", "e", lambda b, e: b + e))).drop("e")
    langs = F.array(*[F.lit(x) for x in names])
    best, top = F.array_max("belief"), F.array_max("text")
    odds = F.aggregate("belief", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    at = lambda c, m: F.element_at(langs, F.array_position(F.col(c), m).cast("int"))
    flat = F.array_min("text") == top
    return out.select("page_id", at("belief", best).alias("lang"), F.round(1 / odds, 6).alias("probability"), "declared",
                      F.when(~flat, at("text", top)).alias("text_lang"))
