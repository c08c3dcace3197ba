"""URL filters: host and path rules, and a ratio of two character models for the rest.

Rules decide by the longest that fits.  Every other URL is judged by two smoothed
variable-order Markov models of its UTF-8 bytes, one of the URLs that the rules
allow and one of those they block: orders 0 to ``ORDER`` are blended by
Witten-Bell weights, so a context weighs as much as its counts support.  The
difference of the two log-likelihoods, divided by the number of bytes, is
mapped to a probability by a logistic calibration on counts of held-out labelled
URLs (a fifth, by hash), and compared with one half.

The models are one table, a row for each string of up to ORDER + 1 bytes that the
labelled URLs hold, made by grouped sums over all of them; it grows with the input
and stays sharded.  URLs are dealt to blocks; each block asks for its
different strings once by a count join, so a string that all URLs share is asked for
once a block, not once a URL.  What comes back meets the block's URLs in a
cogroup.  A block is a slice of at most ``BLOCK_ROWS`` rows and about ``BLOCK_BYTES``
bytes of the table as it was read; a very long URL is a block of its own and
needs memory in proportion to its length.

A null URL, or one without ``://``, has an empty host and path, fits no rule and is
allowed: there is nothing to judge it by.  A probability of exactly one half
allows.  Without labelled URLs of both classes every URL outside the rules is
allowed.  Repeated rows are judged alike.  An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.llm.common import discard, mapped, sliced, written

#: The rules (verdict, rule).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Longest context in bytes; a string of ORDER + 1 bytes and its size fit one long.
ORDER = 6
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 18
SIZE_SHIFT = 56
COUNTS = ("n_allow", "n_block", "total_allow", "total_block", "kinds_allow", "kinds_block")


def windows(url: str) -> np.ndarray:
    """The ORDER + 1 bytes before the URL (zeros), then those that end at each of its bytes, as numbers."""
    b = np.concatenate([np.zeros(ORDER + 1, np.int64), np.frombuffer(url.encode("utf-8", "surrogatepass"), np.uint8)])
    n = len(b) - ORDER
    w = np.zeros(n, np.int64)
    for i in range(ORDER + 1):
        w = (w << 8) | b[i: i + n]
    return w


def keys(w: np.ndarray, size: int) -> np.ndarray:
    """The last ``size`` bytes of each window, marked with the size."""
    return (w & ((1 << 8 * size) - 1)) | (size << SIZE_SHIFT)


def split_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """page_id, url, host, path, rule, ruled (the rule's verdict, else null)."""
    pattern = r"://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    out = pages.select("page_id", url.alias("url")).select(
        "page_id", "url", F.translate(F.regexp_extract("url", pattern, 1), upper, lower).alias("host"),
        F.regexp_extract("url", pattern, 2).alias("path"))
    fits = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    for verdict, rule in rules:
        host, path = rule[: rule.index("/")], rule[rule.index("/"):]
        here = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        one = F.when(here, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
        fits = F.greatest(fits, one)
    return out.withColumn("fit", fits).select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled"))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(gram, n_allow, n_block): windows at all bytes of all URLs, counted per batch, then summed."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in sliced(batch, BLOCK_ROWS, BLOCK_BYTES, "url"):
            by: dict[str, list] = {}
            for verdict, url in zip(part.column("ruled").to_pylist(), part.column("url").to_pylist()):
                by.setdefault(verdict, []).append(windows(url)[1:])
            for verdict, w in by.items():
                at, n = np.unique(np.concatenate(w), return_counts=True)
                yield {"gram": at, **{f"n_{v}": n if v == verdict else np.zeros_like(n) for v in ("allow", "block")}}

    part = mapped(labelled.select("ruled", "url"), run, "gram long, n_allow long, n_block long")
    return part.groupBy("gram").agg(F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block"))


def model_table(grams: DataFrame) -> DataFrame:
    """(key, ``COUNTS``): of each string its occurrences in either class and, as a context, the bytes and kinds of bytes that follow."""
    sized = F.explode(F.array(*[F.col("gram").bitwiseAND(F.lit((1 << 8 * size) - 1)).bitwiseOR(F.lit(size << SIZE_SHIFT))
                                for size in range(ORDER + 2)]))
    strings = (grams.select(sized.alias("key"), "n_allow", "n_block").groupBy("key")
               .agg(F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block")))
    size = F.shiftright("key", SIZE_SHIFT)
    context = F.shiftright(F.col("key").bitwiseAND(F.lit((1 << SIZE_SHIFT) - 1)), 8).bitwiseOR(F.shiftleft(size - 1, SIZE_SHIFT))
    zero = lambda names: [F.lit(0).cast("long").alias(c) for c in names]
    followed = strings.where(size > 0).select(
        context.alias("key"), *zero(COUNTS[:2]), F.col("n_allow").alias(COUNTS[2]), F.col("n_block").alias(COUNTS[3]),
        (F.col("n_allow") > 0).cast("long").alias(COUNTS[4]), (F.col("n_block") > 0).cast("long").alias(COUNTS[5]))
    both = strings.select("key", *COUNTS[:2], *zero(COUNTS[2:])).unionByName(followed)
    return both.groupBy("key").agg(*[F.sum(c).alias(c) for c in COUNTS])


def in_blocks(urls: DataFrame) -> DataFrame:
    """``urls`` as a written table with ``block``, the number of the first row of the row's slice."""
    numbered = urls.withColumn("block", F.monotonically_increasing_id())

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in sliced(batch, BLOCK_ROWS, BLOCK_BYTES, "url"):
            first = part.column("block")[0].as_py()
            yield {**{c: part.column(c) for c in part.schema.names}, "block": np.full(part.num_rows, first)}

    return written(mapped(numbered, run, ", ".join(f"`{c}` {t}" for c, t in numbered.dtypes)), "url-blocks")


def wanted_keys(blocks: DataFrame) -> DataFrame:
    """(block, key): the different strings that each block's URLs need."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in sliced(batch, BLOCK_ROWS, BLOCK_BYTES, "url"):
            by: dict[int, list] = {}
            for block, url in zip(part.column("block").to_pylist(), part.column("url").to_pylist()):
                by.setdefault(block, []).append(windows(url))
            for block, w in by.items():
                w = np.unique(np.concatenate(w))
                key = np.concatenate([np.unique(keys(w, size)) for size in range(ORDER + 2)])
                yield {"block": np.full(len(key), block), "key": key}

    return mapped(blocks.select("block", "url"), run, "block long, key long")


def asked(blocks: DataFrame, model: DataFrame) -> DataFrame:
    """(key, block, ``COUNTS``): the model's rows that each block asks for.

    Counts are small as Parquet and many times larger in memory: by its files' size the model would be broadcast through the driver.
    """
    return wanted_keys(blocks).hint("merge").join(model, "key")


def log_ratios(urls: list[str], key: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Difference of the two models' log-likelihoods a byte; ``key`` sorted, ``counts`` a row of ``COUNTS`` for each."""
    w = [windows(u) for u in urls]
    size = np.array([len(x) for x in w])
    w = np.concatenate(w)
    first = np.zeros(len(w), bool)
    first[np.cumsum(size) - size] = True  # the window before each URL is a context only
    counts = np.vstack([counts, np.zeros((1, len(COUNTS)))])
    here = np.flatnonzero(~first)
    chance = np.full((2, len(here)), 1 / 256)
    for length in range(ORDER + 1):
        at = []
        for wanted in (keys(w, length + 1)[here], keys(w, length)[here - 1]):
            i = np.searchsorted(key, wanted)
            at.append(np.where((i < len(key)) & (key[np.minimum(i, len(key) - 1)] == wanted), i, len(key)) if len(key) else np.zeros(len(wanted), int))
        for c in range(2):
            n, total, kinds = counts[at[0], c], counts[at[1], 2 + c], counts[at[1], 4 + c]
            chance[c] = np.where(total > 0, (n + kinds * chance[c]) / np.maximum(total + kinds, 1), chance[c])
    ratio = np.log(chance[0]) - np.log(chance[1])
    ends = np.cumsum(size - 1)
    return np.array([ratio[e - n: e].mean() for e, n in zip(ends, size - 1)])


def rated_blocks(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, host, path, rule, ruled, held, ratio (null for URLs that need none)."""
    passed = ["page_id", "host", "path", "rule", "ruled", "held"]
    kinds = dict(blocks.dtypes)

    def rate(rows: pa.Table, strings: pa.Table) -> pa.Table:
        key = strings.column("key").to_numpy()
        key, at = np.unique(key, return_index=True)  # a block may have asked in two batches
        counts = np.column_stack([strings.column(c).to_numpy().astype(np.float64)[at] for c in COUNTS])
        judged = np.flatnonzero(rows.column("judged").to_numpy())
        ratio: list = [None] * rows.num_rows
        if len(judged):
            for i, r in zip(judged, log_ratios(rows.column("url").take(judged).to_pylist(), key, counts)):
                ratio[i] = float(r)
        return rows.select(passed).append_column("ratio", pa.array(ratio, pa.float64()))

    return (blocks.groupBy("block").cogroup(found.groupBy("block"))
            .applyInArrow(rate, ", ".join(f"`{c}` {kinds[c]}" for c in passed) + ", ratio double"))


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, held_out: int = 5) -> DataFrame:
    """page_id, host, path, rule, verdict, score (calibrated probability of acceptance; null where a rule decides)."""
    urls = split_urls(pages, rules).withColumn("held", F.expr(f"pmod(xxhash64(url), {held_out}) = 0"))
    grams = written(gram_counts(urls.where("ruled is not null and not held")), "url-grams")
    seen = grams.agg(F.sum("n_allow"), F.sum("n_block")).first()
    if not (seen[0] and seen[1]):
        return urls.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    model = written(model_table(grams), "url-model")
    open_url = F.when(F.col("ruled").isNull(), F.col("host") != "").otherwise(F.col("held"))
    blocks = in_blocks(urls.withColumn("judged", open_url))
    found = asked(blocks.where("judged"), model)
    rated = written(rated_blocks(blocks, found), "url-ratios")
    discard(grams, model, blocks)
    slope, offset = calibration(rated)
    chance = 1 / (1 + F.exp(-(F.lit(slope) * F.col("ratio") + F.lit(offset))))
    rated = rated.withColumn("score", F.when((F.col("ruled").isNull()) & (F.col("host") != ""), chance))
    return rated.select("page_id", "host", "path", "rule", F.coalesce(F.col("ruled"), F.when(F.col("score") < 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def calibration(rated: DataFrame) -> tuple[float, float]:
    """Logistic map of the ratio on the held-out labelled URLs, classes weighted equally.

    Fitted on counts of ratios rounded to 0.01, of which there are at most a few thousand.
    """
    cells = (rated.where("held and ruled is not null").groupBy("ruled", F.round(F.col("ratio") * 100).cast("int").alias("cell"))
             .agg(F.count("*").alias("n")).collect())
    if len({c[0] for c in cells}) < 2:
        return 1.0, 0.0
    x = np.array([c[1] / 100 for c in cells])
    y = np.array([1.0 if c[0] == "allow" else 0.0 for c in cells])
    n = np.array([float(c[2]) for c in cells])
    n = np.where(y == 1, n / n[y == 1].sum(), n / n[y == 0].sum()) * 500
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * q * (1 - q)
        grad = np.array([(n * (q - y) * x).sum() + 0.05 * (a - 1), (n * (q - y)).sum() + 0.05 * b])
        hess = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum() + 0.05]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a - np.clip(da, -5, 5), b - np.clip(db, -5, 5)
    return float(a), float(b)
