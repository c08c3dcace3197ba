"""Substring dedup: sharded FM-indexes; matching statistics mark words that an earlier document has.

Words are ``[^\\x20\\x09-\\x0D]+``.  A window is ``window`` consecutive words of a
document; each word of a window whose words also stand in a document with a
smaller doc_id is removed.  Windows are judged on the input.

1. *Routing.*  The smallest hash of the ``anchor``-word runs in a window is its
   anchor: equal windows have equal anchors.  Only anchors that two documents
   have matter; the stretch of words whose windows share one occurrence of such
   an anchor is a *segment* (under ``2 * window`` words).
2. Equal segments are one; its smallest doc_id owns it.  So a passage or copy,
   however frequent, enters the index once.
3. Segments go to shards by anchor.  Where one anchor has more than
   ``hot_segments`` different segments (a common line in many contexts), these are
   cut into their windows, windows that only one segment has are left out, and
   the others go to shards by their own hash; so no shard holds a hot group.
4. A shard of about ``shard_words`` words gets an FM-index.  Backward search over
   its wavelet tree streams every segment through it; positions whose matching
   statistic reaches ``window`` are repeats, and the smallest owner among the
   matched suffixes says of whom.
5. What is found returns to all occurrences of the segment as intervals of their
   documents, which are then cut.

Nulls and empties: null text counts as no words, and a null doc_id neither
removes nor is cut.  Rows that repeat a doc_id do not remove each other.
Words are compared by 64-bit hashes.  An empty table gives an empty result.
Other columns pass through; ``n_words``, ``n_removed``, ``kept_text`` are added
(replacing input columns of these names).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.llm.common import (byte_words, carried, discard, gram_hashes, mapped, runs, sliced, sliding_min, unused, word_hashes,
                                 written)
from rentlens.llm.fm_index import FMIndex

ANCHOR = 20
HOT_SEGMENTS = 4000
SHARD_WORDS = 600_000


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def anchors_of(text: str | None, window: int, anchor: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, their hashes and the anchor of each window."""
    words = byte_words(text)
    if len(words) < window:
        return words, np.empty(0, np.uint64), np.empty(0, np.uint64)
    h = word_hashes(words)
    return words, h, sliding_min(gram_hashes(h, anchor), window - anchor + 1)


def document_anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, doc_id, row) for the distinct anchors of each document."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in sliced(batch, text="text"):
            per = [np.unique(_signed(anchors_of(t, window, anchor)[2])) for t in part.column("text").to_pylist()]
            counts = [len(x) for x in per]
            take = pa.array(np.repeat(np.arange(len(per)), counts))
            yield {"anchor": np.concatenate(per), "doc_id": part.column("doc_id").take(take), "row": part.column("row").take(take)}

    return mapped(docs, run, "anchor long, doc_id long, row long")


def segments(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Stretches of the documents whose windows share an anchor in the column ``anchors``.

    seg (hash), anchor, doc_id, row, start (first word), windows, words (joined by one space).
    """

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in sliced(batch, rows=500, text="text"):
            out: dict[str, list] = {c: [] for c in ("seg", "anchor", "doc_id", "row", "start", "windows", "words")}
            anchors = part.column("anchors")
            for i, (text, doc, row) in enumerate(zip(*(part.column(c).to_pylist() for c in ("text", "doc_id", "row")))):
                words, _, low = anchors_of(text, window, anchor)
                at, count = runs(low)
                shared = np.isin(_signed(low[at]), anchors[i].values.to_numpy(zero_copy_only=False))
                for s, c in zip(at[shared].tolist(), count[shared].tolist()):
                    body = b" ".join(words[s: s + c + window - 1])
                    out["seg"].append(xxhash.xxh3_64_intdigest(body) - (1 << 63))
                    out["anchor"].append(int(_signed(low[s: s + 1])[0]))
                    out["doc_id"].append(doc)
                    out["row"].append(row)
                    out["start"].append(s)
                    out["windows"].append(c)
                    out["words"].append(body)
            yield out

    return mapped(docs, run, "seg long, anchor long, doc_id long, row long, start int, windows int, words binary")


def segment_windows(segs: DataFrame, window: int) -> DataFrame:
    """(piece, seg, owner, at, words) for each window of the segments; piece is the window's hash."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in sliced(batch, rows=500):
            out: dict[str, list] = {c: [] for c in ("piece", "seg", "owner", "at", "words")}
            for seg, owner, body in zip(*(part.column(c).to_pylist() for c in ("seg", "owner", "words"))):
                words = body.split()
                for at in range(len(words) - window + 1):
                    piece = b" ".join(words[at: at + window])
                    out["piece"].append(xxhash.xxh3_64_intdigest(piece) - (1 << 63))
                    out["seg"].append(seg)
                    out["owner"].append(owner)
                    out["at"].append(at)
                    out["words"].append(piece)
            yield out

    return mapped(segs, run, "piece long, seg long, owner long, at int, words binary")


def first_owners(bodies: list[bytes], owners: np.ndarray, window: int) -> list[np.ndarray]:
    """For each segment, per window, the smallest owner of a segment that holds it, found with an FM-index."""
    words = [b.split() for b in bodies]
    hashes = word_hashes([w for ws in words for w in ws])
    known, ids = np.unique(hashes, return_inverse=True)
    ends = np.cumsum([len(w) for w in words])
    lanes = np.split(ids + 1, ends[:-1])
    index = FMIndex(lanes, len(known) + 1, window)
    seg_of = np.searchsorted(index.starts, index.suffix, side="right") - 1
    owner = np.where(seg_of >= 0, owners[seg_of], np.iinfo(np.int64).max)
    low = np.append(owner, np.iinfo(np.int64).max)
    out = [np.full(max(0, len(w) - window + 1), np.iinfo(np.int64).max) for w in words]
    sizes = np.array([len(w) for w in words])
    for col, lane, length, lo, hi, width in index.matching_statistics(lanes):
        hit = length >= window
        if hit.any():
            span = np.stack([lo[hit], hi[hit]], axis=1).ravel()
            least = np.minimum.reduceat(low, span)[::2]
            for i, p, o in zip(lane[hit].tolist(), (col - (width - sizes[lane[hit]])).tolist(), least.tolist()):
                out[i][p] = o
    return out


def search_shards(dealt: DataFrame, window: int, keep: str, shards: int) -> DataFrame:
    """Index and search each shard's segments: (``keep``, at, count, first) for runs of windows with one first owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {"id": [], "owner": [], "words": []}
        shard = None

        def close() -> Iterator[pa.RecordBatch]:
            if held["id"]:
                found = first_owners(held["words"], np.array(held["owner"], np.int64), window)
                ids, at, count, first = [], [], [], []
                for seg, owner in zip(held["id"], found):
                    a, c = runs(owner)
                    ids += [seg] * len(a)
                    at += a.tolist()
                    count += c.tolist()
                    first += owner[a].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()),
                                                  pa.array(count, pa.int32()), pa.array(first, pa.int64())], [keep, "at", "count", "first"])
            for v in held.values():
                v.clear()

        for batch in batches:
            for s, i, o, w in zip(*(batch.column(c).to_pylist() for c in ("shard", keep, "owner", "words"))):
                if s != shard:
                    yield from close()
                    shard = s
                held["id"].append(i)
                held["owner"].append(o)
                held["words"].append(w)
        yield from close()

    # rows of one shard lie together in one partition
    return (dealt.select("shard", keep, "owner", "words").repartition(shards, "shard").sortWithinPartitions("shard", keep)
            .mapInArrow(run, f"{keep} long, at int, count int, first long"))


def repeated_intervals(docs: DataFrame, window: int, anchor: int, hot_segments: int, shard_words: int) -> DataFrame:
    """(doc_id, row, cuts): word intervals ``[at, at + count)`` of each document that an earlier one has."""
    marked = written(document_anchors(docs, window, anchor), "anchors")
    shared = marked.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    held = marked.join(shared, "anchor").groupBy("doc_id", "row").agg(F.collect_list("anchor").alias("anchors"))
    segs = written(segments(docs.join(held, ["doc_id", "row"]), window, anchor), "segments")
    discard(marked)
    own = segs.groupBy("seg").agg(F.min("doc_id").alias("owner"), F.min("anchor").alias("anchor"), F.first("words").alias("words"))
    own = written(own, "own-segments")
    groups = own.groupBy("anchor").agg(F.count("*").alias("n"))
    hot = groups.where(F.col("n") > hot_segments).select("anchor")
    size = own.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0]
    shards = max(1, int(size / 6 / shard_words) + 1)  # a word is about six bytes
    shard = F.expr(f"cast(pmod(xxhash64(%s), {shards}) as int)".replace("%s", "anchor"))
    plain = search_shards(own.join(groups.where((F.col("n") > 1) & (F.col("n") <= hot_segments)).select("anchor"), "anchor")
                          .withColumn("shard", shard), window, "seg", shards)
    # hot anchors: window by window
    pieces = segment_windows(own.join(hot, "anchor"), window)
    counted = pieces.groupBy("piece").agg(F.min("owner").alias("owner"), F.count("*").alias("n"), F.first("words").alias("words")).where("n > 1")
    single = search_shards(counted.withColumn("shard", F.expr(f"cast(pmod(xxhash64(piece), {shards}) as int)")), window, "piece", shards)
    back = (pieces.select("piece", "seg", F.col("at").alias("offset"))
            .join(single, "piece").select("seg", F.col("offset").alias("at"), "count", "first"))
    # a segment that alone has its anchor repeats only as a whole
    alone = own.join(groups.where("n = 1").select("anchor"), "anchor")
    whole = segs.select("seg", "windows").distinct()
    lone = alone.join(whole, "seg").select("seg", F.lit(0).alias("at"), F.col("windows").alias("count"), F.col("owner").alias("first"))
    whole_hot = own.join(hot, "anchor").join(whole, "seg").select("seg", F.lit(0).alias("at"), F.col("windows").alias("count"), F.col("owner").alias("first"))
    found = plain.unionByName(back).unionByName(lone).unionByName(whole_hot)
    cuts = (segs.select("seg", "doc_id", "row", "start").join(found, "seg").where("first < doc_id")
            .groupBy("doc_id", "row").agg(F.collect_list(F.struct((F.col("start") + F.col("at")).alias("at"),
                                                                  (F.col("count") + window - 1).alias("count"))).alias("cuts")))
    # written, so that the segments and their shuffles are gone before the documents move
    cuts = written(cuts, "cuts")
    del plain, pieces, counted, single, back, alone, lone, whole_hot, found
    discard(segs, own)
    return cuts


def cut_words(docs: DataFrame, names: list[str], cuts_column: str) -> DataFrame:
    """``names`` of ``docs`` with n_words, n_removed and kept_text, the words outside the intervals of ``cuts_column``."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in sliced(batch, text="text"):
            n, gone, kept = [], [], []
            for text, cuts in zip(part.column("text").to_pylist(), part.column(cuts_column).to_pylist()):
                words = byte_words(text)
                n.append(len(words))
                if cuts:
                    keep = np.ones(len(words), bool)
                    for c in cuts:
                        keep[c["at"]: c["at"] + c["count"]] = False
                    gone.append(len(words) - int(keep.sum()))
                    words = [words[i] for i in np.flatnonzero(keep)]
                else:
                    gone.append(0)
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield {**{c: part.column(c) for c in names}, "n_words": n, "n_removed": gone, "kept_text": kept}

    types = dict(docs.dtypes)
    return mapped(docs, run, ", ".join(f"`{c}` {types[c]}" for c in names) + ", n_words long, n_removed long, kept_text string")


def substring_dedup(docs: DataFrame, window: int = 50, anchor: int = ANCHOR, hot_segments: int = HOT_SEGMENTS,
                    shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (kept words joined by one space)."""
    names = carried(docs, ["n_words", "n_removed", "kept_text"])
    docs = docs.select(*names)
    text, number = F.col("text").cast("string"), F.col("doc_id").cast("long")
    plain = docs.where("doc_id is not null").select(number.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row"))
    found = repeated_intervals(plain, window, min(anchor, window), hot_segments, shard_words)
    a, b, cuts = (unused(docs, c) for c in ("cut_doc", "cut_row", "cuts"))
    found = found.select(F.col("doc_id").alias(a), F.col("row").alias(b), F.col("cuts").alias(cuts))
    joined = docs.join(found, (number == F.col(a)) & (F.xxhash64(text) == F.col(b)), "left")
    return cut_words(joined.select(*names, cuts), names, cuts)
