"""Best-fit packing: bound-certified repacking of token pieces into sequences of fixed capacity.

Documents are tokenized (ids of the tokenizers library, then an end id) and only
those longer than the capacity are cut.  The pieces are dealt to groups; each
group packs its pieces by best-fit decreasing and computes lower bounds on its
number of sequences from dual-feasible functions of its lengths.  Where the bound
is met the group is *certified*: nothing can be better, and all its sequences are
final but the emptiest.  A group with a gap keeps only what is exactly full.
What is left of all groups is exchanged - dealt anew - and packed again, until a
single group remains or ``rounds`` are over.

The number of groups follows the number of pieces, so no task or driver sees more
than about ``group_pieces`` of them.

Null text is an empty document (the end id alone).  Empty documents, repeated
rows and repeated ids are packed like any other.  An empty table gives an empty
result.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.llm.bpe import LETTER, NUMBER, SPACE, byte_letters
from rentlens.llm.common import discard, mapped, sliced, written

CACHE_WORDS = 1_000_000
GROUP_PIECES = 40_000


#: Text of which lower-casing and the tokenizer's splitting are known here; other text is encoded run by run.
UNUSUAL = re.compile("[^\x00-\u012f\u0131-\u017f\u2010-\u2027]")
#: The tokenizer's words in lower-cased usual text; white space falls away.
WORDS = re.compile(f"'(?:[stmd]|re|ve|ll)|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")


class WordIds:
    """Ids of a lower-casing tokenizer that drops white space: each different word is encoded once and kept."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = {k: pack("<I", i) for k, i in special.items()}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # the same merges alone, for words that are split and lower-cased already
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Tokenizer.from_str(json.dumps({**spec, "normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}))
        self._letters = {b: c for c, b in byte_letters().items()}
        self.known: dict[str, bytes] = {}

    def _coded(self, words: list[str], whole: bool) -> dict[str, bytes]:
        out = {}
        for i in range(0, len(words), 20_000):
            some = words[i: i + 20_000]
            if whole:
                coded = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            else:
                coded = self.merges.encode_batch_fast([w.encode().decode("latin-1").translate(self._letters) for w in some], add_special_tokens=False)
            for w, e in zip(some, coded):
                ids = e.ids
                out[w] = pack(f"<{len(ids)}I", *ids)
        return out

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit values."""
        found, split, runs = [], set(), set()
        for t in texts:
            parts = [t or ""] if self._cut is None or not t else self._cut.split(t)
            for i in range(0, len(parts), 2):
                if UNUSUAL.search(parts[i]):
                    parts[i] = [w.decode() for w in parts[i].encode().split()]  # between ASCII spaces nothing joins
                    runs.update(parts[i])
                else:
                    parts[i] = WORDS.findall(parts[i].lower())
                    split.update(parts[i])
            found.append(parts)
        known = self.known
        split -= known.keys()
        runs -= known.keys()
        fresh = self._coded(list(split - runs), False) | self._coded(list(runs), True)
        if len(known) + len(fresh) > CACHE_WORDS:  # the old entries still serve this batch
            self.known, known = fresh, {**known, **fresh}
        else:
            known.update(fresh)
        for parts in found:
            yield b"".join([b"".join(map(known.__getitem__, p)) if isinstance(p, list) else self.special[p] for p in parts])


_WORDS: dict[str, WordIds] = {}


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    end = pack("<I", end_id)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        if vocabulary not in _WORDS:
            _WORDS[vocabulary] = WordIds(vocabulary)
        coder = _WORDS[vocabulary]
        for part in sliced(batch, text="text"):
            out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, ids in zip(part.column("doc_id").to_pylist(), coder.ids(part.column("text").to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    body = ids[at: at + 4 * capacity]
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(at // 4)
                    out["length"].append(len(body) // 4)
                    out["ids_crc32"].append(zlib.crc32(body))
            yield out

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run,
                  "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the room left in each bin; equal lengths go in their order."""
    order, capacity = np.argsort(-lengths, kind="stable"), int(capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room
    rooms, some = [], 0  # bit r of ``some``: a bin with room r is open
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                some &= ~(1 << room)
        else:
            room, b = capacity, len(rooms)
            rooms.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        rooms[b] = room - n
        open_bins[room - n].append(b)
        some |= 1 << (room - n)
    return bins, offsets, np.array(rooms, np.int64)


def fewest_bins(lengths: np.ndarray, capacity: int) -> int:
    """Largest lower bound on the bins from dual-feasible functions.

    A function f with f(x1) + ... <= C whenever x1 + ... <= C keeps every packing
    feasible, so the sum of f over the items, divided by C, bounds the bins from below.
    """
    count = np.bincount(lengths, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    # large items rounded up to a whole bin, as no item under the threshold e counts
    total, rest = np.cumsum(count * x), np.cumsum(count)
    e = np.arange(1, capacity // 2 + 1)
    middle = total[capacity - e] - total[e - 1]
    large = rest[capacity] - rest[capacity - e]
    best = max(best, int(np.max(large - (-middle // capacity), initial=0)))
    # items rounded to multiples of C / k
    for k in range(1, 21):
        whole = (k + 1) * x % capacity == 0
        scaled = np.where(whole, x * k, (k + 1) * x // capacity * capacity)  # in units of 1 / k
        best = max(best, -(-int((count * scaled).sum()) // (k * capacity)))
    return best


def pack_round(active: DataFrame, capacity: int, groups: int, number: int, last: bool) -> DataFrame:
    """One round: ``active`` dealt to groups and packed; ``final`` marks the sequences that stay."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable")
        lengths = pdf["length"].to_numpy()
        bins, offsets, rooms = best_fit_decreasing(lengths, capacity)
        certified = len(rooms) == fewest_bins(lengths, capacity)
        stays = rooms == 0
        if certified:
            stays = np.ones(len(rooms), bool)
            if rooms.max(initial=0) > 0:
                stays[int(rooms.argmax())] = False
        if last:
            stays[:] = True
        group = int(pdf["group"].iloc[0])
        return pdf.assign(sequence_id=(number << 52) + (group << 22) + bins, offset=offsets, final=stays[bins])[list(PACKED)]

    dealt = active.select(*PACKED[:6]).withColumn("group", F.expr(f"cast(pmod(xxhash64(item, {number}), {groups}) as long)"))
    return dealt.groupBy("group").applyInPandas(
        pack, "item long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, final boolean")


PACKED = ("item", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "final")


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1,
                     group_pieces: int = GROUP_PIECES, rounds: int = 12) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = token_pieces(docs, vocabulary, capacity, end_id)
    active = written(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    done, n = [], active.count()
    for number in range(rounds):
        groups = max(1, -(-n // group_pieces))
        last = groups == 1 or number == rounds - 1
        packed = written(pack_round(active, capacity, groups, number, last), "packed")
        discard(active)
        done.append(packed.where("final"))
        active = packed.where("not final")
        if last or not (n := active.count()):
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("item", "final")
