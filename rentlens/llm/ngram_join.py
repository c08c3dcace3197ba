"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

A document's set holds its distinct word n-grams (words ``[^\\x20\\x09-\\x0D]+``,
A-Z lower-cased) as 64-bit hashes; a document with fewer words than ``n`` has
its whole sequence as its one member.  Two documents link when
``100 * |x & y| >= percent * |x | y|``; the join is exact and complete.

1. Equal sets are one class, named by its smallest doc_id.
2. *Blocks.*  In one global order of the members every linked pair shares a
   member of both prefixes (``|x| - ceil(t |x|) + 1`` members).  The order puts
   members that a single class has first, then rare before frequent, so a common
   line or passage is at the end, outside the prefixes.  Frequencies are counted
   over all documents.  Classes that share prefix members form blocks.  Members are told apart by ``KEY_BITS`` bits
   of their hashes: far more than there are members, as each chance meeting of two would join two blocks.
   Chains of unlike classes can still make a large block.  One of more than ``tile_rows`` classes is parted by
   step 4's bound alone, on bitmaps without the sets: what the bound leaves keeps every linked pair together, and
   classes that have no possible partner drop out.
3. *Tiles.*  A block of more than ``tile_rows`` classes is cut into size bands
   (a band's largest set is 1/t times its smallest; only a band and the next can
   hold partners) and a band into hash parts, so no task holds more than two
   parts.  Before that the classes of a band of more than ``tile_rows`` are tested
   against a few hubs of it: a group of near copies, however large, becomes one
   star in linear work, and pairs inside the block's largest star (its giant) need
   no tile.
4. In a tile, the bits in which two parity bitmaps differ bound the symmetric
   difference from below and so the overlap from above; what the bound leaves
   is decided by intersecting the sorted arrays.  Pairs that are connected
   already need no test, so a tile returns a forest, never all pairs.
5. Connected components over all tiles' forests.

Nulls and empties: null or wordless text is an empty set and links with
nothing; a null doc_id links with nothing and keeps a null component_id.
Repeated rows of one doc_id are one document in the graph.  An empty table
gives an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentlens.llm.common import (Forest, byte_words, components, discard, free_shuffles, gram_hashes, list_array,
                                 mapped, sliced, word_hashes, written)

#: The share of the hash space whose members are counted, as a multiple of a prefix's share of a set; the rest of a
#: prefix, if any, goes by hash alone.  A larger region lets more sets fill their prefix with members of their own.
REGION = 1.4
#: Leading bits of a hash that tell members apart in the counts.
KEY_BITS = 48
#: Bits of a parity bitmap, at least.
BITMAP = 1024
#: Classes in one part of a tile.
TILE_ROWS = 3000
#: Times as many have a part where only bitmaps are compared.
BITMAP_PARTS = 5


def member_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of one text."""
    words = byte_words(text.translate(_LOWER)) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    return np.unique(gram_hashes(h, n)) if len(h) >= n else gram_hashes(h, len(h))


_LOWER = {c: c + 32 for c in range(65, 91)}


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def region(percent: int) -> int:
    """First key outside the counted region."""
    return int(min(1.0, REGION * (100 - percent) / 100) * 2**KEY_BITS)


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, size, set_hash, the members that can be in the prefix (``keys``, the first by hash), and a bitmap of at least a bit a member."""
    shift = np.uint64(64 - KEY_BITS)
    edge = region(percent) << (64 - KEY_BITS)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in sliced(batch, text="text"):
            sizes, hashes, keys, counts, bits = [], [], [], [], []
            for text in part.column("text").to_pylist():
                s = member_set(text, n)
                inside = len(s) if edge >> 64 else int(np.searchsorted(s, np.uint64(edge)))
                need = max(inside, prefix_length(len(s), percent)) if len(s) else 0
                keys.append((s[:need] >> shift).astype(np.int64))
                bits.append(parity_bitmap(s, max(BITMAP, 1 << (len(s) - 1).bit_length())).tobytes() if len(s) else b"")
                counts.append(need)
                sizes.append(len(s))
                hashes.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
            yield {"doc_id": part.column("doc_id"), "size": sizes, "set_hash": hashes,
                   "keys": list_array(np.concatenate(keys) if keys else np.empty(0, np.int64), counts, pa.int64()), "bits": bits}

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
                  run, "doc_id long, size long, set_hash long, keys array<long>, bits binary")


def blocks(classes: DataFrame, percent: int) -> DataFrame:
    """(doc_id, block) of every class that may have a partner."""
    rows = classes.select("doc_id", F.explode("keys").alias("key"))
    # (two members of one set with one key count as two; that only makes the key a candidate)
    live = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    held = rows.join(live, "key").groupBy("doc_id").agg(F.collect_list(F.struct(
        # members outside the counted region come last, by hash alone
        _outside("key", percent).alias("out"), F.when(_outside("key", percent), F.lit(0)).otherwise(F.col("n")).alias("n"), "key")).alias("live"))
    # members that only this class has come first in the order and fill its prefix
    sized = classes.select("doc_id", "size", F.size("keys").alias("given"))
    room = F.expr(f"size - ceil({percent} * size / 100) + 1 - (given - size(live))").cast("int")
    first = (held.join(sized, "doc_id").withColumn("room", room).where("room > 0")
             .select("doc_id", F.explode(F.slice(F.array_sort("live"), 1, F.col("room"))).alias("x"))
             .select("doc_id", F.col("x.key").alias("key")))
    first = written(first, "ngram-prefix")
    hub = first.groupBy("key").agg(F.min("doc_id").alias("hub"))
    linked = components(first.join(hub, "key").where("doc_id <> hub").select("doc_id", "hub").distinct(), "doc_id", "hub")
    discard(first)
    return linked.select(F.col("node").alias("doc_id"), F.col("component").alias("block"))


def _outside(key: str, percent: int):
    return F.col(key) >= F.lit(region(percent))


def size_band(percent: int):
    """Partners are in one band or in two neighbouring ones."""
    return F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / percent)) + F.lit(1e-9)).cast("int")


def parted(large: DataFrame, bitmaps: DataFrame, percent: int, rows: int) -> DataFrame:
    """(doc_id, block): the classes of ``large`` (doc_id, block, size) that may have a partner by the bitmaps, in smaller blocks.

    The tiles hold no sets, so a class that goes to many costs little.
    """
    dealt = tiles(large, large.select("doc_id").where("false"), percent, rows, 0).join(bitmaps, ["doc_id", "size"])
    linked = components(forest_edges(dealt, percent, exact=False), "a", "b")
    return linked.select(F.col("node").alias("doc_id"), F.col("component").alias("block"))


def hub_links(large: DataFrame, arrays: DataFrame, percent: int, hubs: int = 3) -> DataFrame:
    """(a, b): links between the classes of ``large`` (doc_id, block, size, band) and a few *hubs* of their band.

    Linear in the band: it joins a group of near copies, however large, to a star.
    """
    order = Window.partitionBy("block", "band").orderBy(F.xxhash64("doc_id"), "doc_id")
    some = large.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= hubs)
    some = some.join(arrays, ["doc_id", "size"]).select("block", "band", F.col("doc_id").alias("hub"), F.col("members").alias("hub_members"))
    pairs = large.join(arrays, ["doc_id", "size"]).join(some, ["block", "band"]).where("doc_id <> hub")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in sliced(batch):
            a, b = [], []
            for doc, hub, x, y in zip(*(part.column(c).to_pylist() for c in ("doc_id", "hub", "members", "hub_members"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                o = overlap(x, y)
                if 100 * o >= percent * (len(x) + len(y) - o):
                    a.append(doc)
                    b.append(hub)
            yield {"a": a, "b": b}

    return mapped(pairs.select("doc_id", "hub", "members", "hub_members"), run, "a long, b long")


def tiles(members: DataFrame, giants: DataFrame, percent: int, tile_rows: int, whole: int | None = None) -> DataFrame:
    """members (doc_id, block, size) with the tiles each goes to: ``block, t1, p1, t2, p2`` and ``left``.

    A cell is a band of a block, apart for its *giant* (the classes that hub links
    join to the block's largest component) and the rest; a cell of many classes
    has hashed parts.  A tile is a pair of parts of cells that can hold partners:
    equal or neighbouring bands, not both giant.  So a giant goes to as many tiles
    as the rest has parts, and a pair that is connected already to none.  A block of at most ``whole`` classes
    (``tile_rows`` by default) is one cell.
    """
    total = members.groupBy("block").agg(F.count("*").alias("total"))
    m = members.join(total, "block").join(giants.select("doc_id", F.lit(1).alias("giant")), "doc_id", "left")
    cell = F.when(F.col("total") <= (tile_rows if whole is None else whole), F.lit(0)).otherwise(2 * size_band(percent) + F.coalesce("giant", F.lit(0)))
    m = m.withColumn("cell", cell)
    sizes = m.groupBy("block", "cell").agg(F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias("parts"))
    # a block has at most two cells a band, and bands grow with the logarithm of the size
    cells = sizes.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("cell", "parts"))).alias("parts"))
    m = m.join(cells, "block").withColumn("part", F.expr("cast(pmod(xxhash64(doc_id), parts[cell]) as int)"))
    # cells of this band and its neighbours: the rests, and the giants unless this is one
    near = "filter(if(cell % 2 = 1, array(cell - 3, cell - 1, cell + 1), array(cell - 2, cell - 1, cell, cell + 1, cell + 2, cell + 3)), c -> parts[c] is not null)"
    pair = ("case when c = cell then named_struct('t1', cell, 'p1', least(part, q), 't2', cell, 'p2', greatest(part, q)) "
            "when c > cell then named_struct('t1', cell, 'p1', part, 't2', c, 'p2', q) else named_struct('t1', c, 'p1', q, 't2', cell, 'p2', part) end")
    m = m.withColumn("at", F.explode(F.expr(f"flatten(transform({near}, c -> transform(sequence(0, parts[c] - 1), q -> {pair})))")))
    return m.select("doc_id", "block", "size", "at.t1", "at.p1", "at.t2", "at.p2", F.expr("cell = at.t1 and part = at.p1").alias("left"))


def member_arrays(docs: DataFrame, n: int) -> DataFrame:
    """doc_id and its sorted members as little-endian 64-bit values, with the parity bitmap."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in sliced(batch, rows=500, text="text"):
            sets = [member_set(t, n) for t in part.column("text").to_pylist()]
            yield {"doc_id": part.column("doc_id"), "members": [s.tobytes() for s in sets],
                   "bits": [parity_bitmap(s).tobytes() for s in sets]}

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, members binary, bits binary")


def parity_bitmap(s: np.ndarray, bits: int = BITMAP) -> np.ndarray:
    """One bit per hash cell: whether an odd number of members falls there (``bits``: a power of two)."""
    odd = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).view(np.uint64)


def alike(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all of the fewest bits that one has: cells that fall together have the parity of their sum."""
    width = min(map(len, bitmaps)) // 8
    return np.array([np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, width), axis=0) for b in bitmaps])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a)) if len(a) else 0


def differing(words: np.ndarray, i: int, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Those of ``j`` whose bitmap (a column of ``words``) differs from that of ``i`` in at most ``most`` bits, which is given for each."""
    n = np.zeros(len(j), np.int64)
    for k in range(0, len(words), 4):
        for row in words[k: k + 4]:
            n += np.bitwise_count(row[j] ^ row[i])
        few = n <= most
        j, n, most = j[few], n[few], most[few]
    return j


def tile_links(ids: np.ndarray, sets: list[np.ndarray] | None, bits: np.ndarray, left: np.ndarray, right: np.ndarray,
               percent: int, joined: np.ndarray | None = None, size: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links of one tile; a pair is tested if one is in ``left`` and the other in ``right``.

    Classes of ``joined`` are known to be one component.  Without ``sets``, of which the ``size`` is given then, each pair that the
    bitmaps leave counts as a link.
    """
    if sets is not None:
        size = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((ids, size))
    ids, size, words, left, right = ids[order], size[order], np.ascontiguousarray(bits[order].T), left[order], right[order]
    forest, out = Forest(len(ids)), []
    if joined is not None:
        known = np.flatnonzero(joined[order])
        for k in known[1:]:
            forest.join(int(known[0]), int(k))
    for i in range(len(ids)):
        # sorted by size: partners above i end where 100 * size_i < percent * size_j
        end = int(np.searchsorted(size, 100 * size[i] // percent, side="right"))
        if end <= i + 1:
            continue
        roots = forest.roots()
        j = np.arange(i + 1, end)
        j = j[(roots[j] != roots[i]) & ((left[i] & right[j]) | (right[i] & left[j]))]
        if not len(j):
            continue
        # the overlap is at most half of what the bits that differ leave: 100 * o >= percent * (both - o) needs o >= least
        both = size[j] + size[i]
        least = -(-percent * both // (100 + percent))
        j = differing(words, i, j, both - 2 * least)
        seen_root = forest.root(i)
        for k in j:
            if forest.root(int(k)) == seen_root:
                continue
            if sets is not None:
                o = overlap(sets[order[i]], sets[order[int(k)]])
                if 100 * o < percent * (size[i] + size[k] - o):
                    continue
            forest.join(i, int(k))
            seen_root = forest.root(i)
            out.append((int(ids[i]), int(ids[k])))
    return out


def forest_edges(dealt: DataFrame, percent: int, exact: bool = True) -> DataFrame:
    """(a, b) links found in the tiles; rows of a tile lie together, sorted.  If not ``exact``, by the bitmaps alone."""
    value = "members" if exact else "size"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                left, right = (np.array([h[k] for h in held]) for k in (3, 4))
                giant = left & (key[1] % 2 == 1) | right & (key[3] % 2 == 1)
                sets = [np.frombuffer(h[1], np.uint64) for h in held] if exact else None
                size = None if exact else np.array([h[1] for h in held], np.int64)
                links = tile_links(np.array([h[0] for h in held], np.int64), sets, alike([h[2] for h in held]), left, right, percent, giant, size)
                if links:
                    a, b = zip(*links)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            names = ("block", "t1", "p1", "t2", "p2")
            for row in zip(*(batch.column(c).to_pylist() for c in (*names, "doc_id", value, "bits", "left"))):
                if row[:5] != key:
                    yield from close()
                    held.clear()
                    key = row[:5]
                same = key[1:3] == key[3:5]
                held.append((row[5], row[6], row[7], row[8] or same, (not row[8]) or same))
        yield from close()

    keys = ["block", "t1", "p1", "t2", "p2"]
    return (dealt.repartition(*keys).sortWithinPartitions(*keys, "doc_id")
            .select(*keys, "doc_id", value, "bits", "left").mapInArrow(run, "a long, b long"))


def first_ids(signed: DataFrame) -> DataFrame:
    """(set_hash, size, first): the smallest doc_id of each class."""
    return signed.where("size > 0 and doc_id is not null").groupBy("set_hash", "size").agg(F.min("doc_id").alias("first"))


def ngram_jaccard_join(docs: DataFrame, n: int = 4, percent: int = 85, tile_rows: int = TILE_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    full = written(signatures(docs, n, percent), "ngram-sets")
    signed = written(full.select("doc_id", "size", "set_hash"), "ngram-sizes")
    firsts = first_ids(signed)
    classes = full.join(firsts.select(F.col("first").alias("doc_id"), "set_hash"), ["doc_id", "set_hash"]).dropDuplicates(["doc_id", "set_hash"])
    classes = written(classes, "ngram-classes")
    # each table goes as soon as it is not read any more: keys, bitmaps and members never lie on disk together
    discard(full)
    found = written(blocks(classes, percent), "ngram-blocks")
    # a doc_id with several texts has a set for each; its blocks are the same
    need = found.join(firsts, found.doc_id == firsts["first"]).select("doc_id", "block", "size").distinct()
    large = need.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > tile_rows).select("block")
    if not large.isEmpty():
        of_large = written(need.join(large, "block", "left_semi"), "ngram-large")
        bitmaps = classes.select("doc_id", "size", "bits").join(of_large.select("doc_id").distinct(), "doc_id", "left_semi")
        fine = parted(of_large, bitmaps, percent, BITMAP_PARTS * tile_rows)
        coarse, found = found, written(found.join(large, "block", "left_anti").select("doc_id", "block").unionByName(fine), "ngram-blocks")
        del fine, bitmaps
        discard(coarse, of_large)
        need = found.join(firsts, found.doc_id == firsts["first"]).select("doc_id", "block", "size").distinct()
    del large
    discard(classes)
    arrays = member_arrays(docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi"), n)
    arrays = written(arrays.withColumn("size", (F.length("members") / 8).cast("long")).dropDuplicates(["doc_id", "members"]), "ngram-members")
    free_shuffles(docs.sparkSession)  # those of the texts
    banded = need.withColumn("band", size_band(percent))
    hot = banded.groupBy("block", "band").agg(F.count("*").alias("n")).where(F.col("n") > tile_rows).select("block", "band")
    stars = giants = None
    if not hot.isEmpty():
        stars = written(hub_links(banded.join(hot, ["block", "band"], "left_semi"), arrays, percent), "hub-links")
        joined = components(stars, "a", "b").join(found.withColumnRenamed("doc_id", "node"), "node")
        largest = joined.groupBy("block", "component").agg(F.count("*").alias("n")).groupBy("block").agg(
            F.max(F.struct("n", "component")).alias("x")).select("block", F.col("x.component").alias("component"))
        giants = joined.join(largest, ["block", "component"]).select(F.col("node").alias("doc_id"))
    dealt = tiles(need, giants if giants is not None else found.select("doc_id").where("false"), percent, tile_rows).join(arrays, ["doc_id", "size"])
    edges = forest_edges(dealt, percent)
    linked = components(edges.unionByName(stars) if stars is not None else edges, "a", "b")
    del edges, dealt
    discard(arrays, found, *([] if stars is None else [stars]))
    named = signed.join(firsts, ["set_hash", "size"], "left")
    named = named.join(linked, F.coalesce(F.col("first"), F.col("doc_id")) == F.col("node"), "left")
    return named.select("doc_id", F.col("size").alias("n_shingles"),
                        F.when(F.col("size") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.coalesce("component", "first"))
                        .alias("component_id"))
