"""Spelling variant grouping by reduced-alphabet generation.

A word is near another that differs from it by exactly one inserted, deleted or
replaced code point; its form is its commonest near word, if that is common
enough, and its root what its forms lead to.

Letters are hashed to a few symbols.  Two near words have reduced words that are
equal or one edit apart, so every distinct reduced word's full one-edit
neighbourhood (itself, all deletions, replacements and insertions over the few
symbols) is generated and joined to the reduced vocabulary; the words of the pairs
found are then compared letter by letter.  A neighbourhood's strings are never
made: their hashes follow from those of a word's beginnings and endings, a batch
of words at a time.  They are dealt to buckets by hash, 8 bytes each, and looked
up there in the sorted hashes of the bucket's reduced words; a hash that meets
another by chance costs a comparison, no more.

The number of symbols grows with the vocabulary, so that the shortest words have
as many reduced forms as there are words and few words share one; it does not
change the result.  A reduced word has a bounded number of neighbours, which keeps
buckets even; their number follows from the number of hashes.  The words of a
reduced word that many share are joined row by row, where AQE splits them.

Words are the maximal runs of the letters given, lower-cased by A-Z only, each
occurrence with the code point dropped that its document's hash names (see
``words``).  A null text has none; a null id counts as an empty one; very long
runs are words like others, their neighbourhoods made in slices; repeated rows
count again; of equally common near words the smallest in code-point order is the
form.  Without words the result is empty.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.llm.common import BASE, discard, list_array, mapped, mix, sliced, written

#: Letters of a word: a-z and U+00C0 to U+00FF (A-Z are lower-cased).
LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hashes to a bucket on the average, and at most so many at once in a task that makes them.
BUCKET, AT_ONCE = 1 << 21, 1 << 20
#: Symbols of the reduced alphabet, so that each is one character.
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-_"


def words(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shortest: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """(word, n): distinct words of at least ``shortest`` code points and ``least`` occurrences.

    h is the crc32 of ``<id>:<run>``; where ``every`` divides it, the run's code point h % length goes.
    Deleting makes no run longer, so shorter runs are not even taken out of the text.
    """
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit("[A-Za-zÀ-ÿ]{%d,}" % shortest), F.lit(0)))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), run.alias("run"))
    found = found.select("_id", F.translate("run", UPPER, LOWER).alias("run"))
    found = found.select("run", F.crc32(F.concat("_id", F.lit(":"), "run")).alias("h"), F.char_length("run").alias("size"))
    drop = F.expr("concat(substring(run, 1, cast(h % size as int)), substring(run, cast(h % size as int) + 2))")
    word = F.when(F.col("h") % every == 0, drop).otherwise(F.col("run"))
    return (found.select(word.alias("word")).where(F.char_length("word") >= shortest)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least))


def symbols(k: int) -> str:
    """The symbol of each of ``LETTERS``: a hash of the letter, one of ``k``."""
    hashed = mix(np.array(LETTERS, np.uint64) * np.uint64(BASE))
    return "".join(SYMBOLS[int(h % np.uint64(k))] for h in hashed)


def neighbour_hashes(reduced: np.ndarray, k: int):
    """(row, hash) arrays, in slices, of the one-edit neighbourhoods of words of equal length.

    ``reduced`` has a word's symbol numbers in each row.  Of edits that give the same string
    only one is made: the first deletion in a run of equal symbols, no replacement by the
    symbol itself, and no insertion before an equal symbol.
    """
    n, size = reduced.shape
    base = np.uint64(BASE)
    value = mix((np.arange(k, dtype=np.uint64) + np.uint64(1)) * base)
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size + 1, base, np.uint64))])
    x = value[reduced]
    before = np.zeros((n, size + 1), np.uint64)  # hash of the first i symbols
    for i in range(size):
        before[:, i + 1] = before[:, i] * base + x[:, i]
    after = np.zeros((n, size + 1), np.uint64)   # value of the symbols from i on
    after[:, :size] = np.cumsum((x * powers[size - 1::-1][:size])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    every = np.arange(n)
    yield every, mix(after[:, 0])
    step = max(1, AT_ONCE // (2 * k * n))
    for at in range(0, size + 1, step):
        i = np.arange(at, min(at + step, size + 1))
        inner = i[i < size]
        if len(inner):
            gone = before[:, inner] * powers[size - 1 - inner] + after[:, inner + 1]
            fresh = np.ones(gone.shape, bool)
            later = inner > 0
            fresh[:, later] = reduced[:, inner[later]] != reduced[:, inner[later] - 1]
            row, col = np.nonzero(fresh)
            yield row, mix(gone[row, col])
            put = (before[:, inner] * powers[size - inner] + after[:, inner + 1])[:, :, None] + powers[size - 1 - inner][:, None] * value
            row, col, c = np.nonzero(reduced[:, inner][:, :, None] != np.arange(k))
            yield row, mix(put[row, col, c])
        put = (before[:, i] * powers[size + 1 - i] + after[:, i])[:, :, None] + powers[size - i][:, None] * value
        ahead = np.full((n, len(i)), -1)
        ahead[:, : len(inner)] = reduced[:, inner]
        row, col, c = np.nonzero(ahead[:, :, None] != np.arange(k))
        yield row, mix(put[row, col, c])


def dealt(vocabulary: DataFrame, k: int, buckets: int) -> DataFrame:
    """(bucket, own, base, places, keys): hashes of reduced words (``own``) and of their neighbourhoods.

    ``base`` + place is a reduced word's number, and a key the hash's low half; the bucket is from the high half.
    """
    number = np.full(128, -1, np.int64)
    number[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))

    def rows(batch: pa.RecordBatch):
        for some in sliced(batch, rows=20_000, text="reduced"):
            ids = some.column("rid").to_numpy()
            data = some.column("reduced").cast(pa.binary()).to_pylist()
            sizes = np.array([len(b) for b in data])
            high = ids >> 31
            for size, top in set(zip(sizes.tolist(), high.tolist())):
                at = np.flatnonzero((sizes == size) & (high == top))
                chunk = max(1, AT_ONCE // (2 * (size + 1) * k))
                for first in range(0, len(at), chunk):
                    mine = at[first:first + chunk]
                    reduced = number[np.frombuffer(b"".join(data[j] for j in mine), np.uint8)].reshape(len(mine), size)
                    place = (ids[mine] - (top << 31)).astype(np.int32)
                    for part, (row, key) in enumerate(neighbour_hashes(reduced, k)):
                        # the word itself comes first: a neighbour of its own, and what neighbours are looked up in
                        for own in ((True, False) if part == 0 else (False,)):
                            yield own, top << 31, place[row], key

    def run(batch: pa.RecordBatch):
        held: list = []
        total = 0

        def out():
            merged: dict = {}
            for own, base, place, key in held:
                merged.setdefault((own, base), []).append((place, key))
            for (own, base), some in merged.items():
                place, key = (np.concatenate(c) for c in zip(*some))
                bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                place, low, bucket = place[order], (key[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), bucket[order]
                which, counts = np.unique(bucket, return_counts=True)
                yield {"bucket": pa.array(which, pa.int64()), "own": pa.array([own] * len(which)), "base": pa.array([base] * len(which), pa.int64()),
                       "places": list_array(place, counts, pa.int32()), "keys": list_array(low, counts, pa.int32())}

        for part in rows(batch):
            held.append(part)
            total += len(part[3])
            if total >= AT_ONCE:
                yield from out()
                held, total = [], 0
        if held:
            yield from out()

    return mapped(vocabulary, run, "bucket long, own boolean, base long, places array<int>, keys array<int>")


def looked_up(group: pa.Table) -> pa.Table:
    """(rid, other): a reduced word and one whose hash is among its neighbours', of one bucket."""
    own = group.column("own").to_numpy()

    def flat(mine: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        if not mine.num_rows:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        counts = mine.column("keys").combine_chunks().value_lengths().to_numpy()
        places = mine.column("places").combine_chunks().flatten().to_numpy()
        return np.repeat(mine.column("base").to_numpy(), counts) + places, mine.column("keys").combine_chunks().flatten().to_numpy()

    other, known = flat(group.filter(pa.array(own)))
    rid, keys = flat(group.filter(pa.array(~own)))
    order = np.argsort(known, kind="stable")
    other, known = other[order], known[order]
    low, high = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
    hit = np.flatnonzero(high > low)
    many = high[hit] - low[hit]
    at = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(hit) else np.empty(0, np.int64)
    found = pd.DataFrame({"rid": np.repeat(rid[hit], many), "other": other[at]}).drop_duplicates()  # two hashes may share a key
    return pa.table({"rid": pa.array(found["rid"].to_numpy(), pa.int64()), "other": pa.array(found["other"].to_numpy(), pa.int64())})


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of all ordered pairs of near words of a written table (word, n)."""
    total = vocabulary.count()
    k = min(max(4, math.ceil(total ** (1 / 7))), len(SYMBOLS))
    known = "".join(map(chr, LETTERS))
    reduced = vocabulary.withColumn("reduced", F.translate("word", known, symbols(k)))
    numbered = written(reduced.select("reduced").distinct().withColumn("rid", F.monotonically_increasing_id()), "reduced")
    hashes = numbered.agg(F.coalesce(F.sum((2 * F.char_length("reduced") + 2) * k), F.lit(0))).first()[0]
    rows = dealt(numbered, k, max(1, -(-hashes // BUCKET)))
    pairs = written(rows.groupBy("bucket").applyInArrow(looked_up, "rid long, other long"), "reduced-pairs")
    member = written(reduced.join(numbered, "reduced").select("rid", "word", "n"), "reduced-words")
    a = member.join(pairs, "rid").select("word", "n", "other")
    b = member.select(F.col("rid").alias("other"), F.col("word").alias("other_word"), F.col("n").alias("other_n"))
    near = a.join(b, "other").where("word <> other_word and levenshtein(word, other_word, 1) = 1")
    out = written(near.select("word", "n", F.col("other_word").alias("other"), "other_n"), "near-words")
    discard(numbered, pairs, member)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that the forms (word, form) of a word lead to.

    A form is commoner than its word, so there are no circles; a round doubles the steps followed.
    """
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = written(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = not nxt.where("moved").isEmpty()
        discard(at)
        at = nxt.drop("moved") if not moved else written(nxt.drop("moved"), "roots")
        if not moved:
            return at
        discard(nxt)


def spelling_variants(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shortest: int = 7, least: int = 2,
                      every: int = 31, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``docs``."""
    vocabulary = written(words(docs, text, id_col, shortest, least, every), "words")
    near = near_words(vocabulary)
    # the largest n and of those the smallest word
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    listed = vocabulary.join(best, "word", "left")
    common = -F.col("best.less") >= ratio * F.col("n")
    formed = written(listed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                   F.when(common, F.col("best.form")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n")), "forms")
    discard(near, vocabulary)
    root = roots(formed.where("form is not null"))
    return formed.join(root, "word", "left").withColumn("root", F.coalesce("root", "word"))
