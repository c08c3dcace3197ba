"""Quality classifier: interpolated modified Kneser-Ney character models of trusted text.

Model.  N-grams of ``SHORT`` to ``LONG`` characters as they are (no folding, no
cap) are counted over *all* trusted documents of each language.  Their counts,
continuation counts (in how many contexts an n-gram was seen) and contexts are
tables sharded by language and n-gram, which grow with the trusted text.
Discounts are estimated per order from the counts of counts; each order
interpolates with the next lower one.  The lowest interpolates with a model of
folded characters: ``SYMBOLS`` symbols (lower-case Latin letters, one symbol for
capitals, eight classes of other letters, digits, blank, line end, common
marks), each shared evenly by its code points, order ``ORDER``, at most 12.4 MB
a language; it is a floor for text that has not been seen.

Cross-fitting.  Trusted documents are halved by their text's hash, and a model is
made of each half.  Every document, trusted or not, is scored by the model of the
half that its own text's hash does not fall into: no text is its own evidence, and
equal texts of a language have one perplexity and one verdict, labelled or not.

Scoring joins.  Documents are dealt into blocks; the text travels in parcels,
compressed batches of one block's rows.  A block's different n-grams are joined to
the sharded table, what was found returns to the block, and each document's
log-probabilities are summed.  The labels are joined within the blocks.

Score.  A document's perplexity is over all of its characters.  A document is
rejected if it lies outside the band between two quantiles of the perplexity of
the trusted documents of its language and length class (doubling lengths, as
short texts scatter more), widened by a margin on the log scale.  The quantiles
are exact to 0.001 in the mean negative log-likelihood, from grouped counts.
All perplexities are held out, so a band holds for text that has not been seen and
the margin is only for the quantiles' own error.

Every document with text is judged.  A length class with fewer than ``least``
trusted documents has the language's nearest shorter band, else its nearest longer
one, else that of the whole language; the latter two are widened by ``WIDEN``
standard errors of a mean of so many characters (the spread is the trusted
documents', never under ``SPREAD``, and more of few documents).  A language with fewer than ``FEW`` trusted
documents, and text without a language, is scored by the model of all trusted text
and judged by the bands of all trusted documents under that model.  Null or
empty text has null perplexity and is kept; without any trusted text all is kept.
A null or empty language is none: such text counts for the model of all trusted text only.
Rows that repeat are judged alike; a null doc_id is judged like others.  Trusted
documents have quality 1 and are not toxic in all their labels.  Columns other
than doc_id, text and lang are ignored.

Folded models of more than ``MODELS_AT_ONCE`` languages are used in several passes,
so what a pass broadcasts is bounded whatever the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentlens.llm.common import BASE, discard, free_shuffles, mapped, mix, sliced, unused, written
from rentlens.llm.common import runs as runs_of

ORDER = 4
SYMBOLS = 42
MODELS_AT_ONCE = 6
#: The model of all trusted text, and the language of text without one.
POOLED = ""
#: Highest and lowest order of the unfolded n-grams, and what stands before a text (no code point).
LONG, SHORT, PAD = 5, 4, 0x110000
#: Characters of a block (its n-grams are looked up once) and bytes of text that a task works on at a time.
BLOCK, SLICE = 32 << 20, 2 << 20
#: Blocks that share a hash of the doc_id; a document's text says in which of them it is, so that one doc_id fills none.
SALTS = 8
#: Bytes of rows that a task gathers before it makes parcels of them.
PARCEL = 32 << 20
#: Keys that a task holds before it merges or sends them.
HELD = 8 << 20
#: Trusted documents from which a language has a model of its own; standard errors and least spread of borrowed bands.
FEW, WIDEN, SPREAD = 10, 3.0, 2.0
#: Discounts of counts 1, 2 and 3 or more, from the numbers of n-grams counted one to four times (see ``discounts``).
DISCOUNTS = {c: f"if(n1 > 0 and n2 > 0, least({c - 0.01}, greatest(0.01, {e})), 0.5D)" for c, e in {
    1: "1 - 2 * n1 / (n1 + 2 * n2) * n2 / n1", 2: "if(n3 > 0, 2 - 3 * n1 / (n1 + 2 * n2) * n3 / n2, 1D)",
    3: "if(n3 > 0 and n4 > 0, 3 - 4 * n1 / (n1 + 2 * n2) * n4 / n3, 1D)"}.items()}


def _fold_table() -> np.ndarray:
    """Symbol of each code point below 2**16; higher ones are letters of class 34."""
    t = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        ch = chr(c)
        low = ch.lower()
        if "a" <= ch <= "z":
            t[c] = c - 96
        elif ch.isalpha():
            t[c] = 27 if ch != low else 28 + c % 8
        elif ch.isdigit():
            t[c] = 36
        elif ch == "\n":
            t[c] = 37
        elif ch.isspace():
            t[c] = 38
        elif ch in ".,":
            t[c] = 39
        elif ch in "'\"-:;()?":
            t[c] = 40
        else:
            t[c] = 41
    return t


_FOLD: list[np.ndarray] = []
_TABLES: list[tuple] = []


def symbols(text: str) -> np.ndarray:
    if not _FOLD:
        _FOLD.append(_fold_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _FOLD[0][np.where(points < 1 << 16, points, ord("㐀"))]


def grams(text: str) -> np.ndarray:
    """The n-gram that ends at each character; symbol 0 stands before the text."""
    s = np.concatenate([np.zeros(ORDER - 1, np.int64), symbols(text)])
    g = np.zeros(len(s) - ORDER + 1, np.int64)
    for i in range(ORDER):
        g = g * SYMBOLS + s[i: len(s) - ORDER + 1 + i]
    return g


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The different runs of ``LONG`` characters that end at a character, which of them ends at each, lengths of the texts."""
    import pandas as pd
    pads, parts, lengths = np.full(LONG - 1, PAD, np.uint32), [], []
    for t in texts:
        points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
        parts += [pads, points]
        lengths.append(len(points))
    s = np.concatenate(parts)
    at = np.flatnonzero(s[LONG - 1:] != PAD)
    m = mixed(s)
    code, found = pd.factorize(joined([m[i: len(s) - LONG + 1 + i] for i in range(LONG)])[at])
    first = np.empty(len(found), np.int64)
    first[code[::-1]] = at[::-1]
    return s[first[:, None] + np.arange(LONG)], code, lengths


def keys(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit key of each run of characters, one column for each place."""
    return joined([mixed(c) for c in columns])


def mixed(characters: np.ndarray) -> np.ndarray:
    """What each character adds to a key; those of overlapping runs are computed once."""
    with np.errstate(over="ignore"):
        return mix(characters.astype(np.uint64) + np.uint64(1))


def joined(columns: list[np.ndarray]) -> np.ndarray:
    """``keys`` of columns that are ``mixed``."""
    with np.errstate(over="ignore"):
        h = columns[0] * np.uint64(BASE)
        for c in columns[1:]:
            h += c
            h *= np.uint64(BASE)
        return mix(h).view(np.int64)


def levels(runs: np.ndarray) -> dict[str, np.ndarray]:
    """Keys of the n-gram (g) and the context (c) of each unfolded order that end at the last character of ``runs``."""
    out, every = {}, [mixed(runs[:, i]) for i in range(LONG)]
    for k in range(LONG, SHORT - 1, -1):
        columns = every[LONG - k:]
        out |= {f"g{k}": joined(columns), f"c{k}": joined(columns[:-1])}
    return out


def folded(runs: np.ndarray) -> np.ndarray:
    """The folded n-gram at the end of each run."""
    if not _FOLD:
        _FOLD.append(_fold_table())
    last = runs[:, LONG - ORDER:]
    s = np.where(last == PAD, 0, _FOLD[0][np.where(last < 1 << 16, last, ord("㐀"))]).astype(np.int64)
    return s @ SYMBOLS ** np.arange(ORDER - 1, -1, -1)


def class_sizes() -> np.ndarray:
    """How many code points each symbol stands for."""
    if not _FOLD:
        _FOLD.append(_fold_table())
    n = np.bincount(_FOLD[0], minlength=SYMBOLS).astype(np.float64)
    n[_FOLD[0][ord("㐀")]] += PAD - (1 << 16)
    return np.maximum(n, 1)


def packed(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of each run as two numbers, 21 bits each: ``lo`` has the last three, ``hi`` those before."""
    r, lo = runs.astype(np.int64), LONG - 3
    return (sum(r[:, i] << 21 * (lo - 1 - i) for i in range(lo)), sum(r[:, i] << 21 * (LONG - 1 - i) for i in range(lo, LONG)))


def unpacked(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    mask = (1 << 21) - 1
    return np.stack([(hi >> 21 * (LONG - 4 - i)) & mask for i in range(LONG - 3)] + [(lo >> 21 * i) & mask for i in (2, 1, 0)], axis=1)


def parcels(df: DataFrame) -> DataFrame:
    """(block, parcel): the rows of ``df`` as compressed batches, each of one ``block`` of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packets() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            block = rows.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            at, count = runs_of(block[order])
            for start, n in zip(at.tolist(), count.tolist()):
                sink = pa.BufferOutputStream()
                mine = rows.take(pa.array(order[start:start + n])).combine_chunks()
                with pa.ipc.new_stream(sink, mine.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(mine)
                yield pa.RecordBatch.from_arrays([pa.array([block[order[start]]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                                 ["block", "parcel"])

        for batch in batches:
            for part in sliced(batch, text="text", chars=PARCEL // 4):
                held.append(part)
                if sum(p.nbytes for p in held) >= PARCEL:
                    yield from packets()
        if held:
            yield from packets()
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, "block int, parcel binary")


def unpacked_parcels(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The batches of a block's parcels, in slices of ``SLICE`` bytes of text."""
    for parcel in rows.column("parcel"):
        for batch in pa.ipc.open_stream(parcel.as_buffer()).read_all().combine_chunks().to_batches():
            yield from sliced(batch, text="text", chars=SLICE)


def printed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, lang, text) with the text's hash, its number of characters and the half that the hash falls into."""
    return docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("print"), F.length("text").alias("chars"),
                       F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"))


def in_blocks(docs: DataFrame, chars: int) -> tuple[DataFrame, int]:
    """``docs`` (doc_id, print, ...) with ``block``, and the number of different hashes of doc_ids."""
    ids = max(1, -(-chars // (BLOCK * SALTS)))
    of = F.pmod(F.xxhash64(F.coalesce("doc_id", "print")), F.lit(ids)) * SALTS + F.pmod("print", F.lit(SALTS))
    return docs.withColumn("block", of.cast("int")), ids


def label_blocks(sound: DataFrame, ids: int) -> DataFrame:
    """(block, doc_id): trusted doc_ids in every block that may hold them."""
    every = sound.select("doc_id", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    return every.select((F.pmod(F.xxhash64("doc_id"), F.lit(ids)) * SALTS + F.col("salt")).cast("int").alias("block"), "doc_id")


def merged_counts(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo, n) with equal runs added up."""
    hi, lo, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((lo, hi))
    hi, lo, n = hi[order], lo[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
    return hi[first], lo[first], np.add.reduceat(n, first)


def long_counts(docs: DataFrame, sound: DataFrame) -> DataFrame:
    """(lang, half, hi, lo, n) of the different runs of the documents of ``docs`` (doc_id, lang, half, print, chars, text) whose doc_id is in ``sound``.

    A row with hi = -1 has the number of these documents.
    """
    known = docs.where("doc_id is not null and text <> ''")
    dealt, ids = in_blocks(known, known.agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0])

    def count(rows: pa.Table, labels: pa.Table) -> pa.Table:
        held: dict[tuple, list] = {}
        number: dict[tuple, int] = {}
        trusted = labels.column("doc_id").combine_chunks().unique()
        for part in unpacked_parcels(rows) if len(trusted) else ():
            by: dict[tuple, list] = {}
            part = part.filter(pc.is_in(part.column("doc_id"), trusted))
            for lang, half, text in zip(*(part.column(c).to_pylist() for c in ("lang", "half", "text"))):
                by.setdefault((lang, half), []).append(text)
            for of, texts in by.items():
                found, code, _ = windows(texts)
                mine = held.setdefault(of, [])
                mine.append((*packed(found), np.bincount(code, minlength=len(found))))
                number[of] = number.get(of, 0) + len(texts)
                if sum(len(x[0]) for x in mine[1:]) > max(HELD // 8, len(mine[0][0])):
                    held[of] = [merged_counts(mine)]
        out = [(of, *merged_counts(mine)) for of, mine in held.items()]
        out += [(of, np.array([-1]), np.array([-1]), np.array([n])) for of, n in number.items()]
        cols = [[x[0][i] for x in out for _ in range(len(x[1]))] for i in (0, 1)]
        return pa.table({"lang": pa.array(cols[0], pa.string()), "half": pa.array(cols[1], pa.int32()),
                         **{c: pa.array(np.concatenate([x[i] for x in out]) if out else [], pa.int64()) for i, c in ((1, "hi"), (2, "lo"), (3, "n"))}})

    rows = parcels(dealt.select("block", "doc_id", "lang", "half", "text"))
    part = rows.groupBy("block").cogroup(label_blocks(sound, ids).groupBy("block")).applyInArrow(count, "lang string, half int, hi long, lo long, n long")
    return part.groupBy("lang", "half", "hi", "lo").agg(F.sum("n").alias("n"))


def long_model(counts: DataFrame) -> DataFrame:
    """(half, key, own, back): discounted share of an n-gram, weight of the lower order after a context.

    A key is that of the characters, crossed with the hash of (model, half).  The model for
    texts of a half is of the trusted documents of the other.  Below the highest order the
    counts are continuation counts.
    """
    of, out = ["model", "half"], None
    cur = counts.withColumnRenamed("lang", "model").withColumn("half", 1 - F.col("half"))
    for k in range(LONG, SHORT - 1, -1):
        cur = cur.withColumn("hi", F.col("hi").bitwiseAND(F.lit((1 << 21 * (k - 3)) - 1)))
        cur = cur.groupBy(*of, "hi", "lo").agg((F.sum("n") if k == LONG else F.count("*")).alias("n"))
        rows = cur.select(*of, F.lit(k).alias("k"), "hi", "lo", "n")
        out = rows if out is None else out.unionByName(rows)
    seen = written(out, "long-counts")
    few = seen.groupBy(*of, "k").agg(*[F.count_if(F.col("n") == c).cast("double").alias(f"n{c}") for c in (1, 2, 3, 4)])
    few = few.select(*of, "k", *[F.expr(e).alias(f"d{c}") for c, e in DISCOUNTS.items()])
    # a row for each order of a model
    cut = seen.join(F.broadcast(few), [*of, "k"]).select(
        *of, "k", "hi", "lo", F.shiftright("lo", 21).alias("at"), "n", F.expr("case n when 1 then d1 when 2 then d2 else d3 end").alias("cut"))
    after = cut.groupBy(*of, "k", "hi", "at").agg(F.sum("n").alias("total"), F.sum("cut").alias("back"))
    own = cut.join(after.drop("back"), [*of, "k", "hi", "at"])
    salt, nothing = F.xxhash64("model", "half").alias("salt"), F.lit(None).cast("float")
    table = own.select(salt, "half", "k", "hi", "lo", ((F.col("n") - F.col("cut")) / F.col("total")).cast("float").alias("own"), nothing.alias("back"))
    table = table.unionByName(after.select(salt, "half", "k", "hi", F.shiftleft("at", 21).alias("lo"), nothing.alias("own"), (F.col("back") / F.col("total")).cast("float").alias("back")))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        runs, k = unpacked(*(batch.column(c).to_numpy() for c in ("hi", "lo"))), batch.column("k").to_numpy()
        context = batch.column("own").is_null().to_numpy(zero_copy_only=False)
        key = np.zeros(len(k), np.int64)
        for order in range(SHORT, LONG + 1):
            for end in (0, 1):
                some = (k == order) & (context == bool(end))
                key[some] = keys([runs[some, i] for i in range(LONG - order, LONG - end)])
        yield {"half": batch.column("half"), "key": key ^ batch.column("salt").to_numpy(), "own": batch.column("own"), "back": batch.column("back")}

    keyed = mapped(table, run, "half int, key long, own float, back float")
    model = written(keyed.groupBy("half", "key").agg(F.max("own").alias("own"), F.max("back").alias("back")), "long-model")
    discard(seen)
    return model


def folded_counts(counts: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"lang": batch.column("lang"), "n": batch.column("n"), "gram": folded(unpacked(*(batch.column(c).to_numpy() for c in ("hi", "lo"))))}

    return mapped(counts.select("lang", "hi", "lo", "n"), run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def with_pooled(counts: DataFrame) -> DataFrame:
    """The counts of each language, and those of all text, also of no language, under the name ``POOLED``."""
    return counts.where(F.col("lang") != POOLED).unionByName(counts.withColumn("lang", F.lit(POOLED)))


def order_counts(counts: DataFrame) -> DataFrame:
    """(lang, k, gram, n) for k = ORDER..1: counts of the highest order, continuation counts below it."""
    out = counts.select("lang", F.lit(ORDER).alias("k"), "gram", "n")
    cur = counts.select("lang", "gram")
    for k in range(ORDER - 1, 0, -1):
        lower = cur.groupBy("lang", (F.col("gram") % SYMBOLS**k).alias("gram")).agg(F.count("*").alias("n"))
        out = out.unionByName(lower.select("lang", F.lit(k).alias("k"), "gram", "n"))
        cur = lower.select("lang", "gram")
    return out


def discounts(n: np.ndarray) -> np.ndarray:
    """Discount of counts 0, 1, 2 and 3 or more; never nothing, so that no text is impossible."""
    n1, n2, n3, n4 = (float((n == c).sum()) for c in (1, 2, 3, 4))
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.0]
    return np.clip(np.array(d), np.array([0.0, 0.01, 0.01, 0.01]), np.array([0.0, 0.99, 1.99, 2.99]))


def model_table(k: np.ndarray, gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Natural log-probability of an n-gram's last symbol after the others, for every n-gram."""
    return Model(packed_model(k, gram, n)).log_probability(np.arange(SYMBOLS**ORDER))


class Model:
    """A packed model: contexts that were never seen have the lower order's rows."""

    def __init__(self, packed: bytes):
        self.lower = np.frombuffer(packed, "<f4", SYMBOLS ** (ORDER - 1))
        seen = int(np.frombuffer(packed, "<i4", 1, 4 * len(self.lower))[0])
        at = np.frombuffer(packed, "<i4", seen, 4 * len(self.lower) + 4)
        self.rows = np.frombuffer(packed, "<f4", seen * SYMBOLS, 4 * len(self.lower) + 4 + 4 * seen)
        self.row_of = np.full(SYMBOLS ** (ORDER - 1), -1, np.int32)
        self.row_of[at] = np.arange(seen, dtype=np.int32)

    def log_probability(self, gram: np.ndarray) -> np.ndarray:
        row = self.row_of[gram // SYMBOLS].astype(np.int64)
        out = self.lower[gram % len(self.lower)]
        known = row >= 0
        out[known] = self.rows[row[known] * SYMBOLS + gram[known] % SYMBOLS]
        return out


def packed_model(k: np.ndarray, gram: np.ndarray, n: np.ndarray) -> bytes:
    """The next lower order's log-probabilities, and those of the highest order for the contexts that were seen."""
    lower = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(1, ORDER + 1):
        at = k == order
        dense = np.zeros(SYMBOLS**order)
        dense[gram[at]] = n[at]
        d = discounts(n[at])
        table = dense.reshape(-1, SYMBOLS)
        cut = d[np.minimum(table, 3).astype(np.int64)]
        total = table.sum(axis=1, keepdims=True)
        back = np.divide(cut.sum(axis=1, keepdims=True), total, out=np.ones_like(total), where=total > 0)
        own = np.divide(table - cut, total, out=np.zeros_like(table), where=total > 0)
        # the lower order's context is this one's without its first symbol
        low = np.tile(lower.reshape(-1, SYMBOLS), (max(1, len(table) // max(1, lower.size // SYMBOLS)), 1))[: len(table)]
        before, lower = lower, (own + back * low).ravel()
    at = np.flatnonzero(total[:, 0] > 0).astype("<i4")
    rows = np.log(lower.reshape(-1, SYMBOLS)[at])
    return b"".join([np.log(before).astype("<f4").tobytes(), np.array([len(at)], "<i4").tobytes(), at.tobytes(), rows.astype("<f4").tobytes()])


def trained(counts: DataFrame) -> DataFrame:
    """(lang, model): the folded model of each language of ``counts``."""
    every = written(order_counts(folded_counts(counts)), "order-counts")

    def build(pdf):
        import pandas as pd
        model = packed_model(pdf["k"].to_numpy(), pdf["gram"].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "model": [model]})

    # a group has at most the sum of SYMBOLS ** k rows
    models = written(every.groupBy("lang").applyInPandas(build, "lang string, model binary"), "models")
    discard(every)
    return models


def asked(rows: pa.Table) -> pa.Table:
    """(block, key): the different n-grams and contexts of a block's parcels, for each model that may score them."""
    import pandas as pd
    held: list[np.ndarray] = [np.empty(0, np.int64)]
    for part in unpacked_parcels(rows):
        for salts, texts in grouped(part, ["salt", "wide"]):
            keyed = list(levels(windows(texts.column("text").to_pylist())[0]).values())
            held += [x ^ salt for salt in salts if salt is not None for x in keyed]
        if sum(map(len, held[1:])) > max(HELD, len(held[0])):
            held = [pd.unique(np.concatenate(held))]
    key = pd.unique(np.concatenate(held))
    return pa.table({"block": pa.array(np.full(len(key), rows.column("block")[0].as_py(), np.int32)), "key": pa.array(key)})


def grouped(part: pa.RecordBatch, by: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of a batch that agree in ``by``."""
    at: dict[tuple, list[int]] = {}
    for i, of in enumerate(zip(*(part.column(c).to_pylist() for c in by))):
        at.setdefault(of, []).append(i)
    for of, some in at.items():
        yield of, part.take(pa.array(some))


#: Columns of a scored row.
MARKS = "doc_id long, model string, print long, chars int, half int, extra boolean, known boolean, nll double"


def scorer(held):
    """Scores a block's parcels with what was found of its n-grams; rows of ``found`` with a label are trusted doc_ids."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    schema = to_arrow_schema(StructType.fromDDL(MARKS))

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not _TABLES or _TABLES[0][0] is not held.value:  # once per worker and pass
            _TABLES[:] = [(held.value, {k: Model(v) for k, v in held.value.items()}, class_sizes())]
        models, sizes = _TABLES[0][1:]
        label = found.column("label").to_numpy()
        trusted = found.column("key").filter(pa.array(label)).combine_chunks().unique()
        found = found.filter(pa.array(~label))
        key = found.column("key").to_numpy()
        order = np.argsort(key)
        key = key[order]
        own, back = (np.append(np.nan_to_num(found.column(c).to_numpy().astype(np.float64)[order], nan=none), none) for c, none in (("own", 0.0), ("back", 1.0)))

        def place(k: np.ndarray, salt: int) -> np.ndarray:
            k = k ^ salt
            at = np.searchsorted(key, k)
            return np.where((at < len(key)) & (np.append(key, 0)[at] == k), at, len(key))

        def nll(texts: list[str], model: str, salt: int) -> np.ndarray:
            some, code, lengths = windows(texts)
            gram, at = folded(some), levels(some)
            p = np.exp(models[model].log_probability(gram).astype(np.float64)) / sizes[gram % SYMBOLS]
            for k in range(SHORT, LONG + 1):
                p = own[place(at[f"g{k}"], salt)] + back[place(at[f"c{k}"], salt)] * p
            ends = np.cumsum(lengths)
            return -np.add.reduceat(np.log(p)[code], ends - lengths) / lengths

        out = []

        def add(mine: pa.RecordBatch, model: str, salt: int, extra: bool) -> None:
            known = pc.fill_null(pc.is_in(mine.column("doc_id"), trusted), False)
            out.append(pa.RecordBatch.from_arrays(
                [mine.column("doc_id"), pa.array([model] * mine.num_rows, pa.string()), mine.column("print"), mine.column("chars"), mine.column("half"),
                 pa.array([extra] * mine.num_rows), known, pa.array(nll(mine.column("text").to_pylist(), model, salt))], schema=schema))

        for part in unpacked_parcels(rows):
            for (model, salt, wide), mine in grouped(part, ["model", "salt", "wide"]):
                add(mine, model, salt, False)
                if wide is not None:  # trusted documents also under the model of all trusted text
                    mine = mine.filter(pc.is_in(mine.column("doc_id"), trusted))
                    if mine.num_rows:
                        add(mine, POOLED, wide, True)
        return pa.Table.from_batches(out, schema)

    return score


def scored(docs: DataFrame, sound: DataFrame, models: DataFrame, table: DataFrame, rest: bool) -> DataFrame:
    """``MARKS`` of ``docs`` (doc_id, lang, half, print, chars, text): nll is the mean negative log-likelihood of a character (null without text).

    ``known`` says that the doc_id is in ``sound``.  With ``rest``, such documents of a language
    with a model of its own have a second row, ``extra``, under the model of all trusted text.
    """
    spark = docs.sparkSession
    names = sorted(r[0] for r in models.select("lang").collect())
    model = F.when(F.col("lang").isin(names), F.col("lang")).otherwise(POOLED)
    salt = lambda m: F.xxhash64(m, F.col("half"))
    docs = docs.withColumn("model", model)
    docs = docs.withColumn("salt", salt(F.col("model"))).withColumn("wide", F.when(F.lit(rest) & (F.col("model") != POOLED), salt(F.lit(POOLED))))
    plain = docs.where("text <> ''") if names else docs.where("false")
    out = docs.where("coalesce(text, '') = ''") if names else docs
    out = out.select("doc_id", "model", "print", "chars", "half", F.lit(False).alias("extra"), F.lit(False).alias("known"), F.lit(None).cast("double").alias("nll"))
    # each half of the texts has a pass of its own, with its own part of the table, so that half as much text moves at a time
    plain, ids = in_blocks(plain, (plain.agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0] + 1) // 2)
    labels = label_blocks(sound, ids).select("block", F.col("doc_id").alias("key"), F.lit(None).cast("float").alias("own"),
                                             F.lit(None).cast("float").alias("back"), F.lit(True).alias("label"))
    own = [n for n in names if n != POOLED] or names
    for i, half in ((i, half) for i in range(0, len(own), MODELS_AT_ONCE) for half in (0, 1)):
        some = own[i: i + MODELS_AT_ONCE] + ([POOLED] if POOLED in names and POOLED not in own else [])
        held = spark.sparkContext.broadcast({r[0]: r[1] for r in models.where(F.col("lang").isin(some)).toLocalIterator()})
        # text of no own model goes with the first models
        mine = plain.where((F.col("half") == half) & F.col("model").isin([n for n in some if n != POOLED or not i]))
        # one exchange of the text serves both sides
        mine = parcels(mine.select("block", "doc_id", "model", "print", "chars", "half", "salt", "wide", "text")).repartition("block")
        found = mine.groupBy("block").applyInArrow(asked, "block int, key long").hint("merge").join(table.where(F.col("half") == half), "key")
        found = found.select("block", "key", "own", "back", F.lit(False).alias("label")).unionByName(labels)
        part = written(mine.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(scorer(held), MARKS), "scored")
        del mine, found
        free_shuffles(spark)
        out = out.unionByName(part)
    return out


def length_class(chars):
    return F.floor(F.log2(F.greatest(chars, F.lit(1)))).cast("int")


def bands(trusted: DataFrame, low: float, high: float, least: int) -> DataFrame:
    """(model, length, lo, hi): quantiles of ``nll`` by model and length class, from counts of milli-units."""
    cells = trusted.where("nll is not null").groupBy("model", "length", F.round(F.col("nll") * 1000).cast("long").alias("cell")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("model", "length")
    cum = cells.withColumn("upto", F.sum("n").over(by.orderBy("cell"))).withColumn("all", F.sum("n").over(by))
    return (cum.groupBy("model", "length").agg(
        F.min(F.when(F.col("upto") >= F.col("all") * low, F.col("cell"))).alias("lo"),
        F.min(F.when(F.col("upto") >= F.col("all") * high, F.col("cell"))).alias("hi"), F.max("all").alias("all"))
        .where(F.col("all") >= least).select("model", "length", (F.col("lo") / 1000).alias("lo"), (F.col("hi") / 1000).alias("hi")))


def limits(marks: DataFrame, low: float, high: float, least: int) -> DataFrame:
    """(model, length, lo, hi, spread) for every length class of ``marks`` whose model has trusted documents."""
    trusted = marks.where("known and nll is not null")
    own = bands(trusted, low, high, least).withColumnRenamed("length", "of")
    whole = bands(trusted.withColumn("length", F.lit(None).cast("int")), low, high, 1).withColumnRenamed("length", "of")
    centre = trusted.groupBy("model").agg(F.avg("nll").alias("centre"))
    spread = trusted.join(F.broadcast(centre), "model").groupBy("model").agg(
        (F.greatest(F.lit(SPREAD), F.sqrt(F.avg((F.col("nll") - F.col("centre")) ** 2 * F.col("chars")))) * (1 + 4 / F.count("*"))).alias("spread"))
    # the nearest shorter class, else the nearest longer one, else all
    first = Window.partitionBy("model", "length").orderBy(F.expr("if(of is null, 2, if(of <= length, 0, 1))"), F.expr("abs(of - length)"))
    return (marks.select("model", "length").distinct().join(own.unionByName(whole), "model").withColumn("r", F.row_number().over(first)).where("r = 1")
            .join(spread, "model").select("model", "length", "lo", "hi", F.expr("if(of <= length, 0D, spread)").alias("spread")))


def quality_classifier(docs: DataFrame, labels: DataFrame, low: float = 0.002, high: float = 0.998, margin: float = 0.1,
                       least: int = 50) -> DataFrame:
    """doc_id, print (hash of the text), perplexity, accepted of every row of ``docs``; ``labels`` say which are trusted."""
    sound = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0").select("doc_id")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(POOLED)).alias("lang")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang, F.col("text").cast("string").alias("text"))
    whole = printed(plain)
    counts = written(long_counts(whole, sound), "gram-counts")
    number = counts.where("hi = -1").groupBy("lang").agg(F.sum("n").alias("n"))
    known = [r.lang for r in number.where((F.col("n") >= FEW) & (F.col("lang") != POOLED)).collect()]
    grams = counts.where("hi >= 0")
    own = grams.where(F.col("lang").isin(known))
    # where a document needs the model of all trusted text, it is made, and its bands are of all trusted documents
    rest = not whole.where((F.col("text") != "") & ~F.col("lang").isin(known)).isEmpty()
    some = with_pooled(own.unionByName(grams.where(~F.col("lang").isin(known)).withColumn("lang", F.lit(POOLED)))) if rest else own
    models, table = trained(some), long_model(some)
    discard(counts)
    marks = written(scored(whole, sound, models, table, rest).withColumn("length", length_class(F.col("chars"))), "scores")
    discard(models, table)
    lines = limits(marks, low, high, least)
    # a row for each length class of a model
    judged = marks.where("not extra").join(F.broadcast(lines), ["model", "length"], "left")
    wide = F.lit(margin) + WIDEN * F.col("spread") / F.sqrt(F.greatest("chars", F.lit(1)))
    return judged.select("doc_id", "print", F.exp("nll").alias("perplexity"),
                         F.coalesce((F.col("nll") >= F.col("lo") - wide) & (F.col("nll") <= F.col("hi") + wide), F.lit(True)).alias("accepted"))


def apply_verdicts(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judged`` accepts."""
    a, b = unused(docs, "rejected_doc"), unused(docs, "rejected_print")
    out = judged.where("not accepted").select(F.col("doc_id").alias(a), F.col("print").alias(b)).distinct()
    return docs.hint("merge").join(out, F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (F.xxhash64(F.col("text").cast("string")) == F.col(b)), "left_anti")
