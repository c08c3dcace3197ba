"""Vector code compression: product codes of integer vectors, searched in the Walsh-Hadamard domain.

A vector's components become integers floor(scale * x) and are cut into equal
consecutive parts; each part is coded by the nearest entry of its part's
codebook.  Codebooks start as the parts of the rows with the smallest ids and
are moved to the floored mean of their parts in a fixed number of rounds.

The nearest entry is found without floating point.  Part and entries are padded
with zeros to a power of two, P, and transformed by the integer Walsh-Hadamard
transform; the sum of squared differences of all coefficients is exactly P times
the squared distance.  The sum is built up in sequency order, where most of the
difference lies in the first coefficients; an entry whose sum so far exceeds the
whole sum of some other entry cannot be nearest and is left out of the rest.

Spark scans the vectors once a round: each task returns a sum per codebook
entry and position, in limbs of 30 bits so that no sum overflows, and the sums
are added up in a grouped aggregate.  Only codebooks, whose size is fixed by the
parameters and the vector's length, reach the driver and the tasks.

Rows that are null or hold null or non-finite components are dropped.  Vectors
shorter than the longest are followed by zeros, as is a length that the number
of parts does not divide; an empty vector is all zeros.  Components of any finite
size are exact; an error beyond a long is null.  Rows with a null id come last
when the first entries are chosen; rows with equal ids are taken in the order
of their vectors, and repeated rows are coded alike.  With fewer rows than
entries the codebooks are shorter.  An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentlens.llm.common import carried, mapped, sliced

#: Bits of a limb of a sum: a task's limbs fit a long whatever the number of tasks.
LIMB = 30
#: Coefficients added to the sums before entries are left out again.
STEP = 2
_LONG = 1 << 63


@dataclass(frozen=True)
class Codebooks:
    """``entries[part][entry]`` is a tuple of integers; ``width`` components to a part, ``scale`` to one."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]
    width: int
    scale: int

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def floors(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: long integers where they and what is made of them fit, else Python's."""
    if scale & (scale - 1) == 0 and (not len(values) or np.abs(values).max() < (1 << 40) / scale):
        return np.floor(values * scale).astype(np.int64)  # the product is exact
    return np.array([(n * scale) // d for n, d in (float(x).as_integer_ratio() for x in values)], dtype=object)


def integer_rows(vectors: pa.Array, scale: int, total: int) -> np.ndarray:
    """Rows of ``total`` integers, followed by zeros where a vector is shorter."""
    lengths = np.asarray(vectors.value_lengths())
    ints = floors(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), scale)
    if len(lengths) and (lengths == total).all():
        return ints.reshape(len(lengths), total)
    out = np.zeros((len(lengths), total), ints.dtype)
    out[np.arange(total) < lengths[:, None]] = ints
    return out


def walsh(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row (its length a power of two), coefficients in sequency order."""
    n, p = rows.shape
    out, span = rows, 1
    while span < p:
        pairs = out.reshape(n, p // (2 * span), 2, span)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        out, span = np.stack([a + b, a - b], axis=2).reshape(n, p), span * 2
    return out[:, sequency(p)]


def sequency(p: int) -> np.ndarray:
    """Places of the Hadamard matrix's rows in the order of their number of sign changes."""
    h = np.ones((1, 1), np.int8)
    while len(h) < p:
        h = np.block([[h, h], [h, -h]])
    return np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")


def padded(rows: np.ndarray) -> np.ndarray:
    """Rows with zeros up to a power of two; Python integers if sums of squares might not fit a long."""
    p = 1 << max(rows.shape[1] - 1, 0).bit_length()
    if rows.dtype != object and rows.size and int(np.abs(rows).max()) * 2 * p >= math.isqrt(_LONG // p):
        rows = rows.astype(object)
    out = np.zeros((len(rows), p), rows.dtype)
    out[:, : rows.shape[1]] = rows
    return out


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each part's nearest entry; of equally near ones, the first."""
    both = padded(np.concatenate([entries, parts]))
    x = walsh(both)
    e, x = x[: len(entries)], x[len(entries):]
    n, p = x.shape
    first = min(STEP, p)
    sums = ((x[:, None, :first] - e[None, :, :first]) ** 2).sum(axis=2)
    guess = sums.argmin(axis=1)
    whole = ((x - e[guess]) ** 2).sum(axis=1)  # no entry beyond this can be nearest
    row, entry = np.nonzero(sums <= whole[:, None])
    held = sums[row, entry]
    for at in range(first, p, STEP):
        held = held + ((x[row, at:at + STEP] - e[entry, at:at + STEP]) ** 2).sum(axis=1)
        left = held <= whole[row]
        row, entry, held = row[left], entry[left], held[left]
    # rows are ascending, and entries ascend within a row: the first of the least sums is wanted
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    least = np.minimum.reduceat(held, starts)
    hit = np.flatnonzero(held == np.repeat(least, np.diff(np.append(starts, len(row)))))
    _, at = np.unique(row[hit], return_index=True)
    return entry[hit[at]], least // p


def code_parts(rows: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Entry index of every part of every row, and the rows' squared distances summed over parts."""
    codes, error = np.zeros((len(rows), len(books.entries)), np.int64), 0
    for k, part in enumerate(books.entries):
        mine = rows[:, k * books.width:(k + 1) * books.width]
        entries = np.array(part, dtype=object)
        if mine.dtype != object and all(abs(v) < 1 << 62 for entry in part for v in entry):
            entries = entries.astype(np.int64)
        codes[:, k], d = nearest(mine, entries.reshape(len(part), books.width))
        error = error + d.astype(object)
    return codes, error


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, limb) with value = sum of limb << place * LIMB; the last limb carries the sign."""
    place = 0
    while value not in (0, -1):
        low = value & ((1 << LIMB) - 1)
        if low:
            yield place, low
        value >>= LIMB
        place += 1
    if value:
        yield place, -1


def part_sums(vectors: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> number of its parts and their sum at each position."""
    total = books.width * len(books.entries)

    def run(batch: pa.RecordBatch):
        found: dict[tuple[int, int, int], int] = {}
        for some in sliced(batch):
            rows = integer_rows(some.column(0), books.scale, total)
            codes, _ = code_parts(rows, books)
            for part in range(codes.shape[1]):
                mine = rows[:, part * books.width:(part + 1) * books.width]
                for entry in np.unique(codes[:, part]):
                    chosen = mine[codes[:, part] == entry]
                    found[part, entry, -1] = found.get((part, entry, -1), 0) + len(chosen)
                    for place, s in enumerate(chosen.sum(axis=0)):
                        found[part, entry, place] = found.get((part, entry, place), 0) + int(s)
        rows = [(*key, place, limb) for key, value in found.items() for place, limb in limbs(value)]
        names = ("part", "entry", "position", "place", "limb")
        yield {name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(names)}

    keys = ["part", "entry", "position", "place"]
    sums: dict[tuple[int, int], list[int]] = {}
    for r in mapped(vectors, run, ", ".join(f"{k} long" for k in [*keys, "limb"])).groupBy(*keys).agg(F.sum("limb").alias("limb")).collect():
        held = sums.setdefault((r.part, r.entry), [0] * (books.width + 1))
        held[r.position + 1] += r.limb << (r.place * LIMB)
    return {key: (held[0], held[1:]) for key, held in sums.items()}


def train_codebooks(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id", parts: int = 8,
                    entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks:
    """Codebooks after ``rounds`` rounds over all usable vectors."""
    vectors = df.where(usable(F.col(vector)))
    longest = vectors.agg(F.max(F.size(vector))).first()[0] or 0
    width = -(-longest // parts)
    start = vectors.orderBy(F.col(id_col).asc_nulls_last(), vector).select(F.col(vector).cast("array<double>").alias("v")).limit(entries).collect()
    rows = integer_rows(pa.array([r.v for r in start], pa.list_(pa.float64())), scale, width * parts)
    books = Codebooks(tuple(tuple(tuple(int(x) for x in row[k * width:(k + 1) * width]) for row in rows) for k in range(parts)), width, scale)
    for _ in range(rounds if start else 0):
        sums = part_sums(vectors.select(F.col(vector).cast("array<double>").alias("v")), books)
        moved = lambda k, i, old: tuple(s // sums[k, i][0] for s in sums[k, i][1]) if (k, i) in sums else old
        books = Codebooks(tuple(tuple(moved(k, i, entry) for i, entry in enumerate(part)) for k, part in enumerate(books.entries)), width, scale)
    return books


def vector_codes(df: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """The usable rows with ``code`` (entry indexes in part order, two hex digits each) and ``error``.

    ``error`` is the squared distance summed over parts.  Other columns are passed
    on, but for any named code or error.
    """
    names = carried(df, ["code", "error"])
    kept = df.where(usable(F.col(vector))).select(*names)
    total, many = books.width * len(books.entries), max((len(p) for p in books.entries), default=0)
    digits = max(2, len(f"{max(many - 1, 0):x}"))
    # the names as they are, and no two alike, reach the tasks by position
    schema = T.StructType([*kept.schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    at = names.index(vector) if vector in names else [n.lower() for n in names].index(vector.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in sliced(batch):
                codes, error = code_parts(integer_rows(some.column(at), books.scale, total), books)
                code = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()]
                fits = [int(e) if e < _LONG else None for e in np.broadcast_to(np.asarray(error, object), len(code))]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(code, pa.string()), pa.array(fits, pa.int64())],
                                                 names=[*some.schema.names, "code", "error"])

    return kept.mapInArrow(run, schema)


def with_group_error(coded: DataFrame, label: str = "label", name: str = "label_error") -> DataFrame:
    """``coded`` with its errors summed over rows of equal label, nulls together; null if beyond a long.

    The sums are made map-side first; the join to them is on the label, where AQE
    broadcasts few labels and splits a hot one among many.
    """
    sums = coded.groupBy(F.col(label).alias("_of")).agg(
        F.when(F.count("*") == F.count("error"), F.sum(F.col("error").cast("decimal(38,0)"))).alias("_sum"))
    sums = sums.select("_of", F.expr("try_cast(_sum as bigint)").alias("_sum"))
    kept = [F.col(c) for c in carried(coded, [name])]
    return coded.join(sums, F.col(label).eqNullSafe(F.col("_of")), "left").select(*kept, F.col("_sum").alias(name))
