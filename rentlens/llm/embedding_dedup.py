"""Embedding near-dedup: random-hyperplane sign hashing, exact cosine, connected components.

Vectors of one label are compared by cosine in double precision; those that are
null, zero, or hold null or non-finite components link with nothing, nor do rows
with a null label or id.

* Equal vectors of a label are one *class* with a count, so a vector that a
  third of all rows share is hashed and compared once.
* Each class gets ``tables`` codes of ``bits`` signs of projections on random
  hyperplanes.  Two vectors at cosine c agree in a sign with probability
  1 - acos(c) / pi, 0.936 at 0.98: the chance that they share no code is below
  (1 - 0.936 ** bits) ** tables, 3e-4 with 14 bits and 16 tables; it falls as
  the cosine grows.  Recall is measured in the tests against brute force.
* Classes with equal code in a table meet in a bucket; a bucket of more than
  ``tile_rows`` classes is cut into parts and the pairs of parts are tiles, so no
  task holds more than two parts.  A pair is counted in the first table where its
  codes agree, so links are counted once and pairs are never collected.
* A tile returns each class's number of links and a spanning forest; connected
  components run over the forests.

Rows with one vec_id and different vectors are separate rows of one node.  An
empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.llm.common import Forest, components, mapped, sliced, written

TILE_ROWS = 1500


def hyperplanes(dim: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def codes(unit: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """One integer code per vector and table."""
    signs = (unit @ hyperplanes(unit.shape[1], bits, tables, seed) > 0).reshape(len(unit), tables, bits)
    return (signs.astype(np.int64) << np.arange(bits)).sum(axis=2)


def hashed(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """class, label, n, unit (little-endian doubles) and codes (one per table)."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in sliced(batch):
            rows = part.column("embedding").to_pylist()
            units, coded = [], []
            for v in rows:
                x = np.array(v, np.float64)
                x = x / np.abs(x).max()
                x /= np.sqrt(x @ x)
                units.append(x.tobytes())
                coded.append(codes(x[None, :], bits, tables, seed)[0])
            yield {"class": part.column("class"), "label": part.column("label"), "n": part.column("n"),
                   "dim": [len(v) for v in rows], "unit": units, "codes": [c.tolist() for c in coded]}

    return mapped(classes, run, "class long, label long, n long, dim int, unit binary, codes array<long>")


def tile_links(unit: np.ndarray, coded: np.ndarray, table: int, left: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) with cosine at least ``least``, one of each side, that meet first in ``table``."""
    out_i, out_j = [], []
    same = left.all()
    for i in range(len(unit)) if same else np.flatnonzero(left):
        j = np.arange(i + 1, len(unit)) if same else np.flatnonzero(~left)
        near = j[unit[j] @ unit[i] >= least - 1e-9]
        if len(near):
            # the decision itself, by a sum that does not depend on the other rows of the tile
            cosine = np.array([cosine_of(unit[i], unit[k]) for k in near])
            near = near[(cosine >= least) & ~(coded[near, :table] == coded[i, :table]).any(axis=1)]
            out_i.append(np.full(len(near), i))
            out_j.append(near)
    if not out_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def cosine_of(a: np.ndarray, b: np.ndarray) -> float:
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def bucket_links(dealt: DataFrame, least: float) -> DataFrame:
    """(class, other, links): per tile and class the copies linked, with one forest edge or null."""
    keys = ["label", "dim", "table", "code", "p1", "p2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        out: list[tuple] = []

        def close() -> None:
            if len(held) < 2:
                return
            unit = np.array([np.frombuffer(h[1], np.float64) for h in held])
            same = key[4] == key[5]
            left = np.array([same or h[4] == key[4] for h in held])
            i, j = tile_links(unit, np.array([h[2] for h in held]), key[2], left, least)
            if not len(i):
                return
            count = np.array([h[3] for h in held])
            links = np.bincount(i, count[j], len(held)) + np.bincount(j, count[i], len(held))
            forest = Forest(len(held))
            for a, b in zip(i.tolist(), j.tolist()):
                if forest.join(a, b):
                    out.append((held[a][0], held[b][0], 0))
            out.extend((held[k][0], None, int(links[k])) for k in np.flatnonzero(links))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["class", "other", "links"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*keys, "class", "unit", "codes", "n", "part"))):
                if row[:6] != key:
                    close()
                    held.clear()
                    key = row[:6]
                held.append(row[6:])
                if len(out) > 10_000:
                    yield flush()
        close()
        if out:
            yield flush()

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "class").select(*keys, "class", "unit", "codes", "n", "part").mapInArrow(
        run, "class long, other long, links long")


def embedding_near_dedup(vectors: DataFrame, least: float = 0.98, bits: int = 14, tables: int = 16, seed: int = 7,
                         tile_rows: int = TILE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                       F.col("label").cast("long").alias("label"))
    sound = ("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0 and "
             "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")
    v = v.withColumn("sound", F.expr(sound)).withColumn("embedding", F.expr("transform(embedding, x -> x + 0.0D)"))
    v = v.withColumn("print", F.when(F.col("sound"), F.sha2(F.concat_ws(",", F.col("embedding").cast("array<string>")), 256)))
    keyed = v.select("vec_id", "label", "print")
    classes = written(v.where("sound").groupBy("label", "print").agg(
        F.min("vec_id").alias("class"), F.count("*").alias("n"), F.min("embedding").alias("embedding")), "vector-classes")
    # a class's name is unique: copies in another label have other ids
    coded = written(hashed(classes.select("class", "label", "n", "embedding"), bits, tables, seed), "vector-codes")
    rows = coded.select("*", F.posexplode("codes").alias("table", "code"))
    bucket = ["label", "dim", "table", "code"]
    full = rows.groupBy(*bucket).agg(F.count("*").alias("rows")).where("rows > 1").withColumn(
        "parts", F.ceil(F.col("rows") / tile_rows).cast("int")).drop("rows")
    met = rows.join(full, bucket).withColumn("part", F.expr("cast(pmod(xxhash64(class), parts) as int)"))
    dealt = met.withColumn("q", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("p1", F.least("part", "q")).withColumn("p2", F.greatest("part", "q"))
    found = written(bucket_links(dealt, least), "vector-links")
    linked = components(found.where("other is not null").select("class", "other"), "class", "other")
    links = found.where("other is null").groupBy("class").agg(F.sum("links").alias("links"))
    of = classes.select("label", "print", "class", "n").join(links, "class", "left").join(
        linked.withColumnRenamed("node", "class"), "class", "left")
    out = keyed.join(of, ["label", "print"], "left")
    component = F.coalesce("component", "class", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
