"""Helpers shared by the corpus operators: words, scratch tables, connected components."""

from __future__ import annotations

import gc
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.session import scratch_path

#: Rows per Arrow batch that an operator hands back at a time; bounds a worker's memory.
OUT_ROWS = 2000
#: Fixed odd multiplier of the polynomial hash modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}
#: Folder of each live table made by ``written``.
_PATHS: dict[int, tuple] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def carried(df: DataFrame, added: list[str]) -> list[str]:
    """Columns of ``df`` that an operator passes on: all but those, in any case, that it adds."""
    low = {a.lower() for a in added}
    return [c for c in df.columns if c.lower() not in low]


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out, lambda _, k=id(out): _PATHS.pop(k, None)), path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more (what was made of them is written itself)."""
    for df in tables:
        _, path = _PATHS.pop(id(df), (None, None))
        jvm = df.sparkSession.sparkContext._jvm
        if path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if tables:
        free_shuffles(tables[0].sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Collect the driver's garbage: Spark deletes the shuffle files of finished steps only when their plans have been collected.

    A small job goes first: until the next one, the scheduler holds the last task that it saw, and through a cogroup's task its tables.
    """
    spark.range(0, 1, 1, 1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``fn`` (one record batch in, dicts of column lists out) over every batch of ``df``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    target = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(target)
        for batch in batches:
            for cols in fn(batch):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type, from_pandas=False)
                     for f, c in ((f, cols[f.name]) for f in arrow)], schema=arrow)
            pa.default_memory_pool().release_unused()  # else a worker keeps its largest batch's memory

    return df.mapInArrow(run, target)


def sliced(batch: pa.RecordBatch, rows: int = OUT_ROWS, chars: int = 8 << 20, text: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``rows`` rows and about ``chars`` bytes of column ``text``."""
    n = batch.num_rows
    if text is None:
        for i in range(0, n, rows):
            yield batch.slice(i, rows)
        return
    import pyarrow.compute as pc
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i in range(n):
        held += int(size[i])
        if held >= chars or i + 1 - start >= rows:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < n:
        yield batch.slice(start, n - start)


def byte_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that their order is as good as random."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        m = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS["up"] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, BASE, np.uint64))])
            _POWERS["down"] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, inverse, np.uint64))])
    return _POWERS["up"], _POWERS["down"]


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive symbols (empty if there are fewer)."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n], dtype=np.uint64)])
        return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` consecutive values (``len(x) >= w``)."""
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal consecutive values."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return at, np.diff(np.append(at, len(keys)))


def list_array(values: np.ndarray, lengths, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Alternates the large-star and small-star steps: each links a node's
    neighbours to the smallest of them, so that the graph becomes a forest of
    stars in O(log n) rounds.  A round is two joins on the node.  A hot centre's
    rows are narrow, but they meet in one task: the aggregate and the join on the node
    share a shuffle, which AQE then does not split.  Each round's edges are written to the
    shared folder.  Nothing but a count and a checksum reaches the driver.
    """
    e = written(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
                .where("u <> v").distinct(), "cc")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    mark = None
    for _ in range(max_rounds):
        # large star: every neighbour above a node goes to the node's smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every neighbour below a node, and the node, goes to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u")
        small = pairs.select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        before, e = e, written(small, "cc")
        discard(before)
        row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(row):
            break
        mark = tuple(row)
    else:
        raise RuntimeError("connected components did not settle")
    stars = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    centres = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(centres)


class Forest:
    """Union-find over 0..n-1 with the smaller index as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                break
            up = nxt
        self.up = up
        return up
