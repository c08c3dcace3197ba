"""Exact top-k search by inner product of quantised vectors, with MaxScore.

Each component x becomes ``floor(scale * x)``.  In a shard a dimension is a
term: a candidate's impact on it is its distance from the worst value that the
shard has for the query's sign, so impacts are never negative and the score is a
constant of the query plus the weighted impacts.  A term's bound is its weight
times its largest impact.  A query's terms are sorted by bound; while the bounds
of the smallest together cannot lift a candidate over the query's k-th score,
they are non-essential.  Essential postings are traversed for all candidates;
the others are probed only for candidates that can still compete.  The threshold
rises with every block of candidates.

Candidates are hashed to shards of about ``shard_rows`` rows; every query goes to
every shard, streams through it, and its best ``k`` of all shards are merged.
Queries grow as the table does, so they are never broadcast.

Ties go to the smaller vec_id.  Vectors that are null or hold null or non-finite
components, and rows without a vec_id, take no part, neither as query nor as
candidate.  Rows that repeat id and vector count once.  Vectors of different
lengths are compared as if the shorter ended in zeros.  Scores beyond the range of a
long are cut to it.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentlens.llm.common import written

SHARD_ROWS = 16_000
BLOCK = 1024
#: Sums of products below this stay exact in double precision.
EXACT = 2.0**51


class Shard:
    """The candidates of one shard, term by term."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.low, self.high = self.values.min(axis=0), self.values.max(axis=0)
        self.exact = values.shape[1] * float(np.abs(values).max(initial=0)) ** 2 < EXACT

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the ``k`` best, best first, ties to the smaller id."""
        dim = self.values.shape[1]
        if not self.exact or dim * float(np.abs(q).max(initial=0)) * float(np.abs(self.values).max(initial=0)) >= EXACT:
            return self._plain(query_id, q, k)
        worst = np.where(q > 0, self.low, self.high) * q  # the least a term can add
        bound = np.where(q > 0, self.high, self.low) * q - worst
        terms = np.argsort(-bound, kind="stable")
        left = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0.0]])  # bounds from this term on
        base = worst.sum()
        best_ids, best = np.empty(0, np.int64), np.empty(0)
        for at in range(0, len(self.ids), BLOCK):
            rows = np.arange(at, min(at + BLOCK, len(self.ids)))
            rows = rows[self.ids[rows] != query_id]
            if not len(rows):
                continue
            floor = best[-1] if len(best) == k else -np.inf
            # essential terms: until the rest alone cannot reach the k-th score
            essential = int(np.searchsorted(-(base + left), -floor, side="left")) if floor > -np.inf else dim
            essential = max(1, min(dim, essential))
            t = terms[:essential]
            score = base + (self.values[np.ix_(rows, t)] * q[t] - worst[t]).sum(axis=1)
            while essential < dim:
                keep = score + left[essential] > floor
                rows, score = rows[keep], score[keep]
                if not len(rows):
                    break
                step = min(dim, essential + 8)
                t = terms[essential:step]
                score = score + (self.values[np.ix_(rows, t)] * q[t] - worst[t]).sum(axis=1)
                essential = step
            keep = score > floor  # equal scores of larger ids come after
            ids, score = np.concatenate([best_ids, self.ids[rows[keep]]]), np.concatenate([best, score[keep]])
            order = np.lexsort((ids, -score))[:k]
            best_ids, best = ids[order], score[order]
        return best_ids, best.astype(np.int64)

    def _plain(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Integers too large for doubles: exact sums of Python integers."""
        qi = [int(x) for x in q]
        rows = [(-sum(int(a) * b for a, b in zip(v, qi) if a and b), int(i)) for i, v in zip(self.ids, self.values) if i != query_id]
        best = sorted(rows)[:k]
        top = np.iinfo(np.int64)
        return np.array([i for _, i in best], np.int64), np.array([min(max(-s, top.min), top.max) for s, _ in best], np.int64)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of ``vectors`` with the highest score for each query row."""
    v = vectors.withColumn("is_query", F.coalesce(is_query, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "is_query")
    v = v.where("vec_id is not null and embedding is not null and "
                "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    v = v.withColumn("print", F.xxhash64(F.col("embedding").cast("array<string>"))).dropDuplicates(["vec_id", "print"])
    # floor by the double itself: a cast to long would cut huge values
    v = written(v.select("vec_id", "embedding", "is_query"), "vectors")
    n, width = v.agg(F.count("*"), F.max(F.size("embedding"))).first()
    shards = max(1, -(-n // shard_rows))
    candidates = v.select(F.expr(f"cast(pmod(xxhash64(vec_id), {shards}) as int)").alias("shard"), F.lit(False).alias("asks"), "vec_id", "embedding")
    asks = v.where("is_query").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, rows, index = None, [], [], None
        for batch in batches:
            out: list[tuple] = []
            for shard, query, vec, x in zip(*(batch.column(c).to_pylist() for c in ("shard", "asks", "vec_id", "embedding"))):
                if shard != number:
                    number, ids, rows, index = shard, [], [], None
                y = np.zeros(width)
                y[: len(x)] = np.floor(scale * np.array(x, np.float64))
                if not query:
                    ids.append(vec)
                    rows.append(y)
                    continue
                if index is None and ids:
                    index, rows = Shard(np.array(ids, np.int64), np.array(rows)), []
                if index is not None:
                    out += [(vec, i, s) for i, s in zip(*(a.tolist() for a in index.search(vec, y, k)))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["query_id", "vec_id", "score"])

    both = candidates.unionByName(asks).repartition("shard").sortWithinPartitions("shard", "asks", "vec_id")
    found = both.select("shard", "asks", "vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
