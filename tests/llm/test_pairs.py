"""N-gram join, substring dedup, embedding near-dedup and top-k search against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentlens.llm.common import components
from rentlens.llm.embedding_dedup import embedding_near_dedup
from rentlens.llm.fm_index import FMIndex
from rentlens.llm.ngram_join import ngram_jaccard_join, overlap
from rentlens.llm.substring_dedup import substring_dedup
from rentlens.llm.topk_search import Shard, exact_top_k
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=5, n=60):
    """Random texts, copies, near copies, a shared line and passage, odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "do", "ki", "ra", "no"]) for _ in range(rng.randint(1, 4)))
    line = " ".join(word() for _ in range(12))
    passage = " ".join(word() for _ in range(75))
    texts = []
    for i in range(n):
        w = [word() for _ in range(rng.choice([1, 3, 8, 60, 120, 200]))]
        if i % 3 == 0:
            w[len(w) // 2: len(w) // 2] = line.split()
        if i % 4 == 0:
            w[len(w) // 3: len(w) // 3] = passage.split()
        texts.append(" ".join(w))
    for i in range(0, n, 4):
        texts.append(texts[i])
        w = texts[i].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append("\t".join(w).upper())
    texts += [None, "", "  \n ", "one", "One", "same " * 300, "same " * 320]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(d, texts[i]) for i, d in enumerate(order)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)


@pytest.mark.parametrize("n,percent,tile", [(4, 85, 3000), (5, 80, 4)])
def test_ngram_join(spark, n, percent, tile):
    rows = corpus()
    sets, low = brute.jaccard_components(rows, n, percent)
    assert sum(low[d] != d for d in low) > 10
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(frame(spark, rows), n, percent, tile).collect()}
    assert got == {d: (len(sets[d]), low[d]) for d, _ in rows}


def test_ngram_join_odd_rows(spark):
    df = frame(spark, [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "A B C D E"), (3, None)])
    df = df.withColumn("component_id", F.lit("clash")).withColumn("size", F.lit(1)).withColumn("key", F.lit(2))
    got = sorted(map(tuple, ngram_jaccard_join(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 2, 1), (3, 0, 3)], key=str)
    assert ngram_jaccard_join(df.where("false")).count() == 0


def test_overlap_of_sorted_arrays():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(2))
        assert overlap(a, b) == len(np.intersect1d(a, b))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 560)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == brute.components(nodes, [(a, b) for a, b in links if a != b])


@pytest.mark.parametrize("hot", [4000, 1])
def test_substring_dedup(spark, hot):
    rows = corpus(seed=8)
    want = brute.cut(rows, 50)
    out = substring_dedup(frame(spark, rows), hot_segments=hot, shard_words=3000)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "n_removed", "kept_text"]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out.collect()}
    assert got == {d: (len(w), len(w) - len(k), " ".join(k)) for d, (w, k) in want.items()}
    assert sum(n for _, n, _ in got.values()) > 1000


def test_substring_dedup_small_windows(spark):
    rng = random.Random(4)
    rows = [(d, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for d in range(40)]
    want = brute.cut(rows, 6)
    got = {r.doc_id: r.kept_text for r in substring_dedup(frame(spark, rows), window=6, anchor=3, hot_segments=5).collect()}
    assert got == {d: " ".join(k) for d, (_, k) in want.items()}


def test_substring_dedup_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = frame(spark, [(None, text), (2, text), (2, text), (5, text + " x"), (7, None), (8, "")])
    df = df.withColumn("row", F.lit("r")).withColumn("n_words", F.lit("clash")).withColumn("anchor", F.lit(1))
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df).collect()), key=str)
    assert got == sorted([(None, 60, 0, text), (2, 60, 0, text), (2, 60, 0, text), (5, 61, 60, "x"), (7, 0, 0, ""), (8, 0, 0, "")], key=str)
    assert substring_dedup(df.where("false")).count() == 0


def test_matching_statistics():
    rng = random.Random(1)
    for _ in range(40):
        segments = [np.array([rng.randint(1, 3) for _ in range(rng.randint(1, 25))]) for _ in range(6)]
        lanes = [np.array([rng.randint(0, 3) for _ in range(rng.randint(1, 25))]) for _ in range(5)]
        depth = rng.choice([3, 5, 8])
        index = FMIndex(segments, 4, depth)
        for col, lane, length, lo, hi, width in index.matching_statistics(lanes):
            for i, n, a, b in zip(lane, length, lo, hi):
                at, best, count = col - (width - len(lanes[i])), 0, index.n
                for size in range(1, depth + 1):
                    want = lanes[i][at: at + size].tolist()
                    found = sum(s[j: j + size].tolist() == want for s in segments for j in range(len(s) - size + 1))
                    if len(want) == size and found and 0 not in want:
                        best, count = size, found
                assert (n, b - a) == (best, count)


def test_matches_longer_than_a_byte():
    """Two segments share 300 symbols: both suffixes are found, not only one of them."""
    rng = np.random.default_rng(2)
    shared = rng.integers(1, 9, 300)
    segments = [np.concatenate([shared, [9, 1]]), np.concatenate([[7], shared, [10, 2]])]
    index = FMIndex(segments, 10, 300)
    got = [(int(n), int(b - a)) for col, _, length, lo, hi, _ in index.matching_statistics([np.concatenate([shared, [9, 1]])]) for n, a, b in zip(length, lo, hi) if col == 0]
    assert got == [(300, 2)]


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    for label in (0, 1, 2):
        for _ in range(25):
            base = rng.standard_normal(16)
            for _ in range(rng.choice([1, 1, 2, 5])):
                rows.append((at, (base + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.12])).astype(np.float32).tolist(), label))
                at += 1
    same = rng.standard_normal(16).astype(np.float32).tolist()
    rows += [(at + i, same, 1) for i in range(40)] + [(at + 40, same, 2), (at + 41, same, None), (at + 42, None, 1),
             (at + 43, [0.0] * 16, 1), (at + 44, [0.0] * 16, 1), (at + 45, [float("nan")] * 16, 1), (at + 46, [None] + same[1:], 1),
             (at + 47, [float("inf")] + same[1:], 1), (at + 48, [], 1), (at + 49, [2 * x for x in same], 1), (at + 50, [1e30] * 16, 1)]
    return rows


@pytest.mark.parametrize("tile", [1500, 7])
def test_embedding_near_dedup(spark, tile):
    rows = vectors()
    ok = {}
    for i, e, l in rows:
        if e and l is not None and all(x is not None and np.isfinite(x) for x in e) and any(e):
            ok[i] = (np.array(e, np.float64), l)
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1]
             and ok[a][0] @ ok[b][0] / np.sqrt((ok[a][0] @ ok[a][0]) * (ok[b][0] @ ok[b][0])) >= 0.98]
    low = brute.components([r[0] for r in rows], links)
    degree = {r[0]: 0 for r in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept)
           for r in embedding_near_dedup(spark.createDataFrame(rows, VECTORS), tile_rows=tile).collect()}
    assert got == {i: (degree[i], low[i], low[i] == i) for i, _, _ in rows}


def test_embedding_near_dedup_recall(spark):
    """Pairs just above the threshold, the hardest to find: at least 0.99 of them."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(0, 600, 2):
        a, b = rng.standard_normal((2, 64))
        a /= np.sqrt(a @ a)
        b -= (a @ b) * a
        b /= np.sqrt(b @ b)
        rows += [(i, a.tolist(), 1), (i + 1, (0.9802 * a + np.sqrt(1 - 0.9802**2) * b).tolist(), 1)]
    got = embedding_near_dedup(spark.createDataFrame(rows, VECTORS)).where("n_links = 1").count()
    assert got >= 0.99 * 600
    assert embedding_near_dedup(spark.createDataFrame([], VECTORS)).count() == 0


def top_k(rows, k):
    ok = {i: [int(np.floor(1024 * np.float64(np.float32(x)))) for x in e] for i, e, _ in rows
          if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = set()
    for q in ok:
        if q % 10 == 0:
            scored = sorted((-sum(x * y for x, y in zip(ok[q], ok[c])), c) for c in ok if c != q)[:k]
            out |= {(q, r + 1, c, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, c) in enumerate(scored)}
    return out


@pytest.mark.parametrize("shard", [16_000, 30])
def test_exact_top_k(spark, shard):
    rows = vectors()
    rows = rows + rows[:15]
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("clash")).withColumn("shard", F.lit(1))
    got = {tuple(r) for r in exact_top_k(df, F.col("vec_id") % 10 == 0, k=4, shard_rows=shard).collect()}
    assert got == top_k(rows, 4)
    assert exact_top_k(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0


def test_shard_search_with_many_ties():
    rng = np.random.default_rng(2)
    values = rng.integers(-3, 4, (5000, 12)).astype(float)
    ids = rng.permutation(5000)
    shard = Shard(ids, values)
    for q in rng.integers(-3, 4, (20, 12)).astype(float):
        want = sorted(zip((-(values @ q)).tolist(), ids.tolist()))[:7]
        got_ids, got = shard.search(-1, q, 7)
        assert list(zip((-got).tolist(), got_ids.tolist())) == [(int(s), i) for s, i in want]
