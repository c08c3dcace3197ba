"""Blocks of the n-gram join on tables whose documents are unlike."""

import numpy as np
from pyspark.sql import functions as F

from rentlens.llm import ngram_join as J


def test_unlike_members_do_not_make_blocks(spark):
    """Members were told apart by 32 bits: with many documents chance meetings joined nearly all of them into one block."""
    words = spark.range(300_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text")).repartition(4)
    signed = J.signatures(words, 4, 85)
    assert signed.select(F.explode("keys")).distinct().count() == 300_000
    assert J.blocks(signed, 85).isEmpty()


def test_large_blocks_are_parted_before_their_sets_move(spark, monkeypatch):
    """A block of unlike documents, joined by chains of shared members, sent each one's set to several tiles."""
    grid = [(i, f"a{i % 50} b{i // 50}") for i in range(2500)]
    long = [f"u{k}" for k in range(90)]
    near = [(3000 + i, " ".join(long[:80] + [f"a{i}", f"b{i}"] + long[80 + i % 3:])) for i in range(9)]
    moved = []
    arrays = J.member_arrays
    monkeypatch.setattr(J, "member_arrays", lambda docs, n: (moved.append(docs.count()), arrays(docs, n))[1])
    docs = spark.createDataFrame(grid + near, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in J.ngram_jaccard_join(docs, n=1, percent=50, tile_rows=40).collect()}
    assert {i for i, c in got.items() if c != i} == set(range(3001, 3009)) and got[3008] == 3000
    assert len(moved) == 1 and 9 <= moved[0] < 1000  # chance meetings in the bitmaps remain


def test_bitmaps_of_different_size_compare(spark):
    rng = np.random.default_rng(4)
    s = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    short, folded = J.alike([J.parity_bitmap(s).tobytes(), J.parity_bitmap(s, 4096).tobytes()])
    assert (short == folded).all() and len(short) == J.BITMAP // 64
