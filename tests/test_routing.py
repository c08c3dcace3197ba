"""Rows on their way to the leaves of boosted trees."""

import numpy as np

from rentlens.operators import leafwise as L
from rentlens.plans import model_queries as MQ
from tests.conftest import SF_SMALL


def grown(rng, leaves):
    """A lopsided tree whose leaves are numbered."""
    trees = [float(i) for i in range(leaves)]
    while len(trees) > 1:
        i = int(rng.integers(0, len(trees) - 1))
        trees[i: i + 2] = [(int(rng.integers(0, 3)), int(rng.integers(0, 9)), trees[i], trees[i + 1])]
    return trees[0]


def one_by_one(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_routed_equals_row_by_row():
    rng = np.random.default_rng(8)
    for leaves in (1, 2, 31, 64, 65, 300):
        tree = grown(rng, leaves)
        bins = rng.integers(0, 10, (3, 400)).astype(np.int16)
        values = np.where(bins == 4, np.nan, bins.astype(float))
        for x in (bins, values):
            assert L.routed(tree, x).tolist() == [one_by_one(tree, r) for r in x.T]
        assert len(L.routed(tree, bins[:, :0])) == 0


def test_small_trees_compare_columns_and_pick_no_rows():
    """Each level picked its node's rows one by one, which took most of a fit's time."""

    class Column(np.ndarray):
        def __getitem__(self, at):
            assert self.ndim == 2 and not isinstance(at, np.ndarray), "rows were picked"
            return super().__getitem__(at)

    rng = np.random.default_rng(9)
    tree = grown(rng, L.LEAVES)
    bins = rng.integers(0, 10, (3, 50)).astype(np.int16)
    assert L.routed(tree, bins.view(Column)).tolist() == L.routed(tree, bins).tolist()


def test_listings_are_derived_once_for_fit_and_records(spark, monkeypatch):
    """The records to score were derived from the text again."""
    derived = []
    split = MQ.split_listings
    monkeypatch.setattr(MQ, "split_listings", lambda *a: (derived.append(a), split(*a))[1])
    rows = MQ._model_rows(spark, SF_SMALL)
    assert sorted(MQ.scoring_records(spark, SF_SMALL, rows).collect(), key=str) == sorted(MQ.scoring_records(spark, SF_SMALL).collect(), key=str)
    derived.clear()
    monkeypatch.setattr(MQ, "challenger", lambda *a: MQ.champion(*a))
    assert MQ.q_batch_score_challenger(spark, SF_SMALL).columns == ["listing_id", "prediction"] and len(derived) == 1
