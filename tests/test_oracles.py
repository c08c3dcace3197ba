"""Every registered query with an oracle equals DuckDB on the same tables.

Fast queries are checked at sf0.01 (the driver's scale).  Queries that
write much are compared at sf0.001; those of tree models
and the run log, which SQL cannot express, are in test_models.
"""

import pytest

import __spark_entry__ as E
from rentlens.plans.catalog import ORACLES, QUERIES
from tests.conftest import SF_CHECK, SF_SMALL
from tests.oracle_check import compare

SLOW = {"sink_dated_partitions", "stream_daily_metrics", "stream_daily_metrics_all", "stream_clean_listings", "html_extract_listings"}


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n not in SLOW))
def test_query_matches_oracle(spark, name):
    r = compare(spark, name, SF_CHECK, QUERIES[name], ORACLES[name])
    assert r["rows_match"] and r["schema_match"] and r["hash_match"] and r["dtype_match"], r


@pytest.mark.parametrize("name", sorted(SLOW))
def test_slow_query_matches_oracle_small(spark, name):
    r = compare(spark, name, SF_SMALL, QUERIES[name], ORACLES[name])
    assert r["rows_match"] and r["schema_match"] and r["hash_match"] and r["dtype_match"], r


def test_only_these_queries_have_no_oracle():
    assert set(QUERIES) - set(ORACLES) == {
        "gbt_challenger_predictions", "batch_score_challenger", "champion_challenger_compare", "model_run_log", "model_registry_scores", "estimated_mae_daily"}


def test_entry_registers_every_query():
    assert set(E.queries()) >= set(QUERIES) and set(E.oracle_sql()) >= set(ORACLES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["ku_name", "bargain_rank", "listing_id", "rent_price", "sqr_m", "predicted_rent",
                          "residual"]
