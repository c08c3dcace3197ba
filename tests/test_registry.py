"""Aliases and runs of saved models, records by position, distinct values in order."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rentlens.operators import models as M
from rentlens.operators.relational import distinct_in_order
from rentlens.operators.score import score_positional
from rentlens.plans import model_queries as MQ
from rentlens.plans.catalog import QUERIES as Q
from rentlens.schema import FEATURES, TARGET
from rentlens.session import scratch_path
from tests.conftest import SF_SMALL


def test_concurrent_writers_lose_and_mix_nothing(spark):
    root = scratch_path(spark, "race")

    def write(i):
        return M.set_aliases(spark, root, {"passed": f"p{i}", "challenger": f"c{i}", f"own{i}": f"o{i}"})

    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(write, range(8)))
    assert M._entries(spark, root).select("entry").distinct().count() == 8
    assert [M.alias_version(spark, root, f"own{i}") for i in range(8)] == [f"o{i}" for i in range(8)]
    passed, challenger = (M.alias_version(spark, root, a) for a in ("passed", "challenger"))
    assert passed[1:] == challenger[1:] and numbers[int(passed[1:])] == max(numbers)
    after = M.set_alias(spark, root, "passed", "later")
    assert after == max(numbers) + 1 and M.alias_version(spark, root, "passed") == "later"
    assert M.alias_version(spark, root, "challenger") == challenger


def test_only_a_run_below_the_gate_is_loaded(spark):
    root, runs, model = scratch_path(spark, "models"), scratch_path(spark, "runs"), MQ.champion(spark, SF_SMALL)
    a, b = M.save_version(model, root), M.save_version(model, root)
    M.log_run(spark, runs, "bad", {}, {"mse": 4.0}, a)
    M.log_run(spark, runs, "unsaved", {}, {"mse": 0.1})
    assert M.reload_if_passed(spark, root, runs) == (None, None) and M.alias_version(spark, root, "passed") is None
    M.log_run(spark, runs, "good", {}, {"mse": 2.0}, a)
    loaded, version = M.reload_if_passed(spark, root, runs)
    assert loaded is not None and version == a == M.alias_version(spark, root, "passed")
    assert M.reload_if_passed(spark, root, runs, held=a) == (None, a)
    M.log_run(spark, runs, "better", {}, {"mse": 1.0}, b)
    assert M.reload_if_passed(spark, root, runs, held=a)[1] == b == M.alias_version(spark, root, "passed")


def test_registry_scores_equal_the_models_in_memory(spark):
    got = Q["model_registry_scores"](spark, SF_SMALL).toPandas().set_index("listing_id").sort_index()
    models = {"champion": MQ.champion(spark, SF_SMALL), "challenger": MQ.challenger(spark, SF_SMALL)}
    want = MQ.score_many(models, MQ._test(spark, SF_SMALL), keep=[TARGET]).toPandas().set_index("listing_id").sort_index()
    np.testing.assert_allclose(got.challenger, want.challenger, rtol=1e-12)
    mse = {n: ((want[TARGET] - want[n]) ** 2).mean() for n in models}
    best = min(mse, key=mse.get)
    if mse[best] < M.MSE_GATE:
        np.testing.assert_allclose(got.passed, want[best], rtol=1e-12)
    else:
        assert got.passed.isna().all()


def test_positional_equals_by_name_and_refuses_other_types(spark):
    test, model = MQ._test(spark, SF_SMALL), MQ.champion(spark, SF_SMALL)
    x = F.array(*[F.col(c).cast("double") for c in FEATURES])
    named = MQ.score(model, test).withColumnRenamed("prediction", "by_name")
    both = score_positional(model, test.select("listing_id", x.alias("record"), F.lit("k").alias("reason")), keep=["record"])
    both = both.join(named, "listing_id").toPandas()
    np.testing.assert_allclose(both.prediction, both.by_name, rtol=1e-12)
    assert both["reason"].isna().all()
    for bad in (x.cast("array<int>"), x.cast("array<string>"), F.lit(1.0)):
        with pytest.raises(ValueError, match="array<double>"):
            score_positional(model, test.select("listing_id", bad.alias("record")))
    odd = spark.sql("SELECT 1L AS listing_id, CAST(NULL AS array<double>) AS record UNION ALL SELECT 2L, array(1D, 2D) "
                    "UNION ALL SELECT 3L, array(1D, double('NaN'), 1D, 1D, double('inf'), NULL, 1D)")
    got = {r["listing_id"]: (r["prediction"], r["reason"]) for r in score_positional(model, odd).collect()}
    assert got == {1: (None, "record:missing"), 2: (None, "record:width 2"),
                   3: (None, ",".join(f"{FEATURES[i]}:missing" for i in (1, 4, 5)))}


def test_distinct_in_order_equals_pandas_over_many_files(spark):
    path = scratch_path(spark, "in-order")
    spark.range(5000).selectExpr("id", "nullif((id * 7919) % 313, 5) AS v").repartition(6).write.parquet(path)
    files = sorted(r[0] for r in spark.read.parquet(path).select(F.col("_metadata.file_path")).distinct().collect())
    whole = pd.concat([pd.read_parquet(f.removeprefix("file:")) for f in files])
    got = [r["value"] for r in distinct_in_order(spark.read.parquet(path), F.col("v")).collect()]
    assert len(files) > 1 and got == [None if pd.isna(v) else int(v) for v in whole.v.unique()]
    assert distinct_in_order(spark.read.parquet(path).where("id < 0"), F.col("v")).count() == 0
