"""Out-of-fold predictions and the band of the estimated loss."""

import numpy as np

from pyspark.sql import functions as F

from rentlens.operators.drift import out_of_fold
from rentlens.plans.catalog import QUERIES as Q
from tests.conftest import SF_SMALL


def test_no_row_is_predicted_by_a_model_that_saw_it(spark):
    df = spark.range(300).selectExpr("id", "id % 17 + 0.5 AS a", "(id * 31) % 23 * 1.0 AS b", "(id * id) % 29 + id % 17 * 2.0 AS y")
    got = out_of_fold(df, "y", ["a", "b"], "id", folds=4).withColumn("fold", F.expr("pmod(xxhash64(id), 4)")).toPandas().astype(float)
    x = np.column_stack([got.a, got.b, np.ones(len(got))])
    assert set(got.fold) == {0, 1, 2, 3}
    for k in range(4):
        out = (got.fold == k).to_numpy()
        beta, *_ = np.linalg.lstsq(x[~out], got.y.to_numpy()[~out], rcond=None)
        np.testing.assert_allclose(got.predicted[out], x[out] @ beta, rtol=1e-9)


def test_band_covers_the_realised_loss_on_most_days(spark):
    d = Q["estimated_mae_daily"](spark, SF_SMALL).toPandas().dropna()
    assert (d.lower <= d.estimated_mae).all() and (d.estimated_mae <= d.upper).all()
    inside = (d.lower <= d.realised_mae) & (d.realised_mae <= d.upper)
    assert len(d) > 100 and inside.mean() >= 0.95, inside.mean()
