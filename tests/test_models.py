"""Model-based (rows-only) queries against brute force on a small fixture."""

import numpy as np
import pytest

from rentlens.operators import models as M
from rentlens.plans import model_queries as MQ
from rentlens.plans.catalog import QUERIES as Q
from rentlens.schema import FEATURES, TARGET
from rentlens.session import scratch_path
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def split_pd(spark):
    return MQ.split_listings(spark, SF_SMALL).select("listing_id", "split", *FEATURES, TARGET).toPandas()


def lstsq(train):
    X = np.column_stack([train[FEATURES].to_numpy(float), np.ones(len(train))])
    beta, *_ = np.linalg.lstsq(X, train[TARGET].to_numpy(float), rcond=None)
    return X, beta


def test_champion_predictions_equal_least_squares(spark, split_pd):
    _, beta = lstsq(split_pd[split_pd.split == "train"].dropna())
    test = split_pd[split_pd.split == "test"].sort_values("listing_id")
    Xt = np.column_stack([test[FEATURES].to_numpy(float), np.ones(len(test))])
    got = Q["ols_champion_predictions"](spark, SF_SMALL).toPandas().sort_values("listing_id")
    assert list(got.listing_id) == list(test.listing_id)
    np.testing.assert_allclose(got.prediction.to_numpy(), Xt @ beta, rtol=0, atol=1e-6)


def test_summary_equals_the_closed_form(spark):
    """Standard errors, limits, F, log-likelihood, AIC and BIC from the design matrix, by numpy."""
    got = M.ols_coefficient_table(spark, *M.fit_formula_ols(MQ._train(spark, SF_SMALL), MQ.FORMULA)).toPandas()
    design = Q["formula_design_matrix"](spark, SF_SMALL).toPandas()
    x = np.column_stack([np.array(design.features.tolist()), np.ones(len(design))])
    y = design.label.to_numpy()
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    n, k = x.shape
    rss = float(((y - x @ beta) ** 2).sum())
    se = np.sqrt(rss / (n - k) * np.diag(np.linalg.inv(x.T @ x)))
    np.testing.assert_allclose(got.coef, beta, rtol=1e-5, atol=1e-7)
    np.testing.assert_allclose(got.std_err, se, rtol=1e-5)
    np.testing.assert_allclose(got.t_value, beta / se, rtol=1e-4, atol=1e-5)
    half = (got.upper - got.lower) / 2 / got.std_err
    assert half.nunique() >= 1 and half.iloc[0] == pytest.approx(1.962, abs=0.01)
    one = got.iloc[0]
    tss = float(((y - y.mean()) ** 2).sum())
    assert one.n == n and one.r2 == pytest.approx(1 - rss / tss) and one.f_value == pytest.approx((tss - rss) / (k - 1) / (rss / (n - k)), rel=1e-6)
    loglik = -n / 2 * (np.log(2 * np.pi * rss / n) + 1)
    assert one.log_likelihood == pytest.approx(loglik) and one.aic == pytest.approx(2 * k - 2 * loglik) and one.bic == pytest.approx(k * np.log(n) - 2 * loglik)


def test_roundtrip_equals_in_memory_models(spark):
    root, test = scratch_path(spark, "models"), MQ._test(spark, SF_SMALL)
    models = {"passed": MQ.champion(spark, SF_SMALL), "challenger": MQ.challenger(spark, SF_SMALL)}
    for alias, model in models.items():
        M.set_alias(spark, root, alias, M.save_version(model, root))
    again = {alias: M.load_model(spark, root, alias) for alias in models}
    a, b = (MQ.score_many(m, test).toPandas().set_index("listing_id").sort_index() for m in (models, again))
    np.testing.assert_allclose(a.to_numpy(), b.to_numpy(), rtol=1e-12)


def test_stream_score_equals_batch_score(spark):
    s = Q["stream_score"](spark, SF_SMALL).toPandas().set_index("listing_id").sort_index()
    b = Q["batch_score_champion"](spark, SF_SMALL).toPandas().set_index("listing_id").sort_index()
    assert list(s.index) == list(b.index) and s.prediction.isna().any()
    np.testing.assert_allclose(s.prediction.to_numpy(), b.prediction.to_numpy(), rtol=1e-9)


def test_challenger_binds_features_by_name(spark):
    test = MQ._test(spark, SF_SMALL)
    model = MQ.challenger(spark, SF_SMALL)
    a = MQ.score(model, test.select("listing_id", *reversed(FEATURES))).toPandas().set_index("listing_id").sort_index()
    b = Q["gbt_challenger_predictions"](spark, SF_SMALL).toPandas().set_index("listing_id").sort_index()
    np.testing.assert_allclose(a.prediction.to_numpy(), b.prediction.to_numpy(), rtol=1e-12)


def patience_by_hand(errors, patience):
    """Walk the rounds, remember the best, end when it is ``patience`` rounds old."""
    best = 0
    for i in range(1, len(errors)):
        if errors[i] < errors[best]:
            best = i
        if i - best == patience:
            break
    return best + 1


def test_boosting_keeps_the_best_round(spark):
    split = MQ.split_listings(spark, SF_SMALL).select("split", *FEATURES, TARGET)
    train, held = split.where("split = 'train'"), split.where("split = 'test'")
    model, errors = M.fit_gbt_best(train, held, maxIter=25, patience=4, stepSize=0.6)
    assert len(errors) == 25 and model.stages[-1].getNumTrees == patience_by_hand(errors, 4)
    assert M.held_out_errors(model, held)[-1] == pytest.approx(errors[model.stages[-1].getNumTrees - 1], rel=1e-9)
    pred = MQ.score(model, held, key=TARGET).toPandas().dropna()
    assert float(((pred[TARGET] - pred.prediction) ** 2).mean()) == pytest.approx(errors[model.stages[-1].getNumTrees - 1], rel=1e-6)


@pytest.mark.parametrize("errors", [[3, 2, 1], [1, 2, 3, 4, 0.5], [2, 2, 2], [5, 4, 4.5, 4.6, 3, 3.5], [1]])
def test_patience_rule(errors):
    for patience in (1, 2, 3, 10):
        assert M.best_round(errors, patience) == patience_by_hand(errors, patience)


def test_failing_model_leaves_the_alias(spark):
    root = scratch_path(spark, "gate")
    model = MQ.champion(spark, SF_SMALL)
    assert M.alias_version(spark, root, "passed") is None
    assert not M.promote(spark, model, 4.0, root) and M.alias_version(spark, root, "passed") is None
    assert not M.promote(spark, model, float("nan"), root)
    assert M.promote(spark, model, 3.9, root)
    version = M.alias_version(spark, root, "passed")
    assert not M.promote(spark, model, 9.0, root) and M.alias_version(spark, root, "passed") == version
    assert M.promote(spark, model, 1.0, root) and M.alias_version(spark, root, "passed") != version
    with pytest.raises(ValueError, match="challenger"):
        M.load_model(spark, root, "challenger")


def test_challenger_budget_and_quality(spark, split_pd):
    model = MQ.challenger(spark, SF_SMALL)
    assert 1 <= model.stages[-1].getNumTrees <= 100
    cmp = Q["champion_challenger_compare"](spark, SF_SMALL).toPandas().set_index("model")
    test = split_pd[split_pd.split == "test"].dropna()
    baseline = float(np.mean((test[TARGET] - test[TARGET].mean()) ** 2))
    assert cmp.loc["challenger", "mse"] < baseline and cmp.loc["champion", "mse"] < baseline
    assert cmp.winner.sum() >= 1


def test_run_log_has_both_models(spark):
    runs = Q["model_run_log"](spark, SF_SMALL).collect()
    assert sorted(r["model"] for r in runs) == ["challenger_gbt", "champion_ols"]
    assert all(r["metrics"]["mse"] >= 0 and abs(r["metrics"]["rmse"] ** 2 - r["metrics"]["mse"]) < 1e-9
               for r in runs)


def test_estimated_mae_is_nonnegative_and_tracks_realised(spark):
    d = Q["estimated_mae_daily"](spark, SF_SMALL).toPandas()
    assert (d.estimated_mae >= 0).all() and (d.realised_mae.dropna() >= 0).all()
    d = d.dropna()
    w = d.n / d.n.sum()
    # averaged over all analysis days, the estimate is within 50% of the realised MAE
    est, real = float((d.estimated_mae * w).sum()), float((d.realised_mae * w).sum())
    assert abs(est - real) <= 0.5 * real


def test_design_matrix_width(spark):
    d = Q["formula_design_matrix"](spark, SF_SMALL)
    widths = {len(r["features"]) for r in d.select("features").collect()}
    assert len(widths) == 1
