"""Queries for features, models, evaluation and scoring.

Rows without a rent take no part in fits, metrics and rankings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentlens.operators import evaluate as E
from rentlens.operators import features as Fe
from rentlens.operators import models as M
from rentlens.operators.leafwise import fit_leafwise
from rentlens.operators.score import RANGES, score, score_many, score_positional, validate_scoring_input
from rentlens.plans.common import fitted_once, listings, split_listings
from rentlens.plans.registry import query
from rentlens.plans.sql import coefficient_sql, residualised, summary_sql, with_listings
from rentlens.schema import FEATURES, NOTEBOOK_FEATURES, TARGET
from rentlens.session import scratch_path
from rentlens.sources.tables import land

SPLIT_SQL = ("CASE WHEN CAST('0x' || substr(md5(CAST(listing_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 < 8 "
             "THEN 'train' ELSE 'test' END")
SPLIT_CTE = f"split_listings AS (SELECT *, {SPLIT_SQL} AS split FROM clean_listings)"


def _train(spark, sf_dir) -> DataFrame:
    return split_listings(spark, sf_dir).where(F.col("split") == "train")


def _test(spark, sf_dir) -> DataFrame:
    return split_listings(spark, sf_dir).where(F.col("split") == "test")


def _landed(spark, sf_dir, *cols: str) -> DataFrame:
    """The split listings with ``cols``, written once: a query that fits and then diagnoses reads this, not the text again."""
    return land(split_listings(spark, sf_dir).select("listing_id", "split", *cols), scratch_path(spark, "split"))


def _model_rows(spark, sf_dir) -> DataFrame:
    """The split listings as the models take them, written once for the fits, their keys and the scoring."""
    return _landed(spark, sf_dir, TARGET, *FEATURES)


def champion(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None):
    """M1: OLS on the seven features, fitted on the train split (of ``rows``, if given: split listings)."""
    data = (_train(spark, sf_dir) if rows is None else rows.where("split = 'train'")).select(*FEATURES, TARGET)
    return fitted_once("champion", data, lambda: M.fit_ols(data))


def challenger(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None):
    """M4, M5: boosted trees of 31 leaves on the train split, kept up to the best round on the test split."""
    data = (_model_rows(spark, sf_dir) if rows is None else rows).select("split", *FEATURES, TARGET)
    return fitted_once("challenger", data, lambda: fit_leafwise(
        data.where("split = 'train'"), data.where("split = 'test'"), FEATURES, TARGET)[0])


def notebook_fit(df: DataFrame) -> E.LinearFit:
    """The four-feature model of the notebook, by least squares."""
    return E.fit_linear(df, TARGET, NOTEBOOK_FEATURES)


def _on_test(spark, sf_dir) -> DataFrame:
    """The test split with the four-feature model's prediction and residual."""
    s = _landed(spark, sf_dir, TARGET, *NOTEBOOK_FEATURES)
    return E.with_residual(s.where("split = 'test'"), notebook_fit(s.where("split = 'train'")))


CHAMPION_SQL = residualised("split_listings", ["listing_id", "split", "rent_price"], FEATURES, "rent_price", "split = 'train'")
NOTEBOOK_SQL = residualised("split_listings", ["listing_id", "split", "rent_price"], NOTEBOOK_FEATURES, "rent_price", "split = 'train'")


# ---------------------------------------------------------------- F1, F3, F4

_LEVELS = {"apartment_type": ["1DK", "1K", "1LDK", "2K"],
           "house_type": ["賃貸アパート", "賃貸マンション"],
           "ku_name": [f"NATION_{i}" for i in range(25)]}


@query("one_hot_columns", with_listings(
    "SELECT listing_id, " + ", ".join(
        f"CASE WHEN {c} = '{lvl}' THEN 1 ELSE 0 END AS \"{c}_{lvl}\"" for c, lv in _LEVELS.items() for lvl in lv)
    + " FROM clean_listings"))
def q_one_hot_columns(spark, sf_dir):
    return Fe.one_hot_columns(listings(spark, sf_dir), list(_LEVELS), keep=["listing_id"])


@query("one_hot_sparse", with_listings("""
SELECT c.listing_id, coalesce(string_agg(CAST(l.slot AS VARCHAR), ',' ORDER BY l.slot), '') AS slots, (SELECT CAST(count(*) AS INTEGER) FROM levels) AS width
FROM clean_listings c LEFT JOIN levels l
  ON (l.pos = 0 AND l.level = c.apartment_type) OR (l.pos = 1 AND l.level = c.house_type) OR (l.pos = 2 AND l.level = c.ku_name) OR (l.pos = 3 AND l.level = c.name_place)
GROUP BY c.listing_id""", """pairs AS (
SELECT 0 AS pos, apartment_type AS level FROM clean_listings UNION SELECT 1, house_type FROM clean_listings
UNION SELECT 2, ku_name FROM clean_listings UNION SELECT 3, name_place FROM clean_listings),
levels AS (SELECT pos, level, row_number() OVER (ORDER BY pos, level) - 1 AS slot FROM pairs WHERE level IS NOT NULL)"""))
def q_one_hot_sparse(spark, sf_dir):
    """F1 with a column that has a level for every listing."""
    cols = ["apartment_type", "house_type", "ku_name", "name_place"]
    hot = Fe.one_hot_sparse(listings(spark, sf_dir), cols, keep=["listing_id"])
    return hot.select("listing_id", F.array_join(F.col("slots").cast("array<string>"), ",").alias("slots"), "width")


@query("train_test_split_hash", with_listings(
    f"SELECT listing_id, {SPLIT_SQL} AS split FROM clean_listings"))
def q_train_test_split_hash(spark, sf_dir):
    return split_listings(spark, sf_dir).select("listing_id", "split")


# Fixed value: the notebook's formula.
FORMULA = ("rent_price ~ rei_price + shikikin + maintenence_price + sqr_m + floor + "
           "apartment_type + ku_name")
_FORMULA_COLUMNS = ["rent_price", "rei_price", "shikikin", "maintenence_price", "sqr_m", "floor", "apartment_type", "ku_name"]


def _design_sql() -> str:
    """Treatment coding as RFormula lays it out: numeric terms in formula
    order, then per categorical term one indicator per level in descending
    alphabetical order, the alphabetically first level being the base."""
    cols = ["rei_price", "shikikin", "maintenence_price", "sqr_m", "CAST(floor AS DOUBLE)"]
    for c in ("apartment_type", "ku_name"):
        levels = sorted(_LEVELS[c], reverse=True)[:-1]
        cols += [f"CASE WHEN {c} = '{lvl}' THEN 1.0 ELSE 0.0 END" for lvl in levels]
    return with_listings(
        f"SELECT listing_id, rent_price AS label, [{', '.join(cols)}] AS features FROM split_listings "
        "WHERE split = 'train' AND ku_name IS NOT NULL AND rent_price IS NOT NULL", SPLIT_CTE)


@query("formula_design_matrix", _design_sql())
def q_formula_design_matrix(spark, sf_dir):
    train = _landed(spark, sf_dir, *_FORMULA_COLUMNS).where("split = 'train'")
    return Fe.formula_design_matrix(train, FORMULA, keep=["listing_id"])


# ---------------------------------------------------------------- M1-M4

@query("ols_champion_predictions", with_listings(
    "SELECT listing_id, rent_price, round(predicted, 6) AS prediction FROM scored WHERE split = 'test'",
    SPLIT_CTE + ",\n" + CHAMPION_SQL))
def q_ols_champion_predictions(spark, sf_dir):
    return score(champion(spark, sf_dir), _test(spark, sf_dir), keep=[TARGET]).withColumn("prediction", F.round("prediction", 6))


@query("ols_coefficients", with_listings("""
SELECT round((s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12), 6) AS coef_sqr_m,
       round((s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12), 6) AS coef_eki_walk,
       round(my - (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) * m1
                - (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) * m2, 6) AS intercept
FROM (SELECT covar_pop(sqr_m, sqr_m) AS s11, covar_pop(eki_walk, eki_walk) AS s22,
             covar_pop(sqr_m, eki_walk) AS s12, covar_pop(sqr_m, rent_price) AS s1y,
             covar_pop(eki_walk, rent_price) AS s2y, avg(sqr_m) AS m1, avg(eki_walk) AS m2,
             avg(rent_price) AS my
      FROM split_listings WHERE split = 'train' AND rent_price IS NOT NULL) t""", SPLIT_CTE))
def q_ols_coefficients(spark, sf_dir):
    """M2: MLlib OLS on two features; the oracle solves the normal equations in SQL."""
    lr = M.ols_stage(M.fit_ols(_train(spark, sf_dir), ["sqr_m", "eki_walk"]))
    c = lr.coefficients.toArray()
    return spark.range(1).select(F.round(F.lit(float(c[0])), 6).alias("coef_sqr_m"),
                                 F.round(F.lit(float(c[1])), 6).alias("coef_eki_walk"),
                                 F.round(F.lit(float(lr.intercept)), 6).alias("intercept"))


_COEF_CTE, _COEF_SELECT = coefficient_sql("split_listings", NOTEBOOK_FEATURES, "rent_price", "split = 'train'")


@query("ols_notebook_coefficients", with_listings(
    f"SELECT term, round(coef, 6) AS coef, round(std_err, 6) AS std_err, round(coef / std_err, 4) AS t_value, CAST(n AS BIGINT) AS n FROM ({_COEF_SELECT}) c "
    f"UNION ALL SELECT 'intercept', round(my - s, 6), NULL, NULL, CAST(n AS BIGINT) FROM (SELECT sum(coef * mean_x) AS s, max(n) AS n FROM ({_COEF_SELECT}) d) "
    "CROSS JOIN (SELECT avg(rent_price) AS my FROM split_listings WHERE split = 'train')", SPLIT_CTE + ",\n" + _COEF_CTE))
def q_ols_notebook_coefficients(spark, sf_dir):
    """M2, M3: the four-feature model's coefficients, standard errors and t values (the intercept's only in the summary)."""
    fit = notebook_fit(_train(spark, sf_dir))
    terms, _ = fit.summary()
    rows = [(t[0], round(t[1], 6), *((round(t[2], 6), round(t[3], 4)) if t[0] != "intercept" else (None, None)), fit.n) for t in terms]
    return spark.createDataFrame(rows, "term string, coef double, std_err double, t_value double, n long")


@query("ols_simple_fit", with_listings("""
SELECT round(f.slope, 8) AS slope, round(f.intercept, 8) AS intercept, round(f.r2, 8) AS r2,
       CAST(f.n AS BIGINT) AS n,
       round(avg(power(s.rent_price - (f.intercept + f.slope * s.sqr_m), 2)), 8) AS test_mse
FROM split_listings s CROSS JOIN fit f WHERE s.split = 'test'
GROUP BY f.slope, f.intercept, f.r2, f.n""", SPLIT_CTE + """,
fit AS (SELECT regr_slope(rent_price, sqr_m) AS slope, regr_intercept(rent_price, sqr_m) AS intercept,
 regr_r2(rent_price, sqr_m) AS r2, regr_count(rent_price, sqr_m) AS n FROM split_listings WHERE split = 'train')"""))
def q_ols_simple_fit(spark, sf_dir):
    """M2 (one feature): one regr_* aggregate on train, one MSE aggregate on test."""
    s = split_listings(spark, sf_dir)
    fit = E.simple_fit(s.where("split = 'train'"), TARGET, "sqr_m").first()
    residual = F.col(TARGET) - (F.lit(fit["intercept"]) + F.lit(fit["slope"]) * F.col("sqr_m"))
    return s.where("split = 'test'").agg(F.round(F.avg(residual * residual), 8).alias("test_mse")).select(
        F.round(F.lit(fit["slope"]), 8).alias("slope"), F.round(F.lit(fit["intercept"]), 8).alias("intercept"),
        F.round(F.lit(fit["r2"]), 8).alias("r2"), F.lit(int(fit["n"])).cast("long").alias("n"), "test_mse")


def _formula_terms() -> dict[str, str]:
    """Term name → SQL expression, as the formula is coded."""
    terms = {c: c for c in ("rei_price", "shikikin", "maintenence_price", "sqr_m", "floor")}
    for c in ("apartment_type", "ku_name"):
        for lvl in sorted(_LEVELS[c], reverse=True)[:-1]:
            terms[f"{c}_{lvl}"] = f"CASE WHEN {c} = '{lvl}' THEN 1.0 ELSE 0.0 END"
    return terms


_TERMS = _formula_terms()
_SUMMARY_CTE, _SUMMARY_SELECT = summary_sql("design", {t: f"t{i}" for i, t in enumerate(_TERMS)}, "rent_price")


@query("ols_summary_table", with_listings(
    f"SELECT term, round(coef, 5) AS coef, round(std_err, 5) AS std_err, round(coef / std_err, 3) AS t_value, CAST(n AS BIGINT) AS n, round(r2, 6) AS r2 "
    f"FROM ({_SUMMARY_SELECT}) s", SPLIT_CTE + ",\ndesign AS MATERIALIZED (SELECT listing_id AS id, rent_price, "
    + ", ".join(f"{e} AS t{i}" for i, e in enumerate(_TERMS.values()))
    + " FROM split_listings WHERE split = 'train' AND ku_name IS NOT NULL AND rent_price IS NOT NULL),\n" + _SUMMARY_CTE))
def q_ols_summary_table(spark, sf_dir):
    """M3: the formula model's terms (treatment-coded layout and ward); the operator's table has the other figures too."""
    train = _landed(spark, sf_dir, *_FORMULA_COLUMNS).where("split = 'train'")
    model, names = M.fit_formula_ols(train, FORMULA)
    t = M.ols_coefficient_table(spark, model, names).where("term <> 'intercept'")
    return t.select("term", F.round("coef", 5).alias("coef"), F.round("std_err", 5).alias("std_err"), F.round("t_value", 3).alias("t_value"),
                    "n", F.round("r2", 6).alias("r2"))


@query("gbt_challenger_predictions")
def q_gbt_challenger_predictions(spark, sf_dir):
    rows = _model_rows(spark, sf_dir)
    return score(challenger(spark, sf_dir, rows), rows.where("split = 'test'"), keep=[TARGET])


# ---------------------------------------------------------------- M6, M7, R1-R4

_METRICS_SQL = ("SELECT count(residual) AS n, avg(residual * residual) AS mse, sqrt(avg(residual * residual)) AS rmse, "
                "avg(abs(residual)) AS mae, 1 - avg(residual * residual) / var_pop(rent_price) AS r2 FROM scored WHERE split = 'test'")


def _round_all(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if isinstance(df.schema[c].dataType, T.DoubleType)
                       else F.col(c) for c in df.columns])


@query("regression_metrics", with_listings(
    f"SELECT n, round(mse, 6) AS mse, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2 "
    f"FROM ({_METRICS_SQL}) m", SPLIT_CTE + ",\n" + NOTEBOOK_SQL))
def q_regression_metrics(spark, sf_dir):
    return _round_all(E.regression_metrics(_on_test(spark, sf_dir), TARGET, "predicted"), 6)


@query("promotion_gate", with_listings(
    f"SELECT 'champion' AS model, round(mse, 6) AS mse, 4.0 AS threshold, mse < 4.0 AS passed, mse < 4.0 AS has_alias "
    f"FROM ({_METRICS_SQL}) m", SPLIT_CTE + ",\n" + CHAMPION_SQL))
def q_promotion_gate(spark, sf_dir):
    """M7: the champion's test MSE against the gate; the alias ``passed`` is set only if it holds."""
    root, model = scratch_path(spark, "models"), champion(spark, sf_dir)
    m = E.regression_metrics(score(model, _test(spark, sf_dir), keep=[TARGET]), TARGET, "prediction")
    g = E.promotion_gate(m, M.MSE_GATE).select("mse", "threshold", "passed").first()
    M.promote(spark, model, g["mse"], root)
    rows = [("champion", round(g["mse"], 6), g["threshold"], g["passed"], M.alias_version(spark, root, "passed") is not None)]
    return spark.createDataFrame(rows, "model string, mse double, threshold double, passed boolean, has_alias boolean")


@query("residuals", with_listings(
    "SELECT listing_id, rent_price, round(predicted, 6) AS predicted, round(residual, 6) AS residual FROM scored WHERE split = 'test'",
    SPLIT_CTE + ",\n" + NOTEBOOK_SQL))
def q_residuals(spark, sf_dir):
    return _on_test(spark, sf_dir).select("listing_id", TARGET, F.round("predicted", 6).alias("predicted"),
                                          F.round("residual", 6).alias("residual"))


@query("residual_histogram", with_listings(
    "SELECT CAST(floor(residual / 0.25) AS BIGINT) AS bin, floor(residual / 0.25) * 0.25 AS lower, "
    "(floor(residual / 0.25) + 1) * 0.25 AS upper, count(*) AS n FROM scored WHERE split = 'test' AND residual IS NOT NULL GROUP BY 1, 2, 3",
    SPLIT_CTE + ",\n" + NOTEBOOK_SQL))
def q_residual_histogram(spark, sf_dir):
    return E.residual_histogram(_on_test(spark, sf_dir).where("residual is not null"), "residual", 0.25)


@query("residual_density", with_listings("""
SELECT CAST(g.i AS INTEGER) AS i, round(p.lo + g.i * p.step, 4) AS x,
       round(sum(b.m * exp(-0.5 * power((p.lo + g.i * p.step - b.c) / p.h, 2)) / (p.n * p.h * sqrt(2 * pi()))), 4) AS density
FROM bins b CROSS JOIN range(0, 25) g(i) CROSS JOIN params p GROUP BY g.i, p.lo, p.step""",
    SPLIT_CTE + ",\n" + NOTEBOOK_SQL + """,
moments AS (SELECT count(residual) AS n, stddev_samp(residual) * power(count(residual), -0.2) AS h, min(residual) AS a, max(residual) AS z
            FROM scored WHERE split = 'train'),
params AS (SELECT n, h, a - 3 * h AS lo, (z - a + 6 * h) / 24 AS step FROM moments),
bins AS (SELECT (floor(residual / (h / 4)) + 0.5) * (h / 4) AS c, count(*) AS m FROM scored CROSS JOIN params
         WHERE split = 'train' AND residual IS NOT NULL GROUP BY 1)"""))
def q_residual_density(spark, sf_dir):
    train = _landed(spark, sf_dir, TARGET, *NOTEBOOK_FEATURES).where("split = 'train'")
    d = E.residual_density(E.with_residual(train, notebook_fit(train)))
    return d.select("i", F.round("x", 4).alias("x"), F.round("density", 4).alias("density"))


@query("breusch_pagan_lm", with_listings("""
SELECT CAST(count(e2) AS BIGINT) AS n, round(1 - sum(power(residual, 2)) / (var_pop(e2) * count(e2)), 6) AS r2_aux,
       round(count(e2) - sum(power(residual, 2)) / var_pop(e2), 4) AS lm
FROM scored WHERE used""",
    SPLIT_CTE + ",\n" + residualised("split_listings", ["listing_id", "split", "rent_price", *NOTEBOOK_FEATURES], NOTEBOOK_FEATURES,
                                     "rent_price", "split = 'train'", "first_fit")
    + ",\nsquares AS (SELECT *, residual * residual AS e2 FROM first_fit WHERE used),\n"
    + residualised("squares", ["listing_id", "e2"], NOTEBOOK_FEATURES, "e2", "true")))
def q_breusch_pagan_lm(spark, sf_dir):
    """Over the four-feature design, with the F variant and both p-values in the operator."""
    train = _landed(spark, sf_dir, TARGET, *NOTEBOOK_FEATURES).where("split = 'train'")
    bp = E.breusch_pagan(train, notebook_fit(train))
    return spark.createDataFrame([(bp["n"], round(bp["r2_aux"], 6), round(bp["lm"], 4))], "n long, r2_aux double, lm double")


# ---------------------------------------------------------------- K3, M8-M12

@query("model_roundtrip_score", with_listings(
    "SELECT listing_id, round(predicted, 6) AS champion FROM scored WHERE split = 'test'", SPLIT_CTE + ",\n" + CHAMPION_SQL))
def q_model_roundtrip_score(spark, sf_dir):
    """K3: both models saved as versions with aliases; the promoted one, loaded by its alias, scores the test split."""
    root, rows = scratch_path(spark, "models"), _model_rows(spark, sf_dir)
    for alias, model in (("passed", champion(spark, sf_dir, rows)), ("challenger", challenger(spark, sf_dir, rows))):
        M.set_alias(spark, root, alias, M.save_version(model, root))
    return score(M.load_model(spark, root, "passed"), rows.where("split = 'test'"), out="champion").withColumn("champion", F.round("champion", 6))


@query("model_registry_scores")
def q_model_registry_scores(spark, sf_dir):
    """K3, M7, M8: both models saved and their runs logged; the challenger loaded by its alias and the best run's model, which
    the gate lets pass, score the test split (null where none passes)."""
    root, runs, rows = scratch_path(spark, "models"), scratch_path(spark, "runs"), _model_rows(spark, sf_dir)
    test = rows.where("split = 'test'")
    models = {"champion": champion(spark, sf_dir, rows), "challenger": challenger(spark, sf_dir, rows)}
    scored = score_many(models, test, keep=[TARGET])
    saved = {name: M.save_version(model, root) for name, model in models.items()}
    M.set_alias(spark, root, "challenger", saved["challenger"])
    mse = scored.agg(*[F.avg((F.col(TARGET) - F.col(n)) ** 2).alias(n) for n in models]).first()
    for name, model in models.items():
        M.log_run(spark, runs, name, M.model_params(model), {"mse": mse[name]}, saved[name])
    best, _ = M.reload_if_passed(spark, root, runs)
    loaded = {"challenger": M.load_model(spark, root, "challenger")} | ({"passed": best} if best else {})
    out = score_many(loaded, test, keep=[TARGET])
    return out if best else out.withColumn("passed", F.lit(None).cast("double"))


#: The test split as arrays by position: some too short, some too long, some with an element missing.
_WIDTHS = {"listing_id % 13 = 0": "record:width 6", "listing_id % 17 = 0": "record:width 8", "listing_id % 19 = 0": "year_built:missing"}


@query("positional_records_score", with_listings(
    "SELECT listing_id, CASE WHEN r IS NULL THEN round(predicted, 6) END AS prediction, r AS reason FROM (SELECT listing_id, predicted, CASE "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _WIDTHS.items()) + " END AS r FROM scored WHERE split = 'test') p",
    SPLIT_CTE + ",\n" + CHAMPION_SQL))
def q_positional_records_score(spark, sf_dir):
    """Records bound by position, width and type enforced."""
    x = [F.col(c).cast("double") for c in FEATURES]
    holes = [F.when(F.expr("listing_id % 19 <> 0"), v) if c == "year_built" else v for c, v in zip(FEATURES, x)]
    record = (F.when(F.expr("listing_id % 13 = 0"), F.array(*x[:-1])).when(F.expr("listing_id % 17 = 0"), F.array(*x, F.lit(1.0))).otherwise(F.array(*holes)))
    rows = _test(spark, sf_dir).select("listing_id", record.alias("record"))
    return score_positional(champion(spark, sf_dir), rows).withColumn("prediction", F.round("prediction", 6))


# Scoring records as they may arrive: text, a word for a number, yen for 万円, a missing field.
RECORDS = {c: f"CAST({c} AS STRING)" for c in FEATURES} | {
    "eki_walk": "CASE WHEN listing_id % 13 = 0 THEN 'near' ELSE CAST(eki_walk AS STRING) END",
    "rei_price": "CASE WHEN listing_id % 17 = 0 THEN CAST(rei_price * 10000 AS STRING) ELSE CAST(rei_price AS STRING) END",
    "sqr_m": "CASE WHEN listing_id % 19 = 0 THEN NULL WHEN listing_id % 29 = 0 THEN '1200.5' ELSE CAST(sqr_m AS STRING) END",
}
RECORDS_CTE = "records AS (SELECT listing_id, " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in RECORDS.items()) + " FROM split_listings WHERE split = 'test')"
_TYPED = ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in FEATURES)
TYPED_CTE = f"typed AS (SELECT listing_id, {_TYPED} FROM records)"
#: The champion fitted on the train split and applied to the records (whose rents are not used).
RECORD_SQL = (RECORDS_CTE + ",\n" + TYPED_CTE + """,
both_parts AS (SELECT listing_id, 'train' AS split, rent_price, """ + ", ".join(FEATURES) + """ FROM split_listings WHERE split = 'train'
 UNION ALL SELECT listing_id, 'test', NULL, """ + ", ".join(FEATURES) + " FROM typed),\n"
              + residualised("both_parts", ["listing_id", "split", "rent_price"], FEATURES, "rent_price", "split = 'train'"))


def scoring_records(spark, sf_dir, rows: DataFrame | None = None) -> DataFrame:
    """The test split (of ``rows``, if given: split listings) as scoring records in text, some of them odd."""
    return (_test(spark, sf_dir) if rows is None else rows.where("split = 'test'")).selectExpr("listing_id", *[f"{e} AS {c}" for c, e in RECORDS.items()])


_SCORED_RECORDS = with_listings("SELECT listing_id, round(predicted, 4) AS prediction FROM scored WHERE split = 'test'", SPLIT_CTE + ",\n" + RECORD_SQL)


@query("batch_score_champion", _SCORED_RECORDS)
def q_batch_score_champion(spark, sf_dir):
    return score(champion(spark, sf_dir), scoring_records(spark, sf_dir)).withColumn("prediction", F.round("prediction", 4))


@query("batch_score_challenger")
def q_batch_score_challenger(spark, sf_dir):
    # columns deliberately out of training order: binding is by name
    rows = _model_rows(spark, sf_dir)
    shuffled = scoring_records(spark, sf_dir, rows).select("listing_id", *reversed(FEATURES))
    return score(challenger(spark, sf_dir, rows), shuffled)


@query("champion_challenger_compare")
def q_champion_challenger_compare(spark, sf_dir):
    """Both models on the same test rows; the lower MSE wins."""
    rows = _model_rows(spark, sf_dir)
    both = score_many({"champion": champion(spark, sf_dir, rows), "challenger": challenger(spark, sf_dir, rows)},
                      rows.where("split = 'test'"), keep=[TARGET])
    return E.compare_models(both.dropna(subset=[TARGET]), TARGET, ["champion", "challenger"])


@query("model_run_log")
def q_model_run_log(spark, sf_dir):
    """M8: log both fits (params, test metrics) to a run table and read it back."""
    path = scratch_path(spark, "runs")
    rows = _model_rows(spark, sf_dir)
    test = rows.where("split = 'test'")
    for name, model in (("champion_ols", champion(spark, sf_dir, rows)), ("challenger_gbt", challenger(spark, sf_dir, rows))):
        m = E.regression_metrics(score(model, test, keep=[TARGET]), TARGET, "prediction").first()
        params = {**M.model_params(model), "test_size": 0.2, "split": "md5(listing_id) % 10 >= 8"}
        M.log_run(spark, path, name, params, {"mse": m["mse"], "rmse": m["rmse"], "mae": m["mae"], "r2": m["r2"]})
    return M.read_runs(spark, path)


_MISSING = ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}:missing' END" for c in FEATURES)
_ODD = ", ".join(f"CASE WHEN {c} < {RANGES[c][0]} OR {c} > {RANGES[c][1]} THEN '{c}:range' END" for c in FEATURES)


@query("validate_scoring_input", with_listings(
    f"SELECT listing_id, {', '.join(FEATURES)}, nullif(concat_ws(',', {_MISSING}), '') AS reason, "
    f"nullif(concat_ws(',', {_ODD}), '') AS warning FROM typed", SPLIT_CTE + ",\n" + RECORDS_CTE + ",\n" + TYPED_CTE))
def q_validate_scoring_input(spark, sf_dir):
    return validate_scoring_input(scoring_records(spark, sf_dir))
