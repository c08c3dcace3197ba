"""Invariants of split, one-hot, JS drift, OLS, density, extraction."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentlens.functions.html import field_texts, parse_html, path_text, read_containers
from rentlens.functions.stats import chi2_upper, f_upper, t_quantile, t_two_sided
from rentlens.operators import evaluate as E
from rentlens.operators import features as Fe
from rentlens.operators.drift import js_distance_daily
from rentlens.operators.extract import CONTAINER, LISTING_SELECTORS, extract_listings
from rentlens.operators.models import fit_ols
from rentlens.operators.value import bargain_topk
from rentlens.plans.common import listings, raw
from rentlens.plans.pages import render_listing_pages
from rentlens.schema import NOTEBOOK_FEATURES
from tests.conftest import SF_CHECK, SF_SMALL


def test_split_disjoint_complete(spark):
    df = Fe.with_split(listings(spark, SF_CHECK))
    c = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert c["test"] == 3007 and c["train"] + c["test"] == 14845
    assert df.select("listing_id").distinct().count() == 14845


def test_one_hot_rows_sum_to_one(spark):
    df = listings(spark, SF_SMALL)
    oh = Fe.one_hot_columns(df, ["apartment_type"], keep=["listing_id"])
    s = sum(F.col(c) for c in oh.columns if c.startswith("apartment_type_"))
    assert oh.where(s != 1).count() == 0


def test_js_identical_is_zero_and_bounded(spark):
    ev = spark.read.parquet(f"{SF_CHECK}/events.parquet")
    # a copy of the reference week shifted forward is identical in distribution
    ref = ev.where(F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz"))
    shifted = ref.withColumn("ts", F.col("ts") + F.expr("INTERVAL 7 DAYS"))
    both = ref.unionByName(shifted)
    r = js_distance_daily(both, "ts", "value", "2024-01-08").collect()
    assert len(r) == 7 and all(0.0 <= x["js_distance"] <= 1.0 for x in r)
    full = js_distance_daily(ev, "ts", "value", "2024-01-08").collect()
    assert all(0.0 <= x["js_distance"] <= 1.0 for x in full)


def test_js_whole_week_equals_zero(spark):
    ev = spark.read.parquet(f"{SF_CHECK}/events.parquet")
    day = ev.where(F.to_date("ts") == F.lit("2024-01-03").cast("date"))
    copy = day.withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 DAYS"))
    r = js_distance_daily(day.unionByName(copy), "ts", "value", "2024-01-08").first()
    assert r["js_distance"] == pytest.approx(0.0, abs=1e-9)


def test_ols_train_residuals_sum_to_zero(spark):
    train = Fe.with_split(listings(spark, SF_SMALL)).where("split = 'train'")
    model = fit_ols(train)
    s = model.transform(train).agg(F.sum(F.col("rent_price") - F.col("prediction"))).first()[0]
    assert abs(s) < 1e-6


def test_linear_fit_equals_mllib_and_numpy(spark):
    df = Fe.with_split(listings(spark, SF_CHECK)).where("split = 'train'")
    fit = E.fit_linear(df, "rent_price", NOTEBOOK_FEATURES)
    lr = fit_ols(df, NOTEBOOK_FEATURES).stages[-1]
    assert fit.coef == pytest.approx(lr.coefficients.toArray(), rel=1e-8) and fit.intercept == pytest.approx(lr.intercept, rel=1e-8)
    assert fit.std_errors() == pytest.approx(lr.summary.coefficientStandardErrors, rel=1e-6)
    pdf = df.select("rent_price", *NOTEBOOK_FEATURES).dropna().toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf[NOTEBOOK_FEATURES]])
    beta, rss, *_ = np.linalg.lstsq(x, pdf["rent_price"], rcond=None)
    assert [fit.intercept, *fit.coef] == pytest.approx(beta, rel=1e-7) and fit.rss == pytest.approx(rss[0], rel=1e-7)
    terms, whole = fit.summary()
    assert [t[4] for t in terms] == pytest.approx(lr.summary.pValues, abs=1e-9)
    n, p = len(pdf), len(NOTEBOOK_FEATURES)
    tss = ((pdf["rent_price"] - pdf["rent_price"].mean()) ** 2).sum()
    assert whole["f_value"] == pytest.approx((tss - rss[0]) / p / (rss[0] / (n - p - 1)), rel=1e-6)
    loglik = -n / 2 * (np.log(2 * np.pi) + np.log(rss[0] / n) + 1)
    assert whole["aic"] == pytest.approx(-2 * loglik + 2 * (p + 1)) and whole["bic"] == pytest.approx(-2 * loglik + np.log(n) * (p + 1))


def test_linear_fit_refuses_what_has_no_answer(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0), (4.0, 2.0)], "y double, x double")
    with pytest.raises(ValueError, match="variation"):
        E.fit_linear(df, "y", ["x"])
    with pytest.raises(ValueError, match="complete rows"):
        E.fit_linear(df.where("false"), "y", ["x"])


def test_tail_probabilities():
    # reference values from published tables
    assert t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert f_upper(4.103, 2, 10) == pytest.approx(0.05, abs=1e-4)
    assert chi2_upper(9.488, 4) == pytest.approx(0.05, abs=1e-4) and chi2_upper(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert t_quantile(0.975, 10) == pytest.approx(2.228, abs=1e-3)
    assert f_upper(2.228**2, 1, 10) == pytest.approx(t_two_sided(2.228, 10), rel=1e-9)


def exact_density(values, x, h):
    return np.exp(-0.5 * ((x - values) / h) ** 2).sum() / (len(values) * h * np.sqrt(2 * np.pi))


@pytest.mark.parametrize("scale,n", [(1.0, 3000), (0.001, 20000), (50.0, 500)])
def test_density_equals_the_kernel_sum(spark, scale, n):
    """Whatever the bandwidth, the binned density is the exact kernel sum to 1e-3 of its peak."""
    values = np.random.default_rng(1).normal(0, scale, n)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "residual double")
    h = values.std(ddof=1) * n ** -0.2
    got = E.residual_density(df).collect()
    assert len(got) == 25
    want = np.array([exact_density(values, r["x"], h) for r in got])
    assert np.abs(np.array([r["density"] for r in got]) - want).max() <= 3e-3 * want.max()
    fine = E.residual_density(df, bins_per_bandwidth=16).collect()
    assert np.abs(np.array([r["density"] for r in fine]) - want).max() <= 1e-3 * want.max()
    grid = np.array([r["x"] for r in sorted(fine, key=lambda r: r["i"])])
    assert np.trapezoid([exact_density(values, x, h) for x in grid], grid) == pytest.approx(1.0, abs=0.1)


def test_breusch_pagan_equals_numpy(spark):
    df = Fe.with_split(listings(spark, SF_SMALL)).where("split = 'train'")
    bp = E.breusch_pagan(df, E.fit_linear(df, "rent_price", NOTEBOOK_FEATURES))
    pdf = df.select("rent_price", *NOTEBOOK_FEATURES).dropna().toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf[NOTEBOOK_FEATURES]])
    e2 = (pdf["rent_price"] - x @ np.linalg.lstsq(x, pdf["rent_price"], rcond=None)[0]) ** 2
    r2 = 1 - ((e2 - x @ np.linalg.lstsq(x, e2, rcond=None)[0]) ** 2).sum() / ((e2 - e2.mean()) ** 2).sum()
    assert bp["lm"] == pytest.approx(len(pdf) * r2, rel=1e-6) and 0 <= bp["lm_p_value"] <= 1 and 0 <= bp["f_p_value"] <= 1


def test_missing_rent_is_no_bargain(spark):
    df = listings(spark, SF_SMALL)
    assert df.where("rent_price is null").count() > 0 and df.where("rent_price = 0").count() == 0
    top = bargain_topk(df)
    assert top.where("rent_price is null").count() == 0 and top.count() > 0


def test_drift_counts_missing_and_negative(spark):
    rows = [("2024-01-01", v) for v in (5.0, 15.0, None, -3.0)] + [("2024-01-09", v) for v in (5.0, 15.0, None, -3.0)] \
        + [("2024-01-10", v) for v in (None, None, float("nan"), None)]
    df = spark.createDataFrame(rows, "d string, value double").withColumn("ts", F.col("d").cast("timestamp"))
    got = {r.chunk: (r.n, r.js_distance) for r in js_distance_daily(df, "ts", "value", "2024-01-08").collect()}
    assert got["2024-01-09"] == (4, 0.0) and got["2024-01-10"][0] == 4 and got["2024-01-10"][1] > 0.5
    assert js_distance_daily(df, "ts", "value", "2023-01-01").where("js_distance is not null").count() == 0


def test_html_tree_semantics():
    root = parse_html('<div class="a b"><p>x &amp; <b>y</b><div class="a">z</div><!-- c --></div>')
    assert [n.tag for n in root.find_all("div", "a")] == ["div", "div"]
    assert root.find("div", "a b").text == "x & yz"
    assert root.find("div", "b a") is None       # several tokens must equal the attribute
    assert parse_html('<i class="a  b">x</i>').find("i", "a b").text == "x"  # up to white space
    assert parse_html("<script>if (a<b) '<p>'</script><p>y").find("p").text == "y"
    assert parse_html("<p>a<br/>b<img src='x>y'>c</p>d").find("p").text == "abc"
    assert root.find("span") is None


def test_render_extract_round_trip(spark):
    r = raw(spark, SF_SMALL)
    back = extract_listings(render_listing_pages(r, per_page=20))
    cols = ["listing_id", "rent_price", "sqr_m", "rei_price", "floor", "year_built", "nearest_eki"]
    assert back.count() == r.count()
    assert back.select(*cols).exceptAll(r.select(*cols)).count() == 0


def test_one_scan_equals_the_tree(spark):
    """The container reader gives what successive first matches in the tree give, also on broken pages."""
    rng = random.Random(4)
    parts = ["<div class='cassetteitem' data-id='1'>", "</div>", "<ul>", "</ul>", "<li>", "</li>", "<span>", "</span>", "<tbody>", "</tbody>", "<br>",
             "<span class='cassetteitem_menseki'>", "<span class='cassetteitem_price  cassetteitem_price--deposit'>", "<div>", "x", "&amp;", "<!-- n -->",
             "<div class='cassetteitem_detail-text'>", "<p>"]
    for _ in range(400):
        doc = "<div class='cassetteitem'>" + "".join(rng.choice(parts) for _ in range(40))
        found, _ = read_containers(doc, CONTAINER, LISTING_SELECTORS)
        tree = parse_html(doc).find_all(*CONTAINER)
        assert [field_texts(c) for c in found] == [{k: path_text(n, p) for k, p in LISTING_SELECTORS.items()} for n in tree]


def test_page_level_variants(spark):
    pages = spark.createDataFrame([("<div class='designateline-box-txt02'>W</div><div class='cassetteitem'><div><ul><li>first</li></ul></div></div>",)], "html string")
    r = extract_listings(pages, id_attr=None, ward_from="page", name_from="item").first()
    assert (r.ku_name, r.name_place, r.address) == ("W", "first", "first")
    assert extract_listings(pages, id_attr=None).first().ku_name == "first"
