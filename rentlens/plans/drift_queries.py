"""Queries for enrichment joins (J1-J3) and drift / chunked performance."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentlens.operators import drift as D
from rentlens.operators import evaluate as E
from rentlens.operators.enrich import facility_distances, geocode, geocode_addresses, nearest_facility
from rentlens.plans.common import fitted_once, listings
from rentlens.plans.registry import query
from rentlens.plans.sql import residualised, with_listings
from rentlens.schema import NOTEBOOK_FEATURES, TARGET
from rentlens.sources.tables import FACILITY_SQL, GAZETTEER_SQL, GEO_SQL, facility_dim, gazetteer, geo_dim, read_table

# Drift settings.  Events before 2024-01-08 are the reference
# period; listings scraped before 1996 are the listing reference period.
EVENTS_REFERENCE_END = "2024-01-08"
LISTINGS_REFERENCE_END = "1996-01-01"
JS_WIDTH, JS_BINS, JS_ALERT = 10.0, 10, 0.1
PREDICTION_WIDTH, PREDICTION_BINS = 1.0, 30
# Calibrated drift: bins of equal reference counts, limit in standard deviations of the reference days.
CALIBRATED_BINS, CALIBRATED_DEVIATIONS = 10, 3.0
# Facilities further away than this are not listed.
RADIUS_KM = 20.0
# Events with missing and negative readings put in (shared by Spark and the oracles).
EVENT_VALUE = "CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 59 = 0 THEN -value ELSE value END"

_DIM_CTES = f"geo AS ({GEO_SQL}), facility AS ({FACILITY_SQL})"
_HAV = ("2 * 6371.0 * asin(sqrt(power(sin(radians(f.flat - g.lat) / 2), 2) + cos(radians(g.lat)) * "
        "cos(radians(f.flat)) * power(sin(radians(f.flon - g.lon) / 2), 2)))")


def _geocoded(spark, sf_dir):
    return geocode(listings(spark, sf_dir), geo_dim(spark, sf_dir))


@query("geocode_left_join", with_listings(
    "SELECT c.listing_id, c.ku_name, g.lat, g.lon FROM clean_listings c LEFT JOIN geo g ON c.ku_name = g.ku_name",
    _DIM_CTES))
def q_geocode_left_join(spark, sf_dir):
    return _geocoded(spark, sf_dir).select("listing_id", "ku_name", "lat", "lon")


@query("geocode_by_address", with_listings("""
SELECT listing_id, address, place, round(lat, 8) AS lat, round(lon, 8) AS lon FROM (
  SELECT c.listing_id, c.address, g.place, g.lat, g.lon, row_number() OVER (PARTITION BY c.listing_id ORDER BY length(g.place) DESC) AS rk
  FROM clean_listings c LEFT JOIN gazetteer g ON starts_with(c.address, g.place)) t WHERE rk = 1""",
    f"gazetteer AS ({GAZETTEER_SQL.replace('STRING', 'VARCHAR')})"))
def q_geocode_by_address(spark, sf_dir):
    """The listing's own address against places of three sizes; the longest that fits."""
    found = geocode_addresses(listings(spark, sf_dir), gazetteer(spark, sf_dir))
    return found.select("listing_id", "address", "place",
                        F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


@query("facility_distance_matrix", with_listings(
    f"SELECT c.listing_id, CAST(f.facility_id AS VARCHAR) AS facility_id, f.facility, round({_HAV}, 6) AS km "
    "FROM clean_listings c LEFT JOIN geo g ON c.ku_name = g.ku_name "
    f"LEFT JOIN facility f ON {_HAV} <= {RADIUS_KM}", _DIM_CTES))
def q_facility_distance_matrix(spark, sf_dir):
    d = facility_distances(_geocoded(spark, sf_dir), facility_dim(spark, sf_dir), RADIUS_KM)
    return d.select("listing_id", F.col("facility_id").cast("string").alias("facility_id"), "facility", F.round("km", 6).alias("km"))


@query("nearest_facility", with_listings(f"""
SELECT listing_id, CAST(facility_id AS VARCHAR) AS facility_id, facility, round(km, 6) AS km FROM (
  SELECT c.listing_id, f.facility_id, f.facility, {_HAV} AS km,
         row_number() OVER (PARTITION BY c.listing_id ORDER BY {_HAV}, f.facility_id) AS rk
  FROM clean_listings c LEFT JOIN geo g ON c.ku_name = g.ku_name LEFT JOIN facility f ON g.lat IS NOT NULL) t WHERE rk = 1""",
    _DIM_CTES))
def q_nearest_facility(spark, sf_dir):
    d = nearest_facility(_geocoded(spark, sf_dir), facility_dim(spark, sf_dir))
    return d.select("listing_id", F.col("facility_id").cast("string").alias("facility_id"), "facility", F.round("km", 6).alias("km"))


def _js_sql(day: str, value: str, source: str, end: str, width: float, bins: int) -> str:
    """Jensen-Shannon distance per day: bins -2 (missing), -1 (negative), 0..bins."""
    return f"""b AS (SELECT CAST({day} AS DATE) AS d,
                  CASE WHEN {value} IS NULL THEN -2 WHEN {value} < 0 THEN -1
                       ELSE least(CAST(floor({value} / {width}) AS INTEGER), {bins}) END AS bin FROM {source}),
ref AS (SELECT bin, count(*) * 1.0 / sum(count(*)) OVER () AS q FROM b WHERE d < DATE '{end}' GROUP BY bin),
cur AS (SELECT d, bin, count(*) AS c FROM b WHERE d >= DATE '{end}' GROUP BY d, bin),
tot AS (SELECT d, sum(c) AS n FROM cur GROUP BY d),
j AS (SELECT t.d, t.n, coalesce(c.c, 0) * 1.0 / t.n AS p, coalesce(r.q, 0.0) AS q
      FROM tot t CROSS JOIN range(-2, {bins + 1}) k(bin)
      LEFT JOIN cur c ON c.d = t.d AND c.bin = k.bin LEFT JOIN ref r ON r.bin = k.bin),
js AS (SELECT d, n, sqrt(greatest(sum(
         CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END +
         CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END), 0)) AS jsd
       FROM j GROUP BY d, n)"""


_JS_SELECT = (f"SELECT CAST(d AS VARCHAR) AS chunk, CAST(n AS BIGINT) AS n, round(jsd, 6) AS js_distance, "
              f"jsd > {JS_ALERT} AS alert FROM js")


@query("drift_js_daily", f"WITH readings AS (SELECT ts, {EVENT_VALUE} AS value FROM events),\n"
       + _js_sql("ts", "value", "readings", EVENTS_REFERENCE_END, JS_WIDTH, JS_BINS) + "\n" + _JS_SELECT)
def q_drift_js_daily(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").selectExpr("ts", f"{EVENT_VALUE} AS value")
    r = D.js_distance_daily(ev, "ts", "value", EVENTS_REFERENCE_END, JS_WIDTH, JS_BINS, JS_ALERT)
    return r.select("chunk", "n", F.round("js_distance", 6).alias("js_distance"), "alert")


def _calibrated_sql(day: str, value: str, source: str, end: str, bins: int, deviations: float) -> str:
    """Distances over bins of equal reference counts; the limit comes from each reference day against the others."""
    shares = ", ".join(f"{k / bins}" for k in range(1, bins))
    return f"""v AS (SELECT CAST({day} AS DATE) AS d, CAST({value} AS DOUBLE) AS x FROM {source}),
edge AS (SELECT DISTINCT unnest(quantile_disc(x, [{shares}])) AS e FROM v WHERE d < DATE '{end}' AND x IS NOT NULL),
numbered AS (SELECT e, row_number() OVER (ORDER BY e) AS k, lead(e) OVER (ORDER BY e) AS up FROM edge),
kinds AS (SELECT -2 AS bin UNION ALL SELECT 0 UNION ALL SELECT k FROM numbered),
cells AS (SELECT v.d, CASE WHEN v.x IS NULL THEN -2 ELSE coalesce(m.k, 0) END AS bin, count(*) AS c
          FROM v LEFT JOIN numbered m ON v.x >= m.e AND (m.up IS NULL OR v.x < m.up) GROUP BY 1, 2),
tot AS (SELECT d, sum(c) AS n FROM cells GROUP BY d),
full_ref AS (SELECT bin, sum(c) AS c FROM cells WHERE d < DATE '{end}' GROUP BY bin),
ref_n AS (SELECT coalesce(sum(c), 0) AS n FROM full_ref),
pq AS (SELECT t.d, t.n, coalesce(c.c, 0) * 1.0 / t.n AS p,
              (coalesce(f.c, 0) - CASE WHEN t.d < DATE '{end}' THEN coalesce(c.c, 0) ELSE 0 END) * 1.0
              / nullif(r.n - CASE WHEN t.d < DATE '{end}' THEN t.n ELSE 0 END, 0) AS q
       FROM tot t CROSS JOIN kinds k CROSS JOIN ref_n r
       LEFT JOIN cells c ON c.d = t.d AND c.bin = k.bin LEFT JOIN full_ref f ON f.bin = k.bin),
js AS (SELECT d, n, CASE WHEN count(q) > 0 THEN sqrt(greatest(sum(
         CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END +
         CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END), 0)) END AS jsd FROM pq GROUP BY d, n),
lim AS (SELECT least(avg(jsd) + {deviations} * stddev_samp(jsd), 1.0) AS alert_limit FROM js WHERE d < DATE '{end}')"""


_CALIBRATED_SELECT = ("SELECT CAST(d AS VARCHAR) AS chunk, CAST(n AS BIGINT) AS n, round(jsd, 6) AS js_distance, "
                      "round(alert_limit, 6) AS alert_limit, jsd > alert_limit AS alert FROM js CROSS JOIN lim WHERE d >= DATE '{}'")


def _calibrated_row(r):
    return r.select("chunk", "n", F.round("js_distance", 6).alias("js_distance"), F.round("alert_limit", 6).alias("alert_limit"), "alert")


@query("drift_js_calibrated", f"WITH readings AS (SELECT ts, {EVENT_VALUE} AS value FROM events),\n"
       + _calibrated_sql("ts", "value", "readings", EVENTS_REFERENCE_END, CALIBRATED_BINS, CALIBRATED_DEVIATIONS)
       + "\n" + _CALIBRATED_SELECT.format(EVENTS_REFERENCE_END))
def q_drift_js_calibrated(spark, sf_dir):
    """R5 with bins and alert limit from the reference."""
    ev = read_table(spark, sf_dir, "events").selectExpr("ts", f"{EVENT_VALUE} AS value")
    return _calibrated_row(D.js_drift_calibrated(ev, "ts", "value", EVENTS_REFERENCE_END, CALIBRATED_BINS, CALIBRATED_DEVIATIONS))


#: Every listing's prediction by the four-feature model of the reference period.
_PREDICTED = residualised("clean_listings", ["listing_id", "scraped_at", "rent_price"], NOTEBOOK_FEATURES, "rent_price",
                          f"scraped_at < TIMESTAMP '{LISTINGS_REFERENCE_END}'")


@query("prediction_drift_js_daily", with_listings(_JS_SELECT, _PREDICTED + ",\n" + _js_sql(
    "scraped_at", "predicted", "scored", LISTINGS_REFERENCE_END, PREDICTION_WIDTH, PREDICTION_BINS)))
def q_prediction_drift_js_daily(spark, sf_dir):
    """R5 on the model's predictions."""
    r = D.js_distance_daily(_scored(spark, sf_dir), "scraped_at", "predicted", LISTINGS_REFERENCE_END,
                            PREDICTION_WIDTH, PREDICTION_BINS, JS_ALERT)
    return r.select("chunk", "n", F.round("js_distance", 6).alias("js_distance"), "alert")


@query("prediction_drift_calibrated", with_listings(
    _CALIBRATED_SELECT.format(LISTINGS_REFERENCE_END), _PREDICTED + ",\n" + _calibrated_sql(
        "scraped_at", "round(predicted, 6)", "scored", LISTINGS_REFERENCE_END, CALIBRATED_BINS, CALIBRATED_DEVIATIONS)))
def q_prediction_drift_calibrated(spark, sf_dir):
    """R5 on the model's predictions, with bins and alert limit from the reference."""
    df = _scored(spark, sf_dir).select("scraped_at", F.round("predicted", 6).alias("predicted"))
    return _calibrated_row(D.js_drift_calibrated(df, "scraped_at", "predicted", LISTINGS_REFERENCE_END, CALIBRATED_BINS, CALIBRATED_DEVIATIONS))


@query("prediction_distribution_daily", with_listings("""
SELECT CAST(CAST(scraped_at AS DATE) AS VARCHAR) AS chunk, count(*) AS n, round(avg(predicted), 6) AS mean,
       round(quantile_disc(predicted, 0.05), 4) AS p05, round(quantile_disc(predicted, 0.5), 4) AS p50,
       round(quantile_disc(predicted, 0.95), 4) AS p95
FROM scored GROUP BY 1""", _PREDICTED))
def q_prediction_distribution_daily(spark, sf_dir):
    """R6 on the model's predictions."""
    d = D.distribution_daily(_scored(spark, sf_dir), "scraped_at", "predicted")
    return d.select("chunk", "n", F.round("mean", 6).alias("mean"), *[F.round(c, 4).alias(c) for c in ("p05", "p50", "p95")])


@query("drift_distribution_daily", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS chunk, count(*) AS n, round(avg(value), 8) AS mean,
       round(stddev_samp(value), 8) AS std,
       round(quantile_disc(value, 0.05), 4) AS p05, round(quantile_disc(value, 0.25), 4) AS p25,
       round(quantile_disc(value, 0.5), 4) AS p50, round(quantile_disc(value, 0.75), 4) AS p75,
       round(quantile_disc(value, 0.95), 4) AS p95
FROM events GROUP BY 1""")
def q_drift_distribution_daily(spark, sf_dir):
    d = D.distribution_daily(read_table(spark, sf_dir, "events"), "ts", "value")
    return d.select("chunk", "n", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"),
                    *[F.round(c, 4).alias(c) for c in ("p05", "p25", "p50", "p75", "p95")])


def _reference(df):
    return df.where(F.col("scraped_at") < F.lit(LISTINGS_REFERENCE_END).cast("timestamp_ntz"))


def _analysis(df):
    return df.where(F.col("scraped_at") >= F.lit(LISTINGS_REFERENCE_END).cast("timestamp_ntz"))


def _scored(spark, sf_dir):
    """Listings with the prediction of the four-feature model fitted on the reference period."""
    df = listings(spark, sf_dir)
    return E.with_residual(df, E.fit_linear(_reference(df), TARGET, NOTEBOOK_FEATURES))


@query("realised_mae_daily", with_listings(f"""
SELECT CAST(CAST(scraped_at AS DATE) AS VARCHAR) AS chunk, count(residual) AS n, round(avg(abs(residual)), 6) AS mae
FROM scored WHERE scraped_at >= TIMESTAMP '{LISTINGS_REFERENCE_END}' GROUP BY 1""", _PREDICTED))
def q_realised_mae_daily(spark, sf_dir):
    r = D.realised_mae_daily(_analysis(_scored(spark, sf_dir)), "scraped_at", TARGET, "predicted")
    return r.select("chunk", "n", F.round("mae", 6).alias("mae"))


@query("estimated_mae_daily")
def q_estimated_mae_daily(spark, sf_dir):
    """Learned from errors out of fold, with the sampling band of each day."""
    s = _scored(spark, sf_dir)
    known = _reference(s).select("listing_id", *NOTEBOOK_FEATURES, TARGET).dropna(subset=[TARGET])
    ref = D.out_of_fold(known, TARGET, NOTEBOOK_FEATURES, "listing_id")
    est = fitted_once("loss_estimator", ref, lambda: D.fit_loss_estimator(ref, NOTEBOOK_FEATURES, TARGET, "predicted"))
    return D.estimated_mae_daily(_analysis(s), est, "scraped_at", TARGET, "predicted", D.sampling_error(ref, TARGET, "predicted"))
