"""Queries over the derived listings: parsers (C1-C11, X4), projections and
null handling (P1-P8), stacking and profiling (U1-U4), value reports (G1, G2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentlens.functions import parse as P
from rentlens.operators import relational as R
from rentlens.operators.value import bargain_topk, ward_value_summary
from rentlens.plans.common import listings, raw
from rentlens.plans.registry import query
from rentlens.operators.clean import clean_with_rejects
from rentlens.plans.sql import CLEAN_CTE, FIT_ALL, ODD_CTE, _money, _rent, _s, with_listings
from rentlens.sources.tables import odd_listings, read_table

# The columns that the models do not use.
MODEL_DROP = ["name_place", "address", "eki_name", "apartment_type", "house_type", "ku_name"]


def _raw_col(name: str):
    return P.strip_newlines(F.col(name))


# ---------------------------------------------------------------- C11, G1, G2

@query("clean_listings", with_listings("SELECT * FROM clean_listings"))
def q_clean_listings(spark, sf_dir):
    return listings(spark, sf_dir)


@query("ward_value_summary", with_listings("""
SELECT ku_name, apartment_type, count(*) AS listings,
 round(avg(rent_price), 8) AS avg_rent, round(avg(sqr_m), 8) AS avg_sqr_m,
 round(avg(rent_price * 10000.0 / sqr_m), 2) AS avg_yen_per_sqm,
 round(quantile_disc(rent_price * 10000.0 / sqr_m, 0.5), 2) AS median_yen_per_sqm
FROM clean_listings GROUP BY ku_name, apartment_type"""))
def q_ward_value_summary(spark, sf_dir):
    return ward_value_summary(listings(spark, sf_dir))


@query("bargain_topk", with_listings("""
SELECT ku_name, CAST(bargain_rank AS INTEGER) AS bargain_rank, listing_id, rent_price, sqr_m,
 round(predicted, 4) AS predicted_rent, round(residual, 4) AS residual
FROM (SELECT c.ku_name, c.listing_id, c.rent_price, c.sqr_m,
        f.intercept + f.slope * c.sqr_m AS predicted,
        c.rent_price - (f.intercept + f.slope * c.sqr_m) AS residual,
        row_number() OVER (PARTITION BY c.ku_name
          ORDER BY c.rent_price - (f.intercept + f.slope * c.sqr_m), c.listing_id) AS bargain_rank
      FROM clean_listings c CROSS JOIN fit f WHERE c.ku_name IS NOT NULL AND c.rent_price IS NOT NULL) t
WHERE bargain_rank <= 3""", FIT_ALL))
def q_bargain_topk(spark, sf_dir):
    return bargain_topk(listings(spark, sf_dir), k=3)


PERMISSIVE_CTE = CLEAN_CTE.replace("clean_listings AS (", "permissive AS (", 1).replace("CAST(", "TRY_CAST(").replace("FROM raw_listings", "FROM odd_listings")
_REJECT_SOURCES = {"sqr_m": "sqr_m", "year_built": "year_built", "floor": "floor", "eki_walk": "nearest_eki",
                   "rent_price": "rent_price", "rei_price": "rei_price", "shikikin": "shikikin",
                   "maintenence_price": "maintenence_price"}


@query("clean_listings_permissive", with_listings(
    "SELECT p.* REPLACE (CAST(p.year_built AS DOUBLE) AS year_built, CAST(p.floor AS DOUBLE) AS floor, CAST(p.eki_walk AS DOUBLE) AS eki_walk), " + " + ".join(f"CASE WHEN r.{src} IS NOT NULL AND p.{c} IS NULL THEN 1 ELSE 0 END"
                                for c, src in _REJECT_SOURCES.items())
    + " AS n_rejected FROM permissive p JOIN odd_listings r ON p.listing_id = r.listing_id",
    ODD_CTE + ",\n" + PERMISSIVE_CTE))
def q_clean_listings_permissive(spark, sf_dir):
    """Permissive clean; unparsable fields become null and are counted per row."""
    df = clean_with_rejects(odd_listings(spark, sf_dir))
    # as doubles, which hold nulls alike in both engines' frames
    ints = {c: F.col(c).cast("double") for c in ("year_built", "floor", "eki_walk")}
    return df.withColumns(ints).withColumn("n_rejected", F.size("rejected")).drop("rejected")


# ---------------------------------------------------------------- C1-C10, X4

@query("parse_area", with_listings(
    f"SELECT listing_id, CAST(split_part({_s('sqr_m')}, 'm', 1) AS DOUBLE) AS sqr_m FROM raw_listings"))
def q_parse_area(spark, sf_dir):
    return raw(spark, sf_dir).select("listing_id", P.parse_area(_raw_col("sqr_m")).alias("sqr_m"))


MONEY = ["rei_price", "shikikin", "maintenence_price"]


@query("parse_money", with_listings(
    f"SELECT listing_id, {_rent('rent_price')} AS rent_price, " + ", ".join(f"{_money(c)} AS {c}" for c in MONEY) + " FROM raw_listings"))
def q_parse_money(spark, sf_dir):
    return raw(spark, sf_dir).select(
        "listing_id", P.parse_rent(_raw_col("rent_price")).alias("rent_price"),
        *[P.parse_money(_raw_col(c)).alias(c) for c in MONEY])


@query("parse_fee_yen", with_listings(
    "SELECT listing_id, TRY_CAST(split_part(maintenence_price, '円', 1) AS DOUBLE) AS maintenance_yen "
    "FROM raw_listings"))
def q_parse_fee_yen(spark, sf_dir):
    # '-' is not a number in this variant; permissive mode turns it into null.
    return raw(spark, sf_dir).select(
        "listing_id", P.parse_fee_yen(_raw_col("maintenence_price"), "permissive").alias("maintenance_yen"))


def _yen_sql(c: str) -> str:
    s = _s(c)
    num = f"TRY_CAST(replace(replace({s}, '万円', ''), '円', '') AS DOUBLE)"
    return (f"CASE WHEN {s} IS NULL OR {s} = '-' THEN 0.0 ELSE round(CASE WHEN suffix({s}, '万円') "
            f"THEN {num} * 10000.0 ELSE {num} END, 0) END")


YEN_NAMES = {"rent_price": "rent_yen", "rei_price": "rei_yen", "shikikin": "shikikin_yen",
             "maintenence_price": "maintenance_yen"}


@query("parse_money_to_yen", with_listings(
    "SELECT listing_id, " + ", ".join(f"{_yen_sql(c)} AS {n}" for c, n in YEN_NAMES.items())
    + " FROM odd_listings", ODD_CTE))
def q_parse_money_to_yen(spark, sf_dir):
    return odd_listings(spark, sf_dir).select(
        "listing_id", *[P.parse_money_to_yen(_raw_col(c), "permissive").alias(n) for c, n in YEN_NAMES.items()])


_AGE = _s("year_built")


@query("parse_building_age", with_listings(f"""
SELECT listing_id, CASE WHEN {_AGE} = '-' THEN 0
  WHEN strpos({_AGE}, '新築') > 0 THEN CAST(replace({_AGE}, '新築', '0') AS INTEGER)
  ELSE CAST(replace(replace({_AGE}, '年', ''), '築', '') AS INTEGER) END AS year_built
FROM raw_listings"""))
def q_parse_building_age(spark, sf_dir):
    return raw(spark, sf_dir).select("listing_id", P.parse_building_age(_raw_col("year_built")).alias("year_built"))


_FL = "replace(floor, chr(10), '')"
_FLT = (f"CASE WHEN strpos({_FL}, '地上') > 0 THEN split_part(split_part({_FL}, '地上', 2), '階', 1) "
        f"ELSE split_part({_FL}, '階', 1) END")


@query("parse_storeys", with_listings(
    f"SELECT listing_id, CASE WHEN ({_FLT}) IS NULL OR ({_FLT}) = '' THEN 0 "
    f"ELSE CAST({_FLT} AS INTEGER) END AS floor FROM raw_listings"))
def q_parse_storeys(spark, sf_dir):
    return raw(spark, sf_dir).select("listing_id", P.parse_storeys(F.col("floor")).alias("floor"))


_E = _s("nearest_eki")


@query("parse_station_walk", with_listings(
    f"SELECT listing_id, CASE WHEN {_E} IS NULL OR {_E} IN ('-', 'nan') THEN 0 "
    f"ELSE CAST(split_part(split_part({_E}, '歩', 2), '分', 1) AS INTEGER) END AS eki_walk FROM raw_listings"))
def q_parse_station_walk(spark, sf_dir):
    return raw(spark, sf_dir).select("listing_id", P.parse_station_walk(_raw_col("nearest_eki")).alias("eki_walk"))


@query("parse_station_text", with_listings(
    f"SELECT listing_id, CASE WHEN {_E} IS NULL OR {_E} IN ('-', 'nan') THEN '0' "
    f"ELSE split_part({_E}, '歩', 1) END AS eki_name FROM raw_listings"))
def q_parse_station_text(spark, sf_dir):
    return raw(spark, sf_dir).select("listing_id", P.parse_station_text(_raw_col("nearest_eki")).alias("eki_name"))


_ST = f"split_part({_E}, '駅', 1)"


@query("parse_line_and_station", with_listings(
    f"SELECT listing_id, {_ST} AS eki_full, split_part({_ST}, '/', 1) AS line, "
    f"CASE WHEN strpos({_ST}, '/') > 0 THEN split_part({_ST}, '/', 2) END AS station FROM raw_listings"))
def q_parse_line_and_station(spark, sf_dir):
    e = _raw_col("nearest_eki")
    line, station = P.split_line_station(e)
    return raw(spark, sf_dir).select("listing_id", P.parse_station_name(e).alias("eki_full"),
                                     line.alias("line"), station.alias("station"))


_W = _s("ku_name")


@query("parse_ward", with_listings(
    f"SELECT listing_id, CASE WHEN strpos({_W}, '東京都') > 0 "
    f"THEN split_part(split_part({_W}, '東京都', 2), '区', 1) END AS ku_name FROM raw_listings"))
def q_parse_ward(spark, sf_dir):
    return raw(spark, sf_dir).select("listing_id", P.parse_ward(_raw_col("ku_name")).alias("ku_name"))


@query("text_slice_from", with_listings(
    "SELECT listing_id, substr(nearest_eki, 6) AS eki_tail FROM raw_listings"))
def q_text_slice_from(spark, sf_dir):
    return raw(spark, sf_dir).select("listing_id", P.text_slice_from(F.col("nearest_eki"), 5).alias("eki_tail"))


# ---------------------------------------------------------------- P1-P8

@query("drop_columns", with_listings(
    "SELECT listing_id, scraped_at, rent_price, sqr_m, rei_price, shikikin, maintenence_price, "
    "year_built, floor, eki_walk FROM clean_listings"))
def q_drop_columns(spark, sf_dir):
    return R.drop_columns(listings(spark, sf_dir), MODEL_DROP, strict=True)


@query("select_features", with_listings(
    "SELECT listing_id, sqr_m, rei_price, shikikin, maintenence_price, year_built, floor, eki_walk, "
    "rent_price FROM clean_listings"))
def q_select_features(spark, sf_dir):
    from rentlens.schema import FEATURES, TARGET
    return R.select_columns(listings(spark, sf_dir), ["listing_id", *FEATURES, TARGET])


@query("sanitize_column_names", with_listings(
    "SELECT listing_id AS listingid, rent_price, sqr_m AS sqr_mm2, eki_walk AS ekiwalkmin "
    "FROM clean_listings"))
def q_sanitize_column_names(spark, sf_dir):
    df = listings(spark, sf_dir).select(
        F.col("listing_id").alias("listing id#"), F.col("rent_price").alias("rent_price(万円)"),
        F.col("sqr_m").alias("sqr_m [m2]"), F.col("eki_walk").alias("eki-walk min"))
    return R.sanitize_column_names(df)


@query("filter_not_null", with_listings(
    "SELECT listing_id, sqr_m FROM raw_listings WHERE sqr_m IS NOT NULL"))
def q_filter_not_null(spark, sf_dir):
    return R.filter_not_null(raw(spark, sf_dir), ["sqr_m"]).select("listing_id", "sqr_m")


@query("fill_null_columns", with_listings(
    "SELECT listing_id, coalesce(rei_price, '0') AS rei_price, coalesce(shikikin, '0') AS shikikin, "
    "coalesce(maintenence_price, '0') AS maintenence_price FROM raw_listings"))
def q_fill_null_columns(spark, sf_dir):
    df = raw(spark, sf_dir).select("listing_id", "rei_price", "shikikin", "maintenence_price")
    return R.fill_null_columns(df, {"rei_price": "0", "shikikin": "0", "maintenence_price": "0"})


_P6 = ["rei_price", "shikikin", "maintenence_price", "year_built"]


@query("replace_values", with_listings(
    "SELECT listing_id, " + ", ".join(f"CASE WHEN {c} IN ('-', 'nan', '') THEN '0' ELSE {c} END AS {c}"
                                      for c in _P6) + " FROM raw_listings"))
def q_replace_values(spark, sf_dir):
    df = raw(spark, sf_dir).select("listing_id", *_P6)
    return R.replace_values(df, {"-": "0", "nan": "0", "": "0"})


_RAW_ORDER_STR = ["rent_price", "address", "sqr_m", "name_place", "rei_price", "shikikin",
                  "maintenence_price", "nearest_eki", "apartment_type", "year_built", "ku_name",
                  "floor", "house_type"]


@query("regex_replace_all_columns", with_listings(
    "SELECT listing_id, scraped_at, " + ", ".join(f"replace({c}, chr(10), '') AS {c}" for c in _RAW_ORDER_STR)
    + " FROM raw_listings"))
def q_regex_replace_all_columns(spark, sf_dir):
    return R.replace_in_strings(raw(spark, sf_dir), "\n", "")


@query("cast_columns", with_listings(
    "SELECT listing_id, CAST(trunc(rei_price) AS INTEGER) AS rei_price, "
    "CAST(trunc(maintenence_price) AS INTEGER) AS maintenence_price, "
    "CAST(year_built AS VARCHAR) AS year_built, CAST(floor AS DOUBLE) AS floor FROM clean_listings"))
def q_cast_columns(spark, sf_dir):
    df = listings(spark, sf_dir).select("listing_id", "rei_price", "maintenence_price", "year_built", "floor")
    return R.cast_columns(df, {"rei_price": "int", "maintenence_price": "int",
                               "year_built": "string", "floor": "double"})


# ---------------------------------------------------------------- U1-U4

@query("union_by_name", with_listings("""
SELECT listing_id, rent_price, sqr_m, CAST(NULL AS DOUBLE) AS maintenence_price
FROM clean_listings WHERE scraped_at < TIMESTAMP '1998-01-01'
UNION ALL
SELECT listing_id, rent_price, CAST(NULL AS DOUBLE) AS sqr_m, maintenence_price
FROM clean_listings WHERE scraped_at >= TIMESTAMP '1998-01-01'"""))
def q_union_by_name(spark, sf_dir):
    df = listings(spark, sf_dir)
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    early = df.where(F.col("scraped_at") < cut).select("listing_id", "rent_price", "sqr_m")
    late = df.where(F.col("scraped_at") >= cut).select("listing_id", "maintenence_price", "rent_price")
    return R.union_by_name([early, late])


@query("distinct_in_order", """
SELECT value, min(row) AS first_row FROM (SELECT o_orderpriority || ' ' || CAST(o_custkey % 997 AS VARCHAR) AS value, row_number() OVER () - 1 AS row FROM orders) o
GROUP BY value""")
def q_distinct_in_order(spark, sf_dir):
    """Over the rows of the orders file as they lie in it."""
    value = F.concat_ws(" ", "o_orderpriority", (F.col("o_custkey") % 997).cast("string"))
    return R.distinct_in_order(read_table(spark, sf_dir, "orders"), value).select("value", "first_row")


@query("distinct_values", with_listings("SELECT DISTINCT ku_name FROM clean_listings"))
def q_distinct_values(spark, sf_dir):
    return R.distinct_values(listings(spark, sf_dir), "ku_name")


@query("head_rows", with_listings("SELECT * FROM clean_listings ORDER BY listing_id LIMIT 5"))
def q_head_rows(spark, sf_dir):
    return R.head_rows(listings(spark, sf_dir), 5, ["listing_id"])


_PROFILE_TYPES = {"listing_id": "bigint", "scraped_at": "timestamp_ntz"}
_PROFILE_COLS = ["listing_id", "scraped_at", "rent_price", "address", "sqr_m", "name_place", "rei_price",
                 "shikikin", "maintenence_price", "nearest_eki", "apartment_type", "year_built",
                 "ku_name", "floor", "house_type"]


@query("profile_columns", with_listings("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, '{_PROFILE_TYPES.get(c, 'string')}' AS dtype, count({c}) AS non_null "
    f"FROM raw_listings" for c in _PROFILE_COLS)))
def q_profile_columns(spark, sf_dir):
    return R.profile_columns(raw(spark, sf_dir))
