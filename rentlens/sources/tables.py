"""Driver tables and the listing / dimension tables derived from them.

The driver tables hold no apartment listings, so listings are derived
deterministically from ``orders`` (one listing per order key) joined to the
customer's nation, which supplies the ward.  The recipe is SQL text so the
very same expressions feed Spark (``selectExpr``) and the DuckDB oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table; projections and filters push into it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The listing recipe (column name, SQL expression over
# o_orderkey AS k, o_orderdate, n_name).  Formats follow the listing site's
# text: 万円 money, m2 area, 築N年 age, 階建 storeys, 歩N分 walk.
LISTING_RECIPE = [
    ("listing_id", "k"),
    ("scraped_at", "o_orderdate"),
    ("rent_price",
     "CASE WHEN k % 71 = 0 THEN NULL ELSE CAST(6 + k % 12 AS STRING) || CASE WHEN k % 10 = 0 THEN '' ELSE '.' || CAST(k % 10 AS STRING) END || '万円' END"),
    ("sqr_m",
     "CASE WHEN k % 97 = 0 THEN NULL ELSE CAST(18 + 2 * (k % 12) + k % 5 AS STRING) || '.' || lpad(CAST(k % 100 AS STRING), 2, '0') || 'm2' END"),
    ("rei_price",
     "CASE WHEN k % 83 = 0 THEN NULL WHEN k % 5 = 0 THEN '-' ELSE CAST(6 + k % 12 AS STRING) || '.' || lpad(CAST((k * 7) % 100 AS STRING), 2, '0') || '万円' END"),
    ("shikikin",
     "CASE WHEN k % 89 = 0 THEN NULL WHEN k % 10 = 3 THEN '-' ELSE CAST(6 + k % 12 AS STRING) || '万円' END"),
    ("maintenence_price",
     "CASE WHEN k % 79 = 0 THEN NULL WHEN k % 11 = 0 THEN '-' ELSE CAST(1000 + 500 * (k % 20) AS STRING) || '円' END"),
    ("nearest_eki",
     "CASE WHEN k % 67 = 0 THEN NULL WHEN k % 73 = 0 THEN '-' ELSE '第' || CAST(k % 7 AS STRING) || '線/S' || CAST(k % 40 AS STRING) || '駅 歩' || CAST(1 + k % 15 AS STRING) || '分' END"),
    ("apartment_type",
     "CASE k % 4 WHEN 0 THEN '1K' WHEN 1 THEN '1DK' WHEN 2 THEN '2K' ELSE '1LDK' END"),
    ("year_built",
     "CASE WHEN k % 9 = 0 THEN '新築' WHEN k % 101 = 0 THEN '-' ELSE '築' || CAST(1 + k % 50 AS STRING) || '年' END"),
    ("ku_name",
     "CASE WHEN k % 53 = 0 THEN '大阪府' ELSE '東京都' END || n_name || '区' || CAST(k % 6 AS STRING)"),
    ("floor",
     "CASE WHEN k % 61 = 0 THEN '階建' WHEN k % 8 = 0 THEN chr(10) || '地下1地上' || CAST(5 + k % 35 AS STRING) || '階建' || chr(10) ELSE CAST(1 + k % 15 AS STRING) || '階建' || chr(10) END"),
    ("house_type",
     "CASE WHEN k % 25 = 0 THEN '賃貸アパート' ELSE '賃貸マンション' END"),
]
# Fields whose text does not parse, or has the other money unit;
# for the permissive clean and the money parsers only.
ODD_RECIPE = {
    "rent_price": "CASE WHEN k % 29 = 0 THEN '102,000円' WHEN k % 31 = 0 THEN '98000円' WHEN k % 71 = 0 THEN NULL ELSE rent_price END",
    "sqr_m": "CASE WHEN k % 41 = 0 THEN '約25m2' ELSE sqr_m END",
    "maintenence_price": "CASE WHEN k % 19 = 0 THEN '1.2万円' WHEN k % 23 = 0 THEN '込み' ELSE maintenence_price END",
    "nearest_eki": "CASE WHEN k % 37 = 0 THEN 'バス10分' ELSE nearest_eki END",
    "year_built": "CASE WHEN k % 43 = 0 THEN '築99年以上' ELSE year_built END",
    "floor": "CASE WHEN k % 47 = 0 THEN '平屋' ELSE floor END",
}
# address repeats the ward text; name_place is a building label from the key.
LISTING_EXTRA = [
    ("address", "CASE WHEN k % 53 = 0 THEN '大阪府' ELSE '東京都' END || n_name || '区' || CAST(k % 6 AS STRING)"),
    ("name_place", "'B' || CAST(k AS STRING)"),
]
RAW_ORDER = ["listing_id", "scraped_at", "rent_price", "address", "sqr_m", "name_place",
             "rei_price", "shikikin", "maintenence_price", "nearest_eki", "apartment_type",
             "year_built", "ku_name", "floor", "house_type"]


def listing_select_sql() -> str:
    """The recipe as one SELECT list (shared by Spark and the oracles)."""
    exprs = dict(LISTING_RECIPE + LISTING_EXTRA)
    return ",\n ".join(f"{exprs[c]} AS {c}" for c in RAW_ORDER)


ODD_COLUMNS = [f"{ODD_RECIPE[c].replace('k %', 'listing_id %')} AS {c}" if c in ODD_RECIPE else c for c in RAW_ORDER]


def odd_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw listings with fields that a fail-mode clean would refuse."""
    return raw_listings(spark, sf_dir).selectExpr(*ODD_COLUMNS)


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw 13-field listings (all text) plus ``listing_id`` and ``scraped_at``.

    orders ⋈ customer is the one large join (AQE splits a hot customer); nation
    is a dimension, which Catalyst broadcasts if its bytes allow.
    """
    return listings_from(read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer"),
                         read_table(spark, sf_dir, "nation"))


def land(df: DataFrame, path: str) -> DataFrame:
    """Write a derived table to ``path`` and read it back (a pipeline that uses it often does so once)."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listings_from(orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """The listing recipe over given orders / customer / nation frames."""
    orders = orders.select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderdate")
    customer = customer.select("c_custkey", "c_nationkey")
    nation = nation.select("n_nationkey", "n_name")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    joined = joined.join(nation, joined.c_nationkey == nation.n_nationkey)
    exprs = dict(LISTING_RECIPE + LISTING_EXTRA)
    return joined.selectExpr(*[f"{exprs[c]} AS {c}" for c in RAW_ORDER])


# Geocode dimension from nation (ward → point); one nation in
# six is left out so that some lookups miss, as a failed geocode does.
GEO_SQL = ("SELECT n_name AS ku_name, 35.5 + 0.01 * n_nationkey AS lat, "
           "139.5 + 0.015 * n_nationkey AS lon FROM nation WHERE n_nationkey % 6 <> 5")
# Facility dimension from region (five facilities).
FACILITY_SQL = ("SELECT r_regionkey AS facility_id, r_name AS facility, "
                "35.55 + 0.05 * r_regionkey AS flat, 139.85 - 0.06 * r_regionkey AS flon FROM region")


# Gazetteer from nation, places of three sizes: the metropolis, five in six of its wards,
# and three districts of every second ward (the addresses name six).
GAZETTEER_SQL = (
    "SELECT '東京都' AS place, 35.68 AS lat, 139.69 AS lon FROM nation WHERE n_nationkey = 0 UNION ALL "
    "SELECT '東京都' || n_name || '区', 35.5 + 0.01 * n_nationkey, 139.5 + 0.015 * n_nationkey FROM nation WHERE n_nationkey % 6 <> 5 UNION ALL "
    "SELECT '東京都' || n_name || '区' || CAST(r_regionkey AS STRING), 35.5 + 0.01 * n_nationkey + 0.001 * r_regionkey, "
    "139.5 + 0.015 * n_nationkey - 0.001 * r_regionkey FROM nation JOIN region ON r_regionkey <> n_nationkey "
    "WHERE n_nationkey % 2 = 0 AND r_regionkey < 3")


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place, lat, lon): the three parts of ``GAZETTEER_SQL``."""
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    ward = F.concat(F.lit("東京都"), F.col("n_name"), F.lit("区"))
    lat, lon = F.lit(35.5) + F.lit(0.01) * F.col("n_nationkey"), F.lit(139.5) + F.lit(0.015) * F.col("n_nationkey")
    whole = nation.where("n_nationkey = 0").select(F.lit("東京都").alias("place"), F.lit(35.68).alias("lat"), F.lit(139.69).alias("lon"))
    wards = nation.where("n_nationkey % 6 <> 5").select(ward.alias("place"), lat.alias("lat"), lon.alias("lon"))
    numbers = F.filter(F.array(*[F.lit(k) for k in range(3)]), lambda k: k != F.col("n_nationkey"))
    district = nation.where("n_nationkey % 2 = 0").withColumn("k", F.explode(numbers)).join(
        region.select(F.col("r_regionkey").cast("int").alias("k")), "k")
    districts = district.select(F.concat(ward, F.col("k").cast("string")).alias("place"),
                                (lat + F.lit(0.001) * F.col("k")).alias("lat"), (lon - F.lit(0.001) * F.col("k")).alias("lon"))
    return whole.unionByName(wards).unionByName(districts)


def geo_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    return (n.where(F.col("n_nationkey") % 6 != 5)
             .select(F.col("n_name").alias("ku_name"),
                     (F.lit(35.5) + F.lit(0.01) * F.col("n_nationkey")).cast("double").alias("lat"),
                     (F.lit(139.5) + F.lit(0.015) * F.col("n_nationkey")).cast("double").alias("lon")))


def facility_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_table(spark, sf_dir, "region")
    return r.select(F.col("r_regionkey").alias("facility_id"), F.col("r_name").alias("facility"),
                    (F.lit(35.55) + F.lit(0.05) * F.col("r_regionkey")).cast("double").alias("flat"),
                    (F.lit(139.85) - F.lit(0.06) * F.col("r_regionkey")).cast("double").alias("flon"))
