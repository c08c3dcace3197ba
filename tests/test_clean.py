"""Clean step totals, computed from the recipe by hand, and rejects."""

from pyspark.sql import functions as F

from rentlens.operators.clean import clean_listings, clean_with_rejects
from rentlens.schema import CLEAN_COLUMNS
from rentlens.sources.tables import raw_listings
from tests.conftest import SF_CHECK


def test_clean_totals_sf001(spark):
    df = clean_listings(raw_listings(spark, SF_CHECK))
    assert df.columns == ["listing_id", "scraped_at", *CLEAN_COLUMNS]
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count("ku_name").alias("wards"),
               F.countDistinct("ku_name").alias("dw"), F.countDistinct("eki_name").alias("de"),
               F.sum("rent_price").alias("rent"), F.sum("sqr_m").alias("sqm"), F.sum("rei_price").alias("rei"),
               F.sum("shikikin").alias("shiki"), F.sum("maintenence_price").alias("maint"),
               F.sum("year_built").alias("age"), F.sum("floor").alias("floor"), F.sum("eki_walk").alias("walk")).first()
    assert (r["n"], r["wards"], r["dw"], r["de"]) == (14845, 14564, 25, 281)  # the 280 stations and '0'
    assert round(r["rent"], 2) == 174899.0 and round(r["sqm"], 2) == 467551.05
    assert round(r["rei"], 2) == 140802.07 and round(r["shiki"], 2) == 151175
    assert round(r["maint"], 2) == 76599500
    assert (r["age"], r["floor"], r["walk"]) == (333185, 142353, 115338)


def test_rejects_split(spark):
    rows = [(1, "10万円", "20m2", "-", "-", "-", "駅 歩5分", "築3年", "3階建", "東京都A区"),
            (2, "x万円", "20m2", "-", "-", "-", "バス10分", "平屋", "３階建", "東京都B区")]
    cols = "listing_id long, rent_price string, sqr_m string, rei_price string, shikikin string, " \
           "maintenence_price string, nearest_eki string, year_built string, floor string, ku_name string"
    out = {r["listing_id"]: r for r in clean_with_rejects(spark.createDataFrame(rows, cols)).collect()}
    assert out[1]["rejected"] == []
    assert sorted(out[2]["rejected"]) == ["eki_walk", "floor", "rent_price", "year_built"]
