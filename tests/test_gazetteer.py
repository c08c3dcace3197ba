"""J1 by address: the longest place that an address starts with."""

from pyspark.sql import functions as F

from rentlens.operators.enrich import geocode_addresses

PLACES = [("東京都", 1.0, 1.0), ("東京都港区", 2.0, 2.0), ("東京都港区芝1", 3.0, 3.0), ("東京都 港区芝１－２", 4.0, 4.0), ("大阪府", 5.0, 5.0),
          ("大阪府", 4.5, 9.0), ("", 9.0, 9.0), ("  ", 9.0, 9.0), (None, 9.0, 9.0), ("東京", None, None)]
ADDRESSES = ["東京都港区芝1-2-3", "東京都 港区芝１丁目", "東京都港区", "東京都北区", "大阪府北区", "京都府", "", "　", None, "東京", "東京都港区" + "芝" * 200_000,
             "東京都港区", "東京都港区芝１－２－９"]


def plain(address):
    if address is None:
        return None
    table = str.maketrans("０１２３４５６７８９－", "0123456789-", " 　")
    hits = [(len(p.translate(table)), p, lat, lon) for p, lat, lon in PLACES if p and p.translate(table) and address.translate(table).startswith(p.translate(table))]
    top = [h for h in hits if h[0] == max(hits)[0]]
    return min(top)[1:] if top else None


def test_longest_place_wins(spark):
    places = spark.createDataFrame(PLACES, "place string, lat double, lon double")
    df = spark.createDataFrame(list(enumerate(ADDRESSES)), "listing_id int, address string").withColumn("LAT", F.lit("clash"))
    got = geocode_addresses(df, places)
    assert got.columns == ["listing_id", "address", "place", "lat", "lon"]
    rows = {r.listing_id: (r.place, r.lat, r.lon) for r in got.collect()}
    assert len(rows) == len(ADDRESSES) == got.count()
    for i, a in enumerate(ADDRESSES):
        assert rows[i] == (plain(a) or (None, None, None)), a
    assert geocode_addresses(df.where("false"), places).count() == 0
    assert geocode_addresses(df, places.where("false")).where("place is null").count() == len(ADDRESSES)


def test_joins_by_equality_only(spark):
    places = spark.createDataFrame(PLACES, "place string, lat double, lon double")
    df = spark.createDataFrame(list(enumerate(ADDRESSES)), "listing_id int, address string")
    plan = geocode_addresses(df, places)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
