"""Geocode lookup and distances to facilities.

J1 is an equi-join to a geocode dimension (by ward) or to the places of a
gazetteer (by address, longest place first); Catalyst's byte threshold and AQE
choose between broadcast and shuffle.  J2 and J3 are spatial equi-joins: points
on the unit sphere fall into cubic cells, and all facilities within one cell
width (as a straight line through the sphere) of a point lie in the point's
cell or one of its 26 neighbours.  Only distinct listing points are joined;
listings get their result by a join on the point.  Nothing is collected, and no
pair outside neighbouring cells is formed.  A listing without a point keeps its
row with nulls, as a failed geocode does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions.geo import EARTH_RADIUS_KM, haversine_km
from rentlens.session import scratch_path

#: Half the circumference: no two points are further apart.
EVERYWHERE_KM = math.pi * EARTH_RADIUS_KM


def geocode(df: DataFrame, geo: DataFrame, key: str = "ku_name") -> DataFrame:
    """Left join to (key, lat, lon); a failed lookup leaves lat/lon null."""
    return df.join(geo, key, "left")


def address_key(address: Column) -> Column:
    """An address without white space, full-width digits and hyphens as ASCII ones."""
    return F.regexp_replace(F.translate(address.cast("string"), "０１２３４５６７８９－−", "0123456789--"), r"[\s\u3000]+", "")


def geocode_addresses(df: DataFrame, gazetteer: DataFrame, address: str = "address") -> DataFrame:
    """J1 by address: ``df`` with place, lat, lon of the longest gazetteer ``place`` that the address starts with.

    Distinct addresses give one key for each length that a place has (so a very long address gives no more than a
    short one); the keys are joined to the places by equality and the longest hit of an address wins.  Only the places'
    lengths reach the driver.  Both sides are compared by ``address_key``.  A place that the gazetteer lists more
    than once has the smallest (place, lat, lon); blank places fit nothing.  Addresses that are null, blank or fit
    no place keep their row with nulls.  Columns of ``df`` named place, lat or lon are replaced.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("place", "lat", "lon")])
    places = (gazetteer.select(address_key(F.col("place")).alias("place_key"), F.struct("place", "lat", "lon").alias("at"))
              .where(F.col("place_key") != "").groupBy("place_key").agg(F.min("at").alias("at")))
    sizes = sorted(r[0] for r in places.select(F.length("place_key")).distinct().collect())
    known = df.select(F.col(address).alias("found_address")).where(F.col("found_address").isNotNull()).distinct()
    key = known.withColumn("whole", address_key(F.col("found_address")))
    lengths = F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"), lambda n: n <= F.length("whole"))
    keys = key.withColumn("size", F.explode(lengths)).select("found_address", "size", F.expr("substr(whole, 1, size)").alias("place_key"))
    best = keys.join(places, "place_key").groupBy("found_address").agg(F.max_by("at", "size").alias("at"))
    joined = df.join(best, F.col(address) == F.col("found_address"), "left")
    return joined.select(*df.columns, "at.place", "at.lat", "at.lon")


def _chord(km: float) -> float:
    """Straight-line distance on the unit sphere of a great-circle distance."""
    return 2 * math.sin(min(km, EVERYWHERE_KM) / (2 * EARTH_RADIUS_KM))


def _cell(lat: Column, lon: Column, width: float) -> list[Column]:
    la, lo = F.radians(lat), F.radians(lon)
    xyz = (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))
    return [F.floor(c / F.lit(width)).cast("long") for c in xyz]


def _points(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return (df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
              .select(F.col(lat).cast("double").alias("plat"), F.col(lon).cast("double").alias("plon")).distinct())


def _pairs_within(points: DataFrame, facilities: DataFrame, km: float) -> DataFrame:
    """(plat, plon, facility_id, facility, km) for all pairs at most ``km`` apart."""
    width = _chord(km) * (1 + 1e-9)
    fx, fy, fz = _cell(F.col("flat"), F.col("flon"), width)
    fac = (facilities.where("flat is not null and flon is not null")
           .select("facility_id", "facility", F.col("flat").cast("double").alias("flat"),
                   F.col("flon").cast("double").alias("flon"), fx.alias("cx"), fy.alias("cy"), fz.alias("cz")))
    px, py, pz = _cell(F.col("plat"), F.col("plon"), width)
    near = points.select("plat", "plon", px.alias("x"), py.alias("y"), pz.alias("z"))
    for c in ("x", "y", "z"):
        near = near.withColumn(f"c{c}", F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])))
    dist = haversine_km(F.col("plat"), F.col("plon"), F.col("flat"), F.col("flon"))
    return (near.join(fac, ["cx", "cy", "cz"])
                .select("plat", "plon", "facility_id", "facility", dist.alias("km")).where(F.col("km") <= km))


def _on_point(df: DataFrame, found: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.join(found, (F.col(lat).cast("double") == F.col("plat")) & (F.col(lon).cast("double") == F.col("plon")), "left")


def facility_distances(df: DataFrame, facilities: DataFrame, radius_km: float, lat: str = "lat", lon: str = "lon",
                       keep: list[str] | None = None) -> DataFrame:
    """One row per listing and facility within ``radius_km`` (great circle); a listing without any
    (or without a point) has one row with nulls.  ``EVERYWHERE_KM`` asks for all facilities."""
    keep = keep or ["listing_id"]
    found = _pairs_within(_points(df, lat, lon), facilities, radius_km)
    return _on_point(df, found, lat, lon).select(*keep, "facility_id", "facility", "km")


def nearest_facility(df: DataFrame, facilities: DataFrame, lat: str = "lat", lon: str = "lon",
                     keep: list[str] | None = None, start_km: float = 4.0, growth: float = 4.0) -> DataFrame:
    """The closest facility per listing (ties → lower facility_id); nulls without a point.

    Points are searched within ``start_km``, those without a facility there
    within ``growth`` times that, and so on up to the whole sphere: a facility
    found within the radius is nearer than any beyond it.
    """
    keep = keep or ["listing_id"]
    spark, radius, parts = df.sparkSession, start_km, []
    open_points = _written(spark, _points(df, lat, lon))
    while True:
        best = (_pairs_within(open_points, facilities, radius).groupBy("plat", "plon")
                .agg(F.min(F.struct("km", "facility_id", "facility")).alias("best")))
        parts.append(_written(spark, best))
        if radius >= EVERYWHERE_KM:
            break
        open_points = _written(spark, open_points.join(parts[-1], ["plat", "plon"], "left_anti"))
        if open_points.isEmpty():
            break
        radius = min(radius * growth, EVERYWHERE_KM)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return _on_point(df, found, lat, lon).select(*keep, "best.facility_id", "best.facility", "best.km")


def _written(spark, df: DataFrame) -> DataFrame:
    """A table of distinct points in the shared scratch folder (each round reads the last one's)."""
    path = scratch_path(spark, "points")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
