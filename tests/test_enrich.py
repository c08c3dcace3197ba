"""J1-J3 against brute force, with many facilities and odd points."""

import math
import random

import pytest

from rentlens.operators.enrich import EVERYWHERE_KM, facility_distances, geocode, nearest_facility

KM = 6371.0


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * KM * math.asin(math.sqrt(h))


def places(seed, n, box):
    rng = random.Random(seed)
    return [(rng.uniform(*box[0]), rng.uniform(*box[1])) for _ in range(n)]


LISTINGS = places(1, 30, ((35.0, 36.0), (139.0, 140.0))) + [(35.5, 139.5)] * 20 + [(89.9, 10.0), (-60.0, 179.99), (0.0, -179.99)]


def frames(spark, facilities):
    rows = [(i, *p) for i, p in enumerate(LISTINGS)] + [(100, None, 139.0), (101, 35.0, None)]
    f = [(i, f"f{i}", *p) for i, p in enumerate(facilities)]
    return (spark.createDataFrame(rows, "listing_id int, lat double, lon double"),
            spark.createDataFrame(f, "facility_id int, facility string, flat double, flon double"))


@pytest.mark.parametrize("n", [1, 5, 100_000])
def test_nearest_equals_brute_force(spark, n):
    facilities = places(2, n, ((35.0, 36.0), (139.0, 140.0))) if n > 5 else places(3, n, ((-80, 80), (-180, 180)))
    df, fac = frames(spark, facilities)
    got = {r.listing_id: (r.facility_id, r.km) for r in nearest_facility(df, fac).collect()}
    assert len(got) == len(LISTINGS) + 2 and got[100] == (None, None) and got[101] == (None, None)
    for i, p in enumerate(LISTINGS):
        best = min((km(p, f), j) for j, f in enumerate(facilities))
        assert got[i][0] == best[1] and got[i][1] == pytest.approx(best[0], abs=1e-6)


def test_nearest_ties_and_no_facilities(spark):
    df, fac = frames(spark, [(35.2, 139.2)] * 3)
    assert {r.facility_id for r in nearest_facility(df, fac).collect()} == {0, None}
    assert {r.facility_id for r in nearest_facility(df, fac.where("false")).collect()} == {None}


@pytest.mark.parametrize("radius", [5.0, 60.0, EVERYWHERE_KM])
def test_within_radius_equals_brute_force(spark, radius):
    facilities = places(4, 200, ((35.0, 36.0), (139.0, 140.0))) + [(-89.9, -170.0), (0.0, 179.99)]
    df, fac = frames(spark, facilities)
    got = {(r.listing_id, r.facility_id) for r in facility_distances(df, fac, radius).collect()}
    want = set()
    for i, p in enumerate(LISTINGS):
        near = {(i, j) for j, f in enumerate(facilities) if km(p, f) <= radius}
        want |= near or {(i, None)}
    assert got == want | {(100, None), (101, None)}


def test_failed_geocode_keeps_the_row(spark):
    df = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "listing_id int, ku_name string")
    geo = spark.createDataFrame([("A", 1.0, 2.0)], "ku_name string, lat double, lon double")
    assert {(r.listing_id, r.lat) for r in geocode(df, geo).collect()} == {(1, 1.0), (2, None), (3, None)}
