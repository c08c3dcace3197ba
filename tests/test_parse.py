"""Parsers against the format table of FIXTURES.md §1 (invented values)."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rentlens.functions import parse as P


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [("25.51m2", 25.51), ("38m2", 38.0), (None, None)])
def test_area(spark, text, expected):
    assert one(spark, P.parse_area, text) == expected


@pytest.mark.parametrize("text,expected", [("10.2万円", 10.2), ("12万円", 12.0), ("-", 0.0), (None, 0.0),
                                           ("9000円", 9000.0), ("6.75万円", 6.75)])
def test_money(spark, text, expected):
    assert one(spark, P.parse_money, text) == expected


@pytest.mark.parametrize("text,expected", [("10.2万円", 102000.0), ("9万円", 90000.0), ("6.75万円", 67500.0),
                                           ("9000円", 9000.0), ("-", 0.0)])
def test_money_to_yen(spark, text, expected):
    assert one(spark, P.parse_money_to_yen, text) == expected


@pytest.mark.parametrize("text,expected", [("新築", 0), ("築7年", 7), ("-", 0), ("築35年", 35)])
def test_age(spark, text, expected):
    assert one(spark, P.parse_building_age, text) == expected


@pytest.mark.parametrize("text,expected", [("3階建\n", 3), ("\n13階建\n", 13), ("\n地下1地上13階建\n", 13),
                                           ("0階建\n", 0), ("階建\n", 0), (None, 0)])
def test_storeys(spark, text, expected):
    assert one(spark, P.parse_storeys, text) == expected


@pytest.mark.parametrize("text,walk,name", [("東京メトロ東西線/木場駅 歩6分", 6, "東京メトロ東西線/木場駅 "),
                                            ("-", 0, "0"), ("nan", 0, "0"), (None, 0, "0")])
def test_station(spark, text, walk, name):
    assert one(spark, P.parse_station_walk, text) == walk
    assert one(spark, P.parse_station_text, text) == name


def test_station_line_split(spark):
    df = spark.createDataFrame([("東京メトロ東西線/木場駅 歩6分",)], "v string")
    line, station = P.split_line_station(F.col("v"))
    r = df.select(P.parse_station_name(F.col("v")).alias("n"), line.alias("l"), station.alias("s")).first()
    assert (r["n"], r["l"], r["s"]) == ("東京メトロ東西線/木場", "東京メトロ東西線", "木場")


@pytest.mark.parametrize("text,expected", [("東京都江東区木場６", "江東"), ("大阪府大阪市北区", None), (None, None)])
def test_ward(spark, text, expected):
    assert one(spark, P.parse_ward, text) == expected


def test_slice(spark):
    assert one(spark, lambda c: P.text_slice_from(c, 5), "築10年 3階建") == "3階建"
    # a fixed-width slice eats a digit when the age text is shorter (defect D8)
    assert one(spark, lambda c: P.text_slice_from(c, 5), "築10年10階建") == "0階建"
    assert one(spark, lambda c: P.text_slice_from(c, 5), "abc") == ""


# Inputs that abort the original scripts: 'fail' raises, 'permissive' gives null.
BAD = [(P.parse_building_age, "築99年以上"), (P.parse_building_age, "平屋"), (P.parse_money, "1,000円"),
       (P.parse_station_walk, "バス10分"), (P.parse_storeys, "３階建")]


@pytest.mark.parametrize("fn,text", BAD)
def test_bad_values_fail(spark, fn, text):
    with pytest.raises(PySparkException):
        one(spark, lambda c: fn(c, "fail"), text)


@pytest.mark.parametrize("fn,text", BAD)
def test_bad_values_permissive(spark, fn, text):
    assert one(spark, lambda c: fn(c, "permissive"), text) is None


def test_regex_metacharacters_are_literal(spark):
    # '.' and '+' in listing text must not act as patterns
    assert one(spark, P.parse_money, "1.5万円") == 1.5
    assert one(spark, P.strip_newlines, "a.+\nb") == "a.+b"
