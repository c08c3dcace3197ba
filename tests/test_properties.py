"""Property tests for the text parsers: generated listing text → expected value.

Each hypothesis example is a batch of values checked in one Spark job.
"""

from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rentlens.functions import parse as P

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))

money = st.decimals(min_value=Decimal("0"), max_value=Decimal("999.99"), places=2)
small = st.integers(min_value=0, max_value=300)
names = st.text(alphabet=st.characters(whitelist_categories=("Lu", "Ll", "Lo", "Nd"),
                                       blacklist_characters="区東京都"), min_size=1, max_size=8)


def run(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["r"] for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


@SETTINGS
@given(st.lists(money, min_size=1, max_size=40))
def test_money_round_trip(spark, values):
    texts = [f"{v.normalize():f}万円" for v in values]
    assert run(spark, P.parse_money, texts) == [float(v) for v in values]
    assert run(spark, P.parse_money_to_yen, texts) == [float(round(v * 10000)) for v in values]


@SETTINGS
@given(st.lists(st.tuples(small, small, st.booleans()), min_size=1, max_size=40))
def test_storeys(spark, rows):
    texts = [f"\n地下{a}地上{b}階建\n" if under else f"{b}階建\n" for a, b, under in rows]
    assert run(spark, P.parse_storeys, texts) == [b for _, b, _ in rows]


@SETTINGS
@given(st.lists(st.tuples(names, small), min_size=1, max_size=40))
def test_station(spark, rows):
    texts = [f"{line}線/{name}駅 歩{m}分" for name, m in rows for line in ["第1"]]
    assert run(spark, P.parse_station_walk, texts) == [m for _, m in rows]
    assert run(spark, P.parse_station_text, texts) == [f"第1線/{n}駅 " for n, _ in rows]


@SETTINGS
@given(st.lists(st.tuples(names, names), min_size=1, max_size=40))
def test_ward(spark, rows):
    texts = [f"東京都{w}区{rest}" for w, rest in rows] + [f"大阪府{w}区" for w, _ in rows]
    assert run(spark, P.parse_ward, texts) == [w for w, _ in rows] + [None] * len(rows)


@SETTINGS
@given(st.lists(st.one_of(st.just("新築"), st.just("-"), small.map(lambda n: f"築{n}年")), min_size=1, max_size=40))
def test_age(spark, texts):
    expected = [0 if t in ("新築", "-") else int(t[1:-1]) for t in texts]
    assert run(spark, P.parse_building_age, texts) == expected
