"""F1 with sparse rows: equal to the dense columns, and a million levels."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rentlens.operators.features import category_levels, level_dictionary, one_hot_columns, one_hot_sparse, slot_vectors


def test_equal_to_dense_columns(spark):
    rows = [(1, "b", "x"), (2, "a", None), (3, None, None), (4, "b", "y"), (4, "b", "y"), (5, "", "é")]
    df = spark.createDataFrame(rows, "id int, p string, q string").withColumn("slots", F.lit("clash"))
    levels = {r.slot: f"{r['column']}_{r.level}" for r in level_dictionary(df, ["p", "q"]).collect()}
    assert [levels[i] for i in range(len(levels))] == [f"{c}_{v}" for c, vs in category_levels(df, ["p", "q"]).items() for v in vs]
    dense = one_hot_columns(df, ["p", "q"], keep=["id"])
    vectors = slot_vectors(one_hot_sparse(df, ["p", "q"], keep=["id"])).select("id", vector_to_array("features").alias("f"))
    assert sorted((r.id, [int(x) for x in r.f]) for r in vectors.collect()) == sorted((r[0], list(r[1:])) for r in dense.collect())
    none = one_hot_sparse(df.where("id = 3"), ["p", "q"], keep=["id"]).collect()
    assert [(r.id, r.slots, r.width) for r in none] == [(3, [], 0)]
    assert one_hot_sparse(df.where("false"), ["p"], keep=["id"]).count() == 0


def test_levels_of_another_table(spark):
    known = spark.createDataFrame([("a",), ("c",)], "p string")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, p string")
    got = one_hot_sparse(df, ["p"], levels=level_dictionary(known, ["p"])).collect()
    assert sorted((r.id, r.slots, r.width) for r in got) == [(1, [0], 2), (2, [], 2), (3, [1], 2)]


def test_a_million_levels_and_a_hot_one(spark):
    df = spark.range(0, 1_500_000, 1, 16).selectExpr("id", "IF(id % 3 = 0, 'hot', lpad(cast(id as string), 8, '0')) AS p")
    got = one_hot_sparse(df, ["p"])
    want = 1_000_001  # ids that 3 does not divide, in order, then the hot level
    row = got.agg(F.max("width").alias("w"), F.count("*").alias("n"), F.max(F.size("slots")).alias("s")).first()
    assert (row.w, row.n, row.s) == (want, 1_500_000, 1)
    bad = got.withColumn("slot", F.col("slots")[0]).where(F.col("slot") != F.when(F.col("id") % 3 == 0, want - 1).otherwise(F.expr("id - floor(id / 3) - 1")))
    assert bad.count() == 0
