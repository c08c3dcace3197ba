"""F4 as an expression, against the formula transformer."""

from pyspark.ml.feature import RFormula
from pyspark.ml.functions import vector_to_array

from rentlens.operators.features import formula_design_matrix

ROWS = [(1, 1.5, 2, "b", "x"), (2, 2.5, 3, "a", "z"), (3, None, 4, "c", "x"), (4, 4.0, None, "c", "x"), (5, 1.0, 5, None, "y"),
        (6, 2.0, 6, "ａ", "y"), (7, 0.0, 0, "0", "x"), (7, 0.0, 0, "0", "x")]


def transformed(df, formula):
    rf = RFormula(formula=formula, featuresCol="features", labelCol="label", stringIndexerOrderType="alphabetDesc")
    clean = df.dropna(subset=["y", "n", "p", "q"])
    return rf.fit(clean).transform(clean).select("id", "label", vector_to_array("features").alias("features"))


def test_equals_the_transformer(spark):
    df = spark.createDataFrame(ROWS, "id int, y double, n int, p string, q string")
    for formula in ("y ~ n + p + q", "y~p+n+q", "n ~ q + y + p"):
        got, want = formula_design_matrix(df, formula, keep=["id"]), transformed(df, formula)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), formula
    assert formula_design_matrix(df.where("false"), "y ~ n + p", keep=["id"]).count() == 0


def test_an_empty_level_is_a_level(spark):
    """The transformer refuses it."""
    df = spark.createDataFrame([(1, 1.0, ""), (2, 2.0, "b"), (3, 3.0, "a")], "id int, y double, p string")
    got = {r.id: r.features for r in formula_design_matrix(df, "y ~ p", keep=["id"]).collect()}
    assert got == {1: [0.0, 0.0], 2: [1.0, 0.0], 3: [0.0, 1.0]}
