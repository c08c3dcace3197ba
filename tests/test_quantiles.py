"""Exact quantiles against DuckDB's quantile_disc."""

import duckdb
import numpy as np
import pandas as pd

from rentlens.operators.quantiles import exact_quantiles

SHARES = [0.0, 0.05, 0.25, 0.5, 0.9, 0.95, 1.0]


def test_equals_quantile_disc_on_hot_groups_and_ties(spark):
    """A group of 400,000 different values, one that is mostly a single value, small ones and a null one."""
    sql = """SELECT CASE WHEN id < 400000 THEN 'hot' WHEN id < 600000 THEN 'same' WHEN id < 600100 THEN NULL ELSE 'g' || CAST(id % 50 AS STRING) END AS g,
             CASE WHEN id >= 400000 AND id < 600000 THEN IF(id % 10 = 0, CAST(id AS DOUBLE), 7.0D) WHEN id % 91 = 0 THEN NULL
             ELSE (id * 7919 % 1000003) / 7.0D - 50000 END AS v, id % 3 AS h FROM RANGE(0, 603000, 1, 12)"""
    df = spark.sql(sql)
    rows = df.toPandas()  # noqa: F841  (read by DuckDB)
    want = duckdb.sql(f"SELECT g, quantile_disc(v, {SHARES}) AS q FROM rows GROUP BY g").df()
    got = exact_quantiles(df, ["g"], "v", SHARES).toPandas()
    as_dict = lambda t: {("null" if pd.isna(r.g) else r.g): tuple(r.q) for r in t.itertuples()}
    assert as_dict(got) == as_dict(want) and len(got) == 53
    by_two = exact_quantiles(df, ["g", "h"], "v", [0.5])
    assert by_two.columns == ["g", "h", "q"] and by_two.count() == len(rows.dropna(subset=["v"]).groupby(["g", "h"], dropna=False))


def test_odd_values(spark):
    df = spark.createDataFrame([("a", None), ("b", float("nan")), ("b", 1.0), ("c", float("-inf"))], "g string, v double")
    got = {r["g"]: r["q"] for r in exact_quantiles(df, ["g"], "v", [0.5, 1.0]).collect()}
    assert set(got) == {"b", "c"} and got["b"][0] == 1.0 and np.isnan(got["b"][1]) and got["c"] == [float("-inf")] * 2
    assert exact_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
