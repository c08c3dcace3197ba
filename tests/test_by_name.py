"""CSV columns by name, foreign headers, and rejects that go somewhere, also after a failure between the two sinks."""

import os

import pandas as pd
import pytest
from pyspark.sql import types as T
from pyspark.sql.readwriter import DataFrameWriter

from rentlens.schema import KEYED_RAW_SCHEMA
from rentlens.session import scratch_path
from rentlens.sources.files import header_names, scan_csv, scan_csv_by_name
from rentlens.streaming import ingest

FILES = {
    "a.csv": "x,y,z\n1,a,\"two\nlines\"\n2,b,c\n",
    "b.csv": "y,x\nb2,3\n",
    "c [1]%20.csv": "﻿z,extra,x\r\nzz,\"e,1\",4\r\n",
    "d.csv": "x,x,\n5,6,7\n",
    "only-header.csv": "y,late\n",
    "empty.csv": "",
    "other.txt": "x\n9\n",
}
SCHEMA = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.StringType()), T.StructField("z", T.StringType())])


@pytest.fixture
def folder(spark):
    path = scratch_path(spark, "by-name")
    os.makedirs(path)
    for name, text in FILES.items():
        with open(f"{path}/{name}", "w", newline="", encoding="utf-8") as f:
            f.write(text)
    return path


def test_by_name_equals_pandas(spark, folder):
    names = [n for n, t in FILES.items() if n.endswith(".csv") and t]
    want = pd.concat([pd.read_csv(f"{folder}/{n}", dtype=str, encoding="utf-8-sig") for n in names])
    want["z"] = want["z"].str.replace("\r\n", "\n")
    got = scan_csv_by_name(spark, folder, SCHEMA, glob="*.csv", extras=True)
    assert set(got.columns) == set(want.columns) and got.columns[:3] == ["x", "y", "z"] and dict(got.dtypes)["x"] == "int"
    rows = lambda df: sorted(tuple("" if pd.isna(v) else str(v) for v in r) for r in df[sorted(want.columns)].itertuples(index=False))
    assert rows(got.select(*[got[f"`{c}`"].cast("string").alias(c) for c in got.columns]).toPandas()) == rows(want)
    assert scan_csv_by_name(spark, folder, SCHEMA, glob="*.csv").columns == ["x", "y", "z"]


def test_header_names():
    assert header_names('a,"b,c",a,A,,') == ["a", "b,c", "a.1", "A.2", "Unnamed: 4", "Unnamed: 5"]
    assert header_names("﻿a\r") == ["a"]


def test_by_name_without_files_and_with_bad_rows(spark, folder):
    assert scan_csv_by_name(spark, folder, SCHEMA, glob="*.none").count() == 0
    with open(f"{folder}/bad.csv", "w") as f:
        f.write("x,y,z\nno number,b,c\n1\n2,b,c\n")
    got = {(r.x, r.y, r.bad) for r in scan_csv_by_name(spark, folder, SCHEMA, glob="bad.csv", bad_rows="bad").collect()}
    assert got == {(None, "b", "no number,b,c"), (1, None, "1"), (2, "b", None)}


def test_positional_scans_refuse_a_foreign_header(spark, folder):
    assert scan_csv(spark, folder, SCHEMA, glob="a.csv").count() == 2
    with pytest.raises(Exception, match="(?i)header|FAILED_READ_FILE"):
        scan_csv(spark, folder, SCHEMA, glob="b.csv").collect()
    landing, out, ck = (scratch_path(spark, n) for n in ("foreign", "foreign-out", "foreign-ck"))
    os.makedirs(landing)
    names = [f.name for f in KEYED_RAW_SCHEMA]
    with open(f"{landing}/x.csv", "w") as f:
        f.write(",".join(reversed(names)) + "\n" + ",".join("1" for _ in names) + "\n")
    with pytest.raises(Exception, match="(?i)header|FAILED_READ_FILE"):
        ingest.ingest_listings(spark, landing, out, ck)


def test_good_and_rejected_rows_are_the_input_also_after_a_failure_in_a_batch(spark, monkeypatch):
    landing, good, rejects, ck = (scratch_path(spark, n) for n in ("in", "good", "rejects", "ck"))
    os.makedirs(landing)

    def land(name, rows, header="listing_id,sqr_m,rent_price"):
        with open(f"{landing}/{name}", "w") as f:
            f.write("\n".join([header, *rows]) + "\n")

    def run():
        ingest.ingest_with_rejects(spark, landing, good, rejects, ck, max_files_per_trigger=1)

    land("1.csv", ["1,20m2,8万円", "2,?m2,8万円", "x,20m2,8万円", "3", "4,20m2,dear", "5,,8万円"])
    land("2.csv", ["8万円,6,30m2"], "rent_price,listing_id,sqr_m")
    run()
    land("3.csv", ["7,20m2,9万円", "8,20m2,?"])
    calls = []
    parquet = DataFrameWriter.parquet

    def failing(self, path, *args, **kw):
        if "/rejects-" in path:
            calls.append(path)
            raise OSError("lost")
        return parquet(self, path, *args, **kw)

    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.parquet", failing)
    with pytest.raises(Exception, match="lost"):
        run()
    assert calls
    monkeypatch.undo()
    run()
    run()  # nothing new
    fine = sorted((r.listing_id, r.sqr_m, r.rent_price) for r in spark.read.parquet(good).collect())
    assert fine == [(1, 20.0, 8.0), (6, 30.0, 8.0), (7, 20.0, 9.0)]
    bad = sorted(((r.listing_id, ",".join(r.reasons)) for r in spark.read.parquet(rejects).collect()), key=str)
    assert bad == sorted([(2, "sqr_m"), (None, "listing_id"), (3, "malformed row,sqr_m"), (4, "rent_price"), (5, "sqr_m"), (8, "rent_price")], key=str)
    assert all(r.record for r in spark.read.parquet(rejects).collect())
