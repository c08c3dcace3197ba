"""Session, scratch folder and the shared model cache."""

from pyspark.sql import functions as F

from rentlens.plans.common import fitted_once
from rentlens.session import build_session, remove_scratch, scratch_path


def test_build_session_leaves_the_master_alone(spark):
    before = (spark.sparkContext.master, spark.conf.get("spark.sql.shuffle.partitions"))
    again = build_session()
    assert (again.sparkContext.master, again.conf.get("spark.sql.shuffle.partitions")) == before


def test_scratch_is_removed(spark):
    path = scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    other = scratch_path(spark, "x")
    assert other != path
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert fs.exists(p)
    remove_scratch(spark)
    assert not fs.exists(p)


def test_changed_rows_are_fitted_anew(spark):
    calls = []
    df = spark.range(10)
    for data in (df, df, df.where("id < 9"), df.withColumn("id", F.col("id") + (F.col("id") == 3).cast("long"))):
        fitted_once("test", data, lambda: calls.append(1))
    assert len(calls) == 3
