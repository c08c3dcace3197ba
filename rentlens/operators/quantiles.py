"""Exact quantiles of groups of any size, without a sketch and without a group in one task.

Equal values of a group become one row with their count.  Those rows are dealt to ranges of
(group, value), which split a large group over many tasks, and are written with the number of their
range.  The counts per group and range say in which range each quantile lies; only those ranges are
read again, and a running count within the range finds the value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentlens.session import scratch_path


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], out: str = "q") -> DataFrame:
    """``by`` columns and ``out``: per group the smallest value that at least each share of the values does not exceed.

    Null values do not count, NaN is the largest value, and a group without a value has no row.  Null
    is a group of its own.  A share of 0 is the minimum.
    """
    spark = df.sparkSession
    counted = (df.where(F.col(value).isNotNull()).groupBy(F.struct(*by).alias("key"), F.col(value).alias("value"))
               .agg(F.count("*").alias("n")))
    path = scratch_path(spark, "quantile-ranges")
    counted.repartitionByRange("key", "value").withColumn("part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    # a row per group and range
    before = Window.partitionBy("key").orderBy("part")
    parts = ranged.groupBy("key", "part").agg(F.sum("n").alias("n")).select(
        "key", "part", F.sum("n").over(before).alias("upto"), (F.sum("n").over(before) - F.col("n")).alias("below"),
        F.sum("n").over(Window.partitionBy("key")).alias("total"))
    total = F.col("total")
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.greatest(F.lit(1), total - F.floor(total - F.lit(float(s)) * total)).alias("rank"))
                      for i, s in enumerate(shares)])
    wanted = (parts.withColumn("ranks", F.filter(ranks, lambda r: (r["rank"] > F.col("below")) & (r["rank"] <= F.col("upto"))))
              .where("size(ranks) > 0").select("key", "part", "below", "ranks"))
    within = Window.partitionBy("key", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    found = (ranged.join(wanted, ["key", "part"]).withColumn("upto", F.col("below") + F.sum("n").over(within))
             .select("key", "value", F.explode(F.filter("ranks", lambda r: (r["rank"] <= F.col("upto")) & (r["rank"] > F.col("upto") - F.col("n")))).alias("r")))
    return (found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("r.i", "value"))).alias("all"))
            .select(*[F.col("key")[c].alias(c) for c in by], F.col("all")["value"].alias(out)))
