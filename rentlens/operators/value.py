"""Goal-derived operators: value for money by ward (G1) and bargains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentlens.operators.evaluate import fit_linear, with_residual
from rentlens.operators.quantiles import exact_quantiles


def ward_value_summary(clean: DataFrame, accuracy: int | None = None) -> DataFrame:
    """G1: listings, average rent and rent per m² by ward and layout.

    Every aggregate is partial (map-side combine) so a hot ward costs one
    small buffer per task.  The median is exact; with ``accuracy`` it is a bounded sketch.
    """
    keys = ["ku_name", "apartment_type"]
    rows = clean.withColumn("per_sqm", F.col("rent_price") * F.lit(10000.0) / F.col("sqr_m"))
    stats = [F.count(F.lit(1)).alias("listings"), F.round(F.avg("rent_price"), 8).alias("avg_rent"),
             F.round(F.avg("sqr_m"), 8).alias("avg_sqr_m"), F.round(F.avg("per_sqm"), 2).alias("avg_yen_per_sqm")]
    if accuracy:
        return rows.groupBy(*keys).agg(*stats, F.round(F.percentile_approx("per_sqm", 0.5, accuracy), 2).alias("median_yen_per_sqm"))
    q = exact_quantiles(rows, keys, "per_sqm", [0.5]).toDF(*[f"q_{c}" for c in keys], "q")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"q_{c}"))
    return rows.groupBy(*keys).agg(*stats).join(q, same, "left").select(
        *keys, "listings", "avg_rent", "avg_sqr_m", "avg_yen_per_sqm", F.round(F.col("q")[0], 2).alias("median_yen_per_sqm"))


def bargain_topk(clean: DataFrame, k: int = 3) -> DataFrame:
    """Per ward, the k listings whose rent lies furthest below the fitted line.

    The line is rent ~ area over all listings with a rent; ranking excludes
    listings without a ward or a rent.  ``row_number() <= k`` lets Spark insert a partial
    per-group limit before the shuffle, so a hot ward ships at most k rows
    per task.
    """
    scored = with_residual(clean, fit_linear(clean, "rent_price", ["sqr_m"]))
    w = Window.partitionBy("ku_name").orderBy(F.col("residual").asc(), F.col("listing_id").asc())
    return (scored.where(F.col("ku_name").isNotNull() & F.col("residual").isNotNull())
                  .withColumn("bargain_rank", F.row_number().over(w))
                  .where(F.col("bargain_rank") <= k)
                  .select("ku_name", "bargain_rank", "listing_id", "rent_price", "sqr_m",
                          F.round("predicted", 4).alias("predicted_rent"),
                          F.round("residual", 4).alias("residual")))
