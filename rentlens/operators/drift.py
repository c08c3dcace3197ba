"""Drift and performance per time chunk.

Chunks are calendar days.  Everything is one partial-aggregated group-by on
the chunk (map-side combine), so a hot day costs a few counters per task.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentlens.operators.evaluate import fit_linear
from rentlens.operators.models import fit_gbt
from rentlens.operators.quantiles import exact_quantiles


#: Bins of values that are no measurement in [0, ∞): null or NaN, and negative.
MISSING, NEGATIVE = -2, -1


def value_bin(value: Column, width: float, n_bins: int) -> Column:
    """Bins 0..n_bins: [k·width, (k+1)·width), the last one open-ended; own bins for missing and negative values."""
    return (F.when(value.isNull() | F.isnan(value), F.lit(MISSING)).when(value < 0, F.lit(NEGATIVE))
             .otherwise(F.least(F.floor(value / F.lit(width)), F.lit(n_bins))).cast("int"))


def _plogp_half(p: Column, m: Column) -> Column:
    return F.when(p > 0, F.lit(0.5) * p * F.log2(p / m)).otherwise(F.lit(0.0))


def js_distance_daily(df: DataFrame, ts: str, value: str, reference_end: str, width: float = 10.0,
                      n_bins: int = 10, alert_above: float = 0.1) -> DataFrame:
    """Jensen–Shannon distance (base 2, in [0, 1]) of each day's binned
    ``value`` distribution against the reference period (days before
    ``reference_end``); only analysis days are reported.

    The input is scanned once: days are counted, and the reference is the sum of
    its days (a window over the day rows, a handful per month).  Missing and
    negative values count, in bins of their own.  Without a reference the
    distance is null.
    """
    b = value_bin(F.col(value).cast("double"), width, n_bins)
    kinds = [MISSING, NEGATIVE, *range(n_bins + 1)]
    days = df.groupBy(F.to_date(F.col(ts)).alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(b == k).alias(f"b{i}") for i, k in enumerate(kinds)])
    end, all_days = F.lit(reference_end).cast("date"), Window.partitionBy(F.lit(0))
    before = F.col("chunk") < end
    total = lambda c: F.sum(F.when(before, F.col(c)).otherwise(F.lit(0))).over(all_days)
    days = days.withColumn("rn", total("n")).withColumns({f"r{i}": total(f"b{i}") for i in range(len(kinds))}).where(F.col("chunk") >= end)
    js = F.lit(0.0)
    for i in range(len(kinds)):
        p, q = F.col(f"b{i}") / F.col("n"), F.try_divide(F.col(f"r{i}"), F.col("rn"))
        js = js + _plogp_half(p, (p + q) / 2) + _plogp_half(q, (p + q) / 2)
    js = F.when(F.col("rn") > 0, F.sqrt(F.greatest(js, F.lit(0.0))))
    return days.select(F.col("chunk").cast("string").alias("chunk"), "n", js.alias("js_distance")) \
               .withColumn("alert", F.col("js_distance") > F.lit(alert_above))


def reference_edges(df: DataFrame, ts: str, value: str, reference_end: str, n_bins: int = 10) -> list[float]:
    """Edges between ``n_bins`` bins that hold equally many reference values: their exact quantiles, repeats left out."""
    before = F.to_date(F.col(ts)) < F.lit(reference_end).cast("date")
    v = F.col(value).cast("double")
    known = df.where(before & ~F.isnan(v)).select(F.lit(0).alias("all"), v.alias("value"))
    found = exact_quantiles(known, ["all"], "value", [k / n_bins for k in range(1, n_bins)]).first()
    return sorted(set(found["q"])) if found else []


def edge_bin(value: Column, edges: list[float]) -> Column:
    """Bin k is [edge k-1, edge k), the outer ones open; missing values have a bin of their own."""
    out = F.when(value.isNull() | F.isnan(value), F.lit(MISSING))
    for k, e in enumerate(edges):
        out = out.when(value < F.lit(e), F.lit(k))
    return out.otherwise(F.lit(len(edges)))


def js_drift_calibrated(df: DataFrame, ts: str, value: str, reference_end: str, n_bins: int = 10, deviations: float = 3.0,
                        edges: list[float] | None = None, alert_above: float | None = None) -> DataFrame:
    """R5 with bins and alert limit learned from the reference period (days before ``reference_end``).

    Bins hold equally many reference values (``reference_edges``).  Each reference day is measured against the
    other reference days, each later day against all of them; ``alert_limit`` is the reference days' mean distance plus
    ``deviations`` standard deviations, 1 at most.  ``edges`` and ``alert_above`` fix bins and limit instead.
    Only later days are reported.  Without a reference the distance, and with fewer than two reference days the
    limit and the alert, are null.
    """
    edges = reference_edges(df, ts, value, reference_end, n_bins) if edges is None else edges
    b = edge_bin(F.col(value).cast("double"), edges)
    kinds = [MISSING, *range(len(edges) + 1)]
    days = df.where(F.col(ts).isNotNull()).groupBy(F.to_date(F.col(ts)).alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(b == k).alias(f"b{i}") for i, k in enumerate(kinds)])
    # a row a day: the reference is the sum of its days, less the day itself where that is one of them
    before, all_days = F.col("chunk") < F.lit(reference_end).cast("date"), Window.partitionBy(F.lit(0))
    own = lambda c: F.when(before, F.col(c)).otherwise(F.lit(0))
    days = days.withColumns({f"r{c}": F.sum(own(c)).over(all_days) - own(c) for c in ["n", *[f"b{i}" for i in range(len(kinds))]]})
    js = F.lit(0.0)
    for i in range(len(kinds)):
        p, q = F.col(f"b{i}") / F.col("n"), F.try_divide(F.col(f"rb{i}"), F.col("rn"))
        js = js + _plogp_half(p, (p + q) / 2) + _plogp_half(q, (p + q) / 2)
    days = days.withColumn("js_distance", F.when(F.col("rn") > 0, F.sqrt(F.greatest(js, F.lit(0.0)))))
    if alert_above is None:
        known = F.when(before, F.col("js_distance"))
        limit = F.avg(known).over(all_days) + F.lit(deviations) * F.stddev_samp(known).over(all_days)
        limit = F.when(limit.isNotNull(), F.least(limit, F.lit(1.0)))
    else:
        limit = F.lit(alert_above)
    return (days.withColumn("alert_limit", limit).where(~before)
                .select(F.col("chunk").cast("string").alias("chunk"), "n", "js_distance", "alert_limit")
                .withColumn("alert", F.col("js_distance") > F.col("alert_limit")))


def distribution_daily(df: DataFrame, ts: str, value: str, accuracy: int | None = None) -> DataFrame:
    """Per-day count, mean, standard deviation and quantiles of ``value``.

    The quantiles are exact.  With ``accuracy`` they are a sketch, which saves two exchanges: exact up to
    that many rows a day; beyond, a rank may be off by n / accuracy.
    """
    qs = [0.05, 0.25, 0.5, 0.75, 0.95]
    dated = df.withColumn("chunk", F.to_date(F.col(ts)))
    stats = [F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")]
    if accuracy:
        days = dated.groupBy("chunk").agg(*stats, F.percentile_approx(F.col(value), qs, accuracy).alias("q"))
    else:
        q = exact_quantiles(dated, ["chunk"], value, qs).withColumnRenamed("chunk", "q_chunk")
        days = dated.groupBy("chunk").agg(*stats).join(q, F.col("chunk").eqNullSafe(F.col("q_chunk")), "left")
    return days.select(F.col("chunk").cast("string").alias("chunk"), "n", "mean", "std",
                       *[F.col("q")[i].alias(f"p{int(x * 100):02d}") for i, x in enumerate(qs)])


def realised_mae_daily(df: DataFrame, ts: str, label: str, pred: str) -> DataFrame:
    """MAE of ``pred`` per day."""
    return (df.groupBy(F.to_date(F.col(ts)).alias("chunk"))
              .agg(F.count(F.col(label) - F.col(pred)).alias("n"), F.avg(F.abs(F.col(label) - F.col(pred))).alias("mae"))
              .select(F.col("chunk").cast("string").alias("chunk"), "n", "mae"))


def out_of_fold(df: DataFrame, y: str, xs: list[str], key: str, folds: int = 5, out: str = "predicted") -> DataFrame:
    """``out``: for each row the prediction of the linear model fitted on the rows of the other folds.

    Folds follow from the hash of ``key``, so equal keys share one.  One aggregate a fold; the predictions are expressions.
    """
    fold = F.pmod(F.xxhash64(key), F.lit(folds))
    predicted = F.lit(None).cast("double")
    for k in range(folds):
        predicted = F.when(fold == k, fit_linear(df.where(fold != k), y, xs).predict()).otherwise(predicted)
    return df.withColumn(out, predicted)


def fit_loss_estimator(reference: DataFrame, features: list[str], label: str, pred: str,
                       **gbt) -> PipelineModel:
    """Learn |label − pred| from the features and the prediction on reference rows.

    ``pred`` should come from a model that has not seen the row (``out_of_fold``): errors of rows that were fitted are too small.
    """
    train = reference.withColumn("abs_error", F.abs(F.col(label) - F.col(pred)))
    params = {"maxIter": 20, "maxDepth": 4, "maxBins": 64, "minInstancesPerNode": 20, **gbt}
    return fit_gbt(train, [*features, pred], "abs_error", **params)


def sampling_error(reference: DataFrame, label: str, pred: str) -> float:
    """Standard deviation of |label − pred| over the reference rows; of a mean over n rows it is this by the root of n."""
    return float(reference.agg(F.stddev_samp(F.abs(F.col(label) - F.col(pred)))).first()[0] or 0.0)


def estimated_mae_daily(analysis: DataFrame, estimator: PipelineModel, ts: str, label: str,
                        pred: str, deviation: float | None = None, width: float = 3.0) -> DataFrame:
    """Estimated MAE per day (no labels used) next to the realised MAE.

    With the ``deviation`` of one error, ``lower`` and ``upper`` are ``width`` standard errors of the day's mean away.
    """
    scored = estimator.transform(analysis)
    estimate = F.avg(F.greatest(F.col("prediction"), F.lit(0.0)))
    days = (scored.groupBy(F.to_date(F.col(ts)).alias("chunk"))
                  .agg(F.count(F.lit(1)).alias("n"), estimate.alias("estimated_mae"),
                       F.avg(F.abs(F.col(label) - F.col(pred))).alias("realised_mae"))
                  .select(F.col("chunk").cast("string").alias("chunk"), "n", "estimated_mae", "realised_mae"))
    if deviation is None:
        return days
    half = F.lit(width * deviation) / F.sqrt("n")
    return days.withColumns({"lower": F.greatest(F.col("estimated_mae") - half, F.lit(0.0)), "upper": F.col("estimated_mae") + half})
