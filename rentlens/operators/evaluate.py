"""Linear fits from moments, residuals, metrics and residual diagnostics.

A fit is one global aggregate (means and covariances), computed with partial
aggregation on every partition; only those few numbers reach the driver, which
solves for the coefficients, and they go back into the plan as literals.  Rows
with a null target or feature take no part in a fit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions.stats import chi2_upper, f_upper, t_quantile, t_two_sided


@dataclass
class LinearFit:
    """Ordinary least squares of ``y`` on ``xs`` with an intercept."""

    y: str
    xs: list[str]
    n: int
    coef: np.ndarray  # of xs
    intercept: float
    rss: float
    tss: float
    inverse: np.ndarray  # of the centred cross products of xs
    means: np.ndarray

    def predict(self) -> Column:
        """The prediction as a column (null where a feature is null)."""
        out = F.lit(self.intercept)
        for x, b in zip(self.xs, self.coef.tolist()):
            out = out + F.lit(b) * F.col(x)
        return out

    @property
    def df_resid(self) -> int:
        return self.n - len(self.xs) - 1

    def std_errors(self) -> np.ndarray:
        """Of the coefficients, then of the intercept."""
        s2 = self.rss / self.df_resid
        return np.sqrt(s2 * np.append(np.diag(self.inverse), 1 / self.n + self.means @ self.inverse @ self.means))

    def summary(self, level: float = 0.95) -> tuple[list[tuple], dict[str, float]]:
        """Per term (name, coef, std_err, t, p, lower, upper), and the figures of the whole fit."""
        half = t_quantile(0.5 + level / 2, self.df_resid)
        terms = []
        for name, b, se in zip([*self.xs, "intercept"], [*self.coef.tolist(), self.intercept], self.std_errors().tolist()):
            t = b / se
            terms.append((name, b, se, t, t_two_sided(t, self.df_resid), b - half * se, b + half * se))
        p = len(self.xs)
        r2 = 1 - self.rss / self.tss
        f = (self.tss - self.rss) / p / (self.rss / self.df_resid)
        loglik = -self.n / 2 * (math.log(2 * math.pi * self.rss / self.n) + 1)
        return terms, {"n": self.n, "r2": r2, "adj_r2": 1 - (1 - r2) * (self.n - 1) / self.df_resid, "f_value": f,
                       "f_p_value": f_upper(f, p, self.df_resid), "log_likelihood": loglik,
                       "aic": 2 * (p + 1) - 2 * loglik, "bic": (p + 1) * math.log(self.n) - 2 * loglik}


def fit_linear(df: DataFrame, y: str, xs: list[str], given: dict[str, Column] | None = None) -> LinearFit:
    """Least squares from one aggregate: n, means and covariances of all pairs.

    ``given`` names computed regressors (e.g. indicators), which need not be columns of ``df``.
    """
    given = given or {}
    cols = [(given.get(c, F.col(c))).cast("double").alias(f"c{i}") for i, c in enumerate([y, *xs])]
    k = len(cols)
    rows = df.select(*cols).dropna()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(k)],
                   *[F.covar_pop(f"c{i}", f"c{j}").alias(f"s{i}_{j}") for i, j in pairs]).first()
    n = int(row["n"])
    if n < k + 1:
        raise ValueError(f"cannot fit {y} on {xs}: {n} complete rows")
    s = np.zeros((k, k))
    for i, j in pairs:
        s[i, j] = s[j, i] = row[f"s{i}_{j}"]
    means = np.array([row[f"m{i}"] for i in range(k)])
    # scaled to correlations before solving, so that units do not matter
    sd = np.sqrt(np.diag(s)[1:])
    if (sd == 0).any():
        raise ValueError(f"cannot fit {y}: no variation in {[x for x, d in zip(xs, sd) if d == 0]}")
    scaled = np.linalg.inv(s[1:, 1:] / np.outer(sd, sd))
    inverse = scaled / np.outer(sd, sd)
    coef = inverse @ s[1:, 0]
    rss = float(n * (s[0, 0] - coef @ s[1:, 0]))
    return LinearFit(y, list(xs), n, coef, float(means[0] - coef @ means[1:]), rss, float(n * s[0, 0]), inverse / n, means[1:])


def simple_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    """One-row fit of y ~ x: slope, intercept, R², n (nulls skipped pairwise)."""
    return df.agg(F.regr_slope(y, x).alias("slope"),
                  F.regr_intercept(y, x).alias("intercept"),
                  F.regr_r2(y, x).alias("r2"),
                  F.regr_count(y, x).alias("n"))


def with_residual(df: DataFrame, fit: LinearFit, pred: str = "predicted", resid: str = "residual") -> DataFrame:
    """Add prediction and residual (actual − predicted)."""
    p = fit.predict()
    return df.withColumn(pred, p).withColumn(resid, F.col(fit.y) - p)


def regression_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """M6: n, MSE, RMSE, MAE, R² in one aggregate pass; rows without label or prediction do not count."""
    err = F.col(label) - F.col(pred)
    stats = df.agg(F.count(err).alias("n"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
                   F.var_pop(F.when(err.isNotNull(), F.col(label))).alias("var_y"))
    return stats.select("n", "mse", F.sqrt("mse").alias("rmse"), "mae",
                        (F.lit(1.0) - F.col("mse") / F.col("var_y")).alias("r2"))


def promotion_gate(metrics: DataFrame, threshold: float) -> DataFrame:
    """M7: the metrics row with the gate threshold and a pass flag (MSE < threshold)."""
    return metrics.withColumn("threshold", F.lit(float(threshold))) \
                  .withColumn("passed", F.col("mse") < F.lit(float(threshold)))


def residual_histogram(df: DataFrame, resid: str = "residual", width: float = 0.25) -> DataFrame:
    """R2: counts per residual bin [k·width, (k+1)·width)."""
    k = F.floor(F.col(resid) / F.lit(width)).cast("long")
    return (df.groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
              .select("bin", (F.col("bin") * F.lit(width)).alias("lower"),
                      ((F.col("bin") + 1) * F.lit(width)).alias("upper"), "n"))


def residual_density(df: DataFrame, resid: str = "residual", grid_points: int = 25, bins_per_bandwidth: int = 4) -> DataFrame:
    """Gaussian kernel density of residuals on a grid from three bandwidths below the least to three above the largest.

    The bandwidth is sd · n^(-1/5).  Residuals are first counted in bins of a
    fixed fraction of the bandwidth (partial aggregation), so the kernel sum costs
    bins × grid rather than rows × grid, and the bins shrink as the bandwidth does.
    Each bin row expands over the grid with a generated array; no join.
    """
    r = F.col(resid)
    st = df.agg(F.count(r).alias("n"), F.stddev_samp(r).alias("sd"), F.min(r).alias("lo"), F.max(r).alias("hi")).first()
    n, sd = int(st["n"]), float(st["sd"] or 0.0)
    if n < 2 or sd == 0.0:
        raise ValueError("a density needs at least two different residuals")
    h = sd * n ** (-0.2)
    width, start, step = h / bins_per_bandwidth, st["lo"] - 3 * h, (st["hi"] - st["lo"] + 6 * h) / (grid_points - 1)
    centre = (F.floor(r / F.lit(width)) + F.lit(0.5)) * F.lit(width)
    bins = df.where(r.isNotNull()).groupBy(centre.alias("c")).agg(F.count(F.lit(1)).alias("m"))
    g = F.lit(start) + F.col("i") * F.lit(step)
    z = (g - F.col("c")) / F.lit(h)
    kern = F.col("m") * F.exp(F.lit(-0.5) * z * z) / F.lit(n * h * math.sqrt(2 * math.pi))
    return (bins.select("c", "m", F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))).alias("i"))
                .groupBy("i").agg(F.sum(kern).alias("density")).select("i", g.alias("x"), "density"))


def breusch_pagan(df: DataFrame, fit: LinearFit) -> dict[str, float]:
    """Squared residuals regressed on the design of ``fit``: LM = n · R² and F, with their p-values."""
    e = F.col(fit.y) - fit.predict()
    aux = fit_linear(df.withColumn("_e2", e * e), "_e2", fit.xs)
    r2, p = 1 - aux.rss / aux.tss, len(fit.xs)
    lm, f = aux.n * r2, r2 / p / ((1 - r2) / aux.df_resid)
    return {"n": aux.n, "r2_aux": r2, "lm": lm, "lm_p_value": chi2_upper(lm, p), "f_value": f, "f_p_value": f_upper(f, p, aux.df_resid)}


def compare_models(df: DataFrame, label: str, preds: list[str]) -> DataFrame:
    """N, MSE, RMSE, MAE, R² per prediction column from one aggregate pass;
    ``winner`` marks the lowest MSE (ties: every tied model)."""
    aggs = [F.count(label).alias("n"), F.var_pop(label).alias("var_y")]
    for p in preds:
        e = F.col(label) - F.col(p)
        aggs += [F.avg(e * e).alias(f"{p}__mse"), F.avg(F.abs(e)).alias(f"{p}__mae")]
    wide = df.agg(*aggs)
    best = F.least(*[F.col(f"{p}__mse") for p in preds])
    rows = [F.struct(F.lit(p).alias("model"), F.col(f"{p}__mse").alias("mse"),
                     F.sqrt(F.col(f"{p}__mse")).alias("rmse"), F.col(f"{p}__mae").alias("mae"),
                     (F.lit(1.0) - F.col(f"{p}__mse") / F.col("var_y")).alias("r2"),
                     (F.col(f"{p}__mse") == best).alias("winner")) for p in preds]
    return wide.select("n", F.inline(F.array(*rows))).select("model", "n", "mse", "rmse", "mae", "r2", "winner")
