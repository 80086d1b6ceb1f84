"""Selection-bias statistics: scalars for the driver, Columns for tables."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tickloom.operators.slices import block, day, over


def normal_pdf(x):
    return np.exp(-0.5 * np.square(x)) / math.sqrt(2 * math.pi)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def erf(x: Column, nodes: int = 40) -> Column:
    """The error function within 1e-13: 2 / sqrt(pi) times the integral of exp(-t^2) from
    0 to x, by Gauss's rule over [0, x]. From 6 on it is one at that precision."""
    at, weight = np.polynomial.legendre.leggauss(nodes)
    y = F.least(F.abs(x), F.lit(6.0))
    total = None
    for t, w in zip((at + 1) / 2, weight / 2):
        one = F.lit(float(w)) * F.exp(y * y * F.lit(-float(t * t)))
        total = one if total is None else total + one
    return F.signum(x) * F.least(F.lit(1.0), F.lit(2 / math.sqrt(math.pi)) * y * total)


def cdf(x: Column) -> Column:
    """The standard normal distribution function, within 1e-13."""
    return (1 + erf(x / math.sqrt(2))) / 2


def pdf(x: Column) -> Column:
    return F.exp(x * x / -2) / math.sqrt(2 * math.pi)


@functools.lru_cache(maxsize=4096)
def expected_maximum(n: int) -> float:
    """Mean of the largest of n independent standard normals, by Simpson's rule
    over [-9, 9] in steps of 0.001."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError("n must be a positive integer")
    if n == 1:
        return 0.0
    x = np.linspace(-9, 9, 18_001)
    cdf = np.array([normal_cdf(v) for v in x])
    y = n * x * normal_pdf(x) * cdf ** (n - 1)
    w = np.full(len(x), 2.0)
    w[1::2], w[[0, -1]] = 4.0, 1.0
    return float(w @ y * 0.001 / 3)


def hurdle_empirical(dispersion: float, trials: int) -> float:
    if not math.isfinite(dispersion) or dispersion <= 0:
        raise ValueError("dispersion must be positive")
    return dispersion * expected_maximum(trials)


def hurdle_modelled(sigma: float, rho: float, trials: int) -> float:
    if not (math.isfinite(sigma) and sigma > 0 and 0 <= rho < 1):
        raise ValueError("need sigma > 0 and 0 <= rho < 1")
    return sigma * math.sqrt(1 - rho) * expected_maximum(trials)


def sharpe_error(t: int, sr: float, skew: float = 0.0, kurtosis: float = 3.0) -> float:
    if t < 2 or kurtosis <= 1:
        raise ValueError("need t >= 2 and raw kurtosis > 1")
    var = (1 - skew * sr + (kurtosis - 1) / 4 * sr * sr) / (t - 1)
    if not var > 0:
        raise ValueError("no positive variance: check the units of the ratio")
    return math.sqrt(var)


def deflated_decision(sr: float, hurdle: float, error: float, method: str, threshold: float = 0.95) -> tuple[float, bool]:
    """(probability that the true ratio beats the hurdle, whether it suffices)."""
    if not method:
        raise ValueError("name the method of the standard error")
    p = normal_cdf((sr - hurdle) / error)
    return p, p >= threshold


def decision(sr: Column, hurdle: Column, error: Column, method: str, threshold: float = 0.95) -> tuple[Column, Column]:
    """(probability that the true ratio beats the hurdle, whether it suffices) as Columns,
    null where there is no standard error."""
    if not method:
        raise ValueError("name the method of the standard error")
    p = cdf((sr - hurdle) / error)
    return p, p >= threshold


def default_lags(t: int) -> int:
    return max(1, int(4 * (t / 100) ** (2 / 9)))


def sharpe(r: Column) -> Column:
    """Mean over sample deviation; 0 for fewer than two or no spread."""
    sd = F.stddev_samp(r)
    return F.when((F.count(r) < 2) | sd.isNull() | (sd <= 1e-9), 0.0).otherwise(F.avg(r) / sd)


def sharpe_table(returns: DataFrame, by: list[str], value: str = "r") -> DataFrame:
    """Per candidate: t, ratio, skew, raw kurtosis and its standard error (null
    where no positive variance remains)."""
    t = returns.groupBy(*by).agg(F.count(value).alias("t"), sharpe(F.col(value)).alias("sr"), F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt"))
    var = (1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")) / (F.col("t") - 1)
    return t.where("t >= 2").withColumn("se", F.when(var > 0, F.sqrt(var)))


def autocorrelation_error(returns: DataFrame, by: list[str], order: list[str], value: str = "r", span: int = 365) -> DataFrame:
    """Per candidate with 8 values or more: t, n_lags (the rule of thumb), the sum
    of autocorrelations and sqrt((1 + 2 sum) / t), null where that is not positive.

    Every lag is one lag() over the same window, so one sort serves all; a candidate's
    history is cut into stretches that begin with the rows the lags look back on, and
    the products are summed up where they lie. There are as many lags as the longest
    candidate's rule asks for: its length, one number, comes to the driver first. The
    order begins with an instant, whose days, `span` at a time, are its slices, or with a
    number, cut every 65536."""
    count = returns.groupBy(*by).agg(F.count(value).alias("_t"), F.avg(value).alias("_mean")).where("_t >= 8")
    longest = count.agg(F.max("_t").alias("t")).first()["t"] or 0
    most = default_lags(longest) + 1 if longest else 0  # one more, should roundings differ
    base = returns.select(*by, *order, F.col(value).alias("_r")).join(count, by).withColumn("_d", F.col("_r") - F.col("_mean"))
    base = base.withColumn("_l", F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("_t") / 100.0, F.lit(2 / 9)))).cast("int"))

    def lags(t, w):
        lagged = F.lit(0.0)
        for k in range(1, most + 1):
            lagged = lagged + F.when(F.col("_l") >= k, F.coalesce(F.lag("_d", k).over(w), F.lit(0.0))).otherwise(0.0)
        return t.withColumn("_p", F.col("_d") * lagged)

    kind = base.schema[order[0]].dataType
    at = block(order[0], 1 << 16) if isinstance(kind, NumericType) else F.floor(day(order[0]) / span)
    rows = over(base, lags, most, order[0], by=tuple(by), order=tuple(order[1:]), at=at)
    out = rows.groupBy(*by).agg(F.max("_t").alias("t"), F.max("_l").alias("n_lags"), (F.sum("_p") / F.sum(F.col("_d") * F.col("_d"))).alias("autocorr_sum"))
    factor = 1 + 2 * F.col("autocorr_sum")
    return out.withColumn("se", F.when(factor > 0, F.sqrt(factor / F.col("t"))))
