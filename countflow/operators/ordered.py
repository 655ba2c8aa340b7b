"""Ordered-set operators: weighted quantiles and medians, corrections, winsorised deviations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _shares(df: DataFrame, by: list[str], value: str, weight: str, tie: list[str]) -> DataFrame:
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    up = part.orderBy(value, *tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.filter(F.col(value).isNotNull() & F.col(weight).isNotNull())
    return rows.withColumns({"_cum": F.sum(weight).over(up), "_all": F.sum(weight).over(part)})


def weighted_quantile(df: DataFrame, by: list[str], value: str, weight: str, tau: float, tie: list[str], name: str) -> DataFrame:
    """Least value at which the running weight reaches tau of the total: an intercept-only quantile regression."""
    rows = _shares(df, by, value, weight, tie)
    return rows.filter(F.col("_cum") >= tau * F.col("_all")).groupBy(*by).agg(F.min(value).alias(name))


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str, tie: list[str], name: str = "weighted_median") -> DataFrame:
    """The value after the last running share of at most one half; the mean of both where the share is exactly one half.

    A first value that alone weighs more than one half is the median itself.
    """
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    rows = _shares(df, by, value, weight, tie).withColumn("_next", F.lead(value).over(part.orderBy(value, *tie)))
    below = F.col("_cum") * 2 <= F.col("_all")
    exact = F.when(F.col("_cum") * 2 == F.col("_all"), (F.col(value) + F.col("_next")) / 2)
    pick = F.max_by(F.coalesce(exact, F.col("_next")), F.when(below, F.struct("_cum", value)))
    return rows.groupBy(*by).agg(F.coalesce(pick, F.min(value)).alias(name))


def population_correction(df: DataFrame, by: list[str], score: str, weight: str, q: Column | float, tie: list[str], name: str = "correction") -> DataFrame:
    """Least score whose running weight share exceeds q; null where none does (too few units)."""
    rows = _shares(df, by, score, weight, tie)
    over = F.col("_cum") > (q if isinstance(q, Column) else F.lit(q)) * F.col("_all")
    return rows.groupBy(*by).agg(F.min(F.when(over, F.col(score))).alias(name))


def linear_quantile(df: DataFrame, by: list[str], value: str, q: Column | float, tie: list[str], name: str) -> DataFrame:
    """Linear-interpolation quantile per group; q may be a column that is constant in each group. Nulls are left out."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    level = F.least((q if isinstance(q, Column) else F.lit(float(q))), F.lit(1.0))
    rows = df.withColumn("_q", level).filter(F.col(value).isNotNull())
    rows = rows.withColumns({"_k": F.row_number().over(part.orderBy(value, *tie)) - 1, "_h": F.col("_q") * (F.count(F.lit(1)).over(part) - 1)})
    h = F.col("_h")
    lo, hi = F.max(F.when(F.col("_k") == F.floor(h), F.col(value))), F.max(F.when(F.col("_k") == F.ceil(h), F.col(value)))
    return rows.groupBy(*by).agg((lo + (F.max(h) - F.floor(F.max(h))) * (hi - lo)).alias(name))


def inflate(c: str) -> Column:
    """Sum of squares over squared sum."""
    return F.try_divide(F.sum(F.col(c) * F.col(c)), F.pow(F.sum(c), F.lit(2.0)))


def winsorized_std(df: DataFrame, by: list[str], value: str, tie: list[str], share: float = 0.05, name: str = "winsorized_std") -> DataFrame:
    """Sample deviation after the lowest and highest floor(share * n) values are set to the nearest kept ones."""
    part = Window.partitionBy(*by)
    rows = df.filter(F.col(value).isNotNull()).withColumns({"_k": F.row_number().over(part.orderBy(value, *tie)), "_n": F.count(F.lit(1)).over(part)})
    cut = F.floor(F.lit(share) * F.col("_n"))
    keep = (F.col("_k") > cut) & (F.col("_k") <= F.col("_n") - cut)
    rows = rows.withColumns({"_lo": F.min(F.when(keep, F.col(value))).over(part), "_hi": F.max(F.when(keep, F.col(value))).over(part)})
    return rows.groupBy(*by).agg(F.stddev_samp(F.greatest(F.least(F.col(value), F.col("_hi")), F.col("_lo"))).alias(name))


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
