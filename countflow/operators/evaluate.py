"""Back-testing: masking past results and scoring estimates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mask_history(past: DataFrame, current: DataFrame, measures: list[str], threshold: float, scope: list[str] = ()) -> DataFrame:
    """Past results as they would have looked with the units that report now: 0 where a unit does not."""
    keys = [*scope, "postal_code", "geographic_unit_fips"]
    j = past.join(current.select(*keys, "percent_expected_vote"), keys)
    seen = F.coalesce(F.col("percent_expected_vote") >= threshold, F.lit(False))
    return j.withColumns({f"results_{e}": F.when(seen, F.col(f"results_{e}")).otherwise(0.0) for e in measures})


def metrics(e: str, alphas: list[float], true: str | None = None) -> list[Column]:
    """Aggregates: mae, mape (true values of 0 left out; null if none is left), coverage and mean relative interval length."""
    t, p = F.col(true or f"raw_results_{e}"), F.col(f"pred_{e}")
    out = [F.avg(F.abs(t - p)).alias(f"mae_{e}"), F.avg(F.when(t != 0, F.abs(F.try_divide(t - p, t)))).alias(f"mape_{e}")]
    for a in alphas:
        lo, hi = F.col(f"`lower_{a}_{e}`"), F.col(f"`upper_{a}_{e}`")
        out.append(F.avg(((lo <= t) & (t <= hi)).cast("double")).alias(f"frac_within_pi_{a}_{e}"))
        size = F.when((t == 0) & (hi == lo), 0.0).otherwise(F.abs(F.try_divide(hi - lo, t)))
        out.append(F.avg(size).alias(f"mean_pi_length_{a}_{e}"))
    return out


def score(estimates: DataFrame, truth: DataFrame, on: list[str], by: list[str], e: str, alphas: list[float] = (), scope: list[str] = ()) -> DataFrame:
    """Metrics per group and over all (level `all`) in one pass with grouping sets."""
    j = estimates.join(truth, on)
    sets = [[F.col(c) for c in (*scope, *by)], [F.col(c) for c in scope]]
    keys = [F.col(c) for c in (*scope, *by)]
    out = j.groupingSets(sets, *keys).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), *metrics(e, list(alphas)))
    return out.withColumn("level", F.when(F.col("_g") == 0, "group").otherwise("all")).drop("_g")


def truth(units: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    return units.groupBy(*by).agg(*[F.sum(f"results_{e}").alias(f"raw_results_{e}") for e in measures])


def merge_measures(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Result tables of several measures side by side, on the full key."""
    return reduce(lambda a, b: a.join(b.drop(*[c for c in b.columns if c in a.columns and c not in keys]), keys), frames)
