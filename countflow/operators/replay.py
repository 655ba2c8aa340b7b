"""Replaying past results as if units came in one after the other."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countflow.functions.common import seeded
from countflow.operators.grouped import prefix_number


def percent_to_n(percent: float, n: int, rounding: str = "up") -> int:
    share = round(percent / 100.0, 2)
    return math.ceil(share * n) if rounding == "up" else math.floor(share * n)


def shuffled(units: DataFrame, seed: int = 0, upweight: dict[str, dict[str, float]] | None = None, first: list[str] = (), scope: list[str] = ()) -> DataFrame:
    """units with `place` (1 first): a weighted random order without replacement; the units of `first` lead it.

    Exponential keys by a seeded hash, so the order depends on no partitioning. Weights of
    several categories multiply; a weight of 0 or less comes last.
    """
    weight = F.lit(1.0)
    for column, by in (upweight or {}).items():
        factor = F.lit(1.0)
        for value, w in by.items():
            factor = F.when(F.col(column) == value, float(w)).otherwise(factor)
        weight = weight * factor
    u = (seeded("geographic_unit_fips", seed).cast("double") + 1) / float((1 << 60) + 2)
    key = F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(1e300))
    forced = F.when(F.col("geographic_unit_fips").isin(list(first)), 0).otherwise(1)
    rows = units.withColumns({"_forced": forced, "_key": key})
    # Keys lie mostly below a few units; buckets of them keep any scope from meeting in one task.
    bucket = F.when(F.col("_forced") == 0, -1).otherwise(F.floor(F.least("_key", F.lit(1e6)) * 256)).cast("long")
    rows = prefix_number(rows, list(scope), ["_forced", "_key", "geographic_unit_fips"], bucket, "place")
    return rows.withColumn("place", F.col("place") + 1).drop("_forced", "_key")


def first_n(units: DataFrame, n: int, measures: list[str], unexpected: int = 0, all_columns: bool = False) -> DataFrame:
    """The first n units (by `place`) as finished, the rest at 0; raw_results_e keeps the truth.

    unexpected: that many of the n are copies of finished units under made-up ids. Only
    results_e of the measures become 0; with all_columns every results_ column does.
    """
    done = F.col("place") <= n - unexpected
    zero = [c for c in units.columns if c.startswith("results_")] if all_columns else [f"results_{e}" for e in measures]
    out = units.withColumns({f"raw_results_{e}": F.col(f"results_{e}") for e in measures})
    out = out.withColumns({c: F.when(done, F.col(c)).otherwise(0) for c in zero})
    out = out.withColumn("percent_expected_vote", F.when(done, 100.0).otherwise(0.0))
    if unexpected:
        copies = out.filter(F.col("place") <= min(unexpected, n - unexpected)).withColumn("geographic_unit_fips", F.concat("geographic_unit_fips", (F.col("place") - 1).cast("string")))
        out = out.unionByName(copies)
    return out


def percent(units: DataFrame, share: float, measures: list[str], rounding: str = "up", **more) -> DataFrame:
    return first_n(units, percent_to_n(share, units.count(), rounding), measures, **more)
