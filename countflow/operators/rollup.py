"""Roll-ups of units to any dimension: one conditional aggregation instead of outer joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countflow.operators.units import NONREPORTING, UNEXPECTED


def _keyed(units: DataFrame, by: list[str]) -> DataFrame:
    """Rows with all keys; classes of counties are unknown for unexpected units, so those take no part there."""
    rows = units.dropna(subset=by)
    return rows.filter(F.col("role") != UNEXPECTED) if "county_classification" in by else rows


def known_votes(units: DataFrame, by: list[str], e: str) -> DataFrame:
    """Sum of results and of reporting flags over reporting and unexpected units."""
    rows = _keyed(units, by).filter(F.col("role") != NONREPORTING)
    return rows.groupBy(*by).agg(F.coalesce(F.sum(f"results_{e}"), F.lit(0.0)).alias(f"results_{e}"), F.sum("reporting").alias("reporting"))


def open_votes(units: DataFrame, by: list[str], e: str) -> DataFrame:
    """Sums over nonreporting units: results so far and predictions."""
    rows = _keyed(units, by).filter(F.col("role") == NONREPORTING)
    return rows.groupBy(*by).agg(F.coalesce(F.sum(f"results_{e}"), F.lit(0.0)).alias(f"results_{e}"), F.coalesce(F.sum(f"pred_{e}"), F.lit(0.0)).alias(f"pred_{e}"))


def predictions(units: DataFrame, by: list[str], e: str, sums: list[str] = ()) -> DataFrame:
    """pred_e (known results plus predictions of open units), results_e and reporting per group.

    sums: further unit columns (say, interval ends) that replace results on open units too.
    """
    open_ = F.col("role") == NONREPORTING
    known = F.col(f"results_{e}")

    def total(c: str):
        return F.coalesce(F.sum(F.when(open_, F.col(c)).otherwise(known)), F.lit(0.0))

    aggs = [total(f"pred_{e}").alias(f"pred_{e}"), F.coalesce(F.sum(known), F.lit(0.0)).alias(f"results_{e}"), F.sum("reporting").alias("reporting")]
    return _keyed(units, by).groupBy(*by).agg(*aggs, *[total(c).alias(c) for c in sums])


def all_levels(units: DataFrame, scope: list[str], levels: list[str], e: str) -> DataFrame:
    """The predictions of several single-key levels and of the whole scope in one pass (grouping sets)."""
    open_ = F.col("role") == NONREPORTING
    sets = [[*[F.col(s) for s in scope], F.col(k)] for k in levels] + [[F.col(s) for s in scope]]
    rows = units.dropna(subset=scope)
    keys = [F.col(c) for c in (*scope, *levels)]
    out = rows.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("_g"), F.coalesce(F.sum(F.when(open_, F.col(f"pred_{e}")).otherwise(F.col(f"results_{e}"))), F.lit(0.0)).alias(f"pred_{e}"), F.sum("reporting").alias("reporting"), F.count(F.lit(1)).alias("units")
    )
    n = len(levels)
    level, key = F.lit("all"), F.lit("all")
    for i, k in enumerate(levels):
        # Of the trailing bits of the id only level i is grouped.
        mask = ((1 << n) - 1) ^ (1 << (n - 1 - i))
        level = F.when(F.col("_g") == mask, F.lit(k)).otherwise(level)
        key = F.when(F.col("_g") == mask, F.col(k)).otherwise(key)
    return out.select(*scope, level.alias("level"), key.alias("key"), f"pred_{e}", "reporting", "units").filter(F.col("key").isNotNull())


def district_contests(units: DataFrame, scope: list[str] = (), least: int = 10) -> DataFrame:
    """Districts that are contests of their own: of states with several districts, and of more than `least` units."""
    n = units.dropna(subset=["postal_code", "district"]).groupBy(*scope, "postal_code", "district").agg(F.count(F.lit(1)).alias("n"))
    several = F.count(F.lit(1)).over(Window.partitionBy(*scope, "postal_code")) > 1
    return n.withColumn("_s", several).filter(F.col("_s") & (F.col("n") > least)).drop("_s")


def normalized_margin(units: DataFrame, by: list[str]) -> DataFrame:
    """Predicted and current lead over votes per group; 0 / 0 is 0, anything else over 0 null."""
    from countflow.functions.nulls import strict_ratio

    open_ = F.col("role") == NONREPORTING
    rows = _keyed(units, by)
    out = rows.groupBy(*by).agg(
        F.sum(F.when(open_, F.col("pred_margin")).otherwise(F.col("results_margin"))).alias("_m"), F.sum(F.when(open_, F.col("pred_turnout")).otherwise(F.col("results_weights"))).alias("pred_turnout"),
        F.sum("results_margin").alias("_rm"), F.sum("results_weights").alias("_rw"), F.sum("reporting").alias("reporting"),
    )
    return out.select(*by, strict_ratio("_m", "pred_turnout").alias("pred_margin"), strict_ratio("_rm", "_rw").alias("results_margin"), "reporting", "pred_turnout")


def baseline_margin(units: DataFrame, by: list[str]) -> DataFrame:
    """(dem - gop) / (turnout + 1) of the baseline per group."""
    return _keyed(units, by).groupBy(*by).agg(((F.sum("baseline_dem") - F.sum("baseline_gop")) / (F.sum("baseline_turnout") + 1)).alias("baseline_margin"))
