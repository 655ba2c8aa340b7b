"""Combining baseline and current tables and classifying units, for any number of contests at once.

`scope` names the columns that separate independent estimates (say, election_id); every
join and window includes them, so one plan serves all elections.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countflow.operators.measures import add_turnout_factor

REPORTING, NONREPORTING, UNEXPECTED = "reporting", "nonreporting", "unexpected"
BLOCKED, ZERO, STRANGE, STRANGE_TURNOUT, STRANGE_MARGIN = (f"non-modeled: {x}" for x in ("blocklisted", "zero baseline", "strange turnout factor", "strange turnout factor modeled", "strange margin change modeled"))


class NotEnoughUnits(Exception):
    """Fewer units report than the model needs."""


class EstimateError(Exception):
    """The input does not allow an estimate."""


def in_states(df: DataFrame, states: list[str]) -> DataFrame:
    return df.filter(F.col("postal_code").isin(states))


def semi_join(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df whose keys occur in other; never multiplied."""
    return df.join(other.select(*on), on, "left_semi")


def without_results(baseline: DataFrame) -> DataFrame:
    return baseline.drop(*[c for c in baseline.columns if c.startswith("results_")])


def combine(baseline: DataFrame, current: DataFrame, results: list[str], handle: str = "drop", scope: list[str] = ()) -> DataFrame:
    """Baseline with the current values of each unit and its turnout factor.

    handle: `drop` leaves out units of which any result is null; `zero` keeps them with null
    results as 0 and percent_expected_vote 0 (other results stay as they are).
    """
    keys = [*scope, "postal_code", "geographic_unit_fips"]
    joined = without_results(baseline).join(current, keys, "left")
    missing = reduce(Column.__or__, [F.col(c).isNull() for c in results])
    if handle == "drop":
        joined = joined.filter(~missing)
    elif handle == "zero":
        joined = joined.withColumns({"percent_expected_vote": F.when(missing, 0.0).otherwise(F.col("percent_expected_vote")), **{c: F.coalesce(c, F.lit(0.0)) for c in results}})
    else:
        raise ValueError(f"handle_unreporting must be drop or zero, not {handle}")
    return add_turnout_factor(joined)


def id_part(i: int) -> Column:
    return F.get(F.split("geographic_unit_fips", "_"), F.lit(i))


def county_of(unit_type: str | Column) -> Column:
    """The county in a unit's id: its second part where ids begin with a district, else its first."""
    district = F.lit("district" in unit_type) if isinstance(unit_type, str) else F.coalesce(F.contains(unit_type, F.lit("district")), F.lit(False))
    return F.when(district, F.coalesce(id_part(1), id_part(0))).otherwise(id_part(0))


def unexpected(current: DataFrame, combined: DataFrame, aggregates: list[str] = (), unit_type: str | Column = "county", scope: list[str] = (), order: list[str] = ("postal_code",)) -> DataFrame:
    """Units of the current table that the combined one lacks (by unit id alone), one row each."""
    keys = [*scope, "geographic_unit_fips"]
    out = current.filter(F.col("geographic_unit_fips").isNotNull()).join(combined.select(*keys), keys, "left_anti")
    w = Window.partitionBy(*keys).orderBy(*order)
    out = out.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
    if "county_fips" in aggregates:
        out = out.withColumn("county_fips", county_of(unit_type))
    if "district" in aggregates:
        out = out.withColumn("district", id_part(0))
    return out.withColumn("unit_category", F.lit(UNEXPECTED))


def category(threshold: float, lower: float = 0.5, upper: float = 2.0, units_blocked: list[str] = (), states_blocked: list[str] = (), modeled: dict[str, Column] | None = None) -> Column:
    """Why a unit is not modeled; null for modeled units. The first rule that holds counts.

    Blocked and zero-baseline units count whether they report or not; turnout factors (bounds
    included) and the modeled rules only where the unit reports.
    """
    reports = F.coalesce(F.col("percent_expected_vote") >= threshold, F.lit(False))
    blocked = F.col("geographic_unit_fips").isin(list(units_blocked)) | F.col("postal_code").isin(list(states_blocked))
    odd = (F.col("turnout_factor") <= lower) | (F.col("turnout_factor") >= upper)
    rule = F.when(blocked, BLOCKED).when(F.abs("baseline_weights") <= 1e-8, ZERO).when(reports & odd, STRANGE)
    for name, flag in (modeled or {}).items():
        rule = rule.when(reports & F.coalesce(flag, F.lit(False)), name)
    return rule


def classify(combined: DataFrame, threshold: float, extra: DataFrame | None = None, **rules) -> DataFrame:
    """One table of all units with role, reporting (1 or 0) and unit_category.

    role is reporting, nonreporting or unexpected (units that are not modeled count as
    unexpected in roll-ups). Units whose percent is null have no role and are left out, as
    are nulls of both predicates. extra: unexpected units.
    """
    out = combined.withColumn("unit_category", category(threshold, **rules))
    pev = F.col("percent_expected_vote")
    role = F.when(F.col("unit_category").isNotNull(), UNEXPECTED).when(pev >= threshold, REPORTING).when(pev < threshold, NONREPORTING)
    out = out.withColumn("role", role).filter(F.col("role").isNotNull()).withColumn("unit_category", F.coalesce("unit_category", F.lit("expected")))
    if extra is not None:
        out = out.unionByName(extra.withColumn("role", F.lit(UNEXPECTED)), allowMissingColumns=True)
    return out.withColumn("reporting", (F.col("role") == REPORTING).cast("int"))


def residual_outliers(units: DataFrame, value: str, center: str, z: float = 2.0, scope: list[str] = (), least: int = 20) -> Column:
    """Whether |value - center| exceeds its mean plus z population deviations within scope (more than `least` units needed)."""
    w = Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(1))
    off = F.abs(F.col(value) - F.col(center))
    return (off > F.avg(off).over(w) + z * F.stddev_pop(off).over(w)) & (F.count(off).over(w) > least)


def check_enough(units: DataFrame, least: float, scope: list[str] = ()) -> None:
    """Raises NotEnoughUnits where a scope has fewer reporting units than needed."""
    counts = units.groupBy(*scope).agg(F.coalesce(F.sum((F.col("role") == REPORTING).cast("int")), F.lit(0)).alias("n"))
    short = counts.filter(F.col("n") < least).limit(1).collect()
    if short:
        raise NotEnoughUnits(f"Currently {short[0].n} reporting, need at least {least:g}")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Units that appear more than once within their keys, with how often."""
    return df.groupBy(*keys, "geographic_unit_fips").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def ids_by_state(units: DataFrame, scope: list[str] = ()) -> DataFrame:
    """The ids of units that are not modeled, by reason and state, in order, joined by commas."""
    odd = units.filter((F.col("unit_category") != "expected") & (F.col("unit_category") != UNEXPECTED))
    return odd.groupBy(*scope, "unit_category", "postal_code").agg(F.array_join(F.sort_array(F.collect_list("geographic_unit_fips")), ",").alias("units"))


def check_unique(units: DataFrame, scope: list[str] = ()) -> None:
    twice = duplicates(units, list(scope)).limit(1).collect()
    if twice:
        raise EstimateError(f"At least one unit appears twice: {twice[0].geographic_unit_fips}")
