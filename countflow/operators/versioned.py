"""Versioned results: the lead at every whole percent, validity of courses, and extrapolation from finished units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countflow.functions.common import bounded
from countflow.functions.nulls import ratio

NON_MONOTONE, BATCH, VALID = "non-monotone percent expected vote", "batch_margin", "none"


def between(df: DataFrame, start=None, end=None, at: str = "last_modified") -> DataFrame:
    """Versions stamped within [start, end]; either end may be open."""
    if start is not None:
        df = df.filter(F.col(at) >= F.lit(start).cast("timestamp"))
    return df if end is None else df.filter(F.col(at) <= F.lit(end).cast("timestamp"))


def thin(register: DataFrame, every: int, series: list[str], at: str) -> DataFrame:
    """Every n-th version of each series in time order, beginning with the first."""
    rank = F.dense_rank().over(Window.partitionBy(*series).orderBy(at))
    return register.withColumn("_k", (rank - 1) % every).filter("_k = 0").drop("_k")


def append_current(versions: DataFrame, current: DataFrame, scope: list[str] = ()) -> DataFrame:
    """versions with the current values of each unit one second after the last version."""
    last = versions.groupBy(*scope).agg((F.max("last_modified") + F.expr("INTERVAL 1 SECOND")).alias("last_modified"))
    now = current.drop("last_modified")
    now = now.join(bounded(last), list(scope)) if scope else now.join(bounded(last), F.lit(True))
    return versions.unionByName(now, allowMissingColumns=True)


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def courses(versions: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Each version with its corrected percent, the lead of the batch up to the next version, and the unit's error_type.

    The percent is the turnout's share of the unit's last turnout times its last percent.
    A unit whose turnout ever falls is non-monotone; one with a batch in which the lead
    changes by more than the votes is a batch error. Nulls count as 0.
    """
    part = Window.partitionBy(*keys)
    by_time = part.orderBy("last_modified", tie)
    whole = by_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t, d, g, w = (_zero(f"results_{c}") for c in ("turnout", "dem", "gop", "weights"))
    rows = versions.select(*keys, "last_modified", tie, t.alias("_t"), d.alias("_d"), g.alias("_g"), w.alias("_w"), _zero("percent_expected_vote").alias("_p"), _zero("results_normalized_margin").alias("norm"))

    def step(c: str) -> Column:
        return F.coalesce(F.lead(c).over(by_time) - F.col(c), F.lit(0.0))

    rows = rows.withColumns({"_lt": F.last("_t").over(whole), "_lp": F.last("_p").over(whole), "last_norm": F.last("norm").over(whole), "_dt": step("_t"), "_dm": step("_d") - step("_g"), "_dw": step("_w"), "k": F.row_number().over(by_time)})
    batch = F.when((F.col("_dw") == 0) & (F.col("_dm") == 0), 0.0).otherwise(F.try_divide("_dm", "_dw"))
    rows = rows.withColumns({"pct": ratio("_t", "_lt") * F.col("_lp"), "batch": batch})
    fell = F.max(((F.col("_dt") < 0) & (F.col("_lt") != 0)).cast("int")).over(part)
    odd = F.max((F.col("batch").isNull() | (F.abs("batch") > 1)).cast("int")).over(part)
    kind = F.when(fell == 1, NON_MONOTONE).when(odd == 1, BATCH).otherwise(VALID)
    rows = rows.withColumns({"error_type": kind, "next_pct": F.lead("pct").over(by_time)})
    return rows.drop("_t", "_d", "_g", "_w", "_p", "_lt", "_lp", "_dt", "_dm", "_dw")


def estimate(versions: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """The interpolated lead at every whole percent from 0 to the unit's last, and its distance to the last lead.

    Every version covers the whole percents from its own up to the next version's, so the
    as-of lookup is an explode of each version's own range and needs no join. Percents
    before the first version take its lead. Invalid units give 101 rows of nulls.
    """
    rows = courses(versions, keys, tie)
    good = rows.filter(F.col("error_type") == VALID)
    start = F.ceil("pct").cast("long")
    stop = F.coalesce(F.ceil("next_pct").cast("long") - 1, F.floor("pct").cast("long"))
    seen = F.when(stop >= start, F.sequence(start, stop)).otherwise(F.array().cast("array<long>"))
    early = F.when((F.col("k") == 1) & (start > 0), F.sequence(F.lit(0).cast("long"), start - 1)).otherwise(F.array().cast("array<long>"))
    here = good.withColumn("_c", F.explode(F.concat(F.transform(seen, lambda p: F.struct(p.alias("p"), F.lit(False).alias("early"))), F.transform(early, lambda p: F.struct(p.alias("p"), F.lit(True).alias("early"))))))
    p, first = F.col("_c.p"), F.col("_c.early")
    inside = F.try_divide(F.col("norm") * F.col("pct") + F.col("batch") * (p - F.col("pct")), p.cast("double"))
    # Within the last version's percent nothing is left to interpolate, but a fraction above it does not count.
    margin = F.when(p == 0, 0.0).when(first, F.col("norm")).otherwise(inside)
    nearest = F.when(first, F.col("pct")).otherwise(F.coalesce("next_pct", "pct"))
    out = here.select(*keys, p.alias("percent_expected_vote"), nearest.alias("nearest_observed_vote"), margin.alias("est_margin"), (F.col("last_norm") - margin).alias("est_correction"), "error_type")
    bad = rows.filter((F.col("error_type") != VALID) & (F.col("k") == 1))
    none = F.lit(None).cast("double")
    bad = bad.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(100).cast("long"))).alias("percent_expected_vote"), none.alias("nearest_observed_vote"), none.alias("est_margin"), none.alias("est_correction"), "error_type")
    return out.unionByName(bad)


def corrections(open_units: DataFrame, donors: DataFrame, estimates: DataFrame, scope: list[str] = (), threshold: float = 75.0, least: int = 5, reach: float = 5.0) -> DataFrame:
    """Per open county beyond the threshold: mean, max, min, deviation and count of the donors' corrections at its percent.

    donors: finished counties of the same state (at least `least`). estimates: estimate() of
    the donors. Only corrections whose nearest observation lies within reach count.
    """
    state = [*scope, "postal_code"]
    enough = donors.groupBy(*state).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).drop("_n")
    est = estimates.join(donors.select(*state, "geographic_unit_fips"), [*scope, "geographic_unit_fips"]).withColumnRenamed("geographic_unit_fips", "_donor").withColumnRenamed("percent_expected_vote", "_at")
    todo = open_units.filter((F.col("percent_expected_vote") >= threshold) & (F.col("geographic_unit_type") == "county")).join(bounded(enough), state, "left_semi")
    todo = todo.select(*state, "geographic_unit_fips", F.bround("percent_expected_vote", 0).cast("long").alias("_at"))
    j = todo.join(est, [*state, "_at"], "left")
    ok = (F.abs(F.col("_at") - F.col("nearest_observed_vote")) < reach) & F.col("est_correction").isNotNull()
    c = F.when(ok, F.col("est_correction"))
    return j.groupBy(*state, "geographic_unit_fips").agg(F.avg(c).alias("est_correction"), F.max(c).alias("est_correction_max"), F.min(c).alias("est_correction_min"), F.stddev_samp(c).alias("est_correction_std"), F.count(c).alias("est_correction_count"))


def extrapolate(open_units: DataFrame, found: DataFrame, scope: list[str] = (), spread: str = "std") -> DataFrame:
    """Open units with pred_extrapolate (current lead plus mean correction) and its deviation (`std` or `max_min`)."""
    if spread not in ("std", "max_min"):
        raise ValueError("spread must be std or max_min")
    dev = F.col("est_correction_std") if spread == "std" else F.col("est_correction_max") - F.col("est_correction_min")
    keys = [*scope, "postal_code", "geographic_unit_fips"]
    return open_units.join(found, keys, "left").withColumns({"pred_extrapolate": F.col("results_normalized_margin") + F.col("est_correction"), "pred_extrapolate_std": dev})
