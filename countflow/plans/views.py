"""The project's tables as baseline, current and versioned views of all elections at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countflow.functions.common import bounded, repaired_id, repaired_state, table
from countflow.functions.nulls import clean
from countflow.operators import measures, units

SCOPE = ["election_id"]
#: Percent from which a unit counts as reporting in the registered queries, and the covariates they use.
THRESHOLD = 60.0
COVARIATES = ["median_household_income", "percent_bachelor_or_higher", "age_le_30"]
RESULTS = ["results_dem", "results_gop", "results_turnout"]


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that exist now, one row each, with evenly written classes."""
    b = table(spark, sf_dir, "baseline_units").filter(F.col("removed_at").isNull())
    w = Window.partitionBy("geographic_unit_fips").orderBy(F.col("added_at").desc(), F.col("baseline_turnout").desc(), "postal_code")
    b = b.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "added_at", "removed_at")
    counts = {c: F.col(c).cast("double") for c in ("baseline_dem", "baseline_gop", "baseline_turnout", *RESULTS)}
    return clean(b).withColumns({**counts, "county_classification": F.lower(F.trim("county_classification"))})


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last load of every election, repaired; of several rows of a unit the last written."""
    last = table(spark, sf_dir, "load_register").groupBy("election_id").agg(F.max("load_id").alias("load_id"))
    c = table(spark, sf_dir, "current_loads").join(bounded(last), "load_id")
    c = clean(c).withColumns({"geographic_unit_fips": repaired_id("geographic_unit_fips"), "postal_code": repaired_state("postal_code")}).filter(F.col("geographic_unit_fips").isNotNull())
    w = Window.partitionBy("election_id", "geographic_unit_fips").orderBy(F.col("row_id").desc())
    c = c.withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    return c.select("election_id", "postal_code", "geographic_unit_fips", *RESULTS, "percent_expected_vote")


def expected(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """The baseline units of every election that has loads: those of its states."""
    loads = table(spark, sf_dir, "load_register").select("election_id").distinct()
    states = table(spark, sf_dir, "election_config").select("election_id", F.explode("states").alias("postal_code")).join(loads, "election_id", "left_semi")
    return states.distinct().join(base if base is not None else baseline(spark, sf_dir), "postal_code")


def combined(spark: SparkSession, sf_dir: str, handle: str = "drop") -> DataFrame:
    """Baseline and current values with the measures dem and margin."""
    base = measures.add_baselines(expected(spark, sf_dir), {"dem": "dem", "turnout": "turnout", "margin": "margin"})
    cur, _ = measures.add_results(current(spark, sf_dir), ["dem", "margin"])
    return units.combine(base, cur, RESULTS, handle, SCOPE)


def classified(spark: SparkSession, sf_dir: str, with_unexpected: bool = True, **rules) -> DataFrame:
    both = combined(spark, sf_dir)
    extra = None
    if with_unexpected:
        cur, _ = measures.add_results(current(spark, sf_dir), ["dem", "margin"])
        extra = units.unexpected(cur, both, ["county_fips", "district"], "county", SCOPE)
    return units.classify(both, THRESHOLD, extra, **rules)
