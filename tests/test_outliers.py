"""The outlier rule in an election of two states, of which one has a shifted level."""

import pytest
from pyspark.sql import functions as F

from countflow.config import Request
from countflow.plans import catalog
from countflow.plans.client import Client

SCHEMA = "election_id string, postal_code string, geographic_unit_fips string, role string, turnout_factor double, baseline_weights double, median_household_income double, percent_bachelor_or_higher double, age_le_30 double, baseline_normalized_margin double"


def units(spark):
    """Exactly 1 + 0.1 x in AA and 2 + 0.1 x in BB, but for one unit of AA that lies between; AA has four fifths."""
    rows = []
    for i in range(60):
        state = "BB" if i % 5 == 0 else "AA"
        x = (i * 7 % 11) / 10
        rows.append(("e", state, f"u{i:02d}", "reporting", (2.0 if state == "BB" else 1.0) + 0.1 * x + (0.4 if i == 33 else 0.0), 1.0, x, (i * 5 % 13) / 10, (i * 3 % 17) / 10, (i * 11 % 19) / 10))
    return spark.createDataFrame(rows, SCHEMA)


def test_query_fits_a_level_for_each_state(spark, monkeypatch):
    monkeypatch.setattr(catalog.views, "classified", lambda *_: units(spark))
    assert [x.geographic_unit_fips for x in catalog.outlier_rule_covariates(spark, "").collect()] == ["u33"]


def test_client_fits_a_level_for_each_state(spark):
    client = Client(spark, None)
    request = Request(["turnout"], [0.9])
    flags = client._outliers(units(spark).drop("election_id"), request).collect()
    assert [x.geographic_unit_fips for x in flags] == ["u33"]


def test_exact_fit_gives_exact_levels(spark):
    u = units(spark).withColumns({"residuals_o": F.col("turnout_factor"), "last_election_results_o": F.col("baseline_weights"), "train": F.lit(True)})
    fit = catalog.conformal.fit_scores(u, "o", ["median_household_income"], [0.5], ["election_id"], effects=["postal_code"])
    for x in u.join(fit, ["election_id", "geographic_unit_fips"]).collect():
        assert x.q_0 == pytest.approx(x.turnout_factor - (0.4 if x.geographic_unit_fips == "u33" else 0.0), abs=1e-6)
