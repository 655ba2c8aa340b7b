import pytest
from pyspark.sql import functions as F

import __spark_entry__
from countflow.operators import bootstrap
from countflow.plans import catalog
from tests.oracle import connect, same

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
CORE = [n for n in QUERIES if not n.startswith(("p7", "p8", "p9"))]


@pytest.fixture(scope="module")
def con(data_folder="/root/testdata/sf0.001"):
    return connect(data_folder)


@pytest.mark.parametrize("name", [n for n in CORE if n in SQL])
def test_query_matches_sql(spark, data, con, name):
    same(spark, data, QUERIES[name], SQL[name], con)


DATA = "/root/testdata/sf0.01"
KEYS = ["election_id", "geographic_unit_fips"]


@pytest.fixture(scope="module")
def frames(spark):
    """Results of the queries without SQL over tables in which every estimate has units, and of those they are compared with."""
    names = ["q_outlier_rule_covariates", "q_qr_covariates", "q_gaussian_full", "q_gaussian_units", "q_bootstrap_units", "q_bootstrap_state", "q_bootstrap_national", "q_conformal_units_intercept", "q_unit_roles", "q_units_combined", "q_nonreporting_bounds", "q_normalized_margin_state"]
    return {n: QUERIES[n](spark, DATA).toPandas() for n in names}


def test_queries_without_sql_are_all_tested():
    assert {n for n in CORE if n not in SQL} == {"p2_found", "p4_grid", "q_outlier_rule_covariates", "q_qr_covariates", "q_gaussian_full", "q_gaussian_units", "q_bootstrap_units", "q_bootstrap_state", "q_bootstrap_national"}


def test_intervals_of_covariates_and_of_gaussian_models(frames):
    roles, counted = frames["q_unit_roles"], frames["q_units_combined"].set_index(KEYS).results_dem
    open_ = {tuple(x) for x in roles[roles.role == "nonreporting"][KEYS].itertuples(index=False)}
    for name in ("q_qr_covariates", "q_gaussian_units"):
        f = frames[name].set_index(KEYS)
        assert set(f.index) == open_ and len(f) == len(open_)
        f = f.dropna()
        assert len(f) and (f.lower <= f.upper).all() and (f.lower >= counted.loc[f.index]).all() and (f.lower == f.lower.round()).all()
    # A bootstrap bound of the deviation is no smaller than what calibrates without it most of the time, so intervals are real.
    g, c = frames["q_gaussian_units"].set_index(KEYS), frames["q_conformal_units_intercept"].set_index(KEYS)
    both = g.join(c, rsuffix="_c").dropna()
    assert (both.upper - both.lower).median() > 0 and (both.upper_c - both.lower_c).median() > 0
    full = frames["q_gaussian_full"]
    assert (full["lower_0.7_dem"] <= full["upper_0.7_dem"]).all() and len(full) == 4


def test_quantile_fits_are_optimal(spark):
    """No small step from the fitted coefficients lowers the weighted pinball loss."""
    import numpy as np

    from countflow.operators import conformal
    from countflow.plans.views import COVARIATES, SCOPE

    u = catalog._units(spark, DATA).filter("role = 'reporting'").withColumn("train", F.lit(True))
    fit = conformal.fit_scores(u, "dem", COVARIATES, [0.15, 0.85], SCOPE).toPandas().set_index(KEYS)
    rows = u.toPandas().set_index(KEYS).join(fit)
    rng = np.random.default_rng(0)
    for _, part in rows.groupby(level=0):
        x = part[COVARIATES].to_numpy(float)
        x = np.column_stack([np.ones(len(x)), np.nan_to_num(x - np.nanmean(x, axis=0))])
        x = x / np.maximum(np.abs(x).max(axis=0), 1e-12)
        w, y = part.last_election_results_dem.to_numpy(), part.residuals_dem.to_numpy()
        for k, tau in enumerate((0.15, 0.85)):
            loss = lambda p: (w * np.maximum(tau * (y - p), (tau - 1) * (y - p))).sum()  # noqa: B023, E731
            at = part[f"q_{k}"].to_numpy()
            best = loss(at)
            for size in (1e-4, 1e-2):
                assert all(loss(at + x @ (size * rng.standard_normal(x.shape[1]))) >= best * (1 - 1e-6) for _ in range(60))


def test_covariate_outliers_report_and_are_few(frames):
    roles = frames["q_unit_roles"]
    on = {tuple(x) for x in roles[roles.role == "reporting"][KEYS].itertuples(index=False)}
    odd = {tuple(x) for x in frames["q_outlier_rule_covariates"][KEYS].itertuples(index=False)}
    assert odd and odd < on and len(odd) < 0.1 * len(on)


def test_bootstrap_intervals_hold_their_predictions(frames):
    u, bounds = frames["q_bootstrap_units"].set_index(KEYS), frames["q_nonreporting_bounds"].set_index(KEYS)
    j = u.join(bounds)
    assert len(j) == len(u) > 0 and (j["lower_0.7_margin"] <= j["upper_0.7_margin"]).all()
    assert ((j.pred_margin / j.pred_turnout).between(j.y_lower - 1e-3, j.y_upper + 1e-3) | (j.pred_turnout.abs() < 1e-9)).mean() > 0.99
    s = frames["q_bootstrap_state"]
    assert (s["lower_0.7_margin"] < s.pred_margin).all() and (s["upper_0.7_margin"] > s.pred_margin).all() and s.pred_margin.abs().max() <= 1
    n = frames["q_bootstrap_national"]
    assert (n["lower_0.7"] <= n.agg_pred).all() and (n.agg_pred <= n["upper_0.7"]).all()


def test_bootstrap_is_repeatable(spark, frames):
    again = QUERIES["q_bootstrap_state"](spark, DATA).toPandas()
    order = ["election_id", "postal_code"]
    a, b = (f.sort_values(order).reset_index(drop=True) for f in (frames["q_bootstrap_state"], again))
    assert (a[["lower_0.7_margin", "upper_0.7_margin", "pred_margin"]] - b[["lower_0.7_margin", "upper_0.7_margin", "pred_margin"]]).abs().max().max() < 1e-9


def test_grid_levels_stay_near_the_readings(spark):
    """Where a period holds readings its smoothed level lies within three deviations of their mean nearly always, and gaps are less sure."""
    from countflow.operators.spikes import readings

    g = QUERIES["p4_grid"](spark, DATA).toPandas()
    r = readings(spark, DATA).filter("last_modified <= received_at and last_modified >= received_at - interval 2 days and percent_expected_vote between 0 and 105")
    r = r.groupBy("election_id", F.col("unit").alias("geographic_unit_fips"), (F.floor(F.unix_micros("last_modified") / 600e6) * 600).alias("period_start")).agg(F.avg("percent_expected_vote").alias("mean")).toPandas()
    j = g.merge(r, on=[*KEYS, "period_start"], how="inner")
    j = j[j.n_readings > 0]
    off = (j.percent_expected_vote - j["mean"]).abs()
    assert len(j) > 1000 and (off <= 3 * j.percent_expected_vote_sd + 5).mean() > 0.95
    assert (g[g.missing].percent_expected_vote_sd.median() > g[~g.missing].percent_expected_vote_sd.median()) and (g.missing == (g.n_readings == 0)).all()


def test_wrong_values_agree_with_a_plain_rule(spark):
    """Spikes that a plain look at neighbours finds beyond doubt are found, and few values besides the plain rules' are."""
    import numpy as np

    from countflow.operators.spikes import readings

    found = {tuple(x) for x in QUERIES["p2_found"](spark, DATA).toPandas().itertuples(index=False)}
    rows = readings(spark, DATA).filter("last_modified <= received_at and last_modified >= received_at - interval 2 days and election_id is not null and unit is not null").toPandas().sort_values(["election_id", "unit", "last_modified", "row_id"])
    sure = set()
    for _, p in rows.groupby(["election_id", "unit"], sort=False):
        p = p.drop_duplicates(["last_modified", "results_weights", "results_dem", "results_gop"])
        w, ids = p.results_weights.to_numpy(float), p.row_id.to_numpy()
        for i in range(1, len(w) - 1):
            a, b, c = w[i - 1], w[i], w[i + 1]
            if np.isfinite([a, b, c]).all() and a > 100 and abs(c - a) < 0.02 * a and abs(b - a) > 3 * a:
                sure.add((int(ids[i]), "results_weights"))
    assert sure and len(sure & found) >= 0.95 * len(sure)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_bootstrap_queries_draw_as_often_as_the_operator():
    assert catalog._DRAWS.draws == bootstrap.Settings().draws == 500
