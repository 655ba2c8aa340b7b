"""Golden values and small cases of the estimation operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from countflow import config
from countflow.config import Contest, Request
from countflow.operators import bootstrap, conformal, evaluate, features, measures, ordered, replay, rollup, solvers, units, versioned
from countflow.plans.client import Client, HistoricalClient
from countflow.sources import readers, sinks


def frame(spark, names, rows):
    kinds = []
    for k, n in enumerate(names):
        v = next((r[k] for r in rows if r[k] is not None), 0.0)
        kinds.append(f"{n} " + ("string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "long" if isinstance(v, int) else "double"))
    return spark.createDataFrame(rows, ", ".join(kinds))


@pytest.mark.parametrize("values,weights,want", [([10], [1], 10), ([10, 20], [1, 1], 15), ([1, 2, 3], [5, 1, 1], 1), ([1, 2, 3], [1, 1, 5], 3), ([1, 2, 3, 4], [1, 1, 1, 1], 2.5), ([1, 2, 3, 4], [1, 2, 2, 1], 2.5), ([3, 1, 2], [1, 1, 1], 2), ([1, 2, 3, 4, 5], [0.1, 0.2, 0.3, 0.2, 0.2], 3)])
def test_weighted_median(spark, values, weights, want):
    df = frame(spark, ["i", "v", "w"], [(i, float(v), float(w)) for i, (v, w) in enumerate(zip(values, weights))])
    assert ordered.weighted_median(df, [], "v", "w", ["i"]).first()[0] == pytest.approx(want)


def test_inflate_and_winsorised_deviation(spark):
    df = frame(spark, ["g", "i", "v"], [("a", i, float(v)) for i, v in enumerate([1, 2, 3])])
    assert df.agg(ordered.inflate("v")).first()[0] == pytest.approx(14 / 36)
    v = list(range(40)) + [1000.0]
    df = frame(spark, ["g", "i", "v"], [("a", i, float(x)) for i, x in enumerate(v)])
    assert ordered.winsorized_std(df, ["g"], "v", ["i"]).first()[1] == pytest.approx(solvers.winsorize(v).std(ddof=1))


def test_quantile_regression_golden_and_optimal():
    x = np.array([[1, 1], [1, 1], [1, 1], [1, 2]], float)
    b = solvers.quantile_regression(x, np.array([3.0, 8, 9, 15]), 0.5)
    assert b == pytest.approx([1, 7])
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(300), rng.normal(size=(300, 3))])
    y, w = x @ [1, 2, 0, -1] + rng.standard_t(3, 300), rng.uniform(0.1, 2, 300)
    loss = lambda b, t: (w * np.where(y - x @ b >= 0, t, t - 1) * (y - x @ b)).sum()
    for tau in (0.05, 0.5, 0.9):
        b = solvers.quantile_regression(x, y, tau, w)
        assert all(loss(b, tau) <= loss(b + rng.normal(size=4) * s, tau) + 1e-9 for s in (1e-3, 1e-2, 0.1) for _ in range(50))


def test_quantile_regression_degenerate():
    x = np.column_stack([np.ones(30), np.ones(30), np.repeat([0.0, 1.0], 15)])
    y = np.concatenate([np.zeros(15), np.full(15, 5.0)])
    b = solvers.quantile_regression(x, y, 0.5)
    assert x @ b == pytest.approx(y)
    assert solvers.quantile_regression(x[:0], y[:0], 0.5).tolist() == [0, 0, 0]
    shrunk = solvers.quantile_regression(x, y, 0.5, ridge=1e6)
    assert abs(shrunk[2]) < 0.1


def test_quantile_regression_of_few_units_and_unlike_scales():
    """As many units as columns, nearly dependent: normal equations are singular there although the columns are not."""
    x = np.array([[1.0, 4881.4000000000015, -8.652000000000005, 0.047264999999999974], [1.0, 2616.4000000000015, -11.872000000000003, -0.063835], [1.0, -3115.5999999999985, -5.232000000000003, 0.010564999999999991], [1.0, -6243.5999999999985, 0.6679999999999957, 0.10576499999999997]])
    y, w = np.array([-0.28503937007874014, -0.18783542039355994, -0.2913738019169329, -0.2562551553478141]), np.array([1905.0, 2236.0, 3130.0, 3637.0])
    for tau in ((1 - 0.7) / 2, 0.5, (1 + 0.7) / 2):
        assert x @ solvers.quantile_regression(x, y, tau, w) == pytest.approx(y, abs=1e-9)
    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(40), rng.normal(size=(40, 3))])
    y, w = x @ [1, 2, 0, -1] + rng.standard_t(3, 40), rng.uniform(0.1, 2, 40)
    want = x @ solvers.quantile_regression(x, y, 0.85, w)
    for scale in ([1, 1e10, 1, 1e-8], [1e-9, 1, 1e9, 1]):
        assert (x * scale) @ solvers.quantile_regression(x * scale, y, 0.85, w) == pytest.approx(want, abs=1e-9)


def test_ridge_residuals_and_folds():
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(50), rng.normal(size=(50, 2))])
    y = x @ [1.0, 2.0, 3.0] + rng.normal(size=50) * 0.1
    m = solvers.Ridge(x)
    assert m.fit(y) == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0])
    loo = m.residuals(y, leave_one_out=True)
    keep = np.arange(50) != 7
    b = np.linalg.lstsq(x[keep], y[keep], rcond=None)[0]
    assert loo[7] == pytest.approx(y[7] - x[7] @ b)
    assert solvers.choose_ridge(x, y, np.ones(50)) == solvers.LAMBDAS[0]
    big = solvers.sigma_bound(rng.normal(size=200), 0.9, 2000)
    assert 0.9 < big < 1.3 and math.isnan(solvers.sigma_bound([1.0], 0.9))


def test_levels_of_intervals():
    assert conformal.nonparametric_fraction(200, 0.95) == 0.81
    assert (conformal.nonparametric_minimum(0.7), conformal.nonparametric_minimum(0.9)) == (6, 20)
    assert conformal.gaussian_minimum() == pytest.approx(7.0)
    assert bootstrap.quantile_levels(0.95, 1000) == (0.025, 0.975)


def test_group_predictions_golden(spark):
    rows = [("a", "reporting", 5.0, 0.0, 1), ("a", "reporting", 2.0, 0.0, 1), ("a", "nonreporting", 0.0, 9.0, 0), ("b", "nonreporting", 3.0, 4.0, 0), ("b", "unexpected", 7.0, 0.0, 0), (None, "reporting", 1.0, 0.0, 1), ("c", "nonreporting", None, None, 0)]
    df = frame(spark, ["postal_code", "role", "results_e", "pred_e", "reporting"], rows)
    got = {r.postal_code: (r.pred_e, r.results_e, r.reporting) for r in rollup.predictions(df, ["postal_code"], "e").collect()}
    assert got == {"a": (16.0, 7.0, 2), "b": (11.0, 10.0, 0), "c": (0.0, 0.0, 0)}
    a, b = rollup.known_votes(df, ["postal_code"], "e"), rollup.open_votes(df, ["postal_code"], "e")
    assert {r[0]: r[1] for r in a.collect()} == {"a": 7.0, "b": 7.0} and {r[0]: r[2] for r in b.collect()} == {"a": 9.0, "b": 4.0, "c": 0.0}


def test_holdout_shares(spark):
    rows = [("u1", "a", "expected", 1), ("u2", "b", "expected", 1), ("u3", "c", "expected", 0), ("u4", None, "expected", 0)]
    df = frame(spark, ["geographic_unit_fips", "fe", "unit_category", "reporting"], rows)
    e = features.normalise_effects(["fe"])
    known = features.levels(df, e)
    assert known.reference("fe") == "a" and known.kept("fe") == ["b"] and known.expanded("fe") == ["b", "c"]
    got = {r[0]: r.fe_b for r in features.one_hot(df, e, known, holdout=True).collect()}
    assert got == {"u1": 0.0, "u2": 1.0, "u3": 0.5, "u4": 0.0}
    three = frame(spark, ["geographic_unit_fips", "fe", "unit_category", "reporting"], [*rows, ("u5", "d", "expected", 1)])
    known = features.levels(three, e)
    assert {r[0]: r.fe_d for r in features.one_hot(three, e, known, holdout=True).collect()}["u3"] == pytest.approx(1 / 3)
    assert features.sort_features(["x", "baseline_normalized_margin_A", "intercept"]) == ["intercept", "baseline_normalized_margin_A", "x"]


def test_effects_and_deltas(spark):
    rows = [("u1", "a", 0.5), ("u2", "a", 0.5), ("u3", "b", 0.3), ("u4", "b", 0.8), ("u5", "c", 0.5)]
    df = frame(spark, ["geographic_unit_fips", "c", "r"], rows)
    assert {r[0]: round(r[1], 9) for r in bootstrap.effects(df, "r", ["c"]).collect()} == {"a": 0.5, "b": 0.55, "c": 0.0}
    assert {r[0]: round(r.delta, 9) for r in bootstrap.delta(df, "r", ["c"]).collect()} == {"u1": 0, "u2": 0, "u3": -0.25, "u4": 0.25, "u5": 0.5}


def test_stratum_levels():
    s = bootstrap.Stratum(np.array([-0.1, 0.0, 0.1, 0.2]), (-0.3, 0.3))
    assert s.inverse(np.array([0.0, 0.05, 0.999])).tolist() == [-0.3, -0.3, 0.3]
    assert s.inverse(np.array(0.5)) == pytest.approx(0.1)
    u = s.level(np.array([-0.1, 0.0, 0.1, 0.2, 0.9]) + 1e-6)
    assert (np.diff(u) > 0).all() or u[-1] == bootstrap.TAUS.max()
    assert s.variance() > 0


def test_open_bounds_golden(spark):
    df = frame(spark, ["results_normalized_margin", "turnout_factor", "percent_expected_vote"], [(0.1, 0.8, 75.0), (0.1, 0.8, 40.0), (0.1, 0.8, 100.0), (0.1, 0.0, 60.0), (-0.2, 0.9, 120.0)])
    r = bootstrap.open_bounds(df).collect()
    assert (r[0].y_lower, r[0].y_upper) == pytest.approx((-0.175, 0.325))
    assert (r[0].z_lower, r[0].z_upper) == pytest.approx((0.64, 3.2))
    for x in (r[1], r[2], r[4]):
        assert (x.y_lower, x.y_upper, x.z_lower, x.z_upper) == (-1, 1, 0.5, 1.5)
    assert r[3].z_upper == 1.5


def test_calls(spark):
    with pytest.raises(bootstrap.BootstrapError):
        bootstrap.calls(spark, {"lhs": ["a"], "rhs": ["a"]}, {"a"})
    with pytest.raises(bootstrap.BootstrapError):
        bootstrap.calls(spark, {"lhs": ["z"]}, {"a"})
    p = frame(spark, ["c", "pred_margin", "call"], [("a", -0.2, 1), ("b", 0.3, 0), ("c", 0.3, 1), ("d", -0.1, -1)])
    got = {r.c: r.x for r in p.withColumn("x", bootstrap.apply_call(F.col("pred_margin"), F.col("call"))).collect()}
    assert got == {"a": 0.005, "b": -0.005, "c": 0.3, "d": -0.1}


VERS = ["geographic_unit_fips", "last_modified", "row", "results_turnout", "results_dem", "results_gop", "results_weights", "percent_expected_vote", "results_normalized_margin"]


def versions(spark, rows):
    df = frame(spark, VERS, rows)
    return df.withColumn("last_modified", F.timestamp_seconds("last_modified"))


def test_versioned_lead(spark):
    good = [("u", 1, 1, 50.0, 30.0, 20.0, 50.0, 40.0, 0.2), ("u", 2, 2, 100.0, 50.0, 50.0, 100.0, 80.0, 0.0)]
    out = {r.percent_expected_vote: r for r in versioned.estimate(versions(spark, good), ["geographic_unit_fips"], "row").collect()}
    assert sorted(out) == list(range(81))
    assert out[0].est_margin == 0 and out[20].est_margin == pytest.approx(0.2)
    assert out[60].est_margin == pytest.approx((0.2 * 40 + -0.2 * 20) / 60) and out[60].nearest_observed_vote == 80
    assert out[80].est_margin == 0 and out[80].est_correction == 0
    falls = [("u", 1, 1, 50.0, 30.0, 20.0, 50.0, 40.0, 0.2), ("u", 2, 2, 40.0, 20.0, 20.0, 40.0, 80.0, 0.0)]
    bad = versioned.estimate(versions(spark, falls), ["geographic_unit_fips"], "row").collect()
    assert len(bad) == 101 and {r.error_type for r in bad} == {versioned.NON_MONOTONE} and bad[0].est_margin is None
    swap = [("u", 1, 1, 50.0, 30.0, 20.0, 50.0, 40.0, 0.2), ("u", 2, 2, 50.0, 129.0, -81.0, 48.0, 80.0, 0.0)]
    assert {r.error_type for r in versioned.estimate(versions(spark, swap), ["geographic_unit_fips"], "row").collect()} == {versioned.BATCH}


def test_metrics(spark):
    df = spark.createDataFrame([(10.0, 8.0, 5.0, 12.0), (0.0, 2.0, 1.0, 3.0)], "t double, pred_e double, `lower_0.9_e` double, `upper_0.9_e` double")
    r = df.agg(*evaluate.metrics("e", [0.9], "t")).first()
    assert tuple(r) == (2.0, pytest.approx(0.2), 0.5, pytest.approx(0.7))
    none = df.filter("t = 0").agg(*evaluate.metrics("e", [], "t")).first()
    assert none.mape_e is None


def test_replay(spark):
    df = frame(spark, ["geographic_unit_fips", "postal_code", "results_e", "results_f"], [(f"u{i}", "AB"[i % 2], i, i) for i in range(10)])
    s = replay.shuffled(df, 3, {"postal_code": {"A": 1e9}}, ["u9"])
    order = [r.geographic_unit_fips for r in s.orderBy("place").collect()]
    assert order[0] == "u9" and set(order[1:6]) == {"u0", "u2", "u4", "u6", "u8"}
    out = replay.percent(s, 33.3, ["e"], "up", unexpected=1).collect()
    assert len(out) == 11 and sum(r.percent_expected_vote == 100 for r in out) == 4
    assert all(r.results_e == 0 and r.raw_results_e is not None for r in out if r.percent_expected_vote == 0)
    assert replay.percent_to_n(33.3, 10, "down") == 3


def test_semi_join_keeps_copies(spark):
    a = frame(spark, ["c1", "c2", "c3"], [("x", 1, 1), ("x", 1, 2), ("y", 1, 3)])
    b = frame(spark, ["c1", "c2"], [("x", 1), ("x", 1), ("z", 1)])
    assert sorted(r.c3 for r in units.semi_join(a, b, ["c1", "c2"]).collect()) == [1, 2]


def test_unexpected_ids(spark):
    cur = frame(spark, ["postal_code", "geographic_unit_fips"], [("A", "5_123_9"), ("A", "77"), ("A", None)])
    com = frame(spark, ["geographic_unit_fips"], [("77",)])
    r = units.unexpected(cur, com, ["county_fips", "district"], "precinct-district").collect()
    assert [(x.county_fips, x.district) for x in r] == [("123", "5")]


def test_custom_measure(spark):
    @measures.register("turnout_share_gop")
    def share(df, prefix):
        return df.withColumn(f"{prefix}turnout_share_gop", F.col(f"{prefix}gop") / F.col(f"{prefix}turnout")), [f"{prefix}turnout_share_gop"]

    df = frame(spark, ["results_dem", "results_gop", "results_turnout"], [(3.0, 1.0, 4.0)])
    out, names = measures.add_results(df, ["turnout_share_gop", "margin"])
    assert names == ["results_turnout_share_gop", "results_margin", "results_weights", "results_normalized_margin", "results_turnout"]
    assert (out.first().results_turnout_share_gop, out.first().results_normalized_margin) == (0.25, 0.5)
    with pytest.raises(ValueError):
        measures.add_results(df, ["nothing"])


def contest(general=True):
    return Contest("2024-11-05_XX_G" if general else "2024-11-05_XX_P", "S", ["A", "B"], ["county"], ["2020"], ["median_household_income"], ["postal_code", "county_classification", "county_fips", "unit"], ["county_classification"])


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    base, cur = [], []
    for i in range(120):
        state, cls = "AB"[i % 2], "xyz"[i % 3]
        d, g = int(rng.integers(400, 2000)), int(rng.integers(400, 2000))
        base.append((state, f"{i:03d}", "county", f"{i:03d}", cls, float(rng.normal(50, 10)), float(d), float(g), float(d + g + 20)))
        swing, turn = 0.05 * (state == "A") + rng.normal(0, 0.02), rng.uniform(0.9, 1.1)
        share = min(max(d / (d + g) + swing, 0.05), 0.95)
        pev = 100.0 if i < 80 else float(rng.uniform(10, 95))
        n = (d + g) * turn * pev / 100
        cur.append((state, f"{i:03d}", float(round(n * share)), float(round(n * (1 - share))), float(round(n)), pev))
    cur += [("A", "900", 50.0, 40.0, 95.0, 100.0), ("B", "901", None, None, None, None)]
    b = spark.createDataFrame(base, "postal_code string, geographic_unit_fips string, geographic_unit_type string, county_fips string, county_classification string, median_household_income double, baseline_dem double, baseline_gop double, baseline_turnout double")
    c = spark.createDataFrame(cur, "postal_code string, geographic_unit_fips string, results_dem double, results_gop double, results_turnout double, percent_expected_vote double")
    return b, c


@pytest.mark.parametrize("method,features_,effects", [("nonparametric", [], {}), ("nonparametric", ["median_household_income"], {"county_classification": "all"}), ("gaussian", [], {})])
def test_client_conformal(spark, tables, method, features_, effects):
    b, c = tables
    r = Request(["turnout", "dem"], [0.7], features=features_, fixed_effects=effects, aggregates=["postal_code", "county_classification", "unit"], pi_method=method)
    out = Client(spark, contest()).get_estimates(r, c, b)
    u, s = out["unit_data"].toPandas(), out["state_data"].toPandas()
    assert len(u) == 122 and set(out) == {"unit_data", "state_data", "classification_data"}
    assert {"pred_turnout", "lower_0.7_turnout", "upper_0.7_turnout", "pred_dem", "results_dem"} <= set(u.columns)
    open_ = u[(u.reporting == 0) & (u.unit_category == "expected")]
    assert len(open_) == 40 and (open_.pred_turnout >= open_.results_turnout).all()
    assert s.pred_turnout.sum() == pytest.approx(u.pred_turnout.sum()) and s.reporting.sum() == u.reporting.sum()
    assert (s["lower_0.7_turnout"] <= s["upper_0.7_turnout"]).all()
    assert len(out["classification_data"].toPandas()) == 6


def test_client_bootstrap(spark, tables):
    b, c = tables
    r = Request(["margin"], [0.7, 0.9], aggregates=["postal_code", "county_classification", "unit"], pi_method="bootstrap", model_parameters={"B": 60, "lambda_": 0.1}, lhs_called_contests=["A"])
    cl = Client(spark, contest())
    with pytest.raises(bootstrap.BootstrapError):
        cl.get_national_summary()
    out = cl.get_estimates(r, c, b)
    s = out["state_data"].toPandas().set_index("postal_code")
    assert (s["lower_0.9_margin"] < s["pred_margin"]).all() and (s["upper_0.9_margin"] > s["pred_margin"]).all()
    assert s.loc["A", "pred_margin"] >= 0.005 and s.loc["A", "lower_0.9_margin"] >= 0.005
    again = Client(spark, contest()).get_estimates(r, c, b)["state_data"].toPandas().set_index("postal_code")
    assert again["upper_0.9_margin"].to_dict() == pytest.approx(s["upper_0.9_margin"].to_dict())
    n = cl.get_national_summary({"A": 10, "B": 5}, 3, [0.9]).first()
    assert n["lower_0.9"] <= n.agg_pred <= n["upper_0.9"] and n["lower_0.9"] >= 13
    with pytest.raises(bootstrap.BootstrapError):
        cl.get_national_summary({"A": 10})
    u = out["unit_data"].toPandas()
    assert u["lower_0.7_margin"].notna().sum() == len(u) - u.results_margin.isna().sum()


def test_client_guards(spark, tables):
    b, c = tables
    few = c.withColumn("percent_expected_vote", F.lit(0.0))
    with pytest.raises(units.NotEnoughUnits, match="Currently 0 reporting, need at least 20"):
        Client(spark, contest()).get_estimates(Request(["turnout"], [0.9]), few, b)
    with pytest.raises(units.EstimateError):
        Client(spark, contest()).get_estimates(Request(["turnout"], [0.7]), c, b.unionByName(b.limit(3)))
    with pytest.raises(ValueError):
        Client(spark, contest()).get_estimates(Request(["turnout"], [0.7], pi_method="guess"), c, b)


def test_dropped_units_are_unexpected_and_zeroed_units_stay(spark, tables):
    b, c = tables
    holes = c.withColumns({x: F.when(F.col("geographic_unit_fips") != "005", F.col(x)) for x in ("results_dem", "results_gop", "results_turnout")})
    drop = Client(spark, contest()).get_estimates(Request(["turnout"], [0.7]), holes, b)["unit_data"].toPandas().set_index("geographic_unit_fips")
    assert drop.loc["005", "unit_category"] == "unexpected"
    zero = Client(spark, contest()).get_estimates(Request(["turnout"], [0.7], handle_unreporting="zero"), holes, b)["unit_data"].toPandas().set_index("geographic_unit_fips")
    assert (zero.loc["005", "unit_category"], zero.loc["005", "reporting"]) == ("expected", 0)


def test_back_test(spark, tables):
    b, c = tables
    past = b.select("postal_code", "geographic_unit_fips", (F.col("baseline_dem") * 1.1).alias("results_dem"), F.col("baseline_turnout").alias("results_turnout"), F.col("baseline_gop").alias("results_gop"))
    out = HistoricalClient(spark, contest(False)).evaluate(Request(["dem"], [0.7], aggregates=["postal_code", "unit"]), c, b, past)
    r = sinks.records(out["dem"]["unit_data"].drop("level"), "postal_code")
    assert set(r) == {"A", "B", "all"} and r["all"]["mape_dem"] < 0.02 and r["all"]["n"] == 120
    assert set(sinks.records(out["dem"]["state_data"].drop("level"), "postal_code")) == {"A", "B", "all"}


def test_config():
    c = config.from_dict({"e_G": [{"office": "H", "states": ["A"], "geographic_unit_types": ["county"], "features": ["x"], "aggregates": ["postal_code"], "fixed_effect": [], "baseline_pointer": {"turnout": "turnout", "c1": "dem"}, "__comment": 1}]})["e_G", "H"]
    assert c.measures() == ["turnout", "c1", "margin"] and c.all_features() == ["x", "baseline_normalized_margin"] and c.all_features() == c.all_features()
    assert c.pointers(["c1", "margin"]) == {"c1": "dem", "margin": "margin"}
    assert config.expand("county_fips", "H") == ["postal_code", "district", "county_fips"] and config.expand("postal_code", "S") == ["postal_code"]
    assert config.validate(c, Request(["nothing"])) == ["measure nothing is not configured"]
    for bad in (Request(["c1"], features=["q"]), Request(["c1"], geographic_unit_type="town"), Request(["c1"], aggregates=["unit"]), Request(["c1"], handle_unreporting="keep"), Request(["c1"], model_parameters={"B": "many"})):
        with pytest.raises(ValueError):
            config.validate(c, bad)


def test_files(spark, tmp_path, tables):
    b, _ = tables
    sinks.write(b, str(tmp_path / "b"), "csv")
    back = readers.baseline(spark, str(tmp_path / "b"), ["A"])
    assert back.count() == 60 and back.first().geographic_unit_fips.startswith("0") and dict(back.dtypes)["baseline_dem"] == "double"
    rows = readers.current(spark, [["postal_code", "geographic_unit_fips", "results_dem", "percent_expected_vote", "other"], ["A", "01", "5", 100, None], ["A", "02", float("nan"), None, 3]])
    assert rows.columns == ["postal_code", "geographic_unit_fips", "results_dem", "percent_expected_vote"] and [r.results_dem for r in rows.collect()] == [5.0, None]
    sinks.write_current(frame(spark, ["geographic_unit_fips"], [("1",), ("1_2",), ("23_1",)]), str(tmp_path / "o"), "parquet")
    assert spark.read.parquet(str(tmp_path / "o/current_whole_units")).count() == 2
    v = frame(spark, ["geographic_unit_fips", "dem", "last_modified"], [("01.0", 1.0, 5), (" 2.3 ", 2.0, 50)]).withColumn("last_modified", F.timestamp_seconds("last_modified"))
    out = readers.versions(spark, v, "1970-01-01 00:00:01", "1970-01-01 00:00:40").collect()
    assert [(r.geographic_unit_fips, r.results_dem) for r in out] == [("01", 1.0)]


def test_streams(spark, tmp_path):
    from countflow.streaming import latest

    folder = tmp_path / "in"
    rows = [[("u", 10, 1), ("u", 10, 1), ("v", 5, 7)], [("u", 700, 2)], [("w", 90000, 3)]]
    for k, part in enumerate(rows):
        df = frame(spark, ["unit", "last_modified", "x"], part).withColumn("last_modified", F.timestamp_seconds("last_modified"))
        df.coalesce(1).write.mode("append").parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    s = latest.stream(spark, str(folder), schema)
    latest.run_available(s, latest.upsert_latest(str(tmp_path / "state"), ["unit"]), str(tmp_path / "c1"))
    state = str(tmp_path / "state")
    assert {(r.unit, r.x) for r in latest.read_latest(spark, state).collect()} == {("u", 2), ("v", 7), ("w", 3)}
    # A batch that is run again changes nothing; later rows with earlier times neither; old versions go.
    sink = latest.upsert_latest(state, ["unit"])
    late = frame(spark, ["unit", "last_modified", "x"], [("u", 3, 99), ("z", 3, 5)]).withColumn("last_modified", F.timestamp_seconds("last_modified"))
    for _ in range(2):
        sink(late, 3)
        assert {(r.unit, r.x) for r in latest.read_latest(spark, state).collect()} == {("u", 2), ("v", 7), ("w", 3), ("z", 5)}
    for n in range(4, 8):
        sink(late, n)
    assert all(len(list(b.iterdir())) <= 2 for b in (tmp_path / "state/rows").glob("bucket=*")) and latest.read_latest(spark, str(tmp_path / "none")) is None
    got = []
    h = latest.history(latest.without_copies(latest.stream(spark, str(folder), schema), ["unit"], late="1 minute"), ["unit"], ["x"], late=None)
    latest.run_available(h, lambda df, n: got.extend(df.collect()), str(tmp_path / "c2"))
    assert {(r.unit, r.n_readings, r.x) for r in got} == {("u", 1, 1), ("v", 1, 7), ("u", 1, 2)}


def test_command_line(spark, tmp_path, tables):
    from countflow import cli

    b, c = tables
    b.write.parquet(str(tmp_path / "b.parquet"))
    c.write.parquet(str(tmp_path / "c.parquet"))
    k = contest()
    config.save({k.election_id: [{"office": "S", "states": ["A", "B"], "geographic_unit_types": ["county"], "features": [], "aggregates": ["postal_code", "unit"], "fixed_effect": []}]}, str(tmp_path / "k.json"))
    out = cli.main([k.election_id, "--config", str(tmp_path / "k.json"), "--office_id", "S", "--baseline", str(tmp_path / "b.parquet"), "--current", str(tmp_path / "c.parquet"), "--estimands", "turnout", "--prediction_intervals", "0.7", "--output", str(tmp_path / "out")])
    assert set(out) == {"unit_data", "state_data"} and (tmp_path / "out/state_data").exists()
