"""Command line replays, back-tests over several elections, saving, sources of versions and siblings, and parameters."""

import json
import time

import pytest
from pyspark.sql import functions as F

from countflow import cli, config
from countflow.config import Request
from countflow.functions import common
from countflow.operators import bootstrap, rollup, units, versioned
from countflow.plans.client import Client, HistoricalClient
from countflow.sources import readers, sinks
from tests.test_estimation import contest, frame, tables  # noqa: F401

ALLOWED = {"states": ["A", "B"], "geographic_unit_types": ["county"], "features": [], "aggregates": ["postal_code", "unit"], "fixed_effect": []}


@pytest.fixture
def root(spark, tmp_path, tables):  # noqa: F811
    """A data folder with one election of the present and one of the past."""
    b, _ = tables
    data = b.withColumns({"results_dem": F.round(F.col("baseline_dem") * 1.05), "results_gop": F.round(F.col("baseline_gop") * 0.97), "results_turnout": F.round(F.col("baseline_turnout") * 1.01)})
    for election in ("2024-11-05_XX_G", "2020"):
        sinks.write(data, readers.data_path(str(tmp_path), election, "S", "county"), "csv")
    config.save({"2024-11-05_XX_G": [{"office": "S", "historical_election": ["2020"], **ALLOWED}]}, readers.config_path(str(tmp_path), "2024-11-05_XX_G"))
    return str(tmp_path)


ARGS = ["2024-11-05_XX_G", "--office_id", "S", "--estimands", "turnout", "--aggregates", "postal_code", "unit", "--prediction_intervals", "0.7"]


def test_replay_from_the_command_line(root):
    out = cli.main([*ARGS, "--data_root", root, "--percent_reporting", "60", "--unexpected_units", "3"])
    u = out["unit_data"].toPandas()
    assert (u.results_turnout > 0).sum() == 72 and 60 <= u.reporting.sum() <= 69 and (u.unit_category == "unexpected").sum() == 3 and len(u) == 123
    again = cli.main([*ARGS, "--data_root", root, "--percent_reporting", "60", "--unexpected_units", "3"])["unit_data"].toPandas()
    assert sorted(u.pred_turnout) == sorted(again.pred_turnout)
    with pytest.raises(SystemExit):
        cli.parser().parse_args([*ARGS, "--percent_reporting", "101"])
    assert cli.parser().parse_args([*ARGS, "--fixed_effects", "county_classification"]).fixed_effects == {"county_classification": ["all"]}
    assert cli.parser().parse_args([*ARGS, "--fixed_effects", '{"a": ["b"]}']).fixed_effects == {"a": ["b"]}


def test_past_elections_from_the_command_line(root):
    out = cli.main([*ARGS, "--data_root", root, "--percent_reporting", "60", "--historical"])
    assert set(out) == {"2020_turnout_unit_data", "2020_turnout_state_data"}
    r = sinks.records(out["2020_turnout_unit_data"].drop("level"), "postal_code")
    assert set(r) == {"A", "B", "all"} and r["all"]["n"] >= 110 and r["all"]["mape_turnout"] < 0.01


def test_no_past_elections(spark, tables):  # noqa: F811
    c = contest()
    c.historical_election = []
    with pytest.raises(units.EstimateError, match="no historical elections"):
        HistoricalClient(spark, c).evaluate_all(Request(["turnout"], [0.7]), tables[1], lambda e: (None, None))


def test_outputs_are_saved_where_wanted(spark, tables, tmp_path, monkeypatch):  # noqa: F811
    b, c = tables
    r = Request(["turnout"], [0.7], aggregates=["postal_code", "unit"], save_output=list(config.SAVED), output=str(tmp_path / "o"))
    Client(spark, contest()).get_estimates(r, c, b)
    assert not (tmp_path / "o").exists()
    monkeypatch.setenv("APP_ENV", "production")
    Client(spark, contest()).get_estimates(r, c, b)
    back = spark.read.option("header", True).csv(str(tmp_path / "o/results/unit_data"))
    assert back.count() == 122
    calibration = spark.read.option("header", True).csv(str(tmp_path / "o/turnout/calibration"))
    assert {"measure", "aggregate", "alpha", "lower_score"} <= set(calibration.columns) and calibration.count() > 0
    assert json.loads((tmp_path / "o/config.json").read_text())["office"] == "S"
    assert (tmp_path / "o/data/current_whole_units").exists()
    past = b.withColumns({"results_turnout": F.col("baseline_turnout"), "results_dem": F.col("baseline_dem"), "results_gop": F.col("baseline_gop")})
    HistoricalClient(spark, contest()).evaluate_all(r, c, lambda e: (past, past))
    assert json.loads((tmp_path / "o/evaluation/2020.json").read_text())["turnout"]["state_data"]


@pytest.mark.parametrize("bad", [{"model_parameters": {"lambda_": -1}}, {"model_parameters": {"y_LB": "low"}}, {"model_parameters": {"extrapolate_std_method": "mad"}}, {"save_output": ["all"], "output": "x"}, {"save_output": ["data"]}, {"model_parameters": {"B": True}}])
def test_bad_parameters(bad):
    with pytest.raises(ValueError):
        config.validate(contest(), Request(["turnout"], **bad))


def test_unknown_parameters_are_named():
    assert config.validate(contest(), Request(["turnout"], model_parameters={"lambda": 3})) == ["model parameter lambda is not known"]


def test_small_files_on_any_file_system(spark, tmp_path):
    from countflow.sources import files

    path = f"file://{tmp_path}/deep/er/k.json"
    config.save({"e": [{"office": "S", **ALLOWED}]}, path, spark)
    assert files.exists(spark, path) and not files.exists(spark, path + "x")
    assert config.from_file(path, spark)["e", "S"].states == ["A", "B"]
    sinks.write_json(spark, {"a": "Größe"}, path)
    assert json.loads(files.read_text(spark, path)) == {"a": "Größe"}


def test_bounds_reach_the_bootstrap(spark, tables):  # noqa: F811
    b, c = tables
    narrow = {"B": 30, "lambda_": 0.1, "z_unobserved_lower_bound": 0.99, "z_unobserved_upper_bound": 1.01, "y_unobserved_lower_bound": -0.01, "y_unobserved_upper_bound": 0.01, "percent_expected_vote_error_bound": 0.4}
    r = Request(["margin"], [0.7], aggregates=["unit"], pi_method="bootstrap", model_parameters=narrow)
    u = Client(spark, contest()).get_estimates(r, c.withColumn("percent_expected_vote", F.when(F.col("percent_expected_vote") < 100, 10.0).otherwise(F.col("percent_expected_vote"))), b)["unit_data"].filter("reporting = 0 and unit_category = 'expected'").toPandas()
    assert (abs(u.pred_margin) <= 0.0102 * u.pred_turnout + 1e-6).all() and len(u) > 20


def test_versions_from_files(spark, tmp_path):
    for k in range(5):
        frame(spark, ["geographic_unit_fips", "postal_code", "dem"], [("01.0", "A", float(k))]).coalesce(1).write.mode("append").option("header", True).csv(str(tmp_path / "v"))
        time.sleep(1.1)
    rows = readers.versions(spark, readers.version_files(spark, str(tmp_path / "v"), 2)).collect()
    assert sorted(r.results_dem for r in rows) == [0.0, 2.0, 4.0] and {r.geographic_unit_fips for r in rows} == {"01"} and len({r.last_modified for r in rows}) == 3


def test_anchoring_follows_the_sibling(spark, tables):  # noqa: F811
    b, c = tables
    predictions = b.select("postal_code", "geographic_unit_fips", (F.col("baseline_turnout") * 0.2).alias("pred_margin"), F.col("baseline_turnout").alias("pred_turnout"))
    sib = readers.sibling(b, c, predictions)
    open_ = frame(spark, ["geographic_unit_fips", "results_normalized_margin", "baseline_normalized_margin"], [("000", 0.1, 0.0), ("7_001", 0.3, 0.0), ("none", 0.1, 0.0)])
    got = {r.geographic_unit_fips: r.pred_anchored for r in bootstrap.anchor(open_, sib).collect()}
    now = {r.geographic_unit_fips: r.results_margin / r.results_weights for r in sib.collect()}
    assert got["000"] == pytest.approx(0.2 + 0.1 - now["000"]) and got["7_001"] == pytest.approx(0.2 + 0.3 - now["001"]) and got["none"] is None
    plain = Client(spark, contest()).get_estimates(Request(["margin"], [0.7], aggregates=["unit"], pi_method="bootstrap", model_parameters={"B": 30, "lambda_": 0.1}), c, b, sibling=sib)
    assert plain["unit_data"].filter("pred_margin is not null").count() > 100


def test_versions_between_two_times(spark):
    v = frame(spark, ["geographic_unit_fips", "s"], [("1", 10), ("1", 20), ("1", 30)]).withColumn("last_modified", F.timestamp_seconds("s"))
    assert [versioned.between(v, *span).count() for span in ((None, None), ("1970-01-01 00:00:20", None), (None, "1970-01-01 00:00:20"), ("1970-01-01 00:00:11", "1970-01-01 00:00:29"))] == [3, 2, 2, 1]


def test_district_contests(spark):
    rows = [("A", "1", str(i)) for i in range(12)] + [("A", "2", str(i)) for i in range(3)] + [("B", "9", str(i)) for i in range(20)] + [("A", None, "x")]
    got = rollup.district_contests(frame(spark, ["postal_code", "district", "geographic_unit_fips"], rows)).collect()
    assert [(r.postal_code, r.district, r.n) for r in got] == [("A", "1", 12)]


def test_checkpoints_need_a_shared_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_sources_hold_no_unchecked_broadcast_and_no_local_checkpoint():
    import pathlib

    root = pathlib.Path(common.__file__).parent.parent
    for path in root.rglob("*.py"):
        text = path.read_text()
        assert "localCheckpoint" not in text.replace("no `localCheckpoint`", "")
        if path.name not in ("common.py", "chunks.py"):
            assert "broadcast(" not in text, path


def test_district_elections(spark, tables):  # noqa: F811
    b, c = tables
    number = F.col("geographic_unit_fips").cast("int")
    district = F.when(F.col("postal_code") == "A", F.when(number % 3 == 0, "1").otherwise("2")).otherwise("9")
    b = b.withColumn("district", district)
    k = contest()
    k.office, k.aggregates = "H", ["postal_code", "district", "unit"]
    r = Request(["margin"], [0.7], pi_method="bootstrap", model_parameters={"B": 30, "lambda_": 0.1})
    out = Client(spark, k).get_estimates(r, c, b)
    d = out["district_data"].toPandas()
    assert {tuple(x) for x in d[["postal_code", "district"]].itertuples(index=False)} >= {("A", "1"), ("A", "2"), ("B", "9")}
    assert (d["lower_0.7_margin"] < d.pred_margin).all() and (d["upper_0.7_margin"] > d.pred_margin).all()


def test_checkpoints_are_cleared(spark, tmp_path):
    before = common.shared_dir(spark)
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        common.cut(spark.range(5))
        folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        import os

        assert os.path.exists(folder)
        common.clear(spark)
        assert not os.path.exists(folder) and common.cut(spark.range(5)).count() == 5
    finally:
        spark.sparkContext.setCheckpointDir(before.rsplit("/", 1)[0])


def test_bootstrap_fits_effects_and_separate_states(spark, tables):  # noqa: F811
    """Counties of one class swing far to one side; only a fit with the class as an effect follows them."""
    b, c = tables
    hot = F.col("geographic_unit_fips").cast("int") % 3 == 0
    shift = F.when(hot, 0.25).otherwise(0.0) * (F.col("results_dem") + F.col("results_gop"))
    c = c.withColumns({"results_dem": F.col("results_dem") + F.round(shift), "results_gop": F.greatest(F.col("results_gop") - F.round(shift), F.lit(0.0))})
    early = c.withColumn("percent_expected_vote", F.when(F.col("percent_expected_vote") < 100, 10.0).otherwise(F.col("percent_expected_vote")))
    base = b.select("geographic_unit_fips", ((F.col("baseline_dem") - F.col("baseline_gop")) / (F.col("baseline_dem") + F.col("baseline_gop"))).alias("base"))

    def gap(**asked):
        p = {"B": 40, "lambda_": 0.0001, "strata": ["county_fips_one"], "fit_margin_outlier_model": False, "fit_turnout_outlier_model": False, **asked.pop("model_parameters", {})}
        r = Request(["margin"], [0.7], aggregates=["unit"], pi_method="bootstrap", model_parameters=p, **asked)
        u = Client(spark, contest()).get_estimates(r, early, b.withColumn("county_fips_one", F.lit("x")))["unit_data"].filter("reporting = 0 and unit_category = 'expected'").join(base, "geographic_unit_fips")
        lead = u.withColumn("moved", F.col("pred_margin") / F.col("pred_turnout") - F.col("base")).withColumn("hot", hot)
        m = {x.hot: x.m for x in lead.groupBy("hot").agg(F.avg("moved").alias("m")).collect()}
        return m[True] - m[False]

    plain, fitted = gap(), gap(fixed_effects={"county_classification": "all"})
    assert fitted > 0.35 and plain < 0.2
    own = gap(fixed_effects={"county_classification": ["x"]}, model_parameters={"states_for_separate_model": ["A", "Q"]})
    assert own > 0.35
