"""Command line: estimates, replays, national summary and back-tests over files."""

from __future__ import annotations

import argparse
import ast
import json
import logging

from pyspark.sql import DataFrame

from countflow import config
from countflow.config import Request
from countflow.functions import common
from countflow.operators import replay
from countflow.plans.client import Client, HistoricalClient
from countflow.sources import readers, sinks


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("countflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="countflow", description=__doc__)
    p.add_argument("election_id")
    p.add_argument("--office_id", required=True)
    p.add_argument("--data_root", help="folder with {election}/{office}/data_{unit type}.csv and config/{election}.json; stands in for the files below")
    p.add_argument("--config", help="JSON file of contests")
    p.add_argument("--baseline", help="baseline table; without --current its results are replayed")
    p.add_argument("--current", help="current table")
    p.add_argument("--versions", help="versioned results, for extrapolation (bootstrap)")
    p.add_argument("--version_files", help="folder of snapshots, one file each, in place of --versions")
    p.add_argument("--sibling", nargs=3, metavar=("BASELINE", "RESULTS", "PREDICTIONS"), help="a sibling contest, for anchoring (bootstrap)")
    p.add_argument("--estimands", nargs="+", default=["turnout"])
    p.add_argument("--features", nargs="*", default=[])
    p.add_argument("--aggregates", nargs="*", default=None)
    p.add_argument("--fixed_effects", type=_effects, default={}, help="a dictionary, or one name with all its levels")
    p.add_argument("--pi_method", choices=config.METHODS, default="nonparametric")
    p.add_argument("--prediction_intervals", nargs="+", type=float, default=[0.7, 0.9])
    p.add_argument("--percent_reporting_threshold", type=float, default=100)
    p.add_argument("--percent_reporting", type=int, choices=range(101), metavar="0..100", default=100, help="share of the units that report, when results are replayed")
    p.add_argument("--unexpected_units", type=int, default=0, help="unexpected units among those replayed")
    p.add_argument("--seed", type=int, default=0, help="order of the replay")
    p.add_argument("--geographic_unit_type", default="county", choices=("county", "precinct", "county-district", "precinct-district"))
    p.add_argument("--handle_unreporting", choices=config.UNREPORTING, default="drop")
    p.add_argument("--model_parameters", type=ast.literal_eval, default={})
    p.add_argument("--lhs_called_contests", nargs="*", default=[])
    p.add_argument("--rhs_called_contests", nargs="*", default=[])
    p.add_argument("--stop_model_call", nargs="*", default=[])
    p.add_argument("--national_summary", action="store_true")
    p.add_argument("--historical", action="store_true", help="score the past elections that the contest names (needs --data_root)")
    p.add_argument("--save_output", nargs="*", default=[], choices=config.SAVED)
    p.add_argument("--output", help="folder for what is saved; result tables always go there if it is named without --save_output")
    return p


def _effects(text: str) -> dict:
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return {text: ["all"]}


def replayed(baseline: DataFrame, a: argparse.Namespace) -> DataFrame:
    """The results in the baseline as a current table in which a share of the units reports."""
    held = [e for e in dict.fromkeys([*a.estimands, "turnout"]) if f"results_{e}" in baseline.columns]
    order = replay.shuffled(baseline, a.seed)
    return replay.percent(order, a.percent_reporting, held, unexpected=0 if a.historical else a.unexpected_units, all_columns=True).drop("place")


def main(argv: list[str] | None = None) -> dict:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = _session()
    contest = config.from_file(a.config or readers.config_path(a.data_root, a.election_id), spark)[a.election_id, a.office_id]
    r = Request(a.estimands, a.prediction_intervals, a.percent_reporting_threshold, a.geographic_unit_type, a.features, a.aggregates, a.fixed_effects, a.pi_method, a.handle_unreporting, a.lhs_called_contests, a.rhs_called_contests, a.stop_model_call, a.model_parameters, a.save_output, a.output)

    def past(election: str) -> DataFrame:
        return readers.read(spark, readers.data_path(a.data_root, election, a.office_id, a.geographic_unit_type))

    baseline = readers.read(spark, a.baseline) if a.baseline else past(a.election_id)
    current = a.current or replayed(readers.baseline(spark, baseline, contest.states), a)
    if a.historical:
        client = HistoricalClient(spark, contest)
        found = client.evaluate_all(r, current, lambda election: (past(election),) * 2)
        out = {f"{election}_{e}_{t}": df for election, parts in found.items() for e, tables in parts["evaluation"].items() for t, df in tables.items()}
    else:
        client = Client(spark, contest)
        versions = readers.versions(spark, a.versions) if a.versions else readers.versions(spark, readers.version_files(spark, a.version_files)) if a.version_files else None
        sibling = readers.sibling(readers.read(spark, a.sibling[0]), readers.read(spark, a.sibling[1]), readers.past_predictions(spark, a.sibling[2])) if a.sibling else None
        out = client.get_estimates(r, current, baseline, versions, sibling)
        if a.national_summary:
            out["nat_sum_data"] = client.get_national_summary(alphas=a.prediction_intervals)
    for name, df in out.items():
        print(name)
        df.show(truncate=False)
    if a.output and not a.save_output:
        sinks.write_results(out, a.output)
    return out


def run() -> None:
    """main() in a session of its own, which leaves no checkpoints behind."""
    main()
    common.clear(_session())


if __name__ == "__main__":
    run()
