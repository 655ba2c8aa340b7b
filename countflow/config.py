"""Election configuration: lookup of what a contest allows, and validation of a request against it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from countflow.sources import files

#: Roll-ups by office and their order, and what a request may name.
AGGREGATE_ORDER = ["postal_code", "district", "county_classification", "county_fips", "unit"]
DISTRICT_OFFICES = ("H", "Y", "Z")
SAVED = ("results", "data", "config", "conformalization")
METHODS = ("nonparametric", "gaussian", "bootstrap")
UNREPORTING = ("drop", "zero")


def default_aggregates(office: str) -> list[str]:
    return ["postal_code", "district", "unit"] if is_district(office) else ["postal_code", "unit"]


def is_district(office: str) -> bool:
    return office[:1] in DISTRICT_OFFICES


def expand(aggregate: str, office: str) -> list[str]:
    """The key list of one roll-up: its state (and district, in district elections) and itself."""
    keys = ["postal_code", *(["district"] if is_district(office) else []), aggregate]
    return [k for k in AGGREGATE_ORDER if k in keys]


@dataclass
class Contest:
    """One contest of an election as configured."""

    election_id: str
    office: str
    states: list[str] = field(default_factory=list)
    geographic_unit_types: list[str] = field(default_factory=list)
    historical_election: list[str] = field(default_factory=list)
    features: list[str] = field(default_factory=list)
    aggregates: list[str] = field(default_factory=list)
    fixed_effect: list[str] = field(default_factory=list)
    baseline_results_year: int | None = None
    baseline_pointer: dict[str, str] = field(default_factory=dict)

    @property
    def general(self) -> bool:
        return self.election_id.endswith("G")

    def measures(self) -> list[str]:
        names = list(self.baseline_pointer) or ["dem", "gop", "turnout"]
        return [*names, *(["margin"] if self.general and "margin" not in names else [])]

    def all_features(self) -> list[str]:
        return [*self.features, *(["baseline_normalized_margin"] if self.general else [])]

    def pointers(self, measures: list[str]) -> dict[str, str]:
        """The baseline that each measure is compared with; the margin always with itself."""
        return {e: e if e == "margin" else self.baseline_pointer.get(e, e) for e in measures}


def from_dict(config: dict) -> dict[tuple[str, str], Contest]:
    """Contests by (election, office) of a nested dictionary {election_id: [ {office, ...} ]}."""
    out = {}
    for election, parts in config.items():
        for p in parts:
            known = {k: v for k, v in p.items() if k in Contest.__dataclass_fields__ and v is not None}
            out[election, p["office"]] = Contest(election_id=election, **{k: v for k, v in known.items() if k != "election_id"})
    return out


def from_file(path: str, spark: SparkSession | None = None) -> dict[tuple[str, str], Contest]:
    """Contests of a JSON file: a local one, or with a session one on any file system."""
    return from_dict(json.loads(files.read_text(spark, path) if spark is not None else Path(path).read_text()))


def save(config: dict, path: str, spark: SparkSession | None = None) -> None:
    if spark is not None:
        return files.write_text(spark, path, json.dumps(config))
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(config))


def from_table(table: DataFrame, election_id: str) -> Contest:
    """A contest from the config table (one row per election)."""
    from pyspark.sql import functions as F

    row = table.filter(F.col("election_id") == election_id).first()
    if row is None:
        raise ValueError(f"no config for {election_id}")
    d = row.asDict()
    d["baseline_pointer"] = json.loads(d.get("baseline_pointer") or "{}")
    return Contest(**{k: v for k, v in d.items() if k in Contest.__dataclass_fields__ and v is not None})


@dataclass
class Request:
    """What an estimate is asked for; the defaults are those of every caller."""

    measures: list[str]
    prediction_intervals: list[float] = field(default_factory=lambda: [0.7, 0.9])
    percent_reporting_threshold: float = 100
    geographic_unit_type: str = "county"
    features: list[str] = field(default_factory=list)
    aggregates: list[str] | None = None
    fixed_effects: dict[str, list[str]] | list[str] = field(default_factory=dict)
    pi_method: str = "nonparametric"
    handle_unreporting: str = "drop"
    lhs_called_contests: list[str] = field(default_factory=list)
    rhs_called_contests: list[str] = field(default_factory=list)
    stop_model_call: list[str] = field(default_factory=list)
    model_parameters: dict = field(default_factory=dict)
    save_output: list[str] = field(default_factory=list)
    output: str | None = None


#: Model parameters with the types they may have (fixed values).
PARAMETERS: dict[str, type | tuple] = {
    "lambda_": (int, float), "robust": bool, "beta": (int, float), "winsorize": bool, "turnout_factor_lower": (int, float), "turnout_factor_upper": (int, float),
    "unit_blocklist": list, "postal_code_blocklist": list, "fit_margin_outlier_model": bool, "fit_turnout_outlier_model": bool, "outlier_z_threshold": (int, float),
    "B": int, "strata": list, "T": (int, float), "agg_model_hard_threshold": bool, "seed": int, "states_for_separate_model": list, "contest_correlations": list,
    "y_LB": (int, float), "y_UB": (int, float), "z_LB": (int, float), "z_UB": (int, float), "y_unobserved_lower_bound": (int, float), "y_unobserved_upper_bound": (int, float),
    "z_unobserved_lower_bound": (int, float), "z_unobserved_upper_bound": (int, float), "percent_expected_vote_error_bound": (int, float),
    "extrapolate_threshold": (int, float), "min_extrapolating_units": int, "max_dist_to_observed": (int, float), "extrapolate_std_method": str,
}


def validate(contest: Contest, r: Request) -> list[str]:
    """Raises ValueError where a request names what the contest lacks; returns warnings (unknown measures and parameters)."""

    def check(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(what)

    effects = list(r.fixed_effects)
    check(r.geographic_unit_type in contest.geographic_unit_types, f"geographic unit type {r.geographic_unit_type} is not valid, use one of {contest.geographic_unit_types}")
    unknown = [f for f in r.features if f not in contest.all_features()]
    check(not unknown, f"features {unknown} are not valid, use some of {contest.all_features()}")
    wrong = [a for a in r.aggregates or [] if a not in contest.aggregates]
    check(not wrong, f"aggregates {wrong} are not valid, use some of {contest.aggregates}")
    wrong = [e for e in effects if e not in contest.fixed_effect]
    check(not wrong, f"fixed effects {wrong} are not valid, use some of {contest.fixed_effect}")
    check(r.pi_method in METHODS, f"interval method {r.pi_method} is not valid, use one of {METHODS}")
    check(r.handle_unreporting in UNREPORTING, f"handle_unreporting {r.handle_unreporting} is not valid, use one of {UNREPORTING}")
    check(all(0 < a < 1 for a in r.prediction_intervals), "prediction intervals lie between 0 and 1")
    for name, value in r.model_parameters.items():
        kind = PARAMETERS.get(name)
        check(kind is None or (isinstance(value, kind) and not (isinstance(value, bool) and kind is not bool)), f"model parameter {name} has the wrong type")
    check(r.model_parameters.get("lambda_") is None or r.model_parameters["lambda_"] >= 0, "lambda_ must not be negative")
    check(r.model_parameters.get("extrapolate_std_method", "std") in ("std", "max_min"), "extrapolate_std_method must be std or max_min")
    check(set(r.save_output) <= set(SAVED), f"save_output {r.save_output} is not valid, use some of {SAVED}")
    check(not r.save_output or r.output is not None, "save_output needs a folder (output)")
    return [f"measure {e} is not configured" for e in r.measures if e not in contest.measures()] + [f"model parameter {p} is not known" for p in r.model_parameters if p not in PARAMETERS]
