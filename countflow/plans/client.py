"""The client: one call from baseline and current tables to result tables."""

from __future__ import annotations

import dataclasses
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countflow import config
from countflow.config import Contest, Request
from countflow.functions.common import bounded, cut
from countflow.operators import bootstrap, conformal, evaluate, features, measures, rollup, units, versioned
from countflow.sources import readers, sinks

LOG = logging.getLogger(__name__)


class Client:
    """Estimates of one contest. Results are lazy tables; only the units table is written once (checkpoint)."""

    def __init__(self, spark: SparkSession, contest: Contest) -> None:
        self.spark, self.contest = spark, contest
        self.calibration: dict[tuple, DataFrame] = {}
        self._summary: tuple | None = None

    # --- units ---

    def _units(self, r: Request, current, baseline) -> DataFrame:
        p = r.model_parameters
        base = readers.baseline(self.spark, baseline, self.contest.states)
        base = measures.add_baselines(units.without_results(base), self.contest.pointers(list(dict.fromkeys([*r.measures, "turnout"]))))
        cur = readers.current(self.spark, current)
        cur, names = measures.add_results(cur, r.measures)
        both = units.combine(base, cur, [n for n in names if n in cur.columns], r.handle_unreporting)
        extra = units.unexpected(cur, both, [a for a in (r.aggregates or []) if a != "unit"], r.geographic_unit_type)
        rules = {"lower": p.get("turnout_factor_lower", 0.5), "upper": p.get("turnout_factor_upper", 2.0), "units_blocked": p.get("unit_blocklist", []), "states_blocked": p.get("postal_code_blocklist", [])}
        out = units.classify(both, r.percent_reporting_threshold, extra, **rules)
        out = cut(out)
        flags = self._outliers(out, r)
        if flags is not None:
            out = out.join(flags, "geographic_unit_fips", "left")
            odd = F.col("_odd").isNotNull() & (F.col("unit_category") == "expected")
            out = out.withColumns({"role": F.when(odd, units.UNEXPECTED).otherwise(F.col("role")), "reporting": F.when(odd, 0).otherwise(F.col("reporting")), "unit_category": F.when(odd, F.col("_odd")).otherwise(F.col("unit_category"))}).drop("_odd")
        for e in r.measures:
            if f"last_election_results_{e}" in out.columns:
                out = measures.add_residual(out, e)
        return cut(out)

    def _outliers(self, u: DataFrame, r: Request) -> DataFrame | None:
        """Reporting units that a weighted median fit on the covariates and states finds strange (turnout first, then the margin)."""
        p, z = r.model_parameters, r.model_parameters.get("outlier_z_threshold", 2.0)
        tests = [("turnout_factor", units.STRANGE_TURNOUT)] if p.get("fit_turnout_outlier_model", True) else []
        if "margin" in r.measures and p.get("fit_margin_outlier_model", True):
            tests.append(("_margin_change", units.STRANGE_MARGIN))
        on = u.filter("role = 'reporting'")
        if not tests or on.count() <= 20:
            return None
        if len(tests) > 1:
            on = on.withColumn("_margin_change", F.col("results_normalized_margin") - F.col("baseline_normalized_margin"))
        covariates = [c for c in ("median_household_income", "percent_bachelor_or_higher", "age_le_30", "ethnicity_group_a", "baseline_normalized_margin", "race_black_or_african_american", "ethnicity_likely_african_american", "education_bachelors_or_higher") if c in on.columns]
        found = None
        for k, (value, name) in enumerate(tests):
            rows = on.withColumns({"residuals_o": F.col(value), "last_election_results_o": F.col("baseline_weights"), "train": F.lit(True)})
            fit = conformal.fit_scores(rows, "o", covariates, [0.5], [], effects=["postal_code"] if "postal_code" in on.columns else [])
            rows = rows.join(fit, "geographic_unit_fips")
            hit = rows.withColumn("_f", units.residual_outliers(rows, value, "q_0", z)).filter("_f").select("geographic_unit_fips", F.lit(k).alias("_rank"), F.lit(name).alias("_odd"))
            found = hit if found is None else found.unionByName(hit)
        return found.groupBy("geographic_unit_fips").agg(F.min_by("_odd", "_rank").alias("_odd"))

    # --- estimates ---

    def get_estimates(self, r: Request, current, baseline, versions: DataFrame | None = None, sibling: DataFrame | None = None) -> dict[str, DataFrame]:
        """Result tables: unit_data and one per roll-up (state_data, district_data, ...).

        current and baseline: a path, a frame or rows with a header. versions: versioned
        results for extrapolation; sibling: a sibling contest's predictions (bootstrap only).
        """
        for warning in config.validate(self.contest, r):
            LOG.warning(warning)
        aggregates = r.aggregates or config.default_aggregates(self.contest.office)
        u = self._units(r, current, baseline)
        units.check_unique(u)
        # Units that are left out of the model, by reason and state.
        for row in units.ids_by_state(u).collect():
            LOG.info("%s, %s: %s", row.unit_category, row.postal_code, row.units)
        if sinks.wanted(r.save_output, "data"):
            sinks.write_current(readers.read(self.spark, current), f"{r.output}/data")
        for alpha in r.prediction_intervals:
            least = {"nonparametric": lambda a: conformal.nonparametric_minimum(a), "gaussian": lambda a: conformal.gaussian_minimum(), "bootstrap": lambda a: 10}[r.pi_method](alpha)
            units.check_enough(u, least)
        if r.pi_method == "bootstrap":
            return self._kept(self._bootstrap(u, r, aggregates, versions, sibling), r)
        tables: dict[str, list[DataFrame]] = {}
        for e in r.measures:
            for name, df in self._conformal(u, r, e, aggregates).items():
                tables.setdefault(name, []).append(df)
        keys = {name: (["postal_code", "geographic_unit_fips", "reporting"] if name == "unit_data" else [*self._keys(name, aggregates), "reporting"]) for name in tables}
        return self._kept({name: evaluate.merge_measures(dfs, keys[name]) for name, dfs in tables.items()}, r)

    def _kept(self, results: dict[str, DataFrame], r: Request) -> dict[str, DataFrame]:
        """The results, written first where the request and the environment want that."""
        if sinks.wanted(r.save_output, "results"):
            sinks.write_results(results, f"{r.output}/results")
        if sinks.wanted(r.save_output, "conformalization"):
            for (alpha, e), df in self.calibration.items():
                sinks.write_calibration(df, f"{r.output}/{e}", e, "unit", alpha)
        if sinks.wanted(r.save_output, "config"):
            sinks.write_json(self.spark, dataclasses.asdict(self.contest), f"{r.output}/config.json")
        return results

    def _keys(self, name: str, aggregates: list[str]) -> list[str]:
        return next(config.expand(a, self.contest.office) for a in aggregates if a != "unit" and table_name(a) == name)

    def _conformal(self, u: DataFrame, r: Request, e: str, aggregates: list[str]) -> dict[str, DataFrame]:
        x = list(r.features)
        names = x
        if x or r.fixed_effects:
            u, names = features.prepare(u, x, r.fixed_effects, r.model_parameters.get("states_for_separate_model", []), scale=False, intercept=False)
        ridge = float(r.model_parameters.get("lambda_", 0.0))
        if names:
            q = conformal.fit_scores(u.withColumn("train", F.col("role") == units.REPORTING), e, names, [0.5], [], ridge=ridge)
            u = u.join(q.select("geographic_unit_fips", "q_0"), "geographic_unit_fips", "left")
            u = u.withColumn(f"pred_{e}", F.when(F.col("role") == units.NONREPORTING, conformal.to_votes(e, F.col("q_0"))).otherwise(F.col(f"results_{e}"))).drop("q_0")
        else:
            u = conformal.predict_swing(u, e)
        n = u.filter("role = 'reporting'").count()
        ends: list[str] = []
        groups: dict[tuple, list[DataFrame]] = {}
        for alpha in r.prediction_intervals:
            share = conformal.nonparametric_fraction(n, alpha) if r.pi_method == "nonparametric" else conformal.GAUSSIAN_FRACTION
            b = cut(conformal.bounds(u, e, alpha, share, [], names))
            self.calibration[alpha, e] = b.filter("calibration")
            if r.pi_method == "nonparametric":
                i = conformal.nonparametric(b, e, alpha, robust=r.model_parameters.get("robust", False))
            else:
                how = {"winsor": r.model_parameters.get("winsorize", False), "beta": float(r.model_parameters.get("beta", 1.0))}
                i = conformal.gaussian(b, e, alpha, **how)
                for a in aggregates:
                    if a != "unit":
                        keys = config.expand(a, self.contest.office)
                        groups.setdefault(tuple(keys), []).append(conformal.gaussian_aggregate(b, u, e, alpha, keys, **how).drop("level"))
            names_ = [f"lower_{alpha}_{e}", f"upper_{alpha}_{e}"]
            ends += names_
            u = u.join(i.select("geographic_unit_fips", *[F.col(f"`{c}`") for c in names_]), "geographic_unit_fips", "left")
        known = F.col(f"results_{e}")
        is_open = F.col("role") == units.NONREPORTING
        # Names with points cannot be referred to in aggregates, so the ends travel under plain names.
        plain = {c: f"_end{k}" for k, c in enumerate(ends)}
        u = u.withColumnsRenamed(plain)
        u = u.withColumns({p: F.when(is_open, F.col(p)).otherwise(known) for p in plain.values()})
        back = {p: c for c, p in plain.items()}
        out = {"unit_data": u.select("postal_code", "geographic_unit_fips", f"pred_{e}", "reporting", "unit_category", *plain.values(), f"results_{e}").withColumnsRenamed(back)}
        for a in aggregates:
            if a == "unit":
                continue
            keys = config.expand(a, self.contest.office)
            if r.pi_method == "nonparametric":
                out[table_name(a)] = rollup.predictions(u, keys, e, list(plain.values())).withColumnsRenamed(back)
            else:
                df = rollup.predictions(u, keys, e)
                for g in groups[tuple(keys)]:
                    df = df.join(g, keys, "left")
                out[table_name(a)] = df
        return out

    def _bootstrap(self, u: DataFrame, r: Request, aggregates: list[str], versions, sibling) -> dict[str, DataFrame]:
        p = r.model_parameters
        district = config.is_district(self.contest.office)
        contest = ["postal_code"]
        if district:
            # A district is a contest of its own where its state has several and it has more than ten units; else its state is.
            own = rollup.district_contests(u).select("postal_code", "district", F.concat_ws("_", "postal_code", "district").alias("_contest"))
            u = u.join(bounded(own), ["postal_code", "district"], "left").withColumn("_contest", F.coalesce("_contest", "postal_code"))
            contest = ["_contest"]
        s = bootstrap.Settings(
            draws=p.get("B", 500), ridge=p.get("lambda_"), seed=p.get("seed", 0), features=list(dict.fromkeys(["baseline_normalized_margin", *r.features])), strata=p.get("strata", ["county_classification"]), contest=contest, correlations=p.get("contest_correlations", []),
            y_worst=(p.get("y_LB", -0.3), p.get("y_UB", 0.3)), z_worst=(p.get("z_LB", -0.5), p.get("z_UB", 0.5)), y_unobserved=(p.get("y_unobserved_lower_bound", -1.0), p.get("y_unobserved_upper_bound", 1.0)),
            z_unobserved=(p.get("z_unobserved_lower_bound", 0.5), p.get("z_unobserved_upper_bound", 1.5)), percent_error=p.get("percent_expected_vote_error_bound", 0.5))
        states = p.get("states_for_separate_model", [])
        if r.fixed_effects or states:
            modeled, names = features.prepare(u.filter("role <> 'unexpected'"), s.features, r.fixed_effects, states, center=False, scale=False)
            plain = [f"_x{k}" for k in range(len(names))]
            u = cut(u.join(modeled.select("geographic_unit_fips", *[F.col(f"`{n}`").alias(c) for n, c in zip(names, plain)]), "geographic_unit_fips", "left"))
            # The intercept and the states' own margins, which stand first, go without penalty.
            own = sum(f"baseline_normalized_margin_{x}" in names for x in states)
            s = dataclasses.replace(s, features=plain, prepared=True, free=1 + own)
        if versions is not None:
            u = self._extrapolated(u, versions, p)
        if sibling is not None:
            u = bootstrap.anchor(u, sibling, district=district)
        one = u.withColumn("_one", F.lit(1))
        drawn = cut(bootstrap.unit_draws(one, ["_one"], s)).drop("_one")
        u = cut(u.join(drawn.select("geographic_unit_fips", "pred_margin", "pred_turnout"), "geographic_unit_fips", "left"))
        called = {"lhs": r.lhs_called_contests, "rhs": r.rhs_called_contests, "stop": r.stop_model_call}
        out = {}
        is_open = F.col("role") == units.NONREPORTING
        unit = u.select("postal_code", "geographic_unit_fips", F.when(is_open, F.col("pred_margin")).otherwise(F.col("results_margin")).alias("pred_margin"), F.when(is_open, F.col("pred_turnout")).otherwise(F.col("results_weights")).alias("pred_turnout"), "reporting", "unit_category", "results_margin")
        for alpha in r.prediction_intervals:
            lo, hi = f"lower_{alpha}_margin", f"upper_{alpha}_margin"
            i = bootstrap.unit_intervals(drawn, [], alpha, s.draws)
            unit = unit.join(i, "geographic_unit_fips", "left").withColumns({c: F.coalesce(F.col(f"`{c}`"), F.col("results_margin")) for c in (lo, hi)})
        out["unit_data"] = unit
        for a in aggregates:
            if a == "unit":
                continue
            keys = config.expand(a, self.contest.office)
            pred, draws = rollup.normalized_margin(u.filter(~is_open | F.col("pred_margin").isNotNull()), keys), cut(bootstrap.group_draws(u, drawn, [], keys))
            top, calls = bootstrap.top_level(keys), None
            if top:
                name = F.concat_ws("_", *keys)
                pred, draws = cut(pred.withColumn("contest", name)), draws.withColumn("contest", name)
                calls = bootstrap.calls(self.spark, called, {x.contest for x in pred.select("contest").collect()})
                j = pred.join(bounded(calls), "contest", "left")
                pred = j.withColumn("pred_margin", bootstrap.apply_call(F.col("pred_margin"), F.col("call"))).drop("call", "stop")
                self._summary = (pred, draws, calls, s)
                pred = pred.join(rollup.baseline_margin(u, keys), keys, "left")
            for alpha in r.prediction_intervals:
                by = ["contest"] if top else keys
                i = bootstrap.group_intervals(draws, pred.select(*by, "pred_margin"), by, alpha, s.draws, calls)
                pred = pred.join(i.drop("pred_margin"), by, "left")
            out[table_name(a)] = pred.drop("contest")
        return out

    def _extrapolated(self, u: DataFrame, versions: DataFrame, p: dict) -> DataFrame:
        now = u.filter("role <> 'unexpected'")
        stack = versioned.append_current(versions.select("geographic_unit_fips", "last_modified", "results_turnout", "results_dem", "results_gop", "results_weights", "percent_expected_vote", "results_normalized_margin"), now.select("geographic_unit_fips", "results_turnout", "results_dem", "results_gop", "results_weights", "percent_expected_vote", "results_normalized_margin"))
        stack = stack.withColumn("_tie", F.xxhash64(*stack.columns))
        est = versioned.estimate(stack, ["geographic_unit_fips"], "_tie")
        donors = now.filter("role = 'reporting' and geographic_unit_type = 'county'").select("postal_code", "geographic_unit_fips")
        found = versioned.corrections(now.filter("role = 'nonreporting'"), donors, est, threshold=p.get("extrapolate_threshold", 75), least=p.get("min_extrapolating_units", 5), reach=p.get("max_dist_to_observed", 5))
        return versioned.extrapolate(u, found, spread=p.get("extrapolate_std_method", "std"))

    def get_national_summary(self, weights: dict[str, float] | None = None, base: float = 0.0, alphas: list[float] = (0.9,), temperature: float | None = None) -> DataFrame:
        """Weighted contests won per interval level; needs bootstrap estimates with a top-level roll-up first."""
        if self._summary is None:
            raise bootstrap.BootstrapError("estimate first, with method bootstrap and the states as a roll-up")
        pred, draws, calls, s = self._summary
        names = [x.contest for x in pred.select("contest").collect()]
        if weights is not None and set(weights) != set(names):
            raise bootstrap.BootstrapError(f"weights for {len(weights)} contests, but there are {len(names)}")
        w = self.spark.createDataFrame([(n, float(1 if weights is None else weights[n])) for n in names], "contest string, weight double")
        one = pred.withColumn("estimand", F.lit("margin"))
        d = draws.withColumn("estimand", F.lit("margin"))
        out = None
        for a in alphas:
            part = bootstrap.national_summary(one, d, w, ["estimand", "contest"], a, s.draws, base, calls, temperature)
            out = part if out is None else out.join(part.drop("agg_pred"), "estimand")
        return out


def table_name(aggregate: str) -> str:
    return {"postal_code": "state_data", "county_fips": "county_data", "county_classification": "classification_data", "district": "district_data"}[aggregate]


class HistoricalClient(Client):
    """Back-testing: the estimate of a past election with the units that report now, scored against its results."""

    def evaluate(self, r: Request, current, past_baseline: DataFrame, past_results: DataFrame) -> dict[str, dict[str, DataFrame]]:
        """Metrics per measure and table: groups (units by state) and all together."""
        cur = readers.current(self.spark, current)
        past = readers.read(self.spark, past_results)
        need = list(dict.fromkeys([*r.measures, "turnout"]))
        masked = evaluate.mask_history(past.select("postal_code", "geographic_unit_fips", *[f"results_{e}" for e in need]), cur, r.measures, r.percent_reporting_threshold)
        results = self.estimates = self.get_estimates(r, masked, past_baseline)
        aggregates = r.aggregates or config.default_aggregates(self.contest.office)
        base = readers.read(self.spark, past_baseline).drop(*[f"results_{e}" for e in need])
        known = past.select("geographic_unit_fips", *[f"results_{e}" for e in need]).join(base, "geographic_unit_fips")
        out: dict[str, dict[str, DataFrame]] = {}
        for e in r.measures:
            unit_truth = known.select("postal_code", "geographic_unit_fips", F.col(f"results_{e}").alias(f"raw_results_{e}"))
            out[e] = {"unit_data": evaluate.score(results["unit_data"].filter("unit_category = 'expected'"), unit_truth, ["postal_code", "geographic_unit_fips"], ["postal_code"], e, r.prediction_intervals)}
            for a in aggregates:
                if a != "unit":
                    keys = config.expand(a, self.contest.office)
                    out[e][table_name(a)] = evaluate.score(results[table_name(a)], evaluate.truth(known, keys, [e]), keys, [keys[-1]], e, r.prediction_intervals)
        return out

    def evaluate_all(self, r: Request, current, load: Callable[[str], tuple]) -> dict[str, dict]:
        """evaluate() for every past election that the contest names: {election: {"evaluation": ..., "estimates": ...}}.

        load gives (baseline, results) of an election. Where wanted, evaluations are written as JSON.
        """
        if not self.contest.historical_election:
            raise units.EstimateError("no historical elections prepared")
        out = {}
        for election in self.contest.historical_election:
            evaluation = self.evaluate(r, current, *load(election))
            out[election] = {"evaluation": evaluation, "estimates": self.estimates}
            if sinks.wanted(r.save_output, "results"):
                plain = {e: {t: [row.asDict() for row in df.collect()] for t, df in tables.items()} for e, tables in evaluation.items()}
                sinks.write_json(self.spark, plain, f"{r.output}/evaluation/{election}.json")
        return out
