"""Registered queries of the estimation operators and their SQL."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countflow.functions.common import bounded, cut, repaired_id, table
from countflow.functions.nulls import half_even
from countflow.operators import bootstrap, conformal, evaluate, features, measures, ordered, replay, rollup, units, versioned
from countflow.plans import sql, views
from countflow.sources import sinks
from countflow.plans.views import COVARIATES, RESULTS, SCOPE, THRESHOLD

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEYS = ["election_id", "postal_code", "geographic_unit_fips"]


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _classified(spark, d, **rules) -> DataFrame:
    return measures.add_residual(views.classified(spark, d, **rules), "dem")


def _units(spark, d) -> DataFrame:
    """The classified units, written once: models read them many times, and they are few beside the loads."""
    return cut(_classified(spark, d))


def _predicted(spark, d, known: DataFrame | None = None) -> DataFrame:
    return conformal.predict_swing(known if known is not None else _units(spark, d), "dem", SCOPE)


# --- combining and classifying ---


@query("q_minimum_slice", sql.rollup("election_id, postal_code", "postal_code is not null"))
def minimum_slice(spark, d):
    return rollup.predictions(_predicted(spark, d), ["election_id", "postal_code"], "dem")


@query("q_units_combined", f"{sql.VIEWS} select {sql.K}, results_dem, results_gop, results_turnout, percent_expected_vote, round(turnout_factor, 6) as turnout_factor from comb")
def units_combined(spark, d):
    return views.combined(spark, d).select(*KEYS, *RESULTS, "percent_expected_vote", r("turnout_factor").alias("turnout_factor"))


@query("q_unreporting_zero", f"""{sql.VIEWS} select {sql.K}, coalesce(results_dem, 0) as results_dem, coalesce(results_gop, 0) as results_gop, coalesce(results_turnout, 0) as results_turnout,
 case when results_dem is null or results_gop is null or results_turnout is null then 0 else percent_expected_vote end as percent_expected_vote from lefted""")
def unreporting_zero(spark, d):
    return views.combined(spark, d, "zero").select(*KEYS, *RESULTS, "percent_expected_vote")


@query("q_unit_roles", f"{sql.UNITS} select {sql.K}, role, unit_category, reporting from roles")
def unit_roles(spark, d):
    return views.classified(spark, d).select(*KEYS, "role", "unit_category", "reporting")


@query("q_unexpected_units", f"{sql.UNITS} select {sql.K}, county_fips, district, results_turnout from unex")
def unexpected_units(spark, d):
    cur, _ = measures.add_results(views.current(spark, d), ["dem", "margin"])
    return units.unexpected(cur, views.combined(spark, d), ["county_fips", "district"], "county", SCOPE).select(*KEYS, "county_fips", "district", "results_turnout")


_BLOCKED = "postal_code in ('ZA', 'QC') or geographic_unit_fips in ('39601', '25140')"


@query("q_non_modeled_priority", f"{sql.UNITS} select {sql.K}, case when {_BLOCKED} then 'non-modeled: blocklisted' else {sql.CATEGORY} end as unit_category from comb where {_BLOCKED} or {sql.CATEGORY} is not null")
def non_modeled_priority(spark, d):
    rule = units.category(THRESHOLD, units_blocked=["39601", "25140"], states_blocked=["ZA", "QC"])
    return views.combined(spark, d).withColumn("unit_category", rule).filter("unit_category is not null").select(*KEYS, "unit_category")


@query("q_outlier_rule_intercept", f"""{sql.UNITS}, x as (select r.*, m.med from roles r join {sql.wmedian("(select * from roles where role = 'reporting')", "election_id", "turnout_factor", "baseline_weights", "med")} m using (election_id) where role = 'reporting'),
 y as (select *, abs(turnout_factor - med) as off from x)
 select {sql.K} from (select *, off > avg(off) over w + 2.0 * stddev_pop(off) over w and count(off) over w > 20 as flag from y window w as (partition by election_id)) where flag""")
def outlier_rule(spark, d):
    u = views.classified(spark, d).filter("role = 'reporting'")
    med = ordered.weighted_median(u, SCOPE, "turnout_factor", "baseline_weights", ["geographic_unit_fips"], "med")
    u = u.join(bounded(med), SCOPE)
    return u.withColumn("flag", units.residual_outliers(u, "turnout_factor", "med", 2.0, SCOPE)).filter("flag").select(*KEYS)


@query("q_outlier_rule_covariates")
def outlier_rule_covariates(spark, d):
    u = views.classified(spark, d).filter("role = 'reporting'").withColumns({"residuals_tf": F.col("turnout_factor"), "last_election_results_tf": F.col("baseline_weights"), "train": F.lit(True)})
    fit = conformal.fit_scores(u, "tf", [*COVARIATES, "baseline_normalized_margin"], [0.5], SCOPE, effects=["postal_code"])
    u = u.join(fit, [*SCOPE, "geographic_unit_fips"])
    return u.withColumn("flag", units.residual_outliers(u, "turnout_factor", "q_0", 2.0, SCOPE)).filter("flag").select(*KEYS)


@query("q_semi_join", "select c_custkey, c_nationkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def semi_join(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return units.semi_join(table(spark, d, "customer"), o, ["c_custkey"]).select("c_custkey", "c_nationkey")


@query("q_state_filter", f"with {sql.BASE} select postal_code, count(*) as n from base where postal_code in ('ZA', 'QC', 'XG') group by 1")
def state_filter(spark, d):
    return units.in_states(views.baseline(spark, d), ["ZA", "QC", "XG"]).groupBy("postal_code").agg(F.count(F.lit(1)).alias("n"))


@query("q_id_parse", f"with {sql.BASE} select geographic_unit_fips, case when geographic_unit_type like '%district%' and contains(geographic_unit_fips, '_') then split_part(geographic_unit_fips, '_', 2) else split_part(geographic_unit_fips, '_', 1) end as county, split_part(geographic_unit_fips, '_', 1) as district_part from base")
def id_parse(spark, d):
    return views.baseline(spark, d).select("geographic_unit_fips", units.county_of(F.col("geographic_unit_type")).alias("county"), units.id_part(0).alias("district_part"))


@query("q_duplicate_units", f"select l.election_id, {sql.U} as geographic_unit_fips, count(*) as n from current_loads join load_register l using (load_id) where geographic_unit_fips is not null group by 1, 2, load_id having count(*) > 1")
def duplicate_units(spark, d):
    c = table(spark, d, "current_loads").join(table(spark, d, "load_register").select("load_id", "election_id"), "load_id").withColumn("geographic_unit_fips", repaired_id("geographic_unit_fips"))
    return units.duplicates(c.filter("geographic_unit_fips is not null"), ["election_id", "load_id"]).drop("load_id")


@query("q_unit_ids_by_state", f"{sql.UNITS} select election_id, unit_category, postal_code, string_agg(geographic_unit_fips, ',' order by geographic_unit_fips) as units from roles where unit_category not in ('expected', 'unexpected') group by 1, 2, 3")
def unit_ids_by_state(spark, d):
    return units.ids_by_state(views.classified(spark, d), SCOPE)


@query("q_whole_units", f"with {sql.CUR} select election_id, geographic_unit_fips from cur where not contains(geographic_unit_fips, '_') or starts_with(geographic_unit_fips, '23') or starts_with(geographic_unit_fips, '31')")
def whole_units(spark, d):
    return sinks.whole_units(views.current(spark, d)).select("election_id", "geographic_unit_fips")


# --- measures ---


@query("q_estimand_margin", f"{sql.VIEWS} select {sql.K}, results_weights, results_margin, round(results_normalized_margin, 6) as results_normalized_margin, round(baseline_normalized_margin, 6) as baseline_normalized_margin from comb")
def estimand_margin(spark, d):
    return views.combined(spark, d).select(*KEYS, "results_weights", "results_margin", r("results_normalized_margin").alias("results_normalized_margin"), r("baseline_normalized_margin").alias("baseline_normalized_margin"))


@query("q_vote_share", f"{sql.VIEWS} select {sql.K}, round(case when results_dem = 0 and results_turnout = 0 then 0 when results_turnout = 0 then null else results_dem / results_turnout end, 6) as results_party_vote_share_dem from comb")
def vote_share(spark, d):
    df, _ = measures.share_dem(views.combined(spark, d), "results_")
    return df.select(*KEYS, r("results_party_vote_share_dem").alias("results_party_vote_share_dem"))


@query("q_residuals", f"{sql.UNITS} select {sql.K}, last_election_results_dem, round(residuals_dem, 6) as residuals_dem from roles where role = 'reporting'")
def residuals(spark, d):
    return _classified(spark, d).filter("role = 'reporting'").select(*KEYS, "last_election_results_dem", r("residuals_dem").alias("residuals_dem"))


# --- roll-ups ---

for _name, _by, _where in (("state", "election_id, postal_code", "postal_code is not null"), ("county", "election_id, postal_code, county_fips", "postal_code is not null and county_fips is not null"), ("class", "election_id, postal_code, county_classification", "postal_code is not null and county_classification is not null and role <> 'unexpected'"), ("district", "election_id, postal_code, district", "postal_code is not null and district is not null")):
    QUERIES[f"q_aggregate_predictions_{_name}"] = lambda spark, d, by=_by: rollup.predictions(_predicted(spark, d), by.split(", "), "dem")
    SQL[f"q_aggregate_predictions_{_name}"] = sql.rollup(_by, _where)


@query("q_reporting_votes", f"{sql.UNITS} select election_id, postal_code, coalesce(sum(results_dem), 0.0) as results_dem, cast(sum(reporting) as bigint) as reporting from roles where postal_code is not null and role <> 'nonreporting' group by 1, 2")
def reporting_votes(spark, d):
    return rollup.known_votes(_classified(spark, d), ["election_id", "postal_code"], "dem")


@query("q_nonreporting_votes", f"{sql.PRED} select election_id, postal_code, coalesce(sum(results_dem), 0.0) as results_dem, coalesce(sum(pred_dem), 0.0) as pred_dem from pred where postal_code is not null and role = 'nonreporting' group by 1, 2")
def nonreporting_votes(spark, d):
    return rollup.open_votes(_predicted(spark, d), ["election_id", "postal_code"], "dem")


_LEVELS = ["postal_code", "county_classification", "district"]
_ALL = " union all ".join(f"select election_id, '{k}' as level, {k} as key, coalesce(sum(case when role = 'nonreporting' then pred_dem else results_dem end), 0.0) as pred_dem, cast(sum(reporting) as bigint) as reporting, count(*) as units from pred where {k} is not null group by election_id, {k}" for k in _LEVELS)


@query("q_rollup_grouping_sets", f"{sql.PRED} {_ALL} union all select election_id, 'all', 'all', coalesce(sum(case when role = 'nonreporting' then pred_dem else results_dem end), 0.0), cast(sum(reporting) as bigint), count(*) from pred group by 1")
def grouping_sets(spark, d):
    return rollup.all_levels(_predicted(spark, d), SCOPE, _LEVELS, "dem")


@query("q_contests_with_units", f"{sql.UNITS} select election_id, postal_code, district, n from (select *, count(*) over (partition by election_id, postal_code) as m from (select election_id, postal_code, district, count(*) as n from roles where postal_code is not null and district is not null group by 1, 2, 3)) where m > 1 and n > 1")
def contests_with_units(spark, d):
    return rollup.district_contests(_classified(spark, d), SCOPE, least=1)


@query("q_truth_rollup", f"with {sql.BASE}, {sql.EXPECTED} select election_id, county_classification, sum(true_dem) as raw_results_dem, sum(true_turnout) as raw_results_turnout from expected where county_classification is not null group by 1, 2")
def truth_rollup(spark, d):
    e = views.expected(spark, d).filter("county_classification is not null")
    return evaluate.truth(e, ["election_id", "county_classification"], ["dem", "turnout"])


@query("q_baseline_margin_state", f"{sql.UNITS} select election_id, postal_code, round((sum(baseline_dem) - sum(baseline_gop)) / (sum(baseline_turnout) + 1), 6) as baseline_margin from roles where postal_code is not null group by 1, 2")
def baseline_margin_state(spark, d):
    return rollup.baseline_margin(_classified(spark, d), ["election_id", "postal_code"]).withColumn("baseline_margin", r("baseline_margin"))


# --- ordered sets ---

_REP = "(select * from roles where role = 'reporting')"


@query("q_weighted_median_by_group", f"{sql.UNITS} select election_id, county_classification, round(weighted_median, 6) as weighted_median from {sql.wmedian(_REP + ' q', 'election_id, county_classification', 'residuals_dem', 'last_election_results_dem', 'weighted_median')}")
def weighted_median_by_group(spark, d):
    u = _classified(spark, d).filter("role = 'reporting'")
    return ordered.weighted_median(u, ["election_id", "county_classification"], "residuals_dem", "last_election_results_dem", ["geographic_unit_fips"]).withColumn("weighted_median", r("weighted_median"))


@query("q_var_inflate", f"{sql.UNITS} select election_id, county_classification, round(sum(last_election_results_dem * last_election_results_dem) / pow(sum(last_election_results_dem), 2), 8) as var_inflate from roles where role = 'reporting' group by 1, 2")
def var_inflate(spark, d):
    return _classified(spark, d).filter("role = 'reporting'").groupBy("election_id", "county_classification").agg(r(ordered.inflate("last_election_results_dem"), 8).alias("var_inflate"))


@query("q_winsor_std", f"""{sql.UNITS}, x as (select election_id, residuals_dem as v, row_number() over (partition by election_id order by residuals_dem, geographic_unit_fips) as k, count(*) over (partition by election_id) as n from roles where role = 'reporting' and residuals_dem is not null),
 y as (select *, min(case when k > floor(0.05 * n) and k <= n - floor(0.05 * n) then v end) over (partition by election_id) as lo, max(case when k > floor(0.05 * n) and k <= n - floor(0.05 * n) then v end) over (partition by election_id) as hi from x)
 select election_id, round(stddev_samp(greatest(least(v, hi), lo)), 6) as winsorized_std from y group by 1""")
def winsor_std(spark, d):
    u = _classified(spark, d).filter("role = 'reporting'")
    return ordered.winsorized_std(u, SCOPE, "residuals_dem", ["geographic_unit_fips"]).withColumn("winsorized_std", r("winsorized_std"))


@query("q_population_correction", f"""{sql.UNITS} select election_id, round(min(case when c > 0.8 * t then v end), 6) as correction from (select election_id, residuals_dem as v, sum(last_election_results_dem) over (partition by election_id order by residuals_dem, geographic_unit_fips rows unbounded preceding) as c,
 sum(last_election_results_dem) over (partition by election_id) as t from roles where role = 'reporting') group by 1""")
def population_correction(spark, d):
    u = _classified(spark, d).filter("role = 'reporting'")
    return ordered.population_correction(u, SCOPE, "residuals_dem", "last_election_results_dem", 0.8, ["geographic_unit_fips"]).withColumn("correction", r("correction"))


@query("q_quantile_linear", f"{sql.UNITS} select election_id, round(quantile_cont(residuals_dem, 0.05), 6) as q05, round(quantile_cont(residuals_dem, 0.9), 6) as q90 from roles where role = 'reporting' group by 1")
def quantile_linear(spark, d):
    u = _classified(spark, d).filter("role = 'reporting'")
    at = [ordered.linear_quantile(u, SCOPE, "residuals_dem", q, ["geographic_unit_fips"], name) for q, name in ((0.05, "q05"), (0.9, "q90"))]
    return at[0].join(at[1], SCOPE).withColumns({c: r(c) for c in ("q05", "q90")})


# --- features ---


@query("q_center_scale", f"{sql.UNITS} select {sql.K}, round((median_household_income - avg(median_household_income) over w) / nullif(stddev_samp(median_household_income) over w, 0), 6) as median_household_income, round((percent_bachelor_or_higher - avg(percent_bachelor_or_higher) over w) / nullif(stddev_samp(percent_bachelor_or_higher) over w, 0), 6) as percent_bachelor_or_higher from roles where role <> 'unexpected' window w as (partition by election_id)")
def center_scale(spark, d):
    u = _classified(spark, d).filter("role <> 'unexpected'")
    x = COVARIATES[:2]
    return features.center_scale(u, x, scope=SCOPE).select(*KEYS, *[r(c).alias(c) for c in x])


_CLASSES = ("central", "far_south", "lakeside", "metro_ring", "river_valley", "uplands")


@query("q_fixed_effects_onehot", f"""{sql.UNITS}, act as (select min(county_classification) as ref from roles where unit_category = 'expected' and reporting = 1 and county_classification is not null)
 select {sql.K}, county_classification as level, cast(case when county_classification = ref then 0 else 1 end as double) as dummies_set from roles, act where role <> 'unexpected' and county_classification is not null""")
def fixed_effects_onehot(spark, d):
    u = _classified(spark, d).filter("role <> 'unexpected'")
    e = features.normalise_effects(["county_classification"])
    known = features.levels(u, e)
    out = features.one_hot(u, e, known)
    names = [f"county_classification_{v}" for v in known.expanded("county_classification")]
    total = sum((F.col(c) for c in names), F.lit(0.0))
    return out.filter("county_classification is not null").select(*KEYS, F.col("county_classification").alias("level"), total.alias("dummies_set"))


@query("q_selective_fe", f"{sql.UNITS} select {sql.K}, case when county_classification in ('central', 'uplands') then county_classification when county_classification is not null then 'other' end as effect from roles where role <> 'unexpected'")
def selective_fe(spark, d):
    u = _classified(spark, d).filter("role <> 'unexpected'")
    return u.select(*KEYS, features.recode("county_classification", ["central", "uplands"]).alias("effect"))


@query("q_holdout_fe", f"""{sql.UNITS}, x as (select r.*, case when county_classification = 'uplands' and reporting = 1 then 'non-modeled' else unit_category end as uc from roles r where role <> 'unexpected'),
 act as (select election_id, list(distinct county_classification) as a from x where uc = 'expected' and reporting = 1 and county_classification is not null group by 1),
 y as (select x.*, coalesce(a, []) as a, list_min(a) as ref from x left join act using (election_id))
 select {sql.K}, round(case when county_classification is null or len(a) = 0 then 0.0 when not list_contains(a, county_classification) then (len(a) - 1.0) / len(a) when county_classification = ref then 0.0 else 1.0 end, 6) as dummies_sum from y""")
def holdout_fe(spark, d):
    u = _classified(spark, d).filter("role <> 'unexpected'")
    # No reporting upland unit takes part in the fit, so that level is held out.
    u = u.withColumn("unit_category", F.when((F.col("county_classification") == "uplands") & (F.col("reporting") == 1), "non-modeled").otherwise(F.col("unit_category")))
    e = features.normalise_effects(["county_classification"])
    known = features.levels(u, e)
    out = features.one_hot_by_scope(u, e, known, SCOPE)
    total = sum((F.col(f"county_classification_{v}") for v in known.active["county_classification"]), F.lit(0.0))
    return out.select(*KEYS, r(total).alias("dummies_sum"))


@query("q_separate_state", f"{sql.UNITS} select {sql.K}, case when postal_code = 'ZA' then 0.0 else age_le_30 end as age_le_30, case when postal_code = 'ZA' then age_le_30 else 0.0 end as age_le_30_ZA from roles where role <> 'unexpected'")
def separate_state(spark, d):
    out, _ = features.separate_states(_classified(spark, d).filter("role <> 'unexpected'"), ["age_le_30"], ["ZA"])
    return out.select(*KEYS, "age_le_30", "age_le_30_ZA")


@query("q_ols_normal_equations", f"""{sql.UNITS}, n as (select election_id, sum(w) as s, sum(w * x) as sx, sum(w * x * x) as sxx, sum(w * y) as sy, sum(w * x * y) as sxy from (select election_id, baseline_weights as w, baseline_normalized_margin as x, results_normalized_margin as y from roles where role = 'reporting') group by 1)
 select election_id, round((s * sxy - sx * sy) / nullif(s * sxx - sx * sx, 0), 5) as slope, round((sy - (s * sxy - sx * sy) / nullif(s * sxx - sx * sx, 0) * sx) / s, 5) as intercept from n""")
def ols_normal_equations(spark, d):
    u = _classified(spark, d).filter("role = 'reporting'")
    out = bootstrap.coefficients(u, "results_normalized_margin", ["baseline_normalized_margin"], "baseline_weights", SCOPE)
    return out.select("election_id", r("baseline_normalized_margin", 5).alias("slope"), r("intercept", 5).alias("intercept"))


@query("q_prepared_features", f"""{sql.UNITS}, z as (select r.*, (select count(*) from roles where reporting = 1 and postal_code = 'ZA') > 0 as own from roles r where role <> 'unexpected'),
 x as (select *, case when own and postal_code = 'ZA' then 0.0::double else age_le_30 end as a, case when postal_code = 'ZA' then age_le_30 else 0.0::double end as b from z)
 select {sql.K}, case when postal_code in ('ZA', 'none') then 0.0::double else 1.0::double end as intercept, round((a - avg(a) over ()) / nullif(stddev_samp(a) over (), 0), 6) as age_le_30, case when own then round((b - avg(b) over ()) / nullif(stddev_samp(b) over (), 0), 6) end as age_le_30_ZA from x""")
def prepared_features(spark, d):
    out, names = features.prepare(_units(spark, d).filter("role <> 'unexpected'"), ["age_le_30"], states=["ZA", "none"])
    own = r("age_le_30_ZA") if "age_le_30_ZA" in names else F.lit(None).cast("double")
    return out.select(*KEYS, "intercept", r("age_le_30").alias("age_le_30"), own.alias("age_le_30_ZA"))


# --- conformal and Gaussian intervals ---

ALPHA = 0.7


def _ends() -> list[Column]:
    """The ends of the unit intervals; names with a point need quotes."""
    return [F.col(f"`{side}_{ALPHA}_dem`").alias(side) for side in ("lower", "upper")]


def _bounds(spark, d, fraction: float = 0.7, x: list[str] = (), known: DataFrame | None = None) -> DataFrame:
    return cut(conformal.bounds(known if known is not None else _units(spark, d), "dem", ALPHA, fraction, SCOPE, list(x)))


_LO, _HI = f"{(1 - ALPHA) / 2!r}::double", f"{(1 + ALPHA) / 2!r}::double"
_ORDER = f"cast('0x' || substr(md5('{conformal.SEED}:' || geographic_unit_fips), 1, 15) as bigint), geographic_unit_fips"
#: The split, the two weighted quantiles of the training residuals, and the scores of the units held back.
_SPLIT = f"""sp as (select *, row_number() over (partition by election_id order by {_ORDER}) <= floor(count(*) over (partition by election_id) * 0.7::double) as train from roles where role = 'reporting'),
 cu as (select election_id, residuals_dem as q, sum(last_election_results_dem) over (partition by election_id order by residuals_dem, geographic_unit_fips rows unbounded preceding) as c, sum(last_election_results_dem) over (partition by election_id) as t from sp where train and residuals_dem is not null and last_election_results_dem is not null),
 qs as (select election_id, min(q) filter (c >= {_LO} * t) as lower_raw, min(q) filter (c >= {_HI} * t) as upper_raw from cu group by 1),
 bd as (select s.*, lower_raw, upper_raw, case when calibration then lower_raw - residuals_dem end as lower_score, case when calibration then residuals_dem - upper_raw end as upper_score
 from (select *, true as calibration from sp where not train union all by name select *, false as calibration from roles where role = 'nonreporting') s left join qs using (election_id)),
 ca as (select *, greatest(lower_score, upper_score) as s, count(*) over (partition by election_id) as n from bd where calibration)"""
_CORRECT = """co as (select election_id, min(case when c > 0.7 * (1 + 1.0 / n) * t then s end) as correction from (select election_id, s, n, sum(last_election_results_dem) over (partition by election_id order by s, geographic_unit_fips rows unbounded preceding) as c, sum(last_election_results_dem) over (partition by election_id) as t from ca where s is not null) group by 1)"""
_PLAIN = """co as (select election_id, greatest(correction, lo + (h - floor(h)) * (hi - lo)) as correction from co0 join (select election_id, max(h) as h, max(case when k = floor(h) then s end) as lo, max(case when k = ceil(h) then s end) as hi from
 (select election_id, s, row_number() over (partition by election_id order by s, geographic_unit_fips) - 1 as k, least(0.7 * (1 + 1.0 / n), 1) * (count(*) over (partition by election_id) - 1) as h from ca where s is not null) group by 1) using (election_id))"""
_ENDS = "case when correction is null then null else round_even(greatest(last_election_results_dem * (lower_raw - correction + 1), results_dem), 0) end as lower, case when correction is null then null else round_even(greatest(last_election_results_dem * (upper_raw + correction + 1), results_dem), 0) end as upper"
_INTERVALS = f"in_ as (select {sql.K}, correction, {_ENDS} from bd left join co using (election_id) where role = 'nonreporting')"


@query("q_conformal_units_intercept", f"{sql.UNITS}, {_SPLIT}, {_CORRECT}, {_INTERVALS} select {sql.K}, round(correction, 6) as correction, lower, upper from in_")
def conformal_units(spark, d):
    return conformal.nonparametric(_bounds(spark, d), "dem", ALPHA, SCOPE).select(*KEYS, r("correction").alias("correction"), *_ends())


@query("q_conformal_robust", f"{sql.UNITS}, {_SPLIT}, {_CORRECT.replace('co as', 'co0 as', 1)}, {_PLAIN}, {_INTERVALS} select {sql.K}, round(correction, 6) as correction, lower, upper from in_")
def conformal_robust(spark, d):
    return conformal.nonparametric(_bounds(spark, d), "dem", ALPHA, SCOPE, robust=True).select(*KEYS, r("correction").alias("correction"), *_ends())


@query("q_calibration_data", f"{sql.UNITS}, {_SPLIT} select {sql.K}, round(lower_raw, 6) as lower_raw, round(upper_raw, 6) as upper_raw, round(lower_score, 6) as lower_score, round(upper_score, 6) as upper_score from bd where calibration")
def calibration_data(spark, d):
    return _bounds(spark, d).filter("calibration").select(*KEYS, *[r(c).alias(c) for c in ("lower_raw", "upper_raw", "lower_score", "upper_score")])


@query("q_conformal_aggregate", f"""{sql.PRED}, {_SPLIT}, {_CORRECT}, {_INTERVALS} select election_id, postal_code, coalesce(sum(case when role = 'nonreporting' then pred_dem else results_dem end), 0.0) as pred_dem, coalesce(sum(results_dem), 0.0) as results_dem, cast(sum(reporting) as bigint) as reporting,
 coalesce(sum(case when role = 'nonreporting' then lower else results_dem end), 0.0) as lower, coalesce(sum(case when role = 'nonreporting' then upper else results_dem end), 0.0) as upper from pred left join in_ using (election_id, postal_code, geographic_unit_fips) where postal_code is not null group by 1, 2""")
def conformal_aggregate(spark, d):
    u = _units(spark, d)
    ends = conformal.nonparametric(_bounds(spark, d, known=u), "dem", ALPHA, SCOPE).select(*KEYS, *_ends())
    return rollup.predictions(_predicted(spark, d, u).join(ends, KEYS, "left"), ["election_id", "postal_code"], "dem", ["lower", "upper"])


def _group_quantile(tau: float, group: str) -> str:
    return f"(select election_id, min(q) filter (c >= {tau!r}::double * t) as v from (select election_id, residuals_dem as q, sum(last_election_results_dem) over (partition by election_id order by residuals_dem, geographic_unit_fips rows unbounded preceding) as c, sum(last_election_results_dem) over (partition by election_id) as t from er where {group}) group by 1)"


#: With one 0/1 feature the fit is saturated: the quantile of either group.
@query("q_quantile_coefficients", f"""{sql.UNITS}, er as (select *, county_classification in ('central', 'uplands') as hot from roles where role = 'reporting' and residuals_dem is not null and county_classification is not null)
 select a.election_id, round(a.v, 6) as intercept, round(b.v - a.v, 6) as hot from {_group_quantile(0.37, "not hot")} a join {_group_quantile(0.37, "hot")} b using (election_id)""")
def quantile_coefficients(spark, d):
    u = _units(spark, d).filter("county_classification is not null").withColumn("hot", F.col("county_classification").isin("central", "uplands").cast("double"))
    both = u.filter("role = 'reporting'").groupBy(*SCOPE).agg(F.count_distinct("hot").alias("k")).filter("k = 2")
    out = conformal.coefficients(u.join(both.select(*SCOPE), SCOPE, "left_semi"), "dem", ["hot"], 0.37, SCOPE)
    return out.select("election_id", r("intercept").alias("intercept"), r("hot").alias("hot"))


@query("q_qr_covariates")
def qr_covariates(spark, d):
    return conformal.nonparametric(_bounds(spark, d, 0.7, COVARIATES), "dem", ALPHA, SCOPE).select(*KEYS, *_ends())


@query("q_gaussian_group_counts", f"{sql.UNITS}, a as (select distinct election_id, postal_code, county_classification from roles where role = 'nonreporting'), b as (select election_id, postal_code, county_classification, count(*) as n from roles where role = 'reporting' group by all) select coalesce(a.election_id, b.election_id) as election_id, coalesce(a.postal_code, b.postal_code) as postal_code, coalesce(a.county_classification, b.county_classification) as county_classification, coalesce(n, 0) as n from a full join b on a.election_id = b.election_id and a.postal_code = b.postal_code and a.county_classification is not distinct from b.county_classification")
def gaussian_group_counts(spark, d):
    return conformal.group_counts(_classified(spark, d), ["postal_code", "county_classification"], SCOPE)


_Z = NormalDist().inv_cdf((3 + ALPHA) / 4)
#: A bounded frame that SQL can rebuild: everything calibrates, raw bounds are fixed rates.
_RAW = """bd as (select *, -0.1 as lower_raw, 0.1 as upper_raw, -0.1 - residuals_dem as lower_score, residuals_dem - 0.1 as upper_score from roles where role in ('reporting', 'nonreporting'))"""
_CAL = "(select * from bd where role = 'reporting')"


def _fixed_bounds(spark, d) -> DataFrame:
    u = _units(spark, d).filter("role in ('reporting', 'nonreporting')").withColumns({"lower_raw": F.lit(-0.1), "upper_raw": F.lit(0.1), "calibration": F.col("role") == "reporting"})
    return u.withColumns({"lower_score": F.when(F.col("calibration"), F.col("lower_raw") - F.col("residuals_dem")), "upper_score": F.when(F.col("calibration"), F.col("residuals_dem") - F.col("upper_raw"))})


@query("q_conformal_units_sql", f"""{sql.UNITS}, {_RAW}, c as (select election_id, min(case when c > 0.7 * (1 + 1.0 / n) * t then s end) as correction from (select election_id, greatest(lower_score, upper_score) as s, count(*) over (partition by election_id) as n, sum(last_election_results_dem) over (partition by election_id order by greatest(lower_score, upper_score), geographic_unit_fips rows unbounded preceding) as c,
 sum(last_election_results_dem) over (partition by election_id) as t from bd where role = 'reporting') group by 1)
 select {sql.K}, round(correction, 6) as correction, case when correction is null then null else round_even(greatest(last_election_results_dem * (lower_raw - correction + 1), results_dem), 0) end as lower, case when correction is null then null else round_even(greatest(last_election_results_dem * (upper_raw + correction + 1), results_dem), 0) end as upper from bd left join c using (election_id) where role = 'nonreporting'""")
def conformal_units_sql(spark, d):
    return conformal.nonparametric(_fixed_bounds(spark, d), "dem", ALPHA, SCOPE).select(*KEYS, r("correction").alias("correction"), *_ends())


def _gauss_sql(by: str) -> str:
    return f"""select a.*, mu_lower, mu_upper from (select {by}, count(*) as n, sum(last_election_results_dem * last_election_results_dem) / pow(sum(last_election_results_dem), 2) as var_inflate, stddev_samp(lower_score) as sigma_lower, stddev_samp(upper_score) as sigma_upper from bd where role = 'reporting' group by {by}) a
 join {sql.wmedian(_CAL + ' q', by, 'lower_score', 'last_election_results_dem', 'mu_lower')} b using ({by}) join {sql.wmedian(_CAL + ' q', by, 'upper_score', 'last_election_results_dem', 'mu_upper')} c using ({by})"""


@query("q_gaussian_bounds_sql", f"""{sql.UNITS}, {_RAW}, m as ({_gauss_sql("election_id")}) select {sql.K},
 round_even(greatest(last_election_results_dem * (lower_raw - (mu_lower + {_Z} * sqrt(var_inflate + 1) * sigma_lower) + 1), results_dem), 0) as lower, round_even(greatest(last_election_results_dem * (upper_raw + (mu_upper + {_Z} * sqrt(var_inflate + 1) * sigma_upper) + 1), results_dem), 0) as upper
 from bd join m using (election_id) where role = 'nonreporting' and sigma_lower is not null""")
def gaussian_bounds(spark, d):
    out = conformal.gaussian(_fixed_bounds(spark, d), "dem", ALPHA, SCOPE, bootstrap=False)
    return out.filter(F.col("sigma_lower").isNotNull()).select(*KEYS, *_ends())


@query("q_gaussian_fallback", f"""{sql.UNITS}, {_RAW}, m2 as ({_gauss_sql("election_id, postal_code, county_classification")}), m1 as ({_gauss_sql("election_id, postal_code")}), m0 as ({_gauss_sql("election_id")}), w as (select distinct election_id, postal_code, county_classification from bd where role = 'nonreporting' and county_classification is not null)
 select w.*, case when m2.n >= 10 then 2 when m1.n >= 10 then 1 when m0.n is not null then 0 end as level, case when m2.n >= 10 then m2.n when m1.n >= 10 then m1.n else m0.n end as n, round(case when m2.n >= 10 then m2.mu_lower when m1.n >= 10 then m1.mu_lower else m0.mu_lower end, 6) as mu_lower, round(case when m2.n >= 10 then m2.sigma_upper when m1.n >= 10 then m1.sigma_upper else m0.sigma_upper end, 6) as sigma_upper
 from w left join m2 using (election_id, postal_code, county_classification) left join m1 on m1.election_id = w.election_id and m1.postal_code = w.postal_code left join m0 on m0.election_id = w.election_id""")
def gaussian_fallback(spark, d):
    b = _fixed_bounds(spark, d)
    want = b.filter("not calibration and county_classification is not null")
    m = conformal.fallback_models(b.filter("calibration"), want, "dem", ALPHA, ["postal_code", "county_classification"], SCOPE, bootstrap=False)
    return m.select("election_id", "postal_code", "county_classification", "level", "n", r("mu_lower").alias("mu_lower"), r("sigma_upper").alias("sigma_upper"))


_SD = "sqrt(ww + var_inflate * w * w)"


@query("q_gaussian_aggregate_sql", f"""{sql.UNITS}, {_RAW}, m1 as ({_gauss_sql("election_id, postal_code")}), m0 as ({_gauss_sql("election_id")}),
 su as (select election_id, postal_code, sum(last_election_results_dem * lower_raw) as lo, sum(last_election_results_dem * upper_raw) as hi, sum(last_election_results_dem) as w, sum(last_election_results_dem * last_election_results_dem) as ww, sum(results_dem) as seen from bd where role = 'nonreporting' and postal_code is not null group by 1, 2),
 mo as (select su.*, case when m1.n >= 10 then 1 when m0.n is not null then 0 end as level, {", ".join(f"case when m1.n >= 10 then m1.{c} else m0.{c} end as {c}" for c in ("var_inflate", "mu_lower", "mu_upper", "sigma_lower", "sigma_upper"))}
 from su left join m1 using (election_id, postal_code) left join m0 on m0.election_id = su.election_id),
 en as (select *, greatest(lo - (w * mu_lower + {_Z} * sigma_lower * {_SD}) + w, seen) as l, greatest(hi + (w * mu_upper + {_Z} * sigma_upper * {_SD}) + w, seen) as u, w * mu_lower + {_Z} * sigma_lower * {_SD} is null as no_l, w * mu_upper + {_Z} * sigma_upper * {_SD} is null as no_u from mo),
 kn as (select election_id, postal_code, sum(results_dem) as known from roles where role <> 'nonreporting' and postal_code is not null group by 1, 2)
 select coalesce(kn.election_id, en.election_id) as election_id, coalesce(kn.postal_code, en.postal_code) as postal_code, round_even(coalesce(known, 0) + coalesce(case when not no_l then l end, 0), 0) as lower, round_even(coalesce(known, 0) + coalesce(case when not no_u then u end, 0), 0) as upper, level
 from kn full join en on kn.election_id = en.election_id and kn.postal_code = en.postal_code""")
def gaussian_aggregate_sql(spark, d):
    u = _classified(spark, d)
    return conformal.gaussian_aggregate(_fixed_bounds(spark, d), u, "dem", ALPHA, ["postal_code"], SCOPE, bootstrap=False).select("election_id", "postal_code", *_ends(), "level")


@query("q_gaussian_full")
def gaussian_full(spark, d):
    u = _units(spark, d)
    return conformal.gaussian_aggregate(_bounds(spark, d, known=u), _predicted(spark, d, u), "dem", ALPHA, ["postal_code"], SCOPE)


@query("q_gaussian_units")
def gaussian_units(spark, d):
    return conformal.gaussian(_bounds(spark, d), "dem", ALPHA, SCOPE).select(*KEYS, *_ends())


# --- bootstrap ---


@query("q_contest_epsilon", f"{sql.UNITS} select election_id, postal_code, round(case when count(residuals_dem) < 2 then 0 else avg(residuals_dem) end, 6) as epsilon from roles where role = 'reporting' group by 1, 2")
def contest_epsilon(spark, d):
    return bootstrap.effects(_classified(spark, d).filter("role = 'reporting'"), "residuals_dem", ["election_id", "postal_code"]).withColumn("epsilon", r("epsilon"))


@query("q_delta", f"{sql.UNITS} select {sql.K}, round(residuals_dem - case when count(residuals_dem) over w < 2 then 0 else avg(residuals_dem) over w end, 6) as delta from roles where role = 'reporting' window w as (partition by election_id, postal_code)")
def delta(spark, d):
    return bootstrap.delta(_classified(spark, d).filter("role = 'reporting'"), "residuals_dem", ["election_id", "postal_code"]).select(*KEYS, r("delta").alias("delta"))


@query("q_nonreporting_bounds", f"""{sql.UNITS}, x as (select *, least(percent_expected_vote, 100) / 100 as f from roles where role = 'nonreporting'), y as (select *, f < 0.5 or abs(f - 1) <= 1.001e-5 as naive, turnout_factor / greatest(f - 0.5, 0.01) as hi from x)
 select {sql.K}, round(case when naive then -1 else f * results_normalized_margin - (1 - f) end, 6) as y_lower, round(case when naive then 1 else f * results_normalized_margin + (1 - f) end, 6) as y_upper, round(case when naive then 0.5 else turnout_factor / (f + 0.5) end, 6) as z_lower, round(case when naive or abs(hi) <= 1e-8 then 1.5 else hi end, 6) as z_upper from y""")
def nonreporting_bounds(spark, d):
    out = bootstrap.open_bounds(_classified(spark, d).filter("role = 'nonreporting'"))
    return out.select(*KEYS, *[r(c).alias(c) for c in ("y_lower", "y_upper", "z_lower", "z_upper")])


_WORST = (-0.3, 0.3)


def _stratum_sql(tau: float, worst: float, name: str) -> str:
    return f"""(select election_id, county_classification, round(min(case when k >= ceil(n * {tau!r}::double - 1e-9) then v end), 6) as {name} from (select election_id, county_classification, v, row_number() over (partition by election_id, county_classification order by v) as k, count(*) over (partition by election_id, county_classification) as n
 from (select election_id, county_classification, v from er union all select distinct election_id, county_classification, {worst}::double from er)) group by 1, 2)"""


@query("q_strata_quantiles", f"""{sql.UNITS}, er as (select election_id, coalesce(county_classification, '') as county_classification, residuals_dem as v from roles where role = 'reporting' and residuals_dem is not null)
 select * from {_stratum_sql(0.2, _WORST[0], "q20")} join {_stratum_sql(0.7, _WORST[1], "q70")} using (election_id, county_classification)""")
def strata_quantiles(spark, d):
    u = _classified(spark, d).filter("role = 'reporting'").fillna("", ["county_classification"])
    out = bootstrap.strata_points(u, "residuals_dem", ["election_id", "county_classification"], [0.2, 0.7], _WORST)
    return out.select("election_id", "county_classification", r("q_0").alias("q20"), r("q_1").alias("q70"))


#: A lead prediction that SQL can rebuild: open units keep their baseline lead at their last turnout.
_SIMPLE = """pm as (select *, case when role = 'nonreporting' then round_even(baseline_normalized_margin * baseline_weights, 0) else results_margin end as pred_margin, case when role = 'nonreporting' then baseline_weights else results_weights end as pred_turnout from roles),
 nm as (select election_id, postal_code, case when sum(pred_turnout) = 0 and sum(pred_margin) = 0 then 0 when sum(pred_turnout) = 0 then null else sum(pred_margin) / sum(pred_turnout) end as pred_margin, case when sum(results_weights) = 0 and sum(results_margin) = 0 then 0 when sum(results_weights) = 0 then null else sum(results_margin) / sum(results_weights) end as results_margin, cast(sum(reporting) as bigint) as reporting, sum(pred_turnout) as pred_turnout from pm where postal_code is not null group by 1, 2)"""


def _leads(spark, d) -> DataFrame:
    u = _classified(spark, d).withColumns({"pred_margin": half_even(F.col("baseline_normalized_margin") * F.col("baseline_weights")), "pred_turnout": F.col("baseline_weights")})
    return rollup.normalized_margin(u, ["election_id", "postal_code"])


@query("q_normalized_margin_state", f"{sql.UNITS}, {_SIMPLE} select election_id, postal_code, round(pred_margin, 6) as pred_margin, round(results_margin, 6) as results_margin, reporting, pred_turnout from nm")
def normalized_margin_state(spark, d):
    return _leads(spark, d).withColumns({"pred_margin": r("pred_margin"), "results_margin": r("results_margin")})


@query("q_called_contests", f"{sql.UNITS}, {_SIMPLE} select election_id, postal_code, round(case when postal_code in ('ZA', 'XG') then greatest(pred_margin, 0.005) when postal_code = 'QC' then least(pred_margin, -0.005) else pred_margin end, 6) as pred_margin from nm")
def called_contests(spark, d):
    c = bootstrap.calls(spark, {"lhs": ["ZA", "XG"], "rhs": ["QC"]}, {"ZA", "XG", "QC"}).withColumnRenamed("contest", "postal_code")
    j = _leads(spark, d).join(bounded(c), "postal_code", "left")
    return j.select("election_id", "postal_code", r(bootstrap.apply_call(F.col("pred_margin"), F.col("call"))).alias("pred_margin"))


_WEIGHTS = f"(select {sql.S} as postal_code, max(nat_sum_weight) as nat_sum_weight from state_weights where removed_at is null group by 1) w"


def _state_weights(spark, d) -> DataFrame:
    return table(spark, d, "state_weights").filter("removed_at is null").groupBy(F.upper(F.trim("postal_code")).alias("postal_code")).agg(F.max("nat_sum_weight").cast("double").alias("weight"))


def _national(spark, d, temperature: float | None = None) -> DataFrame:
    """The summary of the simple leads, which have no draws and so no doubt."""
    w = _state_weights(spark, d)
    leads = _leads(spark, d).join(w, "postal_code", "left_semi")
    none = spark.createDataFrame([], "election_id string, postal_code string, draw int, e1 double, e2 double")
    return bootstrap.national_summary(leads, none, w, ["election_id", "postal_code"], ALPHA, 500, base=3.0, temperature=temperature)


@query("q_national_summary_hard", f"{sql.UNITS}, {_SIMPLE}, g as (select election_id, round_even(sum(case when pred_margin > 0 then nat_sum_weight else 0 end) + 3, 2) as agg_pred from nm join {_WEIGHTS} using (postal_code) group by 1) select election_id, agg_pred, agg_pred as lower, agg_pred as upper from g")
def national_summary_hard(spark, d):
    return _national(spark, d).withColumnsRenamed({f"lower_{ALPHA}": "lower", f"upper_{ALPHA}": "upper"})


@query("q_national_summary_soft", f"{sql.UNITS}, {_SIMPLE} select election_id, round_even(sum(nat_sum_weight / (1 + exp(-50.0 * pred_margin))) + 3, 2) as agg_pred from nm join {_WEIGHTS} using (postal_code) group by 1")
def national_summary_soft(spark, d):
    return _national(spark, d, 50.0).select("election_id", "agg_pred")


@query("q_anchor", f"""{sql.UNITS}, {_SIMPLE}, sb as (select election_id, geographic_unit_fips as key, case when results_weights = 0 and results_margin = 0 then 0 when results_weights = 0 then null else results_margin / results_weights end as now_, case when pred_turnout = 0 and pred_margin = 0 then 0 when pred_turnout = 0 then null else pred_margin / pred_turnout end as then_ from pm where role <> 'unexpected')
 select {", ".join("o." + c for c in KEYS)}, round(then_ + (results_normalized_margin - now_), 6) as pred_anchored from (select *, case when contains(geographic_unit_fips, '_') then split_part(geographic_unit_fips, '_', 2) else geographic_unit_fips end as key from roles where role = 'nonreporting') o left join sb on sb.election_id = o.election_id and sb.key = o.key""")
def anchor(spark, d):
    u = _classified(spark, d)
    open_ = F.col("role") == "nonreporting"
    lead = half_even(F.col("baseline_normalized_margin") * F.col("baseline_weights"))
    sibling = u.filter("role <> 'unexpected'").withColumns({"pred_margin": F.when(open_, lead).otherwise(F.col("results_margin")), "pred_turnout": F.when(open_, F.col("baseline_weights")).otherwise(F.col("results_weights"))})
    return bootstrap.anchor(u.filter(open_), sibling, SCOPE).select(*KEYS, r("pred_anchored").alias("pred_anchored"))


_DRAWS = bootstrap.Settings(ridge=None)


def _drawn(spark, d) -> tuple[DataFrame, DataFrame]:
    u = _units(spark, d)
    return u, cut(bootstrap.unit_draws(u, SCOPE, _DRAWS))


@query("q_bootstrap_units")
def bootstrap_units(spark, d):
    _, drawn = _drawn(spark, d)
    return bootstrap.unit_intervals(drawn, SCOPE, ALPHA, _DRAWS.draws).join(drawn.select("election_id", "geographic_unit_fips", "pred_margin", "pred_turnout"), ["election_id", "geographic_unit_fips"])


def _bootstrap_state(spark, d) -> tuple[DataFrame, DataFrame]:
    u, drawn = _drawn(spark, d)
    p = u.join(drawn.select("election_id", "geographic_unit_fips", "pred_margin", "pred_turnout"), ["election_id", "geographic_unit_fips"], "left")
    return rollup.normalized_margin(p.filter("role <> 'nonreporting' or pred_margin is not null"), ["election_id", "postal_code"]), bootstrap.group_draws(u, drawn, SCOPE, ["postal_code"])


@query("q_bootstrap_state")
def bootstrap_state(spark, d):
    p, g = _bootstrap_state(spark, d)
    return bootstrap.group_intervals(g, p, ["election_id", "postal_code"], ALPHA, _DRAWS.draws)


@query("q_bootstrap_national")
def bootstrap_national(spark, d):
    p, g = _bootstrap_state(spark, d)
    w = p.select("postal_code").distinct().join(table(spark, d, "state_weights").filter("removed_at is null").groupBy("postal_code").agg(F.max("nat_sum_weight").alias("weight")), "postal_code", "left").fillna(1, ["weight"])
    return bootstrap.national_summary(p, g, w, ["election_id", "postal_code"], ALPHA, _DRAWS.draws)


# --- bootstrap: everything after the draws, with draws that SQL can rebuild ---

_N = 20
_QLO, _QHI = (f"{q!r}::double" for q in bootstrap.quantile_levels(ALPHA, _N))
#: Factor on the baseline of each draw: value column, step of the draw number, centre and width.
_STEPS = {"b1": ("baseline_margin", 5, 2.0, 0.05), "b2": ("baseline_margin", 4, 1.5, 0.04), "b3": ("baseline_weights", 3, 1.0, 0.02), "b4": ("baseline_weights", 2, 0.5, 0.03)}
_DRAWN = f"""pm as (select *, baseline_dem - baseline_gop as baseline_margin, case when role = 'nonreporting' then round_even(baseline_normalized_margin * baseline_weights, 0) end as pred_m from roles),
 dr as (select *, {", ".join(f"{c} * (1.0::double + ((k % {m}) - {mid}::double) * {w}::double) as {b}" for b, (c, m, mid, w) in _STEPS.items())} from (select *, unnest(range({_N})) as k from pm where role = 'nonreporting')),
 fx as (select election_id, postal_code, sum(case when role = 'reporting' then baseline_weights * turnout_factor * results_normalized_margin else results_margin end) as m, sum(case when role = 'reporting' then baseline_weights * turnout_factor else results_weights end) as w from pm where role <> 'nonreporting' and postal_code is not null group by 1, 2),
 sm as (select election_id, postal_code, k, sum(b1) as s1, sum(b2) as s2, sum(b3) as s3, sum(b4) as s4 from dr where postal_code is not null group by 1, 2, 3),
 gd as (select election_id, postal_code, k, coalesce((s1 + coalesce(m, 0)) / nullif(s3 + coalesce(w, 0), 0), 0) as e1, coalesce((s2 + coalesce(m, 0)) / nullif(s4 + coalesce(w, 0), 0), 0) as e2 from sm left join fx using (election_id, postal_code))"""


def _made_draws(spark, d) -> tuple[DataFrame, DataFrame]:
    u = _units(spark, d)
    k = F.sequence(F.lit(0), F.lit(_N - 1))
    base = {"baseline_margin": F.col("baseline_dem") - F.col("baseline_gop"), "baseline_weights": F.col("baseline_weights")}

    def factors(c: str, m: int, mid: float, w: float) -> Column:
        return F.transform(k, lambda i: base[c] * (1.0 + (i % m - mid) * w))

    arrays = {b: factors(*step) for b, step in _STEPS.items()}
    drawn = u.filter("role = 'nonreporting'").withColumns(arrays).withColumn("pred_margin", half_even(F.col("baseline_normalized_margin") * F.col("baseline_weights")))
    return u, drawn.select("election_id", "geographic_unit_fips", "pred_margin", *_STEPS)


@query("q_draw_unit_intervals", f"{sql.UNITS}, {_DRAWN} select election_id, geographic_unit_fips, round_even(max(pred_m) - quantile_cont(b1 - b2, {_QHI}), 0) as lower, round_even(max(pred_m) - quantile_cont(b1 - b2, {_QLO}), 0) as upper from dr group by 1, 2")
def draw_unit_intervals(spark, d):
    _, drawn = _made_draws(spark, d)
    return bootstrap.unit_intervals(drawn, SCOPE, ALPHA, _N).withColumnsRenamed({f"lower_{ALPHA}_margin": "lower", f"upper_{ALPHA}_margin": "upper"})


_CALLED = {"lhs": ["ZA"], "rhs": ["XG"], "stop": ["QC"]}
_SPREAD = f"""sp as (select election_id, postal_code, quantile_cont(e1 - e2, {_QLO}) as lo, quantile_cont(e1 - e2, {_QHI}) as hi from gd group by 1, 2),
 iv as (select nm.*, least(pred_margin - coalesce(hi, 0), pred_margin - 0.001) as l, greatest(pred_margin - coalesce(lo, 0), pred_margin + 0.001) as u from nm left join sp using (election_id, postal_code))"""


@query("q_draw_state_intervals", f"""{sql.UNITS}, {_SIMPLE.replace("pm as", "pn as", 1).replace("from pm", "from pn")}, {_DRAWN}, {_SPREAD}, c1 as (select *, case when l < 0 and postal_code = 'ZA' then 0.005 else l end as l1, case when u > 0 and postal_code = 'XG' then -0.005 else u end as u1 from iv)
 select election_id, postal_code, round(case when l1 > 0 and postal_code = 'QC' then -0.005 else l1 end, 6) as lower, round(case when u1 < 0 and postal_code = 'QC' then 0.005 else u1 end, 6) as upper from c1 where pred_margin is not null""")
def draw_state_intervals(spark, d):
    u, drawn = _made_draws(spark, d)
    by = ["election_id", "postal_code"]
    called = bootstrap.calls(spark, _CALLED, {"ZA", "XG", "QC"})
    out = bootstrap.group_intervals(bootstrap.group_draws(u, drawn, SCOPE, ["postal_code"]), _leads(spark, d).filter("pred_margin is not null"), by, ALPHA, _N, called)
    return out.select(*by, r(F.col(f"`lower_{ALPHA}_margin`")).alias("lower"), r(F.col(f"`upper_{ALPHA}_margin`")).alias("upper"))


@query("q_draw_national", f"""{sql.UNITS}, {_SIMPLE.replace("pm as", "pn as", 1).replace("from pm", "from pn")}, {_DRAWN}, sh as (select g.election_id, g.postal_code, avg(case when n.pred_margin - (e1 - e2) > 0 then 1.0 else 0.0 end) as up, avg(case when n.pred_margin - (e1 - e2) < 0 then 1.0 else 0.0 end) as down from gd g join nm n on n.election_id = g.election_id and n.postal_code = g.postal_code group by 1, 2),
 x as (select nm.election_id, nm.pred_margin > 0 as ahead, coalesce(up, case when nm.pred_margin > 0 then 1.0 else 0.0 end) as up, coalesce(down, case when nm.pred_margin > 0 then 0.0 else 1.0 end) as down, nat_sum_weight::double as w, nm.postal_code in ('ZA', 'XG') as called, nm.postal_code = 'QC' as stop from nm join {_WEIGHTS} using (postal_code) left join sh on sh.election_id = nm.election_id and sh.postal_code = nm.postal_code where nm.pred_margin is not null)
 select election_id, round_even(sum(case when ahead then w else 0 end), 2) as agg_pred, round_even(sum(case when ahead then w else 0 end) - sum(case when ahead and (stop or not called and down > {_QLO}) then w else 0 end), 2) as lower, round_even(sum(case when ahead then w else 0 end) + sum(case when not ahead and (stop or not called and up > {_QLO}) then w else 0 end), 2) as upper from x group by 1""")
def draw_national(spark, d):
    u, drawn = _made_draws(spark, d)
    w = _state_weights(spark, d)
    leads = _leads(spark, d).filter("pred_margin is not null").join(w, "postal_code", "left_semi")
    called = bootstrap.calls(spark, _CALLED, {"ZA", "XG", "QC"})
    out = bootstrap.national_summary(leads, bootstrap.group_draws(u, drawn, SCOPE, ["postal_code"]), w, ["election_id", "postal_code"], ALPHA, _N, called=called)
    return out.withColumnsRenamed({f"lower_{ALPHA}": "lower", f"upper_{ALPHA}": "upper"})


# --- versioned results ---

_VKEYS = ["election_id", "unit"]


def _versions(spark, d) -> DataFrame:
    v = table(spark, d, "versioned_results").withColumn("unit", repaired_id("geographic_unit_fips"))
    ok = (F.col("last_modified") <= F.col("received_at")) & (F.col("last_modified") >= F.col("received_at") - F.expr("INTERVAL 2 DAYS"))
    v = v.filter(ok & F.col("unit").isNotNull() & F.col("election_id").isNotNull())
    return v.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("percent_expected_vote", "results_normalized_margin")})


@query("q_versioned_batch_margin", f"with {sql.VERS} select election_id, unit, row_id, round(pct, 6) as pct, round(batch, 6) + 0.0 as batch from vc")
def versioned_batch_margin(spark, d):
    return versioned.courses(_versions(spark, d), _VKEYS, "row_id").select(*_VKEYS, "row_id", r("pct").alias("pct"), r("batch").alias("batch"))


@query("q_versioned_errors", f"with {sql.VERS} select error_type, count(distinct (election_id, unit)) as units, count(*) as versions from vc group by 1")
def versioned_errors(spark, d):
    c = versioned.courses(_versions(spark, d), _VKEYS, "row_id").groupBy(*_VKEYS, "error_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("error_type").agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("versions"))


@query("q_versioned_interpolation", f"with {sql.ESTIMATE} select election_id, unit, p as percent_expected_vote, round(near, 6) as nearest_observed_vote, round(m, 6) + 0.0 as est_margin, round(ln - m, 6) + 0.0 as est_correction, error_type from est union all select election_id, unit, unnest(generate_series(0, 100)), null, null, null, error_type from vc where error_type <> 'none' and k = 1")
def versioned_interpolation(spark, d):
    e = versioned.estimate(_versions(spark, d), _VKEYS, "row_id")
    return e.select(*_VKEYS, "percent_expected_vote", *[r(c).alias(c) for c in ("nearest_observed_vote", "est_margin", "est_correction")], "error_type")


def _donors(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counties of each election whose last percent is at least 90 are donors for those from 40 to 90."""
    b = views.baseline(spark, d).filter("geographic_unit_type = 'county'").select("postal_code", "geographic_unit_fips", "geographic_unit_type")
    v = _versions(spark, d)
    last = v.groupBy("election_id", F.col("unit").alias("geographic_unit_fips")).agg(F.max_by("percent_expected_vote", F.when(F.col("percent_expected_vote").isNotNull(), F.struct("last_modified", "row_id"))).alias("percent_expected_vote"))
    # Few rows that take a pass over all versions: made once.
    u = cut(last.join(b, "geographic_unit_fips"))
    donors = u.filter("percent_expected_vote >= 90").select("election_id", "postal_code", "geographic_unit_fips")
    # Only the courses of donors are interpolated.
    own = v.join(donors.select("election_id", F.col("geographic_unit_fips").alias("unit")), _VKEYS, "left_semi")
    est = versioned.estimate(own, _VKEYS, "row_id").withColumnRenamed("unit", "geographic_unit_fips")
    return u.filter("percent_expected_vote >= 40 and percent_expected_vote < 90"), donors, est


@query("q_extrapolation_stats", f"""with {sql.BASE}, {sql.ESTIMATE}, lastp as (select election_id, unit, arg_max(pp, (last_modified, row_id)) as p from (select election_id, unit, last_modified, row_id, pp from (select election_id, {sql.U} as unit, last_modified, row_id, case when isnan(percent_expected_vote) then null else percent_expected_vote end as pp, received_at from versioned_results where geographic_unit_fips is not null and election_id is not null) where last_modified <= received_at and last_modified >= received_at - interval 2 day) group by 1, 2),
 u as (select l.election_id, b.postal_code, l.unit, l.p from lastp l join base b on b.geographic_unit_fips = l.unit where b.geographic_unit_type = 'county'),
 don as (select * from u where p >= 90), enough as (select election_id, postal_code from don group by 1, 2 having count(*) >= 5),
 todo as (select u.*, cast(round_even(u.p, 0) as bigint) as at from u join enough using (election_id, postal_code) where u.p >= 40 and u.p < 90),
 de as (select don.election_id, don.postal_code, est.p, case when abs(est.p - est.near) < 5 then est.ln - est.m end as c from don join est on est.election_id = don.election_id and est.unit = don.unit)
 select t.election_id, t.postal_code, t.unit as geographic_unit_fips, round(avg(c), 6) as est_correction, round(max(c), 6) as est_correction_max, round(min(c), 6) as est_correction_min, round(stddev_samp(c), 6) as est_correction_std, count(c) as est_correction_count
 from todo t left join de on de.election_id = t.election_id and de.postal_code = t.postal_code and de.p = t.at group by 1, 2, 3""")
def extrapolation_stats(spark, d):
    todo, donors, est = _donors(spark, d)
    out = versioned.corrections(todo, donors, est, SCOPE, threshold=40.0)
    names = ["est_correction", "est_correction_max", "est_correction_min", "est_correction_std"]
    return out.select(*KEYS, *[r(c).alias(c) for c in names], "est_correction_count")


@query("q_extrapolation", f"""{SQL["q_extrapolation_stats"].split(" select t.election_id")[0]}, st as (select t.election_id, t.postal_code, t.unit as geographic_unit_fips, t.at as pc, avg(c) as m, max(c) - min(c) as s from todo t left join de on de.election_id = t.election_id and de.postal_code = t.postal_code and de.p = t.at group by all)
 select election_id, postal_code, geographic_unit_fips, round(pc / 100.0 + m, 6) as pred_extrapolate, round(s, 6) as pred_extrapolate_std from st""")
def extrapolation(spark, d):
    todo, donors, est = _donors(spark, d)
    found = versioned.corrections(todo, donors, est, SCOPE, threshold=40.0)
    # The lead so far is known here by the percent alone, so that SQL can rebuild it.
    lead = todo.withColumn("results_normalized_margin", F.bround("percent_expected_vote", 0) / 100.0)
    out = versioned.extrapolate(lead.join(found.select(*KEYS), KEYS, "left_semi"), found, SCOPE, spread="max_min")
    return out.select(*KEYS, r("pred_extrapolate").alias("pred_extrapolate"), r("pred_extrapolate_std").alias("pred_extrapolate_std"))


@query("q_append_current", f"""with {sql.CUR}, v as (select election_id, last_modified from versioned_results where election_id is not null and last_modified is not null), l as (select election_id, max(last_modified) + interval 1 second as last_modified from v group by 1),
 s as (select election_id, last_modified from v union all select cur.election_id, l.last_modified from cur join l using (election_id)) select election_id, count(*) as n, epoch_us(max(last_modified)) as last_us from s group by 1""")
def append_current(spark, d):
    v = table(spark, d, "versioned_results").filter("election_id is not null and last_modified is not null").select("election_id", "geographic_unit_fips", "last_modified")
    s = versioned.append_current(v, views.current(spark, d).select("election_id", "geographic_unit_fips"), SCOPE)
    return s.groupBy("election_id").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.max("last_modified")).alias("last_us"))


_SPAN = ("2012-01-01 00:00:00", "2020-12-31 23:59:59")


@query("q_versions_between", f"select election_id, count(*) as n from versioned_results where last_modified >= timestamp '{_SPAN[0]}' and last_modified <= timestamp '{_SPAN[1]}' and last_modified is not null and election_id is not null group by 1")
def versions_between(spark, d):
    v = versioned.between(table(spark, d, "versioned_results"), *_SPAN)
    return v.filter("election_id is not null").groupBy("election_id").agg(F.count(F.lit(1)).alias("n"))


@query("q_version_thinning", "select snapshot_id, election_id from (select *, dense_rank() over (partition by election_id order by taken_at) as k from snapshot_register) where (k - 1) % 2 = 0")
def version_thinning(spark, d):
    return versioned.thin(table(spark, d, "snapshot_register"), 2, ["election_id"], "taken_at").select("snapshot_id", "election_id")


# --- replay and evaluation ---


def _truth(spark, d) -> DataFrame:
    b = views.baseline(spark, d).filter("results_dem is not null")
    loads = table(spark, d, "load_register").select("election_id").distinct()
    states = table(spark, d, "election_config").select("election_id", F.explode("states").alias("postal_code")).join(loads, "election_id", "left_semi").distinct()
    return states.join(b, "postal_code").select(*KEYS, *RESULTS)


@query("q_historical_mask", f"with {sql.BASE}, {sql.CUR}, {sql.EXPECTED} select e.election_id, e.postal_code, e.geographic_unit_fips, c.percent_expected_vote, case when coalesce(c.percent_expected_vote >= 60, false) then true_dem else 0 end as results_dem from expected e join cur c using (election_id, postal_code, geographic_unit_fips) where true_dem is not null")
def historical_mask(spark, d):
    out = evaluate.mask_history(_truth(spark, d), views.current(spark, d), ["dem"], THRESHOLD, SCOPE)
    return out.select(*KEYS, "percent_expected_vote", "results_dem")


_EVAL = f"""{sql.PRED}, ev as (select election_id, postal_code, county_classification, true_dem as t, pred_dem as p, 0.9 * pred_dem as lo, 1.2 * pred_dem as hi from pred where role <> 'unexpected' and true_dem is not null and pred_dem is not null)"""
_METRICS = "count(*) as n, round(avg(abs(t - p)), 4) as mae_dem, round(avg(case when t <> 0 then abs((t - p) / t) end), 6) as mape_dem, round(avg(case when lo <= t and t <= hi then 1.0 else 0.0 end), 6) as frac_within_pi_0_dem, round(avg(case when t = 0 and hi = lo then 0 when t = 0 then null else abs((hi - lo) / t) end), 6) as mean_pi_length_0_dem"


@query("q_evaluation", f"{_EVAL} select election_id, postal_code, 'group' as level, {_METRICS} from ev group by 1, 2 union all select election_id, null, 'all', {_METRICS} from ev group by 1")
def evaluation(spark, d):
    p = _predicted(spark, d).filter("role <> 'unexpected' and pred_dem is not null").withColumns({"lower_0_dem": 0.9 * F.col("pred_dem"), "upper_0_dem": 1.2 * F.col("pred_dem")})
    t = _truth(spark, d).select(*KEYS, F.col("results_dem").alias("raw_results_dem"))
    out = evaluate.score(p.select(*KEYS, "pred_dem", "lower_0_dem", "upper_0_dem"), t, KEYS, ["postal_code"], "dem", [0], SCOPE)
    return out.select("election_id", "postal_code", "level", "n", r("mae_dem", 4).alias("mae_dem"), *[r(c).alias(c) for c in ("mape_dem", "frac_within_pi_0_dem", "mean_pi_length_0_dem")])


@query("q_replay_split", f"""with {sql.BASE}, o as (select *, row_number() over (order by geographic_unit_fips) as place, count(*) over () as n from base where true_dem is not null) select geographic_unit_fips, case when place <= ceil(0.4 * n) then true_dem else 0 end as results_dem, true_dem as raw_results_dem, case when place <= ceil(0.4 * n) then 100.0 else 0.0 end as percent_expected_vote from o""")
def replay_split(spark, d):
    b = views.baseline(spark, d).filter("results_dem is not null")
    b = b.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("geographic_unit_fips")))
    return replay.percent(b, 40, ["dem"]).select("geographic_unit_fips", "results_dem", "raw_results_dem", "percent_expected_vote")


_U = "(cast('0x' || substr(md5('7:' || geographic_unit_fips), 1, 15) as bigint)::double + 1) / 1152921504606846978::double"


@query("q_replay_shuffle", f"""with {sql.BASE}, o as (select *, row_number() over (order by case when geographic_unit_fips = '39601' then 0 else 1 end, -ln({_U}) / (case when postal_code = 'ZA' then 5.0::double else 1.0::double end * case when county_classification = 'central' then 0.2::double else 1.0::double end), geographic_unit_fips) as place from base where true_dem is not null),
 f as (select geographic_unit_fips, place, case when place <= 495 then true_dem else 0 end as results_dem, true_dem as raw_results_dem, case when place <= 495 then 100.0 else 0.0 end as percent_expected_vote from o) select * from f union all select geographic_unit_fips || (place - 1), place, results_dem, raw_results_dem, percent_expected_vote from f where place <= 5""")
def replay_shuffle(spark, d):
    b = replay.shuffled(views.baseline(spark, d).filter("results_dem is not null"), 7, {"postal_code": {"ZA": 5.0}, "county_classification": {"central": 0.2}}, ["39601"])
    return replay.first_n(b, 500, ["dem"], unexpected=5).select("geographic_unit_fips", "place", "results_dem", "raw_results_dem", "percent_expected_vote")


@query("q_merged_measures", f"{sql.PRED}, a as (select election_id, postal_code, coalesce(sum(case when role = 'nonreporting' then pred_dem else results_dem end), 0.0) as pred_dem, cast(sum(reporting) as bigint) as reporting from pred where postal_code is not null group by 1, 2), b as (select election_id, postal_code, coalesce(sum(results_turnout), 0.0) as results_turnout from pred where postal_code is not null group by 1, 2) select a.*, results_turnout from a join b using (election_id, postal_code)")
def merged_measures(spark, d):
    p = _predicted(spark, d)
    by = ["election_id", "postal_code"]
    a = rollup.predictions(p, by, "dem").select(*by, "pred_dem", "reporting")
    b = rollup.predictions(p.withColumn("pred_turnout", F.col("results_turnout")), by, "turnout").select(*by, "results_turnout", "reporting")
    return evaluate.merge_measures([a, b], by)
