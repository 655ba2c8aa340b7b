"""DuckDB SQL of the registered estimation queries, over the same views as views.py."""

from countflow.operators.oracle import S, U

_FIN = "case when isnan({c}) or isinf({c}) then null else {c} end as {c}"
_COUNTS = ("results_dem", "results_gop", "results_turnout")
_COV = ("age_le_30", "age_geq_30_le_45", "age_geq_45_le_65", "age_geq_65", "ethnicity_group_a", "ethnicity_group_b", "ethnicity_other", "gender_f", "median_household_income", "percent_bachelor_or_higher")
K = "election_id, postal_code, geographic_unit_fips"

BASE = f"""base as (select * exclude (k) from (select postal_code, geographic_unit_fips, geographic_unit_type, county_fips, lower(trim(county_classification)) as county_classification, district, {", ".join(_FIN.format(c=c) for c in _COV)},
 baseline_dem::double as baseline_dem, baseline_gop::double as baseline_gop, baseline_turnout::double as baseline_turnout, results_dem::double as true_dem, results_gop::double as true_gop, results_turnout::double as true_turnout,
 row_number() over (partition by geographic_unit_fips order by added_at desc, baseline_turnout desc, postal_code) as k from baseline_units where removed_at is null) where k = 1)"""
CUR = f"""cur as (select election_id, postal_code, geographic_unit_fips, {", ".join(_FIN.format(c=c) for c in _COUNTS)}, case when isnan(p) or isinf(p) then null else p end as percent_expected_vote
 from (select l.election_id, {S} as postal_code, {U} as geographic_unit_fips, results_dem, results_gop, results_turnout, percent_expected_vote as p,
 row_number() over (partition by l.election_id, {U} order by row_id desc) as k from current_loads c join (select election_id, max(load_id) as load_id from load_register group by 1) l using (load_id) where geographic_unit_fips is not null) where k = 1)"""
EXPECTED = """expected as (select e.election_id, b.* from (select distinct election_id, unnest(states) as postal_code from election_config where election_id in (select election_id from load_register)) e join base b using (postal_code))"""
_DERIVED = """results_dem + results_gop as results_weights, results_dem - results_gop as results_margin, case when results_dem + results_gop = 0 or results_dem + results_gop is null then 0 else (results_dem - results_gop) / (results_dem + results_gop) end as results_normalized_margin"""
_BASED = """baseline_dem + baseline_gop as baseline_weights, baseline_dem - baseline_gop as baseline_margin, case when baseline_dem + baseline_gop = 0 or baseline_dem + baseline_gop is null then 0 else (baseline_dem - baseline_gop) / (baseline_dem + baseline_gop) end as baseline_normalized_margin,
 baseline_dem + 1 as last_election_results_dem, baseline_turnout + 1 as last_election_results_turnout"""
BOTH = f"""curx as (select *, {_DERIVED} from cur), basex as (select *, {_BASED} from expected),
 lefted as (select b.*, c.results_dem, c.results_gop, c.results_turnout, c.percent_expected_vote, c.results_weights, c.results_margin, c.results_normalized_margin from basex b left join curx c using (election_id, postal_code, geographic_unit_fips)),
 comb as (select *, case when baseline_weights = 0 or baseline_weights is null or results_weights is null then 0 else results_weights / baseline_weights end as turnout_factor from lefted where results_dem is not null and results_gop is not null and results_turnout is not null)"""
VIEWS = f"with {BASE}, {CUR}, {EXPECTED}, {BOTH}"
CATEGORY = """case when abs(baseline_weights) <= 1e-8 then 'non-modeled: zero baseline' when percent_expected_vote >= 60 and (turnout_factor <= 0.5 or turnout_factor >= 2.0) then 'non-modeled: strange turnout factor' end"""
EXTRA = """unex as (select *, split_part(geographic_unit_fips, '_', 1) as county_fips, split_part(geographic_unit_fips, '_', 1) as district from (select c.*, row_number() over (partition by election_id, geographic_unit_fips order by postal_code nulls first) as k from curx c where not exists (select 1 from comb b where b.election_id = c.election_id and b.geographic_unit_fips = c.geographic_unit_fips)) where k = 1)"""
ROLES = f"""cat as (select *, {CATEGORY} as why from comb),
 modeled as (select election_id, postal_code, geographic_unit_fips, geographic_unit_type, county_fips, county_classification, district, median_household_income, percent_bachelor_or_higher, age_le_30, baseline_dem, baseline_gop, baseline_turnout, baseline_weights, baseline_normalized_margin, last_election_results_dem, results_dem, results_gop, results_turnout, results_weights, results_margin, results_normalized_margin, percent_expected_vote, turnout_factor,
 case when why is not null then 'unexpected' when percent_expected_vote >= 60 then 'reporting' when percent_expected_vote < 60 then 'nonreporting' end as role, coalesce(why, 'expected') as unit_category, true_dem from cat),
 {EXTRA},
 roles as (select *, case when role = 'reporting' then 1 else 0 end as reporting, (results_dem - last_election_results_dem) / last_election_results_dem as residuals_dem from
 (select * from modeled where role is not null union all by name select election_id, postal_code, geographic_unit_fips, county_fips, district, results_dem, results_gop, results_turnout, results_weights, results_margin, results_normalized_margin, percent_expected_vote, 'unexpected' as role, 'unexpected' as unit_category from unex))"""
UNITS = f"{VIEWS}, {ROLES}"
SWING = """sw as (select election_id, min(r) as swing from (select election_id, residuals_dem as r, sum(last_election_results_dem) over (partition by election_id order by residuals_dem, geographic_unit_fips rows unbounded preceding) as c, sum(last_election_results_dem) over (partition by election_id) as t from roles where role = 'reporting' and residuals_dem is not null) where c >= 0.5 * t group by 1),
 pred as (select roles.*, case when role = 'nonreporting' then round_even(case when swing is null or results_dem is null then null else greatest(last_election_results_dem * (swing + 1), results_dem) end, 0) else results_dem end as pred_dem from roles left join sw using (election_id))"""
PRED = f"{UNITS}, {SWING}"


def rollup(keys: str, where: str = "true", source: str = PRED) -> str:
    return f"{source} select {keys}, coalesce(sum(case when role = 'nonreporting' then pred_dem else results_dem end), 0.0) as pred_dem, coalesce(sum(results_dem), 0.0) as results_dem, cast(sum(reporting) as bigint) as reporting from pred where {where} group by {keys}"


_KNOWN = "role <> 'nonreporting'"
#: Weighted medians of a value by key: the reference definition of ordered.weighted_median.


def wmedian(source: str, by: str, value: str, weight: str, name: str) -> str:
    return f"""(select {by}, coalesce(max_by(case when c * 2 = t then (v + nx) / 2 else nx end, c) filter (c * 2 <= t), min(v)) as {name} from (select {by}, {value} as v, lead({value}) over w as nx, sum({weight}) over (partition by {by} order by {value}, geographic_unit_fips rows unbounded preceding) as c, sum({weight}) over (partition by {by}) as t from {source} where {value} is not null and {weight} is not null window w as (partition by {by} order by {value}, geographic_unit_fips)) group by {by})"""


HASHED = "geographic_unit_fips"
VERS = f"""v as (select election_id, {U} as unit, last_modified, row_id, coalesce(results_turnout, 0)::double as t, coalesce(results_dem, 0)::double as d, coalesce(results_gop, 0)::double as g, coalesce(results_weights, 0)::double as w,
 case when percent_expected_vote is null or isnan(percent_expected_vote) then 0 else percent_expected_vote end as p, case when results_normalized_margin is null or isnan(results_normalized_margin) then 0 else results_normalized_margin end as norm
 from versioned_results where geographic_unit_fips is not null and election_id is not null and last_modified <= received_at and last_modified >= received_at - interval 2 day),
 vw as (select *, last_value(t) over f as lt, last_value(p) over f as lp, last_value(norm) over f as ln, row_number() over o as k, coalesce(lead(t) over o - t, 0) as dt, coalesce(lead(d) over o - d, 0) - coalesce(lead(g) over o - g, 0) as dm, coalesce(lead(w) over o - w, 0) as dw from v
 window o as (partition by election_id, unit order by last_modified, row_id), f as (partition by election_id, unit order by last_modified, row_id rows between unbounded preceding and unbounded following)),
 vb as (select *, case when lt = 0 then 0 else t / lt end * lp as pct, case when dw = 0 and dm = 0 then 0 when dw = 0 then null else dm / dw end as batch from vw),
 vc as (select *, lead(pct) over (partition by election_id, unit order by last_modified, row_id) as npct, case when max(case when dt < 0 and lt <> 0 then 1 else 0 end) over u = 1 then 'non-monotone percent expected vote' when max(case when batch is null or abs(batch) > 1 then 1 else 0 end) over u = 1 then 'batch_margin' else 'none' end as error_type from vb window u as (partition by election_id, unit))"""
ESTIMATE = f"""{VERS}, grid as (select election_id, unit, ln, error_type, unnest(generate_series(0, greatest(cast(floor(max(pct)) as bigint), 0))) as p from vc where error_type = 'none' group by 1, 2, 3, 4),
 obs as (select g.*, max(c.k) as k from grid g left join vc c on c.election_id = g.election_id and c.unit = g.unit and c.pct <= g.p group by all),
 est as (select o.election_id, o.unit, o.p, case when o.k is null then f.pct else coalesce(c.npct, c.pct) end as near, case when o.p = 0 then 0 when o.k is null then f.norm else (c.norm * c.pct + c.batch * (o.p - c.pct)) / o.p end as m, o.ln, o.error_type
 from obs o left join vc c on c.election_id = o.election_id and c.unit = o.unit and c.k = o.k left join vc f on f.election_id = o.election_id and f.unit = o.unit and f.k = 1)"""
