"""DuckDB SQL for the queries of the general problems."""

UNIT = "regexp_replace(translate(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '.', '-'), '-0$', '')"
STATE = "upper(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"
U, S = UNIT.format(c="geographic_unit_fips"), STATE.format(c="postal_code")

_LAST = f"""select {S} as state, election_id, {U} as unit, row_id, last_modified, results_turnout, results_dem, results_gop, results_weights, percent_expected_vote,
 count(*) over (partition by {S}, election_id, {U}) as n_readings,
 row_number() over (partition by {S}, election_id, {U} order by last_modified desc nulls last, received_at desc nulls last, row_id desc) as k
 from versioned_results"""

P1_LAST = f"select state, election_id, unit, n_readings, row_id, last_modified, results_turnout, results_dem, results_gop, results_weights, percent_expected_vote from ({_LAST}) where k = 1"

P1_ROLLUP = f"""with l as (select state, count(*) as n_units, cast(sum(results_dem) as bigint) as last_dem, cast(sum(results_gop) as bigint) as last_gop from ({P1_LAST}) group by state),
 c as (select {S} as state, count(*) as n_rows, count(results_dem) as n_dem, count(case when not isnan(percent_expected_vote) then 1 end) as n_percent, cast(sum(results_turnout) as bigint) as sum_turnout,
 max(case when not isnan(percent_expected_vote) then percent_expected_vote end) as max_percent, min(received_at) as first_received, max(received_at) as last_received from versioned_results group by 1)
 select c.*, n_units, last_dem, last_gop from c left join l on c.state is not distinct from l.state"""

P1_GAPS = f"""with r as (select {S} as state, epoch_us(received_at) - lag(epoch_us(received_at)) over (partition by {S} order by row_id) as step from versioned_results where received_at is not null)
 select state, count(*) as n_rows, max(step) / 1e6 as longest_wait_s, cast(sum(case when step < 0 then 1 else 0 end) as bigint) as n_back from r group by state"""

P3 = f"""with reg as (select snapshot_id, election_id, row_number() over (partition by election_id order by taken_at, snapshot_id) as seq, lead(snapshot_id) over (partition by election_id order by taken_at, snapshot_id) as next_id from snapshot_register where status = 'complete'),
 x as (select reg.*, {U} as u, results_dem as d, results_gop as g, row_number() over (partition by s.snapshot_id, {U} order by last_modified desc nulls last, d desc nulls last, g desc nulls last) as k from result_snapshots s join reg using (snapshot_id) where geographic_unit_fips is not null),
 o as (select * from x where k = 1)
 select a.snapshot_id, a.u as geographic_unit_fips, case when b.u is null then 'added' else 'changed' end as change_type from o a left join o b on a.election_id = b.election_id and a.u = b.u and a.seq = b.seq + 1
 where a.seq > 1 and (b.u is null or a.d is distinct from b.d or a.g is distinct from b.g)
 union all select a.next_id, a.u, 'removed' from o a left join o b on a.election_id = b.election_id and a.u = b.u and b.seq = a.seq + 1 where a.next_id is not null and b.u is null"""

P3_COUNTS = f"select snapshot_id, change_type, count(*) as n from ({P3}) group by all"

P4 = f"""with r as (select distinct election_id, {U} as u, cast(floor(epoch(last_modified) / 600) as bigint) as p from versioned_results
 where last_modified <= received_at and last_modified >= received_at - interval 2 day and geographic_unit_fips is not null and election_id is not null
 and (percent_expected_vote is not null and not isnan(percent_expected_vote) or results_margin is not null)),
 g as (select election_id, u, unnest(generate_series(min(p), max(p))) as p from r group by 1, 2)
 select g.election_id, g.u as geographic_unit_fips, g.p * 600 as period_start from g left join r on g.election_id = r.election_id and g.u = r.u and g.p = r.p where r.p is null"""


P2_IMPOSSIBLE = " union all ".join(f"select row_id, '{c}' as field from versioned_results where {c} < 0" + (f" or ({c} > 105 and not isnan({c}))" if c == "percent_expected_vote" else "") for c in ("percent_expected_vote", "results_weights", "results_dem"))

P4_PERIODS = f"""with r as (select election_id, {U} as u, cast(floor(epoch(last_modified) / 600) as bigint) as p, count(*) as n from versioned_results
 where last_modified <= received_at and last_modified >= received_at - interval 2 day and geographic_unit_fips is not null and election_id is not null
 and (percent_expected_vote is not null and not isnan(percent_expected_vote) or results_margin is not null) group by 1, 2, 3),
 g as (select election_id, u, unnest(generate_series(min(p), max(p))) as p from r group by 1, 2)
 select g.election_id, g.u as geographic_unit_fips, g.p * 600 as period_start, coalesce(n, 0) as n_readings, n is null as missing from g left join r on g.election_id = r.election_id and g.u = r.u and g.p = r.p"""


def _p5(name: str) -> str:
    cols = (("geographic_unit_fips", U, "baseline_units"), ("postal_code", S, "state_weights"))
    return " union all ".join(
        f"select '{name}' as table_name, row_id, '{c}' as field, received_at from {name} t where {c} is not null and not exists "
        f"(select 1 from (select {e} as k, added_at, removed_at from {target}) b where b.k = {e.replace(c, 't.' + c)} and b.added_at <= t.received_at and (b.removed_at is null or b.removed_at > t.received_at))"
        for c, e, target in cols
    )


_P5 = " union all ".join(_p5(t) for t in ("versioned_results", "result_snapshots", "current_loads"))
P5 = f"select table_name, row_id, field from ({_P5})"
P5_COUNTS = f"select table_name, field, strftime(make_timestamp(epoch_us(received_at)), '%Y-%m-%d') as period, count(*) as n from ({_P5}) group by all"



def _partial(name: str) -> str:
    refs = f"select row_id, received_at, {U} as u, {S} as s from {name} where geographic_unit_fips is not null or postal_code is not null"
    held = f"select 1 from (select {U} as u, {S} as s, added_at, removed_at from baseline_units) b where (t.u is null or b.u = t.u) and (t.s is null or b.s = t.s) and b.added_at <= t.received_at and (b.removed_at is null or b.removed_at > t.received_at)"
    return f"select '{name}' as table_name, case when u is null then 'postal_code' when s is null then 'geographic_unit_fips' else 'postal_code+geographic_unit_fips' end as field, received_at from ({refs}) t where not exists ({held})"


_PARTIAL = " union all ".join(_partial(t) for t in ("versioned_results", "result_snapshots", "current_loads"))
P5_PARTIAL = f"select table_name, field, strftime(make_timestamp(epoch_us(received_at)), '%Y-%m-%d') as period, count(*) as n from ({_PARTIAL}) group by all"

_RULES = (("results_weights", 0, "1e308", 0), ("results_normalized_margin", -1, 1, 6), ("percent_expected_vote", 0, 105, 2))
_STACK = " union all ".join(f"select load_id, '{c}' as column_name, case when isnan({c}) then null else {c} end as v, {lo} as lo, {hi} as hi, {10**k}.0 as f from current_loads" for c, lo, hi, k in _RULES)
P6 = f"""with s as ({_STACK}), t as (select load_id, column_name, count(*) as n, count(*) - count(v) as z, count(distinct v) as u, quantile_cont(v, 0.25) as a, quantile_cont(v, 0.5) as m, quantile_cont(v, 0.75) as b,
 bool_or(v < lo or v > hi or isinf(v)) as bad, bool_or(not isinf(v) and abs(v * f - round(v * f)) > 1e-6) as odd from s group by 1, 2),
 j as (select t.*, p.n as pn, p.z as pz, p.u as pu, p.a as pa, p.m as pm, p.b as pb from t left join load_register r using (load_id) left join t p on p.load_id = r.prev_load_id and p.column_name = t.column_name),
 k as (select load_id, column_name, unnest([case when bad then 'range' end, case when odd then 'pattern' end, case when z / n - pz / pn >= 0.1 - 1e-12 then 'nulls' end, case when 4 * u < pu then 'distinct' end,
 case when abs(m - pm) > 0.5 * (pb - pa) or b - a < 0.5 * (pb - pa) or b - a > 2 * (pb - pa) then 'distribution' end]) as finding from j)
 select * from k where finding is not null"""

_COLUMNS = {
    "versioned_results": ("row_id", "election_id", "postal_code", "geographic_unit_fips", "results_turnout", "results_dem", "results_gop", "percent_expected_vote", "results_weights", "results_margin", "results_normalized_margin", "last_modified", "received_at"),
    "result_snapshots": ("row_id", "snapshot_id", "postal_code", "geographic_unit_fips", "results_dem", "results_gop", "results_turnout", "percent_expected_vote", "last_modified", "received_at"),
    "current_loads": ("row_id", "load_id", "postal_code", "geographic_unit_fips", "results_dem", "results_gop", "results_turnout", "results_weights", "results_normalized_margin", "percent_expected_vote", "received_at"),
}
_TEXT, _TIME = {"election_id", "postal_code", "geographic_unit_fips"}, {"last_modified", "received_at"}


def _p6(t: str, c: str) -> str:
    text = c in _TEXT
    real = c in ("percent_expected_vote", "results_normalized_margin") or t == "current_loads" and c.startswith("results_")
    v = f"case when isnan({c}) then null else {c} end" if real else c
    number = "cast(null as double)" if text else "{a}(epoch(" + c + "))" if c in _TIME else "cast({a}(" + v + ") as double)"
    whole = "cast(null as bigint)" if text or real else "epoch_us({a}(" + c + "))" if c in _TIME else "{a}(" + c + ")"
    words = "{a}(" + c + ")" if text else "cast(null as varchar)"
    return f"select '{c}' as column_name, count(*) as n_rows, count(*) - count({v}) as n_null, count(distinct {v}) as n_distinct, {number.format(a='min')} as low, {number.format(a='max')} as high, {whole.format(a='min')} as low_whole, {whole.format(a='max')} as high_whole, {words.format(a='min')} as low_text, {words.format(a='max')} as high_text, '{t}' as table_name from {t}"


P6_PROFILE = " union all ".join(_p6(t, c) for t, cs in _COLUMNS.items() for c in cs)

SQL = {"p1_last_reading": P1_LAST, "p1_state_rollup": P1_ROLLUP, "p1_arrival_gaps": P1_GAPS, "p2_impossible": P2_IMPOSSIBLE, "p4_periods": P4_PERIODS, "p3_found": P3, "p3_change_counts": P3_COUNTS, "p4_found": P4, "p5_found": P5, "p5_orphan_counts": P5_COUNTS, "p5_partial_counts": P5_PARTIAL, "p6_found": P6, "p6_profile": P6_PROFILE}
