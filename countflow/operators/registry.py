"""The queries of the general problems."""

from countflow.operators import chunks, grid, oracle, orphans, quality, snapshots, spikes

QUERIES = {
    "p1_last_reading": chunks.last_readings,
    "p1_state_rollup": chunks.state_rollup,
    "p1_arrival_gaps": chunks.arrival_gaps,
    "p2_found": spikes.p2_found,
    "p2_impossible": spikes.impossible,
    "p3_found": snapshots.p3_found,
    "p3_change_counts": snapshots.change_counts,
    "p4_found": grid.p4_found,
    "p4_grid": grid.p4_grid,
    "p4_periods": grid.periods,
    "p5_found": orphans.p5_found,
    "p5_orphan_counts": orphans.orphan_counts,
    "p5_partial_counts": orphans.partial_counts,
    "p6_found": quality.p6_found,
    "p6_profile": quality.p6_profile,
}

SQL = oracle.SQL
