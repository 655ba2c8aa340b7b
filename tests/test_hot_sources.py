"""Sources with more rows than one task takes: the same results as for a whole source."""

import datetime
import random

import numpy as np
import pytest

from countflow.operators import grid, grouped, spikes
from tests.test_spikes import SCHEMA, D, P, W, course


def wrong(spark, rows):
    out = spikes.wrong_values(spark.createDataFrame([tuple(r) for r in rows], SCHEMA)).collect()
    assert len(out) == len(set(out))
    return {tuple(x) for x in out}


def awkward():
    """Spikes and stuck runs at and across borders of 20 readings, copies that outnumber a segment, and nulls."""
    rows = course(n=120)
    for i in (19, 20, 21):
        rows[i][W] = rows[i][W] * 3
    rows[39][P], rows[60][D] = 90.0, 4
    for i in range(71, 112):
        rows[i][D] = rows[70][D]
    for i in range(2, 17):
        rows[i][P] = None
    rows[20][P] = rows[22][P] = None
    other = course("v", 35, start=500)
    other[20][W] = 9000
    copies = [[1000 + i, *rows[k][1:]] for i, k in enumerate([20] * 130 + [39] * 70 + [90] * 60 + [5] * 30)]
    # A second reading of one moment between the copies of the first.
    copies += [[2000, *rows[60][1:]], [1999, *rows[60][1:P], 50.0, *rows[60][P + 1 :]]]
    return rows + other + copies


@pytest.mark.parametrize("size", [20, 7])
def test_copies_runs_and_spikes_across_segments(spark, monkeypatch, size):
    rows = awkward()
    whole = wrong(spark, rows)
    assert {(20, "results_weights"), (1000, "results_weights"), (1129, "results_weights"), (111, "results_dem"), (1200, "results_dem")} <= whole
    monkeypatch.setattr(grouped, "SEGMENT_ROWS", size)
    assert wrong(spark, rows) == whole


def test_segments_of_all_sources_find_the_same(spark, data, monkeypatch):
    whole = {tuple(x) for x in spikes.p2_found(spark, data).collect()}
    monkeypatch.setattr(grouped, "SEGMENT_ROWS", 40)
    assert {tuple(x) for x in spikes.p2_found(spark, data).collect()} == whole


READ = "row_id long, election_id string, unit string, last_modified timestamp, received_at timestamp, percent_expected_vote double, results_margin double"


def night():
    """A crowded period over several segments, a gap, lone readings, nulls, and a source without margin."""
    r, t0, rows = random.Random(3), datetime.datetime(2024, 11, 6, 1), []
    seconds = sorted([r.uniform(0, 600) for _ in range(40)] + [r.uniform(600, 1200) for _ in range(300)] + [r.uniform(4000, 9000) for _ in range(60)])
    for i, at in enumerate(seconds):
        t = t0 + datetime.timedelta(seconds=at)
        p, m = at / 100 + r.gauss(0, 0.1), at * 3 + r.gauss(0, 20)
        rows.append((i, "e", "u", t, t, None if i % 7 == 0 else 300.0 if i == 90 else p, None if i % 7 and i % 3 == 0 else m))
        if i % 4 == 0:
            rows.append((1000 + i, "e", "v", t, t, p, None))
    return rows


@pytest.mark.parametrize("size,parts", [(100, 1), (7, 5), (1, 3)])
def test_crowded_periods_count_all_readings_and_keep_their_levels(spark, monkeypatch, size, parts):
    """However readings are spread over tasks and combined, the grid is the same, copies counted."""
    df = spark.createDataFrame(night(), READ)
    whole = grid.on_grid(df).orderBy("unit", "period_start").collect()
    assert [x.n_readings for x in whole if x.unit == "u"][:3] == [40, 300, 0]
    monkeypatch.setattr(grid, "COMBINED_ROWS", size)
    again = grid.on_grid(df.repartition(parts)).orderBy("unit", "period_start").collect()
    assert [x[:5] for x in again] == [x[:5] for x in whole]
    for a, b in zip(again, whole, strict=True):
        assert [x if x is None else pytest.approx(x, rel=1e-6, abs=1e-6) for x in b[5:]] == list(a[5:])


def test_many_copies_of_a_reading_sharpen_it_and_cost_one_row(spark):
    t = datetime.datetime(2024, 11, 6, 1)
    at = [(i, "e", "u", t + datetime.timedelta(minutes=10 * i), t + datetime.timedelta(days=1), float(i), 5.0 * i) for i in range(6)]
    one = {x.period_start: x for x in grid.on_grid(spark.createDataFrame(at, READ)).collect()}
    many = {x.period_start: x for x in grid.on_grid(spark.createDataFrame(at + [at[3]] * 4000, READ)).collect()}
    assert [x.n_readings for x in many.values()].count(4001) == 1 and len(many) == len(one) == 6
    assert all(abs(many[k].percent_expected_vote - one[k].percent_expected_vote) < 0.2 and many[k].percent_expected_vote_sd <= one[k].percent_expected_vote_sd + 1e-9 for k in one)


def test_combining_equals_readings_one_by_one():
    """n readings of one moment as one observation with n: the filter that takes them one after the other ends the same."""
    rng = np.random.default_rng(2)
    dt, x = np.array([0.0, 30, 0, 0, 45, 20, 60]), rng.normal(10, 0.01, 7)
    r, q = np.array([[0.01]]), np.array([[1e-6]])
    a, v = grid.smooth(dt[None], x[None, :, None], r, q)
    kept = [0, 1, 4, 5, 6]
    y = np.array([x[0], x[1:4].mean(), x[4], x[5], x[6]])
    b, w = grid.smooth(dt[kept][None], y[None, :, None], r, q, np.array([1, 3, 1, 1, 1.0])[None, :, None])
    assert np.allclose(a[0, [0, 3, 4, 5, 6], 0], b[0, :, 0], atol=1e-6) and np.allclose(v[0, [0, 3, 4, 5, 6], 0], w[0, :, 0], atol=1e-6)
