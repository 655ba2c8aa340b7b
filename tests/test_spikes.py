import datetime

import numpy as np
import pytest

from countflow.operators import spikes

T0 = datetime.datetime(2024, 11, 6, 1)
SCHEMA = "row_id long, election_id string, unit string, last_modified timestamp, received_at timestamp, percent_expected_vote double, results_weights long, results_dem long, results_gop long, results_turnout long, results_margin long"


def course(unit="u", n=40, dem=0.6, start=0):
    """A unit that counts steadily."""
    rows = []
    for i in range(n):
        t = T0 + datetime.timedelta(minutes=5 * i)
        total = 100 + 50 * i
        d = round(dem * total)
        rows.append([start + i, "e", unit, t, t + datetime.timedelta(minutes=1), round(100 * total / 2400, 2), total, d, total - d, total + 10, 2 * d - total])
    return rows


def found(spark, rows):
    return {tuple(x) for x in spikes.wrong_values(spark.createDataFrame([tuple(r) for r in rows], SCHEMA)).collect()}


P, W, D = 5, 6, 7


def test_a_steady_course_has_no_cases(spark):
    assert found(spark, course()) == set()


@pytest.mark.parametrize("field,value", [(P, 90.0), (P, 0.5), (W, 9000), (D, 3000), (D, 10)])
def test_one_spike(spark, field, value):
    rows = course()
    rows[20][field] = value
    assert found(spark, rows) == {(20, spikes.FIELDS[field - P])}


def test_three_readings_off_course_but_not_a_lasting_change(spark):
    rows = course()
    for i in (10, 11, 12):
        rows[i][W] = rows[i][W] * 3
    assert found(spark, rows) == {(i, "results_weights") for i in (10, 11, 12)}
    rows = course()
    for r in rows[20:]:
        for c in range(W, 11):
            r[c] = r[c] - 600 if c != 10 else r[7] - r[8]
    assert found(spark, rows) == set()


def test_a_large_batch_and_a_rest_are_normal(spark):
    rows = course()
    for r in rows[20:]:
        r[P], r[W], r[D], r[8], r[9] = round(r[P] + 15, 2), r[W] + 360, r[D] + 216, r[8] + 144, r[9] + 360
        r[10] = r[D] - r[8]
    assert found(spark, rows) == set()
    rest = course()
    for i in range(15, 25):
        rest[i][P:] = rest[14][P:]
    assert found(spark, rest) == set()


def test_stuck_value_from_the_first_missed_update(spark):
    rows = course()
    for i in range(11, 20):
        rows[i][D] = rows[10][D]
    assert found(spark, rows) == {(i, "results_dem") for i in range(11, 20)}


def test_impossible_values_and_copies(spark):
    rows = course()
    rows[5][P] = 140.0
    rows[7][W] = -1
    rows[9][D] = -5
    rows += [[100, *rows[5][1:]]]
    assert found(spark, rows) == {(5, "percent_expected_vote"), (100, "percent_expected_vote"), (7, "results_weights"), (9, "results_dem")}


def test_rows_without_source_or_time(spark):
    rows = course()
    rows += [[50, None, "u", T0, T0, -1.0, 5, 1, 4, 5, -3], [51, "e", "u", None, T0, 20.0, 5, 9, 1, 12, 8], [52, "e", None, T0, T0, None, None, None, None, None, None]]
    assert found(spark, rows) == {(50, "percent_expected_vote"), (51, "results_weights")}


def test_nulls_everywhere_and_empty(spark):
    assert found(spark, [[1] + [None] * 10, [2, "e", "u", T0, T0] + [None] * 6, [2, "e", "u", T0, T0] + [None] * 6]) == set()
    empty = spark.createDataFrame([], SCHEMA)
    assert spikes.wrong_values(empty).count() == 0


def test_robust_pca_separates_sparse_from_low_rank():
    rng = np.random.default_rng(0)
    m = rng.uniform(1, 3, (4, 60, 1)) * rng.uniform(0.5, 2, (4, 1, 6))
    sparse = np.zeros_like(m)
    for g in range(4):
        sparse[g, 7 * g + 5, g] = 4.0
    s = spikes.robust_pca(m + sparse, np.ones(m.shape, bool), 40)
    assert (np.abs(s[sparse > 0] - 4) < 0.3).all()
    assert np.abs(s[sparse == 0]).max() < 0.3
