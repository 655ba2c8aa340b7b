"""Problem 2: implausible values in measurements, relative to each source's own behaviour.

A source is a unit in an election. Its readings, in time order, form one profile matrix
(readings x measures). Robust principal components split it into a low-rank part, the
normal behaviour (all counts rise together), and a sparse part. Readings with a sparse
part are candidates; a value is reported where it leaves the unit's own course for at
most three readings and comes back. Constant runs and ranges are tested separately.

All sources of a block are decomposed at once: matrices are padded to one length and the
small Gram matrices (measures x measures) are diagonalised in a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countflow.functions.common import repaired_id, table
from countflow.operators import grouped, hot_spikes

#: Fixed values of the problem: longest excursion, missed updates of a stuck value, highest percent.
MAX_EXCURSION = 3
MISSED_UPDATES = 6
MAX_PERCENT = 105.0

#: Measures of the profile matrix; the first three are tested.
FIELDS = ("percent_expected_vote", "results_weights", "results_dem")
PROFILE = (*FIELDS, "results_gop", "results_turnout", "results_margin")

#: Share of the unit's scale by which a value must leave its course, and the least size of a sparse part.
FAR = 0.12
SPARSE = 0.05
RANK_ITERATIONS = 25
#: For the decomposition alone, entries are held within this many typical sizes of their source: one huge entry would
#: bend the low-rank part towards itself. An entry that is held back is far from any course and stays a candidate.
HELD = 20


def robust_pca(m: np.ndarray, seen: np.ndarray, iterations: int = RANK_ITERATIONS) -> np.ndarray:
    """Sparse parts of a batch of matrices (sources x readings x measures), by principal component pursuit.

    seen marks the entries that exist. Augmented Lagrangian steps: singular value
    thresholding for the low-rank part, shrinkage for the sparse part. Entries that do not
    exist carry no sparse part. Matrices that are all zero give zeros.
    """
    g, t, f = m.shape
    m = np.where(seen, m, 0.0)
    # An even start: entries that do not exist follow the readings' median ratio to the others.
    norm = np.sqrt((m**2).sum(axis=(1, 2)))
    count = np.maximum(seen.any(axis=2).sum(axis=1), 1)
    lam = 2.0 / np.sqrt(np.maximum(count, f))[:, None, None]
    mu = np.where(norm > 0, 1.25 / np.maximum(norm, 1e-12), 1.0)[:, None, None]
    limit = mu * 1e5
    y = np.zeros_like(m)
    s = np.zeros_like(m)
    low = np.zeros_like(m)
    for _ in range(iterations):
        x = np.where(seen, m - s + y / mu, low)
        low, s, y = shrunk(m, seen, x, y, shares(np.matmul(x.transpose(0, 2, 1), x), mu), mu, lam)
        mu = np.minimum(mu * 1.6, limit)
    return s


def shares(gram: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """The maps (sources x measures x measures) that threshold the singular values of matrices with these Gram matrices."""
    values, vectors = np.linalg.eigh(gram)
    sigma = np.sqrt(np.maximum(values, 0.0))
    keep = np.maximum(1.0 - (1.0 / mu[:, :, 0]) / np.maximum(sigma, 1e-12), 0.0)
    return np.matmul(vectors * keep[:, None, :], vectors.transpose(0, 2, 1))


def shrunk(m: np.ndarray, seen: np.ndarray, x: np.ndarray, y: np.ndarray, share: np.ndarray, mu: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low-rank part, sparse part and multipliers after one step; each reading's depend on its own row and share only."""
    low = np.matmul(x, share)
    rest = m - low + y / mu
    s = np.where(seen, np.sign(rest) * np.maximum(np.abs(rest) - lam / mu, 0.0), 0.0)
    return low, s, np.where(seen, y + mu * (m - low - s), 0.0)


def _padded(starts: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of similar length together: (group rows as positions, mask, groups) for each padded block."""
    lengths = np.diff(np.append(starts, n))
    order = np.argsort(lengths, kind="stable")
    out = []
    i = 0
    while i < len(order):
        longest = lengths[order[i]]
        j = i
        while j < len(order) and lengths[order[j]] <= max(16, 1.3 * longest) and (j - i) * lengths[order[j]] < 60_000:
            j += 1
        j = max(j, i + 1)
        own = order[i:j]
        width = int(lengths[own].max())
        at = starts[own][:, None] + np.arange(width)
        mask = np.arange(width) < lengths[own][:, None]
        out.append((np.where(mask, at, starts[own][:, None]), mask, own))
        i = j
    return out


def _last_index(flag: np.ndarray, group_start: np.ndarray) -> np.ndarray:
    """For each row the last row at or before it with flag, within its group, else -1."""
    at = np.maximum.accumulate(np.where(flag, np.arange(len(flag)), -1))
    return np.where(at >= group_start, at, -1)


def _excursions(x: np.ndarray, candidate: np.ndarray, group: np.ndarray, scale: np.ndarray, most: int = MAX_EXCURSION) -> np.ndarray:
    """Values (without nulls, in order) that leave their group's course far and come back within `most` readings."""
    n = len(x)
    out = np.zeros(n, bool)
    if not n:
        return out
    first = np.append(True, group[1:] != group[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    calm = ~candidate
    before = _last_index(calm, start)
    back = (n - 1) - np.maximum.accumulate(np.where(calm[::-1], np.arange(n), -1))
    after = np.where(np.maximum.accumulate(np.where(calm[::-1], np.arange(n), -1)) >= 0, back, n)[::-1]
    after = np.where((after < n) & (group[np.minimum(after, n - 1)] == group), after, -1)
    length = np.where(after >= 0, after, 0) - before - 1
    ok = candidate & (before >= 0) & (after >= 0) & (length <= most)
    a = x[before]
    b = x[after]
    low, high = np.minimum(a, b), np.maximum(a, b)
    off = np.maximum(x - high, low - x)
    near = np.maximum(np.maximum(np.abs(a), np.abs(b)), 0.0)
    out[ok] = (off > FAR * np.maximum(near, 0.02 * scale))[ok]
    return out


def find(t: pa.Table, starts: np.ndarray) -> pa.Table:
    """The row and field of every implausible value in a block of whole sources (columns as in wrong_values)."""
    n = t.num_rows
    values = np.column_stack([grouped.floats(t, c) for c in PROFILE])
    lm = grouped.ints(t, "last_modified")
    group = np.zeros(n, np.int64)
    group[starts] = 1
    group = np.cumsum(group) - 1

    # Readings sent twice count once for the course and get the verdict of their first copy.
    copy_of = _first_copies(group, lm, values)
    first = copy_of == np.arange(n)
    reading = (np.cumsum(first) - 1)[copy_of]
    v, g = values[first], group[first]
    r = len(v)
    begin = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if r else np.zeros(0, np.int64)

    impossible, above = ranges(v)
    sparse = np.zeros((r, len(PROFILE)))
    noise = np.zeros((r, len(PROFILE)))
    scale = np.ones((r, len(PROFILE)))
    for at, mask, own in _padded(begin, r):
        m = v[at]
        seen = mask[:, :, None] & np.isfinite(m)
        size = np.where(seen & (np.abs(m) > 0), np.abs(m), np.nan)
        with np.errstate(all="ignore"):
            typical = _nanmedian(size)
        typical = np.where(np.isfinite(typical) & (typical > 0), typical, 1.0)
        s = robust_pca(np.clip(m / typical[:, None, :], -HELD, HELD), seen)
        size = np.abs(s)
        sparse[at[mask]] = size[mask]
        noise[at[mask]] = np.repeat(3 * _nanmedian(np.where(seen, size, np.nan)), mask.sum(axis=1), axis=0)
        scale[at[mask]] = np.repeat(typical, mask.sum(axis=1), axis=0)

    found = impossible.copy()
    stuck = np.zeros((r, 3), bool)
    others_moved = _updates(v, g)
    for f in range(3):
        held = np.isfinite(v[:, f])
        idx = np.flatnonzero(held)
        x, gg = v[idx, f], g[idx]
        stuck[idx, f] = _stuck(x, gg, others_moved(f)[idx])
        doubt = doubted(f, v[idx, f], sparse[idx], noise[idx, f], scale[idx, f]) | impossible[idx, f] | above[idx]
        found[idx, f] |= _excursions(x, doubt & ~stuck[idx, f], gg, scale[idx, f])
    found |= stuck
    settle(v, above, found)
    return cases(grouped.ints(t, "row_id"), found[reading] & np.isfinite(values[:, :3]))


def _first_copies(group: np.ndarray, lm: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row the first row of its group with the same moment and measures."""
    out = np.arange(len(lm))
    tie = np.append(False, (group[1:] == group[:-1]) & (lm[1:] == lm[:-1]))
    tied = np.flatnonzero(tie | np.append(tie[1:], False))
    if len(tied):
        bits = np.where(np.isnan(values[tied]), np.nan, values[tied] + 0.0).view(np.int64)
        _, at, which = np.unique(np.column_stack([group[tied], lm[tied], bits]), axis=0, return_index=True, return_inverse=True)
        out[tied] = tied[at[which.ravel()]]
    return out


def ranges(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of FIELDS that no unit can have, and readings with more dem than weights."""
    with np.errstate(invalid="ignore"):
        impossible = v[:, :3] < 0
        impossible[:, 0] |= v[:, 0] > MAX_PERCENT
        return impossible, v[:, 2] > v[:, 1]


def doubted(f: int, x: np.ndarray, sparse: np.ndarray, noise: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Values x of field f with a sparse part; sparse: readings x measures."""
    level = np.maximum(np.abs(x) / scale, 0.05)
    # The part of all counts that moved together may lie in the percent instead, and the other way round.
    other = (1, 4) if f == 0 else (0,)
    part = np.maximum(sparse[:, f], sparse[:, other].max(axis=1))
    return part > np.maximum(SPARSE * level, 0.01 + noise)


def settle(v: np.ndarray, above: np.ndarray, found: np.ndarray) -> None:
    """More dem than weights: the field that left its course; where neither did, the one the other counts contradict."""
    open_ = above & ~found[:, 1] & ~found[:, 2]
    if open_.any():
        implied = v[:, 5] + v[:, 3]
        dem_wrong = open_ & np.isfinite(implied) & (np.abs(implied - v[:, 2]) > np.abs(v[:, 2] + v[:, 3] - v[:, 1]))
        found[dem_wrong, 2] = True
        found[open_ & ~dem_wrong, 1] = True


def cases(row_id: np.ndarray, verdict: np.ndarray) -> pa.Table:
    rows, fields = np.nonzero(verdict)
    return pa.table({"row_id": pa.array(row_id[rows], pa.int64()), "field": pa.array(np.array(FIELDS)[fields], pa.string())})


def _nanmedian(x: np.ndarray) -> np.ndarray:
    """Median over axis 1 without NaN (sorting puts NaN last)."""
    s = np.sort(x, axis=1)
    k = np.isfinite(x).sum(axis=1)
    at = np.maximum(k - 1, 0) // 2
    return np.where(k > 0, np.take_along_axis(s, at[:, None, :], axis=1)[:, 0, :], np.nan)


def _updates(v: np.ndarray, g: np.ndarray):
    """For a field: readings at which the unit's other counts moved on from the reading before."""
    same = np.append(False, g[1:] == g[:-1])

    def moved(c: int) -> np.ndarray:
        x = v[:, c]
        held = np.isfinite(x)
        idx = np.flatnonzero(held)
        out = np.zeros(len(x), bool)
        if len(idx) > 1:
            y = x[idx]
            out[idx[1:]] = (g[idx[1:]] == g[idx[:-1]]) & (y[1:] != y[:-1])
        return out & same

    by = {c: moved(c) for c in (1, 2, 3, 4)}

    def of(field: int) -> np.ndarray:
        # results_gop and results_turnout are the counts that no test doubts.
        return by[4] & by[3] if field == 2 else by[4]

    return of


def _stuck(x: np.ndarray, group: np.ndarray, moved: np.ndarray, before: float = 0, after: float = 0) -> np.ndarray:
    """Rows of constant runs from the first missed update on, where at least MISSED_UPDATES updates were missed.

    before, after: updates that the first run missed before these rows, and the last run after them.
    """
    n = len(x)
    if not n:
        return np.zeros(0, bool)
    new = np.append(True, (group[1:] != group[:-1]) | (x[1:] != x[:-1]))
    run = np.cumsum(new) - 1
    missed = moved & ~new
    total = np.bincount(run, weights=missed)
    total[0] += before
    total[-1] += after
    so_far = np.cumsum(missed)
    at_start = so_far[np.flatnonzero(new)].astype(float)
    at_start[0] -= before
    return (total[run] >= MISSED_UPDATES) & (so_far - at_start[run] > 0)


def wrong_values(readings: DataFrame) -> DataFrame:
    """Implausible values of readings: one row (row_id, field) per value.

    readings: row_id, election_id, unit, last_modified, received_at and the PROFILE columns.
    Null and NaN values are never reported. Rows that name no source (null election or
    unit) or have no trustworthy time (last_modified null, after received_at or over two
    days before it) take no part in the course of a source; of them only impossible values
    are reported. Copies of a row get the same verdict. A source of more than
    grouped.SEGMENT_ROWS rows is handled by many tasks with the same result (hot_spikes).
    """
    r = readings
    for c in PROFILE:
        r = r.withColumn(c, F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")))
    timed = F.col("last_modified").isNotNull() & F.coalesce((F.col("last_modified") <= F.col("received_at")) & (F.col("last_modified") >= F.col("received_at") - F.expr("INTERVAL 2 DAYS")), F.lit(True))
    sourced = F.col("election_id").isNotNull() & F.col("unit").isNotNull()
    r = r.select("row_id", "election_id", "unit", "last_modified", *PROFILE, (timed & sourced).alias("_ok"))
    keys, order = ["election_id", "unit"], ["last_modified", "row_id"]
    on_course = r.filter("_ok").drop("_ok")
    calm, hot, names = grouped.split_hot(on_course, keys, grouped.SEGMENT_ROWS)
    course = grouped.map_groups(calm, keys, order, find, "row_id long, field string")
    if names is not None:
        course = course.unionByName(hot_spikes.wrong_values(hot, names, keys, order))
    p, w, d, g, m = (F.col(c) for c in ("percent_expected_vote", "results_weights", "results_dem", "results_gop", "results_margin"))
    dem_off = F.coalesce(F.abs(m + g - d) > F.abs(d + g - w), F.lit(False))
    tests = F.array(
        F.when((p < 0) | (p > MAX_PERCENT), F.lit(FIELDS[0])),
        F.when((w < 0) | ((d > w) & (d >= 0) & ~dem_off), F.lit(FIELDS[1])),
        F.when((d < 0) | ((d > w) & (w >= 0) & dem_off), F.lit(FIELDS[2])),
    )
    alone = r.filter(~F.col("_ok")).select("row_id", F.explode(F.array_compact(tests)).alias("field"))
    return course.unionByName(alone)


def readings(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "versioned_results").withColumn("unit", repaired_id("geographic_unit_fips"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    return wrong_values(readings(spark, sf_dir))


def impossible(spark, sf_dir: str) -> DataFrame:
    """Of the wrong values those that no unit can have by themselves: below 0, or a percent above the highest."""
    v = readings(spark, sf_dir).select("row_id", *FIELDS)
    value = F.get(F.array(*[F.col(c).cast("double") for c in FIELDS]), F.array_position(F.array(*[F.lit(c) for c in FIELDS]), F.col("field")).cast("int") - 1)
    odd = (value < 0) | ((F.col("field") == FIELDS[0]) & (value > MAX_PERCENT))
    return p2_found(spark, sf_dir).join(v, "row_id").filter(odd).select("row_id", "field")
