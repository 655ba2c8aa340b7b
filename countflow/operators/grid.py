"""Problem 4: irregular readings onto a regular grid, by a Kalman smoother per source.

Each measure of a source follows a continuous-time local linear trend (level and slope,
white noise on the slope's derivative). The forward filter and the backward smoother run
over the merged sequence of readings and grid times; at grid times there is nothing to
observe, and the smoothed level and its standard deviation are the result. Many sources
advance together, one event at a time, as arrays.

Readings of one source within one minute are one observation, their mean with the
variance of as many readings. Minutes are combined before the shuffle, so a source has at
most one row per minute of its time, whatever its share of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countflow.functions.common import repaired_id, table
from countflow.operators import grouped
from countflow.operators.spikes import _padded

PERIOD_S = 600
#: Width of one observation in seconds (a part of the period), and rows that a task combines at a time before the shuffle.
MINUTE_S, COMBINED_ROWS = 60, 200_000
FIELDS = ("percent_expected_vote", "results_margin")
#: Standard deviation of a reading as a share of the series' largest size; innovations beyond GATE sds lose weight.
NOISE, GATE = 0.002, 4.0

SCHEMA = "election_id string, unit string, period_start long, n_readings long, missing boolean, percent_expected_vote double, percent_expected_vote_sd double, results_margin double, results_margin_sd double"


def smooth(dt: np.ndarray, x: np.ndarray, r: np.ndarray, q: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed levels and variances. dt: sources x events, seconds since the event before; x: sources x
    events x measures, NaN where nothing is observed; r, q: sources x measures; n: readings that x is the mean of."""
    u, e, f = x.shape
    n = np.ones(x.shape) if n is None else np.maximum(n, 1)
    level = np.zeros((e, u, f))
    p = np.zeros((e, 3, u, f))
    gain, scaled = np.zeros((e, 2, u, f)), np.zeros((e, 2, u, f))
    seen = np.isfinite(x)
    first = np.argmax(seen, axis=1)
    start = np.where(seen.any(axis=1), np.take_along_axis(x, first[:, None, :], axis=1)[:, 0, :], 0.0)
    size = np.where(seen, np.abs(x), 0.0).max(axis=1) + 1.0
    a, b = start.copy(), np.zeros((u, f))
    paa, pab, pbb = (2 * size) ** 2, np.zeros((u, f)), (size / 600.0) ** 2
    for i in range(e):
        d = dt[:, i, None]
        a = a + d * b
        paa = paa + d * (2 * pab + d * pbb) + q * d**3 / 3
        pab = pab + d * pbb + q * d**2 / 2
        pbb = pbb + q * d
        o = seen[:, i]
        if o.any():
            v = np.where(o, x[:, i] - a, 0.0)
            s = paa + r / n[:, i]
            # A reading far off the prediction counts as a noisier one.
            s = s * np.maximum(v * v / (GATE**2 * s), 1.0)
            inverse = np.where(o, 1.0 / s, 0.0)
            ka, kb = paa * inverse, pab * inverse
            a, b = a + ka * v, b + kb * v
            pbb = np.maximum(pbb - kb * pab, 0.0)
            paa, pab = (1 - ka) * paa, (1 - ka) * pab
            gain[i, 0], gain[i, 1], scaled[i, 0], scaled[i, 1] = ka, kb, inverse, inverse * v
        level[i], p[i, 0], p[i, 1], p[i, 2] = a, paa, pab, pbb
    # Backward (Bryson-Frazier): the adjoint of the innovations needs no inverse of a covariance.
    out, var = np.empty((e, u, f)), np.empty((e, u, f))
    la, lb = np.zeros((u, f)), np.zeros((u, f))
    haa, hab, hbb = np.zeros((u, f)), np.zeros((u, f)), np.zeros((u, f))
    for i in range(e - 1, -1, -1):
        paa, pab = p[i, 0], p[i, 1]
        out[i] = level[i] - (paa * la + pab * lb)
        var[i] = np.maximum(paa - (paa * (paa * haa + 2 * pab * hab) + pab * pab * hbb), 0.0)
        ka, kb = gain[i]
        c = 1 - ka
        la, lb = c * la - kb * lb - scaled[i, 1], lb
        haa, hab = c * (c * haa - kb * hab) - kb * (c * hab - kb * hbb) + scaled[i, 0], c * hab - kb * hbb
        d = dt[:, i, None]
        lb = lb + d * la
        hbb = hbb + d * (2 * hab + d * haa)
        hab = hab + d * haa
    return out.transpose(1, 0, 2), var.transpose(1, 0, 2)


def _trend_noise(t: np.ndarray, x: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Observation and slope noise per group of one measure: from its size and from its typical change of slope."""
    idx = np.flatnonzero(np.isfinite(x))
    size = np.zeros(n_groups)
    np.maximum.at(size, group[idx], np.abs(x[idx]))
    r = np.maximum(NOISE * size, 1e-3) ** 2
    g, tt, xx = group[idx], t[idx], x[idx]
    dt = np.maximum(np.diff(tt), 60.0)
    slope = np.diff(xx) / dt
    if len(g) < 3:
        return r, (1e-7 * (size + 1)) ** 2
    two = g[2:] == g[:-2]
    turn = (np.diff(slope) ** 2 / ((dt[1:] + dt[:-1]) / 2))[two]
    at = g[2:][two]
    # A high quantile per group: rests tell nothing of the unrest, single spikes nothing of the rule.
    order = np.lexsort((turn, at))
    count = np.bincount(at, minlength=n_groups)
    place = np.cumsum(count) - count + (0.7 * np.maximum(count - 1, 0)).astype(np.int64)
    q = np.zeros(n_groups)
    some = count > 0
    q[some] = turn[order][place[some]] * 0.5
    return r, np.maximum(q, (1e-7 * (size + 1)) ** 2)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per source and minute, over as many rows as a task holds at a time."""
    names = ["readings", "off", *(f"{x}{c}" for c in range(2) for x in ("s", "k"))]
    held, rows = [], 0

    def sums() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).group_by(["election_id", "unit", "minute"]).aggregate([(c, "sum") for c in names])
        yield from t.rename_columns([c.removesuffix("_sum") for c in t.column_names]).select(["election_id", "unit", "minute", *names]).combine_chunks().to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
            if rows >= COMBINED_ROWS:
                yield from sums()
                held, rows = [], 0
    if held:
        yield from sums()


def regular(t: pa.Table, starts: np.ndarray) -> pa.Table:
    """The grid rows of a block of whole sources (combined readings sorted by minute)."""
    group = np.zeros(t.num_rows, np.int64)
    group[starts] = 1
    group = np.cumsum(group) - 1
    minute = grouped.ints(t, "minute")
    at = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (minute[1:] != minute[:-1])))
    held, off, *parts = (np.add.reduceat(grouped.floats(t, c), at) for c in ("readings", "off", "s0", "k0", "s1", "k1"))
    t, group, minute = t.take(pa.array(at)), group[at], minute[at]
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    n, k = len(group), len(starts)
    time = minute * float(MINUTE_S) + off / held
    size = np.column_stack(parts[1::2])
    with np.errstate(all="ignore"):
        values = np.where(size > 0, np.column_stack(parts[::2]) / size, np.nan)
    values[~np.isfinite(values)] = np.nan
    period = minute // (PERIOD_S // MINUTE_S)
    first = period[starts]
    counts = period[np.append(starts[1:], n) - 1] - first + 1

    gg = np.repeat(np.arange(k), counts)
    gp = np.repeat(first, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    # Readings in each period: positions by a joint key of group and period.
    base = int(period.min())
    span = int(period.max()) - base + 2
    hit, which = np.unique(group * span + (period - base), return_inverse=True)
    hits = np.bincount(which, weights=held).astype(np.int64)
    want = gg * span + (gp - base)
    at = np.searchsorted(hit, want)
    at = np.minimum(at, len(hit) - 1)
    readings = np.where(hit[at] == want, hits[at], 0)

    noise = [_trend_noise(time, values[:, c], group, k) for c in range(2)]
    r, q = np.column_stack([x[0] for x in noise]), np.column_stack([x[1] for x in noise])

    ev_group = np.concatenate([group, gg])
    ev_time = np.concatenate([time, gp * PERIOD_S + PERIOD_S / 2])
    ev_row = np.concatenate([np.full(n, -1), np.arange(len(gg))])
    ev_value = np.concatenate([values, np.full((len(gg), 2), np.nan)])
    ev_size = np.concatenate([size, np.ones((len(gg), 2))])
    order = np.lexsort((ev_time, ev_group))
    ev_group, ev_time, ev_row, ev_value, ev_size = ev_group[order], ev_time[order], ev_row[order], ev_value[order], ev_size[order]
    begin = np.flatnonzero(np.append(True, ev_group[1:] != ev_group[:-1]))
    level, sd = np.full((len(gg), 2), np.nan), np.full((len(gg), 2), np.nan)
    for where, mask, own_groups in _padded(begin, len(ev_group)):
        tt = ev_time[where]
        dt = np.maximum(np.diff(tt, axis=1, prepend=tt[:, :1]), 0.0)
        dt[~mask] = 0.0
        x = np.where(mask[:, :, None], ev_value[where], np.nan)
        g = ev_group[begin[own_groups]]
        a, v = smooth(dt, x, r[g], q[g], ev_size[where])
        rows = np.where(mask, ev_row[where], -1)
        take = rows >= 0
        level[rows[take]], sd[rows[take]] = a[take], np.sqrt(v[take])
    none = np.zeros((k, 2), bool)
    for c in range(2):
        none[:, c] = np.bincount(group[np.isfinite(values[:, c])], minlength=k) == 0
    level[none[gg]], sd[none[gg]] = np.nan, np.nan

    names = {c: t.column(c).combine_chunks().take(pa.array(starts[gg])) for c in ("election_id", "unit")}
    return _rows(names, gp, readings, level, sd)


def _rows(names: dict, gp: np.ndarray, readings: np.ndarray, level: np.ndarray, sd: np.ndarray) -> pa.Table:
    def number(x: np.ndarray) -> pa.Array:
        return pa.array(x, pa.float64(), from_pandas=True)

    return pa.table({**names, "period_start": pa.array(gp * PERIOD_S, pa.int64()), "n_readings": pa.array(readings, pa.int64()), "missing": pa.array(readings == 0), "percent_expected_vote": number(level[:, 0]), "percent_expected_vote_sd": number(sd[:, 0]), "results_margin": number(level[:, 1]), "results_margin_sd": number(sd[:, 1])})


def on_grid(readings: DataFrame) -> DataFrame:
    """One row per source and ten-minute period from its first to its last reading.

    readings: election_id, unit, last_modified, received_at, row_id and the two measures.
    A reading needs election, unit and a last_modified that is not after received_at and at
    most two days before it, and one of the measures. Values are smoothed levels at the
    middle of the period, sd their standard deviations; a measure that the source never
    reports is null. `missing` marks periods that hold no reading. Repeated rows count as
    readings of their own; infinite values as none.
    """
    r = readings
    for c in FIELDS:
        r = r.withColumn(c, F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")))
    timed = (F.col("last_modified") <= F.col("received_at")) & (F.col("last_modified") >= F.col("received_at") - F.expr("INTERVAL 2 DAYS"))
    held = F.col(FIELDS[0]).isNotNull() | F.col(FIELDS[1]).isNotNull()
    r = r.filter(timed & held & F.col("unit").isNotNull() & F.col("election_id").isNotNull())
    micros = F.unix_micros("last_modified")
    minute = F.floor(micros / (MINUTE_S * 1_000_000)).cast("long")
    each = [e.alias(n) for c, f in enumerate(FIELDS) for e, n in ((F.coalesce(f, F.lit(0.0)), f"s{c}"), (F.col(f).isNotNull().cast("long"), f"k{c}"))]
    r = r.select("election_id", "unit", minute.alias("minute"), F.lit(1).cast("long").alias("readings"), ((micros - minute * MINUTE_S * 1_000_000) / 1e6).alias("off"), *each)
    combined = r.mapInArrow(_combine, r.schema)
    return grouped.map_groups(combined, ["election_id", "unit"], ["minute"], regular, SCHEMA)


def p4_grid(spark, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "versioned_results").withColumn("unit", repaired_id("geographic_unit_fips"))
    return on_grid(r).withColumnRenamed("unit", "geographic_unit_fips")


def p4_found(spark, sf_dir: str) -> DataFrame:
    return p4_grid(spark, sf_dir).filter("missing").select("election_id", "geographic_unit_fips", "period_start")


def periods(spark, sf_dir: str) -> DataFrame:
    """The periods of the grid with their readings, without the smoothed levels."""
    return p4_grid(spark, sf_dir).select("election_id", "geographic_unit_fips", "period_start", "n_readings", "missing")
