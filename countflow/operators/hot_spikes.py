"""Problem 2 for sources that are too large for one task: the verdicts of spikes.find, by many tasks.

Copies are collapsed first and the readings of a source numbered and cut into segments. All
that holds for a whole source is summed over its readings: medians are found by bits, and each
step of the principal component pursuit needs the source's Gram matrix only, so that every
reading replays its own steps from the maps found so far. What crosses a border between two
segments (last values, constant runs, values off course) is carried as a few numbers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countflow.functions.common import bounded, cut
from countflow.operators import grouped, spikes

#: (shift, width) of the digits by which a rank among the bits of non-negative doubles is found.
DIGITS = ((55, 8), (44, 11), (33, 11), (22, 11), (11, 11), (0, 11))
SUMMARY = "_s long, _seg long, x array<double>"


def _matrix(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.column_stack([grouped.floats(b, c) for c in spikes.PROFILE])


def medians(df: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], sources: int) -> np.ndarray:
    """The lower median of each source (column _s) and column of values, without NaN; exact, NaN where there is none."""
    f = len(spikes.PROFILE)
    prefix, rank, count = np.zeros((sources, f), np.int64), None, np.zeros((sources, f), np.int64)
    for shift, width in DIGITS:

        def counted(batches: Iterator[pa.RecordBatch], shift=shift, width=width, prefix=prefix) -> Iterator[pa.RecordBatch]:
            seen: dict[tuple[int, int], int] = defaultdict(int)
            for b in batches:
                s, x = grouped.ints(b, "_s"), values(b)
                bits = np.ascontiguousarray(x + 0.0).view(np.int64)
                fits = np.isfinite(x) & ((bits >> (shift + width)) == prefix[s])
                rows, cols = np.nonzero(fits)
                key, n = np.unique(((s[rows] * f + cols) << width) | ((bits[fits] >> shift) & ((1 << width) - 1)), return_counts=True)
                for k, m in zip(key.tolist(), n.tolist(), strict=True):
                    seen[k] += m
            if seen:
                yield pa.RecordBatch.from_pydict({"k": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

        got = df.mapInArrow(counted, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
        k = np.array([r.k for r in got], np.int64)
        n = np.array([r.n for r in got], np.int64)
        order = np.argsort(k)
        k, n = k[order], n[order]
        cell, digit = k >> width, k & ((1 << width) - 1)
        if rank is None:
            np.add.at(count.reshape(-1), cell, n)
            rank = np.maximum(count - 1, 0) // 2
        new, left = np.zeros(sources * f, np.int64), rank.reshape(-1).copy()
        begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        for i, j in zip(begin, np.append(begin[1:], len(cell)), strict=True):
            c, up = cell[i], np.cumsum(n[i:j])
            at = int(np.searchsorted(up, left[c], side="right"))
            new[c] = digit[i + at]
            left[c] -= up[at] - n[i + at]
        prefix, rank = (prefix << width) | new.reshape(sources, f), left.reshape(sources, f)
    return np.where(count > 0, prefix.view(np.float64), np.nan)


def _normal(b: pa.RecordBatch, typical: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(source, its rows, its scaled matrix, which entries exist) for each source of a batch."""
    s, v = grouped.ints(b, "_s"), _matrix(b)
    for one in np.unique(s):
        at = np.flatnonzero(s == one)
        seen = np.isfinite(v[at])
        yield int(one), at, np.where(seen, np.clip(np.where(seen, v[at], 0.0) / typical[one], -20, 20), 0.0), seen


def _replayed(m: np.ndarray, seen: np.ndarray, steps: list[tuple], lam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, s, y = np.zeros_like(m), np.zeros_like(m), np.zeros_like(m)
    for share, mu in steps:
        low, s, y = spikes.shrunk(m, seen, np.where(seen, m - s + y / mu, low), y, share, mu, lam)
    return low, s, y


def sparse_parts(df: DataFrame, typical: np.ndarray) -> DataFrame:
    """df with _p: the sizes of each reading's sparse parts, as spikes.robust_pca finds them for whole sources."""
    sources, f = typical.shape
    steps: list[list[tuple]] = [[] for _ in range(sources)]
    lam, mu = np.zeros(sources), np.ones(sources)
    limit = mu
    for k in range(spikes.RANK_ITERATIONS):

        def grams(batches: Iterator[pa.RecordBatch], k=k, steps=steps, lam=lam, mu=mu) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for one, _, m, seen in _normal(b, typical):
                    low, s, y = _replayed(m, seen, steps[one], lam[one])
                    x = np.where(seen, m - s + y / mu[one], low) if k else m
                    total[one] = total.get(one, 0.0) + np.append((x.T @ x).ravel(), seen.any(axis=1).sum())
            if total:
                yield pa.RecordBatch.from_pydict({"_s": pa.array(list(total), pa.int64()), "x": pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64()))})

        sums = np.zeros((sources, f * f + 1))
        for r in df.mapInArrow(grams, "_s long, x array<double>").collect():
            sums[r[0]] += r.x
        gram = sums[:, :-1].reshape(sources, f, f)
        if k == 0:
            norm = np.sqrt(np.trace(gram, axis1=1, axis2=2))
            lam = 2.0 / np.sqrt(np.maximum(np.maximum(sums[:, -1], 1), f))
            mu = np.where(norm > 0, 1.25 / np.maximum(norm, 1e-12), 1.0)
            limit = mu * 1e5
        share = spikes.shares(gram, mu[:, None, None])
        steps = [[*steps[i], (share[i], float(mu[i]))] for i in range(sources)]
        mu = np.minimum(mu * 1.6, limit)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, f))
            for one, at, m, seen in _normal(b, typical):
                out[at] = np.abs(_replayed(m, seen, steps[one], lam[one])[1])
            yield b.append_column("_p", pa.array(list(out), pa.list_(pa.float64())))

    return df.mapInArrow(parts, ", ".join(f"{c} {t}" for c, t in [*df.dtypes, ("_p", "array<double>")]))


def _sparse(b: pa.RecordBatch | pa.Table) -> np.ndarray:
    a = b.column("_p")
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    return a.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _judged(stage: int, v: np.ndarray, sparse: np.ndarray, scale: np.ndarray, noise: np.ndarray, last: np.ndarray, runs: np.ndarray, calm: np.ndarray) -> np.ndarray:
    """One segment. Stage 0: the last value of each measure; 1: per field the updates missed by the first and the
    last run, and whether these are one; 2: per field the last calm value and the doubted ones after it, the first
    calm value and those before it; 3: the verdicts. last, runs (before, after) and calm (value and number before,
    value and number after) tell what the earlier stages found about the neighbours."""
    if stage == 0:
        held = [x[np.isfinite(x)] for x in v.T]
        return np.array([x[-1] if len(x) else np.nan for x in held])
    impossible, above = spikes.ranges(v)
    with_last = np.vstack([last, v])
    others_moved = spikes._updates(with_last, np.zeros(len(with_last), np.int64))
    found, stuck, out = impossible.copy(), np.zeros((len(v), 3), bool), []
    for f in range(3):
        idx = np.flatnonzero(np.isfinite(with_last[:, f]))
        x, moved = with_last[idx, f], others_moved(f)[idx]
        if stage == 1:
            new = np.append(True, x[1:] != x[:-1])[: len(x)]
            missed = np.bincount(np.cumsum(new) - 1, weights=moved & ~new) if len(x) else np.zeros(1)
            out += [missed[0], missed[-1], float(len(missed) == 1)]
            continue
        own = idx > 0
        at = idx[own] - 1
        stuck[at, f] = spikes._stuck(x, np.zeros(len(x), np.int64), moved, *runs[f])[own]
        x = v[at, f]
        doubt = spikes.doubted(f, x, sparse[at], np.full(len(x), noise[f]), np.full(len(x), scale[f])) | impossible[at, f] | above[at]
        doubt &= ~stuck[at, f]
        if stage == 2:
            sure = np.flatnonzero(~doubt)
            out += [x[sure[-1]], len(x) - 1 - sure[-1], x[sure[0]], sure[0]] if len(sure) else [np.nan, len(x), np.nan, len(x)]
            continue
        most = spikes.MAX_EXCURSION + 1
        sides = []
        for value, n in (calm[f, :2], calm[f, 2:]):
            n = int(min(n, most))
            sides.append(([value, *[0.0] * n], [False, *[True] * n]) if np.isfinite(value) else ([0.0] * n, [True] * n))
        (ax, ac), (bx, bc) = sides
        full = np.concatenate([ax, x, bx[::-1]])
        flags = np.concatenate([ac, doubt, bc[::-1]]).astype(bool)
        hit = spikes._excursions(full, flags, np.zeros(len(full), np.int64), np.full(len(full), scale[f]))
        found[at, f] |= hit[len(ax) : len(ax) + len(x)]
    if stage < 3:
        return np.array(out, float)
    found |= stuck
    spikes.settle(v, above, found)
    return found & np.isfinite(v[:, :3])


def _stage(df: DataFrame, stage: int, scale: np.ndarray, noise: np.ndarray, context: dict) -> DataFrame:
    none = (np.full(len(spikes.PROFILE), np.nan), np.zeros((3, 2)), np.tile([np.nan, 0.0, np.nan, 0.0], (3, 1)))

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        v, sparse, s, seg = _matrix(t), _sparse(t), grouped.ints(t, "_s"), grouped.ints(t, "_seg")
        out = []
        for i, j in zip(starts, np.append(starts[1:], t.num_rows), strict=True):
            near = context.get((int(s[i]), int(seg[i])), none)
            out.append(_judged(stage, v[i:j], sparse[i:j], scale[s[i]], noise[s[i]], *near))
        if stage == 3:
            return spikes.cases(grouped.ints(t, "row_id"), np.concatenate(out))
        return pa.table({"_s": pa.array(s[starts], pa.int64()), "_seg": pa.array(seg[starts], pa.int64()), "x": pa.array([x.tolist() for x in out], pa.list_(pa.float64()))})

    return grouped.map_groups(df, ["_s", "_seg"], ["_n"], run, "row_id long, field string" if stage == 3 else SUMMARY)


def _carried(stage: int, rows: list, context: dict) -> dict:
    """The context of every segment with what the summaries of a stage add to it."""
    got: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
    for r in rows:
        got[r[0]][r[1]] = np.array(r.x, float)
    out = {}
    for s, by in got.items():
        segs = sorted(by)
        if stage == 0:
            last = np.full(len(spikes.PROFILE), np.nan)
            for k in segs:
                out[s, k] = (last, np.zeros((3, 2)), np.tile([np.nan, 0.0, np.nan, 0.0], (3, 1)))
                last = np.where(np.isfinite(by[k]), by[k], last)
            continue
        for k in segs:
            last, runs, calm = context[s, k]
            out[s, k] = (last, runs.copy(), calm.copy())
        for f in range(3):
            if stage == 1:
                before = after = 0.0
                for k in segs:
                    out[s, k][1][f, 0] = before
                    head, tail, single = by[k][3 * f : 3 * f + 3]
                    before = before + head if single else tail
                for k in reversed(segs):
                    out[s, k][1][f, 1] = after
                    head, _, single = by[k][3 * f : 3 * f + 3]
                    after = head + (after if single else 0.0)
                continue
            for side, way in ((0, segs), (2, segs[::-1])):
                value, n = np.nan, 0.0
                for k in way:
                    out[s, k][2][f, side : side + 2] = value, n
                    v, m = by[k][4 * f + side : 4 * f + side + 2]
                    value, n = (v, m) if np.isfinite(v) else (value, n + m)
    return out


def wrong_values(rows: DataFrame, names: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Implausible values (row_id, field) of the sources named: rows as in spikes.wrong_values, all on course."""
    numbered = cut(names.withColumn("_s", F.row_number().over(Window.orderBy(*keys)) - 1).withColumn("_s", F.col("_s").cast("long")))
    sources = numbered.count()
    reading = [*keys, "last_modified", *spikes.PROFILE]
    once = rows.groupBy(*reading).agg(F.min("row_id").alias("row_id"))
    once = grouped.prefix_number(once, keys, order, F.floor(F.unix_seconds("last_modified") / 600), "_n")
    once = once.join(bounded(numbered), keys).withColumn("_seg", F.floor(F.col("_n") / grouped.SEGMENT_ROWS).cast("long"))
    once = cut(once.select("_s", "_seg", F.col("_n").cast("long").alias("_n"), "row_id", *reading))

    def sizes(b: pa.RecordBatch) -> np.ndarray:
        x = np.abs(_matrix(b))
        return np.where(np.isfinite(x) & (x > 0), x, np.nan)

    def parts(b: pa.RecordBatch) -> np.ndarray:
        return np.where(np.isfinite(_matrix(b)), _sparse(b), np.nan)

    small = once.select("_s", "_seg", "_n", "row_id", *spikes.PROFILE)
    scale = medians(small, sizes, sources)
    scale = np.where(np.isfinite(scale) & (scale > 0), scale, 1.0)
    small = cut(sparse_parts(small, scale))
    noise = 3 * medians(small, parts, sources)
    context: dict = {}
    for stage in range(3):
        context = _carried(stage, _stage(small, stage, scale, noise, context).collect(), context)
    found = cut(_stage(small, 3, scale, noise, context))
    # Every copy gets the verdict of its reading.
    found = bounded(found.join(once.select("row_id", *reading), "row_id").select("field", *[F.col(c).alias(f"_f_{c}") for c in reading]))
    same = F.lit(True)
    for c in reading:
        same = same & F.col(c).eqNullSafe(F.col(f"_f_{c}"))
    return rows.join(found, same).select("row_id", "field")
