"""Stratified residual bootstrap of lead (y) and turnout factor (z).

Two ridge fits give y and z of open units; residuals split into contest effects and unit
errors; unit errors are exchanged through the distribution of their stratum. The fits of
one estimate run in one Arrow function per scope, which returns four arrays of draws per
open unit. All sums over units, ratios and quantiles are SQL.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countflow.functions.common import bounded
from countflow.functions.nulls import half_even, strict_ratio
from countflow.operators.solvers import Ridge, choose_ridge, quantile_regression
from countflow.operators.units import NONREPORTING, REPORTING, UNEXPECTED


class BootstrapError(Exception):
    """Contradictory calls, unknown contests or wrong weights."""


#: Grids of levels below and above the median (fixed values). Built by repeated steps, as the method's grid is: from the
#: 25th step on the upper levels lie a hair above the decimal, so that a level at which n tau is whole takes the next error.
TAUS_LOWER, TAUS_UPPER = np.arange(0.01, 0.5, 0.01), np.arange(0.5, 1, 0.01)
TAUS = np.concatenate([TAUS_LOWER, TAUS_UPPER])
IQR_SCALE = 1.349
CALLED = 0.005


@dataclass
class Settings:
    draws: int = 500
    ridge: float | None = None
    seed: int = 0
    features: list[str] = field(default_factory=lambda: ["baseline_normalized_margin"])
    strata: list[str] = field(default_factory=lambda: ["county_classification"])
    contest: list[str] = field(default_factory=lambda: ["postal_code"])
    y_worst: tuple[float, float] = (-0.3, 0.3)
    z_worst: tuple[float, float] = (-0.5, 0.5)
    y_unobserved: tuple[float, float] = (-1.0, 1.0)
    z_unobserved: tuple[float, float] = (0.5, 1.5)
    percent_error: float = 0.5
    correlations: list[tuple[tuple[str, ...], float]] = field(default_factory=list)
    #: The features are whole columns of the fit already (their own intercept among them), the first `free` without penalty.
    prepared: bool = False
    free: int = 1

    def __post_init__(self) -> None:
        if not self.prepared and "baseline_normalized_margin" not in self.features:
            raise BootstrapError("the bootstrap needs baseline_normalized_margin as a feature")


def effects(units: DataFrame, residual: str, by: list[str], name: str = "epsilon") -> DataFrame:
    """Mean residual per contest; 0 for contests of fewer than two units."""
    return units.groupBy(*by).agg(F.when(F.count(residual) < 2, 0.0).otherwise(F.avg(residual)).alias(name))


def open_bounds(units: DataFrame, s: Settings | None = None) -> DataFrame:
    """Bounds of y and z of open units, from what is counted and what can still come."""
    s = s or Settings()
    f = F.least(F.col("percent_expected_vote"), F.lit(100.0)) / 100
    naive = (f < 0.5) | (F.abs(f - 1) <= 1e-5 + 1e-8)
    y, z = F.col("results_normalized_margin"), F.col("turnout_factor")
    high = z / F.greatest(f - s.percent_error, F.lit(0.01))
    return units.withColumns({
        "y_lower": F.when(naive, s.y_unobserved[0]).otherwise(f * y + (1 - f) * s.y_unobserved[0]),
        "y_upper": F.when(naive, s.y_unobserved[1]).otherwise(f * y + (1 - f) * s.y_unobserved[1]),
        "z_lower": F.when(naive, s.z_unobserved[0]).otherwise(z / (f + s.percent_error)),
        "z_upper": F.when(naive, s.z_unobserved[1]).when(F.abs(high) <= 1e-8, s.z_unobserved[1]).otherwise(high),
    })


class Stratum:
    """The distribution of a stratum's unit errors with one worst case added on either side.

    With strata as a single label the quantile fit is saturated: its value at tau is the
    ceil(n tau)-th smallest error.
    """

    def __init__(self, errors: np.ndarray, worst: tuple[float, float]) -> None:
        def at(values: np.ndarray, taus: np.ndarray) -> np.ndarray:
            v = np.sort(values)
            k = np.ceil(len(v) * taus - 1e-9).astype(int) - 1
            exact = np.ceil(len(v) * taus).astype(int) - 1
            return v[np.clip(np.where(taus > 0.74, exact, k), 0, len(v) - 1)]

        self.points = np.concatenate([at(np.append(errors, worst[0]), TAUS_LOWER), at(np.append(errors, worst[1]), TAUS_UPPER)])

    def inverse(self, u: np.ndarray) -> np.ndarray:
        return np.interp(u, TAUS, self.points, self.points.min(), self.points.max())

    def level(self, x: np.ndarray) -> np.ndarray:
        # Of equal points the last one counts (the right edge of a step).
        u = np.interp(x, self.points, TAUS, right=1)
        u = np.where(np.abs(u - 1) < 1e-5, TAUS.max(), u)
        return np.where(np.abs(u) < 1e-8, TAUS.min(), u)

    def variance(self) -> float:
        return float(((self.inverse(np.array(0.75)) - self.inverse(np.array(0.25))) / IQR_SCALE) ** 2)


def strata_points(units: DataFrame, residual: str, by: list[str], taus: list[float], worst: tuple[float, float]) -> DataFrame:
    """Points of each stratum's error distribution (q_0, q_1, ... in order of taus), with its worst cases; null errors are left out."""
    rows = units.filter(F.col(residual).isNotNull()).select(*by, F.col(residual).cast("double").alias("_e"))
    at = [int(np.abs(TAUS - t).argmin()) for t in taus]
    fields = [f for f in rows.schema.fields if f.name in by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[by].head(1).copy()
        points = Stratum(pdf["_e"].to_numpy(), worst).points
        for k, i in enumerate(at):
            out[f"q_{k}"] = float(points[i])
        return out

    return rows.groupBy(*by).applyInPandas(run, T.StructType([*fields, *(T.StructField(f"q_{k}", T.DoubleType()) for k in range(len(taus)))]))


def coefficients(units: DataFrame, y: str, features: list[str], weight: str, by: list[str], ridge: float = 0.0) -> DataFrame:
    """The weighted ridge fit of y per scope: intercept and one coefficient per feature, null where they cannot be told apart. Rows with nulls are left out."""
    rows = units.dropna(subset=[y, *features, weight]).select(*by, F.col(y).alias("_y"), F.col(weight).alias("_w"), *features)
    names = ["intercept", *features]
    fields = [f for f in rows.schema.fields if f.name in by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(pdf)), pdf[features].to_numpy(float)])
        w = pdf["_w"].to_numpy(float)
        beta = np.full(len(names), np.nan)
        if w.sum() > 0 and np.linalg.matrix_rank(x[w > 0]) == len(names):
            beta = Ridge(x, w, ridge).fit(pdf["_y"].to_numpy(float))
        return pdf[by].head(1).assign(**{n: [None if np.isnan(v) else float(v)] for n, v in zip(names, beta)})

    return rows.groupBy(*by).applyInPandas(run, T.StructType([*fields, *(T.StructField(n, T.DoubleType()) for n in names)]))


class Additive(Stratum):
    """A stratum of several label columns: additive quantile fits over all of them."""

    def __init__(self, dummies: np.ndarray, errors: np.ndarray, own: np.ndarray, worst: tuple[float, float]) -> None:
        x = np.vstack([dummies, own])
        parts = []
        for taus, bound in ((TAUS_LOWER, worst[0]), (TAUS_UPPER, worst[1])):
            y = np.append(errors, bound)
            parts += [own @ quantile_regression(x, y, float(t)) for t in taus]
        self.points = np.maximum.accumulate(np.array(parts))


def _by_contest(values: np.ndarray, contest: np.ndarray, n: int) -> np.ndarray:
    """Contest means of each column of values; 0 where fewer than two units."""
    count = np.bincount(contest, minlength=n)
    flat = values.reshape(len(contest), -1)
    total = np.zeros((n, flat.shape[1]))
    np.add.at(total, contest, flat)
    return np.where(count[:, None] < 2, 0.0, total / np.maximum(count, 1)[:, None])


def draw(train: dict, test: dict, s: Settings) -> dict[str, np.ndarray]:
    """Draws for the open units of one estimate.

    train, test: x (units x features, the first column constant unless prepared otherwise), contest and stratum
    (integer labels); train also y, z, w; test also the four bounds, w and, where known,
    extrapolated y with deviation (NaN elsewhere) and a fixed y (NaN elsewhere).
    """
    rng = np.random.default_rng(s.seed)
    n, m, b = len(train["y"]), len(test["w"]), s.draws
    contests = int(max(train["contest"].max(initial=-1), test["contest"].max(initial=-1))) + 1
    models, errors, eps, delta = {}, {}, {}, {}
    for k in "yz":
        ridge = s.ridge if s.ridge is not None else choose_ridge(train["x"], train[k], train["w"], s.free, rng=rng)
        models[k] = Ridge(train["x"], train["w"], ridge, s.free)
        errors[k] = models[k].residuals(train[k], leave_one_out=True, center=True)
        eps[k] = _by_contest(errors[k], train["contest"], contests)[:, 0]
        delta[k] = errors[k] - eps[k][train["contest"]]

    strata = {}
    for k, worst in (("y", s.y_worst), ("z", s.z_worst)):
        for label in np.unique(np.concatenate([train["stratum"], test["stratum"]])):
            if "dummies" in train:
                own = train["all_dummies"][label]
                strata[k, label] = Additive(train["dummies"], delta[k], own, worst)
            else:
                strata[k, label] = Stratum(delta[k][train["stratum"] == label], worst)

    count = np.bincount(train["contest"], minlength=contests)
    redrawn, levels = {}, []
    for k in "yz":
        unit_var = np.array([strata[k, label].variance() for label in train["stratum"]])
        var = np.bincount(train["contest"], weights=unit_var, minlength=contests) / np.maximum(count, 1)
        var[count < 2] = 0.0
        redrawn[k] = eps[k][:, None] + np.sqrt(var)[:, None] * rng.standard_normal((contests, b))
        u = np.empty(n)
        for label in np.unique(train["stratum"]):
            at = train["stratum"] == label
            u[at] = strata[k, label].level(delta[k][at] + 1e-6)
        levels.append(u)
    # Levels of y and z are drawn in pairs, across strata, and read back in each unit's own stratum.
    picked = rng.integers(0, n, (n, b))
    first, fitted, center = {}, {}, {}
    for c, k in enumerate("yz"):
        back = np.empty((n, b))
        for label in np.unique(train["stratum"]):
            at = train["stratum"] == label
            back[at] = strata[k, label].inverse(levels[c][picked[at]])
        target = (train["x"] @ models[k].fit(train[k]))[:, None] + redrawn[k][train["contest"]] + back
        refit = models[k].fit(target)
        again = _by_contest(models[k].residuals(target, leave_one_out=True, center=True), train["contest"], contests)
        first[k] = test["x"] @ refit + again[test["contest"]]
    first["z"] = np.clip(first["z"], test["z_lower"][:, None], test["z_upper"][:, None])
    if "extrapolated" in test:
        known = np.isfinite(test["extrapolated"]) & np.isfinite(test["extrapolated_std"])
        own = np.maximum(first["y"].std(axis=1) ** 2, 1e-5)
        other = np.maximum(np.where(known, test["extrapolated_std"], 0.0) ** 2, 1e-5)
        share = np.where(known, other / (own + other), 1.0)[:, None]
        first["y"] = share * first["y"] + (1 - share) * np.where(known, test["extrapolated"], 0.0)[:, None]
    if "anchored" in test:
        known = np.isfinite(test["anchored"])
        now = np.clip(first["y"], test["y_lower"][:, None], test["y_upper"][:, None]).mean(axis=1)
        first["y"] = first["y"] + np.where(known, test["anchored"] - now, 0.0)[:, None]
    first["y"] = np.clip(first["y"], test["y_lower"][:, None], test["y_upper"][:, None])
    for k in "yz":
        center[k] = first[k].mean(axis=1)

    fresh_eps = _fresh_effects(errors, eps, train["contest"], test["contest"], contests, s, rng, train.get("names"))
    uniform = rng.uniform(size=(m, b, 2))
    for c, k in enumerate("yz"):
        noise = np.empty((m, b))
        for label in np.unique(test["stratum"]):
            at = test["stratum"] == label
            noise[at] = strata[k, label].inverse(uniform[at, :, c])
        raw = center[k][:, None] + fresh_eps[k] + noise
        fitted[k] = np.clip(raw, test[f"{k}_lower"][:, None], test[f"{k}_upper"][:, None])
    w = test["w"][:, None]
    return {"b1": first["y"] * first["z"] * w, "b2": fitted["y"] * fitted["z"] * w, "b3": first["z"] * w, "b4": fitted["z"] * w, "pred_margin": center["y"] * center["z"] * test["w"], "pred_turnout": center["z"] * test["w"]}


def _fresh_effects(errors, eps, train, test, contests, s: Settings, rng, names) -> dict[str, np.ndarray]:
    """New contest effects: the rest of a finite population where units are in, the observed effects' spread where none are."""
    some = np.flatnonzero(eps["y"] != 0)
    if len(some) <= 1:
        return {k: np.zeros((len(test), s.draws)) for k in "yz"}
    n = np.bincount(train, minlength=contests).astype(float)
    total = n + np.bincount(test, minlength=contests)
    std = np.empty(2 * contests)
    for c, k in enumerate("yz"):
        sq = np.bincount(train, weights=errors[k] ** 2, minlength=contests)
        mean = np.bincount(train, weights=errors[k], minlength=contests) / len(train)
        with np.errstate(all="ignore"):
            var = (sq / len(train) - mean**2) * len(train) / (n - 1) * (1 - n / total) / n
        seen = eps[k][eps[k] != 0]
        var = np.where(np.isfinite(var) & (n >= 2), var, np.var(seen, ddof=1) if len(seen) > 1 else 0.0)
        std[c::2] = np.sqrt(np.maximum(var, 0.0))
    r = np.nan_to_num(np.corrcoef(eps["y"][some], eps["z"][some]), nan=0.0)
    r[0, 0] = r[1, 1] = 1.0
    corr = np.kron(np.eye(contests), r)
    place = {name: i for i, name in enumerate(names or [])}
    for group, rho in s.correlations:
        at = [place[g] for g in group if g in place]
        cross = min(r[0, 1], rho)
        block = np.array([[rho, cross], [cross, rho]])
        for i in at:
            for j in at:
                if i != j:
                    corr[2 * i : 2 * i + 2, 2 * j : 2 * j + 2] = block
    values, vectors = np.linalg.eigh(corr)
    if values.min() < -1e-5:
        corr = (vectors * np.maximum(values, 0.0)) @ vectors.T
        size = np.sqrt(np.diag(corr))
        corr = corr / np.outer(size, size)
        values, vectors = np.linalg.eigh(corr)
    root = vectors * np.sqrt(np.maximum(values, 0.0))
    sample = (root @ rng.standard_normal((2 * contests, s.draws))) * std[:, None]
    return {"y": sample[0::2][test], "z": sample[1::2][test]}


def unit_draws(units: DataFrame, scope: list[str], s: Settings) -> DataFrame:
    """Open units with pred_margin, pred_turnout and the draws b1 to b4 (arrays of s.draws doubles).

    units: classified units with features, results_normalized_margin, turnout_factor,
    baseline_weights and, optionally, pred_extrapolate(+_std) and pred_anchored. Scopes with
    fewer than 10 reporting units give no rows. Null features count as their scope's mean,
    null strata as a stratum of their own.
    """
    optional = [c for c in ("pred_extrapolate", "pred_extrapolate_std", "pred_anchored") if c in units.columns]
    cols = [*dict.fromkeys([*scope, "geographic_unit_fips", "role", *s.contest, *s.strata, *s.features, "results_normalized_margin", "turnout_factor", "baseline_weights", "y_lower", "y_upper", "z_lower", "z_upper", *optional])]
    rows = open_bounds(units.filter(F.col("role") != UNEXPECTED), s).select(*cols)
    keep = [*scope, "geographic_unit_fips"]
    schema = T.StructType([*(f for f in rows.schema.fields if f.name in keep), T.StructField("pred_margin", T.DoubleType()), T.StructField("pred_turnout", T.DoubleType()), *(T.StructField(f"b{i}", T.ArrayType(T.DoubleType())) for i in range(1, 5))])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("geographic_unit_fips", kind="stable").reset_index(drop=True)
        # Features enter as they are, neither centred nor scaled: the penalty is one on their own scales.
        x = pdf[s.features].astype(float)
        x = x.fillna(x.mean()).fillna(0.0).to_numpy()
        x = x if s.prepared else np.column_stack([np.ones(len(pdf)), x])
        contest, names = pd.factorize(pdf[s.contest].fillna("").agg("_".join, axis=1), sort=True)
        labels = pdf[s.strata].fillna("")
        stratum, kinds = pd.factorize(labels.agg("_".join, axis=1), sort=True)
        on = ((pdf["role"] == REPORTING) & pdf["results_normalized_margin"].notna() & pdf["turnout_factor"].notna()).to_numpy()
        off = (pdf["role"] == NONREPORTING).to_numpy()
        if on.sum() < 10 or not off.any():
            return pdf.loc[pdf.index[:0], keep].assign(pred_margin=pd.Series(dtype=float), pred_turnout=pd.Series(dtype=float), **{f"b{i}": pd.Series(dtype=object) for i in range(1, 5)})
        number = lambda c: pdf[c].to_numpy(float)
        train = {"x": x[on], "contest": contest[on], "stratum": stratum[on], "y": number("results_normalized_margin")[on], "z": number("turnout_factor")[on], "w": np.maximum(number("baseline_weights")[on], 1e-9), "names": list(names)}
        test = {"x": x[off], "contest": contest[off], "stratum": stratum[off], "w": number("baseline_weights")[off], **{c: number(c)[off] for c in ("y_lower", "y_upper", "z_lower", "z_upper")}}
        if len(s.strata) > 1:
            dummies = pd.get_dummies(labels).to_numpy(float)
            train["dummies"] = dummies[on]
            train["all_dummies"] = {k: dummies[np.flatnonzero(stratum == k)[0]] for k in np.unique(stratum)}
        if "pred_extrapolate" in optional:
            test |= {"extrapolated": number("pred_extrapolate")[off], "extrapolated_std": number("pred_extrapolate_std")[off]}
        if "pred_anchored" in optional:
            test["anchored"] = number("pred_anchored")[off]
        got = draw(train, test, s)
        out = pdf.loc[off, keep].copy()
        out["pred_margin"], out["pred_turnout"] = got["pred_margin"], got["pred_turnout"]
        for k in ("b1", "b2", "b3", "b4"):
            out[k] = list(got[k])
        return out

    return rows.groupBy(*scope).applyInPandas(run, schema)


def quantile_levels(alpha: float, draws: int) -> tuple[float, float]:
    low = (1 - alpha) / 2
    return math.floor(low * (draws + 1)) / draws, math.ceil((1 - low) * (draws - 1)) / draws


def _spread(error: Column, alpha: float, draws: int) -> list[Column]:
    lo, hi = quantile_levels(alpha, draws)
    return [F.percentile(error, F.lit(lo)).alias("_lo"), F.percentile(error, F.lit(hi)).alias("_hi")]


def unit_intervals(drawn: DataFrame, scope: list[str], alpha: float, draws: int) -> DataFrame:
    by = [*scope, "geographic_unit_fips"]
    rows = drawn.select(*by, "pred_margin", F.explode(F.zip_with("b1", "b2", lambda a, b: a - b)).alias("_e"))
    out = rows.groupBy(*by).agg(F.first("pred_margin").alias("_p"), *_spread(F.col("_e"), alpha, draws))
    return out.select(*by, half_even(F.col("_p") - F.col("_hi")).alias(f"lower_{alpha}_margin"), half_even(F.col("_p") - F.col("_lo")).alias(f"upper_{alpha}_margin"))


def group_draws(units: DataFrame, drawn: DataFrame, scope: list[str], keys: list[str]) -> DataFrame:
    """Per group and draw: e1 and e2, the lead of the two bootstrap worlds over all units of the group.

    Draws are summed with a map-side combine per (group, draw), never collected per group.
    """
    by = [*scope, *keys]
    known = units.filter(F.col("role") != NONREPORTING).dropna(subset=by)
    if "county_classification" in keys:
        known = known.filter(F.col("role") != UNEXPECTED)
    fixed = known.groupBy(*by).agg(F.sum(F.when(F.col("role") == REPORTING, F.col("baseline_weights") * F.col("turnout_factor") * F.col("results_normalized_margin")).otherwise(F.col("results_margin"))).alias("_m"), F.sum(F.when(F.col("role") == REPORTING, F.col("baseline_weights") * F.col("turnout_factor")).otherwise(F.col("results_weights"))).alias("_w"))
    on = [*scope, "geographic_unit_fips"]
    named = drawn.join(units.filter(F.col("role") == NONREPORTING).select(*dict.fromkeys([*on, *keys])), on)
    long = named.dropna(subset=by).select(*by, F.posexplode(F.arrays_zip("b1", "b2", "b3", "b4")).alias("draw", "_b"))
    sums = long.groupBy(*by, "draw").agg(*[F.sum(f"_b.b{i}").alias(f"s{i}") for i in range(1, 5)])
    j = sums.join(fixed, by, "left")
    m, w = F.coalesce("_m", F.lit(0.0)), F.coalesce("_w", F.lit(0.0))
    zero = F.lit(0.0)
    return j.select(*by, "draw", F.coalesce(F.try_divide(F.col("s1") + m, F.col("s3") + w), zero).alias("e1"), F.coalesce(F.try_divide(F.col("s2") + m, F.col("s4") + w), zero).alias("e2"))


def calls(spark, called: dict[str, list[str]], contests: set[str]) -> DataFrame:
    """A small frame of calls: contest, call (1 or 0), stop. called: lhs, rhs, stop."""
    lhs, rhs, stop = (set(called.get(k, [])) for k in ("lhs", "rhs", "stop"))
    if lhs & rhs:
        raise BootstrapError(f"called for both sides: {sorted(lhs & rhs)}")
    for side in (lhs, rhs, stop):
        if side - contests:
            raise BootstrapError(f"no such contests: {sorted(side - contests)}")
    rows = [(c, 1 if c in lhs else 0 if c in rhs else -1, c in stop) for c in sorted(lhs | rhs | stop)]
    return spark.createDataFrame(rows, "contest string, call int, stop boolean")


def apply_call(pred: Column, call: Column) -> Column:
    """A called contest's prediction lies on its side of the threshold."""
    return F.when(call == 1, F.greatest(pred, F.lit(CALLED))).when(call == 0, F.least(pred, F.lit(-CALLED))).otherwise(pred)


def group_intervals(draws_: DataFrame, predictions: DataFrame, by: list[str], alpha: float, draws: int, called: DataFrame | None = None) -> DataFrame:
    """Intervals of the normalised lead per group; predictions holds pred_margin (after calls, at the top level).

    The interval reaches at least .001 beyond the prediction. Calls and stops (columns of
    `called`, joined on contest = the last key) move its ends.
    """
    spread = draws_.groupBy(*by).agg(*_spread(F.col("e1") - F.col("e2"), alpha, draws))
    j = predictions.join(spread, by, "left").fillna(0.0, ["_lo", "_hi"])
    p = F.col("pred_margin")
    low, high = F.least(p - F.col("_hi"), p - 0.001), F.greatest(p - F.col("_lo"), p + 0.001)
    if called is not None:
        j = j.join(bounded(called.withColumnRenamed("contest", by[-1])), by[-1], "left")
        call, stop = F.coalesce("call", F.lit(-1)), F.coalesce("stop", F.lit(False))
        low = F.when((low < 0) & (call == 1), CALLED).otherwise(low)
        high = F.when((high > 0) & (call == 0), -CALLED).otherwise(high)
        low, high = F.when((low > 0) & stop, -CALLED).otherwise(low), F.when((high < 0) & stop, CALLED).otherwise(high)
    return j.select(*by, "pred_margin", low.alias(f"lower_{alpha}_margin"), high.alias(f"upper_{alpha}_margin"))


def national_summary(predictions: DataFrame, draws_: DataFrame, weights: DataFrame, by: list[str], alpha: float, draws: int, base: float = 0.0, called: DataFrame | None = None, temperature: float | None = None) -> DataFrame:
    """The weighted number of contests won, with an interval: agg_pred, lower, upper.

    A contest that is ahead can be lost, and one that is behind won, where more than the
    lower quantile level of its draws say so. Calls remove that doubt, stops add it.
    weights: the last key and `weight`; every contest needs one. temperature replaces the hard
    threshold of the point prediction by a sigmoid.
    """
    key, scope = by[-1], by[:-1]
    lo, _ = quantile_levels(alpha, draws)
    bad = predictions.join(weights, key, "left_anti").limit(1).count()
    if bad:
        raise BootstrapError("every contest needs a weight")
    d = draws_.join(predictions.select(*by, "pred_margin"), by).withColumn("_x", F.col("pred_margin") - (F.col("e1") - F.col("e2")))
    share = d.groupBy(*by).agg(F.avg((F.col("_x") > 0).cast("double")).alias("_up"), F.avg((F.col("_x") < 0).cast("double")).alias("_down"))
    j = predictions.join(share, by, "left").join(bounded(weights), key)
    j = j.join(bounded(called.withColumnRenamed("contest", key)), key, "left") if called is not None else j.withColumns({"call": F.lit(-1), "stop": F.lit(False)})
    ahead = F.col("pred_margin") > 0
    up, down = F.coalesce("_up", ahead.cast("double")), F.coalesce("_down", (~ahead).cast("double"))
    open_ = F.coalesce("call", F.lit(-1)) == -1
    stop = F.coalesce("stop", F.lit(False))
    loss = F.when(ahead & (stop | (open_ & (down > lo))), F.col("weight")).otherwise(0.0)
    gain = F.when(~ahead & (stop | (open_ & (up > lo))), F.col("weight")).otherwise(0.0)
    won = F.col("weight") * (ahead.cast("double") if temperature is None else 1 / (1 + F.exp(-temperature * F.col("pred_margin"))))
    total = j.groupBy(*scope).agg(F.sum(won).alias("_won"), F.sum(loss).alias("_loss"), F.sum(gain).alias("_gain"))
    two = lambda c: F.bround(c + base, 2)
    return total.select(*scope, two(F.col("_won")).alias("agg_pred"), two(F.col("_won") - F.col("_loss")).alias(f"lower_{alpha}"), two(F.col("_won") + F.col("_gain")).alias(f"upper_{alpha}"))


def anchor(open_units: DataFrame, sibling: DataFrame, scope: list[str] = (), district: bool = False) -> DataFrame:
    """Open units with pred_anchored: a sibling contest's predicted lead plus the gap between both contests so far.

    sibling: geographic_unit_fips, results_margin, results_weights, pred_margin, pred_turnout,
    baseline_normalized_margin. In district elections ids carry the county as second part.
    """
    part = F.split("geographic_unit_fips", "_")
    key = F.coalesce(F.get(part, F.lit(1)), F.col("geographic_unit_fips"))
    sib = sibling.select(*scope, F.col("geographic_unit_fips").alias("_key"), strict_ratio("results_margin", "results_weights").alias("_now"), strict_ratio("pred_margin", "pred_turnout").alias("_then"), F.col("baseline_normalized_margin").alias("_base"))
    j = open_units.withColumn("_key", key).join(sib, [*scope, "_key"], "left")
    shift = F.col("baseline_normalized_margin") - F.col("_base") if district else F.lit(0.0)
    return j.withColumn("pred_anchored", (F.col("_then") + shift) + (F.col("results_normalized_margin") - (F.col("_now") + shift))).drop("_key", "_now", "_then", "_base")


def top_level(by: list[str]) -> bool:
    return set(by) in ({"postal_code"}, {"postal_code", "district"})


def delta(units: DataFrame, residual: str, by: list[str]) -> DataFrame:
    """Units with epsilon (their contest's effect) and delta (what is left of the residual)."""
    w = Window.partitionBy(*by)
    eps = F.when(F.count(residual).over(w) < 2, 0.0).otherwise(F.avg(residual).over(w))
    return units.withColumn("epsilon", eps).withColumn("delta", F.col(residual) - F.col("epsilon"))
