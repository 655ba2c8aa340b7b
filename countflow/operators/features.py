"""Feature building: centring, scaling, separate states, fixed effects with reference levels and holdout values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalise_effects(effects: list[str] | dict[str, list[str] | str]) -> dict[str, list[str] | None]:
    """Effects as a dict of the levels to keep apart; None keeps all."""
    if isinstance(effects, dict):
        return {k: None if v == "all" or v == ["all"] else list(v) for k, v in effects.items()}
    return dict.fromkeys(effects)


def recode(effect: str, levels: list[str] | None) -> Column:
    """An effect's value with levels beyond the selected ones as `other`."""
    c = F.col(effect)
    return c if levels is None else F.when(c.isin(levels), c).when(c.isNotNull(), F.lit("other"))


def center_scale(df: DataFrame, features: list[str], center: bool = True, scale: bool = True, scope: list[str] = ()) -> DataFrame:
    """Features minus their mean and over their sample deviation, over all rows of a scope (null where that is 0)."""
    w = Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(1))
    out = {}
    for f in features:
        x = F.col(f) - F.avg(f).over(w) if center else F.col(f)
        out[f] = F.try_divide(x, F.stddev_samp(f).over(w)) if scale else x
    return df.withColumns(out)


def separate_states(df: DataFrame, features: list[str], states: list[str]) -> tuple[DataFrame, list[str]]:
    """Own copies of the features for some states: {feature}_{state}; the originals are 0 there."""
    out = {}
    for s in states:
        here = F.col("postal_code") == s
        out |= {f"{f}_{s}": F.when(here, F.col(f)).otherwise(0.0) for f in features}
    own = F.col("postal_code").isin(states)
    out |= {f: F.when(own, 0.0).otherwise(F.col(f)) for f in features}
    return df.withColumns(out), [*features, *(f"{f}_{s}" for s in states for f in features)]


def sort_features(names: list[str]) -> list[str]:
    """Intercept first, then names that begin with baseline_normalized_margin, then as given."""
    return sorted(names, key=lambda n: 0 if n == "intercept" else 1 if n.startswith("baseline_normalized_margin") else 2)


@dataclass
class Levels:
    """Levels of each effect: all that occur, those among reporting expected units, and the reference."""

    every: dict[str, list[str]] = field(default_factory=dict)
    active: dict[str, list[str]] = field(default_factory=dict)

    def reference(self, effect: str) -> str | None:
        return self.active[effect][0] if self.active[effect] else None

    def kept(self, effect: str) -> list[str]:
        return self.active[effect][1:]

    def expanded(self, effect: str) -> list[str]:
        return [v for v in self.every[effect] if v != self.reference(effect)]


def levels(df: DataFrame, effects: dict[str, list[str] | None]) -> Levels:
    """Metadata in one small action; effects have few levels by nature."""
    seen = F.col("unit_category").eqNullSafe(F.lit("expected")) & (F.col("reporting") == 1)
    aggs = []
    for e, keep in effects.items():
        v = recode(e, keep).cast("string")
        aggs += [F.sort_array(F.collect_set(v)).alias(f"a_{e}"), F.sort_array(F.collect_set(F.when(seen, v))).alias(f"b_{e}")]
    row = df.agg(*aggs).first() if aggs else {}
    return Levels({e: list(row[f"a_{e}"]) for e in effects}, {e: list(row[f"b_{e}"]) for e in effects})


def one_hot(df: DataFrame, effects: dict[str, list[str] | None], known: Levels, holdout: bool = False) -> DataFrame:
    """0/1 columns {effect}_{level} for all but the reference level.

    holdout: a level that no reporting unit has gets 1 / (k + 1) on each of the k kept levels,
    so that its prediction is their mean with the reference.
    """
    out = {}
    for e, keep in effects.items():
        v = recode(e, keep).cast("string")
        unknown = v.isNotNull() & ~v.isin(known.active[e] or [""])
        share = 1.0 / (len(known.kept(e)) + 1)
        for level in known.kept(e) if holdout else known.expanded(e):
            hit = F.coalesce((v == level).cast("double"), F.lit(0.0))
            out[f"{e}_{level}"] = F.when(unknown, F.lit(share)).otherwise(hit) if holdout else hit
    return df.withColumns(out) if out else df


def one_hot_by_scope(df: DataFrame, effects: dict[str, list[str] | None], known: Levels, scope: list[str]) -> DataFrame:
    """one_hot with holdout values where every scope has levels and a reference of its own.

    Columns are those of all levels that any scope's reporting units have ({effect}_{level});
    a scope's reference, and levels it lacks, are 0 there. known: levels over all scopes.
    """
    seen = F.col("unit_category").eqNullSafe(F.lit("expected")) & (F.col("reporting") == 1)
    w = Window.partitionBy(*scope)
    out = df
    for e, keep in effects.items():
        v = recode(e, keep).cast("string")
        out = out.withColumn("_act", F.sort_array(F.collect_set(F.when(seen, v)).over(w)))
        ref = F.get("_act", F.lit(0))
        unknown = v.isNotNull() & ~F.array_contains("_act", v)
        for level in known.active[e]:
            kept = F.coalesce(F.array_contains("_act", F.lit(level)) & (ref != level), F.lit(False))
            value = F.when(unknown, 1.0 / F.greatest(F.size("_act"), F.lit(1))).otherwise(F.coalesce((v == level).cast("double"), F.lit(0.0)))
            out = out.withColumn(f"{e}_{level}", F.when(kept, value).otherwise(0.0))
        out = out.drop("_act")
    return out


def prepare(df: DataFrame, features: list[str], effects=(), states: list[str] = (), center: bool = True, scale: bool = True, intercept: bool = True) -> tuple[DataFrame, list[str]]:
    """Features ready for a fit: (frame, names). Only states with a reporting unit get features of their own."""
    effects = normalise_effects(effects or {})
    names = list(features)
    if states:
        reports = {r[0] for r in df.filter("reporting = 1").select("postal_code").filter(F.col("postal_code").isin(list(states))).distinct().collect()}
        df, names = separate_states(df, names, [s for s in states if s in reports])
    df = center_scale(df, names, center, scale)
    if intercept:
        own = F.col("postal_code").isin(list(states)) if states else F.lit(False)
        df = df.withColumn("intercept", F.when(own, 0.0).otherwise(1.0))
        names = ["intercept", *names]
    if effects:
        known = levels(df, effects)
        df = one_hot(df, effects, known, holdout=True)
        names += [f"{e}_{v}" for e in effects for v in known.kept(e)]
    return df, sort_features(names)
