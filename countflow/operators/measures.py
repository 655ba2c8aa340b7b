"""Derived measures: a name e expands to columns results_e, baseline_e, last_election_results_e and so on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countflow.functions.nulls import ratio, strict_ratio

#: A measure derives its columns for one prefix (`results_` or `baseline_`) and names them.
Measure = Callable[[DataFrame, str], tuple[DataFrame, list[str]]]
_REGISTRY: dict[str, Measure] = {}


def register(name: str, measure: Measure | None = None):
    """Registers a measure under a name; usable as a decorator."""
    if measure is None:
        return lambda m: register(name, m) or m
    _REGISTRY[name] = measure
    return None


def registered() -> list[str]:
    return sorted(_REGISTRY)


@register("margin")
def margin(df: DataFrame, prefix: str) -> tuple[DataFrame, list[str]]:
    """Two-way lead; the weights become the two-way total, the normalised lead is 0 where that is 0."""
    a, b = F.col(f"{prefix}dem"), F.col(f"{prefix}gop")
    df = df.withColumns({f"{prefix}weights": a + b, f"{prefix}margin": a - b})
    return df.withColumn(f"{prefix}normalized_margin", ratio(f"{prefix}margin", f"{prefix}weights")), [f"{prefix}margin", f"{prefix}weights", f"{prefix}normalized_margin"]


@register("party_vote_share_dem")
def share_dem(df: DataFrame, prefix: str) -> tuple[DataFrame, list[str]]:
    name = f"{prefix}party_vote_share_dem"
    return df.withColumn(name, strict_ratio(f"{prefix}dem", f"{prefix}turnout")), [name]


def _derive(df: DataFrame, names: list[str], prefix: str) -> tuple[DataFrame, list[str]]:
    out: list[str] = []
    for e in names:
        if f"{prefix}{e}" in df.columns:
            out.append(f"{prefix}{e}")
            continue
        if e not in _REGISTRY:
            raise ValueError(f"unknown measure: {e}")
        df, made = _REGISTRY[e](df, prefix)
        out += [c for c in made if c not in out]
    return df, out


def add_results(df: DataFrame, measures: list[str], historical: bool = False) -> tuple[DataFrame, list[str]]:
    """Result columns of the measures. Historical tables get null columns where theirs are missing."""
    if historical:
        missing = [f"results_{e}" for e in measures if f"results_{e}" not in df.columns]
        df = df.withColumns({c: F.lit(None).cast("double") for c in missing}) if missing else df
        names = [f"results_{e}" for e in measures]
    else:
        df = df.withColumn("results_weights", F.col("results_turnout"))
        df, names = _derive(df, measures, "results_")
    return df, [*names, *([] if "results_turnout" in names else ["results_turnout"])]


def add_baselines(df: DataFrame, pointers: dict[str, str], historical: bool = False) -> DataFrame:
    """Baseline columns and, unless historical, last_election_results_e: the baseline that e points to plus 1 (so never 0)."""
    df = df.withColumn("baseline_weights", F.col("baseline_turnout"))
    df, _ = _derive(df, list(dict.fromkeys(pointers.values())), "baseline_")
    if not historical:
        df = df.withColumns({f"last_election_results_{e}": F.col(f"baseline_{b}") + 1 for e, b in pointers.items()})
    return df


def add_turnout_factor(df: DataFrame) -> DataFrame:
    return df.withColumn("turnout_factor", ratio("results_weights", "baseline_weights"))


def add_residual(df: DataFrame, e: str) -> DataFrame:
    last = F.col(f"last_election_results_{e}")
    return df.withColumn(f"residuals_{e}", (F.col(f"results_{e}") - last) / last)
